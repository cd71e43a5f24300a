"""Structured Streaming: request windows and incremental ingestion of paged sources."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators.enrich import extract_references, tag_concepts
from loomdex.operators.mutations import append_references, check_natural_keys, delete_for, fold_batch, upsert_documents
from loomdex.session import checkpoint_dir, cut


def minute_counts(events: DataFrame, ts: str = "ts", late: str = "7 days") -> DataFrame:
    """Requests per minute of a stream; minutes close once they are ``late`` behind the newest event."""
    windows = events.withWatermark(ts, late).groupBy(F.window(ts, "1 minute").alias("w")).agg(F.count("*").alias("n"))
    return windows.select(F.col("w.start").alias("minute"), "n")


def run_to_end(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over all that is available and returns the result written to the shared folder."""
    spark = stream.sparkSession
    base = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    out = f"{base}/out"

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.parquet(out)


def minute_counts_stream(spark: SparkSession, sf_dir: str, table: str = "events") -> DataFrame:
    """``minute_counts`` of a table directory, read as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{table}.parquet").schema
    files = spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").parquet(sf_dir)
    return run_to_end(minute_counts(files.withColumn("ts", F.to_timestamp("ts"))))


class EpochStore:
    """Versioned Parquet tables. Each table is cut into ``buckets`` by a hash of its key; a batch writes a new version of the buckets it touches, or appends a
    part to a table that only grows, and then one numbered manifest that names every part. The newest complete manifest holds, so readers
    see all of a batch or nothing of it, and a crash at any point leaves the last batch in force. One writer. A batch that is run again after a
    failure replaces its own parts."""

    KEYS = {"documents": "id", "refs": "from_doc_id", "concept_mentions": "doc_id"}

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm

    def manifest(self) -> dict:
        """The newest manifest whose last line says that it is complete."""
        fs, jvm = self._fs()
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        names = sorted((f.getPath().getName() for f in fs.listStatus(folder)), reverse=True) if fs.exists(folder) else []
        for name in names:
            lines = [r[0] for r in self.spark.read.text(f"{self.path}/manifests/{name}").collect()] if name.startswith("m-") else []
            if len(lines) == 2 and lines[1] == "complete":
                return json.loads(lines[0])
        return {"epoch": -1, "tables": {}, "cursors": {}, "next_seq": 0, "next_ref": 0}

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, table: str, schema: str | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table, or those of its buckets."""
        parts = self.manifest()["tables"].get(table, {})
        paths = [f"{self.path}/{at}" for b, ats in sorted(parts.items()) if buckets is None or int(b) in buckets for at in ats]
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of the keys, at most ``buckets`` numbers."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(keys.columns[0])).alias("b")).distinct().collect())

    def commit(self, tables: dict[str, DataFrame], epoch: int, *, touched: dict[str, list[int]] | None = None, appends: dict[str, DataFrame] | None = None, cursors: dict[str, str] | None = None, **counters: int) -> None:
        """Writes the new versions of the touched buckets (all, where none are named), the appended parts, and then the manifest."""
        now = self.manifest()
        for name, df in tables.items():
            at, of = f"{name}/epoch={epoch}", (touched or {}).get(name, list(range(self.buckets)))
            if not of:
                continue
            rows = df.withColumn("_b", self.bucket(F.col(self.KEYS[name])))
            rows.repartition(max(1, min(len(of), self.buckets)), "_b").write.mode("overwrite").partitionBy("_b").parquet(f"{self.path}/{at}")
            fs, jvm = self._fs()
            parts = now["tables"].setdefault(name, {})
            for b in of:
                # A bucket that lost all its rows has no folder.
                parts[str(b)] = [f"{at}/_b={b}"] if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.path}/{at}/_b={b}")) else []
        for name, df in (appends or {}).items():
            at = f"{name}/epoch={epoch}"
            df.write.mode("overwrite").parquet(f"{self.path}/{at}")
            now["tables"].setdefault(name, {"0": []})["0"].append(at)
        now["epoch"] = epoch
        now["cursors"] = {**now["cursors"], **(cursors or {})}
        now.update(counters)
        self._publish(now, epoch)

    def _publish(self, manifest: dict, epoch: int) -> None:
        fs, jvm = self._fs()
        part, final = (jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{n}") for n in (f".m-{epoch:012d}.tmp", f"m-{epoch:012d}"))
        out = fs.create(part, True)
        out.write(bytearray((json.dumps(manifest) + "\ncomplete\n").encode()))
        out.close()
        fs.rename(part, final)

    def compact(self, table: str, schema: str, epoch: int) -> None:
        """Rewrites the parts of a growing table as one, apart from any batch."""
        now = self.manifest()
        at = f"{table}/compact={epoch}"
        self.read(table, schema).write.mode("overwrite").parquet(f"{self.path}/{at}")
        now["tables"][table], now["epoch"] = {"0": [at]}, epoch
        self._publish(now, epoch)


EDGES = ("from_doc_id", "to_doc_id", "ref_type", "to_external", "context")


def ingest_batch(
    store: EpochStore, batch: DataFrame, epoch: int, at: str, words: list[tuple[str, list[str]]] | None = None, *, page_refs: DataFrame | None = None, cursors: dict[str, str] | None = None
) -> None:
    """One page or micro-batch: upsert, log, and new references and tags of its documents, committed together with the cursors of its sources. Batches already
    committed are skipped.

    Of rows with one id the last by ``batch_pos`` holds, for the document and for everything taken from it. ``page_refs``: (from_doc_id, to_doc_id,
    ref_type, to_external, context), references that the page itself states (merges, replies); they replace, with those found in the
    body, the old ones of the documents of the batch. Only the buckets of the batch's ids are read and written."""
    from loomdex.schema import CHANGE_LOG, CONCEPT_MENTIONS, DOCUMENTS, REFS

    now = store.manifest()
    if epoch <= now["epoch"]:
        return
    last = cut(fold_batch(batch, "id", "batch_pos").select(*batch.columns))
    buckets = store.touched(last.select("id"))
    stored = store.read("documents", DOCUMENTS, buckets)
    check_natural_keys(store.read("documents", DOCUMENTS), last)
    documents, log = upsert_documents(stored, batch.select(*last.columns), None, at, check_keys=False, start=now["next_seq"])
    todo = last.where("body is not null")
    edges = extract_references(todo).select("from_doc_id", F.lit(None).cast("string").alias("to_doc_id"), "ref_type", "to_external", "context")
    stated = page_refs.select(*EDGES) if page_refs is not None else None
    if stated is not None:
        edges = edges.unionByName(stated)
    # References of documents outside the batch touch their own buckets of that table only.
    of_refs = sorted({*buckets, *store.touched(stated.select("from_doc_id"))}) if stated is not None else buckets
    old_refs = delete_for(store.read("refs", REFS, of_refs), "from_doc_id", todo)
    if stated is not None:
        # A page that is read again states the same edges.
        old_refs = old_refs.join(stated.distinct(), [old_refs[c].eqNullSafe(stated[c]) for c in EDGES], "left_anti")
    refs = cut(append_references(old_refs, edges, start=now["next_ref"]))
    mentions = delete_for(store.read("concept_mentions", CONCEPT_MENTIONS, buckets), "doc_id", todo).unionByName(tag_concepts(todo, words))
    log = cut(log)
    top = {"next_seq": log.agg(F.max("seq")).first()[0] or now["next_seq"], "next_ref": refs.agg(F.max("id")).first()[0] or now["next_ref"]}
    top["next_ref"] = max(top["next_ref"], now["next_ref"])
    store.commit({"documents": documents, "refs": refs, "concept_mentions": mentions}, epoch, touched={"documents": buckets, "refs": of_refs, "concept_mentions": buckets}, appends={"change_log": log}, cursors=cursors, **top)


def ingest_stream(source: DataFrame, store: EpochStore, at: Callable[[], str], words=None, checkpoint: str | None = None):
    """Starts a streaming query that ingests a stream of documents (with ``batch_pos``) to its present end; a restart goes on where it stopped."""
    place = checkpoint or os.path.join(store.path, "_offsets")

    def sink(batch: DataFrame, epoch: int) -> None:
        if not batch.isEmpty():
            ingest_batch(store, batch, epoch, at(), words)

    return source.writeStream.option("checkpointLocation", place).trigger(availableNow=True).foreachBatch(sink).start()
