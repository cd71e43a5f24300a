"""Changes of the stored tables as DataFrame plans: a mutation takes tables and returns the new ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators.enrich import extract_references, tag_concepts

#: On conflict these keep the stored value; everything else takes the new one.
KEPT = ("created_at", "source_type", "source_repo", "source_id")


class DuplicateKeyError(ValueError):
    """Two documents claim one natural key (type, repository, source id)."""


def fold_batch(batch: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by ``order`` (ties by all other columns, so the choice is the same every time); older rows of the key are superseded."""
    return batch.groupBy(key).agg(F.max_by(F.struct(*[c for c in batch.columns if c != key]), F.struct(order, F.to_json(F.struct(*batch.columns)))).alias("r")).select(key, "r.*")


def check_natural_keys(stored: DataFrame, batch: DataFrame) -> None:
    """Raises DuplicateKeyError if a natural key of the batch belongs to two documents. Of the stored rows only those with a key of the batch are compared."""
    key = list(KEPT[1:])
    new = batch.select("id", *key).where("source_repo is not null").distinct()
    every = stored.select("id", *key).join(new.select(*key).distinct(), key, "left_semi").select("id", *key).unionByName(new)
    if every.groupBy(*key).agg(F.count_distinct("id").alias("n")).where("n > 1").limit(1).count():
        raise DuplicateKeyError("a natural key belongs to two documents")


def upsert_documents(stored: DataFrame, batch: DataFrame, change_log: DataFrame | None, at: str, *, check_keys: bool = True, start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, change_log) after the batch: the last row per id wins, creation time and natural key of a stored document stay, ``seq`` is the number
    of its new log entry (the caller's is ignored). The log grows by one ``insert`` or ``update`` entry per row of the batch, in (batch order, id)
    order. ``batch`` has the document columns and ``batch_pos``. Without ``change_log`` only the new entries come back, numbered on from ``start``. Raises DuplicateKeyError before anything is written."""
    columns = stored.columns
    if check_keys:
        check_natural_keys(stored, batch)
    if start is None:
        start = change_log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    known = stored.select("id", F.lit(True).alias("known"))
    entries = batch.select("id", "batch_pos").join(known, "id", "left")
    first = F.row_number().over(Window.partitionBy("id").orderBy("batch_pos"))
    entries = entries.withColumn("change_type", F.when(F.col("known") | (first > 1), "update").otherwise("insert"))
    # batch_pos is dense within a micro-batch, so it numbers the log without a global sort.
    log = entries.select((F.lit(start) + F.col("batch_pos")).cast("bigint").alias("seq"), F.col("id").alias("doc_id"), "change_type", F.lit(at).cast("timestamp").alias("changed_at"))
    last = fold_batch(batch, "id", "batch_pos").withColumn("seq", (F.lit(start) + F.col("batch_pos")).cast("bigint")).select(*columns)
    old = stored.select("id", *[F.col(c).alias(f"_{c}") for c in KEPT])
    merged = last.join(old, "id", "left").select(*[F.when(F.col("_source_id").isNotNull(), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in KEPT else F.col(c) for c in columns])
    return stored.join(last.select("id"), "id", "left_anti").unionByName(merged), log if change_log is None else change_log.unionByName(log)


def append_references(refs: DataFrame, new: DataFrame, *, dedupe: bool = True, start: int | None = None) -> DataFrame:
    """``refs`` with new edges numbered on from the largest id; equal edges are stored once unless ``dedupe`` is off."""
    columns = ["from_doc_id", "to_doc_id", "ref_type", "to_external", "context"]
    if start is None:
        start = refs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rows = new.select(*columns)
    if dedupe:
        rows = rows.distinct()
    # Ids need only be unique and increasing over runs: partition and position give them without a global order.
    numbered = rows.select((F.lit(start + 1) + F.monotonically_increasing_id()).alias("id"), *columns)
    return refs.unionByName(numbered.select(*refs.columns))


def delete_for(table: DataFrame, column: str, documents: DataFrame) -> DataFrame:
    """Rows of ``table`` that do not belong to the given documents (by id)."""
    return table.join(documents.select(F.col("id").alias(column)).distinct(), column, "left_anti").select(*table.columns)


def upsert_mentions(mentions: DataFrame, new: DataFrame) -> DataFrame:
    last = new.groupBy("doc_id", "concept_slug").agg(F.max("confidence").alias("confidence"))
    return mentions.join(last, ["doc_id", "concept_slug"], "left_anti").select("doc_id", "concept_slug", "confidence").unionByName(last)


def seed_concepts(concepts: DataFrame, new: DataFrame) -> DataFrame:
    """Adds concepts whose slug is not there yet."""
    return concepts.unionByName(new.join(concepts.select("slug"), "slug", "left_anti").select(*concepts.columns))


def update_sync_state(states: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by source_id; type and repository of a known source stay."""
    old = states.groupBy("source_id").agg(F.min("source_type").alias("_t"), F.min("source_repo").alias("_r"), F.lit(True).alias("_k"))
    merged = new.join(old, "source_id", "left").withColumns({"source_type": F.when(F.col("_k"), F.col("_t")).otherwise(F.col("source_type")), "source_repo": F.when(F.col("_k"), F.col("_r")).otherwise(F.col("source_repo"))})
    return states.join(new.select("source_id"), "source_id", "left_anti").select(*states.columns).unionByName(merged.select(*states.columns))


def reset_type(documents: DataFrame, refs: DataFrame, mentions: DataFrame, change_log: DataFrame, states: DataFrame, source_type: str, patterns: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """All tables without the documents of a type: their tags, outgoing and resolved incoming references and log entries go, and the sync states that match a
    pattern (LIKE, any case, if it has ``%``, else equal). References by external key from other documents stay. ``removed`` counts documents."""
    gone = documents.where(F.col("source_type") == source_type).select("id")
    match = F.lit(False)
    for p in patterns:
        match = match | (F.col("source_id").ilike(p) if "%" in p else F.col("source_id") == p)
    return {
        "documents": documents.where(F.col("source_type") != source_type),
        "refs": delete_for(delete_for(refs, "from_doc_id", gone), "to_doc_id", gone),
        "mentions": delete_for(mentions, "doc_id", gone),
        "change_log": delete_for(change_log, "doc_id", gone),
        "sync_state": states.where(~F.coalesce(match, F.lit(False))),
        "removed": gone.agg(F.count("*").alias("removed")),
    }


def compact_log(change_log: DataFrame, cutoff: str) -> DataFrame:
    """Log entries not older than ``cutoff``, compared as instants."""
    return change_log.where(F.col("changed_at") >= F.lit(cutoff).cast("timestamp"))


def reenrich(documents: DataFrame, refs: DataFrame, mentions: DataFrame, source_type: str, words: list[tuple[str, list[str]]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(refs, mentions) with those of the type's documents that have a body computed anew from it."""
    todo = documents.where((F.col("source_type") == source_type) & F.col("body").isNotNull())
    edges = extract_references(todo).select("from_doc_id", F.lit(None).cast("string").alias("to_doc_id"), "ref_type", "to_external", "context")
    return append_references(delete_for(refs, "from_doc_id", todo), edges, dedupe=False), delete_for(mentions, "doc_id", todo).unionByName(tag_concepts(todo, words))
