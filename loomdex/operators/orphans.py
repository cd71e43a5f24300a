"""References to records that do not exist, were deleted or came later.

All keys, of parents and of children, go into one long form ``(kind, key, ...)`` and are grouped once; a group without
parent flag is an orphan key. Children enter the grouping as distinct keys, so a key that a third of all rows refer to
is one row there; child rows meet the verdicts afterwards, in a join whose skewed side may be split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of external references.
SPEC = r"^(?i:(BIP|BOLT|bLIP|LUD|NUT))-(\d+)$"
ISSUE = r"^([^\s#]+/[^\s#]+)#(\d+)$"
COMMIT = r"^[0-9a-f]{7,40}$"
_SHORT = 7


def _targets(value: Column, field: Column) -> Column:
    """Array of (kind, key) that would satisfy the reference; null if the text has no known form."""
    target = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    spec = F.concat(F.lower(F.regexp_extract(value, SPEC, 1)), F.lit(":"), F.regexp_replace(F.regexp_extract(value, SPEC, 2), r"^0+(?=\d)", ""))
    issue = [target("id", F.concat(F.lit(f"github_{t}:"), F.regexp_replace(value, "#", ":"))) for t in ("issue", "pr")]
    return (
        F.when(field != "to_external", F.array(target("id", value)))
        .when(value.rlike(SPEC), F.array(target("spec", spec)))
        .when(value.rlike(ISSUE), F.array(*issue))
        .when(value.rlike(COMMIT), F.array(target("commit", value)))
    )


def _parents(documents: DataFrame, specs: DataFrame, inserted: DataFrame, hashes: DataFrame) -> DataFrame:
    """Long form of the parent side: (kind, key, at); ``at`` is the earliest insert, null if it is unknown or irrelevant."""
    docs = documents.where("id is not null").select("id", "source_type", "source_id").distinct().join(inserted, "id", "left")
    by_id = docs.select(F.lit("id").alias("kind"), F.col("id").alias("key"), "at")
    number = F.regexp_replace("source_id", r"^0+(?=.)", "")
    by_spec = specs.where("source_type is not null and source_id is not null").select(F.lit("spec").alias("kind"), F.concat_ws(":", F.lower("source_type"), number).alias("key"), F.lit(None).cast("timestamp").alias("at"))
    # A hash names every commit that starts with it: meet on the shortest allowed prefix, then compare in full.
    commits = docs.where("source_type = 'commit'").select(F.substring("source_id", 1, _SHORT).alias("h"), "source_id", "at")
    asked = hashes.select(F.substring("key", 1, _SHORT).alias("h"), "key")
    by_hash = asked.join(commits, "h").where(F.expr("startswith(source_id, key)")).select(F.lit("commit").alias("kind"), "key", "at")
    return by_id.unionByName(by_spec).unionByName(by_hash)


def orphan_references(documents: DataFrame, refs: DataFrame, specs: DataFrame, change_log: DataFrame, sync_state: DataFrame) -> DataFrame:
    """One row per reference: ``src_table, src_field, src_key, from_id, value, state, period``.

    state: ``ok``; ``missing`` (no target); ``deleted`` (no target, but the change log knows its id); ``late`` (the target's
    earliest insert is later than the referring document's); ``untracked`` (``repo#N`` of a repository that is not
    tracked); ``unknown`` (no known form). period: month of the referring document's earliest insert, null if unknown.
    Null values are no references; repeated rows stay repeated; without change log entries nothing is late; empty tables
    give an empty result.
    """
    inserted = change_log.where("change_type = 'insert' and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.min("changed_at").alias("at"))
    one = lambda df, table, field, key, source: df.where(F.col(field).isNotNull()).select(
        F.lit(table).alias("src_table"), F.lit(field).alias("src_field"), F.col(key).cast("bigint").alias("src_key"), F.col(source).alias("from_id"), F.col(field).alias("value")
    )
    children = one(refs, "refs", "to_doc_id", "id", "from_doc_id").unionByName(one(refs, "refs", "to_external", "id", "from_doc_id")).unionByName(one(documents, "documents", "parent_id", "doc_id", "id"))
    # Distinct texts first: each is classified and looked up once however often it occurs.
    texts = children.select("value", (F.col("src_field") == "to_external").alias("ext")).distinct()
    targets = texts.select("value", "ext", F.explode_outer(_targets(F.col("value"), F.when(F.col("ext"), "to_external").otherwise("id"))).alias("t")).select("value", "ext", "t.kind", "t.key")
    hashes = targets.where("kind = 'commit'").select("key").distinct()
    tagged = (
        _parents(documents, specs, inserted, hashes).select("kind", "key", "at", F.lit(1).alias("parent"))
        .unionByName(targets.where("kind is not null").select("kind", "key", F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("parent")))
        .unionByName(change_log.where("doc_id is not null").select(F.lit("id").alias("kind"), F.col("doc_id").alias("key"), F.lit(None).cast("timestamp").alias("at"), F.lit(-1).alias("parent")))
    )
    groups = tagged.groupBy("kind", "key").agg(F.max("parent").alias("parent"), F.min("parent").alias("logged"), F.min("at").alias("at"), F.max((F.col("parent") == 0).cast("int")).alias("child"))
    verdict = groups.where("child = 1").select("kind", "key", (F.col("parent") == 1).alias("there"), (F.col("logged") == -1).alias("logged"), "at")
    tracked = sync_state.where("source_repo is not null").select(F.col("source_repo").alias("repo"), F.lit(True).alias("tracked")).distinct()
    verdict = targets.join(verdict, ["kind", "key"], "left").groupBy("value", "ext").agg(
        F.coalesce(F.max("there"), F.lit(False)).alias("there"), F.coalesce(F.max("logged"), F.lit(False)).alias("logged"), F.min(F.when(F.col("there"), F.col("at"))).alias("at"), F.max("kind").alias("kind")
    )
    repo = F.when(F.col("ext"), F.nullif(F.regexp_extract("value", ISSUE, 1), F.lit("")))
    verdict = verdict.withColumn("repo", repo).join(tracked, "repo", "left")
    origin = inserted.select(F.col("id").alias("from_id"), F.col("at").alias("from_at"))
    rows = children.withColumn("ext", F.col("src_field") == "to_external").join(verdict, ["value", "ext"]).join(origin, "from_id", "left")
    state = (
        F.when(F.col("kind").isNull(), "unknown")
        .when(F.col("repo").isNotNull() & F.col("tracked").isNull(), "untracked")
        .when(~F.col("there"), F.when(F.col("logged"), "deleted").otherwise("missing"))
        .when(F.col("at") > F.col("from_at"), "late")
        .otherwise("ok")
    )
    return rows.select("src_table", "src_field", "src_key", "from_id", "value", state.alias("state"), F.date_format("from_at", "yyyy-MM").alias("period"))


def orphan_report(references: DataFrame) -> DataFrame:
    """Counts per table, field and period: ``n_refs, n_missing, n_deleted, n_late``."""
    n = lambda s: F.count_if(F.col("state") == s).alias(f"n_{s}")
    known = references.where(~F.col("state").isin("unknown", "untracked"))
    return known.groupBy("src_table", "src_field", "period").agg(F.count("*").alias("n_refs"), n("missing"), n("deleted"), n("late"))
