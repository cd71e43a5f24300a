"""Registered queries of the core data-cleaning operators (timestamps, hierarchies, orphan references)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.operators.hierarchy import ancestors, descendants, nested_sets
from loomdex.operators.orphans import orphan_references, orphan_report
from loomdex.operators.timestamps import normalise
from loomdex.session import read_table, spread

_CANONICAL = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}\+00:00$"


def _times(spark: SparkSession, sf: str, zones: DataFrame | None = None) -> DataFrame:
    parts = [("documents", "doc_id", "created_at", "source"), ("parsed_email", "mail_id", "date", "list_name"), ("parsed_message", "msg_num", "date", "list_name")]
    rows = None
    for table, key, value, source in parts:
        one = read_table(spark, sf, table, key, value, source).select(F.lit(table).alias("src_table"), F.col(key).alias("src_key"), F.col(value).alias("value"), F.col(source).alias("feed"))
        rows = one if rows is None else rows.unionByName(one)
    return normalise(spread(rows), "value", "feed", read_table(spark, sf, "source_zones") if zones is None else zones)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = _times(spark, sf).where((F.col("status") == "ok") & ~F.col("value").rlike(_CANONICAL))
    return rows.select("src_table", "src_key", "utc_us")


def p1_report(spark: SparkSession, sf: str) -> DataFrame:
    return _times(spark, sf).groupBy("src_table", "feed", "reading", "status").agg(F.count("*").alias("n_values"))


def _trees(spark: SparkSession, sf: str, **options) -> DataFrame:
    return nested_sets(read_table(spark, sf, "documents", "doc_id", "id", "parent_id"), **options)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    rows = read_table(spark, sf, "documents", "doc_id", "parent_id").where("parent_id is not null").select("doc_id")
    return _trees(spark, sf).join(rows, "doc_id").select("doc_id", F.col("root").alias("root_doc_id"), "depth")


def p2_nested_sets(spark: SparkSession, sf: str) -> DataFrame:
    rows = _trees(spark, sf, paths=True)
    return rows.select("doc_id", "root", "depth", "size", F.array_join(F.transform("path", lambda x: x.cast("string")), "/").alias("path"))


def _hundredths(spark: SparkSession, sf: str) -> DataFrame:
    """The stated set of nodes that are asked for: keys divisible by 100, against all rows."""
    return read_table(spark, sf, "documents", "doc_id").where("doc_id % 100 = 0")


def p2_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return descendants(_trees(spark, sf), _hundredths(spark, sf)).select("ancestor", "doc_id")


def p2_ancestors(spark: SparkSession, sf: str) -> DataFrame:
    return ancestors(_trees(spark, sf), _hundredths(spark, sf)).select("doc_id", "ancestor")


def p1_inferred(spark: SparkSession, sf: str) -> DataFrame:
    """Timestamps with the feeds' order of day and month withheld: what expectation-maximisation decides by itself, and how often it agrees with the stated order."""
    zones = read_table(spark, sf, "source_zones")
    stated = _times(spark, sf).select("src_table", "src_key", "feed", F.col("utc_us").alias("stated_us"))
    alone = _times(spark, sf, zones.withColumn("date_order", F.lit(None).cast("string"))).select("src_table", "src_key", F.col("utc_us").alias("inferred_us"), F.col("status").alias("inferred"))
    both = stated.join(alone, ["src_table", "src_key"])
    return both.groupBy("feed", "inferred").agg(F.count("*").alias("n_values"), F.count_if(F.col("stated_us").eqNullSafe(F.col("inferred_us"))).alias("n_agree"))


def _references(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_references(
        read_table(spark, sf, "documents", "doc_id", "id", "parent_id", "source_type", "source_id"),
        read_table(spark, sf, "refs", "id", "from_doc_id", "to_doc_id", "to_external"),
        read_table(spark, sf, "specs", "source_type", "source_id"),
        read_table(spark, sf, "change_log", "doc_id", "change_type", "changed_at"),
        read_table(spark, sf, "sync_state", "source_repo"),
    )


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return _references(spark, sf).where(F.col("state").isin("missing", "deleted", "late")).select("src_table", "src_field", "src_key")


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(_references(spark, sf))


QUERIES = {f.__name__: f for f in (p1_found, p1_report, p1_inferred, p2_found, p2_nested_sets, p2_descendants, p2_ancestors, p6_found, p6_report)}

_WALK = """
WITH RECURSIVE own AS (SELECT id, min(doc_id) AS p FROM documents GROUP BY id),
tree AS (SELECT d.doc_id AS k, o.p FROM documents d LEFT JOIN own o ON d.parent_id = o.id),
down AS (SELECT k, k AS root, 0::BIGINT AS depth, CAST(k AS VARCHAR) AS path FROM tree WHERE p IS NULL
  UNION ALL SELECT t.k, d.root, d.depth + 1, d.path || '/' || t.k FROM tree t JOIN down d ON t.p = d.k),
lost AS (SELECT k, p FROM tree WHERE k NOT IN (SELECT k FROM down)),
reach AS (SELECT k, p AS x FROM lost UNION SELECT r.k, l.p FROM reach r JOIN lost l ON r.x = l.k),
onloop AS (SELECT k FROM reach WHERE k = x),
loops AS (SELECT r.k, min(r.x) AS root FROM reach r JOIN onloop o ON r.x = o.k GROUP BY r.k),
sizes AS (SELECT a.k, count(*) AS size FROM down a JOIN down b ON b.root = a.root AND (b.path = a.path OR starts_with(b.path, a.path || '/')) GROUP BY a.k),
every AS (SELECT k, root, depth, path FROM down UNION ALL SELECT k, root, -1, NULL FROM loops)
"""
_REFS = """
WITH ins AS (SELECT doc_id AS id, min(changed_at) AS t FROM change_log WHERE change_type = 'insert' GROUP BY 1),
kids AS (
  SELECT 'refs' AS src_table, 'to_doc_id' AS src_field, id AS src_key, from_doc_id AS f, to_doc_id AS v FROM refs WHERE to_doc_id IS NOT NULL
  UNION ALL SELECT 'refs', 'to_external', id, from_doc_id, to_external FROM refs WHERE to_external IS NOT NULL
  UNION ALL SELECT 'documents', 'parent_id', doc_id, id, parent_id FROM documents WHERE parent_id IS NOT NULL),
vals AS (SELECT DISTINCT src_field = 'to_external' AS ext, v FROM kids),
kind AS (SELECT ext, v, CASE WHEN NOT ext THEN 'id' WHEN regexp_matches(v, '^(?i:BIP|BOLT|bLIP|LUD|NUT)-[0-9]+$') THEN 'spec'
  WHEN regexp_matches(v, '^[^\\s#]+/[^\\s#]+#[0-9]+$') THEN 'issue' WHEN regexp_matches(v, '^[0-9a-f]{7,40}$') THEN 'commit' END AS kind FROM vals),
docs AS (SELECT d.id, d.source_type, d.source_id, i.t FROM documents d LEFT JOIN ins i ON i.id = d.id),
hits AS (
  SELECT ext, v, d.t FROM kind JOIN docs d ON d.id = v WHERE kind = 'id'
  UNION ALL SELECT ext, v, d.t FROM kind JOIN docs d ON d.id IN ('github_issue:' || replace(v, '#', ':'), 'github_pr:' || replace(v, '#', ':')) WHERE kind = 'issue'
  UNION ALL SELECT ext, v, d.t FROM kind JOIN docs d ON d.source_type = 'commit' AND starts_with(d.source_id, v) WHERE kind = 'commit'
  UNION ALL SELECT ext, v, NULL FROM kind JOIN specs s ON lower(s.source_type) = lower(split_part(v, '-', 1)) AND ltrim(s.source_id, '0') = ltrim(split_part(v, '-', 2), '0') WHERE kind = 'spec'),
best AS (SELECT ext, v, min(t) AS t FROM hits GROUP BY ALL),
rows AS (SELECT k.*, c.kind, i.t AS ft, CASE
    WHEN c.kind IS NULL OR (c.kind = 'issue' AND split_part(k.v, '#', 1) NOT IN (SELECT source_repo FROM sync_state WHERE source_repo IS NOT NULL)) THEN 'none'
    WHEN b.v IS NULL THEN 'gone' WHEN b.t > i.t THEN 'late' ELSE 'ok' END AS state,
    EXISTS (SELECT 1 FROM change_log l WHERE l.doc_id = k.v OR (c.kind = 'issue' AND l.doc_id IN ('github_issue:' || replace(k.v, '#', ':'), 'github_pr:' || replace(k.v, '#', ':')))) AS logged
  FROM kids k JOIN kind c ON c.v = k.v AND c.ext = (k.src_field = 'to_external') LEFT JOIN best b ON b.v = k.v AND b.ext = c.ext LEFT JOIN ins i ON i.id = k.f)
"""
ORACLE = {
    "p2_found": _WALK + "SELECT e.k AS doc_id, e.root AS root_doc_id, e.depth FROM every e JOIN documents d ON d.doc_id = e.k WHERE d.parent_id IS NOT NULL",
    "p2_nested_sets": _WALK + "SELECT e.k AS doc_id, e.root, e.depth, s.size, e.path FROM every e LEFT JOIN sizes s ON s.k = e.k",
    "p2_descendants": _WALK + "SELECT a.k AS ancestor, b.k AS doc_id FROM down a JOIN down b ON b.root = a.root AND starts_with(b.path, a.path || '/') WHERE a.k % 100 = 0",
    "p2_ancestors": _WALK + "SELECT b.k AS doc_id, a.k AS ancestor FROM down a JOIN down b ON b.root = a.root AND starts_with(b.path, a.path || '/') WHERE b.k % 100 = 0",
    "p6_found": _REFS + "SELECT src_table, src_field, src_key FROM rows WHERE state IN ('gone', 'late')",
    "p6_report": _REFS + """SELECT src_table, src_field, strftime(ft, '%Y-%m') AS period, count(*) AS n_refs, count(*) FILTER (state = 'gone' AND NOT logged) AS n_missing,
      count(*) FILTER (state = 'gone' AND logged) AS n_deleted, count(*) FILTER (state = 'late') AS n_late FROM rows WHERE state <> 'none' GROUP BY ALL""",
}
