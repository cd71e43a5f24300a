"""Registered queries of the subpackage, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.llm.mailtext import new_text
from loomdex.llm.mixing import mix, mix_report
from loomdex.llm.moderation import unsafe_rates, unsafe_scores
from loomdex.llm.names import entities, variant_pairs
from loomdex.llm.neardup import linked_classes, similar_pairs
from loomdex.llm.packing import pack, packing_report
from loomdex.llm.tokens import token_counts
from loomdex.operators.timestamps import normalise
from loomdex.session import cut, read_table, spread


def _mails(spark: SparkSession, sf: str) -> tuple[DataFrame, int]:
    """List mail of documents and parsed_email in one form, and its number of input splits; a thread is a list and a subject without its reply marks."""
    docs = read_table(spark, sf, "documents", "doc_id", "source_type", "source_id", "source", "title", "author", "created_at", "body").where("source_type = 'mailing_list_msg'")
    one = docs.select(F.lit("documents").alias("src_table"), F.col("doc_id").alias("src_key"), F.col("source_id").alias("message"), F.col("source").alias("feed"), F.col("title").alias("subject"), F.col("author").alias("sender"), F.col("created_at").alias("date"), "body")
    two = read_table(spark, sf, "parsed_email", "mail_id", "message_id", "list_name", "subject", "sender", "date", "body").select(
        F.lit("parsed_email").alias("src_table"), F.col("mail_id").alias("src_key"), F.col("message_id").alias("message"), F.col("list_name").alias("feed"), "subject", "sender", "date", "body"
    )
    raw = one.unionByName(two)
    mails = normalise(spread(raw), "date", "feed", read_table(spark, sf, "source_zones"))
    subject = F.trim(F.regexp_replace(F.lower("subject"), r"^(?:\s*(?:re|aw|fwd?|wg|tr|rv|sv|antw)\s*(?:\[\d+\])?\s*:|\s*\[[^\]]{1,30}\])+", ""))
    message = F.coalesce("message", F.concat_ws(":", "src_table", "src_key"))
    mails = mails.select("src_table", "src_key", message.alias("message"), F.concat_ws(":", "feed", F.nullif(subject, F.lit(""))).alias("thread"), "sender", F.col("utc_us").alias("sent_us"), "body")
    return mails, raw.rdd.getNumPartitions()


def _new_text(spark: SparkSession, sf: str) -> DataFrame:
    mails, splits = _mails(spark, sf)
    return new_text(mails, splits=splits)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return _new_text(spark, sf).where("part = 'text'").select("src_table", "src_key", "line_no")


def p3_parts(spark: SparkSession, sf: str) -> DataFrame:
    return _new_text(spark, sf).groupBy("src_table", "part", "rule").agg(F.count("*").alias("n_lines"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    pairs = similar_pairs(spread(read_table(spark, sf, "documents", "doc_id", "title", "body")), width=3, threshold=0.5)
    return pairs.select(F.col("a").alias("doc_id_a"), F.col("b").alias("doc_id_b"))


def p4_classes(spark: SparkSession, sf: str) -> DataFrame:
    return linked_classes(spread(read_table(spark, sf, "documents", "doc_id", "title", "body")))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return variant_pairs(entities(read_table(spark, sf, "documents", "author")))


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    links = entities(read_table(spark, sf, "documents", "author"))
    return links.groupBy("entity").agg(F.count("*").alias("n_spellings"), F.min("author").alias("first_spelling"))


def _packed(spark: SparkSession, sf: str) -> DataFrame:
    # The container sizes are a handful of parameters, so they are read on the driver.
    capacities = {r[0]: r[1] for r in read_table(spark, sf, "pack_capacities").groupBy("container").agg(F.min("capacity_tokens")).collect()}
    return pack(token_counts(spread(read_table(spark, sf, "documents", "doc_id", "text")), "doc_id", "text"), capacities)


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return _packed(spark, sf)


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing_report(_packed(spark, sf), read_table(spark, sf, "pack_capacities"))


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    sizes = cut(token_counts(spread(read_table(spark, sf, "documents", "doc_id", "text", "source")), "doc_id", "text", "source"))
    return mix(sizes, read_table(spark, sf, "mix_targets"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf).select("doc", "source", "n_tokens", "copies")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mix_report(_mixed(spark, sf), read_table(spark, sf, "mix_targets"))


def p8_weighted(spark: SparkSession, sf: str) -> DataFrame:
    """The mixture with unequal inclusion odds: longer documents of a source are preferred, by the logarithm of their size; the shares reached, and the mean size
    of the drawn and of all documents."""
    sizes = cut(token_counts(spread(read_table(spark, sf, "documents", "doc_id", "text", "source")), "doc_id", "text", "source").withColumn("w", F.log1p("n_tokens")))
    drawn = mix(sizes, read_table(spark, sf, "mix_targets"), weight="w")
    means = drawn.groupBy("source").agg(F.round(F.avg("n_tokens"), 6).alias("mean_drawn")).join(sizes.groupBy("source").agg(F.round(F.avg("n_tokens"), 6).alias("mean_all")), "source")
    return mix_report(drawn, read_table(spark, sf, "mix_targets")).join(means, "source", "left")


def p8_violations(spark: SparkSession, sf: str) -> DataFrame:
    """(source, rule, n): documents with more copies than the source's cap allows, drawn more than once as rows, and 1 where the tokens are off their share by more than
    the operator promises: one document of the source, and of each source for the total; all 0."""
    targets = read_table(spark, sf, "mix_targets")
    sizes = cut(token_counts(spread(read_table(spark, sf, "documents", "doc_id", "text", "source")), "doc_id", "text", "source"))
    mixed = cut(mix(sizes, targets))
    caps = targets.where("source is not null").groupBy("source").agg(F.min("max_repeats").alias("cap"))
    over = mixed.join(caps, "source").groupBy("source").agg(F.count_if(F.col("copies") > F.col("cap")).alias("over cap"), (F.count("*") - F.count_distinct("doc")).alias("drawn twice"))
    largest = sizes.groupBy("source").agg(F.max("n_tokens").alias("most"))
    got = mixed.groupBy("source").agg(F.max("share").alias("share"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens")).join(largest, "source")
    everyone = got.agg(F.sum("tokens").alias("total"), F.sum("most").alias("slack"))
    off = got.crossJoin(F.broadcast(everyone)).select("source", (F.abs(F.col("tokens") - F.col("share") * F.col("total")) > F.col("most") + F.col("share") * F.col("slack")).cast("long").alias("share off"))  # one row
    rows = caps.select("source").join(over, "source", "left").join(off, "source", "left").fillna(0)
    return rows.select("source", F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in ("over cap", "drawn twice", "share off")])).alias("x")).select("source", "x.*")


def p7_violations(spark: SparkSession, sf: str) -> DataFrame:
    """(container, rule, n): bins over the capacity, documents whose tokens are not all in bins, documents split although they fit, and pieces that overlap; all 0."""
    packed, caps = cut(_packed(spark, sf)), read_table(spark, sf, "pack_capacities").groupBy("container").agg(F.min("capacity_tokens").alias("cap"))
    sizes = token_counts(spread(read_table(spark, sf, "documents", "doc_id", "text")), "doc_id", "text")
    bins = packed.where("bin is not null").groupBy("container", "bin").agg(F.sum("tokens").alias("t")).join(caps, "container").groupBy("container").agg(F.count_if(F.col("t") > F.col("cap")).alias("over capacity"))
    documents = packed.groupBy("container", F.col("doc").alias("k")).agg(F.sum("tokens").alias("t"), F.count("*").alias("pieces"), F.max(F.col("first_token") + F.col("tokens")).alias("end"))
    asked = sizes.select("k", "n_tokens", F.lit(1).alias("one")).join(caps.withColumn("one", F.lit(1)), "one")  # a handful of containers
    seen = asked.join(documents, ["container", "k"], "left").groupBy("container").agg(
        F.count_if(F.coalesce("t", F.lit(-1)) != F.col("n_tokens")).alias("tokens lost"), F.count_if((F.col("n_tokens") <= F.col("cap")) & (F.col("pieces") > 1)).alias("split"), F.count_if(F.col("end") != F.col("t")).alias("overlap")
    )
    rows = caps.select("container").join(bins, "container", "left").join(seen, "container", "left").fillna(0)
    return rows.select("container", F.explode(F.array(*[F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n")) for c in ("over capacity", "tokens lost", "split", "overlap")])).alias("x")).select("container", "x.*")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return unsafe_scores(spread(read_table(spark, sf, "documents", "doc_id", "text", "source")))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).where("score >= 0.5").select("doc_id")


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    return unsafe_rates(_scores(spark, sf))


def p9_heldout(spark: SparkSession, sf: str) -> DataFrame:
    """Agreement with the raters on documents of even key, which nobody looked at while writing the grammar; only documents with two ratings or more, all equal."""
    rated = read_table(spark, sf, "moderation_labels").where("unsafe is not null and doc_id % 2 = 0").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("unsafe").alias("lo"), F.max("unsafe").alias("hi")).where("n >= 2 and lo = hi")
    got = _scores(spark, sf).join(rated, "doc_id").select((F.col("lo") == 1).alias("unsafe"), (F.col("score") >= 0.5).alias("found"))
    both = F.count_if(F.col("unsafe") & F.col("found"))
    counts = got.agg(F.count("*").alias("n_rated"), F.count_if("unsafe").alias("n_unsafe"), F.count_if("found").alias("n_found"), both.alias("n_both"))
    return counts.withColumns({"recall": F.try_divide("n_both", "n_unsafe"), "precision": F.try_divide("n_both", "n_found")})


QUERIES = {f.__name__: f for f in (p3_found, p3_parts, p4_found, p4_classes, p5_found, p5_entities, p7_packing, p7_report, p7_violations, p8_mix, p8_shares, p8_weighted, p8_violations, p9_found, p9_rates, p9_heldout)}

_SHINGLES = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(body, '')), '[\p{{L}}\p{{N}}]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(list_transform(range(1, len(w) - {k} + 2), lambda i: array_to_string(w[i:i + {k} - 1], ' '))) AS s FROM w WHERE len(w) >= 30),
tok AS (SELECT doc_id, unnest(s) AS t FROM s), n AS (SELECT doc_id, len(s) AS n FROM s),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM tok a JOIN tok b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY ALL),
pairs AS (SELECT a, b, c / (x.n + y.n - c) AS j FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c / (x.n + y.n - c) >= {t} - 1e-12)
"""
ORACLE = {
    "p7_violations": "SELECT DISTINCT container, rule, 0::BIGINT AS n FROM pack_capacities, (VALUES ('over capacity'), ('tokens lost'), ('split'), ('overlap')) AS v(rule)",
    "p8_violations": "SELECT DISTINCT source, rule, 0::BIGINT AS n FROM mix_targets, (VALUES ('over cap'), ('drawn twice'), ('share off')) AS v(rule) WHERE source IS NOT NULL",
    "p4_found": _SHINGLES.format(k=3, t=0.5) + "SELECT a AS doc_id_a, b AS doc_id_b FROM pairs",
    "p4_classes": _SHINGLES.format(k=5, t=0.8) + """, cls AS (SELECT n.doc_id, least(n.doc_id, coalesce(min(p.a), n.doc_id)) AS class_id FROM n LEFT JOIN pairs p ON p.b = n.doc_id AND p.j > 1 - 1e-12 GROUP BY n.doc_id),
      links AS (SELECT x.class_id AS i, count(DISTINCT y.class_id) AS n_links FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) p JOIN cls x ON x.doc_id = p.a JOIN cls y ON y.doc_id = p.b WHERE x.class_id <> y.class_id GROUP BY 1)
      SELECT c.doc_id, c.class_id, count(*) OVER (PARTITION BY c.class_id) AS n_copies, coalesce(l.n_links, 0) AS n_links FROM cls c LEFT JOIN links l ON l.i = c.class_id""",
}
