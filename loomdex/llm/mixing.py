"""Mixing sources to target weights: whole copies first, then Pareto order sampling.

A source that must give r times its size gives floor(r) copies of every document and a sample of the rest: documents are ranked by
random odds divided by inclusion odds, ``(u / (1 - u)) / (p / (1 - p))``, and taken in that order up to the wanted number of tokens.
Ranks are cut through a histogram, so no task orders a whole source: a bin of ranks is in, out or, one per source, ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def allocate(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, share, max_repeats, available, wanted): tokens wanted of each source that has any.

    Shares are scaled to add up to 1 over the sources present. Without ``total_tokens`` the total is the largest at which every source
    reaches its share within its cap (the size of all sources if no cap binds); with it, a capped source gives what
    it can. Repeated targets of a source: the largest share and smallest cap hold; null or negative shares count as 0.
    """
    asked = targets.where("source is not null").groupBy("source").agg(F.max(F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))).alias("target_share"), F.min("max_repeats").cast("double").alias("max_repeats"))
    present = asked.join(sizes.where("available > 0"), "source")
    share = F.coalesce(F.try_divide("target_share", F.sum("target_share").over(Window.partitionBy(F.lit(1)))), F.lit(0.0))
    rows = present.withColumn("share", share)  # one row per target: a small table
    if total_tokens is None:
        most = rows.where("share > 0").agg(F.min(F.col("max_repeats") * F.col("available") / F.col("share")), F.sum("available")).first()
        total_tokens = int(most[0] if most[0] is not None else most[1] or 0)
    wanted = F.least(F.col("share") * total_tokens, F.coalesce(F.col("max_repeats"), F.lit(float("inf"))) * F.col("available"))
    return rows.withColumn("wanted", wanted)


def mix(docs: DataFrame, targets: DataFrame, *, key: str = "k", source: str = "source", size: str = "n_tokens", weight: str | None = None, total_tokens: int | None = None, seed: int = 42, bins: int | None = None) -> DataFrame:
    """(doc, source, n_tokens, copies, target_share, share): the documents of the mixture, copies >= 1.

    ``weight``: a positive column by which documents of a source are preferred; expected copies are proportional to it, up to the source's cap
    (default: all alike). Copies never exceed ``max_repeats``. The tokens of a source differ from the wanted ones by less than one
    document. The draw depends on key and seed only. Documents of sources without target, without tokens or with a null key or source
    are not drawn; repeated rows are drawn as documents of their own with equal rank; an empty table gives an empty result.
    """
    w = F.lit(1.0) if weight is None else F.greatest(F.coalesce(F.col(weight).cast("double"), F.lit(0.0)), F.lit(0.0))
    rows = docs.where(F.col(key).isNotNull() & F.col(source).isNotNull() & (F.col(size) > 0)).select(F.col(key).cast("long").alias("doc"), F.col(source).alias("source"), F.col(size).cast("long").alias("n_tokens"), w.alias("w"))
    # As many bins as keep the one that is ordered at some ten thousand documents, whatever the size of a source.
    bins = bins or max(4096, rows.count() // 10_000)
    sizes = rows.groupBy("source").agg(F.sum("n_tokens").alias("available"), F.sum(F.col("n_tokens") * F.col("w")).alias("weighted"))
    plan = allocate(sizes, targets, total_tokens)
    rows = rows.join(plan, "source")
    cap = F.coalesce("max_repeats", F.lit(1e9))
    expected = F.least(F.col("wanted") * F.col("w") / F.col("weighted"), cap)
    rows = rows.withColumn("expected", expected).withColumn("whole", F.floor(F.col("expected") + 1e-9).cast("long"))
    rows = rows.withColumn("p", F.greatest(F.col("expected") - F.col("whole"), F.lit(0.0)))
    u = (F.xxhash64("doc", F.lit(seed)).bitwiseAND(F.lit(2**52 - 1)).cast("double") + 0.5) / 2.0**52
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    rank = F.when((F.col("p") > 1e-12) & (F.col("whole") + 1 <= cap), odds / (1 + odds))
    rows = rows.withColumn("rank", rank).withColumn("bin", F.least(F.floor(F.col("rank") * bins), F.lit(bins - 1)))
    whole = rows.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("whole")).alias("given"))
    counts = rows.where("rank is not null").groupBy("source", "bin").agg(F.sum("n_tokens").alias("t"))
    upto = F.sum("t").over(Window.partitionBy("source").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))
    edges = counts.withColumn("before", F.coalesce(upto, F.lit(0))).join(whole, "source").join(plan.select("source", "wanted"), "source")
    edges = edges.withColumn("room", F.col("wanted") - F.col("given") - F.col("before")).where("room > 0").select("source", "bin", "t", "room")
    taken = rows.join(edges, ["source", "bin"], "left")
    inside = Window.partitionBy("source", "bin").orderBy("rank", "doc").rowsBetween(Window.unboundedPreceding, -1)
    cutting = taken.where("t > room").withColumn("sofar", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    cutting = cutting.withColumn("extra", (F.col("sofar") + F.col("n_tokens") / 2 <= F.col("room")).cast("long")).drop("sofar")
    plain = taken.where("t is null or t <= room").withColumn("extra", F.col("t").isNotNull().cast("long"))
    out = plain.unionByName(cutting).withColumn("copies", F.col("whole") + F.col("extra")).where("copies > 0")
    return out.select("doc", "source", "n_tokens", "copies", "target_share", "share")


def mix_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: target_share, share (scaled), n_documents, tokens, actual_share, most_copies; absent sources with zeros."""
    asked = targets.where("source is not null").groupBy("source").agg(F.max("target_share").alias("target_share"))
    got = mixed.groupBy("source").agg(F.max("share").alias("share"), F.count("*").alias("n_documents"), F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.max("copies").alias("most_copies"))
    rows = asked.join(got, "source", "left").fillna(0, ["share", "n_documents", "tokens", "most_copies"])
    total = F.sum("tokens").over(Window.partitionBy(F.lit(1)))  # one row per target: a small table
    return rows.select("source", "target_share", F.round("share", 6).alias("share"), "n_documents", "tokens", F.round(F.coalesce(F.try_divide("tokens", total), F.lit(0.0)), 6).alias("actual_share"), "most_copies")
