"""Parent-child rows to nested-set hierarchies.

Subtree sizes are computed upward, sibling preorder ranges are allocated by prefix sums downward, and the resulting
ranges ``[pre, pre + size)`` answer ancestor and descendant questions with plain comparisons. Both directions use
doubling: in round k every node knows its ancestor 2^k steps up, so a forest of depth d takes log2(d) + 1 rounds, not d.

* upward: ``S_0 = 1``; ``S_{k+1}(u) = S_k(u) + sum of S_k(v) over v whose ancestor 2^k up is u``;
* downward: ``pre(u)`` is the sum over the path from the root of 1 + the sizes of the earlier siblings; path sums double
  the same way, each node's sum reaching as far up as its pointer;
* root and depth come from the ranges, by running values over the preorder numbers (``_places``);
* a round in which no node reaches a root ends the pass: the nodes left over lie on a loop or below one.

A parent with very many children is no hot spot: sums are combined map-side and sibling prefix sums are taken in two
levels over key ranges, so no task holds all children of one node.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.session import cut


def _resolve(df: DataFrame, key: str, node: str, parent: str) -> DataFrame:
    """(k, p): key of each row and of its parent, null without one. Of rows that share a node id the smallest key is the parent."""
    owner = df.where(F.col(node).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(node).alias("_id")).agg(F.min(key).alias("p"))
    rows = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(parent).alias("_id"))
    # Rows without a parent stay out of the join: all their nulls would go to one task.
    return rows.where("_id is not null").join(owner, "_id", "left").select("k", "p").unionByName(rows.where("_id is null").select("k", F.lit(None).cast("bigint").alias("p")))


def _sibling_offsets(rows: DataFrame, ranges: int) -> DataFrame:
    """(k, p, size) with off: 1 + sizes of the earlier siblings by key; roots are siblings of one another with the first at 0."""
    bounds = sorted(set(rows.approxQuantile("k", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges)))) if ranges > 1 else []
    bucket = F.lit(0)
    if bounds:
        edges = F.array(*[F.lit(int(b)) for b in bounds])
        bucket = F.size(F.filter(edges, lambda e: e <= F.col("k")))
    rows = rows.withColumn("b", bucket)
    whole = rows.groupBy("p", "b").agg(F.sum("size").alias("t"))
    before = whole.withColumn("s", F.coalesce(F.sum("t").over(Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("p", "b").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("i", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    own = before.select(F.col("p").alias("_p"), F.col("b").alias("_b"), "s")
    rows = rows.join(own, F.col("p").eqNullSafe(F.col("_p")) & (F.col("b") == F.col("_b")))
    return rows.select("k", "p", "size", (F.col("s") + F.col("i") + F.when(F.col("p").isNull(), 0).otherwise(1)).alias("off"))


def _places(sets: DataFrame, n: int, blocks: int) -> DataFrame:
    """``sets`` (k, p, size, pre and others; ``n`` rows) with root and depth as the ranges have them. Preorder numbers run from 0 without gaps, so ``pre`` ranges begin before
    a node, and all of them that have not ended by ``pre`` hold it: depth is ``pre`` less these ends. Root is the last parentless node up to ``pre``. Both are running values inside
    blocks of preorder numbers, to which the blocks before are added; ends are counted by number first, so those of a long chain are one row."""
    ends = sets.groupBy((F.col("pre") + F.col("size")).alias("x")).agg(F.count("*").alias("e")).where(F.col("x") < n)
    rows = sets.withColumns({"x": F.col("pre"), "r": F.when(F.col("p").isNull(), F.col("k"))}).unionByName(ends, allowMissingColumns=True).withColumn("b", F.floor(F.col("x") / max(1, -(-n // blocks))))
    earlier = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    whole = rows.groupBy("b").agg(F.sum("e").alias("t"), F.max_by("r", F.when(F.col("r").isNotNull(), F.col("x"))).alias("h"))
    before = whole.select(F.col("b"), F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t"), F.last("h", ignorenulls=True).over(earlier).alias("h"))
    inside = Window.partitionBy("b").orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"t2": F.coalesce(F.sum("e").over(inside), F.lit(0)), "h2": F.last("r", ignorenulls=True).over(inside)}).where("k is not null").join(before, "b")
    return rows.select(*sets.columns, F.coalesce("h2", "h").alias("root"), (F.col("x") - F.col("t") - F.col("t2")).alias("depth"))


def _loops(left: DataFrame) -> DataFrame:
    """(k, root): for nodes on or below a loop, the smallest key on that loop. ``left``: (k, p) of just those nodes."""
    state = left.select("k", F.col("p").alias("j"), F.col("k").alias("m"))
    while True:
        ahead = state.select(F.col("k").alias("j"), F.col("j").alias("j2"), F.col("m").alias("m2"))
        new = cut(state.join(ahead, "j").select("k", F.col("j2").alias("j"), F.least("m", "m2").alias("m"), (F.col("m2") < F.col("m")).alias("moved")))
        # 2^k steps on, every node stands on its loop once the set stood upon stops shrinking; minima then stop too.
        old_n = state.select("j").distinct().count()
        new_n, moved = new.agg(F.count_distinct("j"), F.coalesce(F.max("moved"), F.lit(False))).first()
        state = new.drop("moved")
        if old_n == new_n and not moved:
            break
    on = state.select(F.col("k").alias("j"), F.col("m").alias("root"))
    return state.select("k", "j").join(on, "j").select("k", "root")


def nested_sets(df: DataFrame, key: str = "doc_id", node: str = "id", parent: str = "parent_id", *, paths: bool = False) -> DataFrame:
    """One row per distinct key: ``key, parent_key, root, depth, size, pre`` and, with ``paths``, ``path``.

    ``key`` is a bigint; ``node`` and ``parent`` are of one type. ``size`` counts the node and its descendants, which are
    exactly the rows with ``pre`` in ``(pre, pre + size)``; ranges of different trees do not overlap. Of repeated rows
    the smallest parent is taken; a null key or a null node id is nobody's parent; rows with a null key are left out. A node
    whose parent is null or does not exist is a root at depth 0. On a loop or below one (a row that is its own parent
    included), ``root`` is the smallest key on the loop, depth is -1 and size, pre and path are null. An empty table
    gives an empty result. ``path`` is the array of keys from the root to the node.
    """
    tree = cut(_resolve(df, key, node, parent))
    # First pass: pointers 2^k up (saturating at the root) and subtree sizes to the same distance.
    state = tree.select("k", "p", F.coalesce("p", "k").alias("j"), F.when(F.col("p").isNull(), 0).otherwise(1).cast("long").alias("d"),
                        F.col("p").isNull().alias("done"), F.lit(1).cast("long").alias("s"))
    total, active = tree.agg(F.count("*"), F.count("p")).first()
    step, rounds = 1, 0
    while active:
        up = state.where(F.col("d") == step).groupBy(F.col("j").alias("k")).agg(F.sum("s").alias("more"))
        ahead = state.select(F.col("k").alias("j"), F.col("j").alias("j2"), F.col("d").alias("d2"), F.col("done").alias("done2"))
        moved = state.where(~F.col("done")).join(ahead, "j").select("k", "p", F.col("j2").alias("j"), (F.col("d") + F.col("d2")).alias("d"), F.col("done2").alias("done"), "s")
        state = cut(state.where("done").unionByName(moved).join(up, "k", "left").select("k", "p", "j", "d", "done", (F.col("s") + F.coalesce("more", F.lit(0))).alias("s")))
        now = state.where("not done").count()
        step *= 2
        if now == active:
            break
        active, rounds = now, rounds + 1
    # Second pass: preorder numbers as sums of sibling offsets along the path, in as many rounds.
    blocks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    off = _sibling_offsets(state.where("done").select("k", "p", F.col("s").alias("size")), blocks)
    sums = {"pre": F.col("pre") + F.col("pre2")} | ({"path": F.concat("path2", "path")} if paths else {})
    acc = cut(off.select("k", "p", "size", F.col("p").alias("j"), F.col("off").alias("pre"), *([F.array("k").alias("path")] if paths else [])))
    for _ in range(rounds):
        # A node without pointer has its whole path and stays out of the join.
        ahead = acc.select(F.col("k").alias("j"), F.col("j").alias("j2"), *[F.col(c).alias(f"{c}2") for c in sums])
        moved = acc.where("j is not null").join(ahead, "j").select("k", "p", "size", F.col("j2").alias("j"), *[v.alias(c) for c, v in sums.items()])
        acc = cut(acc.where("j is null").unionByName(moved))
    out = _places(acc.drop("j"), total - active, blocks)
    if active:
        lost = cut(state.where("not done").select("k", "p"))
        out = out.unionByName(lost.join(_loops(lost), "k").withColumn("depth", F.lit(-1).cast("long")), allowMissingColumns=True)
    return out.select(F.col("k").alias(key), F.col("p").alias("parent_key"), "root", "depth", "size", "pre", *(["path"] if paths else []))


#: Preorder numbers in one block of the descendants join.
BLOCK = 1024


def descendants(sets: DataFrame, of: DataFrame, key: str = "doc_id") -> DataFrame:
    """(ancestor, key): all descendants of the keys in ``of``, by range. A range is cut into blocks of preorder numbers, so the join is an equi-join
    whose size is that of the answer, also where one tree holds a third of all nodes. Nodes on loops have no descendants here; unknown keys give no rows."""
    heads = of.select(F.col(key).alias("ancestor")).distinct().join(sets.select(F.col(key).alias("ancestor"), F.col("pre").alias("lo"), (F.col("pre") + F.col("size")).alias("hi")), "ancestor").where("hi > lo + 1")
    block = lambda c: F.floor(c / BLOCK)
    heads = heads.select("ancestor", "lo", "hi", F.explode(F.sequence(block(F.col("lo") + 1), block(F.col("hi") - 1))).alias("_b"))
    nodes = sets.where("pre is not null").select(F.col(key), "pre", block(F.col("pre")).alias("_b"))
    return nodes.join(heads, "_b").where((F.col("pre") > F.col("lo")) & (F.col("pre") < F.col("hi"))).select("ancestor", key)


def ancestors(sets: DataFrame, of: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ancestor): all ancestors of the keys in ``of``, by range. Every range of descendants is a few aligned blocks of 2^level numbers, and a node lies in
    one block of each level, so equal blocks are exactly the ancestors. Nodes on loops have none here."""
    top = sets.agg(F.max("size")).first()[0] or 1
    levels = F.sequence(F.lit(0), F.lit(int(top).bit_length()))
    power = lambda k: F.pow(F.lit(2.0), k)
    lo, hi = F.col("pre") + 1, F.col("pre") + F.col("size")

    def pieces(k):
        a, b = F.ceil(lo / power(k)), F.floor(hi / power(k))
        whole = lambda x: F.struct(k.alias("level"), x.cast("bigint").alias("at"))
        return F.array(F.when((a < b) & (a % 2 == 1), whole(a)), F.when((a < b) & (b % 2 == 1), whole(b - 1)))

    ranges = sets.where("size > 1").select(F.col(key).alias("ancestor"), F.explode(F.filter(F.flatten(F.transform(levels, pieces)), lambda x: x.isNotNull())).alias("_p")).select("ancestor", "_p.*")
    nodes = of.select(key).distinct().join(sets.where("pre is not null").select(key, "pre"), key)
    nodes = nodes.select(key, F.explode(F.transform(levels, lambda k: F.struct(k.alias("level"), F.floor(F.col("pre") / power(k)).cast("bigint").alias("at")))).alias("_p")).select(key, "_p.*")
    return nodes.join(ranges, ["level", "at"]).select(key, "ancestor")
