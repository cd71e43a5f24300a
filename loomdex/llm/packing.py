"""Packing texts into containers of fixed capacity: hierarchical residual packing.

Every partition packs its items by best fit, largest first, and emits the bins that are nearly full. What is left, underfull bins,
goes on as items: rounds merge the partitions in a tree, each task best-fitting the bins of several, until one task holds
all that is left or a round no longer saves bins. A task never holds more than ``task_items`` items; where more than
that stay open, the tree ends in several tasks.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.session import cut

_SCHEMA = "container string, size long, closed boolean, docs array<long>, pieces array<int>, tokens array<long>"
_ARROW = pa.schema([("container", pa.string()), ("size", pa.int64()), ("closed", pa.bool_()), ("docs", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("tokens", pa.list_(pa.int64()))])


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Indices of the items of each bin: largest item first, each into the fullest bin that still takes it."""
    bins: list[list[int]] = []
    room: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        at = bisect_left(room, (sizes[i], -1))
        if at == len(room):
            bins.append([i])
            left, b = capacity - sizes[i], len(bins) - 1
        else:
            left, b = room.pop(at)
            bins[b].append(i)
            left -= sizes[i]
        if left:
            insort(room, (left, b))
    return bins


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)] if rows else [pa.array([], f.type) for f in _ARROW], schema=_ARROW)


def _pack(items: list[tuple], container: str, capacity: int, slack: int) -> list[tuple]:
    """items: (size, docs, pieces, tokens). Rows of bins; a bin is closed once its room is at most ``slack``."""
    out = []
    for members in best_fit([x[0] for x in items], capacity):
        size = sum(items[i][0] for i in members)
        docs, pieces, tokens = ([v for i in members for v in items[i][c]] for c in (1, 2, 3))
        out.append((container, size, capacity - size <= slack, docs, pieces, tokens))
    return out


def pack(items: DataFrame, capacities: dict[str, int], *, key: str = "k", size: str = "n_tokens", slack: float = 0.004, fan_in: int = 8, task_items: int = 200_000) -> DataFrame:
    """(container, bin, doc, piece, first_token, tokens): where every item goes, for each container of ``capacities``.

    An item no longer than the capacity is never split; a longer one fills whole bins and leaves one piece that is packed like an
    item. Each token of each item is in exactly one bin per container and no bin exceeds its capacity. ``bin`` is the
    smallest (doc, piece) in it. Items without tokens need no room: their bin is null. Null sizes count as 0; null keys are left out; rows repeated
    under one key are separate items of one name and must be told apart by the caller; an empty table or no capacity gives an empty result.
    """
    rows = items.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            for container, capacity in capacities.items():
                whole, open_items = [], []
                for k, n in held:
                    full, rest = divmod(n, capacity)
                    whole += [(container, capacity, True, [k], [p], [capacity]) for p in range(full)]
                    if rest:
                        open_items.append((rest, [k], [full], [rest]))
                yield _batch(whole + _pack(open_items, container, capacity, int(capacity * slack)))

        for batch in batches:
            held += [(k, n) for k, n in zip(batch.column("k").to_pylist(), batch.column("n").to_pylist()) if n > 0]
            if len(held) >= task_items:
                yield from flush()
                held = []
        yield from flush()

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple]] = {}

        def flush(c: str) -> pa.RecordBatch:
            return _batch(_pack(held.pop(c), c, capacities[c], int(capacities[c] * slack)))

        for batch in batches:
            for c, n, docs, pieces, tokens in zip(*(batch.column(x).to_pylist() for x in ("container", "size", "docs", "pieces", "tokens"))):
                held.setdefault(c, []).append((n, docs, pieces, tokens))
                if len(held[c]) >= task_items:
                    yield flush(c)
        for c in list(held):
            yield flush(c)

    state = cut(rows.mapInArrow(first, _SCHEMA))
    done = [state.where("closed")]
    rest = state.where("not closed")
    tasks, left = max(1, state.rdd.getNumPartitions()), rest.count()
    while left and tasks > 1:
        tasks = max(1, -(-tasks // fan_in), -(-left // task_items))
        where = F.pmod(F.xxhash64("container", F.get("docs", F.lit(0)), F.get("pieces", F.lit(0))), F.lit(tasks))
        state = cut(rest.repartition(tasks, where).sortWithinPartitions("container", "size", F.get("docs", F.lit(0)), F.get("pieces", F.lit(0))).mapInArrow(again, _SCHEMA))
        done.append(state.where("closed"))
        rest = state.where("not closed")
        now = rest.count()
        if now > 0.98 * left and tasks > 1 and tasks == -(-left // task_items):
            break
        left = now
    bins = rest
    for d in done:
        bins = bins.unionByName(d)
    members = F.arrays_zip("docs", "pieces", "tokens")
    least = F.array_min(F.transform(members, lambda m: F.struct(m["docs"].alias("d"), m["pieces"].alias("p"))))
    flat = bins.withColumn("bin", F.concat_ws(":", least["d"], least["p"])).select("container", "bin", F.explode(members).alias("m"))
    caps = F.create_map(*[F.lit(v) for kv in capacities.items() for v in kv]) if capacities else F.create_map(F.lit(""), F.lit(1))
    out = flat.select("container", "bin", F.col("m.docs").alias("doc"), F.col("m.pieces").alias("piece"), (F.col("m.pieces") * F.try_element_at(caps, F.col("container"))).cast("long").alias("first_token"), F.col("m.tokens").alias("tokens"))
    none = rows.where("n <= 0").select(F.explode(F.array(*[F.lit(c) for c in capacities]).cast("array<string>")).alias("container"), F.lit(None).cast("string").alias("bin"), F.col("k").alias("doc"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("first_token"), F.lit(0).cast("long").alias("tokens"))
    return out.unionByName(none)


def packing_report(packed: DataFrame, capacities: DataFrame) -> DataFrame:
    """Per container: capacity, n_items, n_bins, least_bins (tokens / capacity, rounded up), fill and n_over (bins above the capacity, always 0)."""
    bins = packed.where("bin is not null").groupBy("container", "bin").agg(F.sum("tokens").alias("t"), F.count_if(F.col("piece") >= 0).alias("n"))
    caps = capacities.groupBy("container").agg(F.min("capacity_tokens").cast("long").alias("capacity"))
    rows = bins.join(caps, "container").groupBy("container", "capacity").agg(F.sum("n").alias("n_items"), F.count("*").alias("n_bins"), F.sum("t").alias("t"), F.count_if(F.col("t") > F.col("capacity")).alias("n_over"))
    return rows.select("container", "capacity", "n_items", "n_bins", F.ceil(F.col("t") / F.col("capacity")).alias("least_bins"), F.round(F.col("t") / (F.col("n_bins") * F.col("capacity")), 6).alias("fill"), "n_over")
