"""Near-duplicates: exact set-similarity join on word shingles.

1. Texts are cut into blocks; each block sends its distinct shingle hashes with their counts to hash ranges, which sum
   the document frequency of every shingle. A shingle frequent in a block travels once, without its documents.
2. Frequencies come back to the blocks. A document's *prefix* under the order (frequency, hash) must share a shingle with
   the prefix of every document at or above the threshold; shingles of frequency 1 lead the order and match nothing, so
   only the few rare shared ones remain.
3. Documents meeting in a prefix shingle form size-banded tiles: sorted by size, compared only while sizes, and the places of the shingle
   in both prefixes, allow the threshold. The documents of a frequent shingle are dealt to parts, and each pair of parts is a tile elsewhere.
   Each carries a hashed bitmap of its set, whose bit counts bound the overlap from above; pairs bounded below the
   threshold are never emitted.
4. The rest is decided by exact intersection of the sorted hash arrays.

Documents with equal shingle sets form a class and take part once, whatever their number. Blocks keep their own copies
out of every message, so neither a boilerplate shingle nor a class holding a third of all rows gathers in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.llm.shingles import Shingler, _mix, class_of
from loomdex.session import cut

_MESSAGE = "bucket int, kind int, block long, m long, u binary, c binary, d binary, e binary"
_COLUMNS = ("bucket", "kind", "block", "m", "u", "c", "d", "e")
_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("block", pa.int64()), ("m", pa.int64()), *[(c, pa.binary()) for c in "ucde"]])
_SHARES, _DOCS, _FREQUENT = 0, 1, 2
#: A block closes at this many shingles or documents; the size of one task's arrays, not a cap on anything.
BLOCK_SHINGLES, BLOCK_DOCS = 2_000_000, 50_000
#: A prefix shingle of more documents than this is split into tiles of about this many.
TILE_DOCS = 4096


def _rank(df: np.ndarray) -> np.ndarray:
    """Document frequencies in 16 bits: exact below 2^15, then logarithmic. Any order that is the same everywhere keeps prefixes complete."""
    return np.where(df < 2**15, df, 2**15 + np.floor(256 * np.log2(np.maximum(df, 2**15) / 2**15))).astype("<u2")


def _df(rank: np.ndarray) -> np.ndarray:
    return np.where(rank < 2**15, rank, 2.0**15 * 2.0 ** ((rank.astype(np.float64) - 2**15) / 256))


def _tile_keys(u: np.ndarray, df: np.ndarray, classes: np.ndarray, tile_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(entry, key): the runs that each prefix entry joins. The low two bits of a key say which side of a tile the entry is on, 0 for runs compared with themselves.

    The documents of a frequent shingle are dealt to parts by class, and each pair of parts is a tile of its own, so no task walks the run of a
    shingle that a third of all texts share.
    """
    parts = np.maximum(1, np.ceil(_df(df) / tile_docs)).astype(np.int64)
    entry = np.repeat(np.arange(len(u)), parts)
    n = parts[entry]
    q = np.arange(len(entry)) - np.repeat(np.cumsum(parts) - parts, parts)
    p = (_mix(classes[entry]) % n.astype(np.uint64)).astype(np.int64)
    lo, hi = np.minimum(p, q).astype(np.uint64), np.maximum(p, q).astype(np.uint64)
    side = np.where(p == q, 0, np.where(p < q, 1, 2)).astype(np.uint64)
    with np.errstate(over="ignore"):
        split = _mix(u[entry] + _mix(lo * np.uint64(2**32) + hi + np.uint64(1)))
    key = np.where(n > 1, split, u[entry])
    return entry, (key & ~np.uint64(3)) | side


def _planes(x: np.ndarray) -> bytes:
    """Bytes of a sorted array, byte planes together, so that the shuffle's compression finds the equal high bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _unplanes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*rows), _ARROW)] if rows else [pa.array([], t.type) for t in _ARROW], schema=_ARROW)


def _width(n: np.ndarray) -> np.ndarray:
    """Bitmap bits of a set of n: the power of two from 2n up, 64 at least. Sets of one width are one size band."""
    return np.maximum(64, 2 ** np.ceil(np.log2(np.maximum(2 * n, 2))).astype(np.int64))


def _bitmap(s: np.ndarray, width: int) -> np.ndarray:
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<u8")


def _blocks(width: int, min_words: int, buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)

    def flush(block: int, ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        classes = np.array([class_of(s) for s in sets], np.uint64)
        key = np.array(ids, np.int64)
        order = np.lexsort((key, classes))
        first = np.ones(len(order), bool)
        first[1:] = classes[order][1:] != classes[order][:-1]
        head = np.sort(order[first])
        n = np.array([len(sets[i]) for i in head], np.int64)
        maps = [_bitmap(sets[i], w) for i, w in zip(head, _width(n).tolist())]
        home = block % buckets
        rows = [
            (home, _DOCS, block, len(head), key[head].tobytes(), n.astype("<i4").tobytes(), classes[head].tobytes(), np.concatenate(maps).tobytes()),
            (home, _DOCS, block, 0, key.tobytes(), b"", classes.tobytes(), b""),
        ]
        h = np.concatenate([sets[i] for i in head])
        doc = np.repeat(np.arange(len(head), dtype=np.uint16), n)
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        u, c = h[start], np.diff(np.append(start, len(h)))
        often = c >= max(64, len(head) // 16)
        each = np.repeat(often, c)
        rows.append((home, _FREQUENT, block, 0, _planes(u[often]), c[often].astype("<i4").tobytes(), doc[each].tobytes(), b""))
        cuts = np.concatenate(([0], np.searchsorted(u, edges), [len(u)]))
        ends = np.append(start, len(h))
        for b in range(buckets):
            lo, hi = cuts[b], cuts[b + 1]
            if lo < hi:
                kept = slice(ends[lo], ends[hi])
                rows.append((b, _SHARES, block, 0, _planes(u[lo:hi]), c[lo:hi].astype("<u2").tobytes(), doc[kept][~each[kept]].tobytes(), np.packbits(often[lo:hi]).tobytes()))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width, min_words)
        block, ids, sets, held = TaskContext.get().partitionId() << 32, [], [], 0
        for batch in batches:
            for k, title, body in zip(*(batch.column(c).to_pylist() for c in ("k", "title", "body"))):
                s = shingles(title, body)
                if s is None:
                    continue
                ids.append(k)
                sets.append(s)
                held += len(s)
                if held >= BLOCK_SHINGLES or len(ids) >= BLOCK_DOCS:
                    yield flush(block, ids, sets)
                    block, ids, sets, held = block + 1, [], [], 0
        if ids:
            yield flush(block, ids, sets)

    return run


def _frequencies(table: pa.Table) -> pa.Table:
    """One hash range: sums the counts of each shingle and answers each block with those of two documents or more."""
    rows = list(zip(*(table.column(c).to_pylist() for c in _COLUMNS)))
    shares = [r for r in rows if r[1] == _SHARES]
    out = [r for r in rows if r[1] != _SHARES]
    if shares:
        us = [_unplanes(r[4]) for r in shares]
        cs = [np.frombuffer(r[5], "<u2").astype(np.int64) for r in shares]
        _, where = np.unique(np.concatenate(us), return_inverse=True)
        total = np.bincount(where, weights=np.concatenate(cs)).astype(np.int64)[where]
        at = 0
        for r, u, c in zip(shares, us, cs):
            df = total[at : at + len(u)]
            at += len(u)
            often = np.unpackbits(np.frombuffer(r[7], np.uint8), count=len(u)).astype(bool)
            keep = df >= 2
            each = np.repeat(keep, np.where(often, 0, c))
            doc = np.frombuffer(r[6], np.uint16)[each]
            out.append((r[0], _SHARES, r[2], 0, _planes(u[keep]), np.where(often, 0, c)[keep].astype("<u2").tobytes(), doc.tobytes(), _rank(df[keep]).tobytes()))
    return pa.Table.from_batches([_rows(out)])


def _prefixes(threshold: float, buckets: int, tile_docs: int) -> Callable[[pa.Table], pa.Table]:
    edges = (np.arange(1, buckets, dtype=np.float64) / buckets * 2.0**64).astype(np.uint64)

    def run(table: pa.Table) -> pa.Table:
        """One block: the prefixes of its documents, in packages by hash range with the documents they belong to."""
        rows = list(zip(*(table.column(c).to_pylist() for c in _COLUMNS)))
        everyone = next(r for r in rows if r[1] == _DOCS and not r[3])
        heads = next(r for r in rows if r[1] == _DOCS and r[3])
        frequent = next(r for r in rows if r[1] == _FREQUENT)
        key, n = np.frombuffer(heads[4], np.int64), np.frombuffer(heads[5], "<i4").astype(np.int64)
        classes, maps = np.frombuffer(heads[6], np.uint64), np.frombuffer(heads[7], "<u8")
        at = np.concatenate(([0], np.cumsum(_width(n) // 64)))
        us, ds, dfs = [], [], []
        known_u, known_df = [], []
        for r in rows:
            if r[1] == _SHARES:
                u, c, df = _unplanes(r[4]), np.frombuffer(r[5], "<u2"), np.frombuffer(r[7], "<u2")
                us.append(np.repeat(u, c))
                dfs.append(np.repeat(df, c))
                ds.append(np.frombuffer(r[6], np.uint16))
                known_u.append(u[c == 0])
                known_df.append(df[c == 0])
        hot_u = _unplanes(frequent[4]) if frequent[4] else np.empty(0, np.uint64)
        if len(hot_u) and known_u:
            ku, kd = np.concatenate(known_u), np.concatenate(known_df)
            order = np.argsort(ku)
            df = kd[order][np.searchsorted(ku[order], hot_u)]
            c = np.frombuffer(frequent[5], "<i4")
            us.append(np.repeat(hot_u, c))
            dfs.append(np.repeat(df, c))
            ds.append(np.frombuffer(frequent[6], np.uint16))
        out = [(-1, _DOCS, everyone[2], 0, everyone[4], b"", everyone[6], b"")]
        if us and sum(map(len, us)):
            u, d, df = np.concatenate(us), np.concatenate(ds).astype(np.int64), np.concatenate(dfs)
            order = np.lexsort((u, df, d))
            u, d, df = u[order], d[order], df[order]
            shared = np.bincount(d, minlength=len(n))
            begin = np.concatenate(([0], np.cumsum(shared)))[:-1]
            length = n - np.ceil(threshold * n - 1e-9).astype(np.int64) + 1
            # Places count the shingles that nobody shares, which lead the order. Beyond 16 bits a place is understated, which loses nothing.
            place = np.arange(len(u)) - begin[d] + (n - shared)[d]
            use = place < length[d]
            u, d, df, place = u[use], d[use], df[use], np.minimum(place[use], 2**16 - 1)
            entry, u = _tile_keys(u, df, classes[d], tile_docs)
            d, place = d[entry], place[entry]
            order = np.argsort(u, kind="stable")
            u, d, place = u[order], d[order], place[order]
            cuts = np.concatenate(([0], np.searchsorted(u, edges), [len(u)]))
            for b in range(buckets):
                lo, hi = cuts[b], cuts[b + 1]
                if lo < hi:
                    docs, ref = np.unique(d[lo:hi], return_inverse=True)
                    bits = np.concatenate([maps[at[i] : at[i + 1]] for i in docs])
                    who = np.concatenate([key[docs].view("<u8"), n[docs].view("<u8"), classes[docs]])
                    out.append((b, _SHARES, everyone[2], len(docs), _planes(u[lo:hi]), np.concatenate([ref, place[lo:hi]]).astype("<u2").tobytes(), who.tobytes(), bits.tobytes()))
        return pa.Table.from_batches([_rows(out)])

    return run


def _bounded(a: np.ndarray, b: np.ndarray, n: np.ndarray, bits: dict[int, np.ndarray], slot: np.ndarray, band: np.ndarray, threshold: float) -> np.ndarray:
    """Mask of the pairs whose overlap bound from the bitmaps reaches the threshold."""
    keep = np.zeros(len(a), bool)
    need = threshold / (1 + threshold) * (n[a] + n[b]) - 1e-9
    for lo in np.unique(band):
        for hi in np.unique(band):
            for x, y in ((a, b), (b, a)) if lo < hi else ((a, b),) if lo == hi else ():
                of = np.flatnonzero((band[x] == lo) & (band[y] == hi))
                if not len(of):
                    continue
                for part in np.array_split(of, max(1, len(of) * int(lo) // 2**26)):
                    p, q = bits[lo][slot[x[part]]], bits[hi][slot[y[part]]]
                    q = np.bitwise_or.reduce(q.reshape(len(part), int(hi // lo), -1), axis=1)
                    bound = np.minimum(n[x[part]] - np.bitwise_count(p & ~q).sum(1, dtype=np.int64), n[y[part]] - np.bitwise_count(q & ~p).sum(1, dtype=np.int64))
                    keep[part] = bound >= need[part]
    return keep


def _tiles(threshold: float) -> Callable[[pa.Table], pa.Table]:
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        """One hash range: pairs that share a prefix shingle, whose sizes fit and whose bitmap bound allows the threshold."""
        us, refs, places, whos, words, base = [], [], [], [], [], 0
        for m, u, c, d, e in zip(*(table.column(x).to_pylist() for x in ("m", "u", "c", "d", "e"))):
            us.append(_unplanes(u))
            ref, place = np.frombuffer(c, "<u2").astype(np.int64).reshape(2, -1)
            refs.append(ref + base)
            places.append(place)
            whos.append(np.frombuffer(d, "<u8").reshape(3, m))
            words.append(np.frombuffer(e, "<u8"))
            base += m
        u, ref, place, who = np.concatenate(us), np.concatenate(refs), np.concatenate(places), np.concatenate(whos, axis=1)
        key, n, classes, stream = who[0].view(np.int64), who[1].astype(np.int64), who[2], np.concatenate(words)
        # Copies: every message of a class names the same shingles, so its smallest key is the same everywhere.
        order = np.lexsort((key, classes))
        first = np.concatenate(([True], classes[order][1:] != classes[order][:-1]))
        head = np.empty(len(key), np.int64)
        head[order] = order[first][np.cumsum(first) - 1]
        ref = head[ref]
        band = _width(n)
        at = np.concatenate(([0], np.cumsum(band // 64)))
        slot, bits = np.zeros(len(n), np.int64), {}
        for w in np.unique(band):
            of = np.flatnonzero(band == w)
            slot[of] = np.arange(len(of))
            bits[w] = stream[at[of][:, None] + np.arange(w // 64)]
        run_of, side = u >> np.uint64(2), u & np.uint64(3)
        order = np.lexsort((ref, n[ref], run_of))
        u, side, ref, place = run_of[order], side[order], ref[order], place[order]
        once = np.concatenate(([True], (u[1:] != u[:-1]) | (ref[1:] != ref[:-1])))
        u, side, ref, place = u[once], side[once], ref[once], place[once]
        size, found, held = n[ref], [], 0
        # Texts whose first common shingle stands here share at most what follows it, so the partner's size is bounded.
        most = (size - place) * (1 + threshold) / threshold - size + 1e-9
        some = lambda p: np.unique(np.concatenate(p)) if p else np.empty(0, np.int64)
        active, step = np.arange(len(u)), 1
        while len(active):
            active = active[active + step < len(u)]
            other = active + step
            # Sizes grow along a run: what is too large once stays too large.
            fits = (u[other] == u[active]) & (size[other] <= np.minimum(most[active], size[active] / threshold + 1e-9))
            active, other = active[fits], other[fits]
            apart = (size[active] <= most[other]) & ((side[active] != side[other]) | (side[active] == 0))
            walking, active, other = active, active[apart], other[apart]
            a, b = np.minimum(ref[active], ref[other]), np.maximum(ref[active], ref[other])
            if len(a):
                keep = _bounded(a, b, n, bits, slot, band, threshold)
                found.append(a[keep] * len(n) + b[keep])
                held += int(keep.sum())
                if held > 4_000_000:
                    found = [some(found)]
                    held = 0
            active, step = walking, step + 1
        pair = some(found)
        a, b = key[pair // len(n)], key[pair % len(n)]
        return pa.table([np.minimum(a, b), np.maximum(a, b)], schema=schema)

    return run


def _unpack_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for u, d in zip(batch.column("u").to_pylist(), batch.column("d").to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(u, np.int64)), pa.array(np.frombuffer(d, np.int64))], names=["k", "class"])


def _arrays(width: int, min_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(width, min_words)
        for batch in batches:
            sets = [shingles(t, b) for t, b in zip(batch.column("title").to_pylist(), batch.column("body").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("k"), pa.array([None if s is None else s.tobytes() for s in sets], pa.binary())], names=["k", "s"])

    return run


def _intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        value = []
        for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(p) > len(q):
                p, q = q, p
            at = np.searchsorted(q, p)
            both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
            value.append(both / (len(p) + len(q) - both))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(value, pa.float64())], names=["a", "b", "similarity"])


def similar_classes(
    df: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body", *, width: int = 5, threshold: float = 0.8, min_words: int = 30,
    broadcast_keys: int = 500_000, tile_docs: int = TILE_DOCS,
) -> tuple[DataFrame, DataFrame]:
    """(pairs, members). pairs: (a, b, similarity) of class representatives, a < b, similarity = shared / all distinct
    shingles >= ``threshold``. members: (k, rep) for every text of at least ``min_words`` words; texts with equal shingle sets
    have one rep, their smallest key.

    Complete and exact: no pair of texts at or above the threshold is lost, none below is kept. Null title or body counts as
    empty; shorter texts are in no pair and in no class; a row repeated under one key counts once; rows with a null key are
    left out; an empty table gives empty results. Texts of any length are used whole.
    """
    texts = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(title).alias("title"), F.col(body).alias("body"))
    chars = texts.agg(F.sum(F.length(F.coalesce("title", F.lit(""))) + F.length(F.coalesce("body", F.lit(""))))).first()[0] or 0
    spark = df.sparkSession
    # Hash ranges in proportion to the text: about 3 MB of text, or half a million shingles, each.
    buckets = 2 ** max(3, math.ceil(math.log2(chars / 3e6 + 1)))
    # As many tasks as the text asks for, whatever the session's number of shuffle partitions, so that none grows with the collection.
    tasks = max(spark.sparkContext.defaultParallelism, buckets // 4)
    asked = texts.mapInArrow(_blocks(width, min_words, buckets), _MESSAGE).repartition(tasks, "bucket")
    answered = asked.groupBy("bucket").applyInArrow(_frequencies, _MESSAGE).repartition(tasks, "block")
    packed = cut(answered.groupBy("block").applyInArrow(_prefixes(threshold, max(1, buckets // 16), tile_docs), _MESSAGE))
    met = packed.where(f"kind = {_SHARES}").repartition(max(spark.sparkContext.defaultParallelism, buckets // 16), "bucket").groupBy("bucket").applyInArrow(_tiles(threshold), "a long, b long")
    met = cut(met.distinct())
    needed = met.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    # The few texts in surviving pairs are read again; their keys are broadcast only while they are few.
    needed = F.broadcast(needed) if 2 * met.count() <= broadcast_keys else needed
    arrays = texts.join(needed, "k", "left_semi").mapInArrow(_arrays(width, min_words), "k long, s binary").where("s is not null").dropDuplicates(["k"])
    side = lambda c: arrays.select(F.col("k").alias(c), F.col("s").alias(f"s{c}"))
    decided = met.join(side("a"), "a").join(side("b"), "b").mapInArrow(_intersect, "a long, b long, similarity double")
    pairs = decided.where(F.col("similarity") >= threshold)
    docs = packed.where(f"kind = {_DOCS}").mapInArrow(_unpack_docs, "k long, class long")
    reps = docs.groupBy("class").agg(F.min("k").alias("rep"))
    members = docs.join(reps, "class").select("k", "rep").distinct()
    return pairs, members


def similar_pairs(df: DataFrame, key: str = "doc_id", title: str = "title", body: str = "body", *, full_class: int | None = 256, **options) -> DataFrame:
    """(a, b, similarity): pairs of texts, a < b. Classes of up to ``full_class`` copies are listed with all their pairs; a larger class as pairs of its first
    text with each other one, and its links to other texts by that first text alone, so that a class of a third of all rows gives no quadratic
    output. None lists every pair of every class."""
    pairs, members = similar_classes(df, key, title, body, **options)
    grown = members.groupBy("rep").agg(F.count("*").alias("copies")).where("copies > 1")
    of = cut(members.join(grown, "rep"))
    is_small = F.lit(True) if full_class is None else F.col("copies") <= full_class
    small, large = of.where(is_small), of.where(~is_small)
    one = F.lit(1.0).alias("similarity")
    within = small.alias("x").join(small.alias("y"), "rep").where("x.k < y.k").select(F.col("x.k").alias("a"), F.col("y.k").alias("b"), one)
    star = large.where("k > rep").select(F.col("rep").alias("a"), F.col("k").alias("b"), one)
    full = pairs
    for c in ("a", "b"):
        full = full.join(small.select(F.col("rep").alias(c), F.col("k").alias(f"k{c}")), c, "left").withColumn(c, F.coalesce(f"k{c}", c)).drop(f"k{c}")
    across = full.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "similarity")
    return across.unionByName(within).unionByName(star)


def linked_classes(df: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """One row per text of enough words: key, ``class_id`` (smallest key with an equal shingle set), ``n_copies`` of the class and
    ``n_links``, the number of other classes at or above the threshold."""
    pairs, members = similar_classes(df, key, **options)
    links = pairs.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    copies = members.groupBy("rep").agg(F.count("*").alias("n_copies"))
    out = members.join(copies, "rep").join(links, "rep", "left")
    return out.select(F.col("k").alias(key), F.col("rep").alias("class_id"), "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
