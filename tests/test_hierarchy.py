from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomdex.operators import hierarchy
from loomdex.operators.hierarchy import ancestors, descendants, nested_sets
from loomdex.plans import cleaning

SCHEMA = "doc_id long, id string, parent_id string, k string, size int"


def brute(rows):
    owner = {}
    for k, i, _ in rows:
        if k is not None and i is not None:
            owner[i] = min(owner.get(i, k), k)
    parent = {k: owner.get(p) for k, _, p in rows if k is not None}
    out = {}
    for k in parent:
        path, at = [k], parent[k]
        while at is not None and at not in path:
            path.append(at)
            at = parent[at]
        if at is None:
            out[k] = (path[-1], len(path) - 1, tuple(reversed(path)))
        else:
            out[k] = (min(path[path.index(at):]), -1, None)
    return parent, out


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    sets = nested_sets(df, paths=True).cache()
    got = {r.doc_id: r for r in sets.collect()}
    parent, want = brute(rows)
    assert set(got) == set(want)
    below = {}
    for k, (_, d, path) in want.items():
        r = got[k]
        assert (r.root, r.depth) == want[k][:2] and r.parent_key == parent[k]
        if d >= 0:
            assert tuple(r.path) == path
            for a in path:
                below.setdefault(a, set()).add(k)
    for a, members in below.items():
        r = got[a]
        assert r.size == len(members)
        assert {k for k, x in got.items() if x.pre is not None and r.pre <= x.pre < r.pre + r.size} == members
    got_up = sorted((r.doc_id, r.ancestor) for r in ancestors(sets, df).collect())
    assert got_up == sorted((k, a) for k, (_, d, path) in want.items() if d >= 0 for a in path[:-1])
    got_down = sorted((r.ancestor, r.doc_id) for r in descendants(sets, df).collect())
    assert got_down == sorted((a, k) for k, a in got_up)
    return df, got


def test_forest_with_loops(spark):
    rnd = random.Random(3)
    rows = [(i, f"n{i}", None if i == 0 or rnd.random() < 0.05 else "gone" if rnd.random() < 0.05 else f"n{rnd.randrange(i)}") for i in range(150)]
    rows += [(200, "n200", "n201"), (201, "n201", "n202"), (202, "n202", "n200"), (203, "n203", "n202"), (204, "n204", "n203"), (205, "n205", "n205"), (206, "n206", "n205")]
    df, got = check(spark, rows)
    top = df.where("doc_id = 0").select("doc_id")
    below = {r.doc_id for r in descendants(nested_sets(df), top).collect()}
    assert below == {k for k, r in got.items() if r.path and 0 in r.path and k != 0}


def test_chain_and_star(spark):
    rows = [(i, f"c{i}", f"c{i - 1}" if i else None) for i in range(60)] + [(1000 + i, f"s{i}", "c3") for i in range(200)]
    check(spark, rows)


def test_long_loop(spark):
    check(spark, [(i, f"l{i}", f"l{(i + 1) % 13}") for i in range(13)] + [(50, "t", "l4")])


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", "a")], [(5, "a", None), (4, "a", None), (7, "b", "a"), (7, "b", "a"), (None, "c", "a")]])
def test_edges(spark, rows):
    check(spark, rows)


@pytest.mark.parametrize("blocks", [1, 3, 7, 1000])
def test_places_from_ranges(spark, blocks):
    """Root and depth from keys, sizes and preorder numbers alone: long chains that end together, stars, single roots and blocks that begin inside a tree."""
    parents = [None, *range(20), *[7] * 15, None, None, *range(37, 60), 37, 40, None]
    below = {}
    for k, p in enumerate(parents):
        below.setdefault(p, []).append(k)
    rows, want = [], {}

    def visit(k, root, depth):
        at = len(rows)
        rows.append(None)
        want[k] = (root, depth)
        for c in below.get(k, []):
            visit(c, root, depth + 1)
        rows[at] = (k, parents[k], len(rows) - at, at)

    for k in below[None]:
        visit(k, k, 0)
    sets = spark.createDataFrame(rows, "k long, p long, size long, pre long")
    got = hierarchy._places(sets, len(rows), blocks)
    assert got.columns == [*sets.columns, "root", "depth"]
    assert {r.k: (r.root, r.depth) for r in got.collect()} == want and len(rows) == len(parents)


def test_p2_found_takes_ranges(spark, tmp_path, monkeypatch):
    """p2_found allots sibling ranges and reads root and depth from them: with ranges that hold nothing, every node is a root."""
    rows = [(1, "a", None), (2, "b", "a"), (3, "c", "b"), (4, "d", "gone"), (5, "e", "d"), (7, "g", "h"), (8, "h", "g"), (9, "i", "h")]
    spark.createDataFrame(rows, "doc_id long, id string, parent_id string").write.parquet(f"{tmp_path}/documents.parquet")
    found = lambda: sorted(tuple(r) for r in cleaning.p2_found(spark, str(tmp_path)).select("doc_id", "root_doc_id", "depth").collect())
    loops, used = [(7, 7, -1), (8, 7, -1), (9, 7, -1)], []
    plain = hierarchy._sibling_offsets
    monkeypatch.setattr(hierarchy, "_sibling_offsets", lambda *a: used.append(1) or plain(*a))
    assert found() == [(2, 1, 1), (3, 1, 2), (4, 4, 0), (5, 4, 1), *loops] and used
    monkeypatch.setattr(hierarchy, "_sibling_offsets", lambda *a: plain(*a).withColumn("size", F.lit(1).cast("long")))
    assert [r[2] for r in found()] == [0, 0, 0, 0, -1, -1, -1]
