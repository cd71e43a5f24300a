from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm.neardup import linked_classes, similar_classes, similar_pairs
from loomdex.llm.shingles import Shingler


def corpus(seed=1):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([20, 31, 60, 120, 700]))] for _ in range(60)]
    rows = []
    for b in base:
        for _ in range(rnd.choice([1, 1, 2, 3])):
            t = list(b)
            for _ in range(int(len(t) * rnd.choice([0, 0.02, 0.06, 0.12]))):
                k = rnd.randrange(len(t))
                t[k : k + 1] = rnd.choice([[], [rnd.choice(words)], [t[k], rnd.choice(words)]])
            rows.append(" ".join(t))
    rows += ["boiler plate text that many records share word for word and that says nothing at all " * 3] * 40
    rows += [f"boiler plate text that many records share word for word and that says nothing at all number {i} " * 3 for i in range(30)]
    return [(i, "Title" if i % 5 == 0 else None, t) for i, t in enumerate(rows)]


def brute(rows, width, threshold):
    s = Shingler(width, 30)
    sets = {k: set(x.tolist()) for k, t, b in rows if (x := s(t, b)) is not None}
    out = {}
    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            n = len(sets[a] & sets[b])
            if n and n / (len(sets[a]) + len(sets[b]) - n) >= threshold:
                out[(a, b)] = n / (len(sets[a]) + len(sets[b]) - n)
    return sets, out


@pytest.mark.parametrize(("width", "threshold"), [(3, 0.5), (5, 0.8)])
def test_complete(spark, width, threshold):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, title string, body string").withColumn("k", F.lit("x")).repartition(5)
    sets, want = brute(rows, width, threshold)
    got = {(r.a, r.b): r.similarity for r in similar_pairs(df, width=width, threshold=threshold).collect()}
    assert set(got) == set(want) and all(abs(got[p] - want[p]) < 1e-12 for p in want)
    links = {r.doc_id: r for r in linked_classes(df, width=width, threshold=threshold).collect()}
    assert set(links) == set(sets)
    for k, r in links.items():
        same = {m for m in sets if sets[m] == sets[k]}
        assert r.class_id == min(same) and r.n_copies == len(same)
        near = {min(m for m in sets if sets[m] == sets[o]) for p in want if k in p for o in p if sets[o] != sets[k]}
        assert r.n_links == len(near)


def test_many_blocks_and_stars(spark):
    rows = corpus(2)
    df = spark.createDataFrame(rows, "doc_id long, title string, body string").repartition(7)
    sets, want = brute(rows, 3, 0.5)
    full = {(r.a, r.b) for r in similar_pairs(df, width=3, threshold=0.5, full_class=None, tile_docs=3).collect()}
    assert full == set(want)
    got = {(r.a, r.b) for r in similar_pairs(df, width=3, threshold=0.5, full_class=5, broadcast_keys=0).collect()}
    assert got <= set(want)
    linked = {}
    for a, b in sorted(got):
        linked.setdefault(a, a)
        linked.setdefault(b, b)
    find = lambda x: x if linked[x] == x else find(linked[x])
    for a, b in got:
        linked[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in want)  # stars lose no link


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "a", ""), (2, "a", "b")], [(None, "t", "x y z " * 20)], [(1, "t", "same words here " * 20)] * 3])
def test_edges(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, title string, body string")
    pairs, members = similar_classes(df, width=3, threshold=0.5)
    assert pairs.count() == 0 and members.count() == (1 if len(rows) == 3 else 0)
    assert similar_pairs(df, width=3, threshold=0.5).count() == 0


def test_long_text(spark):
    rnd = random.Random(9)
    words = [f"v{rnd.randrange(10**6)}" for _ in range(60_000)]
    rows = [(1, None, " ".join(words)), (2, None, " ".join(words[:40_000])), (3, None, " ".join(words[25_000:]))]
    got = {(r.a, r.b) for r in similar_pairs(spark.createDataFrame(rows, "doc_id long, title string, body string"), width=3, threshold=0.5).collect()}
    assert got == {(1, 2), (1, 3)}


def test_template(spark):
    """Thousands of texts that share a template below the threshold meet in its shingles, and are not compared one by one."""
    rnd = random.Random(4)
    common = [f"c{i}" for i in range(60)]
    rows = [(i, None, " ".join(common + [f"o{rnd.randrange(10**9)}" for _ in range(42)])) for i in range(4000)]
    rows += [(10_000 + i, None, rows[i][2] + " more") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, title string, body string").repartition(4)
    got = {(r.a, r.b) for r in similar_pairs(df, width=3, threshold=0.5, tile_docs=500).collect()}
    assert got == {(i, 10_000 + i) for i in range(5)}
