from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loomdex.llm.mixing import mix, mix_report
from loomdex.llm.packing import best_fit, pack, packing_report
from loomdex.llm.tokens import token_counts


def test_tokens(spark):
    import tiktoken  # noqa: F401

    rows = [(1, "hello world"), (2, None), (3, ""), (4, "x " * 100_000), (5, "<|endoftext|> été"), (1, "hello world")]
    got = sorted((r.k, r.n_tokens) for r in token_counts(spark.createDataFrame(rows, "k long, text string"), "k", "text").collect())
    assert got[0] == got[1] == (1, 2) and (2, 0) in got and (3, 0) in got and dict(got)[4] >= 100_000 and dict(got)[5] > 3


def check(spark, sizes, capacities, parts=6, **options):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "k long, n_tokens long, bin string").repartition(parts)
    rows = pack(df, capacities, **options).collect()
    for c, cap in capacities.items():
        pieces, bins = {}, {}
        for r in rows:
            if r.container == c:
                pieces.setdefault(r.doc, []).append((r.first_token, r.tokens))
                if r.bin is not None:
                    bins.setdefault(r.bin, []).append((r.doc, r.piece, r.tokens))
        assert set(pieces) == set(range(len(sizes)))
        for k, ps in pieces.items():
            n = sizes[k] or 0
            at = 0
            for first, t in sorted(ps):
                assert first == at
                at += t
            assert at == n and (n > cap or len(ps) == 1)
        assert all(sum(t for _, _, t in m) <= cap for m in bins.values())
        yield c, bins


def test_whole_and_tight(spark):
    rnd = random.Random(4)
    sizes = [rnd.choice([0, 1, 5, 40, 90, 130, 260, 700]) + rnd.randrange(30) for _ in range(900)] + [0, None, 10_000, 512, 1024]
    for c, bins in check(spark, sizes, {"small": 512, "large": 2048}):
        cap = {"small": 512, "large": 2048}[c]
        least = -(-sum(n or 0 for n in sizes) // cap)
        assert len(bins) <= least * 1.02 + 1
    report = packing_report(pack(spark.createDataFrame([(1, 600)], "k long, n_tokens long"), {"small": 512}), spark.createDataFrame([("small", 512)], "container string, capacity_tokens int")).first()
    assert (report.n_bins, report.least_bins, report.n_over) == (2, 2, 0)


def test_tree_stops(spark):
    """Items that cannot share a bin end the tree, whatever the task bound."""
    for _, bins in check(spark, [400] * 120, {"c": 512}, task_items=20):
        assert len(bins) == 120
    list(check(spark, [], {"c": 512}))
    assert pack(spark.createDataFrame([(1, 5), (None, 5)], "k long, n_tokens long"), {}).count() == 0


def test_best_fit_brute_force():
    rnd = random.Random(6)
    for _ in range(50):
        sizes = [rnd.randrange(1, 60) for _ in range(25)]
        bins, room = best_fit(sizes, 60), []
        for i in sorted(range(25), key=lambda i: (-sizes[i], i)):
            fits = [b for b in range(len(room)) if room[b] >= sizes[i]]
            b = min(fits, key=lambda b: room[b]) if fits else len(room)
            if not fits:
                room.append(60)
            room[b] -= sizes[i]
        assert len(bins) == len(room) and sorted(i for m in bins for i in m) == list(range(25))


def sources(spark, counts, seed=3):
    rnd = random.Random(seed)
    rows = [(k, s, rnd.randrange(1, 200), "x") for s, n in counts.items() for k in [hash((s, i)) for i in range(n)]]
    return spark.createDataFrame(rows + [(1, None, 5, "x"), (None, "a", 5, "x"), (2, "zero", 0, "x"), (3, "other", 7, "x")], "k long, source string, n_tokens long, share string")


def test_shares_and_caps(spark):
    docs = sources(spark, {"a": 900, "b": 60, "c": 300}).cache()
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.4, None), ("gone", 0.2, 1), (None, 1.0, 1), ("zero", 0.1, 2)], "source string, target_share double, max_repeats int")
    mixed = mix(docs, targets)
    report = {r.source: r for r in mix_report(mixed, targets).collect()}
    for s, want in (("a", 0.5 / 1.2), ("b", 0.3 / 1.2), ("c", 0.4 / 1.2)):
        assert abs(report[s].actual_share - want) < 0.01
    assert report["b"].most_copies == 3 and report["a"].most_copies == 1 and report["gone"].tokens == 0
    assert sorted(map(tuple, mixed.collect())) == sorted(map(tuple, mix(docs.repartition(7), targets).collect()))
    more = {r.source: r for r in mix_report(mix(docs, targets, total_tokens=10**6), targets).collect()}
    assert more["b"].most_copies == 3 and more["a"].most_copies == 1 and more["c"].most_copies > 3


def test_pareto_inclusion(spark):
    """Unequal probabilities: over many draws documents come with the expected frequency."""
    docs = spark.createDataFrame([(k, "a", 10, 1.0 if k < 30 else 3.0) for k in range(60)], "k long, source string, n_tokens long, w double")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    light = heavy = 0
    for seed in range(12):
        rows = mix(docs, targets, weight="w", total_tokens=300, seed=seed).collect()
        assert abs(sum(r.n_tokens * r.copies for r in rows) - 300) <= 10
        light += sum(r.doc < 30 for r in rows)
        heavy += sum(r.doc >= 30 for r in rows)
    assert 2.0 < heavy / light < 4.5


@pytest.mark.parametrize("rows", [[], [("a", None, 1)], [("a", -1.0, 1)]])
def test_no_targets(spark, rows):
    targets = spark.createDataFrame(rows, "source string, target_share double, max_repeats int")
    assert mix(sources(spark, {"a": 5}), targets).count() == 0
    assert mix(sources(spark, {"a": 5}).where(F.lit(False)), targets).count() == 0
