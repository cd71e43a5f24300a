from __future__ import annotations

from datetime import datetime

from loomdex.operators.orphans import orphan_references, orphan_report

SHA = "ab12cd34ef" * 4


def tables(spark, refs=(), docs=()):
    base = [(1, "github_issue:o/r:5", None, "github_issue", "5"), (2, f"commit:o/r:{SHA}", None, "commit", SHA), (3, "x", None, "irc_log", "3"), (4, "late", None, "irc_log", "4")]
    d = spark.createDataFrame([*base, *docs], "doc_id long, id string, parent_id string, source_type string, source_id string")
    r = spark.createDataFrame(list(refs), "id long, from_doc_id string, to_doc_id string, to_external string")
    s = spark.createDataFrame([("bip", "0028"), ("nut", "00"), ("lud", None)], "source_type string, source_id string")
    log = [("github_issue:o/r:5", 1), (f"commit:o/r:{SHA}", 1), ("x", 5), ("late", 9), ("removed", 2)]
    c = spark.createDataFrame([(i, "insert", datetime(2020, n, 1)) for i, n in log] + [("late", "update", datetime(2020, 1, 1)), ("removed", "delete", datetime(2020, 3, 1)), (None, "insert", None)], "doc_id string, change_type string, changed_at timestamp")
    y = spark.createDataFrame([("o/r",), (None,)], "source_repo string")
    return orphan_references(d, r, s, c, y)


def test_states(spark):
    cases = {
        ("x", None): "ok", ("late", None): "late", ("removed", None): "deleted", ("nothing", None): "missing",
        (None, "o/r#5"): "ok", (None, "o/r#6"): "missing", (None, "p/q#6"): "untracked", (None, "BIP-28"): "ok", (None, "bip-028"): "ok", (None, "BIP-29"): "missing", (None, "NUT-0"): "ok",
        (None, SHA[:8]): "ok", (None, SHA): "ok", (None, "0123456789"): "missing", (None, "words here"): "unknown",
    }
    refs = [(i, "x", a, b) for i, (a, b) in enumerate(cases)] + [(99, "x", None, "BIP-29"), (100, None, "nothing", None)]
    out = {r.src_key: r for r in tables(spark, refs, [(9, "kid", "removed", "irc_log", "9"), (10, "kid2", "", "irc_log", "10"), (11, None, "x", None, None)]).where("src_table = 'refs'").collect()}
    for i, (k, want) in enumerate(cases.items()):
        assert out[i].state == want, k
    assert out[99].state == "missing" and out[99].period == "2020-05" and out[100].period is None


def test_report_and_empty(spark):
    got = tables(spark, [(1, "x", None, "BIP-29"), (1, "x", None, "BIP-29"), (2, "x", "late", None), (3, "x", "x", None), (4, "x", None, "p/q#1")])
    rows = {(r.src_field, r.period): r for r in orphan_report(got).collect()}
    assert rows[("to_external", "2020-05")].n_missing == 2 and rows[("to_doc_id", "2020-05")].n_late == 1 and rows[("to_doc_id", "2020-05")].n_refs == 2
    assert tables(spark).count() == 0
