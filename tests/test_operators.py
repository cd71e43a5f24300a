from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import context as C
from loomdex.operators import metrics as M
from loomdex.operators import mutations as U
from loomdex.operators.enrich import extract_references, tag_concepts
from loomdex.schema import CHANGE_LOG, DOCUMENTS, document_url, make_id, parse_instant


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1)]).select(column.alias("x")).first().x


REFS = [
    ("See #12", {("mentions_issue", "o/r#12")}), ("&#12;", set()), ("Fixes #5", {("fixes", "o/r#5"), ("mentions_issue", "o/r#5")}), ("close #5", {("mentions_issue", "o/r#5")}), ("prefixes #1", {("fixes", "o/r#1"), ("mentions_issue", "o/r#1")}),
    ("o/r#3", set()), ("a/b#3", {("mentions_issue", "a/b#3")}), ("BIP-1, BIP 2 bip3 BIP 12345", {("references_bip", "BIP-1"), ("references_bip", "BIP-2"), ("references_bip", "BIP-3")}), ("LUD-06", {("references_lud", "LUD-06")}),
    ("at abc1234 and abc123 1234567 ABC1234", {("references_commit", "abc1234")}), ("", set()), (None, set()),
]


def test_references(spark):
    df = spark.createDataFrame([(str(i), b, "o/r", 1) for i, (b, _) in enumerate(REFS)] + [("z", "x " * 50000 + "#7", None, 1)], "id string, body string, source_repo string, ord int")
    got = {}
    for r in extract_references(df).collect():
        got.setdefault(r.from_doc_id, set()).add((r.ref_type, r.to_external))
    for i, (body, want) in enumerate(REFS):
        assert got.get(str(i), set()) == want, body
    assert got["z"] == {("mentions_issue", "#7")}


def test_tags(spark):
    df = spark.createDataFrame([("1", "SegWit and BIP-141"), ("2", "resegwitted"), ("3", None), ("4", "op_cat.")], "id string, body string")
    assert sorted((r.doc_id, r.concept_slug) for r in tag_concepts(df).collect()) == [("1", "segwit"), ("4", "op-cat")]
    assert tag_concepts(df, [("own", ["resegwitted"])]).count() == 1


def test_html_and_titles(spark):
    assert one(spark, X.unescape_html(F.col("v")), v="&amp;lt; &quot;&#39;&nbsp;x") == "< \"' x"
    assert one(spark, X.strip_html(F.col("v")), v="a<b>c</b><br/>d") == "acd"
    assert one(spark, X.page_title(F.col("v")), v="<title> A &amp; B </title>") == "A & B"
    assert one(spark, X.page_count(F.col("v")), v='<a class="navPages" href="x">2</a><a class="navPages" href="y">11</a>') == 11
    assert one(spark, X.page_count(F.col("v")), v="none") == 1
    assert one(spark, X.board_id(F.col("v")), v='<a href="i?board=1.0">a</a> <a class="n" href="i?board=6.0">b</a>') == 6
    assert one(spark, X.topic_ids(F.col("v")), v="topic=5.msg1#msg1 topic=7.msg2#msg2 topic=5.msg3#msg3") == [5, 7]
    title = lambda kind, body, n: one(spark, X.spec_title(F.lit(kind), F.col("v"), F.lit(n)), v=body)
    assert title("bip", "<pre>\n  BIP: 9\n  Title: Some thing\n", 9) == "BIP-9: Some thing" and title("bip", "nothing", 9) == "BIP-9"
    assert title("bip", "{|\n| Title = Wiki form", 9) == "BIP-9: Wiki form" or title("bip", "| Title = Wiki form", 9) == "BIP-9: Wiki form"
    assert title("bolt", "# BOLT #4: Onion", 4) == "BOLT #4: Onion" and title("bolt", "x", 4) == "BOLT-4"
    assert title("lud", "## no\n# Pay", 6) == "LUD-06: Pay" and title("lud", "# LUD-06: Pay", 6) == "LUD-06: Pay" and title("nut", "x", 0) == "NUT-00"
    assert title("blip", "# Some", 2) == "bLIP-2: Some"
    assert one(spark, X.front_matter_title(F.col("v")), v="---\nid: 1\ntitle: 'News #12'\n---\nbody") == "News #12"
    assert one(spark, X.issue_number(F.col("v")), v="News #12 and #13") == "12"


def test_mail(spark):
    raw = "subject: old\nSUBJECT: A\n  folded\nFrom: me <m@x>\nSubject:\nDate: Tue, 5 Mar 2024 10:00:00 +0100\n\n body \n"
    h = one(spark, X.mail_headers(F.col("v")), v=raw)
    assert (h.subject, h.sender, h.body) == ("A folded", "me <m@x>", "body") and h.date == datetime(2024, 3, 5, 9)
    h = one(spark, X.mail_headers(F.col("v")), v="From: x")
    assert h.sender == "x" and h.body is None and h.subject is None
    assert one(spark, X.message_id(F.col("v"), "dev"), v="https://h/pi/dev/abc@x/") == "abc@x" and one(spark, X.message_id(F.col("v"), "dev"), v="https://h/other/q") == "q"
    feed = "<feed><entry><link href=\"u1\"/><updated>2020</updated></entry><entry><updated>2</updated></entry></feed>"
    assert [(e.link, e.updated) for e in one(spark, X.atom_entries(F.col("v")), v=feed)] == [("u1", "2020")]
    page = '<span itemprop="name">Subj &amp; x</span><span class="sender" ><a><span itemprop="name">Ann</span></a></span><span class="date"><a href="#">Tue, 5 Mar 2024 10:00:00 +0000</a></span><!--X-Body-of-Message--><pre>Hi &lt;all&gt;' + "_" * 47 + "footer</pre></div>"
    h = one(spark, X.archive_page(F.col("v")), v=page)
    assert (h.subject, h.sender, h.body) == ("Subj & x", "Ann", "Hi <all>")
    posts = one(spark, X.forum_posts(F.col("v")), v='<a class="m" name="msg7"></a><a href="?action=profile;u=3" >Bo &amp; Co</a> January 26, 2019, 06:03:38 AM <div class="post">x<br>y</div><a name="msg8"></a><div class="post"></div>')
    assert [(p.msg, p.author, p.author_id, p.date, p.body) for p in posts] == [(7, "Bo & Co", "3", datetime(2019, 1, 26, 6, 3, 38), "xy")]


def test_cursors(spark):
    assert tuple(one(spark, X.forum_cursor(F.col("v")), v="topic:9|misses:2")) == ("topic", 9, 2) and one(spark, X.forum_cursor(F.col("v")), v="tail:5").mode == "tail"
    assert tuple(one(spark, X.month_cursor(F.col("v")), v="2020-12:30")) == ("2020-12", 30) and one(spark, X.next_month(F.col("v")), v="2020-12") == "2021-01"
    assert one(spark, X.month_cursor(F.lit(None).cast("string"))).month == "2011-06"


def test_dates_ids_urls(spark):
    at = lambda v: one(spark, parse_instant(F.col("v")), v=v)
    assert at("2023-06-01T10:00:00+02:00") == datetime(2023, 6, 1, 8) and at("2023-06-01") == datetime(2023, 6, 1) and at("2023/06/01") is None and at("2023-02-30") is None
    assert one(spark, make_id(F.lit("a"), F.lit(None), F.lit("c"))) == "a:c" and one(spark, make_id(F.lit("a"), F.lit("b"), F.lit("c"))) == "a:b:c"
    url = lambda t, repo="o/r", sid="5", parent=None, meta=None: one(spark, document_url(F.lit(t), F.lit(repo), F.lit(sid), F.lit(parent).cast("string"), F.lit(meta).cast("string")))
    assert url("github_issue") == "https://github.com/o/r/issues/5" and url("github_issue", None) is None
    assert url("github_comment", parent="github_issue:o/r:7") == "https://github.com/o/r/issues/7#issuecomment-5" and url("github_comment", parent="x:y") is None
    assert url("bip", meta='{"url": "u"}') == "u" and url("bip") is None and url("mailing_list_msg") is None
    assert url("optech_newsletter", meta='{"slug": "2023-03-01-newsletter"}').endswith("/2023/03/01/") and url("optech_newsletter", meta='{"slug": "x-y"}') is None
    assert url("bitcointalk_post", parent="bitcointalk_topic::9").endswith("topic=9.msg5#msg5")


def doc(i, title="t", repo="o/r", sid=None, created="2020-01-01", kind="github_issue", body="b"):
    return (i, kind, repo, sid or i, title, body, None, None, datetime.fromisoformat(created), None, None, None, None)


def test_upsert(spark):
    stored = spark.createDataFrame([(*doc("a", "old")[:-1], 1)], DOCUMENTS)
    log = spark.createDataFrame([(1, "a", "insert", datetime(2020, 1, 1))], CHANGE_LOG)
    batch = spark.createDataFrame([(*doc("a", "new", created="2022-01-01"), 1), (*doc("b", "first"), 2), (*doc("b", "second"), 3)], DOCUMENTS + ", batch_pos long")
    docs, new = U.upsert_documents(stored, batch, log, "2023-01-01 00:00:00")
    got = {r.id: r for r in docs.collect()}
    assert got["a"].title == "new" and got["a"].created_at == datetime(2020, 1, 1) and got["a"].seq == 2 and got["b"].title == "second" and got["b"].seq == 4
    assert [(r.seq, r.doc_id, r.change_type) for r in new.orderBy("seq").collect()][1:] == [(2, "a", "update"), (3, "b", "insert"), (4, "b", "update")]
    clash = spark.createDataFrame([(*doc("c", sid="a"), 1)], DOCUMENTS + ", batch_pos long")
    with pytest.raises(U.DuplicateKeyError):
        U.upsert_documents(stored, clash, log, "2023-01-01 00:00:00")
    free = spark.createDataFrame([(*doc("c", sid="a", repo=None), 1), (*doc("d", sid="a", repo=None), 2)], DOCUMENTS + ", batch_pos long")
    assert U.upsert_documents(stored, free, log, "2023-01-01 00:00:00")[0].count() == 3


def test_small_mutations(spark):
    mentions = spark.createDataFrame([("a", "x", 0.5)], "doc_id string, concept_slug string, confidence float")
    new = spark.createDataFrame([("a", "x", 1.0), ("a", "x", 0.7), ("b", "y", 1.0)], "doc_id string, concept_slug string, confidence float")
    assert sorted((r.doc_id, r.confidence) for r in U.upsert_mentions(mentions, new).collect()) == [("a", 1.0), ("b", 1.0)]
    states = "source_id string, source_type string, source_repo string, status string"
    out = U.update_sync_state(spark.createDataFrame([("s", "t", "r", "ok")], states), spark.createDataFrame([("s", "other", None, "error"), ("n", "t2", None, "ok")], states)).collect()
    assert {r.source_id: (r.source_type, r.source_repo, r.status) for r in out} == {"s": ("t", "r", "error"), "n": ("t2", None, "ok")}
    refs = spark.createDataFrame([(5, "a", None, "fixes", "o/r#1", "c")], "id long, from_doc_id string, to_doc_id string, ref_type string, to_external string, context string")
    more = refs.unionByName(refs)
    assert U.append_references(refs, more).count() == 2 and U.append_references(refs, more, dedupe=False).count() == 3
    ids = [r.id for r in U.append_references(refs, more, dedupe=False).collect()]
    assert len(set(ids)) == 3 and min(ids) == 5


def test_lookups(spark):
    specs = spark.createDataFrame([("lud:6", "lud", "06", "T"), ("lud:06x", "lud", "6", "U")], "id string, source_type string, source_id string, title string")
    refs = spark.createDataFrame([(1, "d", None, "references_lud", "LUD-6", ""), (2, "d", None, "references_lud", "LUD-06", ""), (3, "d", "lud:06x", "replies_to", None, ""), (4, "d", "lud:06x", "references_lud", "LUD-6", ""), (5, "lud:06x", None, "fixes", "x", "")],
                                 "id long, from_doc_id string, to_doc_id string, ref_type string, to_external string, context string")
    tags = spark.createDataFrame([("lud:06x", "b"), ("lud:06x", "a")], "doc_id string, concept_slug string")
    r = C.lookup_spec(specs, refs, tags, "lud", 6).first()
    assert r.id == "lud:06x" and (r.n_out, r.n_in) == (1, 3) and r.concepts == ["a", "b"]
    assert sorted((e.side, e.ref_id) for e in C.spec_edges(specs, refs, [("lud", 6), ("lud", 7)]).collect()) == [("incoming", 1), ("incoming", 3), ("incoming", 4), ("outgoing", 5)]
    assert sorted((e.id, e.side, e.ref_id) for e in C.document_edges(refs, ["lud:06x"]).collect()) == [("lud:06x", "incoming", 3), ("lud:06x", "incoming", 4), ("lud:06x", "outgoing", 5)]
    assert C.lookup_spec(specs, refs, tags, "lud", 7).count() == 0
    assert [e.id for e in C.references_to(refs, "LUD-6").collect()] == [1, 4] and C.references_to(refs, "LUD-6", "fixes").count() == 0
    feed = C.changes_since(spark.createDataFrame([(i, "d", "insert", None) for i in range(5)], CHANGE_LOG), 1, 2).orderBy("seq").collect()
    assert [f.seq for f in feed] == [2, 3] and feed[0].has_more and feed[0].next_seq == 3


def test_metrics(spark):
    f = lambda c: one(spark, c)
    assert [f(M.adaptive_interval(F.lit(3600.0), F.lit(n))) for n in (0, 3, 10)] == [7200, 3600, 1800]
    assert [f(M.backoff_seconds(F.lit(n))) for n in range(1, 9)] == [60, 120, 240, 480, 960, 1920, 1920, 1920]
    assert M.may_request(200, 10.0, 4.0) == 7.0 and M.may_request(201, 10.0, 4.0) == 0
    e = spark.createDataFrame([("a", datetime(2020, 1, 1), 5), ("b", datetime(2020, 1, 2), 5), ("c", datetime(2020, 1, 2), 5)], "key string, access_time timestamp, bytes long")
    assert [r.key for r in M.lru_evictions(e, 10).collect()] == ["a"] and M.lru_evictions(e, 15).count() == 0 and M.lru_evictions(e.where("false"), 1).count() == 0
    lines = spark.createDataFrame([("k", 0, "ab"), ("k", 1, "é"), ("k", 2, "z")], "key string, line_no int, line string")
    assert M.truncate_lines(lines, cap=6).first().patch == "ab\né\n[truncated at 6 bytes]" and not M.truncate_lines(lines, cap=100).first().truncated


def test_mails_in_hard_forms(spark, tmp_path):
    """Folded subjects, dates with tabs and several blanks, and nulls are rows of the results."""
    from loomdex.plans.knowledge import QUERIES

    rows = [(1, "A\n  folded\n\tone", " Sat,  8 May 2021 23:58:28 -0400\t", "me", "b"), (2, None, None, None, None), (3, "plain", "Thu,\t26 Apr 2018\t08:30:48 +0200 (CEST)", "me", "b"), (4, "x", "2024-03-05T10:00:00Z", "me", "b")]
    spark.createDataFrame(rows, "mail_id long, subject string, date string, sender string, body string").write.parquet(f"{tmp_path}/parsed_email.parquet")
    heads = {r.mail_id: (r.subject, r.sender, r.body) for r in QUERIES["mail_headers"](spark, str(tmp_path)).collect()}
    assert heads == {1: ("A folded one", "me", "b"), 2: (None, None, None), 3: ("plain", "me", "b"), 4: ("x", "me", "b")}
    us = lambda *t: int((datetime(*t) - datetime(1970, 1, 1)).total_seconds()) * 10**6
    dates = {r.mail_id: r.utc_us for r in QUERIES["mail_dates"](spark, str(tmp_path)).collect()}
    assert dates == {1: us(2021, 5, 9, 3, 58, 28), 2: None, 3: us(2018, 4, 26, 6, 30, 48), 4: us(2024, 3, 5, 10)}
