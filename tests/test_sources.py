from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from loomdex.plans import sources
from loomdex.sources import archives as A
from loomdex.sources import commits as K
from loomdex.sources import tracker as T
from loomdex.sources.paged import PagedSource
from loomdex.sources.registry import jobs, reset_patterns
from loomdex.streaming.ingest import EpochStore, ingest_batch, ingest_stream


def test_tracker(spark):
    at = datetime(2020, 1, 1)
    rows = spark.createDataFrame([(1, "T", "B", "open", ("bob", 7), [("x",)], at, at, None), (2, "P", None, "closed", None, None, at, datetime(2021, 1, 1), "url")], T.ISSUE)
    got = {r.id: r for r in T.issue_documents(rows, "o/r").collect()}
    assert json.loads(got["github_issue:o/r:1"].metadata) == {"state": "open", "labels": ["x"], "is_pr": False} and got["github_issue:o/r:1"].author_id == "7"
    assert json.loads(got["github_pr:o/r:2"].metadata)["is_pr"] and got["github_pr:o/r:2"].author is None
    assert T.next_cursor(rows, 2).startswith("2021-01-01T00:00:00") and T.next_cursor(rows, 3) is None
    comments = spark.createDataFrame([(9, "B", ("bob", 7), at, at, "https://h/issues/12"), (10, "B", None, at, at, "https://h/issues/")], T.COMMENT)
    assert {r.id: r.parent_id for r in T.comment_documents(comments, "o/r").collect()} == {"github_comment:o/r:9": "github_issue:o/r:12", "github_comment:o/r:10": None}


def test_commits(spark):
    c = lambda sha, parents, message, files=(), patch=None: (sha, parents, message, "Ann", "a@x", 1_600_000_000, 1, 2, list(files), patch)
    rows = [c("r", [], "Root\n\nbody", [("a", "A")], "+x"), c("m", ["r"], "Mod", [(f"f{i}", "M") for i in range(102)] + [("q", "Z")], "y" * 9000), c("b", ["r"], "Side", [("q", "Z")]), c("g", ["m", "b"], "Merge pull request #12 from x/y\n\nz")]
    df = spark.createDataFrame(rows, K.COMMIT)
    docs = {r.source_id: r for r in K.commit_documents(df, "o/r").collect()}
    assert docs["r"].title == "Root" and docs["r"].body == "Root\n\nbody\n\n---\nChangeset:\n1 files changed, 1 insertions(+), 2 deletions(-)\nA a\n\n+x"
    assert "... and 3 more files" in docs["m"].body and docs["m"].body.endswith("[truncated at 8192 bytes]") and "? q" in docs["b"].body
    assert "Changeset" not in docs["g"].body and json.loads(docs["g"].metadata)["is_merge"]
    assert [r.to_external for r in K.merge_edges(df, "o/r").collect()] == ["o/r#12"]
    assert {r.sha for r in K.new_commits(df, "g", "m").collect()} == {"g", "b"} and K.new_commits(df, "g").count() == 4
    assert K.default_branch(["x", "master"]) == "master" and K.default_branch([]) is None


def test_archives(spark, tmp_path):
    for name, body in (("bip-0009.md", "Title: Nine"), ("README.md", "no"), ("2020-01-01-news.md", "---\ntitle: 'News #3'\n---\nx"), ("notes.txt", "x")):
        (tmp_path / name).write_text(body)
    files = A.text_files(spark, str(tmp_path))
    r = A.spec_documents(files, "bip", "o/specs", "2020-01-01", "https://h/{name}").collect()
    assert [(x.id, x.title, json.loads(x.metadata)["url"]) for x in r] == [("bip:o/specs:9", "BIP-9: Nine", "https://h/bip-0009.md")]
    assert {x.id for x in A.newsletter_documents(files, "2020-01-01").collect()} >= {"optech_newsletter:3"}
    logs = spark.createDataFrame([("c", "2020-01-02", "hi"), ("c", "2020-01-03", " ")], "channel string, day string, body string")
    assert [(x.id, x.created_at) for x in A.chat_documents(logs).collect()] == [("irc_log:c:2020-01-02", datetime(2020, 1, 2))]
    days = spark.range(1).select(A.log_days(F.lit("2020-01-01").cast("date"), F.lit("2020-01-03").cast("date")).alias("d")).first().d
    assert len(days) == 2
    at = datetime(2020, 1, 1)
    topics = spark.createDataFrame([(5, "T", at, 2, [("x",)], [(50, 1, "a", "<p>", at, at, None), (51, 2, "b", "q", at, at, 1), (52, 3, "c", "q", at, at, 9)])],
                                   "id long, title string, created_at timestamp, category_id int, tags array<struct<name: string>>, posts array<struct<id: long, post_number: int, username: string, cooked: string, created_at: timestamp, updated_at: timestamp, reply_to_post_number: int>>")
    assert {x.id: x.parent_id for x in A.topic_documents(topics).collect()} == {"delving_topic:5": None, "delving_post:51": "delving_topic:5", "delving_post:52": "delving_topic:5"}
    assert [(x.from_doc_id, x.to_doc_id) for x in A.reply_edges(topics).collect()] == [("delving_post:51", "delving_topic:5")]
    mails = spark.createDataFrame([("m1", "Subject: S\nDate: Tue, 5 Mar 2024 10:00:00 +0000\n\nB", "m0"), ("m2", "no headers", None)], "message_id string, raw string, in_reply_to string")
    assert {x.id: (x.title, x.parent_id) for x in A.mail_documents(mails, "l").collect()} == {"mailing_list_msg:m1": ("S", "mailing_list_msg:m0"), "mailing_list_msg:m2": (None, None)}
    html = '<title>T</title><a href="?board=6.0">x</a><a name="msg1"></a><div class="post">p</div><a name="msg2"></a><div class="post">q</div>'
    pages = spark.createDataFrame([(3, html)], "topic_id long, html string")
    assert {x.id for x in A.board_documents(pages, [6]).collect()} == {"bitcointalk_topic::3", "bitcointalk_post::2"} and A.board_documents(pages, [1]).count() == 0
    assert spark.range(1).select(A.ended(F.array(F.lit(True), F.lit(False), F.lit(False), F.lit(False))).alias("x")).first().x


def test_chat_parts(spark, tmp_path):
    """Further logs of one day keep their part in the id, and a log without a readable day stays; rows equal those of the SQL."""
    import duckdb

    logs = spark.createDataFrame([("c", "2020-01-02", None, "a"), ("c", "2020-01-02", "1", "b"), ("c", "2020-02-30", "2", "d"), ("c", None, None, "e")], "channel string, day string, part string, body string")
    assert {x.id: (x.source_id, x.title, x.created_at) for x in A.chat_documents(logs).collect()} == {
        "irc_log:c:2020-01-02": ("c:2020-01-02", "#c IRC log 2020-01-02", datetime(2020, 1, 2)), "irc_log:c:2020-01-02:1": ("c:2020-01-02:1", "#c IRC log 2020-01-02", datetime(2020, 1, 2)),
        "irc_log:c:2020-02-30:2": ("c:2020-02-30:2", "#c IRC log 2020-02-30", None), "irc_log:c": ("c", "#c IRC log ", None),
    }
    names = ["c:2020-01-02", "c:2020-01-02:1", "c:2020-01-02:1:x", "c:2020-02-30", "c:1", "c:2020-1-5", "c", "c:", "c::2", ":", "", None]
    columns = "doc_id long, id string, source_type string, source_repo string, source_id string, title string, body string, author string, parent_id string, metadata string"
    rows = [(i, str(i), "irc_log", None, n, None, "x", None, None, None) for i, n in enumerate(names)] + [(99, "99", "irc_log", None, "c:2020-01-03:1", None, " ", None, None, None)]
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = con.execute(sources.ORACLE["src_chat"]).fetchall()
    got = [tuple(r) for r in sources.QUERIES["src_chat"](spark, str(tmp_path)).select("id", "title", "day").collect()]
    assert len(want) == len(names) and sorted(got, key=str) == sorted(want, key=str)


def test_registry(spark):
    got = jobs(spark, ["o/r"], channels=["c"], specs={"bip": "o/s"}, newsletters=True)
    assert {r.source_id for r in got.collect()} == {"issues:o/r", "comments:o/r", "commits:o/r", "irc:c", "specs:bip", "newsletters"}
    assert reset_patterns("commit") == ("commits:%",) and reset_patterns("bip") == ("specs:bip",)


def _page(path, n, rows):
    (path / f"p{n:03d}.json").write_text("\n".join(json.dumps(r) for r in rows))


def test_paged_stream_restart(spark, tmp_path):
    """A stream over pages equals the batch result, also when pages arrive between two runs."""
    spark.dataSource.register(PagedSource)
    pages, base = tmp_path / "pages", tmp_path / "kb"
    pages.mkdir()
    issue = lambda n, t: {"number": n, "title": t, "body": f"see #{n} and segwit", "state": "open", "created_at": "2020-01-01T00:00:00Z", "updated_at": "2020-01-01T00:00:00Z"}
    _page(pages, 1, [issue(1, "one"), issue(2, "two")])

    def documents(stream):
        rows = stream.select("page", "pos", F.from_json("value", T.ISSUE).alias("r")).select("page", "pos", "r.*")
        return rows

    store = EpochStore(spark, f"file://{base}")

    def run():
        raw = spark.readStream.format("paged").option("path", str(pages)).load()

        def sink(batch, epoch):
            rows = documents(batch).orderBy("page", "pos").collect()
            if rows:
                numbered = spark.createDataFrame([(*r[2:], i + 1) for i, r in enumerate(rows)], T.ISSUE + ", batch_pos long")
                docs = T.issue_documents(numbered, "o/r").join(numbered.select(F.concat(F.lit("github_issue:o/r:"), F.col("number").cast("string")).alias("id"), "batch_pos"), "id")
                ingest_batch(store, docs, epoch, "2020-02-01 00:00:00")

        q = raw.writeStream.option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(sink).start()
        q.processAllAvailable()
        q.stop()

    run()
    assert {r.title for r in store.read("documents").collect()} == {"one", "two"}
    _page(pages, 2, [issue(2, "two again"), issue(3, "three")])
    run()
    run()
    assert {r.id[-1]: r.title for r in store.read("documents").collect()} == {"1": "one", "2": "two again", "3": "three"}
    assert sorted(r.change_type for r in store.read("change_log").collect()) == ["insert", "insert", "insert", "update"]
    refs = store.read("refs").collect()
    assert sorted(r.to_external for r in refs) == ["o/r#1", "o/r#2", "o/r#3"] and len({r.id for r in refs}) == 3
    assert store.read("concept_mentions").count() == 3
    assert spark.read.format("paged").option("path", str(pages)).load().count() == 4
    assert callable(ingest_stream)


def test_last_version_and_crash(spark, tmp_path, monkeypatch):
    """Of two versions of one id the last holds for text and references; page-level references are stored once; a crash before the manifest is published leaves the last batch in force."""
    store = EpochStore(spark, f"file://{tmp_path}/kb", buckets=4)
    columns = "id string, source_type string, source_repo string, source_id string, title string, body string, author string, author_id string, created_at timestamp, updated_at timestamp, parent_id string, metadata string, seq long, batch_pos long"
    doc = lambda n, body, pos: (f"github_issue:o/r:{n}", "github_issue", "o/r", str(n), f"t{n}", body, None, None, None, None, None, None, None, pos)
    batch = spark.createDataFrame([doc(1, "See BIP-222", 2), doc(1, "See BIP-111", 1), doc(2, None, 3)], columns)
    stated = spark.createDataFrame([("github_issue:o/r:2", "github_issue:o/r:1", "replies_to", None, None)], "from_doc_id string, to_doc_id string, ref_type string, to_external string, context string")
    ingest_batch(store, batch, 0, "2020-02-01 00:00:00", [], page_refs=stated, cursors={"s": "p1"})

    def state():
        return {r.id[-1]: r.body for r in store.read("documents").collect()}, sorted((r.ref_type, r.to_external) for r in store.read("refs").collect()), store.manifest()["epoch"], store.read("change_log").count()

    want = ({"1": "See BIP-222", "2": None}, [("references_bip", "BIP-222"), ("replies_to", None)], 0, 3)
    assert state() == want and store.manifest()["cursors"] == {"s": "p1"}

    def crash(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(EpochStore, "_publish", crash)
    with pytest.raises(RuntimeError):
        ingest_batch(store, spark.createDataFrame([doc(1, "See BIP-333", 1)], columns), 1, "2020-02-02 00:00:00", [])
    assert state() == want
    monkeypatch.undo()
    # A crash in the middle of writing leaves a manifest without its last line, which does not count.
    (tmp_path / "kb" / "manifests" / "m-000000000007").write_text('{"epoch": 7')
    assert state() == want
    ingest_batch(store, spark.createDataFrame([doc(1, "See BIP-333", 1)], columns), 1, "2020-02-02 00:00:00", [], page_refs=stated)
    assert state() == ({"1": "See BIP-333", "2": None}, [("references_bip", "BIP-333"), ("replies_to", None)], 1, 4)
    store.compact("change_log", "seq long, doc_id string, change_type string, changed_at timestamp", 2)
    assert store.read("change_log").count() == 4
