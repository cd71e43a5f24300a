from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomdex.llm.mailtext import new_text

MAILS = {
    "top": ("Hi all,+||First new line here.+|which goes on.+||Cheers,|Ann||On Mon, 5 Mar 2024 at 10:00, Bob <b@x> wrote:|> old|> older||_______________________________________________|dev mailing list|manage at https://l/i"),
    "two-line intro": "New words.+||On Tue, Mar 29, 2016 at 12:20 Alexander Long Name|<alexander@post.example> wrote:|AP> old|AP>|more new.+",
    "trap": "On this list every peer once wrote: go on, and I agree.+|From: faucet to draft it takes 9 blocks.+",
    "forward": "See below.+||---------- Forwarded message ----------|From: X <x@y.z>|Date: today|To: list|Subject: s||unmarked old text",
    "outlook": "Top.+||-|J.||________________________________|From: X <x@y.z>|Sent: today|To: list|Subject: s||unmarked old text",
    "ps": "Body text.+||Best regards|Ann Bee|QA, Some Labs|tel. +00 1||PS: One more thing.+|and its rest.+||CONFIDENTIALITY NOTICE: the contents may|be privileged.",
    "signed": "-----BEGIN PGP SIGNED MESSAGE-----|Hash: SHA256||Text.+||— Ann|-----BEGIN PGP SIGNATURE-----||abc|-----END PGP SIGNATURE-----",
    "delimiter": "Text.+||-||Ann Bee|QA",
    "thanks": "Thanks!+||Nobody tracked the feed, yet the receiver reverts it at the tip.+",
    "slogan": "> [snip]|Get Mailwren for mobile",
    "foreign": "Neu.+||Am 5.3.2024 um 10:00 schrieb Bob B:|| alt|El 25/9/2019 a las 17:19, Stefan T escribió:|> viejo||Viele Grüße|Ann",
    "quoting": "Quoting Bob <b@x>:|> old||reply.+||* Bob <b@x> [2024-01-01 10:00]:|| old",
}


def frame(spark, bodies):
    rows = [("m", i, f"id{i}", f"thread{i}", f"s{i}", i, b, "x") for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "src_table string, src_key long, message string, thread string, sender string, sent_us long, body string, kind string")


@pytest.fixture(scope="module")
def parts(spark):
    bodies = [b.replace("|| ", "\n| ").replace("|", "\n").replace("\n\n alt", "\n| alt").replace("+", "") for b in MAILS.values()]
    bodies = ["\n".join("| " + x[1:] if x.startswith("\x01") else x for x in b.split("\n")) for b in bodies]
    out = {}
    for r in new_text(frame(spark, bodies)).collect():
        out.setdefault(r.src_key, {})[r.line_no] = r.part
    return bodies, out


@pytest.mark.parametrize("name", [n for n in MAILS if n not in ("foreign", "quoting")])
def test_lines(parts, name):
    bodies, got = parts
    i = list(MAILS).index(name)
    want = {n for n, line in enumerate(MAILS[name].split("|"), 1) if line.endswith("+")}
    assert {n for n, p in got[i].items() if p == "text"} == want, [(line, got[i][n]) for n, line in enumerate(bodies[i].split("\n"), 1)]


def test_pipe_quotes(spark):
    body = "Neu.\n\nAm 5.3.2024 um 10:00 schrieb Bob B:\n| alt\n|\nEl 25/9/2019 a las 17:19, Stefan T escribió:\n > viejo\n\nViele Grüße\nAnn"
    assert {r.line_no for r in new_text(frame(spark, [body])).where("part = 'text'").collect()} == {1}


def test_thread_and_recurrence(spark):
    """Unmarked history after an introduction is found in the thread; a recurring last line is a signature; copies of one message are not each other's history."""
    old = "The quick brown fox jumps over it."
    reply = f"I agree with that.\n\nOn Mon, 5 Mar 2024 at 10:00, Bob wrote:\n{old}\nBut this sentence is a new one."
    rows = [("m", 1, "a", "t", "bob", 1, old), ("m", 2, "b", "t", "ann", 2, reply), ("m", 3, "a", "t", "bob", 1, old)]
    rows += [("m", 10 + i, f"n{i}", f"u{i}", "cy", 9, f"Some sentence number {i}.\n\nCy of the hills") for i in range(4)]
    df = spark.createDataFrame(rows, "src_table string, src_key long, message string, thread string, sender string, sent_us long, body string")
    got = {(r.src_key, r.line_no): r.part for r in new_text(df).collect()}
    assert got[(2, 4)] == "history" and got[(2, 5)] == "text" and got[(1, 1)] == got[(3, 1)] == "text" and got[(10, 3)] == "signature" and got[(10, 1)] == "text"


def test_rules(spark):
    """Quotes whose original is in the thread fall to the thread rule; an edited re-send keeps its text; contact lines of any length fall to recurrence, and not below its share."""
    a, b = "The quick brown fox jumps over it.", "A second sentence stands here alone."
    block = "\n".join(f"{w} of the long contact block of this sender, which ends like sentences do." for w in ("One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight"))
    rows = [("m", 1, "a", "t", "Bob B <b@x>", 1, f"{a}\n{b}"), ("m", 2, "b", "t", "ann", 2, f"> {a}\nNo.\n> > Not in the thread at all, this."), ("m", 3, "c", "t", "bob", 3, f"{a}\n{b}\nAnd one more line of it.")]
    rows += [("m", 10 + i, f"n{i}", f"u{i}", '"B, Cy" <c@x>' if i % 2 else "Cy B via list", 9, f"Some sentence number {i}.\n\n{block}") for i in range(4)]
    rows += [("m", 50 + i, f"o{i}", f"v{i}", "dee", 9, f"Other sentence number {i}.\n\n" + ("Thanks for the fish." if i < 3 else f"Nothing {i} here.")) for i in range(40)]
    df = spark.createDataFrame(rows, "src_table string, src_key long, message string, thread string, sender string, sent_us long, body string")
    got = {(r.src_key, r.line_no): (r.part, r.rule) for r in new_text(df).collect()}
    assert got[(2, 1)] == ("history", "thread") and got[(2, 2)][0] == "text" and got[(2, 3)] == ("history", "form")
    assert [got[(3, n)][0] for n in (1, 2, 3)] == ["text"] * 3
    assert all(got[(10 + i, n)] == ("signature", "recurrence") for i in range(4) for n in range(3, 11)) and got[(10, 1)][0] == "text"
    assert got[(50, 3)][0] == "text"


def test_edges(spark):
    rows = [("m", 1, None, None, None, None, None), ("m", 2, None, None, None, None, ""), ("m", 3, "x", "t", "s", None, "one line\n" * 20000), ("m", 3, "x", "t", "s", None, "again")]
    df = spark.createDataFrame(rows, "src_table string, src_key long, message string, thread string, sender string, sent_us long, body string")
    got = new_text(df).groupBy("src_key").agg(F.count("*").alias("n")).collect()
    assert {r.src_key: r.n for r in got}[2] == 1 and {r.src_key: r.n for r in got}[3] >= 20001 and 1 not in {r.src_key for r in got}
    assert new_text(df.where("false")).count() == 0
