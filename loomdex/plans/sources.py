"""Registered queries of the source adapters: raw rows and pages are built from whole tables and read back, with the SQL of what must come out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.plans.knowledge import _UNESCAPE
from loomdex.session import read_table
from loomdex.sources import archives as A
from loomdex.sources import commits as K
from loomdex.sources import tracker as T
from loomdex.sources import walks as W

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE[f.__name__] = sql
        return f

    return add


def _escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _read_back(column: str) -> str:
    """SQL of a text that was escaped and is read back."""
    return _UNESCAPE.format(f"replace(replace(replace({column}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')")


def _documents(spark: SparkSession, sf: str, *types: str) -> DataFrame:
    return read_table(spark, sf, "documents", "doc_id", "id", "source_type", "source_repo", "source_id", "title", "body", "author", "parent_id", "metadata").where(F.col("source_type").isin(*types))


@_query("SELECT id, source_type, title, author, CASE source_type WHEN 'github_pr' THEN 'true' ELSE 'false' END AS is_pr FROM documents WHERE source_type IN ('github_issue', 'github_pr')")
def src_tracker(spark, sf):
    d = _documents(spark, sf, "github_issue", "github_pr")
    rows = d.select(F.col("source_id").cast("long").alias("number"), "title", "body", F.lit("open").alias("state"), F.when(F.col("author").isNotNull(), F.struct(F.col("author").alias("login"), F.lit(1).cast("long").alias("id"))).alias("user"), F.lit(None).cast("array<struct<name: string>>").alias("labels"),
                    F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.when(F.col("source_type") == "github_pr", "url").alias("pull_request"), "source_repo")
    return T.issue_documents(rows, F.col("source_repo")).select("id", "source_type", "title", "author", F.get_json_object("metadata", "$.is_pr").alias("is_pr"))


@_query("SELECT id, 'github_issue:' || source_repo || ':' || doc_id AS parent_id, body FROM documents WHERE source_type = 'github_comment'")
def src_comments(spark, sf):
    d = _documents(spark, sf, "github_comment")
    rows = d.select(F.col("source_id").cast("long").alias("id"), "body", F.lit(None).cast("struct<login: string, id: long>").alias("user"), F.lit(None).cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("updated_at"), F.concat(F.lit("https://h/issues/"), F.col("doc_id").cast("string")).alias("issue_url"), "source_repo")
    return T.comment_documents(rows, F.col("source_repo")).select("id", "parent_id", "body")


def _commits(spark: SparkSession, sf: str) -> DataFrame:
    d = _documents(spark, sf, "commit", "github_pr")
    merge = F.col("source_type") == "github_pr"
    message = F.when(merge, F.concat(F.lit("Merge pull request #"), "source_id", F.lit(" from x/y"))).otherwise(F.coalesce("title", F.lit("")))
    return d.select(F.when(merge, F.concat(F.lit("m"), F.col("doc_id").cast("string"))).otherwise(F.col("source_id")).alias("sha"), F.when(merge, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a"))).alias("parents"), message.alias("message"), F.col("author").alias("author_name"), F.lit(None).cast("string").alias("author_email"),
                    F.lit(0).cast("long").alias("ts"), F.lit(1).cast("long").alias("insertions"), F.lit(2).cast("long").alias("deletions"), F.array(F.struct(F.lit("a.c").alias("path"), F.lit("M").alias("status")), F.struct(F.lit("b.c").alias("path"), F.lit("Z").alias("status"))).alias("files"), F.col("body").alias("patch"), "source_repo")


_PATCH = """CASE WHEN body IS NULL THEN '' ELSE chr(10) || chr(10) || (WITH l AS (SELECT unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS no), c AS (SELECT no, line, sum(strlen(line) + 1) OVER (ORDER BY no) AS upto FROM l)
  SELECT coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (upto <= 8192), '') || CASE WHEN max(upto) > 8192 THEN chr(10) || '[truncated at 8192 bytes]' ELSE '' END FROM c) END"""


@_query(f"""SELECT 'commit:' || source_repo || ':' || source_id AS id, coalesce(title, '') AS title, rtrim(coalesce(title, ''), ' ') || chr(10) || chr(10) || '---' || chr(10) || 'Changeset:' || chr(10) || '2 files changed, 1 insertions(+), 2 deletions(-)' || chr(10) || 'M a.c' || chr(10) || '? b.c' || {_PATCH} AS body FROM documents WHERE source_type = 'commit'
  UNION ALL SELECT 'commit:' || source_repo || ':m' || doc_id, 'Merge pull request #' || source_id || ' from x/y', 'Merge pull request #' || source_id || ' from x/y' FROM documents WHERE source_type = 'github_pr'""")
def src_commits(spark, sf):
    return K.commit_documents(_commits(spark, sf), F.col("source_repo")).select("id", "title", "body")


@_query("SELECT 'commit:' || source_repo || ':m' || doc_id AS from_doc_id, 'mentions_pr' AS ref_type, source_repo || '#' || source_id AS to_external FROM documents WHERE source_type = 'github_pr'")
def src_merges(spark, sf):
    return K.merge_edges(_commits(spark, sf), F.col("source_repo")).select("from_doc_id", "ref_type", "to_external")


_N = "cast(cast(source_id AS INT) AS VARCHAR)"
_P = f"CASE WHEN length({_N}) < 2 THEN '0' || {_N} ELSE {_N} END"


@_query(f"""SELECT source_type || ':o/specs:' || {_N} AS id, CASE source_type WHEN 'bip' THEN 'BIP-' || {_N} || ': ' || trim(title) WHEN 'bolt' THEN trim(title) WHEN 'blip' THEN 'bLIP-' || {_N} || ': ' || trim(title)
  WHEN 'lud' THEN CASE WHEN regexp_matches(title, '^(?i)LUD-') THEN trim(title) ELSE 'LUD-' || {_P} || ': ' || trim(title) END WHEN 'nut' THEN CASE WHEN regexp_matches(title, '^(?i)NUT-') THEN trim(title) ELSE 'NUT-' || {_P} || ': ' || trim(title) END END AS title FROM specs""")
def src_specs(spark, sf):
    s = read_table(spark, sf, "specs", "source_type", "source_id", "title", "body")
    n = F.col("source_id").cast("int").cast("string")
    names = {"bip": F.concat(F.lit("bip-"), F.lpad(n, 4, "0"), F.lit(".mediawiki")), "bolt": F.concat(F.lpad(n, 2, "0"), F.lit("-x.md")), "blip": F.concat(F.lit("blip-"), F.lpad(n, 4, "0"), F.lit(".md")), "lud": F.concat(F.lpad(n, 2, "0"), F.lit(".md")), "nut": F.concat(F.lpad(n, 2, "0"), F.lit(".md"))}
    out = None
    for kind, name in names.items():
        head = F.concat(F.lit("<pre>\n  BIP: 1\n  Title: "), "title") if kind == "bip" else F.concat(F.lit("# "), "title")
        files = s.where(F.col("source_type") == kind).select(name.alias("name"), F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("body"))
        one = A.spec_documents(files, kind, "o/specs", "2020-01-01").select("id", "title")
        out = one if out is None else out.unionByName(one)
    return out


@_query("SELECT 'optech_newsletter:' || doc_id AS id, 'Issue #' || doc_id || ' news' AS title, coalesce(json_extract_string(metadata, '$.slug'), 'x') AS slug FROM documents WHERE source_type = 'optech_newsletter'")
def src_newsletters(spark, sf):
    d = _documents(spark, sf, "optech_newsletter")
    slug = F.get_json_object("metadata", "$.slug")
    files = d.select(F.concat(F.coalesce(slug, F.lit("x")), F.lit(".md")).alias("name"), F.concat(F.lit("---\ntitle: 'Issue #"), F.col("doc_id").cast("string"), F.lit(" news'\n---\n"), F.coalesce("body", F.lit(""))).alias("body"))
    return A.newsletter_documents(files, "2020-01-01").select("id", "title", F.get_json_object("metadata", "$.slug").alias("slug"))


@_query(r"""SELECT 'mailing_list_msg:' || mail_id AS id, nullif(trim(regexp_replace(regexp_replace(subject, '\n[ \t]+', ' ', 'g'), '\s*\n.*$', '')), '') AS title, nullif(regexp_replace(body, '^\s+|\s+$', '', 'g'), '') AS body, 'mailing_list_msg:p' || mail_id AS parent_id FROM parsed_email""")
def src_mail(spark, sf):
    """Every mail as a raw message, folded and missing subjects included."""
    e = read_table(spark, sf, "parsed_email", "mail_id", "subject", "sender", "body")
    raw = F.concat(F.lit("Subject: "), F.coalesce("subject", F.lit("")), F.lit("\nFrom: "), F.coalesce("sender", F.lit("")), F.lit("\n\n"), F.coalesce("body", F.lit("")))
    mails = e.select(F.col("mail_id").cast("string").alias("message_id"), raw.alias("raw"), F.concat(F.lit("p"), F.col("mail_id").cast("string")).alias("in_reply_to"))
    return A.mail_documents(mails, "l").select("id", "title", "body", "parent_id")


@_query("SELECT mail_id, mail_id || '@x/y' AS message_id, '2020-01-02T03:04:05Z' AS updated FROM parsed_email")
def src_feed(spark, sf):
    """A feed of one entry for each mail, with an entry without link: links, times and message ids come back."""
    e = read_table(spark, sf, "parsed_email", "mail_id")
    xml = F.concat(F.lit('<feed><link href="z"/><entry><updated>2020</updated></entry><entry><title>t</title><link rel="a" href="https://l/pi/l/'), F.col("mail_id").cast("string"), F.lit('@x/y//"/><updated>\n2020-01-02T03:04:05Z </updated></entry></feed>'))
    rows = e.select("mail_id", F.explode(X.atom_entries(xml)).alias("e"))
    return rows.select("mail_id", X.message_id(F.col("e.link"), "l").alias("message_id"), F.regexp_replace("e.updated", r"\s", "").alias("updated"))


@_query(f"""SELECT 'mailing_list_msg:l/msg' || CASE WHEN msg_num < 100000 THEN lpad(cast(msg_num AS VARCHAR), 5, '0') ELSE cast(msg_num AS VARCHAR) END AS id, nullif(trim({_read_back("coalesce(subject, '')")}), '') AS title, nullif(trim({_read_back("coalesce(sender, '')")}), '') AS author,
  nullif(trim(string_split({_read_back("coalesce(body, '')")}, repeat('_', 47))[1]), '') AS body FROM parsed_message""")
def src_archive(spark, sf):
    m = read_table(spark, sf, "parsed_message", "msg_num", "subject", "sender", "body")
    text = lambda c: _escaped(F.coalesce(c, F.lit("")))
    html = F.concat(F.lit('<h1><span itemprop="name">'), text("subject"), F.lit('</span></h1><span class="sender"><a href="x"><span itemprop="name">'), text("sender"), F.lit('</span></a></span><!--X-Body-of-Message-->'), text("body"), F.lit("</div>footer"))
    return A.archive_documents(m.select("msg_num", html.alias("html")), "l").select("id", "title", "author", "body")


@_query("SELECT 'irc_log:' || source_id AS id, '#' || split_part(source_id, ':', 1) || ' IRC log ' || split_part(source_id, ':', 2) AS title, split_part(source_id, ':', 2) AS day FROM documents WHERE source_type = 'irc_log' AND trim(coalesce(body, ''), ' ') <> ''")
def src_chat(spark, sf):
    """Every log by channel, day and, where a day has several, the part behind the day."""
    d = _documents(spark, sf, "irc_log")
    name = F.split("source_id", ":", 3)
    logs = d.select(F.get(name, F.lit(0)).alias("channel"), F.get(name, F.lit(1)).alias("day"), F.get(name, F.lit(2)).alias("part"), "body")
    day = F.coalesce(F.date_format("created_at", "yyyy-MM-dd"), F.split_part("source_id", F.lit(":"), F.lit(2)))
    return A.chat_documents(logs).select("id", "title", day.alias("day"))


def _topics(spark: SparkSession, sf: str, topic: str, post: str) -> DataFrame:
    """(topic_id, title, body, posts): topics with the posts below them, in order of their keys."""
    d = _documents(spark, sf, topic, post)
    below = d.where(F.col("source_type") == post).groupBy(F.col("parent_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "source_id", F.coalesce("author", F.lit("x")).alias("author"), F.coalesce("body", F.lit("")).alias("body")))).alias("posts"))
    return d.where(F.col("source_type") == topic).select("doc_id", "id", "source_id", "title", F.coalesce("body", F.lit("")).alias("body")).join(below, "id", "left").withColumn("posts", F.coalesce("posts", F.array().cast(below.schema["posts"].dataType)))


_FORUM = "documents p JOIN documents t ON t.id = p.parent_id AND t.source_type = 'delving_topic' WHERE p.source_type = 'delving_post'"


@_query(f"SELECT id, NULL AS parent_id, coalesce(body, '') AS body FROM documents WHERE source_type = 'delving_topic' UNION ALL SELECT p.id, t.id, coalesce(p.body, '') FROM {_FORUM}")
def src_forum(spark, sf):
    return A.topic_documents(_forum(spark, sf)).select("id", "parent_id", "body")


def _forum(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("timestamp")
    post = lambda i, n, user, body, to: F.struct(i.cast("long").alias("id"), n.cast("int").alias("post_number"), user.alias("username"), body.alias("cooked"), none.alias("created_at"), none.alias("updated_at"), to.cast("int").alias("reply_to_post_number"))
    rest = F.transform("posts", lambda p, i: post(p["source_id"], i + 2, p["author"], p["body"], F.when(i > 0, i + 1).otherwise(1)))
    first = F.array(post(F.lit("0"), F.lit(1), F.lit("a"), F.col("body"), F.lit(None)))
    return _topics(spark, sf, "delving_topic", "delving_post").select(F.col("source_id").cast("long").alias("id"), "title", none.alias("created_at"), F.lit(2).alias("category_id"), F.array(F.struct(F.lit("x").alias("name"))).alias("tags"), F.concat(first, rest).alias("posts"))


@_query(f"SELECT p.id AS from_doc_id, coalesce(lag(p.id) OVER (PARTITION BY t.id ORDER BY p.doc_id), t.id) AS to_doc_id, 'replies_to' AS ref_type FROM {_FORUM}")
def src_replies(spark, sf):
    """Every post answers the one before it by number, the first one the topic."""
    return A.reply_edges(_forum(spark, sf)).select("from_doc_id", "to_doc_id", "ref_type")


def _boards(spark: SparkSession, sf: str) -> DataFrame:
    section = lambda msg, user, body: F.concat(F.lit('<a name="msg'), msg, F.lit('"></a><a href="x?action=profile;u=7">'), _escaped(user), F.lit('</a> January 26, 2019, 06:03:38 AM <div class="post">'), _escaped(body), F.lit("</div>"))
    posts = F.array_join(F.transform("posts", lambda p: section(p["source_id"], p["author"], p["body"])), "")
    head = F.concat(F.lit("<title>"), _escaped(F.coalesce("title", F.lit(""))), F.lit('</title><a href="?board=1.0">All</a><a href="x?board=6.0">Dev &amp; talk</a><a class="navPages" href="y">2</a><a class="navPages" href="y">11</a><a href="?topic=5.msg9#msg9">x</a><a href="?topic=4.msg8#msg8">x</a><a href="?topic=5.msg7#msg7">x</a>'))
    return _topics(spark, sf, "bitcointalk_topic", "bitcointalk_post").select(F.col("source_id").cast("long").alias("topic_id"), F.concat(head, section(F.lit("1"), F.lit("a"), F.col("body")), posts).alias("html"))


_BOARD = "documents p JOIN documents t ON t.id = p.parent_id AND t.source_type = 'bitcointalk_topic' WHERE p.source_type = 'bitcointalk_post'"


@_query(f"""SELECT * FROM (SELECT 'bitcointalk_topic::' || source_id AS id, NULL AS parent_id, trim({_read_back("coalesce(body, '')")}) AS body FROM documents WHERE source_type = 'bitcointalk_topic'
  UNION ALL SELECT 'bitcointalk_post::' || p.source_id, 'bitcointalk_topic::' || t.source_id, trim({_read_back("coalesce(p.body, '')")}) FROM {_BOARD}) WHERE body <> ''""")
def src_board(spark, sf):
    return A.board_documents(_boards(spark, sf), [6]).select("id", "parent_id", "body")


@_query(f"""SELECT cast(source_id AS BIGINT) AS topic_id, nullif(trim({_read_back("coalesce(title, '')")}), '') AS title, 6::BIGINT AS board, 'Dev & talk' AS board_name, 11::BIGINT AS pages, '5,4' AS recent FROM documents WHERE source_type = 'bitcointalk_topic'""")
def src_board_heads(spark, sf):
    h = F.col("html")
    return _boards(spark, sf).select("topic_id", X.page_title(h).alias("title"), X.board_id(h).alias("board"), X.board_name(h).alias("board_name"), X.page_count(h).alias("pages"), F.array_join(X.topic_ids(h).cast("array<string>"), ",").alias("recent"))


@_query("SELECT source_id, last_cursor, FALSE AS was_reset FROM sync_state UNION ALL SELECT 'gone:' || source_id, NULL, TRUE FROM sync_state")
def cursor_resets(spark, sf):
    """Cursors of all sources, each also under a name whose state is gone."""
    s = read_table(spark, sf, "sync_state", "source_id", "last_cursor")
    held = s.unionByName(s.select(F.concat(F.lit("gone:"), "source_id").alias("source_id"), "last_cursor"))
    return W.reset_cursors(held, s)


@_query("SELECT source_type, count(*) AS total, count(*) FILTER (EXISTS (SELECT 1 FROM refs r WHERE r.from_doc_id = d.id)) AS done, round(count(*) FILTER (EXISTS (SELECT 1 FROM refs r WHERE r.from_doc_id = d.id)) / count(*), 6) AS ratio FROM documents d GROUP BY 1")
def reenrich_progress(spark, sf):
    return W.progress(read_table(spark, sf, "documents", "id", "source_type"), read_table(spark, sf, "refs", "from_doc_id").select(F.col("from_doc_id").alias("id")))


@_query("""WITH m AS (SELECT DISTINCT list_name, msg_num, lead(msg_num) OVER (PARTITION BY list_name ORDER BY msg_num) AS nxt FROM (SELECT DISTINCT list_name, msg_num FROM parsed_message))
  SELECT list_name, count(*) FILTER (coalesce(nxt, msg_num + 9) - msg_num > 3) AS n_ends, count(*) AS n_numbers FROM m GROUP BY 1""")
def walk_ends(spark, sf):
    """Per list archive: the numbers at which a walk meets three missing ones in a row."""
    m = read_table(spark, sf, "parsed_message", "list_name", "msg_num").distinct()
    following = F.lead("msg_num").over(Window.partitionBy("list_name").orderBy("msg_num"))
    ends = F.coalesce(following, F.col("msg_num") + 9) - F.col("msg_num") > W.ARCHIVE_MISSES
    return m.withColumn("e", ends).groupBy("list_name").agg(F.count_if("e").alias("n_ends"), F.count("*").alias("n_numbers"))
