"""Mail, chat, forum, specification and newsletter texts to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.schema import parse_instant
from loomdex.sources.tracker import _select

# File names of specifications by kind; the number is the first group.
SPEC_FILES = {"bip": r"^bip-(\d{4})\.(?:mediawiki|md)$", "bolt": r"^(\d{2})-[\w-]+\.md$", "blip": r"^blip-(\d{4})\.md$", "lud": r"^(\d{2})\.md$", "nut": r"^(\d{2})\.md$"}
#: Empty days or pages after which a sequence counts as ended.
MAX_MISSES = 3


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, body): whole text files below ``path``."""
    rows = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("_p", F.input_file_name())
    return rows.select(F.element_at(F.split("_p", "/"), -1).alias("name"), F.col("value").alias("body"))


def spec_documents(files: DataFrame, kind: str, repo: str, fetched_at: str, url: str | None = None) -> DataFrame:
    """Specifications among (name, body) files, titled from their text; numbers lose their padding. ``url`` is a pattern with ``{name}``."""
    number = F.regexp_extract("name", SPEC_FILES[kind], 1)
    rows = files.where(number != "").withColumn("_n", number.cast("int"))
    address = F.replace(F.lit(url), F.lit("{name}"), F.col("name")) if url else F.lit(None).cast("string")
    out = rows.withColumns({
        "source_type": F.lit(kind), "source_repo": F.lit(repo), "source_id": F.col("_n").cast("string"), "title": X.spec_title(F.lit(kind), F.col("body"), F.col("_n")),
        "created_at": F.lit(fetched_at).cast("timestamp"), "metadata": F.to_json(F.struct(address.alias("url"))),
    })
    return _select(out.withColumn("id", F.concat_ws(":", "source_type", "source_repo", "source_id")))


def newsletter_documents(files: DataFrame, fetched_at: str) -> DataFrame:
    """Newsletters among (name, body) files: ``.md`` only, numbered from their title, else by slug."""
    slug = F.regexp_replace("name", r"\.md$", "")
    rows = files.where(F.col("name").endswith(".md")).withColumn("_title", F.coalesce(X.front_matter_title(F.col("body")), slug))
    out = rows.withColumns({"source_type": F.lit("optech_newsletter"), "source_id": F.coalesce(X.issue_number(F.col("_title")), slug), "title": F.col("_title"), "created_at": F.lit(fetched_at).cast("timestamp"), "metadata": F.to_json(F.struct(slug.alias("slug")))})
    return _select(out.withColumn("id", F.concat_ws(":", "source_type", "source_id")))


def mail_documents(mails: DataFrame, list_name: str) -> DataFrame:
    """(message_id, raw, in_reply_to) to list messages; mails without a readable date or subject stay, with nulls."""
    rows = mails.withColumn("h", X.mail_headers(F.col("raw")))
    parent = F.when(F.col("in_reply_to").isNotNull(), F.concat(F.lit("mailing_list_msg:"), "in_reply_to"))
    out = rows.withColumns({"source_type": F.lit("mailing_list_msg"), "source_id": F.col("message_id"), "title": F.col("h.subject"), "body": F.col("h.body"), "author": F.col("h.sender"), "created_at": F.col("h.date"), "parent_id": parent, "metadata": F.to_json(F.struct(F.lit(list_name).alias("list")))})
    return _select(out.withColumn("id", F.concat_ws(":", "source_type", "source_id")))


def chat_documents(logs: DataFrame) -> DataFrame:
    """(channel, day, body) daily logs: one document a day at midnight; blank days are none. With a column ``part``, further logs of a day go by its value
    behind the day. A log whose day is missing or no date stays, without instant."""
    rows = logs.where(F.coalesce(F.trim("body"), F.lit("")) != "")
    name = F.when(F.col("channel").isNotNull(), F.concat_ws(":", "channel", "day", *(["part"] if "part" in logs.columns else [])))
    out = rows.withColumns({"source_type": F.lit("irc_log"), "source_id": name, "title": F.concat(F.lit("#"), "channel", F.lit(" IRC log "), F.coalesce("day", F.lit(""))), "created_at": parse_instant(F.col("day"))})
    return _select(out.withColumn("id", F.concat(F.col("source_type"), F.lit(":"), F.col("source_id"))))


def log_days(first: Column, today: Column) -> Column:
    """Array of the days to fetch: from ``first`` up to yesterday."""
    return F.when(first < today, F.sequence(first, F.date_sub(today, 1)))


def topic_documents(topics: DataFrame) -> DataFrame:
    """(id, title, created_at, category_id, tags, posts[array of id, post_number, username, cooked, created_at, updated_at]): the first post becomes the topic, others posts below it."""
    posts = topics.select(F.col("id").alias("topic"), F.col("title").alias("t"), F.col("category_id"), "tags", F.posexplode("posts").alias("pos", "p"))
    first = F.col("pos") == 0
    topic_id = F.concat(F.lit("delving_topic:"), F.col("topic").cast("string"))
    meta = F.to_json(F.struct(F.col("category_id").alias("category"), F.transform("tags", lambda x: x["name"]).alias("tags")))
    out = posts.select(
        F.when(first, topic_id).otherwise(F.concat(F.lit("delving_post:"), F.col("p.id").cast("string"))).alias("id"), F.when(first, "delving_topic").otherwise("delving_post").alias("source_type"),
        F.when(first, F.col("topic")).otherwise(F.col("p.id")).cast("string").alias("source_id"), F.col("t").alias("title"), F.col("p.cooked").alias("body"), F.col("p.username").alias("author"),
        F.col("p.created_at").alias("created_at"), F.col("p.updated_at").alias("updated_at"), F.when(~first, topic_id).alias("parent_id"), F.when(first, meta).alias("metadata"),
    )
    return _select(out)


def reply_edges(topics: DataFrame) -> DataFrame:
    """(from_doc_id, to_doc_id, ref_type): posts that answer a post of their topic by number; number 1 is the topic itself; unknown numbers are dropped."""
    posts = topics.select(F.col("id").alias("topic"), F.posexplode("posts").alias("pos", "p")).select("topic", "pos", F.col("p.post_number").alias("n"), F.col("p.id").alias("post"), F.col("p.reply_to_post_number").alias("to"))
    name = lambda pos: F.when(F.col(pos) == 0, F.concat(F.lit("delving_topic:"), F.col("topic").cast("string"))).otherwise(F.concat(F.lit("delving_post:"), F.col("post").cast("string")))
    target = posts.select("topic", F.col("n").alias("to"), name("pos").alias("to_doc_id"))
    return posts.where("to is not null").withColumn("from_doc_id", name("pos")).join(target, ["topic", "to"]).select("from_doc_id", "to_doc_id", F.lit("replies_to").alias("ref_type"))


def board_documents(pages: DataFrame, boards: list[int] | None = None) -> DataFrame:
    """(topic_id, html) pages of a board forum: the first post is the topic; pages of other boards than ``boards`` are left out."""
    rows = pages.withColumns({"_b": X.board_id(F.col("html")), "_t": X.page_title(F.col("html"))})
    if boards is not None:
        rows = rows.where(F.col("_b").isin(*boards))
    posts = rows.select("topic_id", "_t", "_b", F.posexplode(X.forum_posts(F.col("html"))).alias("pos", "p"))
    first = F.col("pos") == 0
    topic = F.concat(F.lit("bitcointalk_topic::"), F.col("topic_id").cast("string"))
    out = posts.select(
        F.when(first, topic).otherwise(F.concat(F.lit("bitcointalk_post::"), F.col("p.msg").cast("string"))).alias("id"), F.when(first, "bitcointalk_topic").otherwise("bitcointalk_post").alias("source_type"),
        F.when(first, F.col("topic_id")).otherwise(F.col("p.msg")).cast("string").alias("source_id"), F.col("_t").alias("title"), F.col("p.body").alias("body"), F.col("p.author").alias("author"), F.col("p.author_id").alias("author_id"),
        F.col("p.date").alias("created_at"), F.when(~first, topic).alias("parent_id"), F.to_json(F.struct(F.col("_b").alias("board"))).alias("metadata"),
    )
    return _select(out)


def archive_documents(pages: DataFrame, list_name: str) -> DataFrame:
    """(msg_num, html) pages of a list archive to messages numbered by page."""
    rows = pages.withColumn("h", X.archive_page(F.col("html")))
    out = rows.withColumns({"source_type": F.lit("mailing_list_msg"), "source_id": F.concat(F.lit(f"{list_name}/msg"), F.when(F.col("msg_num") < 100_000, F.lpad(F.col("msg_num").cast("string"), 5, "0")).otherwise(F.col("msg_num").cast("string"))), "title": F.col("h.subject"), "body": F.col("h.body"), "author": F.col("h.sender"), "created_at": F.col("h.date"), "seq": F.col("msg_num")})
    return _select(out.withColumn("id", F.concat_ws(":", "source_type", "source_id")))


def ended(found: Column) -> Column:
    """Whether an array of booleans (pages found, in order) ends in ``MAX_MISSES`` misses."""
    return (F.size(found) >= MAX_MISSES) & ~F.exists(F.slice(F.reverse(found), 1, MAX_MISSES), lambda x: x)
