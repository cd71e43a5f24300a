"""Cursors of the paged sources: which rows a page has and where the next one starts.

Every walk is a function of what there is (a DataFrame), the cursor, and today's date: it gives the rows of one page and the next cursor, None where the source is
caught up. One small aggregate a page decides; the rows stay distributed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# First month and day of the walks, rows of a page, misses that end a walk or turn it to the tail.
FIRST_MONTH, FIRST_DAY = "2011-06", "2015-06-01"
FEED_SIZE, SPEC_PAGE, ARCHIVE_PAGE, ARCHIVE_MISSES, TOPIC_MISSES = 10, 10, 25, 3, 50
Page = tuple[DataFrame, str | None]


def month_cursor(month: str, offset: int = 0) -> str:
    return f"{month}:{offset}" if offset else month


def topic_cursor(mode: str, position: int, misses: int = 0) -> str:
    return f"tail:{position}" if mode == "tail" else f"topic:{position}|misses:{misses}"


def _next_month(month: str) -> str:
    year, number = map(int, month.split("-"))
    return f"{year + number // 12}-{number % 12 + 1:02d}"


def month_page(entries: DataFrame, cursor: str | None, today: date, size: int = FEED_SIZE) -> Page:
    """``entries``: month (YYYY-MM), pos (from 0, within the month). A full page goes on within its month; a short one goes on with the next month, up to the present one."""
    month, _, offset = (cursor or FIRST_MONTH).partition(":")
    at = int(offset or 0)
    rows = entries.where((F.col("month") == month) & (F.col("pos") >= at) & (F.col("pos") < at + size))
    n = rows.count()
    if n >= size:
        return rows, month_cursor(month, at + n)
    return rows, _next_month(month) if month < today.strftime("%Y-%m") else None


def day_page(logs: DataFrame, cursor: str | None, today: date) -> Page:
    """``logs``: day (YYYY-MM-DD), body. One day a page; missing and blank days advance, today is not finished yet."""
    day = date.fromisoformat(cursor or FIRST_DAY)
    if day >= today:
        return logs.where(F.lit(False)), None
    rows = logs.where((F.col("day") == day.isoformat()) & (F.coalesce(F.trim("body"), F.lit("")) != ""))
    return rows, (day + timedelta(days=1)).isoformat()


def number_page(pages: DataFrame, cursor: str | None, size: int = ARCHIVE_PAGE, misses: int = ARCHIVE_MISSES) -> Page:
    """``pages``: num. The numbers behind the cursor, up to ``size`` or the first ``misses`` missing ones in a row; the cursor is the last number found."""
    last = int(cursor or 0)
    near = pages.where((F.col("num") > last) & (F.col("num") <= last + size + misses)).select("num").distinct()
    got, at, gone = {r[0] for r in near.collect()}, last, 0  # at most size + misses numbers
    for n in range(last + 1, last + size + 1):
        gone = 0 if n in got else gone + 1
        at = n if n in got else at
        if gone == misses:
            break
    rows = pages.where((F.col("num") > last) & (F.col("num") <= at))
    return rows, str(at) if at > last and gone < misses else None


def index_page(files: DataFrame, cursor: str | None, size: int = SPEC_PAGE) -> Page:
    """``files``: pos (place in the sorted list, from 0). The cursor is the place of the next file."""
    at = int(cursor or 0)
    rows = files.where((F.col("pos") >= at) & (F.col("pos") < at + size))
    return rows, str(at + size) if files.where(F.col("pos") >= at + size).limit(1).count() else None


def topic_page(topics: DataFrame, cursor: str | None, recent: list[int], max_misses: int = TOPIC_MISSES) -> Page:
    """``topics``: topic_id. Walks the numbers one by one and counts misses; after ``max_misses`` in a row it turns to the tail: topics
    newer than the last one, and the ``recent`` ones polled again. A tail never ends, so its cursor is given again."""
    mode = "tail" if (cursor or "").startswith("tail:") else "topic"
    found = re.match(r"^(?:topic|tail):(\d+)(?:\|misses:(\d+))?$", cursor or "")
    at, gone = (int(found.group(1)), int(found.group(2) or 0)) if found else (1, 0)
    if mode == "tail":
        newest = max([at, *recent])
        return topics.where((F.col("topic_id") > at) | F.col("topic_id").isin(recent)).where(F.col("topic_id") <= newest), topic_cursor("tail", newest)
    rows = topics.where(F.col("topic_id") == at)
    gone = 0 if rows.limit(1).count() else gone + 1
    if gone >= max_misses:
        return rows, topic_cursor("tail", at - gone)
    return rows, topic_cursor("topic", at + 1, gone)


def after_page(cursor: str | None, following: str | None, pages_read: int, every: int = 10) -> tuple[str | None, bool, bool]:
    """(cursor to keep, run again at once, write it down now): with a next cursor the source runs on, written down every ``every`` pages; without one the present
    cursor is kept and the source sleeps."""
    return (following, True, pages_read % every == 0) if following is not None else (cursor, False, True)


def reset_cursors(cursors: DataFrame, states: DataFrame) -> DataFrame:
    """``cursors`` (source_id, last_cursor) held by a running job, cleared where the stored state of the source is gone: it was reset."""
    known = states.select("source_id", F.lit(True).alias("_k")).distinct()
    return cursors.join(known, "source_id", "left").select("source_id", F.when(F.col("_k"), F.col("last_cursor")).alias("last_cursor"), F.col("_k").isNull().alias("was_reset"))


def progress(todo: DataFrame, done: DataFrame) -> DataFrame:
    """(source_type, total, done, ratio) of a re-enrichment: documents to be read and those read so far."""
    seen = done.select("id", F.lit(1).alias("_d")).distinct()
    rows = todo.join(seen, "id", "left").groupBy("source_type").agg(F.count("*").alias("total"), F.count("_d").alias("done"))
    return rows.withColumn("ratio", F.round(F.try_divide("done", "total"), 6))


def run_source(walk: Callable[[str | None], Page], ingest: Callable[[DataFrame, int, str | None], None], cursor: str | None = None, limit_pages: int = 1, wait: Callable[[], float] = lambda: 0.0) -> str | None:
    """Reads up to ``limit_pages`` pages of one source: ``walk(cursor)`` gives a page, ``ingest(rows, number, next cursor)`` stores it. ``wait`` gives the seconds to wait
    before a request (``metrics.may_request``). Returns the cursor to go on with."""
    import time

    for number in range(limit_pages):
        time.sleep(wait())
        rows, following = walk(cursor)
        kept, again, _ = after_page(cursor, following, number + 1)
        ingest(rows, number, kept)
        cursor = kept
        if not again:
            break
    return cursor
