"""Tracker API rows (issues, pull requests, comments) to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.schema import DOCUMENTS, make_id

ISSUE = "number long, title string, body string, state string, user struct<login: string, id: long>, labels array<struct<name: string>>, created_at timestamp, updated_at timestamp, pull_request string"
COMMENT = "id long, body string, user struct<login: string, id: long>, created_at timestamp, updated_at timestamp, issue_url string"


def _select(df: DataFrame) -> DataFrame:
    """The document columns in order, missing ones null."""
    wanted = [c.strip().split(" ") for c in DOCUMENTS.split(",")]
    return df.select(*[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in wanted])


def _column(repo: str | Column) -> Column:
    """A repository for all rows, or a column of them."""
    return F.lit(repo) if isinstance(repo, str) else repo


def issue_documents(rows: DataFrame, repo: str | Column) -> DataFrame:
    """Issues and pull requests (rows with ``pull_request``); metadata holds state, labels and is_pr."""
    is_pr = F.col("pull_request").isNotNull()
    kind = F.when(is_pr, "github_pr").otherwise("github_issue")
    meta = F.to_json(F.struct("state", F.transform(F.coalesce("labels", F.array().cast("array<struct<name: string>>")), lambda x: x["name"]).alias("labels"), is_pr.alias("is_pr")))
    out = rows.withColumns({"source_type": kind, "source_repo": _column(repo), "source_id": F.col("number").cast("string"), "author": F.col("user.login"), "author_id": F.col("user.id").cast("string"), "metadata": meta})
    return _select(out.withColumn("id", make_id(F.col("source_type"), F.col("source_repo"), F.col("source_id"))))


def comment_documents(rows: DataFrame, repo: str | Column) -> DataFrame:
    """Comments; the parent is the issue named by the last part of ``issue_url`` if that is a number."""
    number = F.element_at(F.split("issue_url", "/"), -1)
    parent = F.when(number.rlike(r"^\d+$"), F.concat(F.lit("github_issue:"), _column(repo), F.lit(":"), number))
    out = rows.withColumns({"source_id": F.col("id").cast("string"), "source_type": F.lit("github_comment"), "source_repo": _column(repo), "author": F.col("user.login"), "author_id": F.col("user.id").cast("string"), "parent_id": parent})
    return _select(out.withColumn("id", make_id(F.col("source_type"), F.col("source_repo"), F.col("source_id"))))


def next_cursor(rows: DataFrame, page_size: int = 100) -> str | None:
    """Cursor after a page: the last update time if the page is full, else none."""
    n, last = rows.agg(F.count("*"), F.max(F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ssXXX"))).first()
    return last if n >= page_size else None
