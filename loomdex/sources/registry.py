"""Registry of sources: which jobs exist, how often they run and which reset patterns belong to a source type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Seconds between polls by kind of source.
INTERVALS = {"issues": 3600, "comments": 3600, "commits": 3600, "list": 1800, "archive": 1800, "irc": 3600, "forum": 3600, "specs": 3600, "newsletters": 3600}
_TYPE = {"issues": "github_issue", "comments": "github_comment", "commits": "commit", "list": "mailing_list_msg", "archive": "mailing_list_msg", "irc": "irc_log", "forum": "delving_topic", "newsletters": "optech_newsletter"}


def jobs(spark: SparkSession, repos: list[str], channels: list[str] = (), lists: list[str] = (), archives: list[str] = (), forums: list[str] = (), specs: dict[str, str] | None = None, newsletters: bool = False) -> DataFrame:
    """(source_id, source_type, source_repo, base_interval_s, priority): three jobs for each repository, one for each other source."""
    rows = [(f"{k}:{r}", _TYPE[k], r, INTERVALS[k], 0) for r in repos for k in ("issues", "comments", "commits")]
    for kind, names in (("irc", channels), ("list", lists), ("archive", archives), ("forum", forums)):
        rows += [(f"{kind}:{n}", _TYPE[kind], None, INTERVALS[kind], 0) for n in names]
    rows += [(f"specs:{k}", k, r, INTERVALS["specs"], 1) for k, r in (specs or {}).items()]
    if newsletters:
        rows.append(("newsletters", "optech_newsletter", None, INTERVALS["newsletters"], 0))
    return spark.createDataFrame(rows, "source_id string, source_type string, source_repo string, base_interval_s int, priority int")


def reset_patterns(source_type: str) -> tuple[str, ...]:
    """LIKE patterns of the sync states that belong to a source type."""
    if source_type in ("github_issue", "github_pr"):
        return ("issues:%",)
    by_type = {"github_comment": ("comments:%",), "commit": ("commits:%",), "mailing_list_msg": ("list:%", "archive:%"), "irc_log": ("irc:%",), "delving_topic": ("forum:%",), "delving_post": ("forum:%",), "bitcointalk_topic": ("forum:%",), "bitcointalk_post": ("forum:%",), "optech_newsletter": ("newsletters",)}
    return by_type.get(source_type, (f"specs:{source_type}",))
