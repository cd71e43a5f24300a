"""The data model: table schemas, enumerations and derived columns (ids, URLs, instants)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of source and reference types.
SOURCE_TYPES = (
    "github_issue", "github_pr", "github_comment", "github_review", "github_review_comment", "github_discussion", "github_discussion_comment", "commit",
    "mailing_list_msg", "irc_log", "delving_topic", "delving_post", "bip", "bolt", "blip", "lud", "nut", "optech_newsletter", "optech_topic", "optech_blog",
    "bitcointalk_topic", "bitcointalk_post",
)
REF_TYPES = ("mentions_issue", "mentions_pr", "fixes", "references_commit", "references_bip", "references_bolt", "references_blip", "references_lud", "references_nut", "replies_to")
SPEC_TYPES = {"bip": "BIP", "bolt": "BOLT", "blip": "bLIP", "lud": "LUD", "nut": "NUT"}
SYNC_STATUSES = ("pending", "running", "ok", "error")

DOCUMENTS = "id string, source_type string, source_repo string, source_id string, title string, body string, author string, author_id string, created_at timestamp, updated_at timestamp, parent_id string, metadata string, seq long"
REFS = "id long, from_doc_id string, to_doc_id string, ref_type string, to_external string, context string"
CONCEPTS = "slug string, name string, category string, aliases array<string>"
CONCEPT_MENTIONS = "doc_id string, concept_slug string, confidence float"
CHANGE_LOG = "seq long, doc_id string, change_type string, changed_at timestamp"
SYNC_STATE = "source_id string, source_type string, source_repo string, last_cursor string, last_synced_at timestamp, next_run_at timestamp, status string, error_message string, retry_count int, items_found int"

_RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$"
_DAY = r"^\d{4}-\d{2}-\d{2}$"


def make_id(source_type: Column, source_repo: Column, source_id: Column) -> Column:
    """``type:repo:source_id``, without the repository part where there is none."""
    return F.concat_ws(":", source_type, source_repo, source_id)


def parse_instant(text: Column) -> Column:
    """RFC 3339 first, then a plain date at midnight UTC, else null."""
    return F.when(text.rlike(_RFC3339), F.try_to_timestamp(F.upper(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))).when(text.rlike(_DAY), F.try_to_timestamp(F.concat(text, F.lit("T00:00:00Z"))))


def known_source_type(c: Column) -> Column:
    """Unknown stored types read as the first one."""
    return F.when(c.isin(*SOURCE_TYPES), c).otherwise(SOURCE_TYPES[0])


def known_ref_type(c: Column) -> Column:
    return F.when(c.isin(*REF_TYPES), c).otherwise(REF_TYPES[0])


def document_url(source_type: Column, source_repo: Column, source_id: Column, parent_id: Column, metadata: Column) -> Column:
    """Address of a document, derived when asked for; null where a source type has none or a needed part is missing."""
    # Forms of the addresses.
    repo = F.concat(F.lit("https://github.com/"), source_repo)
    number = F.element_at(F.split(parent_id, ":"), -1)
    parts = F.split(F.get_json_object(metadata, "$.slug"), "-", 4)
    day = F.when(F.size(parts) >= 3, F.concat_ws("/", F.lit("https://bitcoinops.org/en/newsletters"), F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.lit("")))
    topic = F.regexp_replace(parent_id, "^bitcointalk_topic::", "")
    return (
        F.when(source_type == "github_issue", F.concat(repo, F.lit("/issues/"), source_id))
        .when(source_type == "github_pr", F.concat(repo, F.lit("/pull/"), source_id))
        .when(source_type == "commit", F.concat(repo, F.lit("/commit/"), source_id))
        .when((source_type == "github_comment") & number.rlike(r"^[0-9]*$"), F.concat(repo, F.lit("/issues/"), number, F.lit("#issuecomment-"), source_id))
        .when(source_type.isin(*SPEC_TYPES), F.get_json_object(metadata, "$.url"))
        .when(source_type == "delving_topic", F.concat(F.lit("https://delvingbitcoin.org/t/"), source_id))
        .when(source_type == "delving_post", F.concat(F.lit("https://delvingbitcoin.org/p/"), source_id))
        .when(source_type == "optech_newsletter", day)
        .when(source_type == "optech_topic", F.concat(F.lit("https://bitcoinops.org/en/topics/"), source_id, F.lit("/")))
        .when(source_type == "bitcointalk_topic", F.concat(F.lit("https://bitcointalk.org/index.php?topic="), source_id, F.lit(".0")))
        .when(source_type == "bitcointalk_post", F.concat(F.lit("https://bitcointalk.org/index.php?topic="), topic, F.lit(".msg"), source_id, F.lit("#msg"), source_id))
    )
