"""Registered queries of the knowledge-base operators, and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomdex.functions import text as X
from loomdex.operators import context as C
from loomdex.operators import metrics as M
from loomdex.operators import mutations as U
from loomdex.operators.enrich import VOCABULARY, extract_references, resolve_references, tag_concepts, vocabulary
from loomdex.operators.search import SearchParams, build_index, read_index, search, write_index
from loomdex.operators.timestamps import normalise
from loomdex.schema import CHANGE_LOG, DOCUMENTS, REFS, document_url, make_id, parse_instant
from loomdex.session import checkpoint_dir, read_table, spread
from loomdex.streaming.ingest import EpochStore, ingest_batch, minute_counts_stream

_DOCS = ("id", "source_type", "source_repo", "source_id", "title", "body", "author", "author_id", "created_at", "updated_at", "parent_id", "metadata", "seq")
QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def docs(spark: SparkSession, sf: str, *columns: str) -> DataFrame:
    """The documents table in the data model; ``created_at`` is an instant, null where the text is neither RFC 3339 nor a day."""
    df = read_table(spark, sf, "documents", *(columns or _DOCS))
    df = df.withColumn("created_at", parse_instant(F.col("created_at"))) if "created_at" in df.columns else df
    return spread(df) if "body" in df.columns else df


_TIME = r"""CASE WHEN regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$') THEN try_cast(regexp_replace(created_at, '(\.\d{6})\d+', '\1') AS TIMESTAMPTZ)
  WHEN regexp_matches(created_at, '^\d{4}-\d{2}-\d{2}$') THEN try_cast(created_at || 'T00:00:00Z' AS TIMESTAMPTZ) END"""
_URL = """CASE WHEN source_type = 'github_issue' THEN 'https://github.com/' || source_repo || '/issues/' || source_id
  WHEN source_type = 'github_pr' THEN 'https://github.com/' || source_repo || '/pull/' || source_id
  WHEN source_type = 'commit' THEN 'https://github.com/' || source_repo || '/commit/' || source_id
  WHEN source_type = 'github_comment' AND regexp_matches(regexp_extract(parent_id, '([^:]*)$', 1), '^[0-9]*$') THEN 'https://github.com/' || source_repo || '/issues/' || regexp_extract(parent_id, '([^:]*)$', 1) || '#issuecomment-' || source_id
  WHEN source_type = 'delving_topic' THEN 'https://delvingbitcoin.org/t/' || source_id WHEN source_type = 'delving_post' THEN 'https://delvingbitcoin.org/p/' || source_id
  WHEN source_type = 'optech_newsletter' AND regexp_matches(metadata->>'slug', '^[^-]*-[^-]*-[^-]*') THEN 'https://bitcoinops.org/en/newsletters/' || split_part(metadata->>'slug', '-', 1) || '/' || split_part(metadata->>'slug', '-', 2) || '/' || split_part(metadata->>'slug', '-', 3) || '/'
  WHEN source_type = 'bitcointalk_topic' THEN 'https://bitcointalk.org/index.php?topic=' || source_id || '.0'
  WHEN source_type = 'bitcointalk_post' THEN 'https://bitcointalk.org/index.php?topic=' || replace(parent_id, 'bitcointalk_topic::', '') || '.msg' || source_id || '#msg' || source_id END"""
_TOK = r"regexp_extract_all(lower(strip_accents(coalesce({}, ''))), '[\p{{L}}\p{{N}}]+')"


def _search_sql(phrases: list[str], match: str, contributes: list[str] | None = None, where: str = "true", limit: int = 20) -> str:
    """Brute-force BM25: ``phrases`` of folded words, a final ``*`` for a prefix; ``match`` over p0, p1 ... (booleans)."""
    parts = [f"WITH d AS (SELECT *, {_TOK.format('title')} AS tt, {_TOK.format('body')} AS bt FROM documents)",
             "tok AS (SELECT id, 'title' AS col, unnest(tt) AS t, generate_subscripts(tt, 1) AS pos FROM d UNION ALL SELECT id, 'body', unnest(bt), generate_subscripts(bt, 1) FROM d)",
             "corpus AS (SELECT count(*) AS n, avg(len(tt) + len(bt)) AS av FROM d)"]
    for i, phrase in enumerate(phrases):
        words = phrase.lstrip("^").rstrip("*").split()
        conds = [f"a{j}.t = '{w}'" for j, w in enumerate(words)] + (["a0.pos = 1"] if phrase.startswith("^") else [])
        if phrase.endswith("*"):
            conds[len(words) - 1] = f"starts_with(a{len(words) - 1}.t, '{words[-1]}')"
        joins = "".join(f" JOIN tok a{j} ON a{j}.id = a0.id AND a{j}.col = a0.col AND a{j}.pos = a0.pos + {j}" for j in range(1, len(words)))
        parts.append(f"q{i} AS (SELECT a0.id, sum(CASE WHEN a0.col = 'title' THEN 5.0 ELSE 1.0 END) AS tf FROM tok a0{joins} WHERE {' AND '.join(conds)} GROUP BY a0.id)")
        parts.append(f"i{i} AS (SELECT CASE WHEN ln((n - c + 0.5) / (c + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - c + 0.5) / (c + 0.5)) END AS idf FROM corpus, (SELECT count(*) AS c FROM q{i}))")
    terms = " + ".join(f"CASE WHEN {(contributes or [f'p{i}' for i in range(len(phrases))])[i]} THEN (SELECT idf FROM i{i}) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / (SELECT av FROM corpus))) ELSE 0 END" for i in range(len(phrases)))
    flags = ", ".join(f"q{i}.id IS NOT NULL AS p{i}, coalesce(q{i}.tf, 0) AS tf{i}" for i in range(len(phrases)))
    joins = "".join(f" LEFT JOIN q{i} ON q{i}.id = d.id" for i in range(len(phrases)))
    parts.append(f"m AS (SELECT d.*, len(tt) + len(bt) AS dl, {flags} FROM d{joins})")
    return ", ".join(parts) + f" SELECT id, source_type, title, {_URL} AS url, round({terms}, 6) AS score FROM m WHERE ({match}) AND ({where}) ORDER BY {terms} DESC, id LIMIT {limit}"


def indexed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The persisted index of a data directory: below the shared folder, built once in a session."""
    path = f"{checkpoint_dir(spark)}/index-{spark.sparkContext.applicationId}-{hashlib.md5(sf.encode()).hexdigest()[:12]}"
    if path not in _BUILT:
        write_index(docs(spark, sf, "id", "title", "body"), path)
        _BUILT.add(path)
    return read_index(spark, path)


_BUILT: set[str] = set()


def _found(spark: SparkSession, sf: str, **params) -> DataFrame:
    rows = search(docs(spark, sf), SearchParams(**params), index=indexed(spark, sf), snippets=False)
    return rows.select("id", "source_type", "title", "url", F.round("score", 6).alias("score"))


@_query(_search_sql(["mempo*"], "p0"))
def search_single_prefix(spark, sf):
    return _found(spark, sf, query="mempo")


@_query(_search_sql(["covenant", "relay"], "p0 AND p1"))
def search_and(spark, sf):
    return _found(spark, sf, query="covenant relay")


@_query(_search_sql(["vault", "timelock", "orphaned"], "p0 OR (p1 AND p2)", ["p0", "p1 AND p2", "p1 AND p2"]))
def search_or(spark, sf):
    return _found(spark, sf, query="vault OR timelock orphaned")


@_query(_search_sql(["coinbase", "miner"], "p0 AND NOT p1", ["p0", "false"]))
def search_not(spark, sf):
    return _found(spark, sf, query="coinbase NOT miner")


@_query(_search_sql(["bip 412"], "p0"))
def search_phrase(spark, sf):
    return _found(spark, sf, query="BIP-412")


_NEAR = "m.id IN (SELECT a.id FROM tok a JOIN tok b ON a.id = b.id AND a.col = b.col AND a.t = 'fee' AND b.t = 'mempool' AND abs(a.pos - b.pos) <= 6)"


@_query(_search_sql(["fee", "mempool"], _NEAR, [_NEAR, _NEAR]))
def search_near(spark, sf):
    return _found(spark, sf, query="NEAR(fee mempool, 5)")


@_query(_search_sql(["^the*"], "p0", limit=50))
def search_first(spark, sf):
    return _found(spark, sf, query="^the*", limit=50)


@_query(_search_sql(["block*"], "p0", where="author = (SELECT author FROM documents WHERE author IS NOT NULL GROUP BY author ORDER BY count(*) DESC, author LIMIT 1)", limit=100))
def search_author(spark, sf):
    """Documents of the most frequent author, as written."""
    author = read_table(spark, sf, "documents", "author").where("author is not null").groupBy("author").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "author").first()[0]
    return _found(spark, sf, query="block", author=author, limit=100)


@_query("SELECT count(*) AS n, min(total) AS total_count FROM (SELECT *, count(*) OVER () AS total FROM (" + _search_sql(["covenant", "relay"], "p0 OR p1", limit=100) + "))")
def search_total(spark, sf):
    rows = search(docs(spark, sf), SearchParams(query="covenant OR relay", limit=100), index=indexed(spark, sf), snippets=False)
    return rows.agg(F.count("*").alias("n"), F.min("total_count").alias("total_count"))


@_query(_search_sql(["proposal", "mempool"], "p0 AND p1"))
def search_title_weight(spark, sf):
    return _found(spark, sf, query="proposal mempool")


@_query(_search_sql(["wallet*"], "p0", where=f"source_type IN ('github_issue', 'github_pr') AND source_repo = 'emberd/emberd' AND ({_TIME}) >= TIMESTAMPTZ '2015-01-01 00:00:00+00' AND ({_TIME}) <= TIMESTAMPTZ '2024-06-30 00:00:00+00'", limit=50))
def search_filtered(spark, sf):
    return _found(spark, sf, query="wallet", source_type=["github_issue", "github_pr", "no_such_type"], source_repo=["emberd/emberd"], after="2015-01-01", before="2024-06-30", limit=50)


@_query(f"SELECT id, source_type, title, {_URL} AS url, 0.0::DOUBLE AS score FROM (SELECT *, {_TIME} AS made_at FROM documents) WHERE source_type = 'github_pr' ORDER BY made_at DESC NULLS LAST, id LIMIT 100")
def search_wildcard(spark, sf):
    return _found(spark, sf, query="*", source_type=["github_pr"], limit=500)


@_query()
def search_snippet(spark, sf):
    rows = search(docs(spark, sf), SearchParams(query="mempool AND bip-412", limit=100), read_table(spark, sf, "concept_mention"), indexed(spark, sf))
    return rows.select("id", "snippet", F.array_join("concepts", ",").alias("concepts"), F.round("score", 6).alias("score"))


@_query(rf"SELECT t AS term, count(*) AS n FROM (SELECT unnest({_TOK.format('title')}) AS t FROM documents) GROUP BY t")
def fold_terms(spark, sf):
    return docs(spark, sf, "title").select(F.explode(X.tokens(F.col("title"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))


@_query(rf"SELECT t AS term, count(DISTINCT id) AS df FROM (SELECT id, unnest({_TOK.format('title')} || {_TOK.format('body')}) AS t FROM documents) GROUP BY t")
def doc_freq(spark, sf):
    words = F.array_distinct(F.concat(X.tokens(F.col("title")), X.tokens(F.col("body"))))
    return docs(spark, sf, "id", "title", "body").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


@_query(rf"""WITH t AS (SELECT id, 'title' AS col, unnest({_TOK.format('title')}) AS term FROM documents UNION ALL SELECT id, 'body', unnest({_TOK.format('body')}) FROM documents)
  SELECT col, count(*) AS n_postings, cast(sum(tf) AS BIGINT) AS n_positions, count(DISTINCT term) AS n_terms FROM (SELECT term, id, col, count(*) AS tf FROM t GROUP BY ALL) GROUP BY col""")
def index_sizes(spark, sf):
    postings, _ = build_index(docs(spark, sf, "id", "title", "body"))
    return postings.groupBy("col").agg(F.count("*").alias("n_postings"), F.sum(F.size("positions")).alias("n_positions"), F.count_distinct("term").alias("n_terms"))


@_query(f"""WITH o AS (SELECT from_doc_id AS id, count(*) AS n_out FROM refs GROUP BY 1), i AS (SELECT to_doc_id AS id, count(*) AS n_in FROM refs WHERE to_doc_id IS NOT NULL GROUP BY 1),
  c AS (SELECT doc_id AS id, string_agg(DISTINCT concept_slug, ',' ORDER BY concept_slug) AS concepts FROM concept_mention GROUP BY 1)
  SELECT d.id, {_URL.replace('source_id', 'd.source_id')} AS url, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in, coalesce(concepts, '') AS concepts FROM documents d LEFT JOIN o ON o.id = d.id LEFT JOIN i ON i.id = d.id LEFT JOIN c ON c.id = d.id""")
def document_context(spark, sf):
    rows = C.document_context(docs(spark, sf), read_table(spark, sf, "refs"), read_table(spark, sf, "concept_mention"))
    return rows.select("id", "url", "n_out", "n_in", F.array_join("concepts", ",").alias("concepts"))


@_query("SELECT from_doc_id AS id, 'outgoing' AS side, id AS ref_id FROM refs UNION ALL SELECT to_doc_id, 'incoming', id FROM refs WHERE to_doc_id IS NOT NULL")
def document_edges(spark, sf):
    return C.document_edges(read_table(spark, sf, "refs")).select("id", "side", "ref_id")


@_query("SELECT id, from_doc_id, ref_type, context FROM refs WHERE to_external = 'BIP-412' ORDER BY id LIMIT 50")
def references_by_entity(spark, sf):
    return C.references_to(read_table(spark, sf, "refs"), "BIP-412").select("id", "from_doc_id", "ref_type", "context")


_SPECS = (("bip", 412), ("bolt", 4), ("lud", 4), ("nut", 0), ("blip", 2))


@_query(" UNION ALL ".join(f"""SELECT id, title, (SELECT count(*) FROM refs r WHERE r.from_doc_id = s.id) AS n_out, (SELECT count(*) FROM refs r WHERE r.to_doc_id = s.id OR r.to_external = '{ {"bip": "BIP", "bolt": "BOLT", "blip": "bLIP", "lud": "LUD", "nut": "NUT"}[t]}-{n}') AS n_in
  FROM (SELECT * FROM specs WHERE source_type = '{t}' AND source_id IN ('{n}', '{n:02d}') ORDER BY id LIMIT 1) s""" for t, n in _SPECS))
def spec_lookup(spark, sf):
    return C.lookup_specs(read_table(spark, sf, "specs"), read_table(spark, sf, "refs"), read_table(spark, sf, "concept_mention"), list(_SPECS)).select("id", "title", "n_out", "n_in")


_TIMELINE = f"SELECT strftime(made_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS date, source_type AS type, title, id, {_URL} AS url FROM (SELECT *, {_TIME} AS made_at FROM documents WHERE id IN (SELECT doc_id FROM concept_mention WHERE concept_slug = '@slug')) WHERE made_at IS NOT NULL AND @bounds ORDER BY made_at, id LIMIT 200"


@_query(_TIMELINE.replace("@slug", "channels").replace("@bounds", "true"))
def timeline(spark, sf):
    return C.timeline(docs(spark, sf), read_table(spark, sf, "concept_mention"), "channels").drop("created_at")


@_query(_TIMELINE.replace("@slug", "signing").replace("@bounds", "made_at >= TIMESTAMPTZ '2018-01-01 00:00:00+00' AND made_at <= TIMESTAMPTZ '2021-12-31 00:00:00+00'"))
def timeline_bounded(spark, sf):
    return C.timeline(docs(spark, sf), read_table(spark, sf, "concept_mention"), "signing", "2018-01-01", "2021-12-31").drop("created_at")


_COMMITS = _search_sql(["mempool*"], "p0", where="source_type IN ('commit', 'github_pr')", limit=10)


@_query(f"""WITH top AS ({_COMMITS}), w AS (SELECT DISTINCT id, source_repo, left(t, 12) AS h FROM (SELECT id, source_repo, unnest({_TOK.format('title')} || {_TOK.format('body')}) AS t FROM documents WHERE source_type = 'github_pr') WHERE length(t) >= 12),
  pulls AS (SELECT c.id, w.id AS pull, row_number() OVER (PARTITION BY c.id ORDER BY w.id) AS r FROM documents c JOIN w ON w.h = left(c.source_id, 12) AND (c.source_repo IS NULL OR c.source_repo = w.source_repo) WHERE c.source_type = 'commit')
  SELECT t.id, t.title, t.score, coalesce((SELECT string_agg(pull, ',' ORDER BY pull) FROM pulls p WHERE p.id = t.id AND r <= 5), '') AS pulls FROM top t""")
def find_commit(spark, sf):
    rows = C.find_commit(docs(spark, sf), "mempool", index=indexed(spark, sf))
    return rows.select("id", "title", F.round("score", 6).alias("score"), F.array_join(F.transform("pulls", lambda p: p["pull_id"]), ",").alias("pulls"))


@_query(rf"""WITH w AS (SELECT DISTINCT id, source_repo, left(t, 7) AS h FROM (SELECT id, source_repo, unnest({_TOK.format('title')} || {_TOK.format('body')}) AS t FROM documents WHERE source_type = 'github_pr') WHERE length(t) >= 7)
  SELECT c.id, count(*) AS n_pulls FROM documents c JOIN w ON w.h = left(c.source_id, 7) AND c.source_repo = w.source_repo WHERE c.source_type = 'commit' GROUP BY c.id""")
def commit_mentions(spark, sf):
    """Pull requests that name a commit by seven digits or more (the short form common in texts)."""
    d = docs(spark, sf, "id", "source_type", "source_repo", "source_id", "title", "body")
    words = d.where("source_type = 'github_pr'").select(F.col("id").alias("pull"), "source_repo", F.explode(F.concat(X.tokens(F.col("title")), X.tokens(F.col("body")))).alias("t")).where(F.length("t") >= 7)
    words = words.select("pull", "source_repo", F.substring("t", 1, 7).alias("h")).distinct()
    commits = d.where("source_type = 'commit'").select("id", "source_repo", F.substring("source_id", 1, 7).alias("h"))
    return commits.join(words, ["source_repo", "h"]).groupBy("id").agg(F.count("*").alias("n_pulls"))


@_query("SELECT source_type, count(*) AS n FROM documents GROUP BY 1")
def stats_by_type(spark, sf):
    return C.stats_by_type(docs(spark, sf, "source_type"))


@_query("SELECT count(*) AS total, count(DISTINCT source_type) AS n_types FROM documents")
def stats_total(spark, sf):
    return C.health(docs(spark, sf, "source_type")).select("total", F.size("by_type").cast("bigint").alias("n_types"))


def _edge_sql() -> str:
    one = "SELECT id AS from_doc_id, '{k}' AS ref_type, {e} AS to_external FROM (SELECT id, coalesce(source_repo, '') AS repo, unnest(regexp_extract_all(body, '{p}')) AS m FROM documents)"
    own = "repo || '#' || regexp_extract(m, '#([0-9]+)', 1)"
    parts = [one.format(k="fixes", e=own, p=r"(?i)(?:fix(?:es|ed)?|clos(?:es|ed)?|resolv(?:es|ed)?)\s+#(\d+)"), one.format(k="mentions_issue", e=own, p=r"(?:^|[^&\w])#(\d+)"),
             one.format(k="mentions_issue", e="m", p=r"(\w[\w.-]*/\w[\w.-]*)#(\d+)") + " WHERE split_part(m, '#', 1) <> repo"]
    for kind, prefix, digits in (("bip", "BIP", 4), ("bolt", "BOLT", 2), ("blip", "bLIP", 4), ("lud", "LUD", 2), ("nut", "NUT", 2)):
        parts.append(one.format(k=f"references_{kind}", e=f"'{prefix}-' || regexp_extract(m, '([0-9]+)', 1)", p=rf"(?i)\b{prefix}[- ]?(\d{{1,{digits}}})\b"))
    sha = "regexp_extract(m, '([0-9a-f]{7,40})', 1)"
    parts.append(one.format(k="references_commit", e=sha, p=r"(?:^|[\s(,])([0-9a-f]{7,40})\b") + f" WHERE regexp_matches({sha}, '[0-9]') AND regexp_matches({sha}, '[a-f]')")
    return "SELECT from_doc_id, ref_type, to_external, count(*) AS n FROM (" + " UNION ALL ".join(parts) + ") GROUP BY ALL"


@_query(_edge_sql())
def enrich_entities(spark, sf):
    return extract_references(docs(spark, sf, "id", "body", "source_repo")).groupBy("from_doc_id", "ref_type", "to_external").agg(F.count("*").alias("n"))


@_query("SELECT slug AS concept_slug, count(*) AS n_docs FROM (" + " UNION ALL ".join(f"SELECT '{slug}' AS slug FROM documents WHERE regexp_matches(lower(body), '\\b(?:{'|'.join(aliases)})\\b')" for slug, aliases in vocabulary()) + ") GROUP BY 1")
def enrich_tags(spark, sf):
    return tag_concepts(docs(spark, sf, "id", "body")).groupBy("concept_slug").agg(F.count("*").alias("n_docs"))


@_query("SELECT ref_type, count(*) AS n, count(to_doc_id) AS n_resolved FROM refs GROUP BY 1")
def ref_counts(spark, sf):
    return read_table(spark, sf, "refs", "ref_type", "to_doc_id").groupBy("ref_type").agg(F.count("*").alias("n"), F.count("to_doc_id").alias("n_resolved"))


@_query("""SELECT r.ref_type, count(*) AS n, count(coalesce(r.to_doc_id, d.id)) AS n_resolved FROM refs r LEFT JOIN (SELECT source_repo || '#' || source_id AS k, min(id) AS id FROM documents WHERE source_type IN ('github_issue', 'github_pr') GROUP BY 1) d ON d.k = r.to_external GROUP BY 1""")
def resolve_refs(spark, sf):
    rows = resolve_references(read_table(spark, sf, "refs"), docs(spark, sf, "id", "source_type", "source_repo", "source_id"))
    return rows.groupBy("ref_type").agg(F.count("*").alias("n"), F.count("to_doc_id").alias("n_resolved"))


@_query("SELECT c.id AS from_doc_id, p.id AS to_doc_id FROM documents c JOIN documents p ON p.id = c.parent_id WHERE c.source_type IN ('delving_post', 'bitcointalk_post')")
def reply_edges(spark, sf):
    d = docs(spark, sf, "id", "source_type", "parent_id")
    posts = d.where(F.col("source_type").isin("delving_post", "bitcointalk_post")).select(F.col("id").alias("from_doc_id"), F.col("parent_id").alias("to_doc_id"))
    return posts.join(d.select(F.col("id").alias("to_doc_id")), "to_doc_id", "left_semi").select("from_doc_id", "to_doc_id")


_UNESCAPE = "{}"
for _entity, _char in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " ")):
    _UNESCAPE = f"replace({_UNESCAPE}, '{_entity}', '{_char}')"


@_query("SELECT id, " + _UNESCAPE.format("regexp_replace(body, '<[^>]+>', '', 'g')") + " AS text FROM documents WHERE source_type IN ('delving_topic', 'delving_post')")
def html_text(spark, sf):
    d = docs(spark, sf, "id", "source_type", "body").where(F.col("source_type").isin("delving_topic", "delving_post"))
    return d.select("id", X.unescape_html(X.strip_html(F.col("body"))).alias("text"))


@_query(r"""SELECT mail_id, nullif(trim(regexp_replace(subject, '\n[ \t]+', ' ', 'g')), '') AS subject, nullif(trim(sender), '') AS sender, nullif(regexp_replace(body, '^\s+|\s+$', '', 'g'), '') AS body FROM parsed_email""")
def mail_headers(spark, sf):
    """Headers read back from raw messages in two spellings of the header names, with an empty one that does not count; folded subjects and mails without one included."""
    e = read_table(spark, sf, "parsed_email", "mail_id", "subject", "sender", "body")
    raw = F.concat(F.lit("SUBJECT: "), F.coalesce("subject", F.lit("")), F.lit("\nX-Id: 1\nfrom: "), F.coalesce("sender", F.lit("")), F.lit("\nSubject:\n\n"), F.coalesce("body", F.lit("")))
    return e.select("mail_id", X.mail_headers(raw).alias("h")).select("mail_id", "h.subject", "h.sender", "h.body")


@_query(r"""SELECT mail_id, epoch_us(coalesce(CASE WHEN regexp_matches(p, '^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$') THEN try_strptime(p, '%-d %b %Y %H:%M:%S %z') END,
    CASE WHEN regexp_matches(date, '^\d{4}-\d{2}-\d{2}[Tt ]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})$') THEN try_cast(regexp_replace(date, '(\.\d{6})\d+', '\1') AS TIMESTAMPTZ) END)) AS utc_us
  FROM (SELECT mail_id, date, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(date, '\s+', ' ', 'g'), ' '), '^(?i)(mon|tue|wed|thu|fri|sat|sun),? +', ''), ' *\([^)]*\)$', ''), ' (GMT|UTC|UT|Z)$', ' +0000'), '( \d{2}:\d{2}) ', '\1:00 ') AS p FROM parsed_email)""")
def mail_dates(spark, sf):
    """Dates of every mail, with any white space between their parts."""
    e = read_table(spark, sf, "parsed_email", "mail_id", "date")
    return e.select("mail_id", F.unix_micros(X.mail_date(F.col("date"))).alias("utc_us"))


_NUM = "cast(cast(source_id AS INT) AS VARCHAR)"
_PAD = f"CASE WHEN length({_NUM}) < 2 THEN '0' || {_NUM} ELSE {_NUM} END"


@_query(f"""SELECT id, CASE source_type WHEN 'bip' THEN 'BIP-' || {_NUM} || ': ' || trim(title) WHEN 'bolt' THEN trim(title) WHEN 'blip' THEN 'bLIP-' || {_NUM} || ': ' || trim(title)
  WHEN 'lud' THEN CASE WHEN regexp_matches(title, '^(?i)LUD-') THEN trim(title) ELSE 'LUD-' || {_PAD} || ': ' || trim(title) END WHEN 'nut' THEN CASE WHEN regexp_matches(title, '^(?i)NUT-') THEN trim(title) ELSE 'NUT-' || {_PAD} || ': ' || trim(title) END END AS title FROM specs""")
def spec_titles(spark, sf):
    s = read_table(spark, sf, "specs", "id", "source_type", "source_id", "title", "body")
    head = F.when(F.col("source_type") == "bip", F.concat(F.lit("<pre>\n  BIP: 1\n  Title: "), "title")).otherwise(F.concat(F.lit("# "), "title"))
    return s.select("id", X.spec_title(F.col("source_type"), F.concat(head, F.lit("\n\n"), F.coalesce("body", F.lit(""))), F.col("source_id").cast("int")).alias("title"))


@_query(f"SELECT id, {_URL} AS url FROM documents")
def url_derivation(spark, sf):
    d = docs(spark, sf, "id", "source_type", "source_repo", "source_id", "parent_id", "metadata")
    return d.select("id", document_url(*[F.col(c) for c in ("source_type", "source_repo", "source_id", "parent_id", "metadata")]).alias("url"))


@_query("SELECT id, source_type || CASE WHEN source_repo IS NULL THEN '' ELSE ':' || source_repo END || ':' || source_id AS made FROM documents")
def make_ids(spark, sf):
    return docs(spark, sf, "id", "source_type", "source_repo", "source_id").select("id", make_id(F.col("source_type"), F.col("source_repo"), F.col("source_id")).alias("made"))


@_query("SELECT doc_id, arg_max(change_type, seq) AS change_type, max(seq) AS seq FROM change_log GROUP BY 1")
def upsert_fold(spark, sf):
    return U.fold_batch(read_table(spark, sf, "change_log", "doc_id", "change_type", "seq"), "doc_id", "seq").select("doc_id", "change_type", "seq")


@_query("""WITH b AS (SELECT *, doc_id AS pos FROM documents), s AS (SELECT id FROM documents WHERE source_type = 'github_issue')
  SELECT b.id, (SELECT max(seq) FROM change_log) + pos AS seq, CASE WHEN s.id IS NULL THEN 'insert' ELSE 'update' END AS change_type FROM b LEFT JOIN s ON s.id = b.id""")
def change_log_seq(spark, sf):
    """Stored issues, then a batch of all records: the new log entries, and that the stored rows carry their numbers."""
    d = docs(spark, sf)
    # The batch comes in pages, which number their rows; here the row number is the key.
    numbers = read_table(spark, sf, "documents", "doc_id", "id").select("id", F.col("doc_id").alias("batch_pos"))
    batch = d.join(numbers, "id")
    stored, log = U.upsert_documents(d.where("source_type = 'github_issue'"), batch, read_table(spark, sf, "change_log"), "2025-12-01 00:00:00+00:00")
    new = log.select("seq", F.col("doc_id").alias("id"), "change_type").join(read_table(spark, sf, "change_log", "seq"), "seq", "left_anti")
    return stored.select("id", "seq").join(new, ["id", "seq"]).select("id", "seq", "change_type")


@_query(f"""WITH e AS ({_edge_sql()}) SELECT 'refs ' || ref_type AS name, count(*) AS n FROM e GROUP BY 1 UNION ALL SELECT 'refs replies_to', count(*) FROM documents WHERE parent_id IS NOT NULL
  UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'body length', cast(sum(length(body)) AS BIGINT) FROM documents UNION ALL SELECT 'log ' || t, (SELECT count(*) FROM documents) FROM (VALUES ('insert'), ('update')) AS v(t)""")
def ingest_pages(spark, sf):
    """All documents in two versions in one page, an older text and the stored one, then a page that states the replies: what the store holds afterwards."""
    import uuid

    store = EpochStore(spark, f"{checkpoint_dir(spark)}/ingest-{uuid.uuid4().hex}", buckets=8)
    d = docs(spark, sf).join(read_table(spark, sf, "documents", "doc_id", "id"), "id")
    new = d.withColumn("batch_pos", F.col("doc_id") * 2 + 1)
    old = d.withColumns({"batch_pos": F.col("doc_id") * 2, "body": F.lit("An older text. See BIP-111 and #3.")})
    ingest_batch(store, old.unionByName(new).drop("doc_id"), 0, "2025-12-01 00:00:00+00:00", [])
    replies = d.where("parent_id is not null").select(F.col("id").alias("from_doc_id"), F.col("parent_id").alias("to_doc_id"), F.lit("replies_to").alias("ref_type"), F.lit(None).cast("string").alias("to_external"), F.lit(None).cast("string").alias("context"))
    # The second page is read twice, as after a lost connection.
    for epoch in (1, 2):
        ingest_batch(store, new.drop("doc_id").where("false"), epoch, "2025-12-01 00:00:00+00:00", [], page_refs=replies, cursors={"pages": str(epoch)})
    refs = store.read("refs", REFS).groupBy("ref_type", "from_doc_id", F.coalesce("to_external", "to_doc_id").alias("to")).agg(F.count("*").alias("k"))
    stored = store.read("documents", DOCUMENTS)
    out = refs.groupBy(F.concat(F.lit("refs "), "ref_type").alias("name")).agg(F.count("*").alias("n"))
    out = out.unionByName(stored.agg(F.count("*").alias("n")).select(F.lit("documents").alias("name"), "n")).unionByName(stored.agg(F.sum(F.length("body")).alias("n")).select(F.lit("body length").alias("name"), "n"))
    return out.unionByName(store.read("change_log", CHANGE_LOG).groupBy(F.concat(F.lit("log "), "change_type").alias("name")).agg(F.count("*").alias("n")))


@_query("""WITH g AS (SELECT id FROM documents WHERE source_type = 'github_pr') SELECT * FROM (VALUES ('documents', (SELECT count(*) FROM documents WHERE source_type <> 'github_pr')),
  ('refs', (SELECT count(*) FROM refs WHERE from_doc_id NOT IN (SELECT id FROM g) AND (to_doc_id IS NULL OR to_doc_id NOT IN (SELECT id FROM g)))), ('mentions', (SELECT count(*) FROM concept_mention WHERE doc_id IS NULL OR doc_id NOT IN (SELECT id FROM g))),
  ('change_log', (SELECT count(*) FROM change_log WHERE doc_id NOT IN (SELECT id FROM g))), ('sync_state', (SELECT count(*) FROM sync_state WHERE source_id NOT ILIKE 'issues:%')), ('removed', (SELECT count(*) FROM g))) AS t(name, n)""")
def reset_type(spark, sf):
    tables = U.reset_type(docs(spark, sf), read_table(spark, sf, "refs"), read_table(spark, sf, "concept_mention"), read_table(spark, sf, "change_log"), read_table(spark, sf, "sync_state"), "github_pr", ("ISSUES:%",))
    out = None
    for name, df in tables.items():
        one = df.select(F.lit("removed").alias("name"), F.col("removed").alias("n")) if name == "removed" else df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_query("SELECT change_type, count(*) AS n FROM change_log WHERE changed_at >= TIMESTAMPTZ '2020-01-01 12:00:00+00' GROUP BY 1")
def compact_log(spark, sf):
    return U.compact_log(read_table(spark, sf, "change_log"), "2020-01-01 12:00:00+00:00").groupBy("change_type").agg(F.count("*").alias("n"))


@_query("WITH g AS (SELECT id FROM documents WHERE source_type = 'commit' AND body IS NOT NULL) SELECT ref_type, cast(sum(n) AS BIGINT) AS n FROM (SELECT ref_type, count(*) AS n FROM refs WHERE from_doc_id NOT IN (SELECT id FROM g) GROUP BY 1 UNION ALL SELECT ref_type, n FROM (" + _edge_sql() + ") WHERE from_doc_id IN (SELECT id FROM g)) GROUP BY 1")
def reenrich(spark, sf):
    refs, _ = U.reenrich(docs(spark, sf), read_table(spark, sf, "refs"), read_table(spark, sf, "concept_mention"), "commit")
    return refs.groupBy("ref_type").agg(F.count("*").alias("n"))


@_query("SELECT seq, doc_id, change_type FROM change_log WHERE seq > 500 ORDER BY seq LIMIT 1000")
def change_feed(spark, sf):
    return C.changes_since(read_table(spark, sf, "change_log"), 500).select("seq", "doc_id", "change_type")


@_query("SELECT source_id, CASE WHEN status IN ('pending', 'running', 'ok', 'error') THEN status ELSE 'pending' END AS status, retry_count FROM sync_state")
def sync_states(spark, sf):
    return C.sync_states(read_table(spark, sf, "sync_state")).select("source_id", "status", "retry_count")


# Metrics: requests and job runs stand in the events table.
_RUNS = "SELECT cast(user_id AS VARCHAR) AS source_id, event_id AS run_id, ts AS completed, value AS duration_s, event_type = 'error' AS failed, event_type = 'view' AS paginating FROM events"


def _runs(spark, sf):
    e = read_table(spark, sf, "events")
    return e.select(F.col("user_id").cast("string").alias("source_id"), F.col("event_id").alias("run_id"), F.col("ts").alias("completed"), F.col("value").alias("duration_s"), F.lit(60.0).alias("base_interval_s"),
                    F.get_json_object("props", "$.k").cast("bigint").alias("docs"), F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("event_type") == "view").alias("paginating"))


_LATEST = f"WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY completed DESC, run_id DESC) AS r FROM ({_RUNS})) WHERE r = 1)"


@_query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1")
def minute_requests(spark, sf):
    return M.requests_per_minute(read_table(spark, sf, "events", "ts")).select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "n")


@_query("SELECT strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n FROM events GROUP BY 1")
def stream_minute_requests(spark, sf):
    return minute_counts_stream(spark, sf).select(F.date_format("minute", "yyyy-MM-dd HH:mm").alias("minute"), "n")


@_query("""WITH m AS (SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1) SELECT cast(coalesce(sum(n) FILTER (m >= TIMESTAMP '2024-01-20 12:00' - INTERVAL 1440 MINUTE), 0) AS BIGINT) AS last_day,
  cast(coalesce(sum(n) FILTER (m >= TIMESTAMP '2024-01-20 12:00' - INTERVAL 10080 MINUTE), 0) AS BIGINT) AS last_week FROM m WHERE m <= TIMESTAMP '2024-01-20 12:00'""")
def requests_last_day_week(spark, sf):
    return M.recent_requests(M.requests_per_minute(read_table(spark, sf, "events", "ts")), "2024-01-20 12:00:30")


@_query(_LATEST + " SELECT source_id, run_id, duration_s FROM l")
def latest_runs(spark, sf):
    return M.latest_runs(_runs(spark, sf)).select("source_id", "run_id", "duration_s")


@_query(_LATEST + """, r AS (SELECT cast(range AS VARCHAR) AS source_id FROM range(0, 200)), s AS (SELECT CASE WHEN completed IS NULL THEN 'pending' WHEN failed THEN 'error' WHEN paginating THEN 'paginating' ELSE 'ok' END AS s FROM r LEFT JOIN l USING (source_id))
  SELECT count(*) FILTER (s = 'ok') AS n_ok, count(*) FILTER (s = 'paginating') AS n_paginating, count(*) FILTER (s = 'error') AS n_error, count(*) FILTER (s = 'pending') AS n_pending, round(100.0 * count(*) FILTER (s = 'ok') / count(*), 2) AS pct_ok,
  round(100.0 * count(*) FILTER (s = 'paginating') / count(*), 2) AS pct_paginating, round(100.0 * count(*) FILTER (s = 'error') / count(*), 2) AS pct_error, round(100.0 * count(*) FILTER (s = 'pending') / count(*), 2) AS pct_pending FROM s""")
def job_status(spark, sf):
    return M.job_status(M.latest_runs(_runs(spark, sf)), spark.range(200).select(F.col("id").cast("string").alias("source_id")))


@_query(_LATEST + " SELECT source_id, round(duration_s / 60.0, 6) AS ratio FROM l")
def backlog(spark, sf):
    return M.backlog(M.latest_runs(_runs(spark, sf))).select("source_id", F.round("ratio", 6).alias("ratio"))


@_query("SELECT DISTINCT source_id FROM sync_state WHERE source_id NOT IN (SELECT source_id FROM sync_state WHERE last_synced_at IS NOT NULL)")
def pending_jobs(spark, sf):
    s = read_table(spark, sf, "sync_state", "source_id", "last_synced_at")
    return M.pending_jobs(s, s.where("last_synced_at is not null"))


@_query("SELECT source_id, items_found, CASE WHEN coalesce(items_found, 0) = 0 THEN 7200.0 WHEN items_found <= 5 THEN 3600.0 ELSE 1800.0 END::DOUBLE AS interval_s FROM sync_state")
def adaptive_interval(spark, sf):
    s = read_table(spark, sf, "sync_state", "source_id", "items_found")
    return s.select("source_id", "items_found", M.adaptive_interval(F.lit(3600.0), F.coalesce("items_found", F.lit(0))).alias("interval_s"))


@_query("SELECT source_id, least(30.0 * pow(2, least(retry_count, 6)), 3600.0) AS wait_s FROM sync_state")
def backoff(spark, sf):
    return read_table(spark, sf, "sync_state", "source_id", "retry_count").select("source_id", M.backoff_seconds(F.col("retry_count")).alias("wait_s"))


@_query("SELECT source_id, retry_count FROM sync_state WHERE next_run_at IS NULL OR next_run_at <= TIMESTAMPTZ '2025-11-15 00:00:00+00' ORDER BY next_run_at NULLS FIRST, retry_count DESC, source_id LIMIT 20")
def due_jobs(spark, sf):
    states = read_table(spark, sf, "sync_state").withColumn("priority", F.col("retry_count"))
    return M.due_jobs(states, "2025-11-15 00:00:00+00:00", 20).select("source_id", "retry_count")


@_query(r"""WITH l AS (SELECT id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS no FROM documents WHERE source_type = 'commit' AND body IS NOT NULL),
  c AS (SELECT id, no, line, sum(strlen(line) + 1) OVER (PARTITION BY id ORDER BY no) AS upto FROM l)
  SELECT id, max(upto) > 400 AS truncated, count(*) FILTER (upto <= 400) AS n_lines, coalesce(string_agg(line, chr(10) ORDER BY no) FILTER (upto <= 400), '') || CASE WHEN max(upto) > 400 THEN chr(10) || '[truncated at 400 bytes]' ELSE '' END AS patch FROM c GROUP BY id""")
def diff_truncate(spark, sf):
    d = docs(spark, sf, "id", "source_type", "body").where("source_type = 'commit' and body is not null")
    lines = d.select("id", F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    rows = M.truncate_lines(lines, "id", cap=400)
    kept = F.size(F.split("patch", "\n")) - F.col("truncated").cast("int")
    return rows.select("id", "truncated", F.when(F.col("patch").startswith("\n[truncated at"), 0).otherwise(kept).cast("bigint").alias("n_lines"), "patch")


@_query("""WITH e AS (SELECT id AS key, n_chars AS bytes, to_timestamp(1700000000 + doc_id * 60) AS a FROM documents), t AS (SELECT sum(bytes) AS total FROM e),
  c AS (SELECT key, coalesce(sum(bytes) OVER (ORDER BY a, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM e) SELECT key FROM c, t WHERE total - freed > 300000""")
def lru_evict(spark, sf):
    e = read_table(spark, sf, "documents", "id", "doc_id", "n_chars").select(F.col("id").alias("key"), F.col("n_chars").alias("bytes"), F.timestamp_seconds(F.lit(1700000000) + F.col("doc_id") * 60).alias("access_time"))
    return M.lru_evictions(e, 300_000).select("key")


@_query(_LATEST + """, r AS (SELECT cast(range AS VARCHAR) AS source_id FROM range(0, 200)), s AS (SELECT CASE WHEN completed IS NULL THEN 'pending' WHEN failed THEN 'error' WHEN paginating THEN 'paginating' ELSE 'ok' END AS s FROM r LEFT JOIN l USING (source_id)),
  t AS (SELECT source_type, count(*) AS n FROM documents GROUP BY 1), m AS (SELECT date_trunc('minute', ts) AS m, count(*) AS n FROM events GROUP BY 1)
  SELECT 'documents' AS section, 'total' AS name, cast(sum(n) AS VARCHAR) AS value, NULL::DOUBLE AS share FROM t UNION ALL SELECT 'documents by type', source_type, cast(n AS VARCHAR), round(100.0 * n / (SELECT sum(n) FROM t), 2) FROM t
  UNION ALL SELECT 'jobs', k, cast((SELECT count(*) FROM s WHERE s = k) AS VARCHAR), round(100.0 * (SELECT count(*) FROM s WHERE s = k) / 200, 2) FROM (VALUES ('ok'), ('paginating'), ('error'), ('pending')) AS v(k)
  UNION ALL SELECT 'requests', k, cast(coalesce((SELECT sum(n) FROM m WHERE m <= TIMESTAMP '2024-01-20 12:00' AND m >= TIMESTAMP '2024-01-20 12:00' - to_minutes(w)), 0) AS VARCHAR), NULL FROM (VALUES ('last_day', 1440), ('last_week', 10080)) AS v(k, w)
  UNION ALL SELECT 'sizes', k, v, NULL FROM (VALUES ('a', '1023 B'), ('b', '1.5 KB'), ('c', '3.0 MB'), ('d', '2.0 GB')) AS v(k, v) UNION ALL SELECT 'version', 'version', 'x', NULL""")
def dashboard_model(spark, sf):
    latest = M.latest_runs(_runs(spark, sf))
    recent = M.recent_requests(M.requests_per_minute(read_table(spark, sf, "events", "ts")), "2024-01-20 12:00:30")
    registered = spark.range(200).select(F.col("id").cast("string").alias("source_id"))
    return M.dashboard(C.stats_by_type(docs(spark, sf, "source_type")), latest, registered, recent, {"a": 1023, "b": 1536, "c": 3 * 1024**2, "d": 2 * 1024**3}, "x")


@_query("""SELECT mail_id, 'https://l/?q=d:2023-12-01..2024-01-01&x=A' || CASE WHEN mail_id % 2 = 1 THEN '&o=' || mail_id ELSE '' END AS feed, 'https://l/m' || mail_id || '/raw' AS raw, 'https://g/c/2024-02-29.log' AS log, 'https://www.mail-archive.com/a@b/msg' || CASE WHEN mail_id < 100000 THEN lpad(cast(mail_id AS VARCHAR), 5, '0') ELSE cast(mail_id AS VARCHAR) END || '.html' AS page FROM parsed_email""")
def source_urls(spark, sf):
    e = read_table(spark, sf, "parsed_email", "mail_id")
    n = F.col("mail_id")
    return e.select("mail_id", X.feed_url("https://l", F.lit("2023-12"), F.when(n % 2 == 1, n).otherwise(0)).alias("feed"), X.raw_url(F.concat(F.lit("https://l/m"), n.cast("string"), F.lit("//"))).alias("raw"), X.log_url("https://g", F.lit("c"), F.lit("2024-02-29").cast("date")).alias("log"), X.archive_url(F.lit("a@b"), n).alias("page"))


@_query()
def timeline_all(spark, sf):
    """The timeline over instants read by timestamp normalisation: no document with a readable time is left out."""
    times = normalise(read_table(spark, sf, "documents", "id", "created_at", "source"), "created_at", "source", read_table(spark, sf, "source_zones"))
    at = times.where("status = 'ok'").select("id", F.timestamp_micros("utc_us").alias("created_at"))
    rows = docs(spark, sf, "id", "source_type", "source_repo", "source_id", "title", "parent_id", "metadata").join(at, "id", "left")
    return C.timeline(rows, read_table(spark, sf, "concept_mention"), "channels").drop("created_at")


@_query()
def prom_text(spark, sf):
    latest = M.latest_runs(_runs(spark, sf))
    recent = M.recent_requests(M.requests_per_minute(read_table(spark, sf, "events", "ts")), "2024-01-20 12:00:30")
    return M.exposition(C.stats_by_type(docs(spark, sf, "source_type")), latest, latest.select("source_id"), recent)


@_query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT query_id, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[]), 6) AS similarity FROM embeddings, q WHERE vec_id <> query_id)
  SELECT query_id, vec_id, similarity, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS r FROM s) WHERE r <= 10""")
def vector_nearest(spark, sf):
    v = read_table(spark, sf, "embeddings", "vec_id", "embedding")
    return C.nearest_vectors(v, v.where("vec_id % 100 = 0"))


@_query("SELECT slug, name, category, n_aliases FROM (VALUES " + ", ".join(f"('{s}', '{n}', '{c}', {len(a.split(','))}::BIGINT)" for s, n, c, a in VOCABULARY) + ") AS t(slug, name, category, n_aliases)")
def concepts_seeded(spark, sf):
    rows = spark.createDataFrame([(s, n, c, [x.strip() for x in a.split(",")]) for s, n, c, a in VOCABULARY], "slug string, name string, category string, aliases array<string>")
    half = rows.where("category <> 'lightning'")
    return U.seed_concepts(half, rows).select("slug", "name", "category", F.size("aliases").cast("bigint").alias("n_aliases"))
