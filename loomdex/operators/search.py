"""Full-text search: inverted index, boolean matching, weighted BM25, snippets.

A search needs, per document, the positions of a few phrases in title and body. They come either from a persisted index (``build_index``:
postings sorted by term, so that a term or prefix filter reaches the scan) or, without one, from the texts in a projection. Corpus statistics are
taken before any metadata filter. Bodies are joined back only for the rows of the answer.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from loomdex.functions.text import fold, tokens
from loomdex.operators.query import Near, Op, Phrase, parse, phrases, tokens_of
from loomdex.schema import SOURCE_TYPES, document_url
from loomdex.session import cut

K1, B = 1.2, 0.75
WEIGHTS = {"title": 5.0, "body": 1.0}
MAX_LIMIT, DEFAULT_LIMIT = 100, 20
SNIPPET_TOKENS = 64


@dataclass
class SearchParams:
    query: str = ""
    source_type: list[str] = field(default_factory=list)
    source_repo: list[str] = field(default_factory=list)
    author: str | None = None
    after: str | None = None
    before: str | None = None
    limit: int = DEFAULT_LIMIT


# Index -------------------------------------------------------------------------------------------------------------


def build_index(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings, doc_stats). postings: term, doc_id, col, positions, dl (tokens of the document); doc_stats: doc_id, dl. Null texts have no tokens.

    Written with ``write_index``; one shuffle by (term, doc, column), combined map-side within a document by construction.
    """
    columns = [F.struct(F.lit(c).alias("col"), tokens(F.col(c)).alias("t")) for c in WEIGHTS]
    words = documents.select(F.col("id").alias("doc_id"), F.array(*columns).alias("xs")).withColumn("dl", F.aggregate("xs", F.lit(0), lambda n, x: n + F.size(x["t"])).cast("long"))
    words = words.select("doc_id", "dl", F.explode("xs").alias("x")).select("doc_id", "dl", "x.col", F.posexplode("x.t").alias("pos", "term"))
    postings = words.groupBy("term", "doc_id", "col", "dl").agg(F.sort_array(F.collect_list("pos")).alias("positions")).select("term", "doc_id", "col", "positions", "dl")
    stats = documents.select(F.col("id").alias("doc_id"), sum(F.size(tokens(F.col(c))) for c in WEIGHTS).cast("long").alias("dl"))
    return postings, stats


def write_index(documents: DataFrame, path: str, partitions: int | None = None) -> None:
    """Persists the index under ``path``: postings range-partitioned and sorted by (term, doc), for min/max pruning of scans, so that a frequent term is
    spread over many files; document lengths, and the corpus statistics in one row."""
    postings, stats = build_index(documents)
    spread = (partitions, "term", "doc_id") if partitions else ("term", "doc_id")
    postings.repartitionByRange(*spread).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    stats.write.mode("overwrite").parquet(f"{path}/doc_stats")
    corpus_of(documents.sparkSession.read.parquet(f"{path}/doc_stats")).write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(postings, corpus) of a persisted index."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/corpus")


def corpus_of(stats: DataFrame) -> DataFrame:
    """One row: docs, avgdl. A table that is this row already stays."""
    return stats if "avgdl" in stats.columns else stats.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))


def merge_index(postings: DataFrame, stats: DataFrame, changed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index after the documents in ``changed`` (new or updated) replaced their old entries."""
    new_postings, new_stats = build_index(changed)
    ids = changed.select(F.col("id").alias("doc_id"))
    return postings.join(ids, "doc_id", "left_anti").unionByName(new_postings), stats.join(ids, "doc_id", "left_anti").unionByName(new_stats)


# Matching ----------------------------------------------------------------------------------------------------------


def _word_positions(words: Column, test) -> Column:
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1, F.lit(1)), lambda i: test(F.get(words, i)))


def _adjacent(parts: list[Column]) -> Column:
    """Start positions p such that part i holds p + i."""

    def follow(found: Column, other: Column, i: int) -> Column:
        return F.filter(found, lambda p: F.array_contains(other, p + i))

    out = parts[0]
    for i, other in enumerate(parts[1:], 1):
        out = follow(out, other, i)
    return out


def _test(p: Phrase, i: int):
    token = p.tokens[i]
    last = p.prefix and i == len(p.tokens) - 1
    return (lambda w: w.startswith(token)) if last else (lambda w: w == token)


def hits_from_text(documents: DataFrame, wanted: list[Phrase]) -> DataFrame:
    """(id, dl, h0, h1, ...): for each phrase its start positions by column, from the texts themselves; no shuffle."""
    rows = documents.select("id", *[tokens(F.col(c)).alias(f"_{c}") for c in WEIGHTS])
    # A generator keeps the tokens from being worked out once per phrase.
    rows = rows.select("id", F.explode_outer(F.array(F.struct(*[F.col(f"_{c}").alias(c) for c in WEIGHTS]))).alias("w")).select("id", "w.*")
    out = {}
    for n, p in enumerate(wanted):
        by = []
        for c in WEIGHTS:
            words = F.col(c)
            found = _adjacent([F.when(F.size(words) > 0, _word_positions(words, _test(p, i))).otherwise(F.array().cast("array<int>")) for i in range(len(p.tokens))])
            by.append(_kept(found, p, c).alias(c))
        out[f"h{n}"] = F.struct(*by)
    return rows.select("id", sum(F.size(c) for c in WEIGHTS).cast("long").alias("dl"), *[v.alias(k) for k, v in out.items()])


def _kept(found: Column, p: Phrase, column: str) -> Column:
    if p.column and p.column != column:
        return F.array().cast("array<int>")
    return F.filter(found, lambda x: x == 0) if p.first else found


def hits_from_index(postings: DataFrame, wanted: list[Phrase]) -> DataFrame:
    """The same from a persisted index, for the documents with one of the terms; only the postings of the query's terms are read."""
    keys = {}
    for p in wanted:
        for i, t in enumerate(p.tokens):
            keys[(t, p.prefix and i == len(p.tokens) - 1)] = None
    condition = None
    for token, prefix in keys:
        c = F.col("term").startswith(token) if prefix else F.col("term") == token
        condition = c if condition is None else condition | c
    rows = postings.where(condition)
    aggs = []
    for k, (token, prefix) in enumerate(keys):
        for c in WEIGHTS:
            hit = (F.col("col") == c) & (F.col("term").startswith(token) if prefix else F.col("term") == token)
            aggs.append(F.sort_array(F.flatten(F.collect_list(F.when(hit, F.col("positions"))))).alias(f"k{k}_{c}"))
    grouped = rows.groupBy("doc_id").agg(F.max("dl").alias("dl"), *aggs)
    index = {key: k for k, key in enumerate(keys)}
    out = []
    for n, p in enumerate(wanted):
        by = [_kept(_adjacent([F.col(f"k{index[(t, p.prefix and i == len(p.tokens) - 1)]}_{c}") for i, t in enumerate(p.tokens)]), p, c).alias(c) for c in WEIGHTS]
        out.append(F.struct(*by).alias(f"h{n}"))
    return grouped.select(F.col("doc_id").alias("id"), "dl", *out)


def _count(n: int, column: str) -> Column:
    return F.greatest(F.coalesce(F.size(F.col(f"h{n}.{column}")), F.lit(0)), F.lit(0))


def _match(tree, at: list[int]) -> tuple[Column, list[tuple[int, Column]]]:
    """(matches, [(phrase number, contributes)]) of a tree; phrases are numbered in order. Only phrases in true sub-expressions contribute."""
    if isinstance(tree, Phrase):
        n = at[0]
        at[0] += 1
        hit = (_count(n, "title") + _count(n, "body")) > 0
        return hit, [(n, hit)]
    if isinstance(tree, Near):
        ns = list(range(at[0], at[0] + len(tree.phrases)))
        at[0] += len(ns)
        near = None
        for c in WEIGHTS:
            one = _near(tree, ns, c)
            near = one if near is None else near | one
        return near, [(n, near) for n in ns]
    parts = [_match(i, at) for i in tree.items]
    if tree.kind == "not":
        ok = parts[0][0] & ~parts[1][0]
        return ok, [(n, c & ok) for n, c in parts[0][1]]
    ok = parts[0][0]
    for p in parts[1:]:
        ok = (ok & p[0]) if tree.kind == "and" else (ok | p[0])
    return ok, [(n, c & (ok if tree.kind == "and" else part[0])) for part in parts for n, c in part[1]]


def _near(tree: Near, ns: list[int], c: str) -> Column:
    """Some choice of one hit per phrase whose gaps fit: checked around each hit of the first phrase."""
    total = sum(len(p.tokens) for p in tree.phrases)
    span = tree.distance + total
    first = F.coalesce(F.col(f"h{ns[0]}.{c}"), F.array().cast("array<int>"))

    def fits(p: Column) -> Column:
        ok = F.lit(True)
        for n in ns[1:]:
            other = F.coalesce(F.col(f"h{n}.{c}"), F.array().cast("array<int>"))
            ok = ok & F.exists(other, lambda q: F.abs(q - p) <= span - 1)
        return ok

    return F.exists(first, fits)


def ranked(hits: DataFrame, tree, stored: DataFrame | None = None) -> DataFrame:
    """(id, score, h*): matching documents with their BM25 score over the whole corpus: that of ``stored`` statistics (one row), else that of ``hits``."""
    seen_phrases = [0]
    ok, contributions = _match(tree, seen_phrases)
    count = seen_phrases[0]
    n_of = [F.count_if((_count(n, "title") + _count(n, "body")) > 0).alias(f"n{n}") for n in range(count)]
    # Corpus statistics are observed over all documents while the few with a hit are written, so the texts are read once; the
    # numbers are parameters of the score expression.
    seen, some = Observation(), F.lit(False)
    for n in range(count):
        some = some | ((_count(n, "title") + _count(n, "body")) > 0)
    hits = cut(hits.observe(seen, F.count("*").alias("docs"), F.avg("dl").alias("avgdl"), *n_of).where(some))
    corpus = dict(seen.get)
    if stored is not None:
        corpus.update(stored.first().asDict())
    score = F.lit(0.0)
    for n, contributes in contributions:
        df = corpus[f"n{n}"]
        idf = F.log((F.lit(float(corpus["docs"] - df)) + 0.5) / (df + 0.5))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        tf = WEIGHTS["title"] * _count(n, "title") + WEIGHTS["body"] * _count(n, "body")
        norm = K1 * (1 - B + B * F.col("dl") / (corpus["avgdl"] or 1.0))
        score = score + F.when(contributes, idf * tf * (K1 + 1) / (tf + norm)).otherwise(0.0)
    used = [F.when(c, F.col(f"h{n}")).alias(f"h{n}") for n, c in contributions]
    return hits.where(ok).select("id", score.alias("score"), *used)


# Filters and the public search ------------------------------------------------------------------------------------


def metadata_filter(documents: DataFrame, params: SearchParams) -> DataFrame:
    """Conditions on type, repository, author and time (both ends included). Unknown types are dropped, and a list of only unknown
    types filters nothing; times that cannot be read are ignored."""
    types = [t for t in params.source_type if t in SOURCE_TYPES]
    out = documents
    if types:
        out = out.where(F.col("source_type").isin(*types))
    if params.source_repo:
        out = out.where(F.col("source_repo").isin(*params.source_repo))
    if params.author is not None:
        out = out.where(F.col("author") == params.author)
    for bound, op in ((params.after, "__ge__"), (params.before, "__le__")):
        instant = _instant(bound)
        if instant:
            out = out.where(getattr(F.col("created_at"), op)(F.lit(instant).cast("timestamp")))
    return out


def _instant(text: str | None) -> str | None:
    from datetime import UTC, datetime

    if not text:
        return None
    try:
        got = datetime.fromisoformat(text)
    except ValueError:
        return None
    got = got.replace(tzinfo=UTC) if got.tzinfo is None else got.astimezone(UTC)
    return got.strftime("%Y-%m-%d %H:%M:%S.%f+00:00")


def search(documents: DataFrame, params: SearchParams, mentions: DataFrame | None = None, index: tuple[DataFrame, DataFrame] | None = None, snippets: bool = True) -> DataFrame:
    """Ranked answer: id, source_type, source_repo, title, author, created_at, score, url, total_count, concepts (array, with ``mentions``) and snippet.

    Best score first, ties by id. A blank or ``*`` query lists by time, newest first, with score 0, and needs at least one filter (ValueError).
    ``limit`` is capped at 100 and may be 0; total_count is the number of rows returned. Raises QuerySyntaxError for what cannot be parsed.
    """
    limit = max(0, min(params.limit, MAX_LIMIT))
    text = params.query.strip()
    columns = ["id", "source_type", "source_repo", "source_id", "title", "author", "created_at", "parent_id", "metadata"]
    if text in ("", "*"):
        if not (params.source_type or params.source_repo or params.author or params.after or params.before):
            raise ValueError("a query without words needs a filter")
        rows = metadata_filter(documents, params).select(*columns).withColumn("score", F.lit(0.0))
        top, tree = rows.orderBy(F.desc("created_at"), "id").limit(limit), None
    else:
        tree = parse(text)
        if tree is None:
            rows = documents.where(F.lit(False)).select(*columns).withColumn("score", F.lit(0.0))
            top = rows.limit(limit)
        else:
            wanted = phrases(tree)
            found = ranked(hits_from_index(index[0], wanted), tree, corpus_of(index[1])) if index else ranked(hits_from_text(documents, wanted), tree)
            marks = [c for c in found.columns if c not in ("id", "score")] if snippets else []
            found = found.select("id", "score", *marks)
            if params.source_type or params.source_repo or params.author is not None or params.after or params.before:
                found = found.join(metadata_filter(documents, params).select("id"), "id", "left_semi")
            best = cut(found.orderBy(F.desc("score"), "id").limit(limit))
            # Metadata are read for the at most 100 rows of the answer only; their ids reach the scan.
            ids = [r[0] for r in best.select("id").collect()]
            top = documents.where(F.col("id").isin(ids)).select(*columns).join(F.broadcast(best), "id")
    top = cut(top)
    top = top.withColumn("total_count", F.lit(top.count()).cast("bigint"))
    if snippets:
        top = _with_snippets(top, documents, tree)
    if mentions is not None:
        tags = mentions.join(F.broadcast(top.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set("concept_slug")).alias("concepts"))
        top = top.join(tags, "id", "left").withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))
    url = document_url(*[F.col(c) for c in ("source_type", "source_repo", "source_id", "parent_id", "metadata")])
    extra = [c for c in ("concepts", "snippet") if c in top.columns]
    out = top.select("id", "source_type", "source_repo", "title", "author", "created_at", "score", url.alias("url"), "total_count", *extra)
    # At most 100 rows, which the joins above may have brought out of order.
    order = [F.desc("score")] if text not in ("", "*") else [F.desc("created_at")]
    return out.coalesce(1).sortWithinPartitions(*order, "id")


# Snippets ---------------------------------------------------------------------------------------------------------


def snippet(body: str | None, hits: list[tuple[int, int, int]], size: int = SNIPPET_TOKENS) -> str | None:
    """``hits``: (first token, tokens, phrase), by position. A window of ``size`` tokens with the hits marked: 1000 for each phrase's first hit
    in the window, 1 for each further one, 120 or 100 for a window that starts the text or a sentence."""
    import regex

    if body is None:
        return None
    spans = [m.span() for m in regex.finditer(r"[\p{L}\p{N}\p{Co}\u0300-\u036f]+", body)]
    total, hits = len(spans), sorted(hits, key=lambda h: (h[0], h[2]))

    def worth(start: int) -> tuple[int, int, int]:
        inside = [h for h in hits if start <= h[0] < start + size]
        seen, score = set(), 0
        for h in inside:
            score += 1 if h[2] in seen else 1000
            seen.add(h[2])
        return score, (inside[0][0] if inside else start), max((h[0] + h[1] for h in inside), default=start)

    sentences = [0]
    for i in range(1, total):
        gap = body[: spans[i][0]]
        if gap[-1:] in " \t\r\n" and gap.rstrip(" \t\r\n")[-1:] in (".", ":"):
            sentences.append(i)
    best, at = -1, 0
    for o, _, _ in hits:
        score, low, high = worth(o)
        centred = min(max(low - int((size - (high - low)) / 2), 0), max(total - size, 0))
        if score > best:
            best, at = score, centred
        if total > size:
            s = max((x for x in sentences if x <= o), default=0)
            if s < o:
                score = worth(s)[0] + (120 if s == 0 else 100)
                if score > best:
                    best, at = score, s
    stop = min(at + size, total)
    out, pos = ["..." if at > 0 else ""], spans[at][0] if at > 0 and spans else 0
    marked: list[list[int]] = []
    for first, n, _ in hits:
        first, last = max(first, at), min(first + n, stop)
        if first < last:
            if marked and first < marked[-1][1]:
                marked[-1][1] = max(marked[-1][1], last)
            else:
                marked.append([first, last])
    for first, last in marked:
        out += [body[pos : spans[first][0]], "<mark>", body[spans[first][0] : spans[last - 1][1]], "</mark>"]
        pos = spans[last - 1][1]
    out += [body[pos : spans[stop - 1][1]], "..."] if stop < total else [body[pos:]]
    return "".join(out)


def _with_snippets(top: DataFrame, documents: DataFrame, tree) -> DataFrame:
    by_name = {f"h{n}": len(p.tokens) for n, p in enumerate(phrases(tree))}
    names = [n for n in by_name if n in top.columns]
    lengths = [by_name[n] for n in names]
    arrays = [F.coalesce(F.col(f"{n}.body"), F.array().cast("array<int>")) for n in names]
    marks = F.array(*arrays) if arrays else F.array().cast("array<array<int>>")
    rows = top.withColumn("_marks", marks).drop(*names)
    bodies = documents.join(F.broadcast(top.select("id")), "id", "left_semi").select("id", "body")  # at most 100 ids
    rows = rows.join(bodies, "id")
    kept = [f for f in rows.schema.fields if f.name not in ("_marks", "body")]

    def run(batches):
        for batch in batches:
            texts = [snippet(b, [(p, lengths[i], i) for i, ps in enumerate(m) for p in ps]) for b, m in zip(batch.column("body").to_pylist(), batch.column("_marks").to_pylist())]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(texts, pa.string())], names=[*[f.name for f in kept], "snippet"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return rows.mapInArrow(run, f"{schema}, snippet string")


__all__ = ["SearchParams", "build_index", "fold", "hits_from_index", "hits_from_text", "merge_index", "metadata_filter", "ranked", "read_index", "search", "snippet", "tokens_of", "write_index", "Op"]
