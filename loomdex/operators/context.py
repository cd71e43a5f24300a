"""Lookups around documents: context, references, specifications, timelines, commits, statistics, sync states.

Every lookup is one set-based plan; lists are aggregated per document, never fetched row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators.search import SearchParams, metadata_filter, search
from loomdex.schema import SPEC_TYPES, document_url, known_ref_type

_EDGE = ("id", "from_doc_id", "to_doc_id", "ref_type", "to_external", "context")
MAX_REFERENCES, MAX_TIMELINE, MAX_COMMITS, MAX_PULLS, SHA_PREFIX = 100, 200, 10, 5, 12


def _url() -> Column:
    return document_url(*[F.col(c) for c in ("source_type", "source_repo", "source_id", "parent_id", "metadata")])


def document_context(documents: DataFrame, refs: DataFrame, mentions: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """All columns of the documents asked for (all, without ``ids``) and url, outgoing and incoming references (by resolved target only), both by id, and
    concepts, by slug. Unknown ids give no row. References are counted here (``n_out``, ``n_in``); they themselves are rows of ``document_edges``, because a
    document may have any number of them. ``concepts`` is an array, at most the vocabulary long."""
    docs, tags = documents, mentions
    if ids is not None:
        docs, tags = docs.where(F.col("id").isin(*ids)), tags.where(F.col("doc_id").isin(*ids))
    counts = document_edges(refs, ids).groupBy("id").agg(F.count_if(F.col("side") == "outgoing").alias("n_out"), F.count_if(F.col("side") == "incoming").alias("n_in"))
    concepts = tags.groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set("concept_slug")).alias("concepts"))
    rows = docs.withColumn("url", _url()).join(counts, "id", "left").join(concepts, "id", "left")
    return rows.fillna(0, ["n_out", "n_in"]).withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def document_edges(refs: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """(id, side, ref_id, from_doc_id, to_doc_id, ref_type, to_external, context): each reference at its source (outgoing) and its resolved target (incoming); of the
    documents asked for, or all. One pass over the references, no shuffle."""
    edge = [F.col("id").alias("ref_id"), *_EDGE[1:]]
    ends = F.array(F.struct(F.col("from_doc_id").alias("id"), F.lit("outgoing").alias("side")), F.struct(F.col("to_doc_id").alias("id"), F.lit("incoming").alias("side")))
    rows = refs if ids is None else refs.where(F.col("from_doc_id").isin(*ids) | F.col("to_doc_id").isin(*ids))
    rows = rows.select(*edge, F.explode(ends).alias("_e")).select("_e.*", "ref_id", *_EDGE[1:]).where("id is not null")
    return rows if ids is None else rows.where(F.col("id").isin(*ids))


def references_to(refs: DataFrame, entity: str, ref_type: str | None = None, limit: int = 50, cap: int | None = MAX_REFERENCES) -> DataFrame:
    """References whose external key equals ``entity`` exactly, by id; unknown stored types read as the first type."""
    rows = refs.where(F.col("to_external") == entity)
    if ref_type:
        rows = rows.where(F.col("ref_type") == ref_type)
    return rows.withColumn("ref_type", known_ref_type(F.col("ref_type"))).orderBy("id").limit(min(limit, cap) if cap else limit)


def _wanted_specs(specs: DataFrame, asked: list[tuple[str, int]]) -> DataFrame:
    """(spec_id, key, *columns of specs): the specification of each kind and number asked for, padded or not, the smaller id if both are stored."""
    rows, match, key = specs, F.lit(False), F.lit(None).cast("string")
    for source_type, number in asked:
        this = (F.col("source_type") == source_type) & F.col("source_id").isin(str(number), f"{number:02d}")
        match, key = match | this, F.when(this, f"{SPEC_TYPES[source_type]}-{number}").otherwise(key)
    rows = rows.where(match).withColumn("key", key)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where("_r = 1").drop("_r")


def spec_edges(specs: DataFrame, refs: DataFrame, asked: list[tuple[str, int]]) -> DataFrame:
    """(id, side, ref_id, ...): references of the specifications asked for, and references to their ids or to ``PREFIX-n`` with the number unpadded, each once. One pass
    over the references, whatever the number of specifications; the specifications are a stated set."""
    known = _wanted_specs(specs, asked).select(F.col("id").alias("spec_id"), "key")
    names = F.array(F.struct(F.col("spec_id").alias("name"), F.lit("id").alias("by")), F.struct(F.col("key").alias("name"), F.lit("key").alias("by")))
    names = F.broadcast(known.select("spec_id", F.explode(names).alias("_n")).select("spec_id", "_n.*"))  # two rows for each one asked for
    ends = F.array(*[F.struct(F.col(c).alias("name"), F.lit(by).alias("by"), F.lit(side).alias("side")) for c, by, side in (("from_doc_id", "id", "outgoing"), ("to_doc_id", "id", "incoming"), ("to_external", "key", "incoming"))])
    rows = refs.select(F.col("id").alias("ref_id"), *_EDGE[1:], F.explode(ends).alias("_e")).select("ref_id", *_EDGE[1:], "_e.*").join(names, ["name", "by"])
    return rows.select(F.col("spec_id").alias("id"), "side", "ref_id", *_EDGE[1:]).dropDuplicates(["id", "side", "ref_id"])


def lookup_specs(specs: DataFrame, refs: DataFrame, mentions: DataFrame, asked: list[tuple[str, int]]) -> DataFrame:
    """The specifications asked for by kind and number, with counts of their references (``n_out``, ``n_in``; the rows are those of ``spec_edges``) and concepts. No
    row where there is none."""
    rows = _wanted_specs(specs, asked).drop("key")
    counts = spec_edges(specs, refs, asked).groupBy("id").agg(F.count_if(F.col("side") == "outgoing").alias("n_out"), F.count_if(F.col("side") == "incoming").alias("n_in"))
    tags = mentions.join(F.broadcast(rows.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi").groupBy(F.col("doc_id").alias("id")).agg(F.array_sort(F.collect_set("concept_slug")).alias("concepts"))
    rows = rows.join(counts, "id", "left").join(tags, "id", "left")
    return rows.fillna(0, ["n_out", "n_in"]).withColumn("concepts", F.coalesce("concepts", F.array().cast("array<string>")))


def lookup_spec(specs: DataFrame, refs: DataFrame, mentions: DataFrame, source_type: str, number: int) -> DataFrame:
    """``lookup_specs`` of one."""
    return lookup_specs(specs, refs, mentions, [(source_type, number)])


def timeline(documents: DataFrame, mentions: DataFrame, concept: str, after: str | None = None, before: str | None = None, limit: int = MAX_TIMELINE) -> DataFrame:
    """(date, type, title, id, url): documents tagged with the concept, oldest first, at most 200, both bounds included. An unknown concept has no events."""
    tagged = mentions.where(F.col("concept_slug") == concept).select(F.col("doc_id").alias("id")).distinct()
    rows = metadata_filter(documents, SearchParams(after=after, before=before)).join(tagged, "id", "left_semi").where("created_at is not null")
    top = rows.orderBy("created_at", "id").limit(min(limit, MAX_TIMELINE))
    return top.select(F.date_format("created_at", "yyyy-MM-dd").alias("date"), F.col("source_type").alias("type"), "title", "id", _url().alias("url"), "created_at")


def associated_pulls(documents: DataFrame, commits: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(commit_id, pull_id, rank): for every commit the first five pull requests whose text has a word starting with its first 12 digits, in
    the commit's repository if it has one. All commits at once: an equi-join on the digits of the words."""
    from loomdex.functions.text import tokens

    shas = commits.select(F.col("id").alias("commit_id"), F.substring(F.lower("source_id"), 1, SHA_PREFIX).alias("sha"), F.col("source_repo").alias("repo"))
    pulls = documents.where("source_type = 'github_pr'")
    if index:
        words = index[0].select("doc_id", "term").join(pulls.select(F.col("id").alias("doc_id"), "source_repo"), "doc_id").where(F.length("term") >= SHA_PREFIX)
    else:
        words = pulls.select(F.col("id").alias("doc_id"), "source_repo", F.explode(F.concat(tokens(F.col("title")), tokens(F.col("body")))).alias("term")).where(F.length("term") >= SHA_PREFIX)
    words = words.select(F.substring("term", 1, SHA_PREFIX).alias("sha"), "doc_id", "source_repo").distinct()
    hits = words.join(shas, "sha").where(F.col("repo").isNull() | (F.col("repo") == F.col("source_repo"))).select("commit_id", F.col("doc_id").alias("pull_id")).distinct()
    rank = F.row_number().over(Window.partitionBy("commit_id").orderBy("pull_id"))
    return hits.withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= MAX_PULLS)


def find_commit(documents: DataFrame, query: str, repo: str | None = None, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Ten best commits and pull requests for a query; commits with their pull requests (id, title) by id."""
    params = SearchParams(query=query, source_type=["commit", "github_pr"], source_repo=[repo] if repo else [], limit=MAX_COMMITS)
    top = search(documents, params, index=index, snippets=False)
    commits = documents.join(F.broadcast(top.where("source_type = 'commit'").select("id")), "id", "left_semi")  # at most ten
    pulls = associated_pulls(documents, commits, index).join(documents.select(F.col("id").alias("pull_id"), F.col("title").alias("pull_title")), "pull_id")
    lists = pulls.groupBy(F.col("commit_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("rank", "pull_id", "pull_title"))).alias("pulls"))
    rows = top.join(lists, "id", "left")
    return rows.withColumn("pulls", F.coalesce("pulls", F.array().cast(rows.schema["pulls"].dataType)))


def stats_by_type(documents: DataFrame) -> DataFrame:
    return documents.groupBy("source_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_type")


def health(documents: DataFrame) -> DataFrame:
    """One row: total and a map of counts by type."""
    counts = stats_by_type(documents)
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.map_from_entries(F.collect_list(F.struct("source_type", "n"))).alias("by_type"))


def sync_states(states: DataFrame, source_id: str | None = None) -> DataFrame:
    """All states by source, or one; an unknown status reads as pending."""
    rows = states if source_id is None else states.where(F.col("source_id") == source_id)
    return rows.withColumn("status", F.when(F.col("status").isin("pending", "running", "ok", "error"), F.col("status")).otherwise("pending")).orderBy("source_id")


def changes_since(change_log: DataFrame, since: int, limit: int = 1000) -> DataFrame:
    """Change feed: rows after ``since`` by seq, with next_seq and has_more of the page."""
    page = change_log.where(F.col("seq") > since).orderBy("seq").limit(limit + 1)
    n = page.agg(F.count("*").alias("_n"))
    rows = page.orderBy("seq").limit(limit).crossJoin(F.broadcast(n))  # one row
    return rows.withColumns({"has_more": F.col("_n") > limit, "next_seq": F.max("seq").over(Window.partitionBy(F.lit(1)))}).drop("_n")


#: Query vectors that are compared with all rows in one pass.
QUERY_BLOCK = 4096


def nearest_vectors(vectors: DataFrame, query: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, similarity): the k most similar vectors of each query vector by cosine, itself left out.

    ``query`` is a stated set; it meets all rows in blocks of QUERY_BLOCK vectors by a hash of their key, each broadcast, so what is broadcast does not grow with the set."""
    def dot(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)

    n = query.count()
    blocks = max(1, -(-2 * n // QUERY_BLOCK)) if n > QUERY_BLOCK else 1
    q = query.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("_b"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    value = dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q")))
    out = None
    for b in range(blocks):
        pairs = vectors.join(F.broadcast(q.where(F.col("_b") == b)), F.col("query_id") != F.col("vec_id"))
        one = pairs.select("query_id", "vec_id", F.round(value, 6).alias("similarity")).withColumn("rank", rank.cast("bigint")).where(F.col("rank") <= k)
        out = one if out is None else out.unionByName(one)
    return out
