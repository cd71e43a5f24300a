"""Version history extracts to documents: new commits, change summaries, merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators.metrics import truncate_lines
from loomdex.session import cut
from loomdex.sources.tracker import _column, _select

COMMIT = "sha string, parents array<string>, message string, author_name string, author_email string, ts long, insertions long, deletions long, files array<struct<path: string, status: string>>, patch string"
PATCH_BYTES, FILES, PAGE = 8192, 100, 200
STATUSES = ("A", "D", "M", "R", "C", "T")


def default_branch(branches: list[str]) -> str | None:
    """main, else master, else HEAD, else the first branch."""
    return next((b for b in ("main", "master", "HEAD") if b in branches), branches[0] if branches else None)


def new_commits(commits: DataFrame, head: str, seen: str | None = None) -> DataFrame:
    """Commits reachable from ``head`` but not from ``seen``: reached sets grow along the chains of first parents, which double each round, so a linear history of n
    commits takes log n rounds; side branches add a round for each time a walk leaves a chain."""
    edges = cut(commits.select("sha", F.posexplode("parents").alias("nth", "parent")))
    # chain[i]: the first parent 2^i steps up, as far as there is one.
    chains = [edges.where("nth = 0").select("sha", F.col("parent").alias("up"))]
    while True:
        last = chains[-1]
        longer = cut(last.join(last.select(F.col("sha").alias("up"), F.col("up").alias("up2")), "up").select("sha", F.col("up2").alias("up")))
        if longer.isEmpty():
            break
        chains.append(longer)
    out = _reach(commits, edges, chains, head)
    if seen:
        out = out.join(_reach(commits, edges, chains, seen), "sha", "left_anti")
    return commits.join(out, "sha", "left_semi")


def _reach(commits: DataFrame, edges: DataFrame, chains: list[DataFrame], start: str) -> DataFrame:
    known = commits.where(F.col("sha") == start).select("sha")
    front = known
    while True:
        # All first-parent ancestors of the front: 1, 2, 4 ... steps from everything reached so far.
        grown = front
        for chain in reversed(chains):
            grown = grown.unionByName(grown.join(chain, "sha").select(F.col("up").alias("sha"))).distinct()
        grown = cut(grown.join(known, "sha", "left_anti").unionByName(front).distinct().join(commits.select("sha"), "sha", "left_semi"))
        known = cut(known.unionByName(grown).distinct())
        front = cut(edges.where("nth > 0").join(grown, "sha").select(F.col("parent").alias("sha")).distinct().join(known, "sha", "left_anti"))
        if front.isEmpty():
            return known


def commit_documents(commits: DataFrame, repo: str | Column) -> DataFrame:
    """Title is the first line; the body the message and a change block: up to 100 files with status letters and the patch up to 8,192 bytes; merges have none."""
    lines = commits.where("size(parents) <= 1 and patch is not null").select("sha", F.posexplode(F.split("patch", "\n")).alias("line_no", "line"))
    patches = truncate_lines(lines, "sha", cap=PATCH_BYTES).select("sha", F.col("patch").alias("cut_patch"))
    rows = commits.join(patches, "sha", "left")
    merge = F.size("parents") > 1
    files = F.coalesce("files", F.array().cast("array<struct<path: string, status: string>>"))
    letter = lambda f: F.when(f["status"].isin(*STATUSES), f["status"]).otherwise("?")
    listed = F.array_join(F.transform(F.slice(files, 1, FILES), lambda f: F.concat(letter(f), F.lit(" "), f["path"])), "\n")
    more = F.when(F.size(files) > FILES, F.concat(F.lit("\n... and "), (F.size(files) - FILES).cast("string"), F.lit(" more files"))).otherwise("")
    summary = F.concat((F.size(files)).cast("string"), F.lit(" files changed, "), F.coalesce("insertions", F.lit(0)).cast("string"), F.lit(" insertions(+), "), F.coalesce("deletions", F.lit(0)).cast("string"), F.lit(" deletions(-)"))
    block = F.concat(F.lit("\n\n---\nChangeset:\n"), summary, F.lit("\n"), listed, more, F.coalesce(F.concat(F.lit("\n\n"), "cut_patch"), F.lit("")))
    meta = F.to_json(F.struct(merge.alias("is_merge"), "parents", F.size(files).alias("files_changed"), "insertions", "deletions", F.transform(F.slice(files, 1, FILES), lambda f: f["path"]).alias("files")))
    out = rows.withColumns({
        "source_type": F.lit("commit"), "source_repo": _column(repo), "source_id": F.col("sha"), "id": F.concat(F.lit("commit:"), _column(repo), F.lit(":"), "sha"), "title": F.substring_index("message", "\n", 1),
        "body": F.when(merge, F.col("message")).otherwise(F.concat(F.rtrim("message"), block)), "author": F.col("author_name"), "author_id": F.col("author_email"), "created_at": F.timestamp_seconds("ts"), "metadata": meta,
    })
    return _select(out)


def merge_edges(commits: DataFrame, repo: str | Column) -> DataFrame:
    """(from_doc_id, ref_type, to_external, context) of merges that name the pull request they close."""
    number = F.regexp_extract("message", r"^Merge pull request #(\d+) from ", 1)
    rows = commits.where((F.size("parents") > 1) & (number != ""))
    return rows.select(F.concat(F.lit("commit:"), _column(repo), F.lit(":"), "sha").alias("from_doc_id"), F.lit("mentions_pr").alias("ref_type"), F.concat(_column(repo), F.lit("#"), number).alias("to_external"), F.substring_index("message", "\n", 1).alias("context"))


def page(commits: DataFrame, size: int = PAGE) -> DataFrame:
    """The newest commits of a page, by time then hash."""
    return commits.orderBy(F.desc("ts"), "sha").limit(size)


def stretch(rows: DataFrame) -> DataFrame:
    """(topic_state rows) run lengths of consecutive misses per source: a miss counter as a window over resets."""
    w = Window.partitionBy("source_id").orderBy("position")
    group = F.sum(F.when(F.col("found"), 1).otherwise(0)).over(w)
    return rows.withColumn("run", group).withColumn("misses", F.sum(F.when(~F.col("found"), 1).otherwise(0)).over(Window.partitionBy("source_id", "run").orderBy("position")))
