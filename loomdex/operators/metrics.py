"""Operational metrics: request windows, job runs, schedules, cache eviction, text exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def requests_per_minute(events: DataFrame, ts: str = "ts") -> DataFrame:
    return events.groupBy(F.date_trunc("minute", F.col(ts)).alias("minute")).agg(F.count("*").alias("n"))


def recent_requests(minutes: DataFrame, now: str) -> DataFrame:
    """One row: requests of the last 1,440 and 10,080 minute buckets, the cutoff minute included."""
    last = F.date_trunc("minute", F.lit(now).cast("timestamp"))
    back = lambda n: F.coalesce(F.sum(F.when((F.col("minute") >= last - F.expr(f"INTERVAL {n} MINUTES")) & (F.col("minute") <= last), F.col("n"))), F.lit(0))
    return minutes.agg(back(1440).alias("last_day"), back(10080).alias("last_week"))


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last run of each source by completion (ties by run id): map-side combined, no window."""
    rest = [c for c in runs.columns if c != "source_id"]
    return runs.groupBy("source_id").agg(F.max_by(F.struct(*rest), F.struct("completed", "run_id")).alias("r")).select("source_id", "r.*")


def job_status(latest: DataFrame, registered: DataFrame) -> DataFrame:
    """One row: n_ok, n_paginating, n_error, n_pending and their percentages of all registered jobs."""
    rows = registered.select("source_id").distinct().join(latest, "source_id", "left")
    status = F.when(F.col("completed").isNull(), "pending").when(F.col("error").isNotNull(), "error").when(F.col("paginating"), "paginating").otherwise("ok")
    names = ("ok", "paginating", "error", "pending")
    counts = rows.withColumn("s", status).agg(*[F.count_if(F.col("s") == n).alias(f"n_{n}") for n in names], F.count("*").alias("n"))
    return counts.select(*[f"n_{n}" for n in names], *[F.coalesce(F.round(F.try_divide(F.col(f"n_{n}") * 100.0, F.col("n")), 2), F.lit(0.0)).alias(f"pct_{n}") for n in names])


def pending_jobs(registered: DataFrame, latest: DataFrame) -> DataFrame:
    return registered.select("source_id").distinct().join(latest, "source_id", "left_anti")


def backlog(latest: DataFrame) -> DataFrame:
    """Per source: duration over base interval, 0 without one."""
    return latest.select("source_id", F.when(F.col("base_interval_s") > 0, F.col("duration_s") / F.col("base_interval_s")).otherwise(0.0).alias("ratio"))


def adaptive_interval(base: Column, found: Column) -> Column:
    """Twice the base after nothing, half of it after six or more items."""
    return F.when(found == 0, base * 2).when(found <= 5, base).otherwise(base / 2)


def backoff_seconds(retries: Column) -> Column:
    return F.least(F.lit(30.0) * F.pow(F.lit(2.0), F.least(retries, F.lit(6))), F.lit(3600.0))


def due_jobs(states: DataFrame, now: str, limit: int = 1) -> DataFrame:
    """Jobs whose time has come, earliest first, then higher priority; never run ones first."""
    due = states.where(F.col("next_run_at").isNull() | (F.col("next_run_at") <= F.lit(now).cast("timestamp")))
    return due.orderBy(F.col("next_run_at").asc_nulls_first(), F.desc("priority"), "source_id").limit(limit)


def may_request(remaining: int, reset_at: float, now: float, margin: int = 200) -> float:
    """Seconds to wait before the next request of a limited interface."""
    return max(0.0, reset_at + 1.0 - now) if remaining <= margin else 0.0


def lru_evictions(entries: DataFrame, cap: int, key: str = "key", access: str = "access_time", size: str = "bytes") -> DataFrame:
    """Entries to drop, oldest first, until the rest fits ``cap``. Totals are summed per day first, so only one day's entries are ordered."""
    total = entries.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    rows = entries.withColumn("_day", F.to_date(access))
    days = rows.groupBy("_day").agg(F.sum(size).alias("_b"))
    before = days.withColumn("_before", F.coalesce(F.sum("_b").over(Window.partitionBy(F.lit(1)).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_day").orderBy(access, key).rowsBetween(Window.unboundedPreceding, -1)
    freed = F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    return rows.join(before.select("_day", "_before"), "_day").withColumn("freed_before", freed).where(F.lit(total) - F.col("freed_before") > cap).drop("_day", "_before")


def cache_usage(entries: DataFrame, cap: int, size: str = "bytes") -> DataFrame:
    """One row: total bytes and their share of ``cap`` (null without one)."""
    total = F.coalesce(F.sum(size), F.lit(0))
    return entries.agg(total.alias("bytes"), F.try_divide(total.cast("double"), F.lit(float(cap))).alias("ratio"))


def truncate_lines(lines: DataFrame, key: str = "key", order: str = "line_no", text: str = "line", cap: int = 8192) -> DataFrame:
    """(key, patch, truncated): lines joined while their bytes, newline included, stay within ``cap``."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("_sum", F.sum(F.octet_length(text) + 1).over(w))
    kept = F.collect_list(F.when(F.col("_sum") <= cap, F.struct(order, text)))
    out = rows.groupBy(key).agg(F.array_sort(kept).alias("_l"), F.max("_sum").alias("_all"))
    patch = F.array_join(F.transform("_l", lambda x: x[text]), "\n")
    return out.select(key, F.when(F.col("_all") > cap, F.concat(patch, F.lit(f"\n[truncated at {cap} bytes]"))).otherwise(patch).alias("patch"), (F.col("_all") > cap).alias("truncated"))


def _escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))


def exposition(by_type: DataFrame, latest: DataFrame, registered: DataFrame, recent: DataFrame, cache_bytes: int = 0, prefix: str = "loomdex") -> DataFrame:
    """(family, line): gauges in text form, one row per sample."""
    def sample(df: DataFrame, name: str, value: Column, label: str | None = None, of: Column | None = None) -> DataFrame:
        labels = F.concat(F.lit("{" + label + '="'), _escape(of), F.lit('"}')) if label else F.lit("")
        return df.select(F.lit(f"{prefix}_{name}").alias("family"), F.concat(F.lit(f"{prefix}_{name}"), labels, F.lit(" "), value.cast("string")).alias("line"))

    status = job_status(latest, registered)
    parts = [
        sample(by_type, "documents", F.col("n"), "source_type", F.col("source_type")),
        sample(by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), "documents_total", F.col("n")),
        sample(recent, "requests_24h", F.col("last_day")), sample(recent, "requests_7d", F.col("last_week")),
        sample(latest, "job_duration_seconds", F.col("duration_s"), "source_id", F.col("source_id")),
        sample(latest, "job_documents", F.col("docs"), "source_id", F.col("source_id")),
        sample(latest, "job_base_interval_seconds", F.col("base_interval_s"), "source_id", F.col("source_id")),
        sample(latest, "job_last_completed", F.unix_seconds("completed"), "source_id", F.col("source_id")),
        sample(backlog(latest), "job_backlog_ratio", F.col("ratio"), "source_id", F.col("source_id")),
        *[sample(status, f"jobs_{n}", F.col(f"n_{n}")) for n in ("ok", "paginating", "error", "pending")],
        sample(latest.agg(F.coalesce(F.sum("duration_s"), F.lit(0.0)).alias("d")), "job_duration_seconds_total", F.col("d")),
        sample(by_type.sparkSession.range(1).select(F.lit(cache_bytes).alias("b")), "cache_bytes", F.col("b")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def format_bytes(n: Column) -> Column:
    """Bytes for people: whole bytes below 1,024, else KB, MB or GB with one decimal."""
    scaled = lambda power, unit: F.concat(F.format_string("%.1f", n / F.lit(1024.0**power)), F.lit(f" {unit}"))
    return F.when(n >= 1024**3, scaled(3, "GB")).when(n >= 1024**2, scaled(2, "MB")).when(n >= 1024, scaled(1, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def dashboard(by_type: DataFrame, latest: DataFrame, registered: DataFrame, recent: DataFrame, sizes: dict[str, int] | None = None, version: str = "") -> DataFrame:
    """(section, name, value, share): what a status page shows: documents in all and by type, the split of the jobs, requests, sizes for people, and the version."""
    status = job_status(latest, registered)
    spark = by_type.sparkSession
    none = F.lit(None).cast("double")
    row = lambda df, section, name, value, share=none: df.select(F.lit(section).alias("section"), (F.lit(name) if isinstance(name, str) else name).alias("name"), value.cast("string").alias("value"), share.alias("share"))
    total = by_type.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    typed = by_type.crossJoin(F.broadcast(total))  # one row
    parts = [row(total, "documents", "total", F.col("total")), row(typed, "documents by type", F.col("source_type"), F.col("n"), F.round(F.try_divide(F.col("n") * 100.0, F.col("total")), 2))]
    parts += [row(status, "jobs", n, F.col(f"n_{n}"), F.col(f"pct_{n}")) for n in ("ok", "paginating", "error", "pending")]
    parts += [row(recent, "requests", n, F.col(n)) for n in ("last_day", "last_week")]
    extra = spark.createDataFrame([*((k, v) for k, v in (sizes or {}).items())], "k string, v long")
    parts += [row(extra, "sizes", F.col("k"), format_bytes(F.col("v"))), row(spark.range(1), "version", "version", F.lit(version))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
