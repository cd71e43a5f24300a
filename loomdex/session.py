"""Session helpers: table loading and lineage cuts that survive executor loss."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its input has fewer splits than there are cores (a small file read by expensive expressions);
    an input with more splits, as any large one has, is left as it is and not shuffled."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """One table of a data directory; ``columns`` prunes the Parquet scan. ``TIMESTAMP_NTZ`` columns are read
    as UTC instants, so that results do not depend on the session time zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if columns:
        df = df.select(*columns)
    ntz = {f.name: F.to_timestamp(f.name) for f in df.schema.fields if isinstance(f.dataType, T.TimestampNTZType)}
    return df.withColumns(ntz) if ntz else df


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts. The cluster names it in ``spark.checkpoint.dir``; only where that is
    unset (tests, local runs) a temporary folder is used."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return named or current.get()
    if named is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="loomdex-ck-")
    sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder and forget how it was made."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def valid_zones(spark: SparkSession) -> list[str]:
    """Names of all time zones this JVM knows, so that no zone text from the data can make a task fail."""
    jvm = spark._jvm
    return str(jvm.java.lang.String.join(",", jvm.java.time.ZoneId.getAvailableZoneIds())).split(",")
