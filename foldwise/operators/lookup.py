"""Lookup tables: one row a key, broadcast where their size allows.

A table of group statistics is small in most data and unbounded in principle.
``bounded`` computes it once, counts it, and marks it for broadcast up to
``LOOKUP_ROWS`` rows, so that the data isn't shuffled on a key of few values.
A larger table is left to a shuffled join: it has a row a key, so the skew join
splits a hot key's rows of the data.
"""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.session import ensure_checkpoint_dir, scratch_path

#: rows of a lookup table that is broadcast; at some tens of bytes a row, a few MB
LOOKUP_ROWS = 100_000


def bounded(table: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """``table``, computed and kept once, with a broadcast hint if it has at most ``rows`` rows."""
    if held(table):  # few rows: nothing but these is computed
        local = table.toArrow()
        return F.broadcast(table.sparkSession.createDataFrame(local, table.schema).coalesce(1)) if local.num_rows <= rows else table.checkpoint()
    kept = table.checkpoint()
    return F.broadcast(kept) if kept.limit(rows + 1).count() <= rows else kept


#: rows of a table that ``tiny`` brings to the driver: k folds x columns, or one row
TINY_ROWS = 10_000


def tiny(table: DataFrame) -> DataFrame:
    """A table whose rows are bounded by folds and columns, computed once and held by the plan
    itself, in one partition: what is derived from it needs no shuffle and no second job.
    More than ``TINY_ROWS`` rows raise an error."""
    rows = table.limit(TINY_ROWS + 1).toArrow()
    if rows.num_rows > TINY_ROWS:
        raise ValueError(f"a table of statistics has more than {TINY_ROWS} rows")
    return table.sparkSession.createDataFrame(rows, table.schema).coalesce(1)


def small(table: DataFrame) -> DataFrame:
    """``table`` computed and kept once; held by the plan (see ``tiny``) if it has few rows."""
    kept = table.checkpoint()
    rows = kept.limit(TINY_ROWS + 1).toArrow()
    return table.sparkSession.createDataFrame(rows, kept.schema).coalesce(1) if rows.num_rows <= TINY_ROWS else kept


def held(df: DataFrame) -> bool:
    """Whether all that ``df`` reads is held by its plan."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    return all(leaves.apply(i).nodeName() == "LocalRelation" for i in range(leaves.size()))


#: bytes of the files behind a frame from which it is kept as columns
LARGE_BYTES = 32 << 20

#: rows of a file of such a frame: a task reads several, as many as a split of Spark's size holds
FILE_ROWS = 50_000


def large(df: DataFrame) -> bool:
    """Whether the files that ``df`` reads are large."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(leaf.stats().sizeInBytes()) for leaf in files if leaf.nodeName() == "LogicalRelation") > LARGE_BYTES


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed and kept once: a large frame as Parquet in the checkpoint folder, a small one
    as a checkpoint.  A checkpoint has every row as an object with 8 bytes a number, and all of it
    is read whatever a reader needs; columns take a fraction of that.  See ``discard``."""
    if not large(df):
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint()
    spark = df.sparkSession
    path = scratch_path(spark, "kept")
    df.write.option("maxRecordsPerFile", FILE_ROWS).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete what ``kept`` wrote of large frames that ``frames`` read, and let Spark delete shuffle
    files that nothing refers to: nothing made of these frames can be computed any more."""
    folders = {}
    for df in frames:
        if large(df):
            folders |= {path.rsplit("/", 1)[0]: df.sparkSession for path in df.inputFiles() if "/foldwise-scratch/kept-" in path}
    for folder, spark in folders.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if folders:
        gc.collect()
        spark._jvm.System.gc()


#: rows of a partition of a kept frame that fits read; at some 150 bytes a row, 150 MB
PART_ROWS = 1_000_000


#: rows that are worth a task of their own where a core would be idle
TASK_ROWS = 50_000


def dealt(df: DataFrame) -> DataFrame:
    """``df`` computed and kept once, in partitions of about ``PART_ROWS`` rows at most, and a
    large frame in one a core at least, none much fuller than the others: splits of a small-column
    file hold as many rows as its row groups do, some millions or none, and the tasks of all that
    reads the frame would grow with them while other cores are idle.  The files of a frame that
    is kept as columns have few rows each, and Spark deals them to tasks by their size."""
    if large(df):
        return kept(df)
    ensure_checkpoint_dir(df.sparkSession)
    own = df.checkpoint()
    rows = [r["count"] for r in own.groupBy(F.spark_partition_id().alias("p")).count().collect()]  # a number a partition
    n, cores = sum(rows), df.sparkSession.sparkContext.defaultParallelism
    parts = max(-(-n // PART_ROWS), min(cores, n // TASK_ROWS))
    return own.repartition(parts).checkpoint() if n > TASK_ROWS and max(rows) > 1.25 * n / parts or parts > own.rdd.getNumPartitions() else own


def spread(df: DataFrame) -> DataFrame:
    """``df`` computed and kept once, in two partitions a core at least: a small file or a
    coalesced shuffle leaves a few, and what expands them would run in as few tasks."""
    if large(df):
        return kept(df)
    ensure_checkpoint_dir(df.sparkSession)
    own = df.checkpoint()
    cores = df.sparkSession.sparkContext.defaultParallelism
    return own if own.rdd.getNumPartitions() >= cores else own.repartition(2 * cores).checkpoint()
