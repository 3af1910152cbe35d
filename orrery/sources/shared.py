"""The folder that driver and executors share, and tables kept there for later steps."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where the setting is absent and everything runs in
    one process (tests, local mode) a fresh temporary folder takes its place; on a cluster, where
    executors wouldn't see such a folder, that is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="orrery-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the session's file system closes."""
    path = f"{shared_dir(spark)}/orrery-{name}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


#: Bytes a core, by Spark's estimate, below which a table may be a single part.
SMALL = 32 << 20


def spread(df: DataFrame) -> DataFrame:
    """The rows over all cores, where Spark's estimate of the table is small: a small file is often a single
    part, whatever its rows cost. Larger tables stay as they are. Nothing is run to decide."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if size < SMALL * cores else df


def evenly(df: DataFrame) -> DataFrame:
    """The rows dealt evenly to as many tasks as there are shuffle partitions: for narrow rows that each
    stand for much work to come."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, lets several
    later steps read it, and outlives lost executors."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Remove kept tables that nothing reads any more, so that a long job's steps don't add up on the
    shared disk. What was made from them must have been written."""
    for df in tables:
        files = df.inputFiles()
        if files and "/orrery-" in files[0]:
            spark = df.sparkSession
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Places of the table of bits that names rows by their keys, as a power of two.
PLACES = 24


def told_by_bits(rows: DataFrame, wanted: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows that may have the keys `by` of some row of `wanted`: all that have, and few others; and
    the rows left. A table of bits, of fixed size, tells them where they are read, so that an exact
    join of the first ones shuffles no others. That should be an inner join: Spark would move a semi
    join to before the bits."""
    place, bit = F.shiftrightunsigned(F.xxhash64(*by), 64 - PLACES), F.expr("shiftleft(1L, cast(_place & 63 as int))")
    cell = F.shiftright("_place", 6)
    cells = kept(wanted.select(place.alias("_place")).groupBy(cell.alias("_cell")).agg(F.bit_or(bit).alias("_bits")), "cells")  # at most 2^(PLACES - 6) rows
    marked = rows.withColumn("_place", place).withColumn("_cell", cell).join(F.broadcast(cells), "_cell", "left")
    there = F.coalesce("_bits", F.lit(0)).bitwiseAND(bit) != 0
    return tuple(marked.where(x).drop("_place", "_cell", "_bits") for x in (there, ~there))
