"""Table sources and sinks: files with fixed schemas, a partitioned store, a database, upserts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from orrery.sources.shared import kept

FORMATS = ("parquet", "csv", "json", "orc")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read(spark: SparkSession, path: str, fmt: str, schema: StructType) -> DataFrame:
    """Q1: a table of files under a given schema; nothing is inferred."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).format(fmt).load(path)


def write(df: DataFrame, path: str, fmt: str, mode: str = "errorifexists") -> None:
    """Q1: the counterpart of `read`."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    writer = df.write.mode(mode).format(fmt)
    (writer.option("header", True) if fmt == "csv" else writer).save(path)


def store(df: DataFrame, path: str, by: list[str], mode: str = "overwrite") -> DataFrame:
    """Write a table partitioned by `by`, and give it back as it is stored. Rows of a
    partition are brought together first, so that each has few files; Spark splits large ones."""
    df.hint("rebalance", *by).write.mode(mode).partitionBy(*by).parquet(path)
    return df.sparkSession.read.parquet(path)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """Of each key the row with the latest `ts`; at equal times the new batch wins. Old rows
    without a match stay. Applying the same batch again changes nothing."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in (*keys, ts)]
    order = [F.col(ts).desc_nulls_last(), F.col("_new").desc(), *[F.col(c).desc_nulls_last() for c in rest]]
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return both.withColumn("_n", first).where("_n = 1").select(*old.columns)


def upsert_store(new: DataFrame, path: str, keys: list[str], ts: str, by: list[str]) -> DataFrame:
    """P17 on a stored table (see store): as upsert, but only the partitions that the batch touches are
    read and replaced; files of all others stay as they are. `by` is part of the keys, so a key
    stays in its partition. The merged rows are written to the shared folder before any old file is
    replaced; a batch that is applied again changes nothing."""
    if not set(by) <= set(keys):
        raise ValueError("partition columns must be keys: else a key's old row lies in a partition that isn't read")
    spark = new.sparkSession
    old = spark.read.parquet(path)
    new = kept(new.select(*old.columns), "batch")
    touched = F.broadcast(new.select(*by).distinct())  # a row per partition that the batch touches
    merged = kept(upsert(old.join(touched, by, "left_semi"), new, keys, ts), "merged")
    merged.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
    return spark.read.parquet(path)


def jdbc_options(url: str, name: str, driver: str | None = None, batch: int = 10_000) -> dict[str, str]:
    """The options that both directions share."""
    options = {"url": url, "dbtable": name, "batchsize": str(batch), "fetchsize": str(batch)}
    return options | ({"driver": driver} if driver else {})


def from_jdbc(spark: SparkSession, url: str, name: str, partition_col: str, lower: int, upper: int, parts: int, driver: str | None = None) -> DataFrameReader:
    """A reader that takes the table in `parts` ranges of `partition_col`; call .load()."""
    ranges = {"partitionColumn": partition_col, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(parts)}
    return spark.read.format("jdbc").options(**jdbc_options(url, name, driver), **ranges)


def to_jdbc(df: DataFrame, url: str, name: str, parts: int, driver: str | None = None):
    """A writer over at most `parts` connections; call .save()."""
    return df.coalesce(parts).write.format("jdbc").mode("append").options(**jdbc_options(url, name, driver))


def in_transaction(spark: SparkSession, url: str, statements: list[str], driver: str | None = None) -> None:
    """Statements that take effect together, or not at all."""
    java = spark.sparkContext._jvm
    if driver:
        java.java.lang.Class.forName(driver)
    connection = java.java.sql.DriverManager.getConnection(url)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in statements:
            statement.executeUpdate(text)
        connection.commit()
    except Exception:
        connection.rollback()
        raise
    finally:
        connection.close()


def put_jdbc(df: DataFrame, url: str, name: str, keys: list[str], parts: int, driver: str | None = None, types: str | None = None) -> None:
    """Put rows into a database table, made if absent: rows with their keys are replaced, others stay.
    Tasks append to a staging table of this call; then one transaction deletes the keys' old rows
    and moves the distinct new ones. So a task that Spark runs twice adds no row, a call that fails
    leaves the table as it was, and one that is repeated changes nothing. Keys are unique in `df`
    and not null. `types` names column types of a new table, where a database can't compare what
    Spark would choose."""
    spark = df.sparkSession
    stage = f"{name}_stage_{uuid.uuid4().hex[:12]}"
    for rows, table_name, tasks in ((df.limit(0), name, 1), (df, stage, parts)):
        writer = to_jdbc(rows, url, table_name, tasks, driver)
        (writer.option("createTableColumnTypes", types) if types else writer).save()
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier
    same = " and ".join(f"{stage}.{quoted(k)} = {name}.{quoted(k)}" for k in keys)
    columns = ", ".join(map(quoted, df.columns))
    try:
        in_transaction(spark, url, [f"delete from {name} where exists (select 1 from {stage} where {same})", f"insert into {name} ({columns}) select distinct {columns} from {stage}"], driver)
    finally:
        in_transaction(spark, url, [f"drop table {stage}"], driver)


def ingest(spark: SparkSession, path: str, schema: StructType, sink: str, checkpoint: str) -> StreamingQuery:
    """Q7: take in the files that came since the last call, then stop. The checkpoint remembers
    what was read, so a call after a failure goes on where the last one stopped."""
    stream = spark.readStream.schema(schema).parquet(path)
    return stream.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
