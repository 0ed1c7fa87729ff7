"""Tables written to the folder that driver and executors share, between steps that read them several times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where none is named, in local mode only, a new one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder")
    context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='quire-')}")
    return context.getCheckpointDir()


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """df, computed once: written as Parquet to the shared folder and read back. Later steps, and tasks that run again, read the files. by: a column with a folder
    for each value, so that steps which filter on it read their rows only."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    out = df.write.partitionBy(by) if by else df.write
    out.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    # the column of the folders is read last
    return kept.select(*df.columns) if by else kept


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    """df, computed once and dealt by the keys into buckets: joins, groups and windows of tables with equal keys and buckets need no shuffle. Only while
    it is written is the table in the catalogue."""
    spark = df.sparkSession
    name, path = f"quire_{uuid.uuid4().hex}", f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).option("path", path).saveAsTable(name)
    try:
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def buckets_for(path: str, spark: SparkSession, each: int) -> int:
    """How many buckets tables made from the one at path get: one for so many bytes of it, so that what a task holds doesn't grow with it, but no fewer than a
    session's shuffles have partitions."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getContentSummary(at).getLength()
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // each))
