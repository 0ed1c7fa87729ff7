"""What the operators of this subpackage share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; without a name one of our own, in local mode only."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='quire-')}"
        sc.setCheckpointDir(found)
    return found


def saved(df: DataFrame) -> DataFrame:
    """Written as a table to the shared folder and read back, which cuts lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/quire-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes what saved() wrote, once no result reads it any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each lengthened until no column of df has it in any case, for columns that are added for a while."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"{name}_"
        taken.add(name.lower())
        out.append(name)
    return out


def freed(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of queries that are over, which it does as their plans are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, use) -> Column:
    """use(value) with value evaluated once, also where use refers to it inside a lambda."""
    return F.transform(F.array(value), use)[0]


#: Rows and bytes that a broadcast side may have; beyond them the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def weight(df: DataFrame) -> Column:
    """About how many bytes a row holds."""
    out = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0)) + 8
        elif kind.startswith(("array", "map", "struct")):
            out = out + F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        else:
            out = out + 8
    return out


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """df, hinted for broadcast if a look at it shows that it has at most so many rows and bytes."""
    seen = df.limit(rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(weight(df)), F.lit(0)).alias("b")).first()
    return F.broadcast(df) if seen["n"] <= rows and seen["b"] <= size else df


def ranked(df: DataFrame, keys: list[str], total: str | None = None) -> DataFrame:
    """Adds pos (0-based rank by keys) and, for a column total, cum (its inclusive running sum).

    Rows are dealt by range of the keys, so a frequent key value is split wherever later keys differ;
    only one count per partition reaches the driver.
    """
    dealt = saved(df.repartitionByRange(*[F.col(k).asc_nulls_first() for k in keys]).withColumn("_pid", F.spark_partition_id()))
    what = F.col(total) if total else F.lit(0).cast("long")
    sums = {r["_pid"]: (r["n"], r["s"]) for r in dealt.groupBy("_pid").agg(F.count("*").alias("n"), F.sum(what).alias("s")).collect()}
    offsets, n, s = [], 0, 0
    for pid in sorted(sums):
        offsets.append((pid, n, s))
        n, s = n + sums[pid][0], s + sums[pid][1]
    before = df.sparkSession.createDataFrame(offsets, "_pid int, _n long, _s long")
    w = Window.partitionBy("_pid").orderBy(*[F.col(k).asc_nulls_first() for k in keys])
    out = dealt.withColumn("_row", F.row_number().over(w))
    if total:
        out = out.withColumn("_run", F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.join(F.broadcast(before), "_pid")
    out = out.withColumn("pos", F.col("_n") + F.col("_row") - 1)
    if total:
        out = out.withColumn("cum", F.col("_s") + F.col("_run"))
    return out.drop("_pid", "_n", "_s", "_row", "_run")
