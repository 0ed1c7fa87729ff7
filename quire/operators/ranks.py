"""Places in an order over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.sources.store import stored


def numbered(df: DataFrame, keys: list[str], name: str = "place") -> DataFrame:
    """df with the place (from 0) of each row in the order of keys, nulls first, equal rows in any order. No task sees more than a range of the keys;
    of each range its number of rows reaches the driver."""
    order = [F.col(k).asc_nulls_first() for k in keys] + [F.col("_tie")]
    ranges = stored(df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    base, first = 0, []
    for r in ranges.groupBy("_range").count().orderBy("_range").collect():
        first.append((r["_range"], base))
        base += r["count"]
    begins = F.broadcast(df.sparkSession.createDataFrame(first, "_range int, _base long"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return ranges.withColumn("_within", within).join(begins, "_range").withColumn(name, F.col("_base") + F.col("_within")).drop("_tie", "_range", "_within", "_base")
