"""Points in intervals as an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Whole numbers from 0 below 2 ** BITS.
BITS = 31


def blocks(lo: Column, hi: Column) -> Column:
    """The dyadic blocks that make up lo to hi, both within: array of (k, b), which stands for b * 2^k up to (b + 1) * 2^k; two of a size at most."""

    def of_size(k: Column) -> Column:
        shift = lambda name, x: F.call_function(name, x, k)
        left = shift("shiftright", lo + shift("shiftleft", F.lit(1).cast("long")) - 1)
        right = shift("shiftright", hi + 1)
        first = F.when((left < right) & (left % 2 == 1), F.struct(k.cast("int").alias("k"), left.alias("b")))
        last = F.when((left < right) & (right % 2 == 1), F.struct(k.cast("int").alias("k"), (right - 1).alias("b")))
        return F.array(first, last)

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(BITS)), of_size)), lambda s: s.isNotNull())


def covering(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at", lo: str = "lo", hi: str = "hi") -> DataFrame:
    """points joined with the intervals of equal keys that hold them: lo <= at <= hi, each pair once.

    Intervals fall into dyadic blocks, points into the one block of each size that has them, so pairs meet by equality and nothing is
    compared that does not match. Sizes that no interval has are left out. Rows with nulls in these columns match nothing.
    """
    cut = intervals.filter(F.col(lo) <= F.col(hi)).withColumn("_c", F.explode(blocks(F.col(lo).cast("long"), F.col(hi).cast("long"))))
    sizes = sorted(r["k"] for r in cut.select("_c.k").distinct().collect())
    if not sizes:
        return points.join(intervals, keys).limit(0)
    spread = points.withColumn("_k", F.explode(F.array(*map(F.lit, sizes)))).withColumn("_b", F.call_function("shiftright", F.col(at).cast("long"), F.col("_k")))
    return spread.join(cut.withColumns({"_k": F.col("_c.k"), "_b": F.col("_c.b")}).drop("_c"), [*keys, "_k", "_b"]).drop("_k", "_b")
