"""Points in rectangles as an equi-join on tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A side of a rectangle is covered by so many tiles, and one or two more where it begins and ends within one.
TILES = 4


def placed_in(points: DataFrame, rects: DataFrame, keys: list[str], x: str = "px", y: str = "py") -> DataFrame:
    """points joined with the rectangles (x0, y0, x1, y1; borders belong to them) of equal keys that hold them, each pair once.

    Tiles are powers of two, chosen for each rectangle by its width and its height. A point lies in one tile of each size that some rectangle has, so a pair
    meets once, and a point is compared only with rectangles whose tiles it shares: points tried grow with points found, however many a page has. Rows with nulls match nothing.
    """
    side = lambda a, b: F.greatest(F.ceil(F.log2(F.greatest((F.col(b) - F.col(a)) / TILES, F.lit(1.0)))), F.lit(0)).cast("int")
    tile = lambda v, k: F.floor(v / F.pow(F.lit(2.0), k)).cast("long")
    sized = rects.filter("x0 <= x1 and y0 <= y1").withColumns({"_kx": side("x0", "x1"), "_ky": side("y0", "y1")})
    across = lambda a, b, k: F.sequence(tile(F.col(a), F.col(k)), tile(F.col(b), F.col(k)))
    cut = sized.withColumn("_tx", F.explode(across("x0", "x1", "_kx"))).withColumn("_ty", F.explode(across("y0", "y1", "_ky")))
    sizes = [(r["_kx"], r["_ky"]) for r in sized.select("_kx", "_ky").distinct().collect()]
    if not sizes:
        return points.join(rects, keys).limit(0)
    every: Column = F.array(*[F.struct(F.lit(a).alias("_kx"), F.lit(b).alias("_ky")) for a, b in sorted(sizes)])
    spread = points.withColumn("_k", F.explode(every)).withColumns({"_kx": F.col("_k._kx"), "_ky": F.col("_k._ky")}).drop("_k")
    spread = spread.withColumns({"_tx": tile(F.col(x), F.col("_kx")), "_ty": tile(F.col(y), F.col("_ky"))})
    tiles = ["_kx", "_ky", "_tx", "_ty"]
    return spread.join(cut, [*keys, *tiles]).filter(F.col(x).between(F.col("x0"), F.col("x1")) & F.col(y).between(F.col("y0"), F.col("y1"))).drop(*tiles)
