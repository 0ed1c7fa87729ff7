"""Structured pages: one JSON record a page, read as nested rows and written back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOX = "struct<x:double,y:double,w:double,h:double>"
FONT = "struct<name:string,family:string,weight:string,style:string,size:double>"
LINE = f"struct<wmode:int,bbox:{BOX},font:{FONT},x:double,y:double,text:string>"
BLOCK = f"struct<type:string,bbox:{BOX},lines:array<{LINE}>>"
FILL = f"struct<fill:string,bbox:{BOX},text:string>"
DRAWINGS = f"struct<fills:array<{FILL}>,borders:array<struct<color:string,width:double,count:int>>,frame:struct<color:string,width:double,bbox:{BOX}>>"
PAGE = f"struct<page:int,size:struct<width:double,height:double>,structured:struct<blocks:array<{BLOCK}>>,drawings:{DRAWINGS},text_prompt:string>"


def parsed(json: Column) -> Column:
    """A page record from its text; null for what is no JSON."""
    return F.from_json(json, PAGE, {"mode": "PERMISSIVE"})


def pages(spark: SparkSession, path: str) -> DataFrame:
    """path and page of every page_NNNN.json below a folder, whole files in parallel; page is null where a file is no JSON."""
    files = spark.read.option("wholetext", True).text(path, recursiveFileLookup=True, pathGlobFilter="*.json")
    return files.select(F.input_file_name().alias("path"), parsed(F.col("value")).alias("page"))


def blocks(of_pages: DataFrame, key: list[str], page: str = "page") -> DataFrame:
    """key, page_no, block (from 0), type, x, y, w, h, n_lines; pages without blocks give none."""
    each = of_pages.select(*key, F.col(f"{page}.page").alias("page_no"), F.posexplode(F.col(f"{page}.structured.blocks")).alias("block", "b"))
    return each.select(*key, "page_no", "block", "b.type", *[F.col(f"b.bbox.{c}").alias(c) for c in "xywh"], F.coalesce(F.size("b.lines"), F.lit(0)).alias("n_lines"))


def lines(of_pages: DataFrame, key: list[str], page: str = "page") -> DataFrame:
    """key, page_no, block, line, box, font and text of every text line."""
    each = of_pages.select(*key, F.col(f"{page}.page").alias("page_no"), F.posexplode(F.col(f"{page}.structured.blocks")).alias("block", "b"))
    each = each.filter("b.type = 'text'").select(*key, "page_no", "block", F.posexplode("b.lines").alias("line", "l"))
    return each.select(*key, "page_no", "block", "line", *[F.col(f"l.bbox.{c}").alias(c) for c in "xywh"], F.col("l.font.name").alias("font"), F.col("l.font.size").alias("size"), (F.col("l.font.weight") == "bold").alias("bold"), (F.col("l.font.style") == "italic").alias("italic"), "l.text")


def fills(of_pages: DataFrame, key: list[str], page: str = "page") -> DataFrame:
    each = of_pages.select(*key, F.col(f"{page}.page").alias("page_no"), F.posexplode(F.col(f"{page}.drawings.fills")).alias("f", "d"))
    return each.select(*key, "page_no", "f", "d.fill", *[F.col(f"d.bbox.{c}").alias(c) for c in "xywh"], "d.text")


def box(x: str, y: str, w: str, h: str) -> Column:
    return F.struct(*[F.round(F.col(c).cast("double"), 2).alias(k) for c, k in zip((x, y, w, h), "xywh", strict=True)])


def assembled(of_lines: DataFrame, size: DataFrame, key: list[str], images: DataFrame | None = None, of_fills: DataFrame | None = None) -> DataFrame:
    """key, page, json: page records from lines (block, n, x, y, w, h, font, size, bold, italic, text), page sizes, images and fills.

    A page's records meet by key, so a page is the unit of memory.
    """
    font = F.struct(F.col("font").alias("name"), F.lit("sans-serif").alias("family"), F.when(F.col("bold"), "bold").otherwise("normal").alias("weight"), F.when(F.col("italic"), "italic").otherwise("normal").alias("style"), F.col("size").cast("double").alias("size"))
    line = F.struct(F.lit(0).alias("wmode"), box("x", "y", "w", "h").alias("bbox"), font.alias("font"), F.col("x").cast("double").alias("x"), (F.col("y") + F.col("h")).cast("double").alias("y"), F.col("text").alias("text"))
    right, low = F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h"))
    text = of_lines.groupBy(*key, "page", "block").agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("w"), (low - F.min("y")).alias("h"), F.array_sort(F.collect_list(F.struct("n", line.alias("l")))).alias("all"))
    rows = text.select(*key, "page", F.lit(0).alias("kind"), F.col("block").alias("at"), F.struct(F.lit("text").alias("type"), box("x", "y", "w", "h").alias("bbox"), F.col("all.l").alias("lines")).alias("b"))
    if images is not None:
        rows = rows.unionByName(images.select(*key, "page", F.lit(1).alias("kind"), F.col("i").alias("at"), F.struct(F.lit("image").alias("type"), box("x", "y", "w", "h").alias("bbox"), F.lit(None).cast(f"array<{LINE}>").alias("lines")).alias("b")))
    whole = rows.groupBy(*key, "page").agg(F.array_sort(F.collect_list(F.struct("kind", "at", "b"))).alias("blocks")).join(size, [*key, "page"])
    if of_fills is not None:
        drawn = of_fills.groupBy(*key, "page").agg(F.array_sort(F.collect_list(F.struct("f", F.struct("fill", box("x", "y", "w", "h").alias("bbox"), F.lit("").alias("text")).alias("d")))).alias("fills"))
        whole = whole.join(drawn, [*key, "page"], "left")
    else:
        whole = whole.withColumn("fills", F.lit(None).cast(f"array<struct<f:int,d:{FILL}>>"))
    record = F.struct(F.col("page").alias("page"), F.struct(F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height")).alias("size"), F.struct(F.col("blocks.b").alias("blocks")).alias("structured"), F.struct(F.col("fills.d").alias("fills")).alias("drawings"))
    return whole.select(*key, "page", F.to_json(record).alias("json"))


def write(of_pages: DataFrame, path: str, key: str) -> None:
    """(key, page, json) to a folder a document, a record a line."""
    of_pages.select(key, F.col("json").alias("value")).write.partitionBy(key).mode("overwrite").text(path)
