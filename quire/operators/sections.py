"""What is wrong with the sections of laid-out pages, as rows of a path, a severity and a message.

Sections are JSON: {"sections": [{"properties": {"type", "columns"}, "children": [..]}]}, children {"t": "p" | "h" | "image" | "bar" | "table"}, of a table
{"rows": [{"cells": [{"span", "children": [..]}]}]}. They are held as VARIANT and walked level by level: a round takes the children found by the one before, tells
what is wrong with them, and passes on the children of their cells. A level is a table; nothing is gathered by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.sources.store import stored

KINDS = ("p", "h", "image", "bar", "table")
#: Tables may lie in tables to this depth.
DEEPEST = 8


def kind(v: Column | str) -> Column:
    """array, object, void (a JSON null), or another type; null if there is nothing."""
    return F.lower(F.regexp_extract(F.schema_of_variant(v), "^[A-Za-z]+", 0))


def got(v: str, path: str, typed: str) -> Column:
    return F.try_variant_get(F.col(v), path, typed)


def exploded(rows: DataFrame, array: Column, name: str) -> DataFrame:
    """A row an element of a VARIANT array: its place under name, the element under v. What is no array has none."""
    return rows.select("*", F.posexplode(F.try_variant_get(array, "$", "array<variant>")).alias(name, "v"))


def issue(rows: DataFrame, path: Column, severity: str, message: Column | str) -> DataFrame:
    return rows.select("doc", path.alias("path"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"))


def issues(pages: DataFrame, deepest: int = DEEPEST) -> DataFrame:
    """doc, path, severity (error or warning), message of rows (doc, json). A sound page has none."""
    read = stored(pages.select("doc", F.try_parse_json("json").alias("root")))
    sections = F.try_variant_get("root", "$.sections", "variant")
    listed = read.withColumn("sections", sections)
    count = F.size(F.try_variant_get("sections", "$", "array<variant>"))
    here = F.lit("sections")
    found = [
        issue(listed.filter("root is null"), here, "error", "is no JSON"),
        issue(listed.filter(F.col("root").isNotNull() & (F.coalesce(kind("sections"), F.lit("")) != "array")), here, "error", "is no list"),
        issue(listed.filter((kind("sections") == "array") & (count == 0)), here, "error", "is empty, so the page would be blank"),
    ]
    each = exploded(listed.select("doc", "sections"), F.col("sections"), "i").withColumn("path", F.concat(F.lit("sections["), "i", F.lit("]")))
    is_object = kind("v") == "object"
    found += [
        issue(each.filter(~is_object), F.col("path"), "error", "is no object"),
        issue(each.filter(is_object & (F.col("i") > 0) & (F.coalesce(got("v", "$.properties.type", "string"), F.lit("")) != "continuous")), F.col("path"), "warning", "begins a new page"),
    ]
    level = each.filter(is_object).select("doc", F.concat("path", F.lit(".children")).alias("path"), got("v", "$.children", "variant").alias("list"), (F.coalesce(got("v", "$.properties.columns", "int"), F.lit(1)) > 1).alias("columns"))
    for depth in range(deepest + 1):
        level = stored(level)
        if level.isEmpty():
            break
        found.append(issue(level.filter(F.coalesce(kind("list"), F.lit("")) != "array"), F.col("path"), "error", "is no list"))
        child = exploded(level, F.col("list"), "i").withColumn("at", F.concat("path", F.lit("["), "i", F.lit("]"))).drop("path", "list", "i")
        child = stored(child.withColumns({"is": kind("v"), "t": got("v", "$.t", "string"), "rows": F.try_variant_get("v", "$.rows", "variant")}))
        known = F.col("t").isin(*KINDS)
        table = (F.col("is") == "object") & (F.col("t") == "table")
        found += [
            issue(child.filter("is = 'void'"), F.col("at"), "error", "is null"),
            issue(child.filter("is = 'array'"), F.col("at"), "error", "is a list in a list"),
            issue(child.filter(~F.col("is").isin("void", "array", "object") | (F.col("is") == "object") & ~F.coalesce(known, F.lit(False))), F.col("at"), "error", F.concat(F.lit("is of no known kind: "), F.coalesce("t", "is"))),
            issue(child.filter(table & F.col("columns")), F.col("at"), "warning", "is a table in a section of columns"),
        ]
        if depth == deepest:
            found.append(issue(child.filter(table), F.col("at"), "error", f"lies deeper than {deepest} tables"))
            break
        row = exploded(child.filter(table).select("doc", "at", "rows"), F.col("rows"), "r").select("doc", F.col("at").alias("table"), F.concat("at", F.lit(".rows["), "r", F.lit("]")).alias("at"), got("v", "$.cells", "variant").alias("cells"))
        cell = stored(exploded(row, F.col("cells"), "c").select("doc", "table", F.col("at").alias("row"), F.concat("at", F.lit(".cells["), "c", F.lit("]")).alias("at"), F.coalesce(got("v", "$.span", "int"), F.lit(1)).alias("span"), got("v", "$.children", "variant").alias("children")))
        width = cell.groupBy("doc", "table", "row").agg(F.sum("span").alias("width"))
        most = width.groupBy("doc", "table").agg(F.max("width").alias("most"))
        size = F.coalesce(F.size(F.try_variant_get("children", "$", "array<variant>")), F.lit(0))
        found += [
            issue(width.join(most, ["doc", "table"]).filter("width < most"), F.col("row"), "warning", F.concat(F.lit("spans "), "width", F.lit(" columns of "), "most")),
            issue(cell.filter(size <= 0), F.col("at"), "warning", "is an empty cell"),
        ]
        level = cell.filter(size > 0).select("doc", F.concat("at", F.lit(".children")).alias("path"), F.col("children").alias("list"), F.lit(False).alias("columns"))
    return reduce(DataFrame.unionByName, found)
