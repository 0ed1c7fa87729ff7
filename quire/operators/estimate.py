"""Where the blocks of Word packages fall on pages, estimated from runs, styles, sections and tables without a layout engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.operators import flow
from quire.sources import packages
from quire.sources.store import stored

#: Fixed values, in points: least room of a paragraph and of a cell, what a cell's margins take, what a row has beyond its text, least length of turned text.
LEAST_ROOM, LEAST_CELL, MARGINS, ROW_EXTRA, TURNED = 36.0, 20.0, 10.8, 4.0, 200.0
#: Page and margins where a body tells none.
PAGE = {"page_w_pt": 612.0, "page_h_pt": 792.0, "top_pt": 72.0, "bottom_pt": 72.0, "left_pt": 72.0, "right_pt": 72.0, "col_space_pt": 36.0, "columns": 1}


def geometry(of_nodes: DataFrame) -> DataFrame:
    """path, ends (ids where sections end, in order) and places (room in width and height, and columns, of each)."""
    width = (F.col("page_w_pt") - F.col("left_pt") - F.col("right_pt") - (F.col("columns") - 1) * F.col("col_space_pt")) / F.col("columns")
    one = F.struct("id", width.alias("w"), (F.col("page_h_pt") - F.col("top_pt") - F.col("bottom_pt")).alias("h"), "columns")
    held = packages.sections(of_nodes).withColumn("columns", F.greatest("columns", F.lit(1))).groupBy("path").agg(F.array_sort(F.collect_list(one)).alias("places"))
    return held.select("path", F.col("places.id").alias("ends"), "places")


def sectioned(blocks: DataFrame, of_nodes: DataFrame) -> DataFrame:
    """blocks (path, id) with section (from 0), w, h and columns: a block belongs to the first section that ends below it, else to the last."""
    usual = F.struct(F.lit(-1).alias("id"), F.lit(PAGE["page_w_pt"] - PAGE["left_pt"] - PAGE["right_pt"]).alias("w"), F.lit(PAGE["page_h_pt"] - PAGE["top_pt"] - PAGE["bottom_pt"]).alias("h"), F.lit(PAGE["columns"]).alias("columns"))
    joined = blocks.join(geometry(of_nodes), "path", "left")
    section = F.least(F.size(F.filter(F.coalesce("ends", F.array().cast("array<int>")), lambda e: e < F.col("id"))), F.greatest(F.size("ends") - 1, F.lit(0)))
    place = F.coalesce(F.get("places", F.col("section")), usual)
    return joined.withColumn("section", section).withColumn("place", place).select(*blocks.columns, "section", "place.w", "place.h", "place.columns")


def paragraph_runs(of_nodes: DataFrame) -> DataFrame:
    """path, id (of the paragraph), runs for metrics.wrapped_runs, images, image_pt, page_break."""
    r = packages.runs(of_nodes)
    one = F.struct("r", F.struct("text", F.col("size_pt").alias("size"), "font", "bold").alias("run"))
    held = r.groupBy("path", F.col("p").alias("id")).agg(F.array_sort(F.collect_list(F.when((F.col("text") != "") | (F.col("images") > 0), one))).alias("rs"), F.sum("images").alias("images"), F.sum("image_pt").alias("image_pt"), F.bool_or("page_break").alias("page_break"))
    return held.select("path", "id", F.col("rs.run").alias("runs"), "images", "image_pt", "page_break")


def flow_rows(of_nodes: DataFrame) -> DataFrame:
    """path, block, id, kind and what flow.pagination needs: a row for each paragraph of the body and for each row of a table of the body. Nodes and runs are
    written out, as many steps read them."""
    of_nodes = stored(of_nodes.filter(F.col("part").isin(packages.MAIN, packages.STYLES) | F.col("part").startswith("word/theme/")), by="tag")
    main = of_nodes.filter(F.col("part") == packages.MAIN)
    runs = stored(paragraph_runs(of_nodes))
    props = packages.paragraph_properties(of_nodes).groupBy("path", "id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))
    number = lambda k, usual: F.coalesce(F.col("props")[k].cast("double"), F.lit(usual))
    every = stored(main.filter("tag = 'p'").select("path", "id", "tbl", "tc").join(runs, ["path", "id"], "left").join(props, ["path", "id"], "left"))

    body = sectioned(every.filter("tbl is null"), of_nodes)
    room = F.greatest(F.col("w") - number("indent_left_pt", 0.0) - number("indent_right_pt", 0.0), F.lit(LEAST_ROOM))
    wrapped = body.withColumn("of", metrics.wrapped_runs(F.col("runs"), room))
    line_h: Column = F.coalesce(F.nullif(number("line_pt", 0.0), F.lit(0.0)), F.col("of.size") * metrics.line_height(F.col("of.font")) * number("line_mult", 1.0))
    forced = F.coalesce("page_break", F.lit(False))
    texts = wrapped.select("path", F.col("id").alias("block"), "id", F.lit("text").alias("kind"), "section", F.col("of.lines").alias("lines"), line_h.alias("line_h"), number("space_before_pt", 0.0).alias("before"), number("space_after_pt", 0.0).alias("after"), F.coalesce("image_pt", F.lit(0.0)).alias("extra"), forced.alias("forced"), "columns", F.col("h").alias("room"))

    top = main.filter("tag = 'tbl' and tc is null").select("path", F.col("id").alias("tbl"))
    grid = main.filter("tag = 'gridCol'").groupBy("path", "tbl").agg((F.sum(F.coalesce(F.col("attrs")["w"].try_cast("double"), F.lit(0.0))) / 20).alias("grid"), F.count("*").alias("n"))
    turned = main.filter("tag = 'textDirection' and tc is not null").select("path", "tc").distinct().withColumn("turned", F.col("tc").isNotNull())
    own = packages.cells(of_nodes).join(top, ["path", "tbl"], "left_semi")
    first = own.groupBy("path", "tbl", "tr").agg(F.count("*").alias("c")).groupBy("path", "tbl").agg(F.min_by("c", "tr").alias("first"))
    sized = own.join(grid, ["path", "tbl"], "left").join(first, ["path", "tbl"]).join(turned, ["path", "tc"], "left")
    width = F.coalesce(F.nullif("width_pt", F.lit(0.0)), F.coalesce("grid", F.lit(0.0)) / F.coalesce("n", "first"))
    width = F.when(F.coalesce("turned", F.lit(False)), F.greatest(width, F.lit(TURNED))).otherwise(width)
    room = F.greatest(F.col("width") - MARGINS, F.lit(LEAST_CELL))
    inside = every.filter("tc is not null").select("path", "tc", "runs").join(sized.select("path", "tc", width.alias("width")), ["path", "tc"])
    tall = inside.withColumn("of", metrics.wrapped_runs(F.col("runs"), room)).groupBy("path", "tc").agg(F.sum(F.col("of.lines") * F.col("of.size") * metrics.line_height(F.col("of.font"))).alias("text_pt"))
    pictures = every.filter("tc is not null and image_pt > 0").groupBy("path", "tc").agg(F.sum("image_pt").alias("image_pt"))
    pictures = packages.enclosing_cells(of_nodes).join(pictures, ["path", "tc"]).groupBy("path", F.col("outer").alias("tc")).agg(F.sum("image_pt").alias("image_pt"))
    cell = own.join(tall, ["path", "tc"], "left").join(pictures, ["path", "tc"], "left")
    height = F.coalesce("text_pt", F.lit(0.0)) + F.coalesce("image_pt", F.lit(0.0)) + ROW_EXTRA
    lines = sectioned(cell.groupBy("path", F.col("tbl").alias("block"), F.col("tr").alias("id")).agg(F.max(height).alias("line_h")), of_nodes)
    none = F.lit(0.0)
    units = lines.select("path", "block", "id", F.lit("unit").alias("kind"), "section", F.lit(1).alias("lines"), "line_h", none.alias("before"), none.alias("after"), none.alias("extra"), F.lit(False).alias("forced"), "columns", F.col("h").alias("room"))
    return texts.unionByName(units)


def placements(of_nodes: DataFrame, chunk: int = flow.CHUNK) -> DataFrame:
    """path, block, kind (paragraph or table), section, page, page_end, column (where it ends), lines (rows of a table), height_pt of the blocks of the body."""
    rows = stored(flow_rows(of_nodes))
    placed = flow.pagination(rows.withColumnRenamed("id", "n"), "path", chunk)
    of = rows.select("path", "section", F.col("id").alias("n"), "block", "kind", "lines", (F.col("lines") * F.col("line_h") + F.col("extra")).alias("height_pt"))
    joined = placed.join(of, ["path", "section", "n"])
    kind = F.when(F.col("kind") == "text", "paragraph").otherwise("table")
    return joined.groupBy("path", "section", "block", kind.alias("kind")).agg(F.min("page").alias("page"), F.max("page_end").alias("page_end"), F.max_by("column", "n").alias("column"), F.sum("lines").cast("int").alias("lines"), F.round(F.sum("height_pt"), 1).alias("height_pt"))
