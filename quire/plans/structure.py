"""Queries over what has depth or flows: Markdown blocks, tables in tables, runs, wrapped lines and pages. Oracles start from the lines of the documents and step
through them one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.operators import markdown, placing, sections
from quire.sources import packages
from quire.sources.store import buckets_for, stored

from . import fixture, text_of


def oracle(needs: list[str], sql: str) -> str:
    """SQL over fixtures; those with recursion are named so before the first table."""
    out = text_of(needs, sql, "duck")
    return out.replace("WITH ", "WITH RECURSIVE ", 1) if "RECURSIVE" not in out else out


# ---- Markdown


def markdown_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of documents, dressed as headings, nested items, tables, fenced code and text."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda s: s["line"])
    return fixture(spark, sf_dir, "markdown_lines").groupBy(F.col("doc_id").alias("doc")).agg(F.array_join(lines, "\n").alias("text"))


def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.blocks(markdown_texts(spark, sf_dir)).select(F.col("doc").alias("doc_id"), "block", "parent", "kind", "level", "ordered", "first", "text")


MARKDOWN = r"""
, l AS (SELECT doc_id, n, line AS raw, trim(line) AS t, length(line) - length(ltrim(line)) AS indent, trim(line) LIKE '%|%' AS pipe,
    regexp_extract(trim(line), '^(`{3,}|~{3,})') AS fence, trim(regexp_extract(trim(line), '^(?:`{3,}|~{3,})(.*)$', 1)) AS info,
    regexp_extract(trim(line), '^([-*+]|[0-9]+[.)])\s+', 0) AS mark,
    coalesce(regexp_full_match(lead(line) OVER (PARTITION BY doc_id ORDER BY n), '\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*'), false) AS sep FROM markdown_lines),
s AS (SELECT doc_id, -1 AS n, 'start' AS act, 'none' AS leaf, 0 AS run, 0::BIGINT AS cur, 0::BIGINT AS count, [{'o': 0::BIGINT, 'b': 0::BIGINT}][1:0] AS items, NULL::BIGINT AS parent FROM (SELECT DISTINCT doc_id FROM l)
    UNION ALL SELECT doc_id, n, act,
        CASE WHEN act IN ('close', 'blank', 'heading', 'image') THEN 'none' WHEN act = 'table' THEN 'head' WHEN act = 'sep' THEN 'table' WHEN act = 'code' THEN fence[1] WHEN act IN ('item', 'paragraph') THEN 'text' ELSE leaf END,
        CASE WHEN act = 'code' THEN length(fence) ELSE run END,
        CASE WHEN opens THEN count ELSE cur END,
        count + CASE WHEN act = 'table' THEN 2 WHEN opens OR act = 'row' THEN 1 ELSE 0 END,
        CASE WHEN act = 'item' THEN list_append(kept, {'o': (indent + length(mark))::BIGINT, 'b': count}) ELSE kept END,
        kept[len(kept)].b
    FROM (SELECT *, CASE WHEN opens THEN list_filter(items, lambda x: x.o <= indent) ELSE items END AS kept FROM (SELECT *, act IN ('code', 'heading', 'table', 'item', 'image', 'paragraph') AS opens FROM (
        SELECT l.*, s.leaf, s.run, s.cur, s.count, s.items, CASE WHEN s.leaf IN ('`', '~') THEN CASE WHEN l.fence[1] = s.leaf AND length(l.fence) >= s.run AND l.info = '' THEN 'close' ELSE 'literal' END
            WHEN l.t = '' THEN 'blank' WHEN s.leaf = 'head' THEN 'sep' WHEN s.leaf = 'table' AND l.pipe THEN 'row' WHEN l.fence <> '' AND NOT (l.fence[1] = '`' AND l.info LIKE '%`%') THEN 'code'
            WHEN regexp_matches(l.t, '^#{1,6}\s+') THEN 'heading' WHEN l.pipe AND l.sep THEN 'table' WHEN l.mark <> '' THEN 'item' WHEN regexp_full_match(l.t, '!\[[^\]]*\]\([^)]+\)') THEN 'image' WHEN s.leaf = 'text' THEN 'more' ELSE 'paragraph' END AS act
        FROM s JOIN l ON l.doc_id = s.doc_id AND l.n = s.n + 1) AS a) AS b) AS c),
p AS (SELECT s.doc_id, s.n, s.act, CASE WHEN s.act = 'row' THEN s.count - 1 ELSE s.cur END AS block, CASE WHEN s.act = 'row' THEN s.cur ELSE s.parent END AS parent, l.t, l.raw, l.mark, len(s.items) AS deep FROM s JOIN l ON l.doc_id = s.doc_id AND l.n = s.n WHERE s.act NOT IN ('start', 'blank', 'close', 'sep')),
q AS (SELECT doc_id, n, block, parent, act AS kind, CASE WHEN act = 'heading' THEN length(regexp_extract(t, '^#+')) WHEN act = 'item' THEN deep END AS level, CASE WHEN act = 'item' THEN regexp_matches(mark, '^[0-9]') END AS ordered,
        CASE act WHEN 'heading' THEN trim(regexp_replace(t, '^#+', '')) WHEN 'item' THEN trim(substr(t, length(mark) + 1)) WHEN 'literal' THEN raw WHEN 'code' THEN NULL WHEN 'table' THEN NULL ELSE t END AS piece FROM p
    UNION ALL SELECT doc_id, n, block + 1, block, 'row', NULL, NULL, t FROM p WHERE act = 'table'),
k AS (SELECT doc_id, block, min(n) AS first, max(CASE WHEN kind NOT IN ('more', 'literal') THEN parent END) AS parent, max(CASE WHEN kind NOT IN ('more', 'literal') THEN kind END) AS kind, max(level) AS level, bool_or(ordered) AS ordered, list(piece ORDER BY n) FILTER (WHERE piece IS NOT NULL) AS body FROM q GROUP BY doc_id, block)
SELECT doc_id, block, parent, kind, CAST(level AS INT) AS level, ordered, first, CASE WHEN kind = 'code' THEN coalesce(array_to_string(body, chr(10)), '') WHEN kind = 'row' THEN array_to_string([trim(c) for c in string_split(regexp_replace(body[1], '^\||\|$', '', 'g'), '|')], chr(9))
    WHEN kind <> 'table' THEN trim(regexp_replace(array_to_string(body, ' '), '\s+', ' ', 'g')) END AS text FROM k"""

# ---- packages with tables in tables, styles, themes and sections

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", " ")


def paragraph(text: Column, section: str = "") -> Column:
    """In the style of the document, its first word bold and in a typeface of its own."""
    first = F.substring_index(text, " ", 1)
    rest = F.substring(text, F.length(first) + 2, F.length(text))
    run = lambda t: joined("<w:t xml:space='preserve'>", escaped(t), "</w:t></w:r>")
    return joined("<w:p><w:pPr><w:pStyle w:val='S", (F.col("doc_id") % 4).cast("string"), "'/>", section, "</w:pPr><w:r><w:rPr><w:b/><w:rFonts w:ascii='Georgia'/></w:rPr>", run(joined(first, " ")), F.when(rest != "", joined("<w:r>", run(rest))).otherwise(""), "</w:p>")


def cell(inside: Column, props: str = "") -> Column:
    return joined(f"<w:tc><w:tcPr><w:tcW w:w='4000' w:type='dxa'/>{props}</w:tcPr>", inside, "</w:tc>")


def row(*cells: Column) -> Column:
    return joined("<w:tr>", *cells, "</w:tr>")


def table(*rows: Column) -> Column:
    return joined("<w:tbl>", *rows, "</w:tbl>")


def line_xml(line: Column, n: Column) -> Column:
    """Line n as a paragraph, as tables three deep (n % 8 = 3), as a table with merged cells (n % 8 = 5), or as the end of a section of two columns (n % 20 = 10)."""
    first = F.substring_index(line, " ", 1)
    third = F.when(n % 16 == 3, table(row(cell(paragraph(line))))).otherwise("")
    deep = table(row(cell(paragraph(line)), cell(joined(table(row(cell(paragraph(first)), cell(joined(third, paragraph(F.lit("end")))))), "<w:p/>"))))
    merged = table(row(cell(paragraph(line), "<w:gridSpan w:val='2'/>")), row(cell(paragraph(first), "<w:vMerge w:val='restart'/>"), cell(paragraph(F.lit("")), "<w:vMerge/>")))
    return F.when(n % 8 == 3, deep).when(n % 8 == 5, merged).when(n % 20 == 10, paragraph(line, "<w:sectPr><w:cols w:num='2'/></w:sectPr>")).otherwise(paragraph(line))


STYLES = (
    "<w:style w:styleId='S0'/><w:style w:styleId='S1'><w:basedOn w:val='S0'/><w:rPr><w:sz w:val='28'/></w:rPr></w:style><w:style w:styleId='S2'><w:basedOn w:val='S1'/><w:rPr><w:i/></w:rPr></w:style>"
    "<w:style w:styleId='S3'><w:basedOn w:val='S2'/><w:pPr><w:spacing w:before='120' w:after='60'/><w:ind w:left='360'/></w:pPr></w:style></w:styles>"
)


#: Bytes of the documents on disk that a task makes packages of, so that tasks are many and alike.
TASK_BYTES = 8 << 20


def made_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, document, styles, theme: documents as packages, the contents of their parts. Every other one names its typeface through the theme, every third is
    landscape, styles go by doc_id % 4. Texts whose id is theirs alone are dressed where they lie; else the lines of an id are brought together."""
    path, d = f"{sf_dir}/documents.parquet", F.col("doc_id")
    documents = spark.read.parquet(path)
    if documents.groupBy("doc_id").count().filter("count > 1").isEmpty():
        few, tasks = int(spark.conf.get("spark.sql.shuffle.partitions")), buckets_for(path, spark, TASK_BYTES)
        texts = documents.select("doc_id", "text").filter("text is not null")
        dealt = texts.repartition(tasks, "doc_id") if tasks > few else texts.repartition("doc_id")
        bodies = dealt.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), lambda line, n: line_xml(line, n)), "").alias("body"))
    else:
        lines = fixture(spark, sf_dir, "raw_lines").select("doc_id", "n", line_xml(F.col("line"), F.col("n")).alias("xml"))
        bodies = lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "xml"))), lambda x: x["xml"]), "").alias("body"))
    last = joined("<w:sectPr>", F.when(d % 3 == 0, "<w:pgSz w:w='15840' w:h='12240'/>").otherwise(""), "<w:pgMar w:left='", (720 + 360 * (d % 3)).cast("string"), "'/></w:sectPr>")
    face = F.when(d % 2 == 0, "<w:rFonts w:ascii='Arial'/>").otherwise("<w:rFonts w:asciiTheme='minorHAnsi'/>")
    held = {
        "document": joined(f"<w:document {W}><w:body>", F.col("body"), last, "</w:body></w:document>"),
        "styles": joined(f"<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr>", face, "<w:sz w:val='22'/></w:rPr></w:rPrDefault></w:docDefaults>", STYLES),
        "theme": F.lit(f"<a:theme {W}><a:fontScheme><a:minorFont><a:latin typeface='Cambria'/></a:minorFont></a:fontScheme></a:theme>"),
    }
    return bodies.select(d.cast("string").alias("path"), *[F.encode(v, "utf-8").alias(k) for k, v in held.items()])


#: The nodes of a session and folder, written once.
NODES: dict[tuple[str, str], DataFrame] = {}


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those of the packages."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in NODES:
        named = {"word/document.xml": "document", "word/styles.xml": "styles", "word/theme/theme1.xml": "theme"}
        parts = F.posexplode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(v).alias("content")) for k, v in named.items()])).alias("pos", "of")
        made = made_packages(spark, sf_dir).select("path", parts)
        NODES[key] = stored(packages.nodes(made.select("path", "pos", "of.part", "of.content", F.lit(None).cast("string").alias("error"))), by="tag")
    return NODES[key]


def nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("path").orderBy("tbl"))
    return packages.tables(nodes(spark, sf_dir)).select("path", place.alias("place"), "depth", "rows", "columns", "cells", "merged", "cells_within", "words_within")


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("path").orderBy("tc"))
    return packages.cell_texts(nodes(spark, sf_dir)).select("path", place.alias("place"), "text")


def run_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("path").orderBy("r"))
    return packages.runs(nodes(spark, sf_dir)).select("path", place.alias("place"), "text", "font", "size_pt", "bold", "italic")


def words_by_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the body (0) and of tables by how deep they lie."""
    of = nodes(spark, sf_dir)
    each = packages.paragraphs(of).groupBy("path", "tbl").agg(F.sum(packages.words(F.col("text"))).alias("words"))
    return each.join(packages.tables(of).select("path", "tbl", "depth"), ["path", "tbl"], "left").groupBy("path", F.coalesce("depth", F.lit(0).cast("long")).alias("depth")).agg(F.sum("words").alias("words"))


def mixed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose first word is bold Georgia and the rest Arial of another size, wrapped within 200 points."""
    first = F.substring_index("line", " ", 1)
    run = lambda t, size, font, bold: F.struct(t.alias("text"), size.cast("double").alias("size"), F.lit(font).alias("font"), F.lit(bold).alias("bold"))
    runs = F.array(run(joined(first, " "), 9 + F.col("n") % 4, "Georgia", True), run(F.substring(F.col("line"), F.length(first) + 2, F.length("line")), F.lit(10), "Arial", False))
    of = metrics.wrapped_runs(runs, F.lit(200.0))
    return fixture(spark, sf_dir, "raw_lines").withColumn("of", of).select("doc_id", "n", "of.lines", "of.size", "of.font")


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return placing.placed(made_packages(spark, sf_dir)).select("path", "place", "kind", "section", "page", "page_end", "column", "lines")


def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sections in JSON: of (doc_id + n) % 11, 0 to 5 are children that are null, a list, unknown, a ragged table, one with an empty cell, and one in a table."""
    k, text = (F.col("doc_id") + F.col("n")) % 11, F.to_json(F.struct(F.lit("p").alias("t"), F.col("line").alias("text")))
    one = lambda *children: joined('{"children": [', *children, "]}")
    ragged = joined('{"t": "table", "rows": [{"cells": [', one(text), ', {"span": 2, "children": [', text, ']}]}, {"cells": [', one(text), "]}]}")
    empty = joined('{"t": "table", "rows": [{"cells": [', one(text), ', {"children": []}]}]}')
    nested = joined('{"t": "table", "rows": [{"cells": [', one(text, ", ", ragged), "]}]}")
    child = F.when(k == 0, "null").when(k == 1, joined("[", text, "]")).when(k == 2, '{"t": "blob"}').when(k == 3, ragged).when(k == 4, empty).when(k == 5, nested).otherwise(text)
    lines = fixture(spark, sf_dir, "raw_lines").select("doc_id", "n", child.alias("child"))
    d = F.col("doc_id")
    children = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "child"))), lambda s: s["child"]), ", ")
    made = lines.groupBy("doc_id").agg(children.alias("children"))
    first = joined('{"properties": {"columns": ', F.when(d % 5 == 0, "2").otherwise("1"), '}, "children": [', F.col("children"), "]}")
    more = F.when(d % 7 == 0, ', {"children": []}').when(d % 7 == 1, ', {"properties": {"type": "continuous"}, "children": []}').otherwise("")
    return made.select(d.alias("doc"), F.when(d % 13 == 5, '{"sections": []}').when(d % 13 == 6, '{"sections": ').otherwise(joined('{"sections": [', first, more, "]}")).alias("json"))


def section_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.issues(section_pages(spark, sf_dir)).withColumnRenamed("doc", "doc_id")


WORDS = r"len(list_filter(regexp_split_to_array({0}, '\s+'), lambda w: w <> ''))"
FIRST = "string_split(line, ' ')[1]"
REST = f"substr(line, length({FIRST}) + 2)"
#: The texts of the paragraphs of a line, in order, with the depth of the table each is in.
TEXTS = f"CASE WHEN n % 8 = 3 THEN list_concat([{{'t': line, 'd': 1}}, {{'t': {FIRST}, 'd': 2}}], CASE WHEN n % 16 = 3 THEN [{{'t': line, 'd': 3}}] ELSE [] END, [{{'t': 'end', 'd': 2}}]) WHEN n % 8 = 5 THEN [{{'t': line, 'd': 1}}, {{'t': {FIRST}, 'd': 1}}, {{'t': '', 'd': 1}}] ELSE [{{'t': line, 'd': 0}}] END"
TABLES = f"""SELECT doc_id, n, k, t.* FROM (SELECT *, unnest(ts) AS t, generate_subscripts(ts, 1) AS k FROM (SELECT *, CASE WHEN n % 8 = 3 THEN list_concat(
    [{{'depth': 1, 'rows': 1, 'columns': 2, 'cells': 2, 'merged': 0, 'cells_within': 4 + d, 'words_within': w * (1 + d) + f + 1}}, {{'depth': 2, 'rows': 1, 'columns': 2, 'cells': 2, 'merged': 0, 'cells_within': 2 + d, 'words_within': w * d + f + 1}}],
    CASE WHEN d = 1 THEN [{{'depth': 3, 'rows': 1, 'columns': 1, 'cells': 1, 'merged': 0, 'cells_within': 1, 'words_within': w}}] ELSE [] END)
    ELSE [{{'depth': 1, 'rows': 2, 'columns': 1, 'cells': 3, 'merged': 3, 'cells_within': 3, 'words_within': w + f}}] END AS ts
    FROM (SELECT doc_id, n, {WORDS.format("line")} AS w, {WORDS.format(FIRST)} AS f, CASE WHEN n % 16 = 3 THEN 1 ELSE 0 END AS d FROM raw_lines WHERE n % 8 IN (3, 5)) AS q) AS r) AS s"""
def said(t: str) -> str:
    """The text of a paragraph of text t, which has a blank after its first word."""
    return f"(CASE WHEN length({t}) = length(string_split({t}, ' ')[1]) THEN {t} || ' ' ELSE {t} END)"


#: The texts of the cells of a line, in order.
INNER = f"array_to_string(list_concat([{said(FIRST)}], CASE WHEN n % 16 = 3 THEN ['end ', {said('line')}] ELSE ['end '] END), ' ')"
CELLS = f"CASE WHEN n % 8 = 3 THEN list_concat([{said('line')}, {INNER}, {said(FIRST)}], CASE WHEN n % 16 = 3 THEN ['end ' || ' ' || {said('line')}, {said('line')}] ELSE ['end '] END) ELSE [{said('line')}, {said(FIRST)}, ' '] END"


def units_sql(text: str, bold: str) -> str:
    of = lambda table, usual: f"list_sum([CASE WHEN c = '' THEN 0 WHEN ascii(c) BETWEEN 32 AND 126 THEN {table}[ascii(c) - 31] ELSE {usual} END for c in list_prepend('', string_split({text}, ''))])"
    return f"(CASE WHEN {bold} THEN {of(metrics.BOLD, metrics.AVERAGE_BOLD)} ELSE {of(metrics.REGULAR, metrics.AVERAGE)} END)"


def wrap_sql(runs: str, room: str) -> str:
    """Lines of a list of structs (t, size, scale, bold): words are stepped through, the width so far beside each. Names end in _ to differ from any column's."""
    words = f"flatten(list_transform({runs}, lambda r_: list_transform(string_split(r_.t, ' '), lambda w_: {{'l': 0, 'c': 0::DOUBLE, 'w': {units_sql('w_', 'r_.bold')} / 1000 * r_.size * r_.scale, 's': (CASE WHEN r_.bold THEN {metrics.BOLD[0]} ELSE {metrics.REGULAR[0]} END) / 1000 * r_.size * r_.scale}})))"
    wider = "a_.c + (CASE WHEN a_.c > 0 THEN b_.s ELSE 0 END) + b_.w"
    breaks = f"{wider} > {room} AND a_.c > 0"
    return f"list_reduce(list_prepend({{'l': 1, 'c': 0::DOUBLE, 'w': 0::DOUBLE, 's': 0::DOUBLE}}, {words}), lambda a_, b_: {{'l': a_.l + CASE WHEN {breaks} THEN 1 ELSE 0 END, 'c': CASE WHEN {breaks} THEN b_.w ELSE {wider} END, 'w': 0::DOUBLE, 's': 0::DOUBLE}}).l"


def styled_sql(t: str) -> str:
    """The runs of a paragraph of text t."""
    first, size = f"string_split({t}, ' ')[1]", "(CASE WHEN doc_id % 4 = 0 THEN 11 ELSE 14 END)::DOUBLE"
    rest = f"substr({t}, length({first}) + 2)"
    return f"list_concat([{{'t': {first} || ' ', 'size': {size}, 'scale': 0.91::DOUBLE, 'bold': true}}], CASE WHEN {rest} <> '' THEN [{{'t': {rest}, 'size': {size}, 'scale': (CASE WHEN doc_id % 2 = 0 THEN 0.90 ELSE 0.85 END)::DOUBLE, 'bold': false}}] ELSE [] END)"


def height_sql(t: str) -> str:
    """The height of a line of a paragraph of text t."""
    return f"((CASE WHEN doc_id % 4 = 0 THEN 11 ELSE 14 END)::DOUBLE * (CASE WHEN substr({t}, length(string_split({t}, ' ')[1]) + 2) = '' THEN 1.14 WHEN doc_id % 2 = 0 THEN 1.15 ELSE 1.17 END)::DOUBLE)"


MIXED = f"[{{'t': {FIRST} || ' ', 'size': (9 + n % 4)::DOUBLE, 'scale': 0.91::DOUBLE, 'bold': true}}, {{'t': {REST}, 'size': 10::DOUBLE, 'scale': 0.90::DOUBLE, 'bold': false}}]"
#: Rows in the order of the body, wrapped and measured; then one after the other let down the columns.
PLACED = f"""
, d AS (SELECT doc_id, n, line, sum(CASE WHEN n % 20 = 10 AND n % 8 NOT IN (3, 5) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before, max(n) FILTER (WHERE n % 20 = 10) OVER (PARTITION BY doc_id) AS cut FROM raw_lines),
g AS (SELECT doc_id, n, line, CAST(coalesce(before, 0) AS INT) AS section, n <= coalesce(cut, -1) AS two,
    (CASE WHEN n <= coalesce(cut, -1) THEN (612.0 - 72 - 72 - 36) / 2 ELSE (CASE WHEN doc_id % 3 = 0 THEN 792.0 ELSE 612.0 END) - 72 - (720 + 360 * (doc_id % 3)) / 20.0 END)::DOUBLE AS w,
    (CASE WHEN n <= coalesce(cut, -1) OR doc_id % 3 <> 0 THEN 648 ELSE 468 END) * 1000000::BIGINT AS room FROM d),
b AS (SELECT *, n * 4::BIGINT AS ord, 'paragraph' AS kind, {wrap_sql(styled_sql("line"), "(w - CASE WHEN doc_id % 4 = 3 THEN 18 ELSE 0 END)")} AS lines, {height_sql("line")} AS h, (CASE WHEN doc_id % 4 = 3 THEN 6000000 ELSE 0 END)::BIGINT AS bef, (CASE WHEN doc_id % 4 = 3 THEN 3000000 ELSE 0 END)::BIGINT AS aft FROM g WHERE n % 8 NOT IN (3, 5)
    UNION ALL SELECT *, n * 4, 'table', 1, greatest({wrap_sql(styled_sql("line"), "189.2")} * {height_sql("line")} + 4, CASE WHEN n % 8 = 3 THEN 11 * 1.26::DOUBLE + 4 ELSE 0 END), 0, 0 FROM g WHERE n % 8 IN (3, 5)
    UNION ALL SELECT *, n * 4 + 1, 'table', 1, greatest({wrap_sql(styled_sql(FIRST), "189.2")} * {height_sql(FIRST)} + 4, {wrap_sql(styled_sql("''"), "189.2")} * {height_sql("''")} + 4), 0, 0 FROM g WHERE n % 8 = 5),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS i, CAST(round(h * 1000000) AS BIGINT) AS m FROM b),
f AS (SELECT doc_id, 0::BIGINT AS i, -1 AS section, 0::BIGINT AS base, 0::BIGINT AS begun, 0::BIGINT AS turns, 0::BIGINT AS down, 1 AS c FROM (SELECT DISTINCT doc_id FROM o)
    UNION ALL SELECT doc_id, i, section, base, begun, e.t, e.d + aft, c FROM (SELECT *, list_reduce(list_prepend({{'t': begun, 'd': fell + bef}}, list_transform(range(lines), lambda x: {{'t': 0::BIGINT, 'd': m}})), lambda a, x: {{'t': a.t + CASE WHEN a.d > 0 AND a.d + x.d > room THEN 1 ELSE 0 END, 'd': CASE WHEN a.d > 0 AND a.d + x.d > room THEN x.d ELSE a.d + x.d END}}) AS e FROM (
        SELECT o.doc_id, o.i, o.section, o.lines, o.m, o.room, o.bef, o.aft, CASE WHEN o.two THEN 2 ELSE 1 END AS c, CASE WHEN o.section = f.section THEN f.base WHEN f.section = -1 THEN 0 ELSE f.base + f.turns // f.c + 1 END AS base, CASE WHEN o.section = f.section THEN f.turns ELSE 0 END AS begun, CASE WHEN o.section = f.section THEN f.down ELSE 0 END AS fell
        FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1) AS q) AS r)
SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY n) AS INT) AS place, kind, section, page, page_end, "column", lines FROM (SELECT CAST(f.doc_id AS VARCHAR) AS path, o.n, o.kind, o.section, CAST(min(f.base + f.begun // f.c + 1) AS INT) AS page, CAST(max(f.base + f.turns // f.c + 1) AS INT) AS page_end, CAST(max_by(f.turns % f.c + 1, f.i) AS INT) AS "column", CAST(sum(o.lines) AS INT) AS lines FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i GROUP BY ALL) AS z"""
def plain(text: str, scale: float) -> str:
    return f"[{{'t': {text}, 'size': 11::DOUBLE, 'scale': {scale}::DOUBLE, 'bold': false}}]"


POURED = f"""
, o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page, n) AS i, {wrap_sql(plain('text', 0.87), '468')} AS lines FROM blocks),
f AS (SELECT doc_id, 0::BIGINT AS i, 0::BIGINT AS begun, 0::BIGINT AS turns, 0::BIGINT AS down FROM (SELECT DISTINCT doc_id FROM o)
    UNION ALL SELECT doc_id, i, begun, e.t, e.d + 6000000 FROM (SELECT o.doc_id, o.i, f.turns AS begun, list_reduce(list_prepend({{'t': f.turns, 'd': f.down}}, list_transform(range(lines), lambda x: {{'t': 0::BIGINT, 'd': 12650000::BIGINT}})),
        lambda a, x: {{'t': a.t + CASE WHEN a.d > 0 AND a.d + x.d > 648000000 THEN 1 ELSE 0 END, 'd': CASE WHEN a.d > 0 AND a.d + x.d > 648000000 THEN x.d ELSE a.d + x.d END}}) AS e FROM f JOIN o ON o.doc_id = f.doc_id AND o.i = f.i + 1) AS q)
SELECT doc_id, 0 AS section, CAST(i AS INT) AS n, CAST(begun + 1 AS INT) AS page, CAST(turns + 1 AS INT) AS page_end, 1 AS "column" FROM f WHERE i > 0"""
PARAGRAPHS = f"SELECT doc_id, n, unnest({TEXTS}) AS p, generate_subscripts({TEXTS}, 1) AS k FROM raw_lines"
LONGS = "depth rows columns cells merged cells_within words_within".split()

QUERIES = {
    "S17_markdown_blocks": markdown_blocks,
    "R3_nested_tables": nested_tables,
    "R3_cell_texts": cell_texts,
    "R5_runs": run_walk,
    "A12_words_by_depth": words_by_depth,
    "W16_mixed_runs": mixed_runs,
    "W17_placements": placed,
    "U5_section_issues": section_issues,
}
ORACLES = {
    "S17_markdown_blocks": oracle(["markdown_lines"], MARKDOWN),
    "R3_nested_tables": oracle(["raw_lines"], f"SELECT CAST(doc_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS INT) AS place, {', '.join(f'CAST(x.{c} AS BIGINT) AS {c}' for c in LONGS)} FROM ({TABLES}) AS x"),
    "R3_cell_texts": oracle(["raw_lines"], f"SELECT CAST(doc_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k) AS INT) AS place, text FROM (SELECT doc_id, n, generate_subscripts({CELLS}, 1) AS k, unnest({CELLS}) AS text FROM raw_lines WHERE n % 8 IN (3, 5)) AS c"),
    "R5_runs": oracle(["raw_lines"], f"""SELECT CAST(doc_id AS VARCHAR) AS path, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n, k, j) AS INT) AS place, text, CASE WHEN j = 0 THEN 'Georgia' WHEN doc_id % 2 = 0 THEN 'Arial' ELSE 'Cambria' END AS font, CASE WHEN doc_id % 4 = 0 THEN 11.0 ELSE 14.0 END::DOUBLE AS size_pt, j = 0 AS bold, doc_id % 4 >= 2 AS italic
        FROM (SELECT doc_id, n, k, 0 AS j, string_split(p.t, ' ')[1] || ' ' AS text FROM ({PARAGRAPHS}) AS a UNION ALL SELECT doc_id, n, k, 1, substr(p.t, length(string_split(p.t, ' ')[1]) + 2) FROM ({PARAGRAPHS}) AS b) AS r WHERE text <> ''"""),
    "A12_words_by_depth": oracle(["raw_lines"], f"SELECT CAST(doc_id AS VARCHAR) AS path, p.d::BIGINT AS depth, CAST(sum({WORDS.format('p.t')}) AS BIGINT) AS words FROM ({PARAGRAPHS}) AS a GROUP BY ALL"),
    "W16_mixed_runs": oracle(["raw_lines"], f"SELECT doc_id, n, {wrap_sql(MIXED, '200')} AS lines, greatest(9 + n % 4, 10)::DOUBLE AS size, CASE WHEN n % 4 > 1 THEN 'Georgia' ELSE 'Arial' END AS font FROM raw_lines"),
    "W17_placements": oracle(["raw_lines"], PLACED),
    "U5_section_issues": oracle(["raw_lines"], """, d AS (SELECT DISTINCT doc_id FROM raw_lines), l AS (SELECT doc_id, (doc_id + n) % 11 AS k, doc_id % 5 = 0 AS two, concat('sections[0].children[', CAST(n AS STRING), ']') AS p FROM raw_lines WHERE doc_id % 13 NOT IN (5, 6))
        SELECT doc_id, 'sections' AS path, 'error' AS severity, 'is empty, so the page would be blank' AS message FROM d WHERE doc_id % 13 = 5 UNION ALL SELECT doc_id, 'sections', 'error', 'is no JSON' FROM d WHERE doc_id % 13 = 6
        UNION ALL SELECT doc_id, 'sections[1]', 'warning', 'begins a new page' FROM d WHERE doc_id % 7 = 0 AND doc_id % 13 NOT IN (5, 6)
        UNION ALL SELECT doc_id, p, 'error', CASE k WHEN 0 THEN 'is null' WHEN 1 THEN 'is a list in a list' ELSE 'is of no known kind: blob' END FROM l WHERE k < 3
        UNION ALL SELECT doc_id, p, 'warning', 'is a table in a section of columns' FROM l WHERE k IN (3, 4, 5) AND two
        UNION ALL SELECT doc_id, concat(p, CASE WHEN k = 3 THEN '' ELSE '.rows[0].cells[0].children[1]' END, '.rows[1]'), 'warning', 'spans 1 columns of 3' FROM l WHERE k IN (3, 5)
        UNION ALL SELECT doc_id, concat(p, '.rows[0].cells[1]'), 'warning', 'is an empty cell' FROM l WHERE k = 4"""),
    # of queries registered elsewhere
    "W16_wrapped_lines": oracle(["layout"], f"SELECT doc_id, page, n, {wrap_sql(plain('text', 0.87), 'w')} AS lines FROM layout"),
    "W17_pagination": oracle(["blocks"], POURED),
}
