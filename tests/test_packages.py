"""Packages written and read again, and folds and functions against values worked out by hand."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import metrics, text
from quire.operators import flow, writer
from quire.plans import documents
from quire.sources import packages

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
STYLES = f"""<w:styles {W}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:asciiTheme="minorHAnsi"/></w:rPr></w:rPrDefault></w:docDefaults>
<w:style w:styleId="Base"><w:basedOn w:val="Loop"/><w:rPr><w:sz w:val="20"/><w:b/></w:rPr><w:pPr><w:jc w:val="left"/></w:pPr></w:style>
<w:style w:styleId="Loop"><w:basedOn w:val="Base"/><w:rPr><w:i w:val="0"/></w:rPr></w:style>
<w:style w:styleId="Top"><w:basedOn w:val="Base"/><w:rPr><w:sz w:val="32"/></w:rPr><w:pPr><w:spacing w:before="240" w:line="360"/></w:pPr></w:style></w:styles>"""
DOCUMENT = f"""<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Top"/><w:jc w:val="center"/></w:pPr><w:r><w:t>A &amp; </w:t></w:r><w:r><w:t>B</w:t><w:br w:type="page"/></w:r></w:p>
<w:tbl><w:tblGrid><w:gridCol w:w="2000"/><w:gridCol w:w="2000"/></w:tblGrid><w:tr><w:tc><w:tcPr><w:shd w:val="clear" w:fill="ff0000"/></w:tcPr><w:p/></w:tc>
<w:tc><w:tcPr><w:gridSpan w:val="1"/></w:tcPr><w:tbl><w:tblGrid><w:gridCol w:w="2100"/></w:tblGrid><w:tr><w:tc><w:p><w:r><w:t>deep</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p/></w:tc></w:tr></w:tbl>
<w:sectPr><w:pgSz w:w="15840" w:h="12240" w:orient="portrait"/><w:cols w:num="2"/></w:sectPr></w:body></w:document>"""
THEME = f'<a:theme {A}><a:clrScheme><a:accent1><a:srgbClr val="aabbcc"/></a:accent1></a:clrScheme><a:fontScheme><a:minorFont><a:latin typeface="Calibri"/></a:minorFont></a:fontScheme></a:theme>'
RELS = '<Relationships><Relationship Id="rId1" Target="styles.xml"/><Relationship Id="rId2" Target="gone.xml"/><Relationship Id="rId3" Target="http://x" TargetMode="External"/></Relationships>'
FOOTER = f'<w:ftr {W}><w:p><w:fldSimple w:instr=" PAGE \\* MERGEFORMAT"/><w:r><w:instrText> NUMPAGES </w:instrText></w:r></w:p></w:ftr>'
PNG = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 40)
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 50, 60) + b"\3"


def archive(**more) -> bytes:
    files = {"[Content_Types].xml": "<Types/>", "_rels/.rels": "<Relationships/>", "word/document.xml": DOCUMENT, "word/styles.xml": STYLES, "word/theme/theme1.xml": THEME, "word/_rels/document.xml.rels": RELS, "word/footer1.xml": FOOTER, "word/media/a.png": PNG, "word/media/b.jpeg": JPEG, **more}
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


@pytest.fixture(scope="module")
def read(spark):
    files = spark.createDataFrame([("a", archive()), ("bad", b"no archive"), ("none", None), ("torn", archive(**{"word/styles.xml": "<a><b></a>"}))], "path string, content binary")
    parts = packages.parts(files).cache()
    return parts, packages.nodes(parts).cache()


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def of(df):
    return df.filter("path = 'a'")


def test_validation(read):
    parts, nodes = read
    assert rows(packages.malformed(nodes), "path", "part") == [("torn", "word/styles.xml")]
    assert rows(packages.missing(parts), "path", "part") == sorted((p, r) for p in ("bad", "none") for r in packages.REQUIRED)
    assert rows(of(packages.dangling(nodes, parts)), "part", "rel_id", "target") == [("word/_rels/document.xml.rels", "rId2", "word/gone.xml")]


def test_styles(read):
    _, nodes = read
    got = {(r.style, r.key): r.value for r in of(packages.resolved_styles(nodes)).collect()}
    assert (got["Top", "size_pt"], got["Top", "bold"], got["Top", "italic"], got["Top", "align"], got["Top", "line_mult"]) == ("16.0", "true", "false", "left", "1.5")
    assert got["Base", "size_pt"] == got["Loop", "size_pt"] == "10.0"
    direct = {r.key: r.value for r in of(packages.paragraph_properties(nodes)).collect()}
    assert (direct["align"], direct["space_before_pt"]) == ("center", "12.0")
    assert rows(of(packages.default_font(nodes)), "font", "source") == [("Calibri", "theme")]
    assert rows(of(packages.theme(nodes)), "slot", "value") == [("accent1", "aabbcc"), ("minor", "Calibri")]


def test_document(read):
    parts, nodes = read
    assert rows(of(packages.paragraphs(nodes)).filter("text <> ''"), "text", "page_break") == [("A & B", True), ("deep", False)]
    assert rows(of(packages.sections(nodes)), "page_w_pt", "left_pt", "columns", "orientation") == [(792.0, 72.0, 2, "landscape")]
    assert rows(of(packages.fields(nodes)), "code") == [("NUMPAGES",), ("PAGE",)]
    assert rows(of(packages.too_wide(nodes)), "width_pt", "room_pt") == [(105.0, 100.0)]
    assert rows(of(packages.media(parts)), "part", "width", "height") == [("word/media/a.png", 30, 40), ("word/media/b.jpeg", 60, 50)]
    assert rows(of(packages.counts(nodes, parts)), "sections", "paragraphs", "tables", "words", "styles", "shaded_cells", "media") == [(1, 1, 1, 4, 3, 1, 2)]


def test_nodes_of_some_columns(read):
    """Only the columns named are made, and hold what they hold among all."""
    parts, nodes = read
    for columns in (["path", "part", "id", "tag", "attrs"], ["path", "id", "text", "p"]):
        some = packages.nodes(parts, columns=columns)
        assert some.columns == [c for c in nodes.columns if c in columns]
        assert sorted(map(str, some.collect())) == sorted(map(str, nodes.select(*some.columns).collect()))


def test_round_trip(spark):
    blocks = [("d", 0, "heading1", "Title <1>", None), ("d", 1, "text", "odd \x01 & \r end", "#FF0000"), ("d", 2, "table", "a\tb\nc", None), ("d", 3, "text", None, None), ("d", 4, "break", "", None)]
    parts = packages.parts(writer.documents(spark.createDataFrame(blocks, "path string, n int, kind string, text string, fill string")))
    nodes = packages.nodes(parts)
    texts = [r.text for r in packages.paragraphs(nodes).orderBy("id").collect()]
    assert texts == ["Title <1>", "odd   & \n end", "a", "b", "c", "", "", ""]
    assert not packages.malformed(nodes).count() and not packages.missing(parts).count() and not packages.dangling(nodes, parts).count()


def test_folds():
    assert flow.paragraph_ids([0, 12, 24, 60, 72], [10] * 5, [11, 11, 11, 11, 14], [False] * 5) == [0, 0, 0, 1, 2]
    assert flow.paragraph_ids([0, 12], [10, 10], [None, 11], [False, True]) == [0, 1]
    # 14 has more characters than 11 twice, so the paragraph is of size 14
    assert flow.paragraph_ids([0, 11, 22, 33], [10] * 4, [11, None, 14, 14], [False] * 4, [5, 5, 90, 5]) == [0, 0, 1, 1]
    assert flow.paragraph_ids([0, 11, 22], [10] * 3, [11, 11.4, 11.4], [False] * 3, [5, 90, 5]) == [0, 0, 0]


def regions(spark, tops, bottoms, is_row):
    frame = spark.createDataFrame([("p", i, *x) for i, x in enumerate(zip(tops, [b - t for t, b in zip(tops, bottoms)], is_row))], "page string, n int, y int, h int, is_row boolean")
    return rows(flow.regions(frame, ["page"]), "region", "first", "last")


def test_regions(spark):
    tops = [0, 20, 40, 60, 200]
    after = [t + 10 for t in tops]
    assert regions(spark, tops, after, [False, True, True, True, False]) == [(0, 1, 3)]
    assert regions(spark, [0, 5, 20, 40], [10, 15, 30, 50], [False, True, True, True]) == [(0, 0, 3)]
    assert regions(spark, tops, after, [True, True, False, False, False]) == []
    # a paragraph far below ends the first table; the second has a wrapped line attached
    tops = [0, 20, 40, 300, 400, 420, 440, 455]
    assert regions(spark, tops, [t + 10 for t in tops], [True, True, True, False, True, True, True, False]) == [(0, 0, 2), (1, 4, 7)]


def test_flow(spark):
    lines = spark.createDataFrame([(1, 0.0, 0.0, 20.0, "a"), (1, 60.0, 1.0, 20.0, "b"), (2, 0.0, 0.0, 20.0, "a"), (2, 28.0, 0.0, 20.0, "b"), (3, 0.0, 0.0, 5.0, " ")], "n int, x double, y double, w double, text string")
    assert rows(flow.row_shaped(lines, ["n"]), "n", "is_row") == [(1, True), (2, False)]
    three = spark.createDataFrame([(1, 0, 10, 0, 20, "a"), (1, 1, 12, 60, 20, "b"), (1, 2, 14, 120, 20, "c"), (2, 0, 10, 0, 20, "a"), (2, 1, 10, 60, 20, "b"), (2, 2, 10, 90, 20, "c")], "b int, o int, y int, x int, w int, text string")
    assert rows(flow.row_shaped(three, ["b"], "o"), "b", "is_row") == [(1, True), (2, False)]
    blocks = [("d", 0, 0, "text", 5, 10.0, 0.0, 0.0, False, 2, 30.0), ("d", 0, 1, "unit", 2, 10.0, 0.0, 0.0, False, 2, 30.0), ("d", 1, 0, "text", 1, 10.0, 0.0, 0.0, True, 1, 30.0)]
    frame = spark.createDataFrame(blocks, "doc string, section int, n int, kind string, lines int, line_h double, before double, after double, forced boolean, columns int, room double")
    assert rows(flow.pagination(frame), "section", "n", "page", "page_end", "column") == [(0, 0, 1, 1, 2), (0, 1, 1, 2, 1), (1, 0, 4, 4, 1)]
    edges = spark.createDataFrame([("d", "root", 0, "g", True), ("d", "root", 1, "z", False), ("d", "g", 0, "b", False), ("d", "g", 1, "g", True), ("d", "g", 2, "a", False)], "doc string, parent string, pos int, ref string, is_group boolean")
    assert rows(flow.flattened(edges), "place", "ref") == [(0, "b"), (1, "a"), (2, "z")]


def test_torn_packages_stop_nothing(spark):
    whole = bytearray(archive())
    with zipfile.ZipFile(io.BytesIO(bytes(whole))) as z:
        at = z.getinfo("word/styles.xml").header_offset
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.xml", "<a>" + "x" * 5000 + "</a>")
    torn = bytearray(packed.getvalue())
    torn[40:50] = b"\xff" * 10
    files = spark.createDataFrame([("cut", bytes(whole[:at])), ("torn", bytes(torn)), ("big", packed.getvalue()), ("bomb", archive(**{"word/x.xml": '<!DOCTYPE a [<!ENTITY b "c">]><a>&b;</a>'}))], "path string, content binary")
    got = packages.parts(files, 4000).filter("error is not null")
    assert {r.path for r in got.collect()} == {"cut", "torn", "big"}
    assert rows(packages.malformed(packages.nodes(packages.parts(files))), "path", "part") == [("bomb", "word/x.xml")]


def test_functions(spark):
    one = spark.createDataFrame([("By Lee et al. and et al.", "Page 3 of 12, 2024", '<img src="a.png"><img src="http://x/b">', None)], "t string, f string, h string, z string")
    r = one.select(text.et_al_runs(F.col("t")).alias("t"), text.footer_pieces(F.col("f")).alias("f"), text.absolute_images(F.col("h"), "/base/").alias("h"), text.fallback_paragraphs(F.col("z")).alias("z")).first()
    assert [tuple(x) for x in r.t] == [("By Lee ", False), ("et al.", True), (" and ", False), ("et al.", True)]
    assert [(x.text, x.field) for x in r.f] == [("Page ", None), ("3", "CURRENT"), (" of ", None), ("12", "TOTAL_PAGES"), (", ", None), ("2024", None)]
    assert r.h == '<img src="/base/a.png"><img src="http://x/b">' and r.z is None
    assert text.lenient('so: ```json\n{"blocks": [1]}\n```') == '{"blocks": [1]}'
    assert text.lenient('{"blocks": [{"t": "a", "s": "cut') == '{"blocks": [{"t": "a", "s": "cut"}]}'
    assert text.lenient('{"blocks": 1}') is None and text.lenient("none") is None and text.lenient(None) is None
    width = metrics.text_width(F.lit("Hi"), F.lit(10.0), F.lit(None).cast("string"), F.lit(False))
    wrapped = metrics.wrapped_lines(F.lit("aaaa aaaa aaaa"), F.lit(10.0), F.lit("none"), F.lit(False), F.lit(50.0))
    r = one.select(width.alias("w"), wrapped.alias("l"), metrics.line_height(F.lit(" Calibri ")).alias("h"), metrics.wrapped_lines(F.col("z"), F.lit(1.0), F.lit(None).cast("string"), F.lit(False), F.lit(1.0)).alias("e")).first()
    assert {c: metrics.BOLD[ord(c) - 32] for c in "345Y]"} == {"3": 611, "4": 654, "5": 615, "Y": 660, "]": 415}
    assert r.w == pytest.approx(9.65) and (r.l, r.h, r.e) == (2, 1.15, 1)


def test_nodes_of_some_tags_are_numbered_among_all(spark, read):
    parts, nodes = read
    some = packages.nodes(parts, ("tc", "t"))
    columns = [c for c in nodes.columns if c != "attrs"]
    attrs = F.to_json("attrs").alias("attrs")
    assert sorted(some.select(*columns, attrs).collect(), key=str) == sorted(nodes.filter("tag in ('tc', 't') or error is not null").select(*columns, attrs).collect(), key=str)
    assert rows(packages.malformed(packages.nodes(parts, ())), "path", "part") == [("torn", "word/styles.xml")]


def test_documents_are_written_without_a_group_in_pandas_each(spark):
    lines = spark.createDataFrame([("a", n, "text", t, None) for n, t in ((2, "c"), (0, None), (None, "last"), (1, "a\x01b"))], "path string, n int, kind string, text string, fill string")
    plan = writer.documents(lines)
    assert "FlatMapGroupsInPandas" not in plan._jdf.queryExecution().toString()
    read = packages.paragraphs(packages.nodes(packages.parts(plan)))
    assert [t for _, t in sorted((r["id"], r["text"]) for r in read.collect())] == ["", "a b", "c", "last"]


def test_parts_alone_are_not_parsed_and_texts_are_not_dealt_by_line(spark):
    sf = "/root/testdata/sf0.001"
    documents.READ.clear()
    plan = documents.made(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Aggregate" not in plan
    missing = documents.QUERIES["J15_missing_parts"](spark, sf)
    documents.QUERIES["S16_media"](spark, sf)
    assert not documents.READ
    assert {(r.part, int(r.path) % 7) for r in missing.collect()} == {("_rels/.rels", 3)}


def test_parts_of_a_package_are_changed_before_they_are_packed(spark):
    rows = spark.createDataFrame([("a", [(0, "table", "x & y\tz", None), (1, "text", "b", "#00FF00")]), ("none", [])], "path string, rows array<struct<n: int, kind: string, text: string, fill: string>>")
    change = lambda path, files: files | {"word/new.xml": f"<x>{path}</x>".encode()} if path == "a" else {k: v for k, v in files.items() if k != "word/styles.xml"}
    parts = packages.parts(writer.written(rows, change)).cache()
    assert {r.path: r.n for r in parts.groupBy("path").agg(F.count("*").alias("n")).collect()} == {"a": 6, "none": 4}
    assert bytes(parts.filter("part = 'word/new.xml'").first()["content"]) == b"<x>a</x>"
    assert sorted((r.id, r.text) for r in packages.paragraphs(packages.nodes(parts.filter("path = 'a'"))).collect())[0][1] == "x & y"
