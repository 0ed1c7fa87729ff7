"""Placements by one pass over a package against those by joins over its nodes."""

import random

from quire.operators import estimate, placing
from quire.plans import structure
from quire.sources import packages

NS = 'xmlns:w="urn:w" xmlns:a="urn:a"'
NAMES = ("path", "place", "kind", "section", "page", "page_end", "column", "lines", "height_pt")


def run(pick):
    props = "".join(pick.choice(["<w:b/>", "<w:b w:val='0'/>", "<w:sz w:val='40'/><w:sz w:val='9'/>", "<w:sz w:val='x'/>", "<w:rFonts w:hAnsi='Verdana'/>", "<w:rFonts w:asciiTheme='majorHAnsi'/>", "<w:rFonts w:ascii=''/>", "<w:rStyle w:val='A'/>"]) for _ in range(pick.randrange(3)))
    inside = pick.choice(["<w:t>%s</w:t>" % " ".join(pick.choice(["a", "Wide", "漢 &amp;", "", "x" * 90]) for _ in range(pick.randrange(40)))] * 5 + ["<w:t/>", "<w:br w:type='page'/>", "<w:br/>", "<w:drawing><a:ext cy='400000'/><a:ext cy='9'/><a:blip/></w:drawing>", "<w:drawing><a:blip/><a:ext cy='no'/></w:drawing>", "<w:t>a<w:br/>b</w:t>", "<w:ins><w:t>deep</w:t></w:ins>"])
    return f"<w:r><w:rPr>{props}</w:rPr>{inside}</w:r>"


def section(pick):
    return "<w:sectPr>" + pick.choice(["", "<w:cols w:num='2'/>", "<w:cols w:num='3' w:space='90'/>", "<w:cols w:num='0'/>", "<w:pgSz w:w='6000' w:h='5000'/><w:pgMar w:left='100' w:right='100.5' w:top='99' w:bottom=' 90 '/>", "<w:pgSz w:w='no'/>"]) + "</w:sectPr>"


def paragraph(pick):
    props = pick.choice(["", "", "<w:pStyle w:val='A'/>", "<w:pStyle w:val='B'/>", "<w:pStyle w:val='C'/>", "<w:pStyle w:val='lost'/>", "<w:ind w:left='400' w:right='9000'/>", "<w:spacing w:line='500' w:lineRule='exact'/>", "<w:spacing w:line='360' w:before='80' w:after='7'/>", "<w:rPr><w:sz w:val='90'/></w:rPr>"])
    props += section(pick) if pick.random() < 0.1 else ""
    return f"<w:p><w:pPr>{props}</w:pPr>" + "".join(run(pick) for _ in range(pick.randrange(4))) + "</w:p>"


def table(pick, depth=0):
    rows = ""
    for _ in range(pick.randrange(4)):
        cells = ""
        for _ in range(pick.randrange(1, 4)):
            props = pick.choice(["", "<w:tcW w:w='900' w:type='dxa'/>", "<w:tcW w:w='0' w:type='dxa'/>", "<w:tcW w:w='50' w:type='pct'/>", "<w:textDirection w:val='btLr'/>", "<w:tcW w:w='3000' w:type='dxa'/><w:tcW w:w='4' w:type='dxa'/>"])
            inner = table(pick, depth + 1) if depth < 3 and pick.random() < 0.25 else ""
            cells += f"<w:tc><w:tcPr>{props}</w:tcPr>{paragraph(pick)}{inner}{paragraph(pick) if pick.random() < 0.5 else ''}</w:tc>"
        rows += f"<w:tr>{cells}</w:tr>"
    return "<w:tbl>" + pick.choice(["", "<w:tblGrid><w:gridCol w:w='2000'/><w:gridCol w:w='1000'/></w:tblGrid>", "<w:tblGrid><w:gridCol w:w='x'/></w:tblGrid>"]) + rows + "</w:tbl>"


def package(pick):
    body = "".join(table(pick) if pick.random() < 0.25 else paragraph(pick) for _ in range(pick.randrange(30))) + pick.choice(["", section(pick)])
    face = pick.choice(["", "<w:rFonts w:ascii='Arial'/>", "<w:rFonts w:asciiTheme='minorHAnsi'/>", "<w:rFonts w:cs='Calibri' w:cstheme='majorBidi'/><w:b/>", "<w:sz w:val='30'/>"])
    styles = f"<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr>{face}</w:rPr></w:rPrDefault></w:docDefaults>" + pick.choice(["", "<w:style w:styleId='A'><w:basedOn w:val='B'/><w:rPr><w:sz w:val='28'/><w:b/></w:rPr></w:style><w:style w:styleId='B'><w:basedOn w:val='A'/><w:pPr><w:spacing w:before='120' w:after='60'/><w:ind w:left='360'/></w:pPr><w:rPr><w:rFonts w:ascii='Cambria'/><w:sz w:val='50'/></w:rPr></w:style><w:style w:styleId='C'><w:basedOn w:val='B'/><w:pPr><w:spacing w:line='300'/></w:pPr><w:rPr><w:rFonts w:asciiTheme='minorHAnsi'/></w:rPr></w:style><w:style/>"]) + "</w:styles>"
    theme = f"<a:theme {NS}><a:fontScheme><a:majorFont><a:latin typeface='Tahoma'/></a:majorFont><a:minorFont><a:latin typeface=''/><a:latin typeface='Segoe UI'/></a:minorFont></a:fontScheme></a:theme>"
    parts = [f"<w:document {NS}><w:body>{body}</w:body></w:document>", pick.choice([styles] * 4 + [None, "<torn"]), pick.choice([theme, theme, None])]
    return [None if x is None else x.encode() for x in parts]


def test_one_pass_places_blocks_as_joins_over_nodes_do(spark):
    pick = random.Random(11)
    made = [(str(i), *package(pick)) for i in range(120)] + [("torn", b"<w:document>", None, None), ("entity", b"<!DOCTYPE d [<!ENTITY e 'x'>]><d/>", None, None), ("none", None, None, None), ("empty", b"<d/>", None, None)]
    parts = [(path, i, name, content, None) for path, *contents in made for i, (name, content) in enumerate(zip((packages.MAIN, packages.STYLES, "word/theme/theme1.xml"), contents, strict=True)) if content is not None]
    by_joins = estimate.placements(packages.nodes(spark.createDataFrame(parts, packages.PARTS))).collect()
    want = []
    for path in {r["path"] for r in by_joins}:
        own = sorted((r for r in by_joins if r["path"] == path), key=lambda r: (r["block"], r["section"]))
        want += [(path, place, *(r[c] for c in NAMES[2:])) for place, r in enumerate(own, 1)]
    found = placing.placed(spark.createDataFrame(made, "path string, document binary, styles binary, theme binary"))
    got = [tuple(r[c] for c in NAMES) for r in found.collect()]
    assert len(want) > 1000 and [r[:-1] for r in sorted(got)] == [r[:-1] for r in sorted(want)]
    assert all(abs(a[-1] - b[-1]) < 0.11 for a, b in zip(sorted(got), sorted(want), strict=True))


def test_packages_are_placed_without_joins_over_their_nodes(spark):
    plan = structure.QUERIES["W17_placements"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan and "Aggregate" not in plan and plan.count("Exchange") == 1 and "table-" not in plan


def test_lines_of_an_id_make_one_package(spark, tmp_path):
    """Texts of an id that comes twice are one package, with lines in order; a text that is null makes none, an empty one has an empty line."""
    texts = [(1, "a b\nc"), (2, None), (3, ""), (4, "x\ny\nz")]
    for name, more in (("once", []), ("again", [(1, "d\ne\nf g"), (2, "late")])):
        spark.createDataFrame(texts + more, "doc_id long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
    count = lambda name: sorted((r["path"], r["count"]) for r in structure.QUERIES["W17_placements"](spark, f"{tmp_path}/{name}").groupBy("path").count().collect())
    assert count("once") == [("1", 2), ("3", 1), ("4", 3)]
    assert count("again") == [("1", 5), ("2", 1), ("3", 1), ("4", 3)]
    made = {r["path"]: r["document"].decode() for r in structure.made_packages(spark, f"{tmp_path}/again").collect()}
    assert [made["1"].index(f">{w}") for w in ("a ", "c ", "e ", "f ")] == sorted(made["1"].index(f">{w}") for w in ("a ", "c ", "e ", "f "))
    assert made["4"] == {r["path"]: r["document"].decode() for r in structure.made_packages(spark, f"{tmp_path}/once").collect()}["4"]
