"""Operators over what has depth, against hand-worked cases and plain walks."""

import os
import random
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.operators import estimate, flow, intervals, markdown, ranks, rectangles, sections
from quire.sources import packages, session, store
from quire.streaming import watched

PARTS = ["# h", "- a", "  - b", "    - c", "12. x", "text", "  more", "", "", "```", "````py", "~~~", "| a | b |", "|--|--|", "x | y", "![a](b)", "   deep", "a\tb"]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


# ---- Markdown


def blocks(spark, texts, size=2000):
    found = markdown.blocks(spark.createDataFrame(list(texts.items()), "doc string, text string"), size)
    return sorted((r["doc"], r["block"], r["parent"], r["kind"], r["level"], r["ordered"], r["first"], r["text"]) for r in found.collect())


def test_markdown_by_hand(spark):
    text = "# Title #\nintro\n goes  on\n- a\n  lazy\nmore lazy\n  - b\n\n    para in b\n1. one\n2) two\n\nafter\n| h | k |\n|---|:--:|\n| 1 |  |\nx | y\nno bars\n```py\n# code\n  - x\n``\n```\n![alt](p.png)\n~~~~\n~~~\n```\nopen to the end"
    assert [r[1:] for r in blocks(spark, {"d": text})] == [
        (0, None, "heading", 1, None, 0, "Title #"),
        (1, None, "paragraph", None, None, 1, "intro goes on"),
        (2, None, "item", 1, False, 3, "a lazy more lazy"),
        (3, 2, "item", 2, False, 6, "b"),
        (4, 3, "paragraph", None, None, 8, "para in b"),
        (5, None, "item", 1, True, 9, "one"),
        (6, None, "item", 1, True, 10, "two"),
        (7, None, "paragraph", None, None, 12, "after"),
        (8, None, "table", None, None, 13, None),
        (9, 8, "row", None, None, 13, "h\tk"),
        (10, 8, "row", None, None, 15, "1\t"),
        (11, 8, "row", None, None, 16, "x\ty"),
        (12, None, "paragraph", None, None, 17, "no bars"),
        (13, None, "code", None, None, 18, "# code\n  - x\n``"),
        (14, None, "image", None, None, 23, "![alt](p.png)"),
        (15, None, "code", None, None, 24, "~~~\n```\nopen to the end"),
    ]


def test_markdown_odd_texts(spark):
    assert blocks(spark, {"a": None, "b": "", "c": " \n\n", "d": "```", "e": "a|b\n--|--", "f": "|--|--|"}) == [("d", 0, None, "code", None, None, 0, ""), ("e", 0, None, "table", None, None, 0, None), ("e", 1, 0, "row", None, None, 0, "a\tb"), ("f", 0, None, "paragraph", None, None, 0, "|--|--|")]


def test_markdown_in_chunks(spark):
    """However long the chunks, and wherever fences, tables and items lie across their ends, the blocks are the same."""
    pick = random.Random(4)
    texts = {f"{i:03}": "\n".join(pick.choice(PARTS) for _ in range(pick.randrange(1, 40))) for i in range(60)}
    whole = blocks(spark, texts)
    for size in (1, 2, 7):
        assert blocks(spark, texts, size) == whole


def test_changes_compose():
    pick = random.Random(5)
    for _ in range(2000):
        lines = [pick.choice(PARTS) for _ in range(pick.randrange(1, 14))] + [None]
        whole, at = markdown.Reader(), markdown.Reader()
        list(whole.lines(lines))
        ends = sorted({0, len(lines) - 1, *pick.choices(range(len(lines)), k=3)})
        for a, b in zip(ends, ends[1:], strict=False):
            at = markdown.Change.of(lines[a : b + 1]).applied(at)
        held = lambda r: (r.leaf, r.leaf in "`~" and r.run, r.leaf != "none" and r.open, r.items, r.count)
        assert held(at) == held(whole)


# ---- what lies in what

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'


def p(*texts, props=""):
    return f"<w:p>{props}" + "".join(f"<w:r><w:t>{t}</w:t></w:r>" for t in texts) + "</w:p>"


def table(*tr):
    return "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{c}</w:tc>" for c in cells) + "</w:tr>" for cells in tr) + "</w:tbl>"


def parsed(spark, body, styles=None, path="d"):
    held = [(path, 0, "word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>".encode(), None)]
    if styles:
        held.append((path, 1, "word/styles.xml", f"<w:styles {W}>{styles}</w:styles>".encode(), None))
    return packages.nodes(spark.createDataFrame(held, packages.PARTS)).cache()


def test_points_in_intervals(spark):
    pick = random.Random(6)
    spans = [(pick.choice("ab"), i, lo, lo + pick.randrange(0, 300)) for i in range(200) for lo in [pick.randrange(0, 900)]] + [("a", 900, 5, 4), ("a", 901, None, 4), ("b", 902, 0, 2**31 - 2)]
    dots = [(pick.choice("abc"), j, pick.randrange(0, 1200)) for j in range(300)] + [("a", 950, None), ("b", 951, 2**31 - 2)]
    got = intervals.covering(spark.createDataFrame(dots, "k string, j int, at int"), spark.createDataFrame(spans, "k string, i int, lo int, hi int"), ["k"])
    want = sorted((j, i) for k, j, at in dots for q, i, lo, hi in spans if k == q and None not in (at, lo) and lo <= at <= hi)
    assert rows(got, "j", "i") == want
    none = spark.createDataFrame([], "k string, i int, lo int, hi int")
    assert intervals.covering(spark.createDataFrame(dots, "k string, j int, at int"), none, ["k"]).count() == 0


def test_node_numbers(spark):
    nodes = parsed(spark, p("a") + table([p("b") + table([p("c")]) + p("d")]))
    held = {r["id"]: r for r in nodes.collect()}
    for n in held.values():  # what lies below is what has the node among its parents
        below = set()
        for m in held.values():
            up = m["parent"]
            while up is not None and up != n["id"]:
                up = held[up]["parent"]
            if up == n["id"]:
                below.add(m["id"])
        assert below == set(range(n["id"] + 1, n["last"] + 1))


def test_tables_in_tables(spark):
    deep = table([p("three words here"), p("x")])
    mid = table([p("own") + deep + p("after it"), p("second")], [p("third")])
    nodes = parsed(spark, p("before") + table([p("left one"), mid + p("after mid"), ""]) + table(["<w:tcPr><w:gridSpan w:val='2'/></w:tcPr>" + p("wide")], ["<w:tcPr><w:vMerge/></w:tcPr>" + p(""), p("n")]))
    got = packages.tables(nodes).orderBy("tbl").collect()
    assert [(r["depth"], r["rows"], r["columns"], r["cells"], r["merged"], r["cells_within"], r["words_within"]) for r in got] == [(1, 1, 3, 3, 0, 8, 13), (2, 2, 2, 3, 0, 5, 9), (3, 1, 2, 2, 0, 2, 4), (1, 2, 1, 3, 2, 3, 2)]
    assert [r["outer"] for r in got] == [None, got[0]["tbl"], got[1]["tbl"], None]
    texts = [r["text"] for r in packages.cell_texts(nodes).orderBy("tc").collect()]
    assert texts == ["left one", "after mid own after it three words here x second third", "own after it three words here x", "three words here", "x", "second", "third", "", "wide", "", "n"]


def test_runs(spark):
    styles = "<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii='Arial'/><w:sz w:val='20'/></w:rPr></w:rPrDefault></w:docDefaults><w:style w:styleId='A'><w:rPr><w:b/><w:sz w:val='30'/></w:rPr></w:style><w:style w:styleId='B'><w:basedOn w:val='A'/><w:rPr><w:i/></w:rPr></w:style>"
    body = "<w:p><w:pPr><w:pStyle w:val='B'/></w:pPr><w:r><w:t>one </w:t></w:r><w:r><w:rPr><w:b w:val='0'/><w:rFonts w:ascii='Georgia'/></w:rPr><w:t>two</w:t><w:t> more</w:t></w:r><w:r/></w:p>" + "<w:p><w:r><w:drawing><a:ext cx='12700' cy='25400'/><a:blip/></w:drawing><w:br w:type='page'/></w:r></w:p>"
    got = packages.runs(parsed(spark, body, styles)).orderBy("r").collect()
    assert [(r["text"], r["font"], r["size_pt"], r["bold"], r["italic"], r["images"], r["image_pt"], r["page_break"]) for r in got] == [
        ("one ", "Arial", 15.0, True, True, 0, 0.0, False),
        ("two more", "Georgia", 15.0, False, True, 0, 0.0, False),
        ("", "Arial", 10.0, False, False, 1, 2.0, True),
    ]


# ---- wrapping and flow


def plain_wrap(runs, room):
    """One word after the other, in floats."""
    width = lambda t, r: sum(({True: metrics.BOLD, False: metrics.REGULAR}[r[3]][ord(c) - 32]) for c in t) / 1000 * r[1] * metrics.SCALE.get(r[2], 1.0)
    lines, at = 1, 0.0
    for r in runs:
        for w in r[0].split(" "):
            gap = width(" ", r) if at > 0 else 0.0
            if at + gap + width(w, r) > room and at > 0:
                lines, at = lines + 1, width(w, r)
            else:
                at = at + gap + width(w, r)
    return lines


def test_mixed_runs(spark):
    pick = random.Random(8)
    cases = [[("".join(pick.choice("ab iW") for _ in range(pick.randrange(0, 30))), pick.choice([8.0, 11.0, 20.0]), pick.choice(["arial", "georgia", "unknown"]), pick.random() < 0.5) for _ in range(pick.randrange(1, 5))] for _ in range(80)]
    rooms = [pick.uniform(20, 300) for _ in cases]
    df = spark.createDataFrame([(i, c, r) for i, (c, r) in enumerate(zip(cases, rooms, strict=True))], "i int, runs array<struct<text: string, size: double, font: string, bold: boolean>>, room double")
    got = {r["i"]: r["of"] for r in df.select("i", metrics.wrapped_runs(F.col("runs"), F.col("room")).alias("of")).collect()}
    for i, (c, room) in enumerate(zip(cases, rooms, strict=True)):
        size = max(r[1] for r in c)
        assert (got[i]["lines"], got[i]["size"], got[i]["font"]) == (plain_wrap(c, room), size, [r[2] for r in c if r[1] == size][-1])
    # "aaaa" of 10 points, then a blank and "aaaa" of 20: 4 * 5.72 + 3.4 + 4 * 11.44 = 72.04 wide
    hand = [("aaaa", 10.0, "x", False), ("aaaa", 20.0, "y", False)]
    df = spark.createDataFrame([(hand, 72.05), (hand, 72.0), ([], 10.0), (None, 10.0)], "runs array<struct<text: string, size: double, font: string, bold: boolean>>, room double")
    assert [tuple(r["of"]) for r in df.select(metrics.wrapped_runs(F.col("runs"), F.col("room")).alias("of")).collect()] == [(1, 20.0, "y"), (2, 20.0, "y"), (1, 11.0, metrics.DEFAULT_FONT), (1, 11.0, metrics.DEFAULT_FONT)]


def poured(pieces, room, turns, down):
    for kind, h in pieces:
        if kind == "turn":
            turns, down = turns + 1, 0
            continue
        if kind == "put" and down and down + h > room:
            turns, down = turns + 1, 0
        down += h
    return turns, down


def test_falls_compose():
    pick = random.Random(9)
    for _ in range(3000):
        pieces = [pick.choice([("put", pick.randrange(0, 9)), ("put", 4), ("skip", pick.randrange(0, 4)), ("put", pick.choice([3, 30])), ("turn", 0)] if pick.random() < 0.2 else [("put", pick.randrange(1, 9))]) for _ in range(pick.randrange(0, 40))]
        cut = pick.randrange(len(pieces) + 1)
        for start in (0, 0.5, 1, 5, 11, 19, 20, 25):
            first = flow.Fall.of(pieces[:cut], 20).after(3, start)
            assert first == poured(pieces[:cut], 20, 3, start)
            assert flow.Fall.of(pieces[cut:], 20).after(*first) == poured(pieces, 20, 3, start)


def test_pagination_in_runs(spark):
    """However the blocks are cut, they fall where one cursor puts them."""
    pick = random.Random(10)
    blocks = [(d, s, n, pick.choice(["text", "text", "unit"]), pick.randrange(0, 9), pick.choice([10.0, 12.65, 13.1]), pick.choice([0.0, 6.0]), pick.choice([0.0, 3.3]), pick.random() < 0.05, 1 + s % 3, 100.0, pick.choice([0.0, 0.0, 40.0])) for d in "ab" for s in range(3) for n in range(pick.randrange(1, 60))]
    df = spark.createDataFrame(blocks, "doc string, section int, n int, kind string, lines int, line_h double, before double, after double, forced boolean, columns int, room double, extra double")
    want, page, section = [], 0, None
    for d, s, n, kind, lines, line_h, before, after, forced, columns, room, extra in blocks:
        if (d, s) != section:
            page = page + turns // section_columns + 1 if section and section[0] == d else 1  # noqa: F821
            section, section_columns, turns, down = (d, s), columns, 0, 0
        turns, down = poured([("turn", 0)] * forced, 100e6, turns, down)
        begin = turns
        whole = [round(x * 1e6) for x in (before, line_h, extra, after)]
        pieces = [("skip", whole[0])] + ([("put", whole[1])] * lines if kind == "text" else [("put", whole[1] * lines)]) + [("put", whole[2])] * (extra > 0) + [("skip", whole[3])]
        turns, down = poured(pieces, 100e6, turns, down)
        want.append((d, s, n, page + begin // columns, page + turns // columns, turns % columns + 1))
    for chunk in (1, 7, 4096):
        assert rows(flow.pagination(df, "doc", chunk), "doc", "section", "n", "page", "page_end", "column") == sorted(want)


def test_placements(spark):
    """A section of two columns, then one with a table; 11 points of the default typeface are 13.86 high."""
    narrow = "<w:pPr><w:sectPr><w:pgSz w:w='4000' w:h='1554'/><w:pgMar w:top='400' w:bottom='600' w:left='200' w:right='200'/><w:cols w:num='2' w:space='200'/></w:sectPr></w:pPr>"
    body = p("a") + p("b") + p("c", props=narrow) + p("d") + table([p("x"), p("y") + p("z")], [p("w")]) + "<w:sectPr/>"
    styles = "<w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii='Plus Jakarta Sans'/></w:rPr></w:rPrDefault></w:docDefaults>"
    got = estimate.placements(parsed(spark, body, styles)).orderBy("block").collect()
    assert [(r["kind"], r["section"], r["page"], r["page_end"], r["column"], r["lines"], r["height_pt"]) for r in got] == [
        ("paragraph", 0, 1, 1, 1, 1, 13.9), ("paragraph", 0, 1, 1, 2, 1, 13.9), ("paragraph", 0, 1, 2, 1, 1, 13.9), ("paragraph", 1, 3, 3, 1, 1, 13.9), ("table", 1, 3, 3, 1, 2, 49.6),
    ]


# ---- order


def test_numbered(spark):
    pick = random.Random(11)
    values = [pick.choice([None, *range(40)]) for _ in range(500)]
    got = rows(ranks.numbered(spark.createDataFrame([(v,) for v in values], "v int"), ["v"]), "place", "v")
    assert [g[0] for g in got] == list(range(500)) and [g[1] for g in got] == sorted(values, key=lambda v: (v is not None, v or 0))


def test_leaves_by_list_ranking(spark):
    """Random forests with circles, groups that nothing refers to and one very deep chain: the same leaves as a walk."""
    pick = random.Random(12)
    edges = []
    for d in range(25):
        groups = ["root"] + [f"g{i}" for i in range(pick.randrange(1, 12))]
        for i, g in enumerate(groups[1:], 1):  # each group is referred to at most once: from one before it, from itself or one after it (a circle), or from nowhere
            parent = pick.choice([*groups[:i], *groups[:i], *groups[1:], "gone"])
            edges.append((f"d{d}", parent, pick.randrange(5) * 100 + i, g, True))
        edges += [(f"d{d}", pick.choice(groups), pick.randrange(5) * 100 + 50 + i, pick.choice(["x", "y", f"l{i}"]), False) for i in range(pick.randrange(0, 30))]
    edges += [("deep", "root" if i == 0 else f"c{i - 1}", 1, f"c{i}", True) for i in range(300)] + [("deep", f"c{i}", 1 + (i % 2) * -1, f"l{i}", False) for i in range(300)]
    df = spark.createDataFrame(edges, "doc string, parent string, pos int, ref string, is_group boolean")
    got, want = flow.ranked_leaves(df, "root"), flow.walked(df, "root")
    assert rows(got, "doc", "place", "ref") == rows(want, "doc", "place", "ref") and got.count() > 300
    assert rows(flow.flattened(df), "doc", "place", "ref") == rows(want, "doc", "place", "ref")
    assert flow.flattened(df.limit(0)).count() == 0


# ---- rectangles


def test_points_in_rectangles(spark):
    pick = random.Random(13)
    rects = [(pick.choice("ab"), i, x, y, x + pick.choice([0, 1, 5, 90, 900]), y + pick.choice([0, 2, 60, 700])) for i in range(150) for x, y in [(pick.randrange(-50, 800), pick.randrange(-50, 800))]] + [("a", 900, 5, 5, 4, 9), ("a", 901, None, 0, 1, 1)]
    dots = [(pick.choice("abc"), j, pick.randrange(-60, 900) / 2, pick.randrange(-60, 900) / 2) for j in range(400)] + [("a", 950, None, 3.0)]
    got = rectangles.placed_in(spark.createDataFrame(dots, "k string, j int, px double, py double"), spark.createDataFrame(rects, "k string, i int, x0 int, y0 int, x1 int, y1 int"), ["k"])
    want = sorted((j, i) for k, j, px, py in dots for q, i, x0, y0, x1, y1 in rects if k == q and None not in (px, x0) and x0 <= px <= x1 and y0 <= py <= y1)
    assert rows(got, "j", "i") == want and len(want) > 50


def test_dense_page_is_not_all_pairs(spark):
    """40,000 words and 400 fills of one page: what meets in tiles is a small multiple of what matches."""
    words = spark.range(40_000).selectExpr("1 AS k", "id AS j", "(id % 200) * 3.0 AS px", "(id div 200) * 4.0 AS py")
    fills = spark.range(400).selectExpr("1 AS k", "id AS i", "cast((id % 20) * 30 AS int) AS x0", "cast((id div 20) * 40 AS int) AS y0", "cast((id % 20) * 30 + 25 AS int) AS x1", "cast((id div 20) * 40 + 30 AS int) AS y1")
    found = rectangles.placed_in(words, fills, ["k"])
    n = found.count()
    plan = found._jdf.queryExecution().toString()
    assert n == 400 * 9 * 8 and "NestedLoop" not in plan and "Cartesian" not in plan


# ---- sections


def test_section_issues(spark):
    p, deep = '{"t": "p", "text": "x"}', '{"t": "p"}'
    for _ in range(4):
        deep = '{"t": "table", "rows": [{"cells": [{"children": [' + deep + "]}]}]}"
    pages = {
        "sound": '{"sections": [{"properties": {"columns": 2}, "children": [%s, {"t": "h"}]}, {"properties": {"type": "continuous"}, "children": []}]}' % p,
        "no json": "{", "null": None, "no list": '{"sections": {"children": []}}', "none": '{"sections": []}', "other": '{"pages": []}',
        "odd": '{"sections": [null, 3, {"properties": {"type": "continuous"}, "children": [null, [%s], {"t": "x"}, {}, "text"]}, {"children": 1}]}' % p,
        "ragged": '{"sections": [{"children": [{"t": "table", "rows": [{"cells": [{"span": 2, "children": [%s]}, {"children": [%s]}]}, {"cells": [{"children": []}, {}]}]}]}]}' % (p, p),
        "columns": '{"sections": [{"properties": {"columns": 2}, "children": [{"t": "table", "rows": [{"cells": [{"children": [%s]}]}]}]}]}' % deep,
    }
    got = rows(sections.issues(spark.createDataFrame(list(pages.items()), "doc string, json string"), deepest=3), "doc", "path", "severity", "message")
    inside = lambda n: "sections[0].children[0]" + ".rows[0].cells[0].children[0]" * n
    assert got == sorted([
        ("no json", "sections", "error", "is no JSON"), ("null", "sections", "error", "is no JSON"), ("no list", "sections", "error", "is no list"), ("other", "sections", "error", "is no list"), ("none", "sections", "error", "is empty, so the page would be blank"),
        ("odd", "sections[0]", "error", "is no object"), ("odd", "sections[1]", "error", "is no object"), ("odd", "sections[2].children[0]", "error", "is null"), ("odd", "sections[2].children[1]", "error", "is a list in a list"),
        ("odd", "sections[2].children[2]", "error", "is of no known kind: x"), ("odd", "sections[2].children[3]", "error", "is of no known kind: object"), ("odd", "sections[2].children[4]", "error", "is of no known kind: string"),
        ("odd", "sections[3]", "warning", "begins a new page"), ("odd", "sections[3].children", "error", "is no list"),
        ("ragged", inside(0) + ".rows[1]", "warning", "spans 2 columns of 3"), ("ragged", inside(0) + ".rows[1].cells[0]", "warning", "is an empty cell"), ("ragged", inside(0) + ".rows[1].cells[1]", "warning", "is an empty cell"),
        ("columns", inside(0), "warning", "is a table in a section of columns"), ("columns", inside(3), "error", "lies deeper than 3 tables"),
    ])


# ---- sessions


def test_of_two_writers_one_commits(spark, tmp_path):
    states = spark.createDataFrame([(1, "pending")], "page int, status string")
    with pytest.raises(FileNotFoundError):
        session.load(spark, str(tmp_path))
    assert session.save(states, str(tmp_path)) == 1
    taken = []

    def write(k):
        try:
            session.save(states.withColumn("by", F.lit(k)), str(tmp_path), 2)
            taken.append(k)
        except session.Conflict:
            pass

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(write, range(4)))
    assert len(taken) == 1 and session.load(spark, str(tmp_path)).first()["by"] == taken[0]
    # a writer that dies after its table and before its entry changes nothing, and hinders nobody
    states.withColumn("by", F.lit(99)).write.parquet(f"{tmp_path}/state-dead")
    assert session.load(spark, str(tmp_path)).first()["by"] == taken[0] and session.load(spark, str(tmp_path), 1).columns == ["page", "status"]
    with pytest.raises(ValueError):
        session.save(states, str(tmp_path), 9)
    assert sorted(n for n in os.listdir(tmp_path / "log") if not n.startswith(".")) == [f"{v:020d}.json" for v in (1, 2)]


def test_no_change_is_lost(spark, tmp_path):
    session.save(spark.createDataFrame([(0,)], "n int"), str(tmp_path))
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda _: session.changed(spark, str(tmp_path), lambda s: s.withColumn("n", F.col("n") + 1)), range(3)))
    assert session.load(spark, str(tmp_path)).first()["n"] == 3 and max(session.versions(spark, str(tmp_path))) == 4


def test_silent_workers_fail_by_timer(spark, tmp_path):
    """Reports of one file a batch: page 0 succeeds at its second try, page 1 starts and falls silent twice, page 2 was completed in the session before."""
    minute = lambda m: datetime(2024, 1, 1, 0, 0) + timedelta(minutes=m)
    batches = [
        [(1, 0, minute(0), "started"), (1, 0, minute(1), "failed"), (1, 1, minute(0), "started"), (1, 2, minute(0), "started")],
        [(1, 0, minute(2), "started"), (1, 0, minute(3), "ok"), (2, 0, minute(9), "started")],
        [(1, 1, minute(10), "started"), (2, 0, minute(10), "ok")],
        [(3, 0, minute(30), "ok")], [(3, 0, minute(31), "ok")],
    ]
    schema = "doc_id long, page int, at timestamp, what string"
    for i, b in enumerate(batches):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(f"{tmp_path}/made{i}")
        (tmp_path / "in").mkdir(exist_ok=True)
        part = next((tmp_path / f"made{i}").glob("*.parquet"))
        os.rename(part, tmp_path / f"in/{i}.parquet")
        os.utime(tmp_path / f"in/{i}.parquet", (1e9 + i, 1e9 + i))
    saved = spark.createDataFrame([(1, 2, "completed", 0)], "doc_id long, page int, status string, failures int")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", watched.PROVIDER)
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        run = watched.watched(stream, saved).writeStream.outputMode("update").format("memory").queryName("page_changes").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        run.awaitTermination(200)
        got = spark.table("page_changes").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    of = lambda d, p: [(r["status"], r["retry_count"], r["error"]) for r in got if (r["doc_id"], r["page"]) == (d, p)]
    assert of(1, 0) == [("in_progress", 0, None), ("pending", 1, "worker failed"), ("in_progress", 1, None), ("completed", 1, None)]
    assert of(1, 1) == [("in_progress", 0, None), ("pending", 1, "worker timed out"), ("in_progress", 1, None), ("failed", 2, "worker timed out")]
    assert of(1, 2) == [] and of(2, 0) == [("in_progress", 0, None), ("completed", 0, None)]


def test_small_groups_cost_no_data_frame(spark):
    """A section of a few blocks, or a band of a page, isn't a group in pandas; gaps are walked in the order of n, rows without a height in one column."""
    blocks = [("d", s, n, "text", 2, 10.0, 0.0, 0.0, False, 1, 30.0) for s in range(2) for n in (2, 0, 1)]
    df = spark.createDataFrame(blocks, "doc string, section int, n int, kind string, lines int, line_h double, before double, after double, forced boolean, columns int, room double")
    placed = flow.pagination(df)
    assert "FlatMapGroupsInPandas" not in placed._jdf.queryExecution().toString()
    assert rows(placed, "section", "n", "page", "page_end") == [(0, 0, 1, 1), (0, 1, 1, 2), (0, 2, 2, 2), (1, 0, 3, 3), (1, 1, 3, 4), (1, 2, 4, 4)]
    bands = spark.createDataFrame([("d", n, 0, y, 5, 10, size, t, None) for n, y, size, t in ((1, 11, None, "b"), (0, 0, 11.0, "a"), (2, 90, 11.0, None))], "doc string, n int, x int, y int, w int, h int, size double, text string, breaks boolean")
    merged = flow.merged_paragraphs(bands, ["doc"])
    assert "FlatMapGroupsInPandas" not in merged._jdf.queryExecution().toString()
    assert rows(merged, "paragraph", "y", "blocks") == [(0, 0, 3)]


def test_words_are_measured_as_by_units(spark):
    texts = ["", " ", "a b", "Éa 漢𝒳 ~\x7f", " x  y "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for bold in (False, True):
        got = df.select("t", F.transform(F.split("t", " "), lambda w: metrics.units(w, F.lit(bold))).alias("u")).collect()
        assert {r["t"]: r["u"] for r in got} == {t: metrics.word_units(t, bold) for t in texts}


def test_stored_by_a_column_reads_back_alike(spark):
    df = spark.createDataFrame([("a", "p", 1), ("a", None, 2), ("b", "w p", 3), ("b", "1", 4), ("b", "p", 5)], "path string, tag string, n int")
    kept = store.stored(df, by="tag")
    assert kept.schema == df.schema and rows(kept, "n", "tag", "path") == rows(df, "n", "tag", "path")
    assert "PartitionFilters: [isnotnull(tag" in kept.filter("tag = 'p'")._jdf.queryExecution().toString()


def test_pieces_of_many_documents_leave_together():
    rows = pd.DataFrame([(i, 0, ["# a", "- b", None], None, None, None, None, None) for i in range(50)], columns=["doc", "chunk", "lines", "leaf", "run", "open", "items", "count"])
    (out,) = markdown.read_on(iter([rows[:20], rows[20:]]), markdown.CHUNK)
    assert list(out["doc"]) == [i for i in range(50) for _ in range(2)] and list(out["kind"]) == ["heading", "item"] * 50


def test_tables_in_buckets_are_joined_and_grouped_without_a_shuffle(spark, tmp_path):
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    df = spark.range(1000).selectExpr("id % 50 AS doc_id", "id % 7 AS page", "id AS n")
    kept = store.bucketed(df, ["doc_id", "page"], 6)
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, df.collect())) and not spark.catalog.listTables()
    counted = kept.groupBy("doc_id", "page", "n").count().join(kept.hint("merge"), ["doc_id", "page", "n"])
    assert counted.count() == 1000 and "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    spark.range(1000).write.parquet(f"{tmp_path}/t.parquet")
    assert store.buckets_for(f"{tmp_path}/t.parquet", spark, 1 << 30) == 4 and store.buckets_for(f"{tmp_path}/t.parquet", spark, 100) > 40


@pytest.mark.parametrize("name", ["K12_summary", "J6_match_fill", "J7_missing_fills", "O4_best_fill", "W11_xy_cut", "W5_column_span"])
def test_rules_by_page_or_table_shuffle_nothing_else(spark, name):
    from quire import plans

    plan = plans.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # pages are counted by document at last; colours of fills and frames are made distinct, no texts among them
    assert len(shuffles) == {"K12_summary": 1, "J7_missing_fills": 2}.get(name, 0)


def test_a_bucket_of_the_layout_holds_little_of_the_texts(spark, tmp_path):
    """The sorts of J1_fill_text spilled with 10 MB of documents to a bucket: a table of 80 MB must lie in 20 buckets at least."""
    from quire import plans

    (tmp_path / "documents.parquet").write_bytes(b"\0" * (80 << 20))
    for part in ("layout", "words", "drawings", "body", "all_blocks", "fill_text"):
        keys, source, each = plans.DEALT[part]
        assert keys == ["doc_id", "page"] and store.buckets_for(f"{tmp_path}/{source}.parquet", spark, each) >= 20
