import duckdb
import pytest

import __spark_entry__ as entry
from quire import plans
from quire.sources.fixtures import prefix, translated

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    c = duckdb.connect()
    for t in plans.TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", ["slice_route_coverage", "A2_body_size", "A4_heading_levels", "W1_gap_clusters", "W8_list_coalescing", "J1_fill_text", "A8_running_elements", "K3_markdown"])
def test_matches_oracle(spark, oracle, name):
    got = plans.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = oracle.sql(plans.ORACLES[name]).fetchall()
    names = [d[0] for d in oracle.sql(plans.ORACLES[name]).description]
    want = sorted(str(tuple(r[names.index(c)] for c in cols)) for r in want)
    assert want and sorted(str(tuple(r[c] for c in cols)) for r in got.collect()) == want


def test_both_branches_of_the_slice(spark):
    assert {r.ok for r in entry.entry(spark).collect()} == {True, False}


def test_every_query_but_folds_has_an_oracle():
    folds = {"W2_merged_paragraphs", "W4_table_regions", "T5_manifests", "K15_worklist"}
    assert set(plans.QUERIES) - set(plans.ORACLES) == folds  # tested by hand


def test_layout_keeps_whole_lines(spark, oracle):
    longest, text = oracle.execute("select max(length(line)), (select max(length(text)) from documents) from (select unnest(string_split(text, chr(10))) as line from documents)").fetchone()
    assert plans.QUERIES["S7_spans"](spark, SF).selectExpr("max(length(text)) as n").first()["n"] >= longest > 80
    assert oracle.execute(translated(prefix(["running"], "duck"), "duck") + "select max(length(raw)) from running").fetchone()[0] == text + len("Only on ")


def test_every_order_is_a_grid(spark, oracle):
    orders = oracle.execute("select count(distinct l_orderkey) from lineitem").fetchone()[0]
    assert plans.QUERIES["A16_ragged"](spark, SF).count() == orders


def test_figure_gaps_are_wide(spark):
    assert all(r.h >= 60 and r.w == 612 - 144 for r in plans.QUERIES["W10_figure_gaps"](spark, SF).collect())


LAYOUT = "doc_id int, page int, n int, block int, x int, y int, w int, h int, size int, flags int, font string, text string"


def layout(spark, lines):
    """Lines (block, x, y, w, text), 12 high, of size 11 unless a sixth value says otherwise."""
    return spark.createDataFrame([(1, 0, i, b, x, y, w, 12, more[0] if more else 11, 0, "Plain", t) for i, (b, x, y, w, t, *more) in enumerate(lines)], LAYOUT)


def got(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def box(spark):
    return spark.createDataFrame([(1, 0, 612, 792)], "doc_id int, page int, width int, height int")


def drawings(spark, rows):
    return spark.createDataFrame([(1, 0, i, *r) for i, r in enumerate(rows)], "doc_id int, page int, d int, x int, y int, w int, h int, fill string, stroke string, width double")


def test_rules_on_tables_of_ones_own(spark):
    """Values worked out from the rules by hand."""
    short = layout(spark, [(i, 72 + 100 * (i % 2), 20 * i, 50, "a b") for i in range(8)])
    route = {r.llm: (r.mode, r.reason) for r in plans.apply("F2_route", layout=short, page_box=box(spark)).collect()}
    assert route == {"auto": ("llm", "scanned"), "all": ("llm", "forced (all)"), "none": ("text", "forced (none)")}
    assert got(plans.apply("F4_tabular_geometry", layout=short, page_box=box(spark)), "tabular") == [(True,)]
    text = "x" * 30
    columns = layout(spark, [(i, 60 if i < 3 else 330, 20 * i, 200, text) for i in range(6)])
    assert got(plans.apply("F2_route", layout=columns, page_box=box(spark)).filter("llm = 'auto'"), "mode", "reason") == [("text", "multi-column")]
    centred = layout(spark, [(i, 200, 20 * i, 212, text) for i in range(6)])
    assert got(plans.apply("F3_multi_column", layout=centred), "multi") == [(False,)]
    numbers = layout(spark, [(i, 72, 20 * i, 300, "Revenue 1,316,892 1,305,077 and a long line of words") for i in range(3)])
    assert got(plans.apply("F5_tabular_content", layout=numbers), "numeric_lines", "tabular") == [(3, True)]

    marks = layout(spark, [(i, 72, 20 * i, 200, t) for i, t in enumerate(["* star", "  ‣ arrow", "– dash", "1234) many", "12.x"])])
    assert got(plans.apply("F14_list_line", layout=marks), "n", "bullet", "numbered", "item") == [(0, True, False, "star"), (1, True, False, "arrow"), (2, False, False, None), (3, False, True, "many"), (4, False, False, None)]
    kinds = layout(spark, [(0, 72, 0, 200, "Big", 18), (1, 72, 40, 200, "- a"), (1, 72, 60, 200, "b"), (2, 72, 80, 200, "body text here " * 9), (3, 72, 100, 200, "1. one"), (4, 72, 120, 200, "2) two")])
    assert got(plans.apply("F28_classify", layout=kinds), "n", "type", "level", "ordered") == [(0, "heading", 1, None), (1, "list", None, False), (2, "paragraph", None, None), (3, "list", None, True), (4, "list", None, True)]
    assert got(plans.apply("W8_list_coalescing", layout=kinds), "ordered", "items", "text") == [(False, 2, "a|b"), (True, 2, "one|two")]

    words = layout(spark, [(0, 62, 62, 200, "inside the fill rect")])
    fills = drawings(spark, [(60, 60, 30, 20, "#3C78D8", None, 0.0), (0, 0, 612, 792, "#FFFFFF", None, 0.0), (61, 62, 20, 12, "#111111", None, 0.0)])
    assert got(plans.apply("J1_fill_text", layout=words, drawings=fills, page_box=box(spark)), "f", "text") == [(0, "inside the"), (2, "inside")]
    assert got(plans.apply("J3_nested_in", drawings=fills, page_box=box(spark)), "f", "nested_in") == [(2, 0)]
    texts = spark.createDataFrame([(1, 0, 0, "#3C78D8", "transaction rationale"), (1, 0, 1, "#111111", "transaction rationale for all of us"), (1, 0, 2, "#222222", "other")], "doc_id int, page int, f int, fill string, text string")
    bars = layout(spark, [(0, 72, 0, 200, "TRANSACTION RATIONALE"), (1, 72, 20, 200, "other"), (2, 72, 40, 200, "all of us for the rationale")])
    assert got(plans.apply("J6_match_fill", layout=bars, fill_text=texts), "n", "f", "score") == [(0, 0, 3), (0, 1, 3), (1, 2, 2), (2, 1, 3)]
    assert got(plans.apply("O4_best_fill", layout=bars, fill_text=texts), "n", "f", "fill") == [(0, 0, "3C78D8"), (1, 2, "222222"), (2, 1, "111111")]

    strokes = drawings(spark, [(40, 40, 500, 600, None, "#000000", 0.0), (40, 40, 520, 600, None, "#808080", 0.5), (0, 0, 612, 792, None, "#000000", 1.0)])
    assert got(plans.apply("X17_border_size", drawings=strokes), "d", "size") == [(0, 8), (1, 4), (2, 8)]
    assert got(plans.apply("F17_frame_candidate", drawings=strokes, page_box=box(spark)), "d", "frame") == [(0, True), (1, True), (2, False)]
    assert got(plans.apply("O3_largest_frame", drawings=strokes, page_box=box(spark)), "d", "color") == [(1, "#808080")]
    attempts = spark.createDataFrame([(1, 408, "status"), (2, 409, "status"), (3, 400, "tool_use_failed"), (4, 429, "status"), (5, 500, "Cancel: x")], "attempt int, code int, message string")
    assert got(plans.apply("T10_retry_class", attempts=attempts), "attempt", "class") == [(1, "retry"), (2, "fatal"), (3, "retry"), (4, "retry"), (5, "fatal")]
    running = spark.createDataFrame([(i, 0, "body", "text", 20, 860, t) for i, t in enumerate(["5", "5/20", "5 of 20", "Page 5", "page 5 OF 20", "p. 5"])], "page int, k int, layer string, label string, cy int, page_h int, raw string")
    assert got(plans.apply("F11_page_number", running=running), "page", "is_number") == [(0, True), (1, False), (2, True), (3, True), (4, True), (5, False)]
    caption = layout(spark, [(0, 72, 0, 200, "above"), (1, 72, 73, 200, "Figure 1. far"), (2, 72, 100, 200, "fig.2 near")])
    images = spark.createDataFrame([], "doc_id int, page int, i int, x int, y int, w int, h int")
    assert got(plans.apply("W10_figure_gaps", layout=caption, images=images, page_box=box(spark)), "n", "y", "h", "asset") == [(1, 12, 61, "fig_1.png")]


def test_ties_and_order_hold_however_large_the_numbers(spark):
    tries = spark.createDataFrame([(1, 0, 1_500_000, "json", 1, True, 200, "s"), (1, 0, 3, "json_escalated", 2, True, 201, "s"), (2, 0, 10**12, "code_text", 3, True, 202, "s"), (2, 1, 1, "json", 1, True, 203, "s")], "doc_id int, page int, attempt long, rung string, rank int, ok boolean, code int, message string")
    assert got(plans.apply("T4_ladder", attempts=tries), "doc_id", "page", "rung", "escalated") == [(1, 0, "json", False), (2, 0, "code_text", True), (2, 1, "json", False)]
    assert got(plans.apply("T9_candidates", attempts=tries), "doc_id", "chosen") == [(1, "json"), (2, "json")]
    assert got(plans.apply("T7_image_floor", attempts=tries.withColumn("ok", tries["attempt"] > 3)), "doc_id", "page", "rung") == [(1, 0, "json"), (2, 0, "code_text"), (2, 1, "image")]
    assert got(plans.apply("W14_first_style", attempts=tries), "doc_id", "style", "start") == [(1, "json_escalated", 201), (2, "code_text", 202)]
    sizes = spark.createDataFrame([(1, 0, 0, 0, 72, 0, 9, 12, 11, 0, "Plain", "abcde"), (1, 0, 600_000, 0, 72, 0, 9, 12, 14, 0, "Plain", "abcdefghij"), (1, 1, 600_001, 1, 72, 0, 9, 12, 9, 0, "Plain", "abcde"), (1, 1, 700_000, 1, 72, 0, 9, 12, 8, 0, "Plain", "vwxyz")], LAYOUT)
    assert got(plans.apply("A2_body_size", layout=sizes), "page", "body") == [(0, 14), (1, 9)]
    assert got(plans.apply("A3_block_size", layout=sizes), "block", "size") == [(0, 14), (1, 9)]
    assert got(plans.apply("A19_dominant_font", layout=sizes), "block", "size") == [(0, 14), (1, 9)]


def test_bands_of_cells(spark):
    """Starts at 40, 62 (a gap of 22: one band), 100 and 190; the second row spans from the first band into the last, the third is stopped by a cell."""
    cells = spark.createDataFrame([(1, 1, 0, 40, 60), (1, 1, 1, 100, 120), (1, 1, 2, 190, 200), (1, 2, 0, 62, 250), (1, 3, 0, 40, 250), (1, 3, 2, 190, 210), (1, 4, 0, 40, 104)], "t int, r int, c int, x int, x_end int")
    assert got(plans.apply("W7_relative_widths", cells=cells), "band", "width") == [(0, 60), (1, 90), (2, 60)]
    assert got(plans.apply("W5_column_span", cells=cells), "r", "c", "span") == [(1, 0, 1), (1, 1, 1), (1, 2, 1), (2, 0, 3), (3, 0, 2), (3, 2, 1), (4, 0, 1)]
    assert got(plans.apply("J16_covered", cells=cells), "r", "c", "k", "blocked") == [(2, 0, 1, False), (2, 0, 2, False), (3, 0, 1, False), (3, 0, 2, True)]


def test_operators_on_tables_of_ones_own(spark):
    x = "x" * 50
    columns = layout(spark, [(i, 60 if i < 3 else 150, 20 * i, 60, x) for i in range(6)])
    assert got(plans.apply("F22_column_bands", layout=columns), "multi") == [(True,)]  # bands at 60 and 150, wherever the middle of the page is
    assert got(plans.apply("F7_row_shaped", layout=columns), "block", "is_row") == [(i, False) for i in range(6)]
    running = spark.createDataFrame([(i * 3, 0, "body", "text", 20, 860, f"Page {i + 7}") for i in range(5)] + [(99, 0, "body", "text", 20, 860, "Page 5")], "page int, k int, layer string, label string, cy int, page_h int, raw string")
    assert got(plans.apply("A9_page_start", running=running), "norm", "page_number_start") == [("page #", 7)]


@pytest.mark.parametrize("name", ["F2_route", "K13_text_prompt", "J6_match_fill", "T5_manifests", "A9_page_start", "W8_list_coalescing"])
def test_texts_are_read_once(spark, name):
    """Rules read the stored relations, and none of their plans brings all rows to one task."""
    plan = plans.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "documents.parquet" not in plan and "Exchange SinglePartition" not in plan


def test_queries_leave_no_views(spark):
    plans.QUERIES["S2_page_text"](spark, SF).count()
    assert not spark.catalog.listTables()
