import json

import pandas as pd
from pyspark.sql import functions as F

from quire.operators import layout_json, orchestration
from quire.plans import documents
from quire.sources import session, structured
from quire.streaming import page_state

SF = "/root/testdata/sf0.001"


def test_elements():
    layout = {"title": "T", "columns": [{"blocks": [{"t": "bar", "text": "Deal terms here"}, {"t": "list", "ordered": True, "items": ["a", "b"]}]}, {"blocks": [{"t": "table", "cols": [1, 2], "rows": [["Name", "Sum"], ["x", "$1,000"], ["y"]]}, {"t": "img", "file": "assets/i.png"}]}]}
    injected = {"fills": [{"fill": "#16a085", "text": "deal terms"}], "border": {"color": "#123456", "width": 0.5}}
    got = [{k: v for k, v in e.items() if k != "path"} for e in layout_json.elements(layout, injected)]
    assert got[0] == {"kind": "title", "text": "T", "bold": True, "align": "center"}
    assert got[1] == {"kind": "frame", "width": 9360, "border": 4, "border_color": "123456"}
    assert got[2] == {"kind": "column", "width": 4680}
    assert got[3] == {"kind": "bar", "text": "Deal terms here", "fill": "16A085", "color": "FFFFFF", "width": 4440, "bold": True}
    assert [e["text"] for e in got if e["kind"] == "item"] == ["1. a", "2. b"]
    cells = [e for e in got if e["kind"] == "cell"]
    assert [c["width"] for c in cells] == [1480, 2960] * 3 and [c["align"] for c in cells] == [None, "right"] * 3
    assert [c["bold"] for c in cells] == [True, True, False, False, False, False]
    assert got[-1] == {"kind": "image", "text": "i.png", "width": 296}
    assert layout_json.elements({"blocks": []}) == []
    assert [e["kind"] for e in layout_json.elements({"blocks": [{"t": "p", "text": "x"}], "frame": True})] == ["frame", "column", "paragraph"]


def test_facts():
    assert [layout_json.border_size(w) for w in (0, None, 0.5, 1, 0.1)] == [8, 8, 4, 8, 2]
    assert layout_json.contrast("16A085") == "FFFFFF" and layout_json.contrast("F9CB9C") == "1A1A1A" and layout_json.contrast(None) is None
    assert layout_json.split_widths([1, 1, 1], 100) == [33, 33, 34]
    assert layout_json.hex_of("#abc") == "000ABC"
    assert layout_json.with_images({"blocks": [{"t": "img", "file": "x/a.png"}]}, ["a.png", "b.png"])["blocks"][1:] == [{"t": "img", "file": "b.png"}]


def test_commits(spark):
    good = json.dumps({"blocks": [{"t": "p", "text": "alpha beta gamma"}]})
    rows = [(1, good, "alpha beta gamma", ["i.png"]), (2, good, "other words than those", []), (3, "no", "alpha", []), (4, good, "", [])]
    frame = spark.createDataFrame([(i, a, None, t, f) for i, a, t, f in rows], "page int, layout string, injected string, text string, assets array<string>")
    got = {r.page: (r.ok, r.coverage, r.error) for r in layout_json.committed(frame, ["page"]).collect()}
    assert got == {1: (True, 1.0, None), 2: (False, 0.0, "low fidelity: only 0% of the words"), 3: (False, None, "no JSON object in model output"), 4: (True, 1.0, None)}


def test_deterministic_pass(spark):
    rows = [(1, "text", "clean", False, "one two three", "one two three", False), (2, "text", "clean", True, "one two", "one two", False), (3, "text", "clean", False, "one two three four five", "one", False), (4, "llm", "scanned", False, "one", None, False), (5, "text", "clean", False, "one", "one", True)]
    pages = spark.createDataFrame(rows, "page int, mode string, reason string, has_vector boolean, original string, rebuilt string, done boolean")
    made, work = orchestration.deterministic_pass(pages, ["page"])
    assert [(r.page, r.reason) for r in made.collect()] == [(1, "clean")]
    assert sorted((r.page, r.reason) for r in work.collect()) == [(2, "vector fills/frame present (clean)"), (3, "low fidelity: 20%"), (4, "scanned")]
    made, work = orchestration.deterministic_pass(pages, ["page"], llm="none")
    assert work.count() == 0 and {r.page: r.reason for r in made.collect()}[3] == "low fidelity: 20% (unverified)"


def test_manifests_and_worklist_part_the_pages(spark):
    made, work = (x.select("doc_id", "page") for x in documents.deterministic(spark, SF))
    assert made.count() and work.count() and not made.join(work, ["doc_id", "page"]).count()


def test_session_is_read_as_written(spark, tmp_path):
    states = spark.createDataFrame([(1, "pending"), (2, "completed")], "page int, status string")
    for n in (1, 2):
        session.save(states.limit(n), str(tmp_path))
    assert sorted(r.page for r in session.load(spark, str(tmp_path)).collect()) == [1, 2]
    assert session.Settings().overridden(["--retries", "3"]).retries == 3
    assert [tuple(r) for r in session.roles('{"builder": [{"provider": "p", "model": "a"}, {"provider": "q", "model": "b"}]}', spark).collect()] == [("builder", 0, "p", "a"), ("builder", 1, "q", "b")]
    files = spark.createDataFrame([('{"page": 3, "mode": "json", "assets": ["a"]}',), ("torn",)], "json string")
    assert [(r.page, r["mode"]) for r in session.manifests(files).filter("page is not null").collect()] == [(3, "json")]


def test_page_files(spark, tmp_path):
    pages = documents.page_json(spark, SF)
    structured.write(pages, str(tmp_path / "out"), "doc_id")
    one = pages.orderBy("doc_id", "page").first()
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "page_0001.json").write_text(one.json)
    (tmp_path / "one" / "page_0002.json").write_text("torn")
    read = structured.pages(spark, str(tmp_path / "one"))
    assert read.count() == 2 and structured.lines(read.filter("page.structured is not null"), ["path"]).count() == sum(len(b["lines"]) for b in json.loads(one.json)["structured"]["blocks"] if b["type"] == "text")
    assert spark.read.text(str(tmp_path / "out")).count() == pages.count()


def test_streamed_states(spark, tmp_path):
    schema = "doc_id long, page int, attempt long, ok boolean"
    rows = [[(1, 1, 1, False), (1, 2, 1, True), (2, 1, 1, False), (2, 1, 2, False)], [(1, 1, 2, True), (1, 2, 2, False), (2, 1, 3, True)]]
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = page_state.tracked(stream).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = {(r.doc_id, r.page): (r.status, r.retry_count) for r in spark.table("states").collect() if r.status != "pending"}
    spark.catalog.dropTempView("states")
    assert last == {(1, 1): ("completed", 1), (1, 2): ("completed", 0), (2, 1): ("failed", 2)}
