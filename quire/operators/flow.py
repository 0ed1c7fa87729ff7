"""Operators over the blocks of a band, page, section or document in order.

Row shapes and table regions are windows; paragraph merging carries a state that no window holds and folds over one band at a time.
Pagination folds over runs of blocks whose effects compose.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.folds import folded, in_order
from quire.operators.ranks import numbered
from quire.sources.store import stored

#: Of paragraphs the gap in median gaps and its least in points, the usual gap, the sizes that are alike;
#: of tables the gap after a row, rows, the gap between cells, heights that are alike.
GAP_FACTOR, LEAST_GAP, USUAL_GAP, SAME_SIZE = 1.8, 6.0, 4.0, 0.5
ROW_GAP, LEAST_ROWS, CELL_GAP, SAME_Y = 30.0, 3, 25.0, 2.0


@dataclass
class Paragraph:
    """What has been merged so far: where it ends, and how many characters have which size."""

    bottom: float
    weights: dict[float, int] = field(default_factory=dict)

    def takes(self, top: float, size: float | None, limit: float) -> bool:
        usual = max(self.weights, key=self.weights.get) if self.weights else None
        return top - self.bottom <= limit and (usual is None or size is None or abs(usual - size) < SAME_SIZE)

    def add(self, bottom: float, size: float | None, chars: int) -> None:
        self.bottom = max(self.bottom, bottom)
        if size is not None:
            self.weights[size] = self.weights.get(size, 0) + chars


def paragraph_ids(y: list[float], h: list[float], size: list[float | None], breaks: list[bool], chars: list[int] | None = None) -> list[int]:
    """Number of the paragraph each block of a band belongs to; blocks are in order of y. chars: lengths of their texts, as weights of sizes."""
    bottoms = [a + b for a, b in zip(y, h, strict=True)]
    gaps = sorted(top - end for top, end in zip(y[1:], bottoms, strict=False))
    limit = max(GAP_FACTOR * (gaps[len(gaps) // 2] if gaps else USUAL_GAP), LEAST_GAP)
    done: list[Paragraph] = []
    ids = []
    for top, bottom, font, cut, n in zip(y, bottoms, size, breaks, chars or [1] * len(y), strict=True):
        if cut or not done or not done[-1].takes(top, font, limit):
            done.append(Paragraph(bottom))
        done[-1].add(bottom, font, n)
        ids.append(len(done) - 1)
    return ids


def merged_paragraphs(blocks: DataFrame, band: list[str]) -> DataFrame:
    """band, paragraph, box, text, blocks of blocks (n, x, y, w, h, size, text, breaks) merged within each band. Null size fits any.

    One band of a page is held at a time.
    """
    kinds = dict(blocks.dtypes)
    names = [*band, "n", "x", "y", "w", "h", "size", "text", "breaks"]

    own = names[len(band) :]

    def number(key: tuple, group: list[dict]) -> list[tuple]:
        group.sort(key=in_order("y", "n"))
        sizes = [None if pd.isna(b["size"]) else float(b["size"]) for b in group]
        ids = paragraph_ids([float(b["y"]) for b in group], [float(b["h"]) for b in group], sizes, [bool(b["breaks"]) for b in group], [len(b["text"] or "") for b in group])
        return [(*key, *(b[c] for c in own), i) for b, i in zip(group, ids, strict=True)]

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", paragraph int"
    rows = folded(blocks, band, own, number, schema)
    lines = F.transform(F.array_sort(F.collect_list(F.struct("y", "n", "text"))), lambda s: s["text"])
    box = [F.min("x").alias("x"), F.min("y").alias("y"), (F.max(F.col("x") + F.col("w")) - F.min("x")).alias("w"), (F.max(F.col("y") + F.col("h")) - F.min("y")).alias("h")]
    return rows.groupBy(*band, "paragraph").agg(*box, F.array_join(lines, " ").alias("text"), F.count("*").alias("blocks"))


def row_shaped(lines: DataFrame, block: list[str], order: str = "x") -> DataFrame:
    """block, is_row: whether two or more lines (x, y, w, text) at one height lie CELL_GAP apart, all of them. A block without text has no row.

    The height of a line is that of the first one, in the order given, within SAME_Y of it.
    """
    full = lines.filter(F.trim("text") != "")
    one = F.struct(F.col(order).alias("o"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"), F.col("w").cast("double").alias("w"))
    held = full.groupBy(*block).agg(F.array_sort(F.collect_list(one)).alias("all"))
    heights = F.aggregate("all", F.array().cast("array<double>"), lambda seen, s: F.when(F.exists(seen, lambda v: F.abs(v - s["y"]) <= SAME_Y), seen).otherwise(F.concat(seen, F.array(s["y"]))))
    each = held.withColumn("heights", heights).select(*block, "heights", F.explode("all").alias("s"))
    each = each.select(*block, F.filter("heights", lambda v: F.abs(v - F.col("s.y")) <= SAME_Y)[0].alias("height"), "s.x", "s.w")
    before = Window.partitionBy(*block, "height").orderBy("x")
    gaps = each.withColumn("gap", F.col("x") - F.lag(F.col("x") + F.col("w")).over(before))
    rows = gaps.groupBy(*block, "height").agg(((F.count("gap") > 0) & (F.coalesce(F.min("gap"), F.lit(0.0)) >= CELL_GAP)).alias("is_row"))
    return rows.groupBy(*block).agg(F.bool_or("is_row").alias("is_row"))


def regions(blocks: DataFrame, page: list[str]) -> DataFrame:
    """page, region, first, last (values of n) of the tables among blocks (n, y, h, is_row) in order of n.

    A row-shaped block heads a stretch that reaches to the next one. Of a stretch those blocks are attached that overlap the range of
    what is attached already or follow it within ROW_GAP, up to the first that does neither; a stretch with such a one ends its table. Tables
    have LEAST_ROWS heads or more, and begin with the blocks just before that overlap one another and the first head.
    """
    order = Window.partitionBy(*page).orderBy("n")
    tops = blocks.select(*page, "n", F.col("y").cast("double").alias("top"), (F.col("y") + F.col("h")).cast("double").alias("bottom"), F.coalesce("is_row", F.lit(False)).alias("head"))
    chained = (F.lag("top").over(order) < F.col("bottom")) & (F.col("top") < F.lag("bottom").over(order))
    tops = tops.withColumn("chained", F.coalesce(chained, F.lit(False))).withColumn("begin", F.max(F.when(~F.col("chained"), F.col("n"))).over(order))
    tops = tops.withColumn("stretch", F.sum(F.col("head").cast("int")).over(order)).filter("stretch > 0")
    within = Window.partitionBy(*page, "stretch").orderBy("n")
    so_far = within.rowsBetween(Window.unboundedPreceding, -1)
    high, low = F.min("top").over(so_far), F.max("bottom").over(so_far)
    touches = ((F.col("top") < low) & (high < F.col("bottom"))) | ((F.col("top") - low >= 0) & (F.col("top") - low < ROW_GAP))
    tops = tops.withColumn("loose", ~F.col("head") & ~touches).withColumn("ended", F.max(F.col("loose").cast("int")).over(within))
    stretches = tops.groupBy(*page, "stretch").agg(F.max("ended").alias("ended"), F.max(F.when(F.col("ended") == 0, F.col("n"))).alias("last"), F.max(F.when(F.col("head"), F.col("begin"))).alias("first"))
    by_stretch = Window.partitionBy(*page).orderBy("stretch")
    tables = stretches.withColumn("table", F.sum(F.coalesce(F.lag("ended").over(by_stretch), F.lit(1))).over(by_stretch))
    found = tables.groupBy(*page, "table").agg(F.min_by("first", "stretch").alias("first"), F.max("last").alias("last"), F.count("*").alias("rows")).filter(F.col("rows") >= LEAST_ROWS)
    number = F.row_number().over(Window.partitionBy(*page).orderBy("table")) - 1
    return found.select(*page, number.alias("region"), "first", "last")


#: Places of n that flow as one, and the unit of lengths, in points: whole numbers, so that sums don't depend on how they are split.
CHUNK, UNIT = 4096, 1e-6


@dataclass(frozen=True)
class Fall:
    """What a run of pieces does to a column that is filled up to some height: how many columns it turns, and the height in the last.

    fresh: from an empty column. steps: (limit, turns, height) for columns filled above the limit; limits fall, the first that is passed counts.
    last: for those that pass none; without turns the height is added.
    """

    fresh: tuple[int, int]
    steps: list[tuple[int, int, int]]
    last: tuple[int, int]

    @classmethod
    def of(cls, pieces: list[tuple[str, int]], room: int) -> Fall:
        """Pieces are (put, height), which must fit or turn the column unless it is empty, (skip, height) and (turn, 0)."""
        known: dict[int, tuple[int, int]] = {}

        def column(i: int) -> tuple[int | None, int]:
            """Where the next column begins after one that is empty before piece i (null: nowhere), and the height reached."""
            down = 0
            for j in range(i, len(pieces)):
                kind, h = pieces[j]
                if kind == "turn":
                    return j + 1, 0
                if kind == "put" and down and down + h > room:
                    return j, 0
                down += h
            return None, down

        def rest(i: int) -> tuple[int, int]:
            path, down = [], 0
            while i is not None and i not in known:
                path.append(i)
                i, down = column(i)
            turns, down = known[i] if i is not None else (-1, down)
            for k in reversed(path):
                turns += 1
                known[k] = (turns, down)
            return known[path[0]] if path else (turns, down)

        fresh, steps, total, least = rest(0), [], 0, None
        for j, (kind, h) in enumerate(pieces):
            if kind == "turn":
                turns, down = rest(j + 1)
                return cls(fresh, steps, (turns + 1, down))
            limit = room - total - h
            if kind == "put" and (least is None or limit < least):
                turns, down = rest(j)
                steps.append((limit, turns + 1, down))
                least = limit
                if limit <= 0:
                    break
            total += h
        return cls(fresh, steps, (0, total))

    def after(self, turns: int, down: int) -> tuple[int, int]:
        if not down:
            return turns + self.fresh[0], self.fresh[1]
        more, at = next(((t, d) for limit, t, d in self.steps if down > limit), self.last)
        return turns + more, at if more else down + at


def block_pieces(b: dict) -> Iterator[tuple[str, int]]:
    """What a row of pagination() is made of, after a forced break."""
    whole = lambda x: 0 if x is None or x != x else round(float(x) / UNIT)
    yield "skip", whole(b["before"])
    lines = int(b["lines"] or 0)
    yield from [("put", whole(b["line_h"]))] * lines if b["kind"] == "text" else [("put", whole(b["line_h"]) * lines)]
    if whole(b["extra"]):
        yield "put", whole(b["extra"])
    yield "skip", whole(b["after"])


def poured(rows: list[dict], turns: int, down: int) -> Iterator[tuple[dict, int, int]]:
    """Rows of pagination(), in order and of one section, each with the columns turned when it comes up and when it ends, from a column filled up to some height."""
    room = round(float(rows[0]["room"]) / UNIT)
    for b in rows:
        if b["forced"]:
            turns, down = turns + 1, 0
        begin = turns
        for kind, h in block_pieces(b):
            if kind == "put" and down and down + h > room:
                turns, down = turns + 1, 0
            down += h
        yield b, begin, turns


def pagination(blocks: DataFrame, doc: str = "doc", chunk: int = CHUNK) -> DataFrame:
    """doc, section, n, page, page_end, column: where blocks fall as they flow through columns and pages.

    Blocks have section, n, kind (text or unit), lines, line_h, before, after, forced, extra (the height of what follows the lines, if the column is there) and, of the section, columns and room (the height).
    A text flows line by line; a unit, as a table row, moves whole. Every section begins on a new page. page is the one at hand when
    a block comes up, after a forced break; page_end and column are those where it ends. Blocks of the same n / chunk flow as one; what each run of
    blocks does to a column (Fall) tells where the next begins, so a long section spreads over tasks; sections of one run need no such step.
    """
    kinds = dict(blocks.dtypes)
    names = ["section", "n", "kind", "lines", "line_h", "before", "after", "forced", "columns", "room"]
    key = [doc, "section", "run"]
    extra = F.col("extra").cast("double") if "extra" in kinds else F.lit(0.0)
    rows = stored(blocks.select(doc, *names, extra.alias("extra")).withColumn("run", F.floor(F.col("n") / chunk).cast("long")))
    typed = f"`{doc}` {kinds[doc]}, section {kinds['section']}, run long"

    def fall(key: tuple, group: list[dict]) -> list[tuple]:
        pieces: list[tuple[str, int]] = []
        for b in sorted(group, key=in_order("n")):
            pieces += [("turn", 0)] * bool(b["forced"]) + list(block_pieces(b))
        f = Fall.of(pieces, round(float(group[0]["room"]) / UNIT))
        return [(*key, json.dumps([f.fresh, f.steps, f.last]))]

    def follow(key: tuple, group: list[dict]) -> list[tuple]:
        at, out = (0, 0), []
        for r in sorted(group, key=in_order("run")):
            out.append((*key, r["run"], *at))
            fresh, steps, last = json.loads(r["fall"])
            at = Fall(tuple(fresh), [tuple(x) for x in steps], tuple(last)).after(*at)
        return out

    def place(key: tuple, group: list[dict]) -> list[tuple]:
        out: list[tuple] = []
        turns, down = group[0]["turns"] or 0, group[0]["down"] or 0
        for b, begin, end in poured(sorted(group, key=in_order("n")), turns, down):
            out.append((*key[:2], b["n"], max(1, int(b["columns"])), begin, end))
        return out

    several = rows.groupBy(doc, "section").agg(F.min("run").alias("least"), F.max("run").alias("most")).filter("least < most").select(doc, "section")
    own = [*names[1:], "extra"]
    falls = folded(rows.join(several, [doc, "section"], "left_semi"), key, own, fall, f"{typed}, fall string")
    starts = folded(falls, [doc, "section"], ["run", "fall"], follow, f"{typed}, turns long, down long")
    placed = folded(rows.join(starts, key, "left"), key, [*own, "turns", "down"], place, f"`{doc}` {kinds[doc]}, section {kinds['section']}, n {kinds['n']}, columns int, begin int, end int")
    pages = placed.groupBy(doc, "section").agg((F.floor(F.max(F.col("end") / F.col("columns"))) + 1).alias("pages"))
    before = F.coalesce(F.sum("pages").over(Window.partitionBy(doc).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    page = lambda at: (F.col("base") + F.floor(F.col(at) / F.col("columns")) + 1).cast("int")
    based = placed.join(pages.select(doc, "section", before.alias("base")), [doc, "section"])
    return based.select(doc, "section", "n", page("begin").alias("page"), page("end").alias("page_end"), (F.col("end") % F.col("columns") + 1).cast("int").alias("column"))


def flattened(children: DataFrame, root: str = "root") -> DataFrame:
    """doc, ref, place: leaves below the root in reading order, from rows (doc, parent, pos, ref, is_group).

    Where every group is referred to once, places come from list ranking (`ranked_leaves`), in rounds that double. Documents in which some group is referred to
    again are walked, one at a time, as its leaves are read each time. References into a group already on the path, missing parents and cycles lead nowhere.
    """
    rows = children.select("doc", "parent", "pos", "ref", "is_group")
    again = rows.filter("is_group").groupBy("doc", "ref").agg(F.count("*").alias("n")).filter((F.col("n") > 1) | (F.col("ref") == root)).select("doc").distinct()
    return ranked_leaves(rows.join(again, "doc", "left_anti"), root).unionByName(walked(rows.join(again, "doc", "left_semi"), root))


#: Where a list of steps ends: after the root's last child, or in a group that nothing refers to.
DONE, LOST = -1, -2


def ranked_leaves(rows: DataFrame, root: str) -> DataFrame:
    """flattened() of trees, by pointer jumping over the tour through them.

    Each reference is entered and left once, which makes two steps 2 g and 2 g + 1 of reference g; each step knows the next. In every round a step adds what the
    one it points to has counted, and points to where that points, so lists of n steps are done after log2 n rounds; what is left then runs in circles.
    """
    edges = stored(numbered(rows, ["doc", "parent", "pos", "ref"], "g"))
    after = F.lead("g").over(Window.partitionBy("doc", "parent").orderBy("g"))
    first = edges.groupBy("doc", F.col("parent").alias("ref")).agg(F.min("g").alias("child"))
    up = edges.filter("is_group").select("doc", F.col("ref").alias("parent"), F.col("g").alias("up"))
    known = edges.withColumn("after", after).join(first, ["doc", "ref"], "left").join(up, ["doc", "parent"], "left")
    inward = F.when(F.col("is_group") & F.col("child").isNotNull(), 2 * F.col("child")).otherwise(2 * F.col("g") + 1)
    outward = F.when(F.col("after").isNotNull(), 2 * F.col("after")).when(F.col("parent") == root, F.lit(DONE)).otherwise(F.coalesce(2 * F.col("up") + 1, F.lit(LOST)))
    steps = F.array(F.struct((2 * F.col("g")).alias("step"), inward.cast("long").alias("to"), (~F.col("is_group")).cast("long").alias("n")), F.struct((2 * F.col("g") + 1).alias("step"), outward.cast("long").alias("to"), F.lit(0).cast("long").alias("n")))
    at, open_before = stored(known.select(F.explode(steps).alias("s")).select("s.*")), None
    while (still := at.filter("to >= 0").count()) and still != open_before:
        ahead = at.select(F.col("step").alias("to"), F.col("to").alias("further"), F.col("n").alias("more"))
        moved = at.filter("to >= 0").join(ahead, "to").select("step", F.col("further").alias("to"), (F.col("n") + F.col("more")).alias("n"))
        at, open_before = stored(at.filter("to < 0").unionByName(moved)), still
    counted = edges.filter("not is_group").join(at.filter(F.col("to") == DONE).select((F.col("step") / 2).cast("long").alias("g"), (F.col("step") % 2).alias("leaving"), "n").filter("leaving = 0"), "g")
    whole = counted.groupBy("doc").agg(F.max("n").alias("all"))
    return counted.join(whole, "doc").select("doc", "ref", (F.col("all") - F.col("n")).cast("int").alias("place"))


def walked(children: DataFrame, root: str) -> DataFrame:
    """flattened() of any document, held one at a time."""
    kind = dict(children.dtypes)["doc"]

    def walk(group: pd.DataFrame) -> pd.DataFrame:
        below: dict[str, list] = {}
        for r in group.sort_values("pos", kind="stable").itertuples():
            below.setdefault(r.parent, []).append((r.ref, bool(r.is_group)))
        leaves, todo = [], [(root, True, frozenset())]
        while todo:
            ref, is_group, path = todo.pop()
            if is_group:
                todo += [(r, g, path | {ref}) for r, g in reversed(below.get(ref, [])) if not (g and r in path | {ref})]
            else:
                leaves.append(ref)
        return pd.DataFrame({"doc": pd.Series([group["doc"].iloc[0]] * len(leaves), dtype=object), "ref": pd.Series(leaves, dtype=object), "place": pd.Series(range(len(leaves)), dtype="int32")})

    return children.groupBy("doc").applyInPandas(walk, f"doc {kind}, ref string, place int")
