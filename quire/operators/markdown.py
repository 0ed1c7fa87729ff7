"""Markdown to blocks, a document split over tasks wherever it is long.

A text is cut into chunks of CHUNK lines. What a chunk does to the open containers is a map that can be worked out before its start is known
(`Change`): which leaf is open at its end, for each that may be open at its start; down to which indent it closes the items open before it, and which
items it opens above them; how many blocks it begins. Maps of consecutive chunks are applied one after another to tell where each chunk
starts, a list of small rows a document; then all chunks are read at once. Documents of one chunk need neither step and no shuffle.

Blocks: heading (#), item (bullet or number, nested by indent), table and its rows (a line with bars above a separator, and the lines with bars that
follow), code (fenced, to the closing fence or the end), image (alone on its line), paragraph. Text below an item or paragraph continues it
until a blank line or another block (lazy continuation). A line belongs to the innermost item whose text begins at its indent or left of it. Tabs count as four
blanks. Quotes, rules and indented code are paragraphs.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Heading, list item, separator of a table, image.
HEADING, ITEM = re.compile(r"(#{1,6})\s+(.*)"), re.compile(r"([-*+]|\d+[.)])(\s+)(.*)")
SEPARATOR = re.compile(r"\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*")
IMAGE = re.compile(r"!\[([^\]]*)\]\(([^)]+)\)")
FENCE = re.compile(r"(`{3,}|~{3,})(.*)")
#: Lines of a chunk.
CHUNK = 2000
#: Pieces leave a task in batches of about so many.
BATCH_ROWS = 20_000
LINES = "doc {kind}, chunk int, n int, block long, parent long, kind string, level int, ordered boolean, piece string"
STATE = "leaf string, run int, open long, items array<struct<offset: int, block: long>>, count long"


@dataclass
class Reader:
    """What is open: the leaf (none, text, head, table, ` or ~ with the run of its fence), its block, the items around (offset, block), how many blocks there are.

    low: the least indent to which items were closed, those from before the first line included.
    """

    leaf: str = "none"
    run: int = 0
    open: int | None = None
    items: list[tuple[int, int]] = field(default_factory=list)
    count: int = 0
    low: int = 1 << 30

    def begin(self, indent: int) -> tuple[int, int | None]:
        """Closes the items that a line at this indent is not in, and gives the numbers of a new block and of the item that it is in."""
        self.low = min(self.low, indent)
        while self.items and self.items[-1][0] > indent:
            self.items.pop()
        self.open, self.count = self.count, self.count + 1
        return self.open, self.items[-1][1] if self.items else None

    def line(self, raw: str, below: str | None) -> Iterator[tuple]:
        """(block, parent, kind or null if the block is open already, level, ordered, piece) of a line; below: the next one."""
        raw = raw.rstrip("\r").replace("\t", "    ")
        text = raw.strip()
        indent = len(raw) - len(raw.lstrip())
        fence = FENCE.fullmatch(text)
        if self.leaf in "`~":
            if fence and fence[1][0] == self.leaf and len(fence[1]) >= self.run and not fence[2].strip():
                self.leaf = "none"
            else:
                yield self.open, None, None, None, None, raw
            return
        if not text:
            self.leaf = "none"
            return
        if self.leaf == "head":
            self.leaf = "table"
            return
        if self.leaf == "table" and "|" in text:
            yield self.count, self.open, "row", None, None, text
            self.count += 1
            return
        if fence and not (fence[1][0] == "`" and "`" in fence[2]):
            block, parent = self.begin(indent)
            self.leaf, self.run = fence[1][0], len(fence[1])
            yield block, parent, "code", None, None, None
        elif found := HEADING.fullmatch(text):
            block, parent = self.begin(indent)
            self.leaf = "none"
            yield block, parent, "heading", len(found[1]), None, found[2].strip()
        elif "|" in text and below is not None and SEPARATOR.fullmatch(below.rstrip("\r")):
            block, parent = self.begin(indent)
            self.leaf = "head"
            yield block, parent, "table", None, None, None
            yield self.count, block, "row", None, None, text
            self.count += 1
        elif found := ITEM.fullmatch(text):
            block, parent = self.begin(indent)
            self.leaf = "text"
            self.items.append((indent + len(found[1]) + len(found[2]), block))
            yield block, parent, "item", len(self.items), found[1][0].isdigit(), found[3].strip()
        elif found := IMAGE.fullmatch(text):
            block, parent = self.begin(indent)
            self.leaf = "none"
            yield block, parent, "image", None, None, text
        elif self.leaf == "text":
            yield self.open, None, None, None, None, text
        else:
            block, parent = self.begin(indent)
            self.leaf = "text"
            yield block, parent, "paragraph", None, None, text

    def lines(self, lines: list[str]) -> Iterator[tuple]:
        """Of the lines, the last of which only tells what lies below."""
        for i, raw in enumerate(lines[:-1]):
            for found in self.line(raw, lines[i + 1]):
                yield i, *found


@dataclass(frozen=True)
class Change:
    """What a chunk does. ends: for each open leaf the reader at its end, begun with no items and block numbers from 0 (open -1: still the one from before).

    fences: for ` and ~, (run, reader) where the first closing fence of at least so many ends what was open; runs rise. Longer fences stay open.
    """

    ends: dict[str, Reader]
    fences: dict[str, list[tuple[int, Reader]]]

    @classmethod
    def of(cls, lines: list[str]) -> Change:
        def after(leaf: str, rest: list[str]) -> Reader:
            at = Reader(leaf, open=-1)
            for _ in at.lines(rest):
                pass
            return at

        fences: dict[str, list[tuple[int, Reader]]] = {"`": [], "~": []}
        for i, raw in enumerate(lines[:-1]):
            found = FENCE.fullmatch(raw.strip())
            if found and not found[2].strip() and len(found[1]) > max([0, *(run for run, _ in fences[found[1][0]])]):
                fences[found[1][0]].append((len(found[1]), after("none", lines[i + 1 :])))
        return cls({leaf: after(leaf, lines) for leaf in ("none", "text", "head", "table")}, fences)

    def applied(self, at: Reader) -> Reader:
        """The reader after the chunk, from the one before."""
        if at.leaf in "`~":
            end = next((r for run, r in self.fences[at.leaf] if run >= at.run), None)
            if end is None:
                return replace(at)
        else:
            end = self.ends[at.leaf]
        items = [i for i in at.items if i[0] <= end.low] + [(offset, block + at.count) for offset, block in end.items]
        return Reader(end.leaf, end.run, at.open if end.open in (-1, None) else end.open + at.count, items, at.count + end.count)


def chunks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc, chunk, of (how many), lines: those of the chunk and the one below it, null after the last. A null text has no lines."""
    split = docs.filter("text is not null").select("doc", F.split("text", "\n").alias("all")).withColumn("of", F.ceil(F.size("all") / size).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("of") - 1), lambda c: F.slice(F.concat("all", F.array(F.lit(None).cast("string"))), c * size + 1, size + 1))
    return split.select("doc", "of", F.posexplode(cut).alias("chunk", "lines"))


def starts(long: DataFrame) -> DataFrame:
    """doc, chunk and the STATE in which each chunk of documents of several begins."""
    kind = dict(long.dtypes)["doc"]
    reader = "struct<leaf: string, run: int, open: long, items: array<struct<offset: int, block: long>>, count: long, low: long>"

    def row(r: Reader) -> dict:
        return {"leaf": r.leaf, "run": r.run, "open": r.open, "items": [{"offset": o, "block": b} for o, b in r.items], "count": r.count, "low": r.low}

    def read(r: dict) -> Reader:
        return Reader(r["leaf"], r["run"], r["open"], [(i["offset"], i["block"]) for i in r["items"]], r["count"], r["low"])

    def change(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc, chunk, lines in zip(b["doc"], b["chunk"], b["lines"], strict=True):
                c = Change.of(list(lines))
                listed = [{"leaf": k, "run": 0, "end": row(r)} for k, r in c.ends.items()] + [{"leaf": k, "run": run, "end": row(r)} for k, found in c.fences.items() for run, r in found]
                yield pd.DataFrame({"doc": [doc], "chunk": [chunk], "changes": [listed]})

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        at, out = Reader(), []
        for doc, chunk, listed in group.sort_values("chunk")[["doc", "chunk", "changes"]].itertuples(index=False):
            state = row(at)
            out.append((doc, chunk, *(state[k] for k in ("leaf", "run", "open", "items", "count"))))
            fences = {c: [(x["run"], read(x["end"])) for x in listed if x["leaf"] == c] for c in "`~"}
            at = Change({x["leaf"]: read(x["end"]) for x in listed if x["leaf"] not in "`~"}, fences).applied(at)
        return pd.DataFrame(out, columns=["doc", "chunk", "leaf", "run", "open", "items", "count"])

    changes = long.repartition("doc", "chunk").select("doc", "chunk", "lines").mapInPandas(change, f"doc {kind}, chunk int, changes array<struct<leaf: string, run: int, end: {reader}>>")
    return changes.groupBy("doc").applyInPandas(follow, f"doc {kind}, chunk int, {STATE}")


def read_on(batches: Iterator[pd.DataFrame], size: int) -> Iterator[pd.DataFrame]:
    """LINES of batches of chunks. Pieces of many chunks leave together, as a data frame for each costs more than reading its lines."""
    names = [c.split()[0] for c in LINES.split(", ")]

    def batch(found: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(found, columns=names)
        return out.astype({"block": "Int64", "parent": "Int64", "level": "Int32", "ordered": "boolean", "n": "Int32"})

    found = []
    for b in batches:
        for r in b.itertuples(index=False):
            fresh = not isinstance(r.leaf, str)
            at = Reader() if fresh else Reader(r.leaf, int(r.run), None if pd.isna(r.open) else int(r.open), [(i["offset"], i["block"]) for i in r.items], int(r.count))
            found += [(r.doc, r.chunk, r.chunk * size + i, *x) for i, *x in at.lines(list(r.lines))]
            if len(found) >= BATCH_ROWS:
                yield batch(found)
                found = []
    if found:
        yield batch(found)


def pieces(begun: DataFrame, size: int) -> DataFrame:
    """LINES of chunks with the STATE they begin in; leaf null where nothing is open yet."""
    return begun.mapInPandas(lambda batches: read_on(batches, size), LINES.format(kind=dict(begun.dtypes)["doc"]))


def blocks(docs: DataFrame, size: int = CHUNK) -> DataFrame:
    """doc, block, parent, kind, level, ordered, first (line), text of the blocks of (doc, text), numbered in order from 0.

    parent: the item, or of a row the table, that holds a block. level: of headings and items. text: lines of code as they are, else joined by
    blanks; of a row its cells joined by tabs; null for a table. A null or blank text has no blocks. doc tells documents apart.
    """
    cut = chunks(docs.select("doc", "text"), size)
    short, long = cut.filter("of = 1"), cut.filter("of > 1")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("leaf", "string"), ("run", "int"), ("open", "long"), ("items", "array<struct<offset: int, block: long>>"), ("count", "long"))]
    columns = ["doc", "chunk", "lines", "leaf", "run", "open", "items", "count"]
    begun = short.select("doc", "chunk", "lines", *none).unionByName(long.join(starts(long), ["doc", "chunk"]).select(*columns))
    of = pieces(begun.select(*columns), size)
    body = F.transform(F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("n", "piece")))), lambda s: s["piece"])
    # a piece without a kind belongs to a block of an earlier line
    found = of.groupBy("doc", "block").agg(F.min("n").alias("first"), F.max("parent").alias("parent"), F.max("kind").alias("kind"), F.max("level").alias("level"), F.max("ordered").alias("ordered"), body.alias("body"))
    cells = F.array_join(F.transform(F.split(F.regexp_replace(F.col("body")[0], r"^\||\|$", ""), r"\|"), lambda c: F.trim(c)), "\t")
    text = F.when(F.col("kind") == "code", F.array_join("body", "\n")).when(F.col("kind") == "row", cells).when(F.col("kind") != "table", F.trim(F.regexp_replace(F.array_join("body", " "), r"\s+", " ")))
    return found.select("doc", "block", "parent", "kind", "level", "ordered", "first", text.alias("text"))
