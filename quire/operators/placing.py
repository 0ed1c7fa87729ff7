"""Where the blocks of a Word package fall on pages, by one pass over the package: what estimate.placements() tells by joins over its nodes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import metrics
from quire.operators import flow
from quire.operators.estimate import LEAST_CELL, LEAST_ROOM, MARGINS, PAGE, ROW_EXTRA, TURNED
from quire.operators.folds import BATCH
from quire.sources import packages

PLACED = "path string, place int, block int, kind string, section int, page int, page_end int, column int, lines int, height_pt double"
#: The attributes and lengths, in twips, that a section has where it doesn't tell them.
SIDES = {"page_w_pt": ("pgSz", "w", 12240), "page_h_pt": ("pgSz", "h", 15840), **{f"{s}_pt": ("pgMar", s, 1440) for s in ("top", "bottom", "left", "right")}, "col_space_pt": ("cols", "space", 720)}
FALLBACK = "Times New Roman"
NUMBER = re.compile(r"[+-]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?|inf|infinity|nan)", re.IGNORECASE)
WHITE = "".join(map(chr, range(33)))


#: Names that a process keeps.
KNOWN = 10_000


class Names(dict):
    """Local names by full ones."""

    def __missing__(self, name: str) -> str:
        if len(self) >= KNOWN:
            self.clear()
        self[name] = out = packages.local(name)
        return out


NAMES = Names()


def attrs(el: ElementTree.Element) -> dict[str, str]:
    return {NAMES[k]: v for k, v in el.attrib.items()}


def double(text: str | None) -> float | None:
    """As Spark casts it; null for what is no number."""
    text = (text or "").strip(WHITE)
    if text[-1:] in ("d", "D", "f", "F") and text[:-1][-1:].isascii() and (text[:-1][-1:].isdigit() or text[:-1][-1:] == "."):
        text = text[:-1]
    return float(text) if NUMBER.fullmatch(text) else None


def whole(text: str | None) -> int | None:
    text = (text or "").strip(WHITE)
    return int(text) if re.fullmatch(r"[+-]?[0-9]+", text) and -(1 << 31) <= int(text) < 1 << 31 else None


def parsed(content: bytes | None) -> ElementTree.Element | None:
    """The root of a part; null for one that packages.nodes() finds malformed."""
    if content is None or b"<!ENTITY" in content:
        return None
    try:
        return ElementTree.fromstring(content)
    except (ElementTree.ParseError, ValueError, LookupError):
        return None


def first(*values: str | None) -> str | None:
    return next((v for v in values if v is not None), None)


@lru_cache(maxsize=KNOWN)
def told(name: str, of: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str | float], ...]:
    """What a node of this name with these attributes, below an rPr or pPr, tells of the properties that lines and heights depend on, as
    packages.property_entries() has them."""
    tag, a = packages.local(name), {packages.local(k): v for k, v in of}
    if tag not in ("sz", "rFonts", "b", "ind", "spacing", "pStyle", "rStyle"):
        return ()
    points = lambda k, per=20.0: None if (v := double(a.get(k))) is None else v / per
    if tag == "sz":
        found = [("size_pt", points("val", 2.0))]
    elif tag == "rFonts":
        found = [("font", first(a.get("ascii"), a.get("hAnsi"), a.get("cs"))), ("font_theme", first(a.get("asciiTheme"), a.get("hAnsiTheme"), a.get("cstheme")))]
    elif tag == "b":
        found = [("bold", "false" if a.get("val") in ("false", "0", "none") else "true")]
    elif tag == "ind":
        found = [("indent_left_pt", points("left")), ("indent_right_pt", points("right"))]
    elif tag == "spacing":
        line = ("line_pt", points("line")) if a.get("lineRule") in ("exact", "atLeast") else ("line_mult", points("line", 240.0))
        found = [("space_before_pt", points("before")), ("space_after_pt", points("after")), line]
    else:
        found = [("style", a.get("val"))]
    return tuple((k, v) for k, v in found if v is not None)


def below(el: ElementTree.Element, holder: str) -> tuple[tuple[str, str | float], ...]:
    """What the nodes in the rPr or pPr of el tell, in order."""
    out = ()
    for h in el:
        if NAMES[h.tag] == holder:
            for node in h:
                out += told(node.tag, tuple(node.items()))
    return out


def slots(theme: bytes | None) -> dict[str, str]:
    """Values of the slots of a theme."""
    out: dict[str, str] = {}
    root = parsed(theme)
    for scheme in () if root is None else root.iter():
        if NAMES[scheme.tag] in ("clrScheme", "fontScheme"):
            for slot in scheme:
                for leaf in slot:
                    if key := {"latin": "typeface", "srgbClr": "val", "sysClr": "lastClr"}.get(NAMES[leaf.tag]):
                        if value := attrs(leaf).get(key):
                            out.setdefault(re.sub("Font$", "", NAMES[slot.tag]), value)
    return out


def single(entries: Iterable[tuple[str, str | float]], theme: dict[str, str]) -> dict[str, str | float]:
    """Run properties by key, typefaces of the theme by their names; of several values that which is last as text."""
    out: dict[str, str | float] = {}
    for k, v in entries:
        if k == "font_theme":
            k, v = "font", theme.get("major" if v.startswith("major") else "minor")
        if v is not None and (k not in out or str(v) > str(out[k])):
            out[k] = v
    return out


class Styles:
    """Properties of the named styles, with what they inherit, and the document's defaults."""

    def __init__(self, styles: bytes | None, theme: bytes | None) -> None:
        self.theme = slots(theme)
        self.own: dict[str, dict[str, dict]] = {}
        self.up: dict[str, str | None] = {}
        defaults, marks = (), ()
        root = parsed(styles)
        for el in () if root is None else root.iter():
            tag = NAMES[el.tag]
            if tag == "style":
                if (name := attrs(el).get("styleId")) is not None:
                    held = self.own.setdefault(name, {"rPr": {}, "pPr": {}})
                    for holder, known in held.items():
                        for k, v in below(el, holder):
                            known.setdefault(k, v)
                    self.up[name] = next((attrs(b).get("val") for b in el if NAMES[b.tag] == "basedOn"), None)
            elif tag == "rPrDefault":
                defaults += below(el, "rPr")
                marks += below(el, "pPr")
        self.default = single(defaults, self.theme)
        declared = [v for k, v in defaults + marks if k == "font"]
        self.usual = max(declared) if declared else single(defaults + marks, self.theme).get("font", FALLBACK)
        self.runs, self.paragraphs, self.faces = {}, {}, {}
        for name in self.own:
            self.runs[name] = single(self.inherited(name, "rPr").items(), self.theme)
            self.paragraphs[name] = self.inherited(name, "pPr")

    def face(self, style: str | None, props: tuple) -> tuple[str, float, float, bool]:
        """Typeface, size, relative width and weight of a run with properties of its own in a paragraph of this style."""
        if (style, props) not in self.faces:
            if len(self.faces) >= KNOWN:
                self.faces.clear()
            held = self.default | self.runs.get(style, {}) | single(props, self.theme)
            font = held.get("font", self.usual)
            self.faces[style, props] = font, held.get("size_pt", 11.0), metrics.scale_of(font), held.get("bold") == "true"
        return self.faces[style, props]

    def inherited(self, name: str, holder: str) -> dict[str, str | float]:
        out, chain = {}, []
        while name in self.own and name not in chain:
            chain.append(name)
            for k, v in self.own[name][holder].items():
                out.setdefault(k, v)
            name = self.up[name]
        return out


#: Packages of one make share their styles and their theme.
styles_of = lru_cache(maxsize=64)(Styles)


class Run:
    __slots__ = ("props", "texts", "images", "high", "page_break")

    def __init__(self, props: tuple) -> None:
        self.props, self.texts, self.images, self.high, self.page_break = props, [], 0, (), False


class Paragraph:
    """ends: how many sections end before it. tabled: whether it lies in a table."""

    __slots__ = ("id", "ends", "tabled", "tc", "props", "runs")

    def __init__(self, number: int, ends: int, tabled: bool, tc: Cell | None, props: tuple) -> None:
        self.id, self.ends, self.tabled, self.tc, self.props, self.runs = number, ends, tabled, tc, props, []


class Table:
    """rows: cells by the number of a row and how many sections end before it. top: whether it lies in no cell."""

    __slots__ = ("id", "top", "grid", "rows")

    def __init__(self, number: int, top: bool) -> None:
        self.id, self.top, self.grid, self.rows = number, top, [], {}


class Cell:
    """paragraphs: the places of its own among all."""

    __slots__ = ("outer", "top", "width", "turned", "paragraphs", "image_pt")

    def __init__(self, outer: Cell | None, top: bool) -> None:
        self.outer, self.top, self.width, self.turned, self.paragraphs, self.image_pt = outer, top, None, False, [], 0.0


def section(el: ElementTree.Element) -> tuple[float, float, int]:
    """Room in width and height, and columns."""
    held: dict[tuple[str, str], list[str]] = {}
    for x in el:
        for k, v in attrs(x).items():
            held.setdefault((NAMES[x.tag], k), []).append(v)
    at = {k: max((d for v in held.get((tag, name), ()) if (d := double(v)) is not None), default=float(twips)) / 20 for k, (tag, name, twips) in SIDES.items()}
    columns = max(1, max((n for v in held.get(("cols", "num"), ()) if (n := whole(v)) is not None), default=1))
    return (at["page_w_pt"] - at["left_pt"] - at["right_pt"] - (columns - 1) * at["col_space_pt"]) / columns, at["page_h_pt"] - at["top_pt"] - at["bottom_pt"], columns


USUAL = (PAGE["page_w_pt"] - PAGE["left_pt"] - PAGE["right_pt"], PAGE["page_h_pt"] - PAGE["top_pt"] - PAGE["bottom_pt"], PAGE["columns"])


READ = frozenset(("p", "r", "t", "tbl", "tr", "tc", "sectPr", "tcW", "gridCol", "textDirection", "blip", "ext", "br"))


class Body:
    """The paragraphs, tables and sections of a main part, with the innermost of each that encloses another, as packages.nodes() numbers them."""

    def __init__(self, root: ElementTree.Element) -> None:
        self.paragraphs: list[Paragraph] = []
        self.tables: list[Table] = []
        self.sections: list[tuple[float, float, int]] = []
        number, todo = -1, [(root, None, None, None, None, None)]
        while todo:
            el, p, r, tbl, tr, tc = todo.pop()
            number += 1
            tag = NAMES[el.tag]
            if tag not in READ:
                pass
            elif tag == "t":
                if r is not None and el.text is not None:
                    r.texts.append(el.text)
            elif tag == "r":
                r = Run(below(el, "rPr"))
                if p is not None:
                    p.runs.append(r)
            elif tag == "p":
                p = Paragraph(number, len(self.sections), tbl is not None, tc, below(el, "pPr"))
                if tc is not None:
                    tc.paragraphs.append(len(self.paragraphs))
                self.paragraphs.append(p)
            elif tag == "tbl":
                tbl = Table(number, tc is None)
                self.tables.append(tbl)
            elif tag == "tr":
                tr = (number, len(self.sections))
            elif tag == "tc":
                tc = Cell(tc, tbl is not None and tr is not None and tbl.top)
                if tc.top:
                    tbl.rows.setdefault(tr, []).append(tc)
            elif tag == "sectPr":
                self.sections.append(section(el))
            elif tag == "tcW":
                a = attrs(el)
                if tc is not None and a.get("type") == "dxa" and (w := a.get("w")) is not None and (tc.width is None or w > tc.width):
                    tc.width = w
            elif tag == "gridCol":
                if tbl is not None:
                    tbl.grid.append(double(attrs(el).get("w")) or 0.0)
            elif tag == "textDirection":
                if tc is not None:
                    tc.turned = True
            elif tag == "blip":
                if r is not None:
                    r.images += 1
            elif tag == "ext":
                if r is not None and not r.high and (cy := attrs(el).get("cy")) is not None:
                    r.high = (h / 12700 if (h := double(cy)) is not None else None,)
            elif tag == "br" and r is not None and attrs(el).get("type") == "page":
                r.page_break = True
            if len(el):
                for child in el[::-1]:
                    todo.append((child, p, r, tbl, tr, tc))

    def place(self, ends: int) -> tuple[int, tuple[float, float, int]]:
        """The section, and its rooms, of what has so many ends of sections before it."""
        at = min(ends, max(len(self.sections) - 1, 0))
        return at, self.sections[at] if self.sections else USUAL


class Words:
    """Widths of the words of many texts, looked up at once."""

    def __init__(self) -> None:
        self.texts: dict[bool, list[str]] = {False: [], True: []}
        self.count = {False: 0, True: 0}
        self.units: dict[bool, list[int]] = {}

    def add(self, text: str, bold: bool) -> tuple[int, int]:
        begin, n = self.count[bold], text.count(" ") + 1
        self.texts[bold].append(text)
        self.count[bold] = begin + n
        return begin, begin + n

    def of(self, bold: bool) -> list[int]:
        if bold not in self.units:
            self.units[bold] = metrics.word_units(" ".join(self.texts[bold]), bold)
        return self.units[bold]


class Measured:
    """The runs of a paragraph in their typefaces, its pictures and breaks."""

    __slots__ = ("words", "runs", "image_pt", "page_break", "size", "height")

    def __init__(self, p: Paragraph, style: str | None, of: Styles, words: Words) -> None:
        self.words, self.runs, self.image_pt, self.page_break = words, [], 0.0, False
        most, font = None, None
        for r in p.runs:
            text = "".join(r.texts)
            self.page_break = self.page_break or r.page_break
            if text or r.images:
                self.image_pt += r.images * (r.high[0] if r.high and r.high[0] is not None else 0.0)
                name, size, scale, bold = of.face(style, r.props)
                self.runs.append((*words.add(text, bold), size, scale, bold))
                if most is None or size >= most:
                    most, font = size, name
        self.size = most if most is not None and most > 0 else 11.0
        self.height = metrics.height_of(font)

    def lines(self, room: float) -> int:
        return metrics.lines_of_words([(self.words.of(bold)[begin:end], size, scale, bold) for begin, end, size, scale, bold in self.runs], room)


def rows_of(body: Body, of: Styles) -> Iterator[dict]:
    """What flow.pagination() needs of the paragraphs of the body and the rows of its tables, as estimate.flow_rows() has it."""
    words, measured = Words(), {}
    for i, p in enumerate(body.paragraphs):
        # of those in tables within cells only pictures count
        if not p.tabled or p.tc is not None and p.tc.top or any(r.images for r in p.runs):
            props = dict(reversed(p.props))
            style = props.get("style")
            measured[i] = m = Measured(p, style, of, words), of.paragraphs.get(style, {}) | props
            cell = p.tc if m[0].image_pt > 0 else None
            while cell is not None:
                cell.image_pt += m[0].image_pt
                cell = cell.outer
    for i, (m, props) in measured.items():
        p = body.paragraphs[i]
        if not p.tabled:
            at, (w, h, columns) = body.place(p.ends)
            lines = m.lines(max(w - props.get("indent_left_pt", 0.0) - props.get("indent_right_pt", 0.0), LEAST_ROOM))
            line_h = props.get("line_pt", 0.0) or m.size * m.height * props.get("line_mult", 1.0)
            yield {"block": p.id, "n": p.id, "kind": "text", "section": at, "lines": lines, "line_h": line_h, "before": props.get("space_before_pt", 0.0), "after": props.get("space_after_pt", 0.0), "extra": m.image_pt, "forced": m.page_break, "columns": columns, "room": h}
    for t in body.tables:
        if t.rows:
            grid = sum(t.grid) / 20 / (len(t.grid) or len(t.rows[min(t.rows)]))
            for (n, ends), cells in t.rows.items():
                tallest = None
                for c in cells:
                    declared = double(c.width)
                    width = declared / 20 if declared else grid
                    room = max((max(width, TURNED) if c.turned else width) - MARGINS, LEAST_CELL)
                    text = 0.0
                    for i in c.paragraphs:
                        m = measured[i][0]
                        text += m.lines(room) * m.size * m.height
                    height = text + c.image_pt + ROW_EXTRA
                    tallest = height if tallest is None else max(tallest, height)
                at, (_, h, columns) = body.place(ends)
                yield {"block": t.id, "n": n, "kind": "unit", "section": at, "lines": 1, "line_h": tallest, "before": 0.0, "after": 0.0, "extra": 0.0, "forced": False, "columns": columns, "room": h}


def placements(document: bytes | None, styles: bytes | None, theme: bytes | None) -> list[tuple]:
    """(place, block, kind, section, page, page_end, column, lines, height_pt) of the blocks of a package's body, in order."""
    root = parsed(document)
    if root is None:
        return []
    sections: dict[int, list[dict]] = {}
    for b in rows_of(Body(root), styles_of(styles, theme)):
        sections.setdefault(b["section"], []).append(b)
    found: dict[tuple[int, int], list] = {}
    base = 0
    for at in sorted(sections):
        rows = sorted(sections[at], key=lambda b: b["n"])
        columns, turns = max(1, rows[0]["columns"]), 0
        for b, begin, turns in flow.poured(rows, 0, 0):
            height = b["lines"] * b["line_h"] + b["extra"]
            page, page_end, column = base + begin // columns + 1, base + turns // columns + 1, turns % columns + 1
            held = found.get((b["block"], at))
            if held is None:
                found[b["block"], at] = ["paragraph" if b["kind"] == "text" else "table", at, page, page_end, column, b["lines"], height]
            else:
                held[3:] = page_end, column, held[5] + b["lines"], held[6] + height
        base += turns // columns + 1
    return [(place, block, *held[:-1], float(held[-1])) for place, ((block, _), held) in enumerate(sorted(found.items()), 1)]


def placed(of_packages: DataFrame) -> DataFrame:
    """path and what placements() gives of packages in rows of (path, document, styles, theme: the contents of these parts, null where there is none; of themes
    the first). One package is held at a time, with a batch of them; no package needs rows of another, so nothing is shuffled."""
    kinds = [pa.string() if x.split()[1] == "string" else pa.float64() if x.split()[1] == "double" else pa.int32() for x in PLACED.split(", ")]
    names = [x.split()[0] for x in PLACED.split(", ")]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        for b in batches:
            for path, *parts in zip(*b.columns, strict=True):
                path = path.as_py()
                found += [(path, *row) for row in placements(*(x.as_py() for x in parts))]
                if len(found) >= BATCH:
                    yield batch(found)
                    found = []
        if found:
            yield batch(found)

    out = of_packages.select("path", "document", "styles", "theme").mapInArrow(step, PLACED.replace("column int", "`column` int"))
    return out.withColumn("height_pt", F.round("height_pt", 1))
