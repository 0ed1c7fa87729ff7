"""The compact layout of a page as JSON: its check, its text, and its expansion into elements with injected facts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: The width of the body and the padding of a column in twentieths of a point, and colours.
WIDTH, PADDING = 9360, 120
LIGHT, DARK, GRID, GREY = "FFFFFF", "1A1A1A", "A6A6A6", "808080"
NUMBER = re.compile(r"-?\$?[\d,]*\.?\d+%?")
WORD = re.compile(r"[^\W_]{3,}")
ELEMENTS = "place int, path string, kind string, text string, level int, fill string, color string, width int, border int, border_color string, bold boolean, italic boolean, align string"
COLUMNS = [c.split()[0] for c in ELEMENTS.split(", ")]


def strict(raw: str | None) -> dict:
    """The layout object of a model's answer; ValueError says what it lacks."""
    text = re.sub(r"\A\s*```[a-zA-Z]*\s*\n|\n?```\s*\Z", "", raw or "")
    first, last = text.find("{"), text.rfind("}")
    if first < 0 or last <= first:
        raise ValueError("no JSON object in model output")
    try:
        found = json.loads(text[first : last + 1])
    except ValueError as e:
        raise ValueError(f"invalid JSON: {e}") from None
    if not any(isinstance(found.get(k), list) for k in ("columns", "blocks")):
        raise ValueError("JSON has neither columns nor blocks")
    return found


@F.pandas_udf(StringType())
def layout_error(raw: pd.Series) -> pd.Series:
    """Null for a layout that may be rendered, else what is wrong with it."""

    def one(text: str | None) -> str | None:
        try:
            strict(text)
        except ValueError as e:
            return str(e).split(":")[0]
        return None

    return pd.Series([one(x) for x in raw], dtype=object)


def columns_of(layout: dict) -> list[list[dict]]:
    found = layout.get("columns") or [{"blocks": layout.get("blocks")}]
    return [[b for b in (c.get("blocks") or []) if isinstance(b, dict)] for c in found if isinstance(c, dict)]


def cell_text(cell) -> str:
    if isinstance(cell, dict):
        return str(cell.get("text") or "")
    return "" if cell is None else str(cell)


def layout_text(layout: dict) -> str:
    """All of its words: title, texts, items and cells."""
    out = [layout.get("title")]
    for blocks in columns_of(layout):
        for b in blocks:
            out += [b.get("text"), *(b.get("items") or []), *(cell_text(c) for row in b.get("rows") or [] for c in row)]
    return " ".join(str(x) for x in out if x)


def with_images(layout: dict, assets: list[str]) -> dict:
    """Assets that no block shows follow as images at the end of the last column."""
    shown = {str(b.get("file")).rsplit("/", 1)[-1] for blocks in columns_of(layout) for b in blocks if b.get("t") == "img" and b.get("file")}
    more = [{"t": "img", "file": f} for f in assets if f not in shown]
    if not more:
        return layout
    if layout.get("columns"):
        *before, last = layout["columns"]
        return {**layout, "columns": [*before, {**last, "blocks": [*(last.get("blocks") or []), *more]}]}
    return {**layout, "blocks": [*(layout.get("blocks") or []), *more]}


def hex_of(color) -> str | None:
    return str(color).removeprefix("#").upper()[:6].rjust(6, "0") if color else None


def contrast(fill: str | None) -> str | None:
    """Light text on dark fills, dark on light ones."""
    if not fill:
        return None
    r, g, b = (int(fill[i : i + 2], 16) for i in (0, 2, 4))
    return LIGHT if 299 * r + 587 * g + 114 * b < 550 * 255 else DARK


def border_size(width) -> int:
    """In eighths of a point; an unknown or zero stroke is one point wide."""
    return max(2, int((float(width) if width else 1.0) * 8 + 0.5))


def best_fill(text: str, fills: list[dict]) -> str | None:
    """Of the fill whose text shares most words with this one: two at least, where all words of the shorter count one more. The first of equals."""
    own = set(WORD.findall(text.lower()))
    score, best = 1, None
    for f in fills:
        words = set(WORD.findall(str(f.get("text") or "").lower()))
        if f.get("fill") and own and words:
            shared = len(own & words)
            here = shared + (shared == min(len(own), len(words)))
            if here > score:
                score, best = here, f["fill"]
    return hex_of(best)


def split_widths(shares: list[float], width: int) -> list[int]:
    """Whole numbers that add up to width; the last one takes what rounding leaves."""
    out = [max(1, int(s / sum(shares) * width)) for s in shares]
    return [*out[:-1], out[-1] + width - sum(out)]


def table_elements(b: dict, injected: dict, width: int, path: str) -> Iterator[dict]:
    rows = [r for r in b.get("rows") or [] if isinstance(r, list)]
    if not rows:
        return
    n = max(1, *map(len, rows))
    shares = b.get("cols") if isinstance(b.get("cols"), list) and len(b["cols"]) == n and sum(b["cols"]) > 0 else [1] * n
    widths = split_widths(shares, width)
    header = b.get("header") is not False
    below = rows[1:] if header else rows
    texts = [[t for r in below if (t := cell_text(r[c] if c < len(r) else None).strip())] for c in range(n)]
    right = [bool(t) and all(NUMBER.fullmatch(x) for x in t) for t in texts]
    stroke = injected.get("border") or injected.get("frame")
    size, color = (border_size(stroke.get("width")), hex_of(stroke.get("color")) or GREY) if stroke else (4, GRID)
    lead = " ".join(cell_text(c) for c in (rows[0] + ["", ""])[:2])
    fill = hex_of(b.get("fill")) or best_fill(lead, injected.get("fills") or [])
    yield {"path": path, "kind": "table", "width": width, "border": size, "border_color": color}
    for i, row in enumerate(rows):
        top = header and i == 0
        for c in range(n):
            cell = row[c] if c < len(row) else None
            own = cell if isinstance(cell, dict) else {}
            yield {"path": f"{path}/r{i}c{c}", "kind": "cell", "text": cell_text(cell), "width": widths[c], "fill": fill if top else None, "color": contrast(fill) if top else None, "bold": top or bool(own.get("bold")), "italic": bool(own.get("italic")), "align": own.get("align") or ("right" if right[c] else None)}
    yield {"path": path, "kind": "space"}


def block_elements(b: dict, injected: dict, width: int, path: str) -> Iterator[dict]:
    kind, text = b.get("t"), str(b.get("text") or "")
    if kind == "bar":
        fill = hex_of(b.get("fill")) or best_fill(text, injected.get("fills") or [])
        given = hex_of(b.get("color"))
        yield {"path": path, "kind": "bar", "text": text, "fill": fill, "color": given or (None if b.get("fill") else contrast(fill)), "width": width, "bold": True}
        yield {"path": path, "kind": "space"}
    elif kind == "h":
        yield {"path": path, "kind": "heading", "text": text, "level": min(4, int(b.get("level") or 1))}
    elif kind == "p":
        yield {"path": path, "kind": "paragraph", "text": text}
    elif kind == "list":
        for i, item in enumerate(b.get("items") or []):
            yield {"path": f"{path}/{i}", "kind": "item", "text": (f"{i + 1}. " if b.get("ordered") else "• ") + str(item)}
    elif kind == "table":
        yield from table_elements(b, injected, width, path)
    elif kind == "img":
        yield {"path": path, "kind": "image", "text": str(b.get("file")).rsplit("/", 1)[-1], "width": max(80, width // 15)}


def elements(layout: dict, injected: dict | None = None) -> list[dict]:
    """What is to be drawn, in order: title, frame and columns, and the elements of each column with their fills, borders and widths.

    One column without a frame is the page itself; otherwise the columns are cells of a frame, which has a border if the layout or the
    vector layer wants one.
    """
    injected = injected or {}
    columns = columns_of(layout) or [[]]
    out = [{"path": "", "kind": "title", "text": str(layout["title"]), "bold": True, "align": "center"}] if layout.get("title") else []
    ruled = bool(layout.get("frame") or injected.get("frame") or len(columns) > 1 and injected.get("border"))
    if len(columns) == 1 and not ruled:
        widths = [WIDTH]
    else:
        stroke = injected.get("frame") or injected.get("border") or {}
        outer = split_widths([1] * len(columns), WIDTH)
        widths = [w - 2 * PADDING for w in outer]
        out.append({"path": "", "kind": "frame", "width": WIDTH, "border": (border_size(stroke["width"]) if stroke.get("width") else 8) if ruled else None, "border_color": (hex_of(stroke.get("color")) or "000000") if ruled else None})
    for i, (blocks, width) in enumerate(zip(columns, widths, strict=True)):
        if len(out) and out[-1]["kind"] == "frame" or len(columns) > 1:
            out.append({"path": str(i), "kind": "column", "width": width + 2 * PADDING})
        for k, b in enumerate(blocks):
            out += block_elements(b, injected, width, f"{i}/{k}")
    return out


def rendered(layouts: DataFrame, key: list[str], layout: str = "layout", injected: str = "injected") -> DataFrame:
    """key and ELEMENTS of rows with a layout and injected facts as JSON; a layout that can't be read gives none."""
    kinds = dict(layouts.dtypes)

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for *own, raw, facts in b.itertuples(index=False):
                try:
                    found = elements(strict(raw), json.loads(facts) if facts else None)
                except (ValueError, TypeError, AttributeError):
                    continue
                rows += [(*own, i, *(e.get(c) for c in COLUMNS[1:])) for i, e in enumerate(found)]
            out = pd.DataFrame(rows, columns=[*key, *COLUMNS])
            for c in ("place", "level", "width", "border"):
                out[c] = out[c].astype("Int32")
            yield out

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in key)
    return layouts.select(*key, layout, injected).mapInPandas(expand, f"{schema}, {ELEMENTS}")


def significant(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]{3,}"), 0))


def coverage(original: Column, made: Column) -> Column:
    """Share of the distinct words of the original that are made again; 1 without words."""
    words = significant(original)
    return F.when(F.size(words) == 0, 1.0).otherwise(F.size(F.array_intersect(words, significant(made))) / F.size(words))


@F.pandas_udf(StructType([StructField(c, StringType()) for c in ("layout", "text", "error")]))
def checked(raw: pd.Series, assets: pd.Series, injected: pd.Series) -> pd.DataFrame:
    """The layout with all images, its text, or why it can't be rendered."""

    def one(text: str | None, files, facts: str | None) -> tuple:
        try:
            whole = with_images(strict(text), list(files) if files is not None else [])
            elements(whole, json.loads(facts) if facts else None)
        except ValueError as e:
            return None, None, str(e).split(":")[0]
        except (TypeError, AttributeError) as e:
            return None, None, f"layout failed to render: {type(e).__name__}"
        return json.dumps(whole, ensure_ascii=False, separators=(",", ":")), layout_text(whole), None

    return pd.DataFrame([one(*x) for x in zip(raw, assets, injected, strict=True)], columns=["layout", "text", "error"])


def committed(candidates: DataFrame, key: list[str], least: float = 0.6) -> DataFrame:
    """key, ok, coverage, error, layout of candidates (key, layout, injected, assets, text): accepted if the layout can be read and drawn and
    its words cover the page's; the layout is null otherwise."""
    seen = candidates.select(*key, F.col("text").alias("original"), checked("layout", "assets", "injected").alias("c"))
    share = F.when(F.col("c.error").isNull(), coverage(F.col("original"), F.col("c.text")))
    rows = seen.select(*key, share.alias("coverage"), F.col("c.error").alias("error"), F.col("c.layout").alias("layout"))
    ok = F.col("error").isNull() & (F.col("coverage") >= least)
    error = F.coalesce("error", F.when(F.col("coverage") < least, F.concat(F.lit("low fidelity: only "), F.round(F.col("coverage") * 100).cast("int"), F.lit("% of the words"))))
    return rows.select(*key, ok.alias("ok"), "coverage", error.alias("error"), F.when(ok, F.col("layout")).alias("layout"))
