"""Widths and heights of text from glyph tables, and greedy wrapping, as column expressions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Advance widths in thousandths of an em of the characters from space to tilde, in order.
REGULAR = [
    170, 282, 395, 790, 646, 974, 734, 245, 295, 295, 479, 606, 270, 498, 286, 429, 732, 371, 600, 609, 630, 616, 597, 543, 628, 597, 286, 306, 606, 606, 606, 499,
    929, 652, 693, 781, 742, 612, 581, 821, 736, 256, 383, 654, 531, 836, 736, 878, 643, 878, 641, 646, 512, 700, 652, 984, 597, 623, 584, 315, 429, 315, 606, 598,
    352, 572, 667, 600, 667, 615, 393, 662, 573, 229, 229, 548, 229, 908, 573, 655, 667, 667, 338, 509, 388, 573, 517, 797, 487, 536, 449, 317, 300, 317, 606,
]
BOLD = [
    178, 371, 498, 915, 647, 1046, 793, 311, 379, 379, 540, 660, 357, 600, 378, 506, 708, 403, 597, 611, 654, 615, 602, 559, 632, 602, 378, 398, 660, 660, 660, 583,
    927, 712, 691, 774, 740, 595, 586, 808, 733, 279, 393, 679, 543, 893, 741, 878, 648, 878, 661, 647, 542, 718, 697, 1020, 661, 660, 571, 416, 506, 415, 660, 663,
    381, 580, 672, 608, 672, 612, 406, 652, 593, 252, 252, 577, 252, 924, 593, 652, 672, 672, 374, 514, 413, 593, 566, 883, 558, 586, 481, 398, 395, 398, 660,
]
AVERAGE, AVERAGE_BOLD = 540, 574
#: Widths of other typefaces relative to those of the tables, and single line heights in em.
SCALE = {"plus jakarta sans": 1.0, "jakarta sans": 1.0, "plusjakartasans": 1.0, "calibri": 0.87, "arial": 0.90, "helvetica": 0.90, "times new roman": 0.82, "cambria": 0.85, "georgia": 0.91, "verdana": 1.02, "courier new": 1.04, "tahoma": 0.91, "segoe ui": 0.89}
HEIGHT = {"plus jakarta sans": 1.26, "jakarta sans": 1.26, "plusjakartasans": 1.26, "calibri": 1.15, "arial": 1.15, "helvetica": 1.15, "times new roman": 1.15, "cambria": 1.17, "georgia": 1.14, "verdana": 1.21, "courier new": 1.13, "tahoma": 1.21, "segoe ui": 1.33}
DEFAULT_FONT, DEFAULT_HEIGHT = "plus jakarta sans", 1.26


def literal(of: dict) -> Column:
    return F.expr("map(" + ", ".join(f"'{k}', {v}D" for k, v in of.items()) + ")")


def name(font: Column) -> Column:
    return F.lower(F.trim(F.coalesce(F.nullif(font, F.lit("")), F.lit(DEFAULT_FONT))))


def line_height(font: Column) -> Column:
    """In em; unknown and null typefaces have the default."""
    return F.coalesce(F.try_element_at(literal(HEIGHT), name(font)), F.lit(DEFAULT_HEIGHT))


def units(text: Column, bold: Column) -> Column:
    """Width in thousandths of an em of the typeface of the tables, an integer."""
    of = lambda table, average: F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: a + F.when(c == "", 0).otherwise(F.coalesce(F.get(F.expr(f"array({', '.join(map(str, table))})"), F.ascii(c) - 32), F.lit(average))))
    return F.when(F.coalesce(bold, F.lit(False)), of(BOLD, AVERAGE_BOLD)).otherwise(of(REGULAR, AVERAGE))


def text_width(text: Column, size: Column, font: Column, bold: Column) -> Column:
    """In points; null for null text or size."""
    return units(text, bold) / 1000 * size * F.coalesce(F.try_element_at(literal(SCALE), name(font)), F.lit(1.0))


#: Glyph widths by code point, and at the end the average of all others, per table.
GLYPHS = {bold: np.array([average] * 32 + table + [average], dtype=np.int64) for bold, table, average in ((False, REGULAR, AVERAGE), (True, BOLD, AVERAGE_BOLD))}
BLANK = {False: REGULAR[0], True: BOLD[0]}


def word_units(text: str, bold: bool) -> list[int]:
    """Widths of the words between blanks, as units() gives them: the text's characters are looked up at once."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    along = np.concatenate(([0], np.cumsum(GLYPHS[bold][np.minimum(points, 127)])))
    blanks = np.flatnonzero(points == 32)
    begins, ends = np.concatenate(([0], blanks + 1)), np.concatenate((blanks, [len(points)]))
    return (along[ends] - along[begins]).tolist()


def lines_of(runs: list[dict] | None, room: float | None) -> int:
    """Lines of runs (text, size, scale, bold) wrapped greedily as one text. Sums run in the order of the words, so they are the same however texts are split."""
    held = [r or {"text": None, "size": None, "scale": 1.0, "bold": False} for r in runs or ()]
    return lines_of_words([(word_units(r["text"] or "", bool(r["bold"])), 0.0 if r["size"] is None else r["size"], r["scale"], bool(r["bold"])) for r in held], room)


def lines_of_words(runs: list[tuple[list[int], float, float, bool]], room: float | None) -> int:
    """lines_of() of runs of word_units, size, scale, bold."""
    lines, at, room = 1, 0.0, float("inf") if room is None else room
    for words, size, scale, bold in runs:
        space = BLANK[bold] / 1000 * size * scale
        for units in words:
            w = units / 1000 * size * scale
            if at > 0:
                wider = at + space + w
                if wider > room:
                    lines, at = lines + 1, w
                else:
                    at = wider
            else:
                at += w
    return lines


def face(font: str | None) -> str:
    """name() of a value."""
    return (font or DEFAULT_FONT).strip(" ").lower()


def scale_of(font: str | None) -> float:
    return SCALE.get(face(font), 1.0)


def height_of(font: str | None) -> float:
    """line_height() of a value."""
    return HEIGHT.get(face(font), DEFAULT_HEIGHT)


def wrapped(runs: Column, room: Column) -> Column:
    """Lines of an array of runs (text, size, font, bold) within room points."""
    one = lambda r: F.struct(r["text"].alias("text"), r["size"].cast("double").alias("size"), F.coalesce(F.try_element_at(literal(SCALE), name(r["font"])), F.lit(1.0)).alias("scale"), r["bold"].alias("bold"))

    @F.arrow_udf("int")
    def counted(runs: pa.Array, room: pa.Array) -> pa.Array:
        return pa.array([lines_of(r.as_py(), w) for r, w in zip(runs, room.to_pylist(), strict=True)], pa.int32())

    return counted(F.transform(runs, one), room.cast("double"))


def wrapped_lines(text: Column, size: Column, font: Column, bold: Column, room: Column) -> Column:
    """Lines of a text wrapped greedily at spaces within room points; a word wider than that has a line of its own. At least 1."""
    return wrapped(F.array(F.struct(text.alias("text"), size.alias("size"), font.alias("font"), bold.alias("bold"))), room)


def wrapped_runs(runs: Column, room: Column) -> Column:
    """lines, size, font of an array of runs (text, size, font, bold) wrapped as one text: words are cut at blanks and where runs meet, and measured in their
    own typeface; a blank before a word is as wide as one of the word's run. size is the largest, font that of the last run of this size. Without runs 1 line of 11 points."""
    some = F.coalesce(F.size(runs) > 0, F.lit(False))

    lines = wrapped(runs, room)
    size = F.array_max(F.transform(runs, lambda r: r["size"]))
    font = F.element_at(F.filter(runs, lambda r: r["size"] == size), -1)["font"]
    usual = F.lit(DEFAULT_FONT)
    return F.struct(F.when(some, lines).otherwise(1).alias("lines"), F.when(some & (size > 0), size).otherwise(F.lit(11.0)).cast("double").alias("size"), F.when(some, F.coalesce(F.nullif(font, F.lit("")), usual)).otherwise(usual).alias("font"))
