"""String functions as column expressions, and the repair of cut JSON."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: What replaces inline HTML in Markdown, in this order.
HTML_TO_MARKDOWN = [
    ("(?i)&nbsp;", " "),
    (r"(?i)<br\s*/?>", "\n"),
    ("(?i)</?(?:b|strong)>", "**"),
    ("(?i)</?(?:i|em)>", "*"),
    ("(?i)<sup>([^<]*)</sup>", "$1"),
    ("(?i)<sub>([^<]*)</sub>", "$1"),
    ("(?i)</?(?:div|p|span|u)[^>]*>", "\n"),
    ("(?i)</?[a-z][^>]*>", ""),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
]


def fallback_paragraphs(text: Column) -> Column:
    """Texts between blank lines, white space squeezed, without empty ones; null for null."""
    squeezed = F.transform(F.split(text, r"\n\s*\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))
    return F.filter(squeezed, lambda s: s != "")


def sanitized(markdown: Column) -> Column:
    for pattern, by in HTML_TO_MARKDOWN:
        markdown = F.regexp_replace(markdown, pattern, by)
    return F.regexp_replace(markdown, r"^\s+|\s+$", "")


def et_al_runs(text: Column) -> Column:
    """array<struct<text, italics>>: the text cut at every "et al.", which is in italics; empty pieces are left out."""
    # both looks keep the mark as a piece of its own
    pieces = F.filter(F.split(text, r"(?=\bet al\.)|(?<=\bet al\.)"), lambda s: s != "")
    return F.transform(pieces, lambda s: F.struct(s.alias("text"), (s == "et al.").alias("italics")))


def footer_pieces(template: Column) -> Column:
    """array<struct<text, field>>: of the runs of digits the first is the page number, the second the number of pages."""
    pieces = F.regexp_extract_all(template, F.lit(r"([0-9]+|[^0-9]+)"), 1)
    digits = lambda s: s.rlike("^[0-9]")

    def one(s: Column, i: Column) -> Column:
        nth = F.size(F.filter(F.slice(pieces, F.lit(1), i + 1), digits))
        return F.struct(s.alias("text"), F.when(digits(s) & (nth == 1), "CURRENT").when(digits(s) & (nth == 2), "TOTAL_PAGES").alias("field"))

    return F.transform(pieces, one)


def absolute_images(html: Column, base: str) -> Column:
    """src of img made absolute below base, unless it has a scheme or is absolute."""
    return F.regexp_replace(html, r"""(<img\b[^>]*?\bsrc=["'])(?![a-zA-Z][a-zA-Z0-9+.-]*:|/)""", "$1" + base.rstrip("/").replace("\\", "\\\\").replace("$", "\\$") + "/")


def origin_cells(cells: Column, row: Column, col: Column) -> Column:
    """Of a row's cells (text, start_row, start_col), the text where a span begins, else an empty one."""
    return F.transform(cells, lambda c, i: F.when((c["start_row"] == row) & (c["start_col"] == i), c["text"]).otherwise(""))


def closed_brackets(text: str) -> str:
    """Cut JSON with its string, arrays and objects closed; a comma at the end goes."""
    open_ones = []
    for piece in re.findall(r'"(?:[^"\\]|\\.)*(?:"|\\?\Z)|[{}\[\]]', text, re.S):
        if piece in "{[":
            open_ones.append("}" if piece == "{" else "]")
        elif piece in "}]" and open_ones:
            open_ones.pop()
        elif piece[0] == '"' and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', piece, re.S):
            open_ones.append('"')
    return re.sub(r",\s*\Z", "", text) + "".join(reversed(open_ones))


def lenient(raw: str | None) -> str | None:
    """The layout object within a model's answer as JSON: fenced, within prose or cut off. None if there is none."""
    text = (raw or "").strip()
    if fence := re.search(r"```[a-zA-Z]*\s*\n(.*?)```", text, re.S):
        text = fence[1].strip()
    first, last = text.find("{"), text.rfind("}")
    if first < 0:
        return None
    text = text[first : last + 1] if last > first else text[first:]
    for attempt in (text, closed_brackets(text)):
        try:
            found = json.loads(attempt)
        except ValueError:
            continue
        has = isinstance(found, dict) and any(isinstance(found.get(k), list) for k in ("columns", "blocks"))
        return json.dumps(found, ensure_ascii=False) if has else None
    return None


@F.pandas_udf(StringType())
def lenient_layout(raw: pd.Series) -> pd.Series:
    return pd.Series([lenient(x) for x in raw], dtype=object)
