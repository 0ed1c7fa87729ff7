"""Blocks to Word packages: one binary value per document."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAIN_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
#: Characters that XML 1.0 can't hold.
FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff\ufffe\uffff]")
STYLES = {"heading1": ("Heading1", 32), "heading2": ("Heading2", 26), "list": ("ListParagraph", 22), "text": ("Normal", 22)}


def safe(text: str) -> str:
    return escape(FORBIDDEN.sub(" ", text))


def run(text: str, fill: str | None = None) -> str:
    """A run of a text that is safe already."""
    shade = f'<w:rPr><w:shd w:val="clear" w:fill={quoteattr(fill.lstrip("#"))}/></w:rPr>' if fill else ""
    return f'<w:r>{shade}<w:t xml:space="preserve">{text}</w:t></w:r>'


def paragraph(kind: str, text: str, fill: str | None) -> str:
    return f'<w:p><w:pPr><w:pStyle w:val="{STYLES.get(kind, STYLES["text"])[0]}"/></w:pPr>{run(safe(text), fill)}</w:p>'


def table(rows: list[str], width: int = 9360) -> str:
    """Rows of cells that tabs separate; short rows are filled up."""
    cells = [safe(r).split("\t") for r in rows]
    columns = max(map(len, cells))
    each = width // columns
    grid = f'<w:gridCol w:w="{each}"/>' * columns
    before, after = run("\t").split("\t")
    before, after = f'<w:tc><w:tcPr><w:tcW w:w="{each}" w:type="dxa"/></w:tcPr><w:p>{before}', f"{after}</w:p></w:tc>"
    line = lambda row: before + (after + before).join(row + [""] * (columns - len(row))) + after
    return f"<w:tbl><w:tblPr/><w:tblGrid>{grid}</w:tblGrid>" + "".join(f"<w:tr>{line(r)}</w:tr>" for r in cells) + "</w:tbl>"


SECTION = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:right="1440" w:bottom="1440" w:left="1440"/></w:sectPr>'
NAMED = "".join(f'<w:style w:type="paragraph" w:styleId="{s}"><w:name w:val="{s}"/>{"" if s == "Normal" else "<w:basedOn w:val=\"Normal\"/>"}<w:rPr><w:sz w:val="{size}"/></w:rPr></w:style>' for s, size in STYLES.values())
#: The parts that every package has beside the main one.
COMMON = {
    "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="{TYPE}.document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{TYPE}.styles+xml"/></Types>',
    "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="word/document.xml"/></Relationships>',
    "word/_rels/document.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{OFFICE}/styles" Target="styles.xml"/></Relationships>',
    "word/styles.xml": f'<w:styles xmlns:w="{MAIN_NS}">{NAMED}</w:styles>',
}
COMMON = {name: (HEAD + content).encode() for name, content in COMMON.items()}


def members(blocks: list[tuple[str, str, str | None]]) -> dict[str, bytes]:
    """The parts of a package by name, from (kind, text, fill): text, heading1, heading2, list, table (rows by line, cells by tab) and break."""
    body = []
    for kind, text, fill in blocks:
        if kind == "break":
            body.append('<w:p><w:r><w:br w:type="page"/></w:r></w:p>')
        else:
            body.append(table(text.split("\n")) if kind == "table" else paragraph(kind, text, fill))
    return {**COMMON, "word/document.xml": f'{HEAD}<w:document xmlns:w="{MAIN_NS}"><w:body>{"".join(body)}{SECTION}</w:body></w:document>'.encode()}


#: Files below this many bytes are stored as they are: deflating them costs more than it saves.
SMALL = 1024


def archive(files: dict[str, bytes]) -> bytes:
    """Equal files give equal bytes."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_STORED if len(content) < SMALL else zipfile.ZIP_DEFLATED)
    return out.getvalue()


def package(blocks: list[tuple[str, str, str | None]]) -> bytes:
    return archive(members(blocks))


def documents(blocks: DataFrame) -> DataFrame:
    """path, content from rows (path, n, kind, text, fill), in the order of n, rows without n last. Null texts are empty."""
    return written(blocks.groupBy("path").agg(F.collect_list(F.struct("n", "kind", "text", "fill")).alias("rows")))


def written(docs: DataFrame, change: Callable[[str, dict[str, bytes]], dict[str, bytes]] | None = None) -> DataFrame:
    """path, content of documents that lie in a row each: path, rows (array of n, kind, text, fill). change: the parts of a package, from its path and the parts made."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b.column(1).flatten()
            n, kind, text, fill = (flat.field(i).to_pylist() for i in range(4))
            held, size, end = [], 0, 0
            for path, many in zip(b.column(0).to_pylist(), b.column(1).value_lengths().to_pylist(), strict=True):
                start, end = end, end + (many or 0)
                order = sorted(range(start, end), key=lambda i: (n[i] is None, n[i] or 0))
                files = members([(kind[i], text[i] or "", fill[i]) for i in order])
                held.append((path, archive(change(path, files) if change else files)))
                size += len(held[-1][1])
                if size > 8 << 20:
                    yield batch(held)
                    held, size = [], 0
            if held:
                yield batch(held)

    def batch(rows: list[tuple[str, bytes]]) -> pa.RecordBatch:
        path, content = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(content, pa.binary())], ["path", "content"])

    rows = F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in ("n", "kind", "text", "fill")]))
    return docs.select("path", rows.alias("rows")).mapInArrow(write, "path string, content binary")
