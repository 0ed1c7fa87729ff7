"""Word packages as relations: parts of the archive, and one row per XML node of them.

Only unzipping and XML parsing are Python; styles, relationships, sections, paragraphs and tables are joins and aggregates
over the node rows. A package or part that can't be read gives one row with its error and stops nothing.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from xml.etree import ElementTree

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.intervals import covering

PARTS = "path string, pos int, part string, content binary, error string"
NODES = "path string, pos int, part string, id int, last int, parent int, depth int, tag string, attrs map<string,string>, text string, p int, r int, tbl int, tr int, tc int, error string"
#: Nodes are numbered in document order; what lies below a node has the numbers after its id up to its last.
#: The innermost enclosing node of these tags, the node itself included, is on every row.
ENCLOSING = ("p", "r", "tbl", "tr", "tc")
REQUIRED = ("[Content_Types].xml", "_rels/.rels", "word/document.xml")
MAIN, STYLES = "word/document.xml", "word/styles.xml"


#: Most bytes that a part may unpack to; a declaration of entities, which can grow without bound, is not read at all.
LARGEST = 256 << 20


#: A batch of rows leaves a task once it holds this many bytes of parts, or this many rows.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 20_000


def parts(files: DataFrame, largest: int = LARGEST) -> DataFrame:
    """One row per member of the archives in (path, content), in archive order; error where content is no archive, or a member is torn or too large."""
    types = (pa.string(), pa.int32(), pa.string(), pa.binary(), pa.string())
    columns = [c.split()[0] for c in PARTS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], columns)

    def members(path: str, content: bytes | None) -> Iterator[tuple]:
        try:
            with zipfile.ZipFile(io.BytesIO(content or b"")) as z:
                for pos, info in enumerate(z.infolist()):
                    yield path, pos, info.filename, *member(z, info)
        except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError, ValueError) as e:
            yield path, None, None, None, str(e)

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for path, content in zip(b.column(0), b.column(1), strict=True):
                for row in members(path.as_py(), content.as_py()):
                    held.append(row)
                    size += len(row[3] or b"")
                    if size > BATCH_BYTES or len(held) >= BATCH_ROWS:
                        yield batch(held)
                        held, size = [], 0
        if held:
            yield batch(held)

    def member(z: zipfile.ZipFile, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        try:
            with z.open(info) as f:
                content = f.read(largest + 1)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError) as e:
            return None, str(e) or type(e).__name__
        return (content, None) if len(content) <= largest else (None, f"larger than {largest} bytes")

    return files.select("path", "content").mapInArrow(unzip, PARTS)


def local(name: str) -> str:
    return name.rpartition("}")[2]


class Rows:
    """Node rows held column by column, as NODES has them or those of its columns that are named; keys and values of the attributes lie flat, with where each row's begin."""

    def __init__(self, tags: frozenset[str] | None, columns: Iterable[str] | None = None) -> None:
        self.tags = tags
        names = [c.split()[0] for c in NODES.split(", ")]
        self.columns: dict[str, list] = {c: [] for c in names if columns is None or c in columns}
        self.keys: list[str] = []
        self.values: list[str] = []
        self.begins: list[int] = []

    def __len__(self) -> int:
        return len(self.begins)

    def add(self, path: str, pos: int, part: str, content: bytes | None) -> None:
        """The nodes of a part in document order, of them those of the tags; a malformed part has one row with id null and the error."""
        try:
            if b"<!ENTITY" in (content or b""):
                raise ValueError("declares entities")
            root = ElementTree.fromstring(content or b"")
        except (ElementTree.ParseError, ValueError, LookupError) as e:
            self.extend(path, pos, part, [(None,) * 12], [None], str(e))
            return
        tags, parents, rows, names = self.tags, [], [], {}
        todo = [(root, None, 0, None, None, None, None, None)]
        while todo:
            el, parent, depth, p, r, tbl, tr, tc = todo.pop()
            number = len(parents)
            tag = names.get(el.tag)
            if tag is None:
                tag = names[el.tag] = local(el.tag)
            if tag in ENCLOSING:
                if tag == "p":
                    p = number
                elif tag == "r":
                    r = number
                elif tag == "tc":
                    tc = number
                elif tag == "tr":
                    tr = number
                else:
                    tbl = number
            if tags is None or tag in tags:
                rows.append((number, parent, depth, tag, el.attrib, el.text, p, r, tbl, tr, tc, None))
            parents.append(parent)
            if len(el):
                depth += 1
                for child in el[::-1]:
                    todo.append((child, number, depth, p, r, tbl, tr, tc))
        last = list(range(len(parents)))
        for i in range(len(parents) - 1, 0, -1):
            if last[i] > last[parents[i]]:
                last[parents[i]] = last[i]
        if rows:
            self.extend(path, pos, part, rows, [last[row[0]] for row in rows], None)

    def extend(self, path: str, pos: int, part: str, rows: list[tuple], last: list[int | None], error: str | None) -> None:
        number, parent, depth, tag, attrs, text, p, r, tbl, tr, tc, _ = zip(*rows, strict=True)
        same = len(rows)
        found = {"path": [path] * same, "pos": [pos] * same, "part": [part] * same, "id": number, "last": last, "parent": parent, "depth": depth, "tag": tag, "text": text, "p": p, "r": r, "tbl": tbl, "tr": tr, "tc": tc, "error": [error] * same}
        for k, held in self.columns.items():
            if k != "attrs":
                held.extend(found[k])
        wanted = "attrs" in self.columns
        for of in attrs:
            self.begins.append(len(self.keys))
            if of and wanted:
                of = {local(k): v for k, v in of.items()}
                self.keys.extend(of)
                self.values.extend(of.values())

    def batch(self) -> pa.RecordBatch:
        texts = ("path", "part", "tag", "text", "error")
        made = {k: pa.array(v, pa.string() if k in texts else pa.int32()) for k, v in self.columns.items() if k != "attrs"}
        if "attrs" in self.columns:
            whole = pa.MapArray.from_arrays(pa.array([*self.begins, len(self.keys)], pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
            # the row of a malformed part has no attributes at all
            made["attrs"] = pc.if_else(made["id"].is_valid(), whole, pa.scalar(None, whole.type))
        return pa.RecordBatch.from_arrays([made[k] for k in self.columns], list(self.columns))


def is_xml() -> Column:
    """Whether a part is read as XML."""
    return F.col("part").rlike(r"\.(xml|rels)$") & F.col("error").isNull()


def nodes(of_parts: DataFrame, tags: Iterable[str] | None = None, columns: Iterable[str] | None = None) -> DataFrame:
    """One row per node of every .xml and .rels part; with tags, of their nodes only, numbered as they are among all. Malformed parts have their row anyway.
    columns: those of NODES to make, id among them where attrs is, as Spark can't tell a step in Python which ones are read."""
    wanted = None if tags is None else frozenset(tags)
    asked = None if columns is None else frozenset(columns)
    schema = ", ".join(c for c in NODES.split(", ") if asked is None or c.split()[0] in asked)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Rows(wanted, asked)
        for b in batches:
            for row in zip(*b.columns, strict=True):
                held.add(*(x.as_py() for x in row))
                if len(held) > BATCH_ROWS:
                    yield held.batch()
                    held = Rows(wanted, asked)
        if len(held):
            yield held.batch()

    return of_parts.filter(is_xml()).select("path", "pos", "part", "content").mapInArrow(parse, schema)


def malformed(of_nodes: DataFrame) -> DataFrame:
    return of_nodes.filter("error is not null").select("path", "part", "error")


def relationships(of_nodes: DataFrame) -> DataFrame:
    """path, part, rel_id, target (a part's name; as written for external ones), external."""

    def resolved(part: pd.Series, target: pd.Series) -> pd.Series:
        def one(p: str, t: str | None) -> str:
            base = posixpath.dirname(posixpath.dirname(p))
            return posixpath.normpath(posixpath.join("/", base, t or "")).lstrip("/")

        return pd.Series([one(p, t) for p, t in zip(part, target, strict=True)], dtype=object)

    attr = F.col("attrs")
    external = F.coalesce(attr["TargetMode"] == "External", F.lit(False))
    rows = of_nodes.filter("tag = 'Relationship'").select("path", "part", attr["Id"].alias("rel_id"), attr["Target"].alias("written"), external.alias("external"))
    target = F.when(F.col("external"), F.col("written")).otherwise(F.pandas_udf(resolved, "string")("part", "written"))
    return rows.select("path", "part", "rel_id", target.alias("target"), "external")


def dangling(of_nodes: DataFrame, of_parts: DataFrame) -> DataFrame:
    """Relationships to parts that the package lacks."""
    have = of_parts.filter("part is not null").select("path", F.col("part").alias("target"))
    return relationships(of_nodes).filter("not external").join(have, ["path", "target"], "left_anti")


def missing(of_parts: DataFrame) -> DataFrame:
    """Required parts that a package lacks, also for what is no archive."""
    need = of_parts.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, REQUIRED))).alias("part"))
    return need.join(of_parts.select("path", "part"), ["path", "part"], "left_anti")


def points(value: Column, per: float = 20.0) -> Column:
    return (value.try_cast("double") / per).cast("string")


#: The nodes below an rPr or pPr that tell properties.
PROPERTY_TAGS = ("sz", "rFonts", "b", "i", "u", "highlight", "color", "jc", "ind", "spacing", "shd", "pStyle", "rStyle")


@lru_cache(maxsize=1)
def property_entries() -> Column:
    """The properties that a node below an rPr or pPr tells, as an array of (key, value); a null value is none."""
    a, tag = F.col("attrs"), F.col("tag")
    val = a["val"]
    on = F.when(F.coalesce(val, F.lit("true")).isin("false", "0", "none"), "false").otherwise("true")
    exact = a["lineRule"].isin("exact", "atLeast")
    entries = {
        "size_pt": F.when(tag == "sz", points(val, 2.0)),
        "font": F.when(tag == "rFonts", F.coalesce(a["ascii"], a["hAnsi"], a["cs"])),
        "font_theme": F.when(tag == "rFonts", F.coalesce(a["asciiTheme"], a["hAnsiTheme"], a["cstheme"])),
        "bold": F.when(tag == "b", on),
        "italic": F.when(tag == "i", on),
        "underline": F.when(tag == "u", on),
        "highlight": F.when((tag == "highlight") & (val != "none"), val),
        "color": F.when((tag == "color") & (val != "auto"), F.concat(F.lit("#"), F.upper(val))),
        "align": F.when(tag == "jc", val),
        **{f"indent_{k}_pt": F.when(tag == "ind", points(a[k])) for k in ("left", "right", "firstLine", "hanging")},
        **{f"space_{k}_pt": F.when(tag == "spacing", points(a[k])) for k in ("before", "after")},
        "line_pt": F.when((tag == "spacing") & exact, points(a["line"])),
        "line_mult": F.when((tag == "spacing") & ~F.coalesce(exact, F.lit(False)), points(a["line"], 240.0)),
        "fill": F.when((tag == "shd") & (F.lower(a["fill"]) != "auto"), F.concat(F.lit("#"), F.upper(a["fill"]))),
        "fill_theme": F.when(tag == "shd", a["themeFill"]),
        "shading_pattern": F.when((tag == "shd") & ~val.isin("clear", "nil"), val),
        "style": F.when(tag.isin("pStyle", "rStyle"), val),
    }
    return F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in entries.items()])


def properties(of_nodes: DataFrame) -> DataFrame:
    """(path, part, owner, kind, key, value): run and paragraph properties of the nodes that hold an rPr or pPr."""
    holders = of_nodes.filter("tag in ('rPr', 'pPr')").selectExpr("path", "part", "id AS parent", "parent AS owner", "CASE WHEN tag = 'rPr' THEN 'run' ELSE 'para' END AS kind")
    rows = of_nodes.filter(F.col("tag").isin(*PROPERTY_TAGS)).join(holders, ["path", "part", "parent"]).select("path", "part", "owner", "kind", F.explode(property_entries()).alias("e"))
    return rows.select("path", "part", "owner", "kind", "e.key", "e.value").filter("value is not null")


def styles(of_nodes: DataFrame) -> DataFrame:
    """path, style, based_on of every named style."""
    own = of_nodes.filter((F.col("part") == STYLES) & (F.col("tag") == "style")).select("path", "id", F.col("attrs")["styleId"].alias("style"))
    based = of_nodes.filter((F.col("part") == STYLES) & (F.col("tag") == "basedOn")).select("path", F.col("parent").alias("id"), F.col("attrs")["val"].alias("based_on"))
    return own.join(based, ["path", "id"], "left")


def chains(of_styles: DataFrame) -> DataFrame:
    """path, style, ancestor, steps: a style and all it is based on; cycles end where they close.

    The walk is a fold over the style table of one document.
    """
    once = of_styles.filter("style is not null").groupBy("path", "style").agg(F.max_by("based_on", "id").alias("up"))
    table = once.groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("style", F.coalesce("up", F.lit(""))))).alias("up"))
    walk = F.expr("""aggregate(map_keys(up), array(style), (acc, step) -> concat(acc,
        filter(array(up[element_at(acc, -1)]), n -> map_contains_key(up, n) and not array_contains(acc, n))))""")
    each = table.select("path", "up", F.explode(F.map_keys("up")).alias("style")).select("path", "style", walk.alias("chain"))
    return each.select("path", "style", F.posexplode("chain").alias("steps", "ancestor"))


def resolved_styles(of_nodes: DataFrame) -> DataFrame:
    """path, style, kind, key, value with what is inherited; of several the nearest ancestor's holds."""
    named = styles(of_nodes)
    own = properties(of_nodes.filter(F.col("part") == STYLES)).join(named.select("path", F.col("id").alias("owner"), F.col("style").alias("ancestor")), ["path", "owner"])
    return chains(named).join(own, ["path", "ancestor"]).groupBy("path", "style", "kind", "key").agg(F.min_by("value", "steps").alias("value"))


def paragraph_properties(of_nodes: DataFrame) -> DataFrame:
    """path, id, key, value of the paragraphs of the main part: direct properties over those of the style."""
    main = of_nodes.filter(F.col("part") == MAIN)
    direct = properties(main).filter("kind = 'para'").select("path", F.col("owner").alias("id"), "key", "value")
    style = direct.filter("key = 'style'").select("path", "id", F.col("value").alias("style"))
    inherited = style.join(resolved_styles(of_nodes).filter("kind = 'para'"), ["path", "style"]).select("path", "id", "key", "value", F.lit(1).alias("rank"))
    both = direct.withColumn("rank", F.lit(0)).unionByName(inherited)
    return both.groupBy("path", "id", "key").agg(F.min_by("value", "rank").alias("value"))


def theme(of_nodes: DataFrame) -> DataFrame:
    """path, slot, value: typefaces as major and minor, and colours, of the first theme part."""
    within = of_nodes.filter("part like 'word/theme/%.xml'")
    first = within.groupBy("path").agg(F.min("pos").alias("pos"))
    within = within.join(first, ["path", "pos"], "left_semi")
    a = F.col("attrs")
    value = F.when(F.col("tag") == "latin", a["typeface"]).when(F.col("tag") == "srgbClr", a["val"]).when(F.col("tag") == "sysClr", a["lastClr"])
    leaf = within.filter("tag in ('latin', 'srgbClr', 'sysClr')").select("path", "parent", "id", value.alias("value"))
    slots = within.join(within.filter("tag in ('clrScheme', 'fontScheme')").select("path", F.col("id").alias("parent")), ["path", "parent"]).select("path", F.col("id").alias("parent"), F.regexp_replace("tag", "Font$", "").alias("slot"))
    return leaf.filter("value <> ''").join(slots, ["path", "parent"]).groupBy("path", "slot").agg(F.min_by("value", "id").alias("value"))


#: Names of theme colours in documents, and the slots they mean.
THEME_SLOTS = {
    "accent1": "accent1", "accent2": "accent2", "accent3": "accent3", "accent4": "accent4", "accent5": "accent5", "accent6": "accent6",
    "text1": "dk1", "text2": "dk2", "background1": "lt1", "background2": "lt2", "dark1": "dk1", "dark2": "dk2", "light1": "lt1", "light2": "lt2",
    "hyperlink": "hlink", "followedHyperlink": "folHlink",
}


def themed(props: DataFrame, of_theme: DataFrame) -> DataFrame:
    """Property rows with theme names resolved: font_theme as font, fill_theme as fill; theme:name where the theme lacks it."""
    colour = F.create_map(*[F.lit(x) for pair in THEME_SLOTS.items() for x in pair])
    slot = F.when(F.col("key") == "fill_theme", F.coalesce(colour[F.col("value")], F.col("value"))).when(F.col("key") == "font_theme", F.when(F.col("value").startswith("major"), "major").otherwise("minor"))
    asked = props.withColumn("slot", slot).join(of_theme.withColumnRenamed("value", "found"), ["path", "slot"], "left")
    fill = F.coalesce(F.concat(F.lit("#"), F.upper("found")), F.concat(F.lit("theme:"), F.col("value")))
    value = F.when(F.col("key") == "fill_theme", fill).when(F.col("key") == "font_theme", F.col("found")).otherwise(F.col("value"))
    key = F.regexp_replace("key", "_theme$", "")
    return asked.withColumn("value", value).withColumn("key", key).filter("value is not null").drop("slot", "found")


def default_font(of_nodes: DataFrame, fallback: str = "Times New Roman", docs: DataFrame | None = None) -> DataFrame:
    """path, font, source of docs (path; all that have nodes unless given): declared in docDefaults, else from the theme, else the fallback."""
    run = properties(of_nodes.filter(F.col("part") == STYLES))
    holder = of_nodes.filter((F.col("part") == STYLES) & (F.col("tag") == "rPrDefault")).select("path", F.col("id").alias("owner"))
    found = themed(run.join(holder, ["path", "owner"], "left_semi").filter("key in ('font', 'font_theme')").withColumn("was", F.col("key")), theme(of_nodes))
    font = found.groupBy("path").agg(F.max(F.when(F.col("was") == "font", F.col("value"))).alias("declared"), F.max("value").alias("any"))
    docs = (of_nodes.select("path").distinct() if docs is None else docs).join(font, "path", "left")
    source = F.when(F.col("declared").isNotNull(), "docDefaults").when(F.col("any").isNotNull(), "theme").otherwise("fallback")
    return docs.select("path", F.coalesce("declared", "any", F.lit(fallback)).alias("font"), source.alias("source"))


def fields(of_nodes: DataFrame) -> DataFrame:
    """path, part, code: distinct field codes of headers and footers."""
    raw = F.when(F.col("tag") == "fldSimple", F.col("attrs")["instr"]).when(F.col("tag") == "instrText", F.col("text"))
    code = F.split(F.trim(raw), " ")[0]
    return of_nodes.filter(r"part rlike '^word/(header|footer)[^/]*[.]xml$' and tag in ('fldSimple', 'instrText')").select("path", "part", code.alias("code")).filter("code <> ''").distinct()


def paragraphs(of_nodes: DataFrame) -> DataFrame:
    """path, id, tbl, tc, text, page_break, images of every paragraph of the main part, empty ones included."""
    main = of_nodes.filter(F.col("part") == MAIN)
    pieces = main.filter("tag in ('t', 'br', 'blip') and p is not null").groupBy("path", F.col("p").alias("id")).agg(
        F.array_sort(F.collect_list(F.when((F.col("tag") == "t") & F.col("text").isNotNull(), F.struct("id", "text")))).alias("texts"),
        F.bool_or((F.col("tag") == "br") & F.coalesce(F.col("attrs")["type"] == "page", F.lit(False))).alias("page_break"),
        F.count_if(F.col("tag") == "blip").alias("images"),
    )
    text = F.coalesce(F.array_join(F.col("texts.text"), ""), F.lit(""))
    out = main.filter("tag = 'p'").select("path", "id", "tbl", "tc").join(pieces, ["path", "id"], "left")
    return out.select("path", "id", "tbl", "tc", text.alias("text"), F.coalesce("page_break", F.lit(False)).alias("page_break"), F.coalesce("images", F.lit(0).cast("long")).alias("images"))


def sections(of_nodes: DataFrame) -> DataFrame:
    """path, id, page and margins in points, orientation (by the sides), columns. A body without sectPr has none."""
    own = of_nodes.filter((F.col("part") == MAIN) & (F.col("tag") == "sectPr")).select("path", "id")
    below = of_nodes.filter((F.col("part") == MAIN) & F.col("tag").isin("pgSz", "pgMar", "cols")).select("path", F.col("parent").alias("id"), "tag", "attrs")

    def of(tag: str, attr: str, twips: int) -> Column:
        return F.coalesce(F.max(F.when(F.col("tag") == tag, F.col("attrs")[attr].try_cast("double"))), F.lit(float(twips))) / 20

    named = {"page_w_pt": ("pgSz", "w", 12240), "page_h_pt": ("pgSz", "h", 15840), **{f"{s}_pt": ("pgMar", s, 1440) for s in ("top", "bottom", "left", "right")}, "header_pt": ("pgMar", "header", 720), "footer_pt": ("pgMar", "footer", 720), "col_space_pt": ("cols", "space", 720)}
    columns = F.coalesce(F.max(F.when(F.col("tag") == "cols", F.col("attrs")["num"].try_cast("int"))), F.lit(1))
    got = own.join(below, ["path", "id"], "left").groupBy("path", "id").agg(*[of(*v).alias(k) for k, v in named.items()], columns.alias("columns"))
    return got.withColumn("orientation", F.when(F.col("page_w_pt") > F.col("page_h_pt"), "landscape").otherwise("portrait"))


def cells(of_nodes: DataFrame) -> DataFrame:
    """path, tbl, tr, tc, col (place in its row), span, merge, width_pt (null if none is declared), outer (the cell its table is in)."""
    main = of_nodes.filter(F.col("part") == MAIN)
    attr = lambda tag, name: F.max(F.when(F.col("tag") == tag, F.col("attrs")[name]))
    inner = main.filter("tag in ('gridSpan', 'vMerge', 'tcW')").groupBy("path", "tc").agg(
        attr("gridSpan", "val").cast("int").alias("span"),
        F.max(F.when(F.col("tag") == "vMerge", F.coalesce(F.col("attrs")["val"], F.lit("continue")))).alias("merge"),
        (F.max(F.when((F.col("tag") == "tcW") & (F.col("attrs")["type"] == "dxa"), F.col("attrs")["w"])).try_cast("double") / 20).alias("width_pt"),
    )
    places = main.filter("tag = 'tc'").groupBy("path", "tbl", "tr").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("path", "tbl", "tr", F.posexplode("ids").alias("col", "tc"))
    outer = main.filter("tag = 'tbl'").select("path", F.col("id").alias("tbl"), F.col("tc").alias("outer"))
    return places.join(inner, ["path", "tc"], "left").join(outer, ["path", "tbl"]).withColumn("span", F.coalesce("span", F.lit(1)))


def enclosing_cells(of_nodes: DataFrame) -> DataFrame:
    """path, tc, outer: every cell with each cell that it lies in, itself among them, however deep."""
    own = of_nodes.filter((F.col("part") == MAIN) & (F.col("tag") == "tc")).select("path", "id", "last")
    return covering(own.select("path", F.col("id").alias("tc")), own.select("path", F.col("id").alias("outer"), F.col("id").alias("lo"), F.col("last").alias("hi")), ["path"], "tc").select("path", "tc", "outer")


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def tables(of_nodes: DataFrame) -> DataFrame:
    """path, tbl, depth (1 in the body), outer (the table it lies in), rows, columns, cells, merged (cells that span or are merged), and with all tables inside it
    cells_within, words_within and images_within."""
    main = of_nodes.filter(F.col("part") == MAIN)
    own = main.filter("tag = 'tbl'").select("path", F.col("id").alias("tbl"), "last", F.col("tc").alias("in_cell"))
    around = covering(own.select("path", "tbl"), own.select("path", F.col("tbl").alias("outer"), F.col("tbl").alias("lo"), F.col("last").alias("hi")), ["path"], "tbl").select("path", "tbl", "outer")
    grid = main.filter("tag = 'gridCol'").groupBy("path", "tbl").agg(F.count("*").alias("grid"))
    cell = cells(of_nodes)
    shape = cell.groupBy("path", "tbl").agg(F.countDistinct("tr").alias("rows"), F.count("*").alias("cells"), F.count_if((F.col("span") > 1) | F.col("merge").isNotNull()).alias("merged"), F.min_by("tr", "tr").alias("first"))
    first = cell.groupBy("path", "tbl", "tr").agg(F.count("*").alias("n")).groupBy("path", "tbl").agg(F.min_by("n", "tr").alias("first_cells"))
    text = paragraphs(of_nodes).filter("tbl is not null").groupBy("path", "tbl").agg(F.sum(words(F.col("text"))).alias("words"), F.sum("images").alias("images"))
    each = shape.drop("first").join(text, ["path", "tbl"], "left")
    within = around.join(each.select("path", "tbl", "cells", "words", "images"), ["path", "tbl"], "left").groupBy("path", F.col("outer").alias("tbl")).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(f"{c}_within") for c in ("cells", "words", "images")])
    deep = around.groupBy("path", "tbl").agg(F.count("*").alias("depth"), F.max(F.when(F.col("outer") < F.col("tbl"), F.col("outer"))).alias("outer"))
    found = deep.join(within, ["path", "tbl"]).join(each, ["path", "tbl"], "left").join(grid, ["path", "tbl"], "left").join(first, ["path", "tbl"], "left")
    none = F.lit(0).cast("long")
    return found.select("path", "tbl", "depth", "outer", *[F.coalesce(c, none).alias(c) for c in ("rows",)], F.coalesce("grid", "first_cells", none).alias("columns"), *[F.coalesce(c, none).alias(c) for c in ("cells", "merged")], "cells_within", "words_within", "images_within")


def cell_texts(of_nodes: DataFrame) -> DataFrame:
    """path, tc, text, images: of each cell its own paragraphs, then those of the tables in it, cell by cell in order; texts joined by a blank, empty ones left out."""
    own = paragraphs(of_nodes).filter("tc is not null").select("path", "tc", F.col("id").alias("p"), "text", "images")
    chains = enclosing_cells(of_nodes)
    inner = chains.groupBy("path", "tc").agg(F.array_sort(F.collect_list("outer")).alias("chain"))
    placed = chains.join(own, ["path", "tc"]).join(inner, ["path", "tc"])
    # a paragraph of the cell itself comes before one in a cell within, whatever their places
    below = F.filter("chain", lambda c: c > F.col("outer"))
    place = F.concat(F.flatten(F.transform(below, lambda c: F.array(F.lit(1), c))), F.array(F.lit(0), F.col("p")))
    full = placed.groupBy("path", F.col("outer").alias("tc")).agg(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct(place.alias("place"), "text")))).alias("texts"), F.sum("images").alias("images"))
    every = of_nodes.filter((F.col("part") == MAIN) & (F.col("tag") == "tc")).select("path", F.col("id").alias("tc"))
    return every.join(full, ["path", "tc"], "left").select("path", "tc", F.coalesce(F.array_join("texts.text", " "), F.lit("")).alias("text"), F.coalesce("images", F.lit(0).cast("long")).alias("images"))


#: Properties that a run has.
RUN_KEYS = ["font", "size_pt", "bold", "italic", "color", "highlight", "fill"]


def by_owner(props: DataFrame, *owner: str) -> DataFrame:
    return props.groupBy(*owner).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("props"))


def runs(of_nodes: DataFrame) -> DataFrame:
    """path, p, r, text, images (how many), image_pt (their heights), page_break and RUN_KEYS of the runs of the main part that hold text or images.

    A property is the run's own, else that of the paragraph's style and what it is based on, else the document's default; a typeface may be
    named by the theme. Size is 11 and the typeface the fallback where nothing says more.
    """
    main, slots = of_nodes.filter(F.col("part") == MAIN), theme(of_nodes)
    single = lambda props, *owner: by_owner(props.groupBy(*owner, "key").agg(F.max("value").alias("value")), *owner)
    direct = single(themed(properties(main).filter("kind = 'run'").drop("part"), slots), "path", "owner").select("path", F.col("owner").alias("r"), F.col("props").alias("direct"))
    styled = single(themed(resolved_styles(of_nodes).filter("kind = 'run'"), slots), "path", "style").select("path", "style", F.col("props").alias("styled"))
    style = paragraph_properties(of_nodes).filter("key = 'style'").select("path", F.col("id").alias("p"), F.col("value").alias("style"))
    holder = of_nodes.filter((F.col("part") == STYLES) & (F.col("tag") == "rPrDefault")).select("path", F.col("id").alias("owner"))
    default = single(themed(properties(of_nodes.filter(F.col("part") == STYLES)).filter("kind = 'run'").join(holder, ["path", "owner"], "left_semi").drop("part"), slots), "path").withColumnRenamed("props", "default")
    attr = F.col("attrs")
    held = main.filter("r is not null and tag in ('t', 'blip', 'ext', 'br')").groupBy("path", "r").agg(
        F.array_sort(F.collect_list(F.when((F.col("tag") == "t") & F.col("text").isNotNull(), F.struct("id", "text")))).alias("texts"),
        F.count_if(F.col("tag") == "blip").alias("images"),
        F.min_by(F.when(F.col("tag") == "ext", attr["cy"].try_cast("double") / 12700), F.when((F.col("tag") == "ext") & attr["cy"].isNotNull(), F.col("id"))).alias("high"),
        F.coalesce(F.bool_or((F.col("tag") == "br") & (attr["type"] == "page")), F.lit(False)).alias("page_break"),
    )
    rows = main.filter("tag = 'r' and p is not null").select("path", "p", F.col("id").alias("r")).join(held, ["path", "r"], "left").join(direct, ["path", "r"], "left").join(style, ["path", "p"], "left").join(styled, ["path", "style"], "left").join(default, "path", "left").join(default_font(of_nodes).select("path", F.col("font").alias("usual")), "path", "left")
    value = lambda k: F.coalesce(F.col("direct")[k], F.col("styled")[k], F.col("default")[k])
    typed = {"font": F.coalesce(value("font"), F.col("usual")), "size_pt": F.coalesce(value("size_pt").cast("double"), F.lit(11.0)), "bold": F.coalesce(value("bold") == "true", F.lit(False)), "italic": F.coalesce(value("italic") == "true", F.lit(False))}
    images = F.coalesce("images", F.lit(0).cast("long"))
    text = F.coalesce(F.array_join("texts.text", ""), F.lit(""))
    out = rows.select("path", "p", "r", text.alias("text"), images.alias("images"), (images * F.coalesce("high", F.lit(0.0))).alias("image_pt"), F.coalesce("page_break", F.lit(False)).alias("page_break"), *[typed.get(k, value(k)).alias(k) for k in RUN_KEYS])
    return out.filter("text <> '' or images > 0 or page_break")


def too_wide(of_nodes: DataFrame, slack: float = 1.03) -> DataFrame:
    """path, tbl, width_pt, room_pt of tables wider than the cell or the page body that holds them."""
    main = of_nodes.filter(F.col("part") == MAIN)
    grid = main.filter("tag = 'gridCol'").select("path", "tbl", "id", (F.coalesce(F.col("attrs")["w"].try_cast("double"), F.lit(0.0)) / 20).alias("w"))
    lists = grid.groupBy("path", "tbl").agg(F.sum("w").alias("width_pt"), F.array_sort(F.collect_list(F.struct("id", "w"))).alias("grid"))
    rooms = cells(of_nodes).join(lists.select("path", "tbl", "grid"), ["path", "tbl"], "left").select("path", F.col("tc").alias("outer"), F.coalesce("width_pt", F.expr("get(grid, col).w")).alias("cell_pt"))
    first = sections(of_nodes).groupBy("path").agg(F.min_by(F.col("page_w_pt") - F.col("left_pt") - F.col("right_pt"), "id").alias("body_pt"))
    held = main.filter("tag = 'tbl'").select("path", F.col("id").alias("tbl"), F.col("tc").alias("outer")).join(lists, ["path", "tbl"]).join(rooms, ["path", "outer"], "left").join(first, "path", "left")
    room = F.when(F.col("outer").isNull(), F.coalesce("body_pt", F.lit(468.0))).otherwise(F.col("cell_pt"))
    return held.select("path", "tbl", "width_pt", room.alias("room_pt")).filter(F.col("width_pt") > slack * F.col("room_pt"))


def media(of_parts: DataFrame) -> DataFrame:
    """path, part, bytes, width, height of word/media: PNG by its header, JPEG by its frame marker, else null."""

    def frame(content: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            at = 2
            while b and b[:2] == b"\xff\xd8" and at + 9 <= len(b) and b[at] == 0xFF:
                kind = b[at + 1]
                if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                    return f"{int.from_bytes(b[at + 7 : at + 9], 'big')}x{int.from_bytes(b[at + 5 : at + 7], 'big')}"
                at += 2 + max(2, int.from_bytes(b[at + 2 : at + 4], "big")) if kind not in (0xFF, 0x01, *range(0xD0, 0xD9)) else 1 + (kind != 0xFF)
            return None

        return pd.Series([one(b) for b in content], dtype=object)

    content = F.col("content")
    png = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"
    number = lambda at: F.conv(F.hex(F.substring(content, at, 4)), 16, 10).cast("int")
    rows = of_parts.filter("part like 'word/media/%'").withColumn("frame", F.when(F.hex(F.substring(content, 1, 2)) == "FFD8", F.pandas_udf(frame, "string")(content)))
    side = lambda i, at: F.when(png, number(at)).otherwise(F.split("frame", "x")[i].cast("int"))
    return rows.select("path", "part", F.octet_length("content").alias("bytes"), side(0, 17).alias("width"), side(1, 21).alias("height"))


def counts(of_nodes: DataFrame, of_parts: DataFrame) -> DataFrame:
    """Per package: sections, paragraphs and tables of the body, words, styles, shaded cells and media files."""
    main = F.col("part") == MAIN
    tally = of_nodes.groupBy("path").agg(
        F.count_if(main & (F.col("tag") == "sectPr")).alias("sections"),
        F.count_if(main & (F.col("tag") == "p") & F.col("tbl").isNull()).alias("paragraphs"),
        F.count_if(main & (F.col("tag") == "tbl") & F.col("tc").isNull()).alias("tables"),
        F.count_if((F.col("part") == STYLES) & (F.col("tag") == "style")).alias("styles"),
        F.count_if(main & (F.col("tag") == "shd") & F.col("tc").isNotNull() & F.col("p").isNull() & (F.lower(F.col("attrs")["fill"]) != "auto")).alias("shaded_cells"),
    )
    text = paragraphs(of_nodes).groupBy("path").agg(F.sum(words(F.col("text"))).alias("words"))
    files = of_parts.filter("part like 'word/media/%'").groupBy("path").agg(F.count("*").alias("media"))
    return tally.join(text, "path", "left").join(files, "path", "left").fillna(0, ["words", "media"])
