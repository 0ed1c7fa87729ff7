"""Line dedup by a suffix array over line-ID sequences.

A document is the sequence of its non-blank lines, each with the MD5 of the line as its ID. Prefix doubling over all documents
at once ranks suffixes by their first h lines, h = 1, 2, 4, ..: the rank by 2h lines follows from the order of the pairs (rank by h
here, rank by h h lines on). A suffix whose first h lines occur nowhere else has its place in the array and drops out, so a round
handles only what is repeated, and rounds end when nothing is. Suffixes of one rank by h lines are an interval of the array
whose longest common prefix is h lines at least. In each interval the first suffix (by doc_id, then line) stays and the others are
later copies; each position takes its deepest interval, and neighbours that copy neighbours join into maximal runs. The lines of later runs of
MIN_LINES or more go. A single line counts as a run if it has MIN_WORDS words.

Ranks are shuffled, not texts; pairs are counted on the map side, so a line in a third of the documents costs one row per task.
Nulls and empty texts have no lines; rows without doc_id stay as they are and take no part. Rows with doc_id and text alike count as
one document, and no copies of each other; of rows with one doc_id and several texts each is a document, in order of a hash. Columns of
other names are passed on. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, fresh, let, ranked, saved, small, table

MIN_LINES, MIN_WORDS = 2, 50
#: A document.
KEY = ["doc_id", "twin"]


def sequence_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x) != "")


def positions(docs: DataFrame, min_words: int) -> DataFrame:
    """doc_id, twin, line (from 0, blank lines not counted), id, and whether the line is long enough to be a run."""
    n_words = lambda x: F.size(F.split(F.trim(x), r"\s+"))
    lines = F.transform(sequence_of(F.col("text")), lambda x, i: F.struct(i.alias("line"), F.unhex(F.md5(x)).alias("id"), (n_words(x) >= min_words).alias("alone")))
    return docs.filter("doc_id is not null").select("doc_id", F.xxhash64("text").alias("twin"), F.explode(lines).alias("x")).select(*KEY, "x.line", "x.id", "x.alone")


def again(rows: DataFrame, by: list[str], *kept: str) -> DataFrame:
    """Of rows those whose values of `by` occur twice, with these replaced by r, their rank among such values."""
    twice = rows.groupBy(*by).agg(F.count("*").alias("n")).filter("n > 1").select(*by)
    ranks = ranked(twice, by).withColumnRenamed("pos", "rank")
    return saved(rows.join(small(ranks), by).select(*KEY, "line", F.col("rank").alias("r"), *kept))


def ahead(level: DataFrame, by: int) -> DataFrame:
    """With next, the rank `by` lines on, where that is repeated too."""
    w = Window.partitionBy(*KEY).orderBy("line").rangeBetween(by, by)
    return saved(level.withColumn("next", F.first("r").over(w)).filter("next is not null").select(*KEY, "line", "r", "next"))


def later(level: DataFrame, lines: int) -> DataFrame:
    """The suffixes of each interval but the first, with that one as `first`."""
    place = F.struct(*KEY, "line")
    first = level.groupBy("r").agg(F.min(place).alias("first"))
    return level.join(small(first), "r").filter(place != F.col("first")).select(*KEY, "line", F.lit(lines).alias("lines"), "first")


def suffix_levels(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> list[DataFrame]:
    """Later copies (doc_id, twin, line, lines, first) by the ranks of min_lines and of every power of two beyond, and long lines."""
    rows = saved(positions(docs, min_words))
    level, h = again(rows, ["id"], "alone"), 1
    forget(rows)
    out = [later(level.filter("alone"), 1)] + [later(level, 1)] * (min_lines == 1)
    while True:
        if h < min_lines < 2 * h:  # two ranks that overlap
            near = ahead(level, min_lines - h)
            out.append(later(again(near, ["r", "next"]), min_lines))
        pairs = ahead(level, h)
        level, h = again(pairs, ["r", "next"]), 2 * h
        forget(pairs)
        if not level.limit(1).count():
            return out
        if h >= min_lines:
            out.append(later(level, h))


def runs(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, twin, line, lines and source (doc_id, twin, line) of the maximal runs that copy earlier ones, as each position's deepest interval has it."""
    found = None
    for level in suffix_levels(docs, min_lines, min_words):
        found = level if found is None else found.unionByName(level)
    deepest = found.groupBy(*KEY, "line").agg(F.max(F.struct("lines", "first")).alias("x")).select(*KEY, "line", "x.lines", "x.first")
    deepest = deepest.withColumn("shift", F.col("first.line") - F.col("line"))
    along = Window.partitionBy(*KEY, "first.doc_id", "first.twin", "shift").orderBy("line")
    cut = deepest.withColumn("cut", (F.col("line") > F.coalesce(F.lag("line").over(along), F.lit(-2)) + 1).cast("int"))
    numbered = cut.withColumn("run", F.sum("cut").over(along))
    whole = numbered.groupBy(*KEY, F.col("first.doc_id").alias("of"), F.col("first.twin").alias("of_twin"), "shift", "run").agg(F.min("line").alias("line"), F.max(F.col("line") + F.col("lines")).alias("end"))
    return whole.select(*KEY, "line", (F.col("end") - F.col("line")).alias("lines"), F.struct(F.col("of").alias("doc_id"), F.col("of_twin").alias("twin"), (F.col("line") + F.col("shift")).alias("line")).alias("source"))


def later_copies(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, twin and removed, the sorted numbers of the non-blank lines that go."""
    lines = F.sequence(F.col("line"), F.col("line") + F.col("lines") - 1)
    return runs(docs, min_lines, min_words).groupBy(*KEY).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(lines)))).alias("removed"))


def without(lines: Column, removed: Column) -> Column:
    """lines without the non-blank ones of these numbers, in order; linear, as pieces between removed lines are sliced out."""
    full = F.filter(F.transform(lines, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    places = let(full, lambda f: F.transform(removed, lambda k: f[k]))
    marks = F.concat(F.array(F.lit(-1)), places, F.array(F.size(lines)))
    pieces = lambda s, m: F.transform(F.sequence(F.lit(1), F.size(m) - 1), lambda j: F.slice(s, m[j - 1] + 2, m[j] - m[j - 1] - 1))
    return let(lines, lambda s: let(marks, lambda m: F.flatten(pieces(s, m))))


def dedup_lines(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with text reduced to the lines that stay, n_lines and n_removed; null texts stay null. Where docs has such columns, the new ones get a longer name."""
    names = fresh(docs, "n_lines", "n_removed", "removed", "of_doc", "of_twin")
    gone = later_copies(docs.select("doc_id", "text"), min_lines, min_words).toDF(*names[3:], names[2])
    out = docs.join(gone, (F.col("doc_id") == F.col(names[3])) & (F.xxhash64("text") == F.col(names[4])), "left")
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n")
    removed = F.col(names[2])
    text = F.when(removed.isNull(), F.col("text")).otherwise(F.array_join(without(lines, removed), "\n"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns], F.size(sequence_of(F.col("text"))).cast("long").alias(names[0]), F.coalesce(F.size(removed), F.lit(0)).cast("long").alias(names[1]))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the MD5 of the text that stays (null for a null text)."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("text").alias("kept_md5"))


ORACLE = rf"""
WITH d AS (SELECT doc_id, text, doc_id AS rid FROM documents),
l AS (SELECT rid, doc_id, p, x FROM (SELECT rid, doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS x, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM d)),
s AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY p) - 1 AS i FROM l WHERE trim(x) <> ''),
g AS (SELECT rid, doc_id, i, {MIN_LINES} AS n, md5(md5(x) || md5(lead(x) OVER (PARTITION BY rid ORDER BY i))) AS name FROM s
      UNION ALL SELECT rid, doc_id, i, 1, CASE WHEN len(string_split_regex(trim(x), '\s+')) >= {MIN_WORDS} THEN md5(x) END FROM s),
f AS (SELECT *, (doc_id, i) = first_value((doc_id, i)) OVER (PARTITION BY n, name ORDER BY doc_id, i) AS first FROM g WHERE name IS NOT NULL),
gone AS (SELECT DISTINCT rid, i FROM (SELECT rid, unnest(range(i, i + n)) AS i FROM f WHERE NOT first)),
k AS (SELECT l.rid, string_agg(l.x, chr(10) ORDER BY l.p) AS t FROM l LEFT JOIN s USING (rid, p) LEFT JOIN gone ON gone.rid = l.rid AND gone.i = s.i WHERE gone.rid IS NULL GROUP BY l.rid),
c AS (SELECT rid, count(*) AS n FROM s GROUP BY rid), r AS (SELECT rid, count(*) AS n FROM gone GROUP BY rid)
SELECT d.doc_id, coalesce(c.n, 0) AS n_lines, coalesce(r.n, 0) AS n_removed, CASE WHEN d.text IS NOT NULL THEN md5(CASE WHEN r.n IS NULL THEN d.text ELSE coalesce(k.t, '') END) END AS kept_md5
FROM d LEFT JOIN c USING (rid) LEFT JOIN r USING (rid) LEFT JOIN k USING (rid)
"""
