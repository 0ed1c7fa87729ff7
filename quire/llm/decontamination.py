"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A document holds a test item if at least 75 of 100 of the item's distinct 5-word shingles occur in it (an item
of fewer words has one shingle, the whole sequence), so at most floor(size / 4) are missing. Items are partitioned by size, each partition
twice as wide as the one before. Those of a partition are indexed by their floor(size / 4) + 1 + spare smallest
shingle hashes, a bottom-k MinHash sketch; spare is an eighth of the partition's least size. By the pigeonhole principle a document
that holds the item hits its sketch 1 + spare times at least, which is the partition's threshold: one common shingle makes
candidates of small items only. Every document probes the index with all its shingle hashes up to the partitions' largest, so no match is lost
however long the document is. Candidates are verified on words. Only DataFrame functions are used.

Words: maximal runs without the characters 0x20 and 0x09-0x0D, lower-cased. Null and empty texts match nothing;
rows without doc_id or item_id are left out. Of repeated rows of an id, also with different texts, the best containment counts, of equal ones that with more hits. Other columns are
not looked at. Empty tables, of documents or items, give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved, small, table

SHINGLE, PERCENT = 5, 75
#: Sketch entries beyond the pigeonhole, as a share of a partition's least size.
SPARE = 8
BLANK = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    inner = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANK, " "))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, " "))


def joined(text: Column) -> Column:
    """The words between single spaces, one at either end too."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), BLANK, " ")), F.lit(" "))


def grams(w: Column, k: int) -> Column:
    """The hashes of all runs of k words."""
    return F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[w[i + j] for j in range(k)]))).otherwise(F.array().cast("array<long>"))


def below(text: Column, k: int, top: int) -> Column:
    return let(words(text), lambda w: F.filter(grams(w, k), lambda h: h <= top))


def shingles(w: Column) -> Column:
    """The distinct 5-word runs as text, or the whole sequence."""
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))
    return F.when(F.size(w) > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def contained(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_hits and containment of every pair that reaches the threshold."""
    items = items.filter("item_id is not null").select("item_id", words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.select(F.least(F.size("w"), F.lit(SHINGLE)).alias("k"), "item_id", shingles(F.col("w")).alias("shingles"))
    items = saved(items.withColumn("item", F.monotonically_increasing_id()))
    n = F.size("shingles")
    spare = F.floor(F.pow(F.lit(2), F.floor(F.log2(n))) / SPARE).cast("int")
    hashes = F.transform("shingles", lambda s: let(F.split(s, " "), lambda w: F.coalesce(*[F.when(F.size(w) == k, F.xxhash64(*[w[j] for j in range(k)])) for k in range(SHINGLE, 0, -1)])))
    sketch = items.select("item", "k", (1 + spare).alias("least"), F.slice(F.array_sort(hashes), F.lit(1), F.floor(n * (100 - PERCENT) / 100).cast("int") + 1 + spare).alias("hs"))
    sketch = saved(sketch.select("item", "k", "least", F.explode("hs").alias("h")))
    tops = {r["k"]: r["top"] for r in sketch.groupBy("k").agg(F.max("h").alias("top")).collect()}
    docs = docs.filter("doc_id is not null").select("doc_id", "text")
    probes = None
    for k, top in sorted(tops.items()):
        part = docs.select("doc_id", F.explode(below(F.col("text"), k, top)).alias("h")).withColumn("k", F.lit(k))
        probes = part if probes is None else probes.unionByName(part)
    if probes is None:
        probes = docs.select("doc_id", F.lit(0).cast("long").alias("h"), F.lit(0).alias("k")).filter("false")
    hit = probes.join(small(sketch), ["k", "h"]).select("doc_id", "item", "least", "h").distinct()
    found = saved(hit.groupBy("doc_id", "item").agg(F.count("*").alias("hits"), F.max("least").alias("least")).filter("hits >= least").select("doc_id", "item"))
    pairs = docs.join(small(found), "doc_id").join(small(items.select("item", "item_id", "shingles")), "item")
    hits = let(joined(F.col("text")), lambda t: F.size(F.filter("shingles", lambda s: F.contains(t, F.concat(F.lit(" "), s, F.lit(" "))))))
    scored = pairs.select("doc_id", "item_id", F.size("shingles").cast("long").alias("n_item_shingles"), hits.cast("long").alias("n_hits"))
    best = scored.filter(F.col("n_hits") * 100 >= F.col("n_item_shingles") * PERCENT).groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_hits") / F.col("n_item_shingles")).alias("share"), "n_hits", "n_item_shingles")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_hits", (F.col("b.n_hits") / F.col("b.n_item_shingles")).alias("containment"))


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"CASE WHEN trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')) = '' THEN [] ELSE string_split(trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')), ' ') END"
ORACLE = rf"""
WITH i AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM i WHERE len(w) > 0)),
n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id),
d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[\x20\x09-\x0D]+', ' ', 'g')) || ' ' AS t FROM documents WHERE doc_id IS NOT NULL),
h AS (SELECT doc_id, item_id, count(*) AS hits FROM d JOIN s ON contains(d.t, ' ' || s.g || ' ') GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n AS n_item_shingles, hits AS n_hits, hits::DOUBLE / n AS containment FROM h JOIN n USING (item_id) WHERE hits * 100 >= n * 75
"""
