"""Mixing sources to target weights by Poisson replication.

Each document of source s gets k copies, k the inverse of the Poisson distribution with mean
weight[s] * rows / rows[s] at a uniform number hashed from seed and doc_id; all copies are then ordered by a
hash, a global shuffle that any rerun repeats. Means over PART are summed from independent parts.

The cumulative probabilities of each source are a table, so that a row only looks up.

Nulls: a null source is a source of its own, a null doc_id hashes as the word null. Repeated rows get the same
number of copies each. A source without weight gets none. An empty table gives no rows. Columns of other names, also __key or
rate, are passed on. Ties in the order, by equal hashes, go by doc_id and copy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, ranked, saved, small
from .common import table as read

SEED = 17
#: exp(-PART) is far from underflow.
PART = 200


def uniform(*parts: Column) -> Column:
    """In [0, 1), of 52 bits, from the MD5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """The smallest k whose cumulative probability exceeds u; 0 without a mean."""
    return drawn(cumulative(mean), u)


def cumulative(mean: Column) -> Column:
    """Array of the cumulative probabilities of 0, 1, ..; null without a mean. A table of one row a source, so rows only look up."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("s"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        return F.struct(p.alias("p"), F.concat(acc["s"], F.array(F.element_at(acc["s"], -1) + p)).alias("s"))

    return F.when(mean.isNotNull(), F.aggregate(F.sequence(F.lit(1), most), start, step, lambda acc: acc["s"]))


def drawn(table: Column, u: Column) -> Column:
    """How many of the cumulative probabilities u reaches, the last one left out."""
    return F.coalesce(F.size(F.filter(F.slice(table, F.lit(1), F.size(table) - 1), lambda s: u >= s)), F.lit(0))


def source_key() -> Column:
    return F.coalesce(F.concat(F.lit("s:"), F.col("source")), F.lit("null"))


def replicate(docs: DataFrame, weights: dict[str | None, float] | None = None, rows: int | None = None, seed: int = SEED, names: tuple[str, str] = ("__copy", "__shuffle")) -> DataFrame:
    """docs with every row as often as its source's rate asks, plus under the names given its number (from 1) and its place in the global order.

    weights: by source, of any sum; none: all sources alike. rows: about so many are returned, as many as docs has if none.
    """
    key, table, parts, copies = fresh(docs, "key", "table", "parts", "copies")
    keyed = docs.withColumn(key, source_key())
    counts = keyed.groupBy(F.col(key).alias("k")).agg(F.count("*").alias("rows"))
    if weights is None:
        counts = counts.withColumn("weight", F.lit(1.0))
    else:
        given = [("null" if k is None else f"s:{k}", float(v)) for k, v in weights.items()]
        counts = counts.join(docs.sparkSession.createDataFrame(given, "k string, weight double"), "k")
    whole = counts.agg(F.sum("rows").alias("n"), F.sum("weight").alias("w")).first()
    n, w = rows or whole["n"] or 0, whole["w"] or 1.0
    rate = F.lit(float(n)) * F.col("weight") / (F.lit(float(w)) * F.col("rows"))
    rates = counts.select("k", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    rates = saved(rates.select(F.col("k").alias(key), F.col("parts").alias(parts), cumulative(F.col("rate") / F.col("parts")).alias(table)))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    times = F.aggregate(F.sequence(F.lit(1), F.col(parts)), F.lit(0), lambda acc, j: acc + drawn(F.col(table), uniform(F.lit(str(seed)), name, j.cast("string"))))
    out = keyed.join(small(rates), key).withColumn(copies, times).filter(F.col(copies) > 0)
    out = out.withColumn(names[0], F.explode(F.sequence(F.lit(1), F.col(copies))))
    place = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(f"shuffle{seed}"), name, F.col(names[0]).cast("string"))), 1, 15), 16, 10).cast("long")
    return out.withColumn(names[1], place).select(*docs.columns, *names)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, copy and position in the global shuffle, all sources at equal weight."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source")
    return ranked(replicate(docs), ["__shuffle", "doc_id", "__copy"]).select("doc_id", "source", F.col("__copy").alias("copy"), F.col("pos").alias("position"))


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce('s:' || source, 'null') AS k FROM documents),
c AS (SELECT k, count(*) AS n FROM d GROUP BY k),
t AS (SELECT sum(n)::DOUBLE AS n, count(*)::DOUBLE AS w FROM c),
r AS (SELECT k, t.n * 1.0 / (t.w * c.n) AS rate, greatest(1, ceil(t.n * 1.0 / (t.w * c.n) / {PART}))::INT AS parts FROM c, t),
q AS (SELECT k, rate / parts AS m FROM r),
p AS (SELECT k, m, 0 AS i, exp(-m) AS p, exp(-m) AS s FROM q
      UNION ALL SELECT k, m, i + 1, p * m / (i + 1), s + p * m / (i + 1) FROM p WHERE i < ceil(m + 12 * sqrt(m) + 20)),
u AS (SELECT d.doc_id, d.source, d.k, row_number() OVER () AS rid, j,
      ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || j), 1, 13))::BIGINT / {float(1 << 52)} AS u
      FROM (SELECT d.*, unnest(range(1, parts + 1)) AS j FROM d JOIN r USING (k)) AS d),
n AS (SELECT u.doc_id, u.source, u.rid, count(p.i)::INT AS copies FROM u LEFT JOIN p ON p.k = u.k AND u.u >= p.s AND p.i < ceil(p.m + 12 * sqrt(p.m) + 20) GROUP BY ALL),
e AS (SELECT doc_id, source, unnest(range(1, copies + 1))::INT AS copy FROM n)
SELECT doc_id, source, copy, row_number() OVER (ORDER BY
  ('0x' || substr(md5('shuffle{SEED}|' || coalesce(doc_id::VARCHAR, 'null') || '|' || copy), 1, 15))::BIGINT, doc_id, copy) - 1 AS position
FROM e
"""
