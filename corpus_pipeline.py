"""From raw documents to shards: language ID, near duplicates, decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the
columns of docs, extra ones included, whatever their names: columns added for a while get names that docs lacks. Empty tables pass
through. Repeated rows and rows without doc_id are rows of their own except where a stage says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import decontamination, jaccard, language, mixing, sharding
from quire.llm.common import fresh, saved, small, table

#: Texts without a letter have score 0; the models' least certain answer lies below this.
LEAST_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null, empty, without letters, or scored below LEAST_SCORE."""
    lang, score = fresh(docs, "lang_pred", "score")
    found = language.identify(docs, language.learn(docs), docs.columns, (lang, score))
    return found.filter((F.col(lang) != "und") & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row of the smallest doc_id stays; rows without doc_id or without words stay."""
    return jaccard.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go, all rows of the doc_id; those without doc_id, and all if there is no benchmark, stay."""
    (name,) = fresh(docs, "leaked")
    leaked = saved(decontamination.contained(docs, table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias(name)).distinct())
    return docs.join(small(leaked), F.col("doc_id") == F.col(name), "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source, null among them, at equal weight, by replication, in a global shuffle; ties go by doc_id and copy."""
    names = tuple(fresh(docs, "copy", "place"))
    order = [names[1], "doc_id", names[0]]
    copies = saved(mixing.replicate(docs, names=names))
    return copies.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and group_id of every row; copies of a text, null ones as empty, share a shard."""
    return sharding.shards(docs)


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix_sources", mix_sources),
    ("shard", shard),
]

#: The first stage fits models, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
