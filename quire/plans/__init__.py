"""Registered queries with their SQL counterparts, and the rules on tables of one's own."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from quire.sources.fixtures import PARTS, prefix, translated
from quire.sources.store import bucketed, buckets_for, stored

from .catalog import OPS

TABLES = ("documents", "pages", "events", "lineitem")
RULES = {name: (needs, sql) for name, needs, sql in OPS}


def text_of(needs: list[str], sql: str, dialect: str, given: tuple[str, ...] = ()) -> str:
    parts = prefix([x for x in needs if x not in TABLES], dialect, given)
    body = sql.strip()
    if dialect == "duck":
        body, parts = (x.replace("LEFT SEMI JOIN", "SEMI JOIN").replace("LEFT ANTI JOIN", "ANTI JOIN") for x in (body, parts))
    out = translated(parts, dialect) + translated(body if parts else body.lstrip(", \n"), dialect)
    if not parts and body.startswith(","):
        out = "WITH " + out
    return out


def bound(spark: SparkSession, sql: str, frames: dict[str, DataFrame]) -> DataFrame:
    """sql over the frames by name. They are views under names of their own only while the text is analysed."""
    names = {k: f"quire_{uuid.uuid4().hex}" for k in frames}
    ctes = ",\n".join(f"{k} AS (SELECT * FROM {v})" for k, v in names.items())
    tail = re.sub(r"^WITH (RECURSIVE )?", ", ", sql.lstrip()) if sql.lstrip().startswith("WITH ") else f" {sql}"
    try:
        for k, df in frames.items():
            df.createOrReplaceTempView(names[k])
        return spark.sql(f"WITH {ctes}{tail}" if frames else sql)
    finally:
        for v in names.values():
            spark.catalog.dropTempView(v)


def apply(rule: str, **tables: DataFrame) -> DataFrame:
    """A rule of the catalogue on one's own records.

    tables: any of the relations that the rule needs, or of those they build on, by name (`layout` with one row a line is enough
    for most): columns as in quire.sources.fixtures.PARTS. Relations not given are derived from those given.
    """
    spark = next(iter(tables.values())).sparkSession
    if rule in documents.OPERATED:
        return documents.OPERATED[rule](lambda part: tables[part] if part in tables else bound(spark, text_of([part], f"SELECT * FROM {part}", "spark", tuple(tables)), tables))
    needs, sql = RULES[rule]
    return bound(spark, text_of(needs, sql, "spark", tuple(tables)), tables)


def fixture(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    """A relation of the fixtures, from the test tables."""
    return query([part], f"SELECT * FROM {part}")(spark, sf_dir)


#: Relations that many rules read: written once for a session and folder, so that no plan reads or splits the texts again.
STORED = ("layout", "all_blocks", "body", "words", "drawings", "fill_text", "html_blocks", "cells", "running")
#: Those of them that lie in buckets by what nearly all rules over them join and group by, so that these needn't shuffle them: the keys, the table that they are
#: made from, and how many bytes of it on disk go to a bucket.
DEALT = {part: (["doc_id", "page"], "documents", 4 << 20) for part in ("layout", "all_blocks", "body", "words", "drawings", "fill_text")} | {"cells": (["t"], "lineitem", 4 << 20)}
KEPT: dict[tuple[str, str, str], DataFrame] = {}


def kept(spark: SparkSession, sf_dir: str, part: str) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, part)
    if key not in KEPT:
        made = query([part], f"SELECT * FROM {part}", made=part)(spark, sf_dir)
        if part in DEALT:
            keys, source, each = DEALT[part]
            # joins by these keys and more need no shuffle either
            spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
            KEPT[key] = bucketed(made, keys, buckets_for(f"{sf_dir}/{source}.parquet", spark, each))
        else:
            KEPT[key] = stored(made)
    return KEPT[key]


def met(needs: list[str], made: str = "") -> tuple[str, ...]:
    """The stored relations that the needs come down to, except the one being made."""
    on, found, seen, todo = {name: on for name, _, on in PARTS}, [], set(), list(needs)
    while todo:
        part = todo.pop()
        if part in STORED and part != made:
            found.append(part)
        elif part not in seen:
            todo += on.get(part, [])
        seen.add(part)
    return tuple(dict.fromkeys(found))


def query(needs: list[str], sql: str, made: str = ""):
    given = met(needs, made)
    spark_sql = text_of(needs, sql, "spark", given)
    read = [t for t in TABLES if re.search(rf"\b{t}\b", spark_sql)]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return bound(spark, spark_sql, {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in read} | {p: kept(spark, sf_dir, p) for p in given})

    return run


QUERIES = {name: query(needs, sql) for name, needs, sql in OPS}
ORACLES = {name: text_of(needs, sql, "duck") for name, needs, sql in OPS}

from . import documents, packages, structure  # noqa: E402  (use query)

for more in (packages, documents, structure):
    for name in more.QUERIES:
        ORACLES.pop(name, None)
    QUERIES |= more.QUERIES
    ORACLES |= more.ORACLES
