"""A trie of the common beginnings of conversations, built level by level.

A turn is the SHA-256 of its role and text, so texts are read once and never shuffled. Conversations of one sequence of turns become one
class, named by its least conv_id. Per depth the live classes are grouped by (parent node, next turn); a node takes the least conv_id
below it. A class that is alone in its node leaves the loop: the rest of it is a chain, written out at once. So there are as many rounds
as turns that different sequences share. Then the levels are joined from the deepest up, which sums leaves and savings. Every level is a written table.

No step gathers a group: turns are numbered in range partitions that split a long conversation, classes and nodes are found by partial
aggregates, and joins are on conv_id or on the node, unique on one side at least. The digest of the members that end in a node runs over
them in ascending order, as SHA-256 must, in a stream of pieces that holds one piece at a time.

Nulls: rows without conv_id belong to no conversation and are left out; a null role or text is empty; a null turn comes first.
Ties of a turn go by the digest of role and text; repeated rows are turns of their own. Very long texts are hashed whole.
An empty table has no nodes, not even the root. Columns of other names don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, saved, small, table

#: Digest of no conversation.
NOBODY = hashlib.sha256(b"").hexdigest()
ROOT = "root"
#: Members that a piece of a digest's input holds.
PIECE = 10_000
#: Conversations lend their beginnings to those of the same hundred, of up to so many turns.
BLOCK, MOST = 100, 5


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, key (of role and text) and chars of every row that has a conv_id."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return conversations.filter("conv_id is not null").select("conv_id", "turn", key.alias("key"), F.length(text).cast("long").alias("chars"))


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, depth (from 1), key and chars of turns() in order.

    Rows are dealt by range, repeated ones too, so a long conversation lies in many partitions; of each partition its first and last
    conversation and a count reach the driver.
    """
    keys = [F.col(k).asc_nulls_first() for k in ("conv_id", "turn", "key", "tie")]
    dealt = saved(rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(*keys).withColumn("pid", F.spark_partition_id()))
    ends = dealt.groupBy("pid", "conv_id").agg(F.count("*").alias("n")).groupBy("pid").agg(F.min(F.struct("conv_id", "n")).alias("first"), F.max(F.struct("conv_id", "n")).alias("last"))
    before, conv, n = [], None, 0
    for r in ends.orderBy("pid").collect():
        carried = n if r["first"]["conv_id"] == conv else 0
        before.append((r["pid"], r["first"]["conv_id"], carried))
        conv, n = r["last"]["conv_id"], r["last"]["n"] + (carried if r["last"]["conv_id"] == r["first"]["conv_id"] else 0)
    carry = rows.sparkSession.createDataFrame(before, "pid int, head long, carried long")
    number = F.row_number().over(Window.partitionBy("pid", "conv_id").orderBy(*keys[1:]))
    joined = dealt.withColumn("number", number).join(F.broadcast(carry), "pid")
    return joined.select("conv_id", (F.col("number") + F.when(F.col("conv_id") == F.col("head"), F.col("carried")).otherwise(0)).alias("depth"), "key", "chars")


def lent(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of placed() with beginnings lent, and the conv_ids, also of conversations that are left without turns.

    Conversation c has the first h turns of conversation c - c % BLOCK (as many as there are) in place of its own first h,
    h the CRC-32 of c in decimals modulo MOST + 1.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST + 1)
    of = saved(rows.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "lender": F.col("conv_id") - F.col("conv_id") % BLOCK}))
    has = of.select(F.col("conv_id").alias("lender"), F.col("n").alias("has"))
    shift = of.join(has, "lender", "left").select("conv_id", "h", F.least("h", F.coalesce("has", F.lit(0))).alias("taken"))
    own = rows.join(shift, "conv_id").filter("depth > h").select("conv_id", (F.col("depth") - F.col("h") + F.col("taken")).alias("depth"), "key", "chars")
    heads = rows.filter(F.col("depth") <= MOST).withColumnRenamed("conv_id", "lender")
    given = of.join(heads, "lender").filter("depth <= h").select("conv_id", "depth", "key", "chars")
    return saved(own.unionByName(given)), of.select("conv_id")


def classes(rows: DataFrame, members: DataFrame) -> DataFrame:
    """conv_id and cls of every member; those with equal sequences of turns share cls, a sum over all turns of 240 bits of their digests."""
    digest = F.sha2(F.concat("key", F.col("depth").cast("string")), 256)
    words = [F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)") for i in range(4)]
    sums = rows.groupBy("conv_id").agg(F.count("*").alias("turns"), *[F.sum(w).alias(f"w{i}") for i, w in enumerate(words)])
    named = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("turns", "w0", "w1", "w2", "w3")])
    return members.join(sums, "conv_id", "left").select("conv_id", F.coalesce("turns", F.lit(0).cast("long")).alias("turns"), named.alias("cls"))


def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The members of a class, in runs of up to PIECE, joined by commas."""
    cls, first, held = None, None, []
    for b in batches:
        for c, conv in zip(b["cls"], b["conv_id"], strict=True):
            if held and (c != cls or len(held) == PIECE):
                yield pd.DataFrame({"cls": [cls], "first": [first], "part": [",".join(held)]})
                held = []
            if not held:
                cls, first = c, conv
            held.append(str(conv))
    if held:
        yield pd.DataFrame({"cls": [cls], "first": [first], "part": [",".join(held)]})


def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 over the pieces of a class, which come in order."""
    cls, at = None, None
    for b in batches:
        for c, part in zip(b["cls"], b["part"], strict=True):
            if c != cls:
                if at:
                    yield pd.DataFrame({"cls": [cls], "ends_sha256": [at.hexdigest()]})
                cls, at = c, hashlib.sha256()
            else:
                at.update(b",")
            at.update(part.encode())
    if at:
        yield pd.DataFrame({"cls": [cls], "ends_sha256": [at.hexdigest()]})


def gathered(of: DataFrame) -> DataFrame:
    """conv_id (least), turns, w (members) and ends_sha256 of each class."""
    groups = saved(of.groupBy("cls").agg(F.min("conv_id").alias("least"), F.min("turns").alias("turns"), F.count("*").alias("w")))
    several = of.join(groups.filter("w > 1").select("cls"), "cls", "left_semi").select("cls", "conv_id")
    runs = several.repartitionByRange("cls", "conv_id").sortWithinPartitions("cls", "conv_id").mapInPandas(pieces, "cls string, first long, part string")
    hashed = saved(runs.repartition("cls").sortWithinPartitions("cls", "first").mapInPandas(digests, "cls string, ends_sha256 string"))
    alone = F.sha2(F.col("least").cast("string").cast("binary"), 256)
    return saved(groups.join(hashed, "cls", "left").select(F.col("least").alias("conv_id"), "turns", "w", F.coalesce("ends_sha256", alone).alias("ends_sha256")))


def with_chains(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The turns of each class's least conversation with turns, w and chain: what is saved from that turn on if nothing else shares it."""
    of = rows.join(groups.select("conv_id", "turns", "w"), "conv_id")
    sums = ranked(of.filter("w > 1"), ["conv_id", "depth"], "chars")
    last = sums.filter("depth = turns").select("conv_id", F.col("cum").alias("end"))
    rest = sums.join(last, "conv_id").select("conv_id", "depth", ((F.col("w") - 1) * (F.col("end") - F.col("cum") + F.col("chars"))).alias("chain"))
    return saved(of.join(rest, ["conv_id", "depth"], "left").withColumn("chain", F.coalesce("chain", F.lit(0).cast("long"))).repartitionByRange("depth", "conv_id"))


def grown(rows: DataFrame, groups: DataFrame) -> list[DataFrame]:
    """The nodes of each level, the root's first: at, parent, conv_id, n_convs, groups (classes in it), chars (of its last text), chain, ending (the class that ends in it)."""
    one = F.col("conv_id")
    root = groups.agg(F.min(one).alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("groups"), F.min(F.when(F.col("turns") == 0, one)).alias("ending"))
    levels = [saved(root.filter("groups > 0").select(F.lit(ROOT).alias("at"), F.lit(None).cast("string").alias("parent"), "conv_id", "n_convs", "groups", F.lit(0).cast("long").alias("chars"), F.lit(0).cast("long").alias("chain"), "ending"))]
    live = groups.select("conv_id", F.lit(ROOT).alias("parent"))
    while True:
        depth = len(levels)
        met = saved(live.join(rows.filter(F.col("depth") == depth), "conv_id").withColumn("at", F.sha2(F.concat("parent", "key"), 256)))
        if met.isEmpty():
            return levels
        found = met.groupBy("parent", "key").agg(F.min("at").alias("at"), F.min(one).alias("conv_id"), F.sum("w").alias("n_convs"), F.count("*").alias("groups"), F.max("chars").alias("chars"), F.max("chain").alias("chain"), F.min(F.when(F.col("turns") == depth, one)).alias("ending"))
        levels.append(saved(found.drop("key").select(*levels[0].columns)))
        live = met.join(levels[-1].filter("groups = 1").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.col("at").alias("parent"))


def rolled(levels: list[DataFrame]) -> list[DataFrame]:
    """The root and the nodes of several classes, level by level from the deepest up, with depth, n_children, n_leaves and saved_tokens."""
    none, out, below = F.lit(0).cast("long"), [], None
    for depth in range(len(levels) - 1, -1, -1):
        shared = levels[depth] if not depth else levels[depth].filter("groups > 1")
        if depth + 1 < len(levels):
            kids = levels[depth + 1].filter("groups = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.col("chain").alias("saved_tokens"))
            kids = kids if below is None else kids.unionByName(below.select(*kids.columns))
            sums = kids.groupBy(F.col("parent").alias("at")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("kept"))
            node = shared.join(sums, "at", "left")
        else:
            node = shared.withColumns({"n_children": none, "n_leaves": none, "kept": none})
        own = (F.col("n_convs") - 1) * F.col("chars")
        below = saved(node.select("at", "parent", "conv_id", F.lit(depth).cast("long").alias("depth"), "n_convs", F.coalesce("n_children", none).alias("n_children"), F.greatest(F.coalesce("n_leaves", none), F.lit(1)).alias("n_leaves"), (F.coalesce("kept", none) + own).alias("saved_tokens"), "ending"))
        out.append(below)
    return out


def union(of: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one scan."""
    return of[0].sparkSession.read.schema(of[0].schema).parquet(*[df.written_to for df in of])


def trie(rows: DataFrame, members: DataFrame) -> DataFrame:
    """A row a node: conv_id (the least member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    rows: conv_id, depth (from 1, without gaps), key, chars. members: every conv_id once, also those without rows.
    """
    groups = gathered(saved(classes(rows, members)))
    of = with_chains(rows, groups)
    levels = grown(of, groups)
    shared = union(rolled(levels))
    tops = reduce(DataFrame.unionByName, [df.filter("groups = 1").select("conv_id", "parent", F.lit(d + 1).cast("long").alias("from")) for d, df in enumerate(levels[1:])], levels[0].limit(0).select("conv_id", "parent", F.lit(0).cast("long").alias("from")))
    name = small(shared.select(F.col("at").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    last = groups.select(F.col("conv_id").alias("ending"), "ends_sha256")
    inner = shared.join(name, "parent", "left").join(last, "ending", "left")
    over: Column = F.col("depth") < F.col("turns")
    chains = of.join(tops.join(name, "parent"), "conv_id").filter(F.col("depth") >= F.col("from")).join(groups.select("conv_id", "ends_sha256"), "conv_id")
    parent = F.when(F.col("depth") == F.col("from"), F.col("parent_conv_id")).otherwise(F.col("conv_id"))
    outer = chains.select("conv_id", F.col("depth").cast("long").alias("depth"), parent.alias("parent_conv_id"), F.col("w").alias("n_convs"), over.cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.col("chain").alias("saved_tokens"), F.when(~over, F.col("ends_sha256")).alias("ends_sha256"))
    return inner.select(*outer.columns).unionByName(outer).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))


def op11_trie(spark, sf_dir: str) -> DataFrame:
    """The nodes of the trie of all conversations, after each has borrowed the beginning of the first of its hundred."""
    return trie(*lent(saved(placed(turns(table(spark, sf_dir, "conversations"))))))


#: CRC-32 of a short ASCII text, bit by bit.
CRC32 = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({0}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT)"

ORACLE = f"""
WITH RECURSIVE t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS p, k, n FROM (
    SELECT conv_id, turn, length(coalesce(text, '')) AS n, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % {BLOCK} AS l, {CRC32.format("conv_id::VARCHAR")} % {MOST + 1} AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, p) AS d, k, n FROM (
    SELECT c.conv_id, 0 AS own, t.p, t.k, t.n FROM c JOIN t ON t.conv_id = c.l AND t.p <= c.h
    UNION ALL SELECT c.conv_id, 1, t.p, t.k, t.n FROM c JOIN t ON t.conv_id = c.conv_id AND t.p > c.h)),
s AS (SELECT conv_id, 0::BIGINT AS d, 0::BIGINT AS n, 'root' AS nd, NULL::VARCHAR AS up FROM c
    UNION ALL SELECT r.conv_id, r.d, r.n, sha256(s.nd || r.k), s.nd FROM s JOIN r ON r.conv_id = s.conv_id AND r.d = s.d + 1),
z AS (SELECT conv_id, max(d) AS z FROM s GROUP BY conv_id),
b AS (SELECT nd, any_value(up) AS up, min(s.conv_id) AS conv_id, any_value(d) AS d, count(*) AS m, any_value(n) AS n, sha256(coalesce(string_agg(s.conv_id::VARCHAR, ',' ORDER BY s.conv_id) FILTER (WHERE d = z), '')) AS e FROM s JOIN z USING (conv_id) GROUP BY nd),
a AS (SELECT nd AS top, nd AS low FROM b UNION ALL SELECT b.up, a.low FROM a JOIN b ON b.nd = a.top WHERE b.up IS NOT NULL),
k AS (SELECT up, count(*) AS kids FROM b GROUP BY up),
u AS (SELECT a.top AS nd, count(*) FILTER (WHERE k.kids IS NULL) AS leaves, sum((b.m - 1) * b.n) AS saved FROM a JOIN b ON b.nd = a.low LEFT JOIN k ON k.up = b.nd GROUP BY a.top)
SELECT b.conv_id, b.d::BIGINT AS depth, p.conv_id AS parent_conv_id, b.m AS n_convs, coalesce(k.kids, 0)::BIGINT AS n_children, u.leaves::BIGINT AS n_leaves, u.saved::BIGINT AS saved_tokens, b.e AS ends_sha256
FROM b JOIN u USING (nd) LEFT JOIN k ON k.up = b.nd LEFT JOIN b AS p ON p.nd = b.up
"""
