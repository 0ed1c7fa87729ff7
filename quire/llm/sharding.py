"""Minimax contiguous partition of documents into shards.

Documents with equal texts form an atomic group (null counts as empty). Groups are ordered by their
smallest doc_id; the smallest shard capacity for which a greedy scan needs at most n shards is found
by binary search over the groups' running sums, and the sequence is cut there. The driver holds only a bounded set
of candidate cut points, refined around the places where the cuts can still lie.

Nulls: a null text has size 8 and the CRC of no bytes; a null doc_id sorts first. Repeated rows are rows of
their own in one group. With fewer groups than shards, the last shards stay empty. An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, saved, table

#: Candidate cut points fetched to the driver per refinement.
POINTS = 8192


def greedy(points: list[int], capacity: int, n: int, optimistic: frozenset | set = frozenset()) -> list[int] | None:
    """Ends of the shards that a greedy scan makes, None if over n are needed.

    points: sorted known group ends from 0 to the total. optimistic: indexes i so that unknown ends may lie
    between points[i] and points[i + 1]; a shard may then end anywhere there.
    """
    at, out = 0, []
    for _ in range(n):
        to = min(at + capacity, points[-1])
        i = bisect_right(points, to) - 1
        end = to if i in optimistic else points[i]
        if end <= at:
            return None
        out.append(end)
        at = end
        if at == points[-1]:
            return out
    return None


def smallest(points: list[int], lo: int, hi: int, n: int, optimistic: set | frozenset = frozenset()) -> int:
    """The smallest capacity from lo to hi for which greedy() succeeds; hi is taken to succeed."""
    while lo < hi:
        mid = (lo + hi) // 2
        if greedy(points, mid, n, optimistic):
            hi = mid
        else:
            lo = mid + 1
    return lo


def reachable(points: list[int], lo: int, hi: int, n: int, opened: set) -> list[int]:
    """The segments with unknown ends where a cut can lie for any capacity from lo to hi."""
    low, high, a, b = [], [], 0, 0
    for _ in range(n):
        a = points[bisect_right(points, min(a + lo, points[-1])) - 1]
        j = bisect_right(points, min(b + hi, points[-1])) - 1
        b = min(b + hi, points[-1]) if j in opened else points[j]
        low.append(a)
        high.append(b)
    return [i for i in sorted(opened) if any(points[i] <= y and x <= points[i + 1] for x, y in zip(low, high, strict=True))]


def balanced(points: list[int], capacity: int, n: int, opened: set) -> tuple[list[int], list[int]]:
    """Cuts for that capacity, each as near to an equal share of what is left as it allows; segments to look into first.

    The scan from the end gives the smallest cut from which the rest still fits.
    """
    total, seek = points[-1], set()
    least = [total]
    for _ in range(n - 1):
        to = least[-1] - capacity
        i = bisect_left(points, to) if to > 0 else 0
        if i - 1 in opened and points[i] != to:
            seek.add(i - 1)
        least.append(points[i])
    least.reverse()  # least[k]: of the cut that ends shard k
    cuts, at = [], 0
    for k in range(n - 1):
        if at == total:
            break
        share = at + (total - at) // (n - k)
        i = bisect_right(points, share) - 1
        if i in opened:
            seek.add(i)
        low, high = points[i], points[min(i + 1, len(points) - 1)]
        if high - at > capacity or low > at and share - low <= high - share:
            high = low
        cut = max(high, least[k])
        if cut > at:
            cuts.append(cut)
            at = cut
    return cuts + [total] * (at < total), sorted(seek)


def stretches(points: list[int], seek: list[int], most: int) -> list[tuple[int, int]]:
    """Bounds of at most so many stretches that hold the segments sought; what lies between the nearest of them is looked into too."""
    found = [(points[i], points[i + 1]) for i in seek]
    gaps = sorted((b[0] - a[1], k) for k, (a, b) in enumerate(zip(found, found[1:], strict=False)))
    split = sorted(k + 1 for gap, k in gaps[len(gaps) - most + 1 :] if gap) if most > 1 else []
    return [(found[i][0], found[j - 1][1]) for i, j in zip([0, *split], [*split, len(found)], strict=True)]


def minimax_cuts(ends: DataFrame, total: int, largest: int, n: int, width: int = POINTS) -> tuple[int, list[int]]:
    """(capacity, shard ends) over the column `end`, the distinct running sums of the ordered groups."""
    if not total:
        return 0, []
    points, opened = [0, total], {0}
    while True:
        floor = max(-(-total // n), largest)
        hi = smallest(points, floor, total, n)
        lo = smallest(points, floor, hi, n, opened)
        if greedy(points, lo, n):
            cuts, seek = balanced(points, lo, n, opened)
            if not seek:
                return lo, cuts
        else:
            seek = reachable(points, lo, hi, n, opened)
        # one branch a stretch: a branch for each segment would be hundreds, whose plans fill the driver's memory
        parts = stretches(points, seek, n)
        step = max(1, -(-sum(b - a for a, b in parts) // width))
        case, where = None, None
        for i, (a, b) in enumerate(parts):
            inside = (F.col("end") > a) & (F.col("end") < b)
            cell = F.struct(F.lit(i).alias("i"), F.floor((F.col("end") - a) / step).alias("c"))
            case = F.when(inside, cell) if case is None else case.when(inside, cell)
            where = inside if where is None else where | inside
        cells = ends.filter(where).groupBy(case.alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count("*").alias("n")).collect()
        gaps = {(r["a"], r["b"]) for r in cells if r["n"] > 2}
        still = {(points[i], points[i + 1]) for i in opened if not any(a <= points[i] and points[i + 1] <= b for a, b in parts)} | gaps
        points = sorted({*points, *(r["a"] for r in cells), *(r["b"] for r in cells)})
        # known ends may lie within a gap
        opened = {i for a, b in still for i in range(bisect_left(points, a), bisect_left(points, b))}


def shards(docs: DataFrame, n: int = 24) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and group_id for every row of docs."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    rows = saved(rows)
    groups = rows.groupBy("digest").agg(F.min("doc_id").alias("group_id"))
    placed = saved(ranked(rows.join(groups, "digest"), ["group_id", "digest", "doc_id"], "size"))
    ends = saved(placed.groupBy("group_id", "digest").agg(F.max("cum").alias("end"), F.sum("size").alias("bytes")))
    all_of = ends.agg(F.max("end").alias("total"), F.max("bytes").alias("largest")).first()
    cuts = minimax_cuts(ends, all_of["total"] or 0, all_of["largest"] or 0, n)[1]
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + (F.col("cum") > c).cast("int")
    placed = placed.withColumn("shard", shard.cast("int"))
    first = [0] * n
    for r in placed.groupBy("shard").agg(F.min("pos").alias("at")).collect():
        first[r["shard"]] = r["at"]
    start = F.element_at(F.array(*[F.lit(x).cast("long") for x in first]), F.col("shard") + 1)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("pos") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group_id")


def op2_sharding(spark, sf_dir: str) -> DataFrame:
    return shards(table(spark, sf_dir, "documents"))
