"""Vectors compressed to one byte a part: product quantisation by Lloyd rounds with Elkan's bounds, in whole numbers.

Components become floor(SCALE * x); a vector is cut into PARTS equal parts, each with a codebook of ENTRIES. Rounds are exact: squared
distances are whole numbers, an assignment is the nearest entry, of several the first, whatever the bounds say.
With every row its bounds are written: for each part an upper bound on the distance to its entry, and a lower bound for each entry. After
entries move, the upper bound grows by the movement of its own entry, the lower ones shrink by that of theirs. An entry is compared only if
neither its lower bound nor half its distance from the row's entry lies strictly above the upper bound; so an entry that ties is always
compared, in whole numbers. Bounds are kept as 32-bit floats, rounded to the safe side.

Sums of parts by entry are added up within tasks, then by Spark; the driver sees codebooks only (PARTS * ENTRIES rows, whatever the input).

Rows whose vector is null or holds null or non-finite components are left out; so are vectors of another length than the most
frequent one that PARTS divides (the longer of equals), which can't be cut alike. Of a repeated vec_id every row counts; the first codebook takes rows in
order of vec_id, then components, null ids last; with fewer rows than ENTRIES it is as long as they are. An empty table gives no rows. Components are
refused with an error where squared errors would not fit a long (about 6 million at 64 components). Extra columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved, small, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Rows compared at once in a task.
CHUNK = 512
#: A row's number, label, whole components, and for each part its entry, the upper bound and the lower bounds.
STATE = "vec_id long, label {label}, v binary, code binary, upper binary, lower binary, compared long"


def whole(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """vec_id, label, v (whole components) of the rows that can be cut."""
    x = F.col("embedding")
    sound = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))), F.lit(False))
    kept = vectors.filter(sound).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("x"))
    length = kept.groupBy(F.size("x").alias("n")).count().filter((F.col("n") > 0) & (F.col("n") % parts == 0)).orderBy(F.desc("count"), F.desc("n")).first()
    n = length["n"] if length else 0
    most = float(math.isqrt((1 << 61) // max(n, 1)))
    value = lambda c: F.when(F.abs(c * scale) < most, F.floor(c * scale)).otherwise(F.raise_error(F.lit("component too large for whole squared errors")))
    return kept.filter(F.size("x") == n).select("vec_id", "label", F.transform("x", lambda c: value(c).cast("long")).alias("v"))


def first_entries(rows: DataFrame, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width): the rows of the smallest vec_ids, cut."""
    got = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    return np.array([r["v"] for r in got], np.int64).reshape(len(got), parts, -1).transpose(1, 0, 2) if got else np.zeros((parts, 0, 0), np.int64)


def above(x: np.ndarray) -> np.ndarray:
    return np.nextafter(x.astype(np.float32), np.float32(np.inf))


def beneath(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter(x.astype(np.float32), np.float32(-np.inf)), np.float32(0))


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a - b) ** 2).sum(-1)


def first(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, ...]:
    """code, upper and lower bounds of rows x (rows, parts, width), every entry compared, and how many comparisons that took."""
    far = np.stack([squared(x[:, p, None, :], book[p][None]) for p in range(x.shape[1])], 1)
    return far.argmin(-1), above(np.sqrt(far.min(-1))), beneath(np.sqrt(far)), far.size


def again(x: np.ndarray, book: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """As first(), from the bounds of an earlier book whose entries (parts, entries) have moved so far since."""
    at = np.arange(x.shape[1])
    upper, lower, code = above(upper.astype(float) + moved[at, code]), beneath(lower.astype(float) - moved), code.copy()
    half = beneath(np.sqrt(squared(book[:, :, None, :], book[:, None, :, :])) / 2)
    near = half + np.where(np.eye(book.shape[1], dtype=bool), np.float32(np.inf), np.float32(0))  # an entry is not its own rival
    doubt = ((lower <= upper[..., None]) & (near[at, code] <= upper[..., None])).any(-1)
    r, p = np.nonzero(doubt)
    mine, c, low = x[r, p], code[r, p], lower[r, p]
    own = squared(mine, book[p, c])
    high = np.minimum(upper[r, p], above(np.sqrt(own)))
    i, e = np.nonzero((low <= high[:, None]) & (near[p, c] <= high[:, None]))
    far = np.full(low.shape, np.iinfo(np.int64).max)
    far[np.arange(len(r)), c] = own
    far[i, e] = squared(mine[i], book[p[i], e])
    low[i, e] = beneath(np.sqrt(far[i, e]))
    low[np.arange(len(r)), c] = beneath(np.sqrt(own))
    code[r, p], upper[r, p], lower[r, p] = far.argmin(-1), above(np.sqrt(far.min(-1))), low
    return code, upper, lower, len(r) + len(i)


def blobs(a: np.ndarray, kind: str) -> pa.Array:
    return pa.array([r.tobytes() for r in a.astype(kind)], pa.binary())


def unpacked(column: pa.Array, kind: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), *shape)


def assigning(book: np.ndarray, moved: np.ndarray | None, last: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A pass over rows, of whole() if moved is None, else of the pass before; last: code in hex digits and error instead of bounds."""
    parts, entries, width = book.shape

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        n, columns = len(b), {"vec_id": b["vec_id"], "label": b["label"]}
        if moved is None:
            x = b["v"].flatten().to_numpy(zero_copy_only=False).reshape(n, parts, width)
            code, upper, lower, compared = first(x, book)
        else:
            x = unpacked(b["v"], "<i8", parts, width)
            code, upper, lower, compared = again(x, book, moved, unpacked(b["code"], "u1", parts).astype(int), unpacked(b["upper"], "<f4", parts), unpacked(b["lower"], "<f4", parts, entries))
        if last:
            columns |= {"code": pa.array([r.tobytes().hex() for r in code.astype("u1")], pa.string()), "error": pa.array(squared(x, book[np.arange(parts), code]).sum(-1))}
        else:
            columns |= {"v": blobs(x, "<i8"), "code": blobs(code, "u1"), "upper": blobs(upper, "<f4"), "lower": blobs(lower, "<f4")}
        return pa.RecordBatch.from_pydict(columns | {"compared": pa.array([compared] + [0] * (n - 1), pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, len(b), CHUNK):
                yield one(b.slice(at, CHUNK))

    return run


def sums(parts: int, entries: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of each task one row an entry in use: how many parts it has, and their sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for b in batches:
            x, code = unpacked(b["v"], "<i8", parts, width), unpacked(b["code"], "u1", parts)
            for p in range(parts):
                np.add.at(total[p], code[:, p], x[:, p])
                np.add.at(count[p], code[:, p], 1)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_pydict({"part": pa.array(p, pa.int32()), "entry": pa.array(e, pa.int32()), "n": pa.array(count[p, e]), "total": pa.array(total[p, e].tolist(), pa.list_(pa.int64()))})

    return run


def updated(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The book with every entry in use at the mean of its parts, rounded down."""
    partial = state.select("v", "code").mapInArrow(sums(*book.shape), "part int, entry int, n long, total array<long>")
    summed = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("total")[i]) for i in range(book.shape[2])]).alias("total"))
    new = book.copy()
    for r in summed.collect():
        new[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return new


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vec_id, label, code, error, compared (distances computed, told on some row of each chunk) of every row kept, and the codebooks (parts, entries, width).

    entries: 256 at most, as a code has a byte a part.
    """
    rows = whole(vectors, parts, scale)
    label = dict(rows.dtypes)["label"]
    book = first_entries(rows, parts, min(entries, 256))
    if not book.size:
        return rows.limit(0).select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("compared")), book
    moved, state = None, rows
    for _ in range(rounds):
        after = saved(state.mapInArrow(assigning(book, moved, False), STATE.format(label=label)))
        if moved is not None:
            forget(state)
        state, new = after, updated(after, book)
        moved, book = np.sqrt(squared(new, book)), new
    out = saved(state.mapInArrow(assigning(book, moved, True), f"vec_id long, label {label}, code string, error long, compared long"))
    if rounds:
        forget(state)
    return out, book


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error summed over its label, and the digest of the final codebooks."""
    found, book = compressed(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    digest = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    by_label = small(found.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")))
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _assigned(at: int, book: int) -> str:
    """SQL of a pass: each part's nearest entry, of several the first."""
    return f"""a{at} AS (SELECT r, p, any_value(v) AS v, min((list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e)) AS b
    FROM x JOIN c{book} USING (p) GROUP BY r, p)"""


def _moved(book: int) -> str:
    return f"""c{book + 1} AS (SELECT c.p, c.e, coalesce(m.c, c.c) AS c FROM c{book} AS c LEFT JOIN (SELECT p, e, list(CAST(floor(s / n) AS BIGINT) ORDER BY i) AS c FROM (
        SELECT p, a.b[2] AS e, i, sum(v[i])::DOUBLE AS s, count(*) AS n FROM a{book + 1} AS a, range(1, len(a.v) + 1) AS q(i) GROUP BY ALL) GROUP BY p, e) AS m ON m.p = c.p AND m.e = c.e)"""


ORACLE = f"""
WITH k AS (SELECT row_number() OVER (ORDER BY vec_id, embedding) AS r, vec_id, label, list_transform(embedding, lambda c: CAST(floor({SCALE} * c::DOUBLE) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0),
x AS (SELECT r, p, list_slice(v, p * len(v) // {PARTS} + 1, (p + 1) * len(v) // {PARTS}) AS v FROM k, range({PARTS}) AS q(p)),
c0 AS (SELECT p, r - 1 AS e, v AS c FROM x WHERE r <= {ENTRIES}),
{_assigned(1, 0)}, {_moved(0)}, {_assigned(2, 1)}, {_moved(1)}, {_assigned(3, 2)},
d AS (SELECT r, string_agg(printf('%02x', b[2]::INT), '' ORDER BY p) AS code, sum(b[1])::BIGINT AS error FROM a3 GROUP BY r),
h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c2)
SELECT k.vec_id, d.code, d.error, CAST(sum(d.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN d USING (r), h
"""
