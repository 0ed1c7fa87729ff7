"""Copies among images, by local descriptors.

Corners (Harris) are found on several scales; each is described by 256 binary intensity tests turned by its orientation (the direction of
its intensity centroid). A corner is indexed together with each of its MATES nearest corners of the same scale, in TABLES hash tables keyed by KEY
bits of either descriptor, drawn at random, and by how the two lie to each other: their turns and their distance, in bins whose borders
differ by table. Two images meet where such pairs share a bucket, differ in at most ALIKE of SKETCH bits and in at most WHOLE of all bits of
either descriptor, hardly more than corners that match, and lie alike; only these leave the bucket. One descriptor alone says too little: smooth pictures have many like corners, and candidates would grow with the
square of the images. Images that meet are compared descriptor by descriptor and linked if at least
INLIERS matches, and SHARE of the corners of the image with fewer, agree on one similarity transform. Crops, shifts, turns by any angle,
rescaling and changes of brightness keep enough corners of pictures from about 80 pixels a side; smaller ones have too few. Equal images are one class; in a bucket each row is tried with the first that it is alike with, of many
rows with the bucket's first, until components are known, then the pairs left between components: so a group of copies gives no more pairs than it has rows.

Formats: binary PGM and PPM, and 8-bit non-interlaced PNG. A null, empty or unreadable image has no corners and links with nothing, except that
equal bytes are one class; a row without id has component null; rows that repeat an id are one image.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache, partial, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, freed, saved, table
from .jaccard import all_links, mix

SCALES, CORNERS, CELL, RADIUS, BITS, TABLES, KEY = (1.0, 0.75, 0.5625), 16, 32, 7, 256, 6, 10
#: Mates of a corner, from NEAR pixels of its scale on, sought within REACH at first; bins of a turn, octaves of a bin of distances.
MATES, NEAR, REACH, TURNS, OCTAVES = 3, 6.0, 64.0, 6, 0.6
#: What pairs of corners that meet may differ in: bits of SKETCH of either descriptor, of the whole one, 1024ths of a turn (of the orientations, of the direction), hundredths of an octave.
SKETCH, ALIKE, WHOLE, ORIENTATION, DIRECTION, DISTANCE = 64, 14, 48, 65, 49, 25
#: Pairs of corners in a bucket from which on only those with its first are tried at once; passes over the index, which bound its disk.
LARGE, PASSES = 64, 6
#: Largest Hamming distance of a match, largest error of an inlier in pixels; inliers asked for, and as a share of the corners of the image with fewer.
HAMMING, ERROR, INLIERS, SHARE = 40, 3.0, 6, 0.1
#: x, y, scale, angle of a corner, then its descriptor.
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("scale", "<f4"), ("angle", "<f4"), ("bits", "u1", BITS // 8)])


def png(data: bytes) -> np.ndarray:
    at, parts, head = 8, [], None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        raise ValueError("PNG kind")
    w, h, deep = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(h, 1 + w * deep)
    out = np.zeros((h, w * deep), np.uint8)
    above = np.zeros(w * deep, np.uint8)
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].copy()
        if kind == 2:
            line += above
        elif kind == 1:
            for c in range(deep):
                line[c::deep] = np.cumsum(line[c::deep], dtype=np.uint64).astype(np.uint8)
        elif kind:
            for i in range(w * deep):
                a = int(line[i - deep]) if i >= deep else 0
                b, c = int(above[i]), int(above[i - deep]) if i >= deep else 0
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    guess = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                line[i] = (int(line[i]) + guess) & 255
        out[y] = above = line
    grey = out.reshape(h, w, deep).astype(np.float32)
    return grey[:, :, :3].mean(2) if deep > 2 else grey[:, :, 0]


def decoded(data: bytes | None) -> np.ndarray | None:
    """Grey image, None if there is none to be had."""
    if not data:
        return None
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return png(data)
        if m := re.match(rb"P([56])\s+(\d+)\s+(\d+)\s+(\d+)\s", data):
            deep = 3 if m[1] == b"6" else 1
            w, h = int(m[2]), int(m[3])
            return np.frombuffer(data[m.end() : m.end() + w * h * deep], np.uint8).reshape(h, w, deep).astype(np.float32).mean(2)
    except (ValueError, struct.error, zlib.error, KeyError):
        pass
    return None


def box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of 2 r + 1, edges repeated."""
    n = 2 * r + 1
    p = np.pad(a, ((r + 1, r), (r + 1, r)), "edge").cumsum(0).cumsum(1)
    return (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]) / (n * n)


def scaled(a: np.ndarray, s: float) -> np.ndarray:
    """Bilinear."""
    h, w = max(1, round(a.shape[0] * s)), max(1, round(a.shape[1] * s))
    y, x = np.clip((np.arange(h) + 0.5) / s - 0.5, 0, a.shape[0] - 1), np.clip((np.arange(w) + 0.5) / s - 0.5, 0, a.shape[1] - 1)
    i, j = np.minimum(y.astype(int), max(0, a.shape[0] - 2)), np.minimum(x.astype(int), max(0, a.shape[1] - 2))
    u, v = (y - i)[:, None], (x - j)[None]
    k, m = np.minimum(i + 1, a.shape[0] - 1), np.minimum(j + 1, a.shape[1] - 1)
    return (1 - u) * ((1 - v) * a[np.ix_(i, j)] + v * a[np.ix_(i, m)]) + u * ((1 - v) * a[np.ix_(k, j)] + v * a[np.ix_(k, m)])


@lru_cache(maxsize=1)
def tests() -> np.ndarray:
    """BITS pairs of points within the patch, Gaussian around its centre."""
    rng = np.random.default_rng(11)
    p = rng.normal(0, RADIUS / 2.2, (BITS * 4, 2, 2))
    return p[(np.hypot(p[..., 0], p[..., 1]) <= RADIUS - 0.5).all(1)][:BITS]


def corners(image: np.ndarray | None) -> np.ndarray:
    """The CORNERS strongest of each cell of CELL pixels, on each scale, described."""
    found = []
    for s in SCALES:
        if image is None or min(image.shape) * s < 2 * RADIUS + 4:
            continue
        a = box(scaled(image, s) if s != 1 else image, 1)
        gy, gx = np.gradient(a)
        xx, yy, xy = box(gx * gx, 2), box(gy * gy, 2), box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        m = RADIUS + 1
        core = r[m:-m, m:-m]
        peak = core > 1e-3
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if dy or dx:
                    peak &= core >= r[m + dy : r.shape[0] - m + dy, m + dx : r.shape[1] - m + dx]
        y, x = np.nonzero(peak)
        if not len(y):
            continue
        order = np.lexsort((-core[y, x], x // CELL, y // CELL))
        cell = (y // CELL * (core.shape[1] // CELL + 1) + x // CELL)[order]
        best = order[np.arange(len(order)) - np.searchsorted(cell, cell) < CORNERS]
        y, x = y[best] + m, x[best] + m
        off = np.arange(-RADIUS, RADIUS + 1)
        disc = (off[:, None] ** 2 + off[None] ** 2) <= RADIUS**2
        patch = a[y[:, None, None] + off[None, :, None], x[:, None, None] + off[None, None]] * disc
        angle = np.arctan2((patch * off[None, :, None]).sum((1, 2)), (patch * off[None, None]).sum((1, 2)))
        c, t = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
        px, py = tests()[None, :, :, 0], tests()[None, :, :, 1]
        ix = np.rint(x[:, None, None] + c * px - t * py).astype(int)
        iy = np.rint(y[:, None, None] + t * px + c * py).astype(int)
        v = a[np.clip(iy, 0, a.shape[0] - 1), np.clip(ix, 0, a.shape[1] - 1)]
        k = np.zeros(len(y), CORNER)
        k["x"], k["y"], k["scale"], k["angle"] = (x + 0.5) / s - 0.5, (y + 0.5) / s - 0.5, s, angle
        k["bits"] = np.packbits(v[:, :, 0] < v[:, :, 1], axis=1)
        found.append(k)
    return np.concatenate(found) if found else np.zeros(0, CORNER)


#: The rest of either descriptor after its sketch, 64 bits each.
REST = tuple((f"one{i}", f"two{i}") for i in range(1, BITS // 64))
#: A pair of corners in the index: bucket, class of the image, part of either descriptor, how they lie, ten bits each, and the rest of either descriptor.
PAIR = np.dtype([("sig", "<i8"), ("cls", "<i8"), ("one", "<u8"), ("two", "<u8"), ("form", "<i4"), *((name, "<u8") for both in REST for name in both)])
#: The same for Spark, which has signed numbers only.
PAIR_TYPES = {name: "int" if name == "form" else "long" for name in PAIR.names}


@lru_cache(maxsize=1)
def keys() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bits of either descriptor and the borders of the bins of each table, and an order of all bits, the sketch first."""
    rng = np.random.default_rng(13)
    bits = np.stack([np.stack([rng.permutation(BITS)[:KEY] for _ in range(2)]) for _ in range(TABLES)])
    return bits, rng.random((TABLES, 3)), rng.permutation(BITS)


def mates(k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each corner with its MATES nearest of the same scale; strips are widened until they hold as many."""
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for s in np.unique(k["scale"]):
        at = np.flatnonzero(k["scale"] == s)
        at = at[np.argsort(k["y"][at], kind="stable")]
        z = (k["x"][at] + 1j * k["y"][at]) * s
        todo, reach = np.arange(len(at)), REACH
        while len(todo) and len(at) > 1:
            whole, left = reach > np.ptp(z.real) + np.ptp(z.imag), []
            for part in np.split(todo, range(256, len(todo), 256)):
                lo, hi = np.searchsorted(z.imag, (z.imag[part[0]] - reach, z.imag[part[-1]] + reach))
                lo, hi = (0, len(at)) if whole else (lo, hi)
                d = np.abs(z[part, None] - z[None, lo:hi])
                d[(d < NEAR) | (not whole and d > reach)] = np.inf
                n = min(MATES, d.shape[1])
                o = np.argsort(d, axis=1, kind="stable")[:, :n]
                ok = np.isfinite(np.take_along_axis(d, o, 1))
                full = ok.sum(1) == MATES if not whole else np.ones(len(part), bool)
                r, c = np.nonzero(ok & full[:, None])
                found.append((at[part[r]], at[lo + o[r, c]]))
                left.append(part[~full])
            todo, reach = np.concatenate(left), reach * 2
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, int), np.zeros(0, int))


def pairs_of(k: np.ndarray, cls: int, tables: range) -> np.ndarray:
    """The rows of the index that an image has in these tables."""
    i, j = mates(k)
    out = np.zeros((len(i), len(tables)), PAIR)
    if not len(i):
        return out.ravel()
    bits, (drawn, border, order) = np.unpackbits(k["bits"], axis=1), keys()
    step = (k["x"] + 1j * k["y"])[j] * k["scale"][j] - (k["x"] + 1j * k["y"])[i] * k["scale"][i]
    turn, way, far = (k["angle"][j] - k["angle"][i]) / (2 * np.pi) % 1, (np.angle(step) - k["angle"][i]) / (2 * np.pi) % 1, np.log2(np.abs(step))
    parts = np.ascontiguousarray(np.packbits(bits[:, order], axis=1)).view("<u8")
    out["cls"] = cls
    for n, (one, two) in enumerate((("one", "two"), *REST)):
        out[one], out[two] = parts[i, n, None], parts[j, n, None]
    whole = [(x * 1024).astype(int) & 1023 for x in (turn, way)]
    out["form"] = (whole[0] | whole[1] << 10 | np.minimum(far * 100, 1023).astype(int) << 20)[:, None]
    power = np.uint64(1) << np.arange(KEY, dtype=np.uint64)
    for n, t in enumerate(tables):
        bins = [np.floor((x * TURNS + border[t, q]) % TURNS) for q, x in enumerate((turn, way))] + [np.floor(far / OCTAVES + border[t, 2])]
        key = mix(np.full(len(i), t + 1, np.uint64))
        for part in (bits[i][:, drawn[t, 0]].astype(np.uint64) @ power, bits[j][:, drawn[t, 1]].astype(np.uint64) @ power, *(x.astype(np.uint64) for x in bins)):
            key = mix(key ^ part)
        out["sig"][:, n] = key.view(np.int64)
    return out.ravel()


def alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Which pairs of corners of different images differ as little as asked."""
    ok = x["cls"] != y["cls"]
    for sketch, *rest in zip(("one", "two"), *REST, strict=True):
        far = np.bitwise_count(x[sketch] ^ y[sketch])
        ok &= (far <= ALIKE) & (far + sum(np.bitwise_count(x[name] ^ y[name]) for name in rest) <= WHOLE)
    for shift, most in ((0, ORIENTATION), (10, DIRECTION)):
        d = ((x["form"] >> shift) - (y["form"] >> shift)) & 1023
        ok &= np.minimum(d, 1024 - d) <= most
    return ok & (np.abs((x["form"] >> 20) - (y["form"] >> 20)) <= DISTANCE)


def copied(a: np.ndarray, b: np.ndarray) -> bool:
    return agree(a, b) >= max(INLIERS, SHARE * min(len(a), len(b)))


def agree(a: np.ndarray, b: np.ndarray) -> int:
    """The most matches that one similarity transform from a to b explains."""
    if len(a) < INLIERS or len(b) < INLIERS:
        return 0
    # part by part, as large images have many corners
    step = max(1, 4_000_000 // (len(b) * BITS // 8))
    j, least = [], []
    for at in range(0, len(a), step):
        d = np.bitwise_count(a["bits"][at : at + step, None] ^ b["bits"][None]).sum(2, dtype=int)
        j.append(d.argmin(1))
        least.append(d.min(1))
    j = np.concatenate(j)
    i = np.flatnonzero(np.concatenate(least) <= HAMMING)
    if len(i) < INLIERS:
        return 0
    p, q = a[i], b[j[i]]
    turn, grow = q["angle"] - p["angle"], p["scale"] / q["scale"]
    m = grow * np.exp(1j * turn)
    z, w = p["x"] + 1j * p["y"], q["x"] + 1j * q["y"]
    shift = w - m * z
    near = (np.abs(m[k] * z + shift[k] - w) <= ERROR * max(1, np.abs(m[k])) for k in range(len(i)))
    # distinct places count, not the scales they are seen on
    spots = np.rint(z.real / 4) + 1j * np.rint(z.imag / 4)
    return max(len(set(spots[row])) for row in near)


def class_of(data: bytes | None) -> int | None:
    return int.from_bytes(hashlib.sha256(data).digest()[:8], "little", signed=True) if data else None


def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        images = b.column(1).to_pylist()
        found = [corners(decoded(x)) for x in images]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(k) for k in found], pa.int64()), pa.array([class_of(x) for x in images], pa.int64()), pa.array([k.tobytes() for k in found], pa.binary())], ["id", "n_corners", "cls", "corners"])


def record(b: pa.RecordBatch, kind: np.dtype) -> np.ndarray:
    out = np.zeros(b.num_rows, kind)
    for i, name in enumerate(kind.names):
        out[name] = b.column(i).to_numpy().view(kind[name])
    return out


def columns(x: np.ndarray, names: tuple[str, ...]) -> list[pa.Array]:
    """As signed numbers, the only ones that Spark has."""
    return [pa.array(np.ascontiguousarray(x[n]).view(f"i{x.dtype[n].itemsize}")) for n in names]


def indexed(tables: range):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for cls, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if len(x := pairs_of(np.frombuffer(k, CORNER), cls, tables)):
                    yield pa.RecordBatch.from_arrays(columns(x, PAIR.names), list(PAIR.names))

    return rows


MEETING = {"a": "long", "b": "long", "big": "boolean"} | {name: PAIR_TYPES[name] for name in PAIR.names[2:]}


def meetings(batches: Iterator[pa.RecordBatch], tree: bool = False) -> Iterator[pa.RecordBatch]:
    """From rows of the index sorted by sig: the pairs (a < b) of images that meet, big false, and the rows of large buckets as (sig, cls), big true.

    tree: a row of a small bucket gives only the pair with the first row that it is alike with; where that leaves a pair out, the bucket's rows that are alike with
    others come as rows of large buckets do. No more is held than a batch and the open bucket, of a large one its first row.
    """

    def pairs(x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        p = np.unique(np.sort(np.stack((x["cls"], y["cls"]), 1), axis=1), axis=0)
        none = np.zeros(len(p), PAIR)
        return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(p[:, i])) for i in range(2)), pa.array(np.full(len(p), False)), *columns(none, PAIR.names[2:])], list(MEETING))

    def linked(x: np.ndarray, y: np.ndarray) -> Iterator[pa.RecordBatch]:
        ok = alike(x, y)
        if ok.any():
            yield pairs(x[ok], y[ok])

    def large(x: np.ndarray) -> pa.RecordBatch:
        sig, cls, *rest = columns(x, PAIR.names)
        return pa.RecordBatch.from_arrays([sig, cls, pa.array(np.full(len(x), True)), *rest], list(MEETING))

    def closed(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not len(x):
            return
        start = np.flatnonzero(np.append(True, x["sig"][1:] != x["sig"][:-1]))
        size = np.diff(np.append(start, len(x)))
        of = np.repeat(size, size)
        if (big := of > LARGE).any():
            yield large(x[big])
            yield from linked(x[np.repeat(start, size)][big], x[big])
        x = x[~big]
        # of each row how far before it the first row lies that it is alike with, how many such there are, and whether it is alike with any
        far, before, met = np.zeros(len(x), int), np.zeros(len(x), int), np.full(len(x), False)
        for d in range(1, min(LARGE, len(x))):
            same = np.flatnonzero(x["sig"][d:] == x["sig"][:-d])
            if not len(same):
                break
            if tree:
                at = same[alike(x[same], x[same + d])]
                far[at + d], met[at], met[at + d] = d, True, True
                before[at + d] += 1
            else:
                yield from linked(x[same], x[same + d])
        if len(at := np.flatnonzero(before)):
            yield pairs(x[at - far[at]], x[at])
            if len(left := x[met & np.isin(x["sig"], x["sig"][before > 1])]):
                yield large(left)

    first, rest = None, np.zeros(0, PAIR)
    for b in batches:
        x = np.concatenate((rest, record(b, PAIR)))
        if first is not None:
            n = np.searchsorted(x["sig"], first["sig"][0], "right")
            if n:
                yield large(x[:n])
                yield from linked(np.repeat(first, n), x[:n])
            x = x[n:]
        rest = x[:0]
        if not len(x):
            continue
        tail = np.searchsorted(x["sig"], x["sig"][-1])
        yield from closed(x[:tail])
        first, rest = None, x[tail:]
        if len(rest) > LARGE:
            yield from closed(rest)
            first, rest = rest[:1].copy(), x[:0]
    yield from closed(rest)


def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, ku, kv) to the linked pairs."""
    for b in batches:
        ok = pa.array([copied(np.frombuffer(x, CORNER), np.frombuffer(y, CORNER)) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)], pa.bool_())
        yield pa.RecordBatch.from_arrays([b.column(0).filter(ok), b.column(1).filter(ok)], ["u", "v"])


#: A row of a large bucket with the component of its image.
PLACED = np.dtype([*PAIR.descr, ("comp", "<i8")])


def crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows PLACED sorted by sig: the pairs of images of different components that meet, each once a bucket and image."""

    def compare(x: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(len(x) - 1):
            y = x[i + 1 :]
            y = y[y["comp"] != x["comp"][i]]
            if len(y) and len(at := np.unique(y["cls"][alike(np.repeat(x[i : i + 1], len(y)), y)])):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(at, x["cls"][i])), pa.array(np.maximum(at, x["cls"][i]))], ["a", "b"])

    parts: list[np.ndarray] = []
    for b in batches:
        x = record(b, PLACED)
        for part in np.split(x, np.flatnonzero(x["sig"][1:] != x["sig"][:-1]) + 1):
            if parts and len(part) and part["sig"][0] != parts[0]["sig"][0]:
                yield from compare(np.concatenate(parts))
                parts = []
            if len(part):
                parts.append(part)
    if parts:
        yield from compare(np.concatenate(parts))


def copies(images: DataFrame) -> DataFrame:
    """(id, image) to id, n_corners and component_id, the smallest id among the image's copies, direct or over others."""
    images = images.select("id", "image")
    rows = saved(images.mapInArrow(described, f"id {dict(images.dtypes)['id']}, n_corners long, cls long, corners binary"))
    reps = saved(rows.filter("id is not null and cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.first("corners").alias("corners")))
    passes, one = [], reps.select("cls", "corners")
    typed = lambda types: ", ".join(f"{name} {kind}" for name, kind in types.items())
    for n in range(PASSES):
        index = one.mapInArrow(indexed(range(n * TABLES // PASSES, (n + 1) * TABLES // PASSES)), typed(PAIR_TYPES))
        # the first of a bucket is the least class, so copies meet the same few
        passes.append(saved(index.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(partial(meetings, tree=True), typed(MEETING))))
        freed(reps.sparkSession)
    found = reduce(DataFrame.unionByName, passes)

    def tested(pairs: DataFrame) -> DataFrame:
        both = pairs.join(one.toDF("a", "ka"), "a").join(one.toDF("b", "kb"), "b").select("a", "b", "ka", "kb")
        return both.mapInArrow(compared, "u long, v long")

    tried = saved(found.filter("not big").select("a", "b").distinct())
    groups = all_links(tested, tried)
    large = found.filter("big").select(F.col("a").alias("sig"), F.col("b").alias("cls"), *PAIR.names[2:])
    placed = saved(large.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select(*PAIR.names, F.coalesce("component", "cls").alias("comp")))
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("sig")
    more = placed.join(mixed, "sig", "left_semi").select(*PLACED.names).repartition("sig").sortWithinPartitions("sig").mapInArrow(crossing, "a long, b long").distinct()
    more = saved(more.join(tried, ["a", "b"], "left_anti"))
    forget(*passes, placed)
    groups = all_links(tested, more, groups)
    least = groups.withColumnRenamed("node", "cls").join(reps.select("cls", "rep"), "cls")
    of_class = least.join(least.groupBy("component").agg(F.min("rep").alias("first")), "component").select("cls", "first")
    out = rows.select("id", "n_corners", "cls").join(reps.select("cls", "rep"), "cls", "left").join(of_class, "cls", "left")
    return out.select("id", "n_corners", F.when(F.col("id").isNotNull(), F.coalesce("first", "rep", "id")).alias("component_id"))


SIDE = 48


@lru_cache(maxsize=4)
def waves(n: int) -> np.ndarray:
    """n plane waves over the picture."""
    rng = np.random.default_rng(3)
    x = np.arange(SIDE) / SIDE * 2 * np.pi
    f, phase = rng.uniform(1, 7, (n, 2)) * rng.choice([-1, 1], (n, 2)), rng.uniform(0, 2 * np.pi, n)
    return np.cos(f[:, 0, None, None] * x[None, :, None] + f[:, 1, None, None] * x[None, None] + phase[:, None, None])


def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, embedding) to (id, image): the vector as the amplitudes of plane waves, as PGM."""
    for b in batches:
        out = []
        for v in b.column(1).to_pylist():
            if not v or any(x is None for x in v):
                out.append(None)
                continue
            a = np.tensordot(np.array(v), waves(len(v)), 1)
            spread = a.std() or 1.0
            out.append(b"P5 %d %d 255\n" % (SIDE, SIDE) + np.clip(128 + 48 * a / spread, 0, 255).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["id", "image"])


def op9_media(spark, sf_dir: str) -> DataFrame:
    """vec_id, n_corners and component_id of every row of embeddings, drawn as pictures, as no table holds images."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    images = vectors.mapInArrow(drawn, "id long, image binary")
    return copies(images).withColumnRenamed("id", "vec_id")
