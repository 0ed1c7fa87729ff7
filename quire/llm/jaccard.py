"""N-gram Jaccard join by universe partition and the pigeonhole principle.

A document's set holds hashes of its distinct 5-word shingles (all words as one shingle if it has fewer). Sets
link when 100 * intersection >= 75 * union. Linked sets of sizes a and b differ in at most (a + b) / 7 tokens and
in size by a factor of 4/3, so each set is indexed in its size band and, as the smaller one, in the next. A band
hashes the tokens into segments and indexes, whichever of these costs least for its sizes:

* exact: every non-empty segment; as each of D differences spoils one segment, more than D segments share one, and the first
  D + 1 signatures by hash value are enough. A set whose tokens leave too many segments empty for that is also
  indexed by deletion, in about half as many segments; both counts are weighed against each other;
* subset: every union of all but D segments;
* deletion: every segment and all its neighbours with one token less, as two differences are needed to spoil one.

Sets that neither argument covers also enter an index of such sets, by token prefix. Candidates are thinned by the
distance of histograms, a lower bound of the difference, and verified exactly on the sets. In buckets of more than PAIRS
sets, only links to the first are tried at first; once components are known, the members left in buckets of several components
meet block by block, and only links that join components leave a block, so no link between components is lost and no pairs are
written.

Equal sets are one class (64-bit sum of token hashes); copies never meet as pairs. Words are maximal runs without 0x20 and
0x09-0x0D, with A-Z lower-cased. Null, empty and blank texts have an empty set and link with nothing; rows without
doc_id have n_shingles but no links and component null; rows that repeat a doc_id are one document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import comb, erfc, exp, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, freed, fresh, saved, small, table
from .components import components

WORDS, PERCENT = 5, 75
EDGES = [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, *(2**k for k in range(6, 60))]
#: Largest bucket whose pairs are all tried at once; members a pivot meets in one task.
PAIRS, CHUNK, BINS, WIDE = 8, 256, 64, 1024
#: Members of a bucket that one task compares with as many others; tokens per matrix product.
BLOCK, COLUMNS = 512, 4096
#: Rows asked for in a verification that are broadcast; beyond them it shuffles.
ASKED = 100_000
M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
GOLDEN = np.uint64(0x9E3779B97F4A7C15)
#: Of signatures that stand for single tokens.
TOKEN_SALT = np.uint64(0x5851F42D4C957F2D)
S30, S27, S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection."""
    x = (x ^ (x >> S30)) * M1
    x = (x ^ (x >> S27)) * M2
    return x ^ (x >> S31)


#: Bytes that words consist of; bytes from which on a word is long.
SOLID = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
LONG = 64
#: A random number for each byte at each place of a short word (LONG rows of 256), alike for A-Z and a-z, 0 for blanks.
BYTE_VALUES = mix((np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint64) + np.arange(1, 1 + LONG, dtype=np.uint64)[:, None] * np.uint64(256)) * GOLDEN) * SOLID
#: Of the words of a shingle.
PLACES = mix(np.arange(1, 1 + WORDS, dtype=np.uint64)) | np.uint64(1)


def unique(x: np.ndarray) -> np.ndarray:
    """x sorted in place, without repeats."""
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def word_hashes(a: np.ndarray) -> np.ndarray:
    """A hash of every word of UTF-8 bytes, in order: a sum over bytes by their places, of long words a digest.

    The numbers of two places have no relation, unlike powers of a base, whose sums agree for words built to that end.
    """
    solid = np.concatenate(([False], SOLID[a], [False]))
    edges = np.flatnonzero(solid[1:] != solid[:-1])
    begins, ends = edges[::2], edges[1::2]
    if not len(begins):
        return np.zeros(0, np.uint64)
    lengths = ends - begins
    place = np.arange(begins[0], len(a))
    place -= np.repeat(begins, np.diff(begins, append=len(a)))
    np.minimum(place, LONG - 1, out=place)
    place <<= 8
    place |= a[begins[0] :]
    out = mix(np.add.reduceat(BYTE_VALUES.take(place), begins - begins[0]))
    for i in np.flatnonzero(lengths > LONG):
        out[i] = int.from_bytes(blake2b(a[begins[i] : ends[i]].tobytes().lower(), digest_size=8).digest(), "little")
    return out


def tokens(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    if not text:
        return np.zeros(0, np.uint64)
    a = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words = word_hashes(a)
    if not len(words):
        return words
    k = min(WORDS, len(words))
    h = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        h += words[i : len(words) - k + 1 + i] * PLACES[i]
    return unique(mix(h))


def class_of(t: np.ndarray) -> int:
    return int(np.array([mix(t + GOLDEN).sum() + np.uint64(len(t))], np.uint64).view(np.int64)[0])


def histogram(t: np.ndarray) -> bytes:
    """Counts of the tokens by their leading bits, up to 255, in about as many bins as there are tokens (BINS to WIDE)."""
    bins = min(WIDE, max(BINS, 1 << len(t).bit_length()))
    return np.minimum(np.bincount((t // np.uint64((1 << 64) // bins)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


def stacked(hists: list[bytes], bins: int) -> np.ndarray:
    """As rows of so many bins. Counts cut off at 255 and added up still differ by no more than the sets do."""
    return np.stack([np.frombuffer(h, np.uint8).reshape(bins, -1).sum(1, dtype=np.int16) for h in hists])


def band_of(n: int) -> int:
    return int(np.searchsorted(EDGES, n, "right")) - 1


def most_apart(n: int, p: int) -> int:
    """The most tokens in which a set of n can differ from a linked one, as both are indexed in band p."""
    return (n + min(EDGES[p + 1] - 1, 100 * n // PERCENT)) // 7


def too_few(n: int, m: int, least: int) -> float:
    """Probability that n random tokens fill fewer than `least` of m segments, by the normal approximation."""
    x = n / m
    mean, sd = m * (1 - exp(-x)), sqrt(max(1e-9, m * (exp(-x) - (1 + x) * exp(-2 * x))))
    return 0.5 * erfc((mean - least + 0.5) / sd / sqrt(2))


@lru_cache(maxsize=None)
def allocation(p: int) -> tuple[str, int, int, int]:
    """(family, segments, differences allowed for, segments of the deletion index) of band p, by the least cost per set.

    The cost is the number of signatures, each dearer the fewer tokens it stands on, as such buckets hold sets that don't link.
    """
    n = EDGES[p + 1] - 1
    d = most_apart(n, p)
    dear = lambda signatures, t: signatures * (1 + 8 * exp(-t))
    halves = d // 2 + 2
    by_deletion = dear(n + halves, n / halves)
    options = []
    m = d + 1
    while True:
        options.append((dear(d + 1, n / m) + too_few(n, m, d + 1) * by_deletion, "exact", m))
        if m >= 4 * n:
            break
        m += max(1, m // 50)
    options.append((by_deletion, "deletion", halves))
    if 0 < d <= 4:
        for s in range(d + 2, d + 5):
            options.append((dear(comb(s, d), n * (s - d) / s), "subset", s))
    _, family, m = min(options)
    return family, m, d, halves


def segments(t: np.ndarray, salt: np.uint64, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens hashed and sorted, where segments begin among them, their sums and numbers."""
    hashed = np.sort(mix(t ^ salt))
    segment = ((hashed >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], segment[1:] != segment[:-1])))
    return hashed, first, np.add.reduceat(hashed, first), segment[first]


def neighbours(t: np.ndarray, salt: np.uint64, m: int, apart: int) -> tuple[np.ndarray, bool]:
    """Signatures of the segments and of each with one token less; whether more than `apart` differences are needed to spoil all.

    A segment of one token is spoilt by one difference, a larger one by two.
    """
    hashed, first, sums, ids = segments(t, salt, m)
    sizes = np.diff(np.append(first, len(t)))
    places = mix(ids + salt)
    less = np.repeat(sums, sizes) - hashed
    found = np.concatenate((mix(sums + places), mix(less + np.repeat(places, sizes))[np.repeat(sizes, sizes) > 1]))
    return found, int(np.minimum(sizes, 2).sum()) > apart


def signatures(t: np.ndarray) -> np.ndarray:
    """The index entries of a set."""
    n = len(t)
    own = band_of(n)
    out, unlucky = [], False
    for p in (own, own + 1):
        if p > own and 100 * n // PERCENT < EDGES[p]:
            continue
        family, m, d, halves = allocation(p)
        salt, other = mix(np.array([p * 4 + 1, p * 4 + 2], np.uint64))
        apart = most_apart(n, p)
        if family == "deletion":
            found, sure = neighbours(t, other, halves, apart)
            unlucky |= not sure
        else:
            _, first, sums, ids = segments(t, salt, m)
            if family == "exact":
                found = np.sort(mix(sums + mix(ids + salt)))[: apart + 1]
                enough = len(first) > apart
            else:
                full = np.zeros(m, np.uint64)
                full[ids.astype(np.int64)] = sums
                chosen = np.array(list(combinations(range(m), m - d)))
                found = mix(full[chosen].sum(1) + mix(np.arange(len(chosen), dtype=np.uint64) + salt))[full[chosen].any(1)]
                enough = len(first) > d
            if not enough:
                more, sure = neighbours(t, other, halves, apart)
                found = np.concatenate((found, more))
                unlucky |= not sure
        out.append(found)
    if unlucky:
        out.append(mix(t[: n - (PERCENT * n + 99) // 100 + 1] + TOKEN_SALT))
    return unique(np.concatenate(out))


def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sizes, classes, hists = [], [], []
        # one text and its tokens at a time
        for text in b.column(1):
            t = tokens(text.as_py())
            sizes.append(len(t))
            classes.append(class_of(t) if len(t) else None)
            hists.append(histogram(t) if len(t) else None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), pa.array(hists, pa.binary())], ["doc_id", "n", "cls", "hist"])


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        sigs, classes, held = [], [], 0
        for text in b.column(0):
            t = tokens(text.as_py())
            if len(t):
                s = signatures(t)
                sigs.append(s)
                classes.append(np.full(len(s), class_of(t), np.int64))
                held += len(s)
            if held > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(classes))], ["sig", "cls"])
                sigs, classes, held = [], [], 0
        if sigs:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view(np.int64)), pa.array(np.concatenate(classes))], ["sig", "cls"])


def bucket_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by (sig, cls): candidate pairs (a < b), and the rows of large buckets as (sig, cls, big).

    Only the start of the bucket at hand and a bounded number of pairs are held.
    """
    pairs: list[np.ndarray] = []
    held = 0
    sig, members, count = None, [], 0  # the open bucket: its first members, how many it has

    def flush(big: list) -> Iterator[pa.RecordBatch]:
        nonlocal pairs, held
        if pairs:
            p = np.unique(np.concatenate(pairs), axis=0)
            pairs, held = [], 0
            yield out(p[:, 0], p[:, 1], False)
        if big:
            g = np.concatenate(big)
            yield out(g[:, 0], g[:, 1], True)

    def out(a: np.ndarray, b: np.ndarray, big: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), big))], ["a", "b", "big"])

    rest: np.ndarray | None = None
    for batch in batches:
        s, c = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        big: list[np.ndarray] = []
        if rest is not None:
            s, c = np.concatenate((rest[0], s)), np.concatenate((rest[1], c))
            rest = None
        if not len(s):
            continue
        keep = np.concatenate(([True], (s[1:] != s[:-1]) | (c[1:] != c[:-1])))
        s, c = s[keep], c[keep]
        start = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        sizes = np.diff(np.append(start, len(s)))
        # the last bucket goes on in the next batch, unless it is large already and is streamed
        tail = start[-1]
        if sig is not None and s[0] == sig:
            # the open large bucket goes on: links to its first member, rows passed on
            m = c[: sizes[0]]
            m = m[m != members[-1]]
            if len(m):
                pairs.append(np.stack((np.full(len(m), members[0]), m), 1))
                held += len(m)
                big.append(np.stack((np.full(len(m), sig), m), 1))
                members = [members[0], m[-1]]
            if len(start) == 1:
                if held > 500_000:
                    yield from flush(big)
                elif big:
                    yield from flush_big(big, out)
                continue
            start, sizes = start[1:], sizes[1:]
        sig = None
        if sizes[-1] > 10_000:
            m = c[tail:]
            sig, members = s[tail], [m[0], m[-1]]
            pairs.append(np.stack((np.full(len(m) - 1, m[0]), m[1:]), 1))
            held += len(m)
            big.append(np.stack((np.full(len(m), sig), m), 1))
        else:
            rest = np.stack((s[tail:], c[tail:]))
        start, sizes = start[:-1], sizes[:-1]
        got = closed(s, c, start, sizes, big)
        pairs += got
        held += sum(map(len, got))
        if held > 500_000:
            yield from flush(big)
        elif big:
            yield from flush_big(big, out)
    big = []
    if rest is not None:
        pairs += closed(rest[0], rest[1], np.array([0]), np.array([rest.shape[1]]), big)
    yield from flush(big)


def flush_big(big: list[np.ndarray], out) -> Iterator[pa.RecordBatch]:
    g = np.concatenate(big)
    yield out(g[:, 0], g[:, 1], True)


def closed(s: np.ndarray, c: np.ndarray, start: np.ndarray, sizes: np.ndarray, big: list[np.ndarray]) -> list[np.ndarray]:
    """Pairs of the complete buckets; rows of the large ones are added to big."""
    pairs = []
    for k in range(2, PAIRS + 1):
        at = start[sizes == k]
        if len(at):
            pairs += [np.stack((c[at + i], c[at + j]), 1) for i in range(k) for j in range(i + 1, k)]
    for at, k in zip(start[sizes > PAIRS], sizes[sizes > PAIRS], strict=True):
        m = c[at : at + k]
        pairs.append(np.stack((np.full(k - 1, m[0]), m[1:]), 1))
        big.append(np.stack((np.full(k, s[at]), m), 1))
    return pairs


def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, na, nb, ha, hb) to the pairs that sizes and histograms allow."""
    for b in batches:
        na, nb = b.column(2).to_numpy(), b.column(3).to_numpy()
        ok = 100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb)
        ha, hb = b.column(4), b.column(5)
        bins = np.minimum(pc.binary_length(ha).to_numpy(), pc.binary_length(hb).to_numpy())
        for width in np.unique(bins):
            rows = np.flatnonzero(ok & (bins == width))
            for at in np.array_split(rows, len(rows) // 2000 + 1):
                if len(at):
                    x, y = stacked(ha.take(pa.array(at)).to_pylist(), width), stacked(hb.take(pa.array(at)).to_pylist(), width)
                    ok[at] = np.abs(x - y).sum(1) <= (na[at] + nb[at]) // 7
        yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(ok)), b.column(1).filter(pa.array(ok))], ["a", "b"])


def runs_of(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows that follow each other with equal first columns: (their values, the rest of each row)."""
    key, held = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:keys] != key:
                if held:
                    yield key, held
                key, held = row[:keys], []
            held.append(row[keys:])
    if held:
        yield key, held


def joins(near: list[np.ndarray], label: np.ndarray) -> list[tuple[int, int]]:
    """Of the pairs (i, j in near[i]) so many as connect what all of them connect; label, changed in place, names the parts at first."""
    out = []
    for i, at in enumerate(near):
        at = at[label[at] != label[i]]
        others, first = np.unique(label[at], return_index=True)
        for c, j in zip(others, at[first], strict=True):
            out.append((i, int(j)))
            label[label == c] = label[i]
    return out


def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (sig, lo, hi, part, cls, comp, n, hist), block by block: edges (u, v) that connect all members
    which sizes and histograms let link across components, fewer than the rows that came in.

    Each set meets those up to a third larger, first by few bins, then by all.
    """
    for key, held in runs_of(batches, 3):
        held.sort(key=lambda x: x[3])
        part, cls, comp, n = (np.array([x[i] for x in held], np.int64) for i in range(4))
        if (comp == comp[0]).all():
            continue
        apart = key[1] != key[2]
        hists = [x[4] for x in held]
        coarse, fine = stacked(hists, BINS), stacked(hists, min(map(len, hists)))
        ends = np.searchsorted(n, 100 * n // PERCENT, "right")
        near = []
        for i in range(len(held)):
            other = comp[i + 1 : ends[i]] != comp[i]
            if apart:
                other &= part[i + 1 : ends[i]] != part[i]
            at = np.flatnonzero(other) + i + 1
            for h in (coarse, fine):
                if len(at):
                    at = at[np.abs(h[at] - h[i]).sum(1) <= (n[at] + n[i]) // 7]
            near.append(at)
        found = np.array(joins(near, np.arange(len(held))), np.int64).reshape(-1, 2)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(cls[found[:, 0]]), pa.array(cls[found[:, 1]])], ["u", "v"])


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs, by products over the tokens that occur twice, COLUMNS at a time."""
    rows = np.repeat(np.arange(len(sets)), [len(t) for t in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times[column] > 1
    rows, column = rows[often], column[often]
    column = np.unique(column, return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [at, at + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[rows[lo:hi], column[lo:hi] - at] = 1
        out += m @ m.T
    return out


def settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (sig, lo, hi, part, cls, comp, tokens), block by block: links between components, no more than join them."""
    for key, held in runs_of(batches, 3):
        part, cls, comp = (np.array([x[i] for x in held], np.int64) for i in range(3))
        if len(held) < 2 or (comp == comp[0]).all():
            continue
        sets = [np.frombuffer(x[3], np.uint64) for x in held]
        n = np.array([len(t) for t in sets])
        both = overlaps(sets)
        link = 100 * both >= PERCENT * (n[:, None] + n[None] - both)
        if key[1] != key[2]:
            link &= part[:, None] != part[None]
        found = np.array(joins([np.flatnonzero(row) for row in link], comp.copy()), np.int64).reshape(-1, 2)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(cls[found[:, 0]]), pa.array(cls[found[:, 1]])], ["u", "v"])


def token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cls, text) to (cls, tokens); other texts of the doc_id asked for are left out."""
    for b in batches:
        found = [(c, t) for c, t in zip(b.column(0).to_pylist(), map(tokens, b.column(1).to_pylist()), strict=True) if len(t) and class_of(t) == c]
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([t.tobytes() for _, t in found], pa.binary())], ["cls", "tokens"])


def blocked(rows: DataFrame) -> DataFrame:
    """Rows (sig, cls, ..) dealt so that any two of a sig meet: a sig of m rows is cut into m / BLOCK parts, and each two parts are a block (sig, lo, hi)."""
    parts = rows.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts"))
    dealt = rows.join(parts, "sig").withColumn("part", F.pmod(F.xxhash64("cls", "sig"), F.col("parts")).cast("long"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1)))
    return met.withColumn("lo", F.least("part", "with")).withColumn("hi", F.greatest("part", "with")).drop("with", "parts")


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.select("sig", "lo", "hi", "part", *columns).repartition("sig", "lo", "hi").sortWithinPartitions("sig", "lo", "hi")


def left_over(docs: DataFrame, reps: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (u, v) between components among the rows (sig, cls, comp) of large buckets, so many that no link is missed.

    Members of a bucket meet by histogram, block by block, and what may link is joined into groups over all buckets; the sets of a group
    then meet, once each and a block, however many buckets they shared. What leaves a task are edges of forests, never pairs.
    """
    mixed = placed.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("sig")
    rows = blocked(placed.join(mixed, "sig", "left_semi")).join(reps.select("cls", "n", "hist"), "cls")
    groups = saved(components(dealt(rows, "cls", "comp", "n", "hist").mapInArrow(suspects, "u long, v long").distinct()))
    members = groups.select(F.col("component").alias("sig"), F.col("node").alias("cls")).join(placed.select("cls", "comp").distinct(), "cls")
    asked = groups.select(F.col("node").alias("cls")).join(reps.select("cls", "rep"), "cls").select("cls", F.col("rep").alias("doc_id"))
    sets = docs.join(small(asked), "doc_id").select("cls", "text").mapInArrow(token_rows, "cls long, tokens binary").dropDuplicates(["cls"])
    return dealt(blocked(members).join(saved(sets), "cls"), "cls", "comp", "tokens").mapInArrow(settled, "u long, v long")


def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (pivot, chunk, member, cls, text), each pivot before its members: the linked pairs."""
    pivot, own = None, np.zeros(0, np.uint64)
    for b in batches:
        u, v = [], []
        for p, _, member, cls, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            t = tokens(text)
            if not len(t) or class_of(t) != cls:  # another row with the doc_id asked for
                continue
            if not member:
                pivot, own = p, t
            elif p == pivot:
                both = len(np.intersect1d(own, t, assume_unique=True))
                if 100 * both >= PERCENT * (len(own) + len(t) - both):
                    u.append(p)
                    v.append(cls)
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def verify(docs: DataFrame, reps: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (a, b) of classes whose sets link. Each set travels once per pivot and CHUNK members."""
    size = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    dealt = pairs.join(size, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("chunks")).cast("int").alias("chunk"))
    asked = dealt.select(F.col("a").alias("pivot"), "chunk", F.lit(True).alias("member"), F.col("b").alias("cls")).unionByName(dealt.select(F.col("a").alias("pivot"), "chunk", F.lit(False).alias("member"), F.col("a").alias("cls")).distinct())
    asked = saved(asked.join(reps.select("cls", "rep"), "cls").select(F.col("rep").alias("doc_id"), "pivot", "chunk", "member", F.col("cls").alias("asked")))
    # one row per text asked for, so that a text passes the join once
    lists = asked.groupBy("doc_id", "asked").agg(F.collect_list(F.struct("pivot", "chunk", "member")).alias("to"))
    lists = F.broadcast(lists) if asked.limit(ASKED + 1).count() <= ASKED else lists
    texts = docs.select("doc_id", "text").join(lists, "doc_id").select("text", F.explode("to").alias("x"), F.col("asked").alias("cls")).select("x.pivot", "x.chunk", "x.member", "cls", "text")
    return texts.repartition("pivot", "chunk").sortWithinPartitions("pivot", "chunk", "member").mapInArrow(verified, "u long, v long").distinct()


def all_links(check, pairs: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """Components (node, component) once every pair (a, b) is verified by check() or lies within a component.

    At first each class meets only the least of its candidates, which joins most groups of copies by a tree; what is left
    between components then follows. Components found before, as groups, count as links.
    """
    for last in (False, True):
        todo = pairs
        if groups is not None:
            of = groups.select(F.col("node").alias("x"), F.col("component").alias("c"))
            todo = todo.join(of.toDF("a", "ca"), "a", "left").join(of.toDF("b", "cb"), "b", "left").filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")
        if last:
            todo = todo.join(tested, ["a", "b"], "left_anti")
        tested = saved(todo if last else todo.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        if not tested.limit(1).count():
            break
        links = check(tested)
        if groups is not None:
            links = links.unionByName(groups.select(F.col("node").alias("u"), F.col("component").alias("v")))
        groups = saved(components(links))
        freed(pairs.sparkSession)
    if groups is None:
        groups = saved(components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("false")))
    return groups


def placed(docs: DataFrame) -> DataFrame:
    """doc_id, n, cls, node (the component's least class) and first (its least doc_id) of every row; the last three null without a set or doc_id."""
    docs = docs.select("doc_id", "text")
    kind = dict(docs.dtypes)["doc_id"]
    rows = saved(docs.mapInArrow(narrow, f"doc_id {kind}, n long, cls long, hist binary"))
    reps = rows.filter("doc_id is not null and cls is not null").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("hist").alias("hist"))
    reps = saved(reps)
    index = docs.filter("doc_id is not null").select("text").mapInArrow(index_rows, "sig long, cls long")
    found = saved(index.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(bucket_pairs, "a long, b long, big boolean"))
    freed(docs.sparkSession)

    def checked(pairs: DataFrame) -> DataFrame:
        return verify(docs, reps, pairs)

    def thinned(pairs: DataFrame) -> DataFrame:
        one = reps.select("cls", "n", "hist")
        both = pairs.join(one.toDF("a", "na", "ha"), "a").join(one.toDF("b", "nb", "hb"), "b")
        return both.select("a", "b", "na", "nb", "ha", "hb").mapInArrow(near, "a long, b long")

    tried = saved(thinned(found.filter("not big").select("a", "b").distinct()))
    groups = all_links(checked, tried)
    large = found.filter("big").select(F.col("a").alias("sig"), F.col("b").alias("cls"))
    open_rows = saved(large.join(groups.withColumnRenamed("node", "cls"), "cls", "left").select("sig", "cls", F.coalesce("component", "cls").alias("comp")))
    forget(found, tried)
    links = left_over(docs.filter("doc_id is not null"), reps, open_rows)
    links = saved(links.unionByName(groups.select(F.col("node").alias("u"), F.col("component").alias("v"))))
    forget(open_rows, groups)
    groups = saved(components(links))
    forget(links)
    least = groups.withColumnRenamed("node", "cls").join(reps.select("cls", "rep"), "cls")
    whole = least.groupBy("component").agg(F.min("rep").alias("first"))
    of_class = least.join(whole, "component").select("cls", "component", "first")
    out = rows.select("doc_id", "n", "cls").join(reps.select("cls", "rep"), "cls", "left").join(of_class, "cls", "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "n", "cls", F.when(known, F.coalesce("component", "cls")).alias("node"), F.when(known, F.coalesce("first", "rep")).alias("first"))


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return placed(docs).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("first", "doc_id").alias("component_id"))


def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Appends the class of the text, which comes last, in its stead."""
    for b in batches:
        found = (tokens(t.as_py()) for t in b.column(b.num_columns - 1))
        yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([class_of(t) if len(t) else None for t in found], pa.int64())], [*b.schema.names[:-1], "cls"])


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component, of the smallest doc_id; of rows of that doc_id, of the smallest class, then hash, then at random of equals.

    Rows of a doc_id whose texts don't link are documents of their own here and each stay; so do rows without doc_id, and
    one of the rows of a doc_id without words. Columns of any other names are passed on.
    """
    rows = saved(placed(docs).filter("doc_id is not null").select("doc_id", "cls", "node", "first"))
    mine, times, keep = fresh(docs, "id", "times", "keep")
    # rows that hold the only text of their doc_id are the most, and decided by doc_id alone
    each = saved(rows.groupBy(F.col("doc_id").alias(mine)).agg(F.count("*").alias(times), F.max((F.coalesce("first", "doc_id") == F.col("doc_id")).cast("int")).alias(keep)))
    gone = each.filter(f"`{keep}` = 0").select(mine)
    left = docs.join(small(gone), F.col("doc_id") == F.col(mine), "left_anti")
    many = each.filter(f"`{keep}` = 1 and `{times}` > 1").select(mine)
    if not many.limit(1).count():
        return left
    once = left.join(small(many), F.col("doc_id") == F.col(mine), "left_anti")
    twice = left.join(small(many), F.col("doc_id") == F.col(mine), "left_semi")
    names = [f"c{i}" for i in range(len(docs.columns))]
    held = twice.select("doc_id", F.struct(*[F.col(f"`{c}`").alias(k) for c, k in zip(docs.columns, names, strict=True)]).alias("row"), F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in docs.columns]).alias("hash"), "text")
    held = held.mapInArrow(classes, held.drop("text").schema.add("cls", "long"))
    of = rows.join(small(many), F.col("doc_id") == F.col(mine), "left_semi").filter("cls is not null").select(F.col("doc_id").alias("d"), F.col("cls").alias("c"), "node", "first").distinct()
    held = held.join(of, (F.col("doc_id") == F.col("d")) & F.col("cls").eqNullSafe(F.col("c")), "left").filter("coalesce(first, doc_id) = doc_id")
    w = Window.partitionBy("doc_id", "node").orderBy("cls", "hash")
    chosen = held.withColumn("k", F.row_number().over(w)).filter("k = 1").select(*[F.col(f"row.{k}").alias(c) for c, k in zip(docs.columns, names, strict=True)])
    return once.unionByName(chosen)


def op5_jaccard(spark, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
