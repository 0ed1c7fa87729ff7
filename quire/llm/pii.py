"""PII: fixed patterns plus information-theoretic sanitisation.

Protected entities are the values that the patterns find. A term (a word of 3 letters or more, as written) reveals an entity e
as far as pointwise mutual information says: PMI(t; e) = log p(t, e) / (p(t) p(e)), with probabilities counted exactly over
all rows: n_term rows hold the word, n_entity the entity, n both (the word outside the pattern matches). Joint
counts are lowered by DISCOUNT. A term whose PMI reaches ALPHA of the information content -log p(e) discloses e, if chance doesn't explain that
they meet: with T words beside entities and E entities, T * E * P(X >= k) may be CHANCE at most, X Poisson with the mean n_term * n_entity / N
that independence gives, k the contexts in which they meet. So fewer than CHANCE pairs of the whole corpus are expected to pass by chance,
at every size, and what meets in one context only says nothing. Contexts are told apart by the smallest hash of their words,
as near copies (Jaccard similarity s) share it with probability s and count as one then. Disclosing terms are added as kind term wherever they
occur outside pattern matches: removed if PMI reaches REMOVE of it, else generalised.

Scans: the texts with entities give their words; every text adds to a count of these words, one row a word and task; disclosing words
are looked up in every text. Words reach the tasks as a Bloom filter of fixed size, which passes all of them and few others, and a join
settles what it passes; so neither scan depends on how many there are. Entities that occur in the same rows are counted as one, so a text with a long list of them gives each word once.

Offsets are code points, end exclusive. A null text counts as empty: no spans. Every row gives a row, repeated or not, with or
without doc_id, as no step joins on doc_id; other columns are passed on under their names. Runs are scanned in linear
time, also in very long texts. An empty table gives no rows. A term that reveals two entities counts with the larger share.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forget, fresh, saved, table
from .jaccard import mix

KINDS = ["email", "ip", "card", "phone", "term"]
DISCOUNT, ALPHA, REMOVE = 0.5, 0.8, 0.97
#: Pairs of a word and an entity that may pass by chance, in expectation.
CHANCE = 0.05
#: Contexts in which a pair must meet, however small the corpus; what meets once is no estimate.
CONTEXTS = 2
#: Words counted in a task before they are handed on; log2 of the bits of a filter.
COUNTED, BITS = 100_000, 26

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits begins, and takes whole runs.
IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
WORD = re.compile(r"[^\W\d_]{3,}")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every @ with local part and domain; the local part is the run before it, back to the last match."""
    free, at = 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = at - (len(before) - len(before.rstrip(LOCAL)))
        free = at + 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
        at = text.find("@", free)


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if "." in text:
        out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def entity(kind: int, value: str) -> str:
    return f"{kind}:{re.sub(r'[^0-9]', '', value) if kind >= 2 else value.lower()}"


def outside(spans: list[tuple[int, int, int]]):
    """A test whether a stretch of text overlaps none of the spans."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        i = bisect_right(starts, b - 1) - 1
        return i < 0 or ends[i] <= a

    return free


def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts with entities: (entities, terms outside them), each distinct."""
    for batch in batches:
        found, terms = [], []
        for text in batch.column(0).to_pylist():
            spans = base_spans(text) if text else []
            if spans:
                free = outside(spans)
                found.append(sorted({entity(k, text[a:b]) for k, a, b in spans}))
                terms.append(sorted({m[0] for m in WORD.finditer(text) if free(*m.span())}))
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), pa.array(terms, pa.list_(pa.string()))], ["entities", "terms"])


def bits(words: list[str]) -> np.ndarray:
    """Three places in a filter for each word."""
    x = mix(np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words)) + np.uint64(1))
    top = np.uint64(64 - BITS)
    return np.stack((x >> top, (x << np.uint64(BITS)) >> top, mix(x) >> top), 1).astype(np.int64)


def bloom(terms: DataFrame) -> np.ndarray:
    """A filter of the column term, bytes of 8 bits; at most 2 ** (BITS - 6) words of it reach the driver, however many terms there are."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(bits(b.column(0).to_pylist()))
            mask = np.left_shift(np.int64(1), at % 64)
            yield pa.RecordBatch.from_arrays([pa.array(at // 64), pa.array(mask)], ["slot", "mask"])

    out = np.zeros(1 << (BITS - 6), np.int64)
    got = terms.select("term").mapInArrow(places, "slot long, mask long").groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    out[got.column("slot").to_numpy()] = got.column("mask").to_numpy()
    return out.view(np.uint8)


def passed(words: set[str], filter_bytes: np.ndarray) -> list[str]:
    """Those of the words that the filter has."""
    listed = list(words)
    if not listed:
        return []
    at = bits(listed)
    ok = ((filter_bytes[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)
    return [listed[i] for i in np.flatnonzero(ok)]


def word_counter(filter_bytes: np.ndarray):
    """Arrow function: text to (term, n), rows of the task with that word, of the words that the filter has."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(passed(set(WORD.findall(text)), filter_bytes))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        if seen:
            yield out()

    return count


def disclosing(docs: DataFrame) -> DataFrame:
    """(term, share) of the terms that disclose an entity; share: the largest discounted PMI(t; e) / -log p(e), near 1 if the term occurs only with e."""
    texts = docs.select("text").filter("text is not null")
    held = texts.mapInArrow(contexts, "entities array<string>, terms array<string>").withColumn("rid", F.monotonically_increasing_id())
    # written with its context, which would be worked out anew for every word after the explosion
    held = saved(held.withColumn("context", F.array_min(F.transform("terms", lambda t: F.xxhash64(t)))))
    terms = held.select("rid", F.explode("terms").alias("term"), "context")
    n_texts = float(max(1, texts.count()))
    each = held.select("rid", F.explode("entities").alias("entity"))
    kinds = each.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("rid")).alias("rows"))
    classes = saved(each.join(kinds, "entity").select("rid", "n_entity", "rows").distinct())
    tries = float(max(1, terms.agg(F.count_distinct("term")).first()[0] * classes.select("n_entity", "rows").distinct().count()))
    pairs = terms.join(classes, "rid").groupBy("term", "n_entity", "rows").agg(F.count("*").alias("n"), F.count_distinct("context").alias("k"))
    content = F.log(F.lit(n_texts) / F.col("n_entity"))

    def share(n_term):
        pmi = F.log((F.col("n") - DISCOUNT) * n_texts / (n_term * F.col("n_entity")))
        return F.least(F.lit(1.0), F.when(content > 0, pmi / content).otherwise(0.0))

    def told(n_term):
        """Whether a pair discloses; Chernoff's bound of the Poisson tail stands for the tail."""
        mean = n_term * F.col("n_entity") / n_texts
        tail = F.when(F.col("k") > mean, F.col("k") * (1 + F.log(mean / F.col("k"))) - mean).otherwise(0.0)
        return (share(n_term) >= ALPHA) & (F.col("k") >= CONTEXTS) & (tail + log(tries) <= log(CHANCE))

    # no term occurs in fewer rows than the pair does, so pairs that fail even then need no count
    pairs = saved(pairs.filter(told(F.col("n"))).select("term", "n", "k", "n_entity").distinct())
    counts = texts.mapInArrow(word_counter(bloom(pairs)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n_term"))
    found = saved(pairs.join(counts, "term").filter(told(F.col("n_term"))).groupBy("term").agg(F.max(share(F.col("n_term"))).alias("share")))
    forget(held, classes, pairs)
    return found


ROW = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("remove", pa.bool_())])
HIT = pa.struct([("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])
SPANS, HITS = "array<struct<kind:int,start:int,end:int,remove:boolean>>", "array<struct<term:string,start:int,end:int>>"


def scanner(at: int, filter_bytes: np.ndarray, names: list[str], kept: list[int]):
    """Arrow function: the columns kept, the pattern matches, and the words outside them that the filter has."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, words = [], []
            for text in batch.column(at).to_pylist():
                spans = base_spans(text) if text else []
                base.append([{"kind": k, "start": a, "end": b, "remove": False} for k, a, b in spans])
                some = set(passed(set(WORD.findall(text)), filter_bytes)) if text else set()
                free = outside(spans)
                words.append([{"term": m[0], "start": m.start(), "end": m.end()} for m in WORD.finditer(text) if m[0] in some and free(*m.span())] if some else [])
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), pa.array(base, pa.list_(ROW)), pa.array(words, pa.list_(HIT))], [*(batch.schema.names[i] for i in kept), *names])

    return scan


def private_spans(docs: DataFrame, names: tuple[str, str] = ("base", "spans"), keep_text: bool = True) -> DataFrame:
    """docs (without text, if not kept) with the pattern matches and all spans (kind, start, end, remove), by kind and start, in two columns of those names."""
    terms = disclosing(docs)
    kept = [i for i, c in enumerate(docs.columns) if keep_text or c != "text"]
    base, hits, rid = fresh(docs, names[0], "hits", "rid")
    schema = T.StructType([docs.schema.fields[i] for i in kept])
    for name, kind in ((base, SPANS), (hits, HITS)):
        schema = schema.add(name, T.StructType.fromDDL(f"x {kind}")[0].dataType)
    rows = docs.mapInArrow(scanner(docs.columns.index("text"), bloom(terms), [base, hits], kept), schema)
    rows = saved(rows.withColumn(rid, F.monotonically_increasing_id()))
    found = rows.filter(F.size(hits) > 0).select(F.col(rid).alias("rid"), F.explode(hits).alias("x")).select("rid", "x.*").join(terms, "term")
    span = F.struct(F.lit(KINDS.index("term")).alias("kind"), "start", "end", (F.col("share") >= REMOVE).alias("remove"))
    added = found.groupBy("rid").agg(F.array_sort(F.collect_list(span)).alias(hits)).withColumnRenamed("rid", rid)
    out = rows.drop(hits).join(added, rid, "left")
    both = F.when(F.col(hits).isNull(), F.col(base)).otherwise(F.concat(base, hits))
    return out.select(*[docs.columns[i] for i in kept], F.col(base).alias(names[0]), both.alias(names[1]))


def sanitised(text: str | None, spans: list) -> str | None:
    """text with entities and generalised terms replaced by their kind, removed terms gone."""
    if not text:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], "" if s["remove"] else f"[{KINDS[s['kind']].upper()}]"]
            at = s["end"]
        elif s["end"] > at:  # overlapping spans of two kinds
            at = s["end"]
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with text sanitised, row by row: entities and generalised terms give way to their kind, removed terms to nothing."""
    names = tuple(fresh(docs, "base", "spans"))
    spans = private_spans(docs, names).drop(names[0])
    at, wide = docs.columns.index("text"), len(docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = pa.array([sanitised(t, s) for t, s in zip(b.column(at).to_pylist(), b.column(wide).to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else b.column(k) for k in range(wide)], b.schema.names[:wide])

    return spans.mapInArrow(clean, docs.schema)


def written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op1_pii(spark, sf_dir: str) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    found = private_spans(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
    return found.select("doc_id", *[n(i).alias(f"n_{KINDS[i]}") for i in range(4)], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
