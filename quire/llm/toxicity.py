"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its runs of 3 to 5 characters, ends marked; their embeddings are averaged and a linear softmax
gives its probability of being toxic. A document is as toxic as its worst word, however long it is: its score is the softmax
of that word's average. Embeddings and softmax are trained together in numpy, in two parts. First words: as only documents are
labelled, the words of toxic documents count as toxic as far as the last round found them to be, those of other documents
never do. Then documents: the worst word of each, as the last round has it, is trained on the document's label, with
the weights that labels have outside the sample, so the softmax is that of documents.
An unseen misspelling shares runs, and so vectors, with the word it comes from.

Learned from at most about SAMPLE toxic and CLEAN_SAMPLE other rows, of those whose crc32(doc_id) mod 4 is not 2, chosen by a hash of
doc_id. Texts without words get the score of log-odds FLOOR, and every text 0 where the labels lack one of both values. Rows that
repeat give rows each; a null doc_id is not held out and not learned from; a null label is none, and of several labels of a
doc_id the larger counts. An empty table gives no rows; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .codes import class_table, gram_hashes, spaced
from .common import table
from .language import HELD_OUT, remainder

BITS, DIMS, SAMPLE, CLEAN_SAMPLE, THRESHOLD = 17, 8, 1500, 3000, 0.3
GRAMS = (3, 4, 5)
#: Log-odds of a text without words.
FLOOR = -12.0


def word_grams(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(bucket, number of the word) of every subword, and the number of words."""
    a = spaced(text, digits=True)
    gap = a == 32
    if len(a) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    word = np.cumsum(gap) - 1  # a gap belongs to the word it precedes
    ids, of = [], []
    for n in GRAMS:
        if len(a) < n:
            continue
        h = (gram_hashes(a, n) >> np.uint64(64 - BITS)).astype(np.int64)
        inner = np.zeros(len(h), bool)
        for i in range(1, n - 1):
            inner |= gap[i : len(h) + i]
        ids.append(h[~inner])
        of.append(word[: len(h)][~inner])
    return np.concatenate(ids), np.concatenate(of), int(gap.sum()) - 1


def word_scores(text: str, scalar: np.ndarray) -> np.ndarray:
    """The log-odds of each word, from the projected embeddings."""
    ids, of, n = word_grams(text)
    if not n:
        return np.zeros(0)
    return np.bincount(of, scalar[ids], n) / np.maximum(1, np.bincount(of, minlength=n))


def train(grams: np.ndarray, of: np.ndarray, n: int, target: np.ndarray, weight: np.ndarray, state: dict | None, epochs: int, rng: np.random.Generator) -> dict:
    """Adagrad on embeddings and softmax together. grams, of: buckets and their words, in order of words."""
    if state is None:
        state = {"e": (rng.standard_normal((1 << BITS, DIMS)) / DIMS).astype(np.float32), "u": (rng.standard_normal((DIMS, 2)) / DIMS).astype(np.float32), "b": np.zeros(2, np.float32)}
    e, u, b = state["e"], state["u"], state["b"]
    ge, gu = np.full(1 << BITS, 1e-6, np.float32), 1e-6
    first = np.searchsorted(of, np.arange(n + 1))
    sizes = np.maximum(1, np.diff(first))
    step = 20_000
    for epoch in range(epochs):
        for lo in rng.permutation(np.arange(0, n, step)):
            hi = min(n, lo + step)
            ids, words = grams[first[lo] : first[hi]], of[first[lo] : first[hi]] - lo
            mean = np.stack([np.bincount(words, e[ids, d], hi - lo) for d in range(DIMS)], 1) / sizes[lo:hi, None]
            z = mean @ u + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            t = target[lo:hi]
            g = (p - np.stack([1 - t, t], 1)) * weight[lo:hi, None]
            total = weight[lo:hi].sum()
            gmean = (g @ u.T) / sizes[lo:hi, None]
            du = mean.T @ g / total
            uniq, inv = np.unique(ids, return_inverse=True)
            de = np.stack([np.bincount(inv, gmean[words, d], len(uniq)) for d in range(DIMS)], 1)
            ge[uniq] += (de * de).mean(1)
            e[uniq] -= (0.3 * de / np.sqrt(ge[uniq])[:, None]).astype(np.float32)
            gu += float((du * du).mean())
            u -= (0.1 * du / np.sqrt(gu)).astype(np.float32)
            b -= (0.1 * g.sum(0) / total).astype(np.float32)
    return {"e": e, "u": u, "b": b}


def projected(state: dict) -> np.ndarray:
    """One number per bucket: as the softmax is linear, log-odds of averages are averages of these."""
    du = state["u"][:, 1] - state["u"][:, 0]
    return (state["e"] @ du + (state["b"][1] - state["b"][0])).astype(np.float64)


def fit(texts: list[list[str]], labels: list[int], prior: float, rounds: int = 4, seed: int = 5) -> dict:
    """texts: the distinct words of each document. prior: the share of toxic documents among all labelled ones."""
    rng = np.random.default_rng(seed)
    vocabulary = sorted({w for t in texts for w in t})
    number = {w: i for i, w in enumerate(vocabulary)}
    n = len(vocabulary)
    order = rng.permutation(n)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    parts = []
    for lo in range(0, n, 20_000):  # in pieces, for memory
        g, o, _ = word_grams(" ".join(vocabulary[i] for i in order[lo : lo + 20_000]))
        sort = np.argsort(o, kind="stable")
        parts.append((g[sort].astype(np.int32), (o[sort] + lo).astype(np.int32)))
    grams, of = (np.concatenate([p[i] for p in parts]) for i in range(2))
    docs = [place[[number[w] for w in t]] for t in texts]
    y = np.array(labels, np.float64)
    good, bad = np.zeros(n), np.zeros(n)
    for d, label in zip(docs, labels, strict=True):
        (bad if label else good)[d] += 1
    blame, state = bad.copy(), None
    for k in range(rounds):
        total = good + bad
        target, weight = np.minimum(1, blame / np.maximum(total, 1e-9)), np.minimum(total, 50)
        state = train(grams, of, n, target, weight, state if k else None, 6 if k else 8, rng)
        scalar = projected(state)
        logit = np.bincount(of, scalar[grams], n) / np.maximum(1, np.bincount(of, minlength=n))
        # blame goes to the words that stand out in their document, against what words of clean documents reach
        clean = np.sort([logit[d].max() for d, label in zip(docs, labels, strict=True) if not label and len(d)] or [0.0])
        bar = clean[int(0.9 * (len(clean) - 1))]
        blame = np.zeros(n)
        for d, label in zip(docs, labels, strict=True):
            if label and len(d):
                s = logit[d]
                blame[d[s >= max(bar, s.max() - 2)]] += 1
    share = max(y.mean(), 1e-9)
    weight = np.where(y == 1, prior / share, (1 - prior) / max(1 - share, 1e-9))
    wordy = np.array([i for i, d in enumerate(docs) if len(d)], np.int64)
    first = np.searchsorted(of, np.arange(n + 1))
    for _ in range(rounds):
        worst = np.array([docs[i][logit[docs[i]].argmax()] for i in wordy], np.int64)
        sizes = first[worst + 1] - first[worst]
        at = np.repeat(first[worst] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        state = train(grams[at], np.repeat(np.arange(len(wordy)), sizes), len(wordy), y[wordy], weight[wordy], state, 5, rng)
        scalar = projected(state)
        logit = np.bincount(of, scalar[grams], n) / np.maximum(1, np.bincount(of, minlength=n))
    return {"scalar": scalar.astype(np.float32)}


def distinct_words(text: str | None) -> list[str]:
    return sorted({w for w in "".join(map(chr, spaced(text, digits=True))).split(" ") if w}) if text else []


def score(model: dict | None, text: str | None) -> float:
    """The softmax of the worst word."""
    if model is None:
        return 0.0
    odds = word_scores(text, model["scalar"]) if text else np.zeros(0)
    return float(1 / (1 + np.exp(-np.clip(odds.max() if len(odds) else FLOOR, -30, 30))))


def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([distinct_words(t) for t in b.column(0).to_pylist()], pa.list_(pa.string())), b.column(1)], ["words", "toxic"])


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, clean_sample: int = CLEAN_SAMPLE) -> dict | None:
    """None unless both labels occur."""
    labels = labels.filter("toxic in (0, 1) and doc_id is not null").filter(remainder() != HELD_OUT).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return None
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 20)) / float(1 << 20)
    chosen = F.broadcast(labels.filter(u < F.when(F.col("toxic") == 1, min(1.0, sample / n[1])).otherwise(min(1.0, clean_sample / n[0]))))
    rows = docs.filter("text is not null").select("doc_id", "text").join(chosen, "doc_id").select("text", "toxic").mapInArrow(bags, "words array<string>, toxic int").collect()
    if len({r["toxic"] for r in rows}) < 2:
        return None
    rows.sort(key=lambda r: (r["toxic"], r["words"]))
    return fit([r["words"] for r in rows], [r["toxic"] for r in rows], n[1] / (n[0] + n[1]))


def scored(docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_table(True)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([score(model, t) for t in b.column(0).to_pylist()], pa.float64())], [*b.schema.names[1:], "score"])

    rows = docs.select("text", "doc_id", (remainder() == HELD_OUT).alias("held_out"))
    out = rows.mapInArrow(of, rows.drop("text").schema.add("score", "double"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scored(docs, learn(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))
