"""Language ID by hierarchical discrimination.

Features are the square roots of hashed counts of 1- to 3-letter runs of the whole text, of unit length. A linear softmax
predicts the language family; within a family, one-versus-one linear support vector machines (squared
hinge) vote. The score is the family's probability times the winner's mean logistic margin against its relatives.

The models are fitted on at most about SAMPLE rows per language, of those whose crc32(doc_id) mod 4 is not 2,
chosen by a hash of doc_id. lang, source and doc_id are no inputs of a prediction. A text that is null or
has no letter is `und` with score 0, and so is every text if no row is labelled. Rows that repeat give rows each;
a null doc_id is not held out and not learned from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .codes import class_table, gram_hashes, spaced
from .common import table

BITS, SAMPLE, HELD_OUT = 12, 700, 2
#: Families of languages by code. Others are a family of their own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
}
FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes}


def family(lang: str) -> str:
    return FAMILY.get(lang, lang)


def remainder() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0))


def features(text: str | None) -> np.ndarray | None:
    """Unit vector, None without letters."""
    if not text:
        return None
    a = spaced(text)
    if len(a) < 2 or not (a != 32).any():
        return None
    ids = np.concatenate([gram_hashes(a, n) >> np.uint64(64 - BITS) for n in (1, 2, 3)])
    x = np.sqrt(np.bincount(ids.astype(np.int64), minlength=1 << BITS)).astype(np.float32)
    return x / np.linalg.norm(x)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def descend(x: np.ndarray, gradient, shape: tuple, steps: int = 150, rate: float = 8.0, decay: float = 1e-4) -> np.ndarray:
    """Gradient descent with momentum from zero; gradient(scores) is that of the mean loss."""
    w, v = np.zeros(shape, np.float32), np.zeros(shape, np.float32)
    for _ in range(steps):
        g = x.T @ gradient(x @ w) / len(x) + decay * w
        v = 0.9 * v - rate * (1 - 0.9) * g
        w += v
    return w


def fit(x: np.ndarray, langs: list[str]) -> dict:
    """Family softmax and one support vector machine per pair of languages of a family."""
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    names = sorted(set(langs))
    groups = sorted({family(s) for s in names})
    y = np.eye(len(groups), dtype=np.float32)[[groups.index(family(s)) for s in langs]]
    model = {"groups": groups, "members": {g: [s for s in names if family(s) == g] for g in groups}, "family": descend(x, lambda z: softmax(z) - y, (x.shape[1], len(groups))), "pairs": {}}
    at = np.array(langs)
    for g in groups:
        for i, a in enumerate(model["members"][g]):
            for b in model["members"][g][i + 1 :]:
                rows = (at == a) | (at == b)
                sign = np.where(at[rows] == a, 1, -1).astype(np.float32)
                model["pairs"][a, b] = descend(x[rows], lambda z, s=sign: -2 * s * np.maximum(0, 1 - s * z), (x.shape[1],), rate=1.0)
    return model


def predict(model: dict, x: np.ndarray) -> tuple[str, float]:
    x = np.append(x, np.float32(1))
    p = softmax((x @ model["family"])[None])[0]
    g = model["groups"][int(p.argmax())]
    best = (-1.0, 0.0, "")
    for a in model["members"][g]:
        margins = [float(x @ w) if q == a else -float(x @ w) for (q, r), w in model["pairs"].items() if a in (q, r)]
        votes = sum(m > 0 for m in margins)
        sure = float(np.mean([1 / (1 + np.exp(-3 * m)) for m in margins])) if margins else 1.0
        best = max(best, (votes + sure / 2, sure, a))
    return best[2], float(min(1.0, max(0.0, p.max() * best[1])))


def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([None if v is None else v.astype("<f4").tobytes() for v in x], pa.binary()), b.column(1)], ["x", "lang"])


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Fitted on rows with text, lang and doc_id that are not held out; None without any."""
    known = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (remainder() != HELD_OUT))
    n = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    if not n:
        return None
    share = F.lit(0.0)
    for lang, rows in n.items():
        share = F.when(F.col("lang") == lang, min(1.0, min(sample, 8 * sample / len(n)) / rows)).otherwise(share)
    u = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 20)) / float(1 << 20)
    rows = known.filter(u < share).select("text", "lang").mapInArrow(vectors, "x binary, lang string").filter("x is not null").collect()
    if not rows:
        return None
    return fit(np.stack([np.frombuffer(r["x"], "<f4") for r in rows]), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: dict | None, kept: list[str], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns kept, then prediction and score under the names given, for every row."""
    rows = docs.select(*kept, *[c for c in ["text"] if c not in kept])
    at, wide = rows.columns.index("text"), len(kept)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_table(False)
        for b in batches:
            said = []
            for t in b.column(at):
                x = features(t.as_py()) if model else None
                said.append(("und", 0.0) if x is None else predict(model, x))
            yield pa.RecordBatch.from_arrays([*b.columns[:wide], pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], [*b.schema.names[:wide], *names])

    return rows.mapInArrow(of, docs.select(*kept).schema.add(names[0], "string").add(names[1], "double"))


def op6_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", remainder() == HELD_OUT)
    return identify(docs, learn(docs), ["doc_id", "held_out"])
