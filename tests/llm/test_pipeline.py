"""The stages of the pipeline on small tables, against plain Python."""

import random
from itertools import combinations

import pytest

import corpus_pipeline
from quire.llm import jaccard, language, mixing, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaked int, lang_pred string, copy int, id int, keep int"
EN = "the quick brown fox jumps over the lazy dog and then it runs away into the deep dark forest near our little town"
ES = "el rapido zorro marron salta sobre el perro perezoso y despues corre lejos hacia el bosque oscuro cerca de nuestro pueblo"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "x", 2, 3, 4) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture()
def docs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        words = (EN if i % 2 else ES).split()
        text = " ".join(rng.choice(words) for _ in range(30)) + f" {i} {i + 1000}"
        rows.append((i, text, "en" if i % 2 else "es", "a" if i % 3 else None))
    rows += [(100, rows[4][1] + " tail", "es", "a"), (101, rows[4][1], "es", "b"), (101, rows[4][1], "es", "b")]
    rows += [(102, "first " + " ".join(f"q{k}" for k in range(20)), "en", "b"), (102, "second " + " ".join(f"r{k}" for k in range(20)), "en", "b")]
    rows += [(103, None, "en", "a"), (104, "", "en", "a"), (105, "12345 678", "en", "a"), (None, rows[1][1], "en", "a")]
    return table(spark, rows)


def plain(df):
    return sorted(tuple(r) for r in df.selectExpr("coalesce(doc_id, -1)", "coalesce(text, '')").collect())


def test_language_stage(spark, docs):
    got = corpus_pipeline.language_id(spark, docs, "")
    assert got.columns == docs.columns
    kept = {r[0] for r in plain(got)}
    assert kept == {r[0] for r in plain(docs)} - {103, 104, 105}


def test_near_duplicate_stage(spark, docs):
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    sets = {i: set() for i in range(len(docs.columns))}
    rows = plain(docs)
    words = [(t.lower().split()) for _, t in rows]
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set() for w in words]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if rows[a][0] != -1 and rows[b][0] != -1 and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            parent[max(root(a), root(b))] = min(root(a), root(b))
    want = sorted(r for k, r in enumerate(rows) if root(k) == k)
    assert plain(got) == want and sum(i == 102 for i, _ in want) == 2


def test_decontamination_stage(spark, docs, tmp_path):
    item = docs.filter("doc_id = 7").first().text
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.decontaminate(spark, docs, str(tmp_path))
    assert got.columns == docs.columns and plain(got) == [r for r in plain(docs) if r[0] != 7]


def test_mixing_stage(spark, docs):
    got = corpus_pipeline.mix_sources(spark, docs, "")
    assert got.columns == docs.columns
    assert plain(got) == plain(mixing.replicate(docs))
    per = {r.source: r["count"] for r in got.groupBy("source").count().collect()}
    assert set(per) == {"a", "b", None}


def test_shard_stage(spark, docs):
    got = corpus_pipeline.shard(spark, docs, "").collect()
    assert len(got) == docs.count() and {r.law for r in got} == {"bytes"}
    shard_of = {}
    for r in got:
        shard_of.setdefault(r.group_id, set()).add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    # the smallest capacity, by trying all of them over the groups in order
    sizes = [s for _, s in sorted((k, sum(r.size for r in got if r.group_id == k)) for k in {r.group_id for r in got})] if None not in {r.group_id for r in got} else None
    if sizes:
        fits = lambda cap: len(sharding.greedy([0, *[sum(sizes[: i + 1]) for i in range(len(sizes))]], cap, 24) or [0] * 99) <= 24
        least = next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
        assert max(sum(r.size for r in got if r.shard == s) for s in {r.shard for r in got}) <= least


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES], ids=lambda s: s[0])
def test_empty_tables_pass_through(spark, stage, tmp_path):
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert stage[1](spark, table(spark, []), str(tmp_path)).count() == 0


def test_whole_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.count() > 100 and set(got.columns) == {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "group_id"}


def test_repeated_ids_keep_different_texts(spark):
    rows = [(1, "a b c d e f g"), (1, "p q r s t u v"), (1, "a b c d e f g"), (2, "a b c d e f g h"), (3, None), (None, "a b c d e f g")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text or "") for r in jaccard.one_of_each(d).collect())
    assert got == [(0, "a b c d e f g"), (1, "a b c d e f g"), (1, "p q r s t u v"), (3, "")]


def test_held_out_languages(spark, docs):
    got = language.identify(docs, language.learn(docs), ["doc_id", "lang"]).filter("lang_pred <> 'und'").collect()
    assert sum(r["lang"] == r.lang_pred for r in got if r.doc_id is not None and r.doc_id < 60) >= 58
