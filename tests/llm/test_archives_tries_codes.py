"""The conversation trie, web archives and vector codes against brute force, and their defined results on odd rows."""

import gzip
import hashlib
import io
import json
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import queries, trie, vector_codes, warc

CONVERSATIONS = "conv_id long, turn long, role string, text string, `from` string, w int"


# ---- trie


def brute_nodes(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest(), (role or "", text or "")))
    own = {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        rebuilt[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + own[c][h:]
    members = defaultdict(list)
    for c, ts in rebuilt.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    kids = defaultdict(list)
    for n in members:
        if n:
            kids[n[:-1]].append(n)
    leaves, saved = {}, {}
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + (len(members[n]) - 1) * (len(n[-1][1]) if n else 0)
    ends = lambda n: hashlib.sha256(",".join(map(str, sorted(c for c in members[n] if len(rebuilt[c]) == len(n)))).encode()).hexdigest()
    return sorted((min(members[n]), len(n), min(members[n[:-1]]) if n else None, len(members[n]), len(kids[n]), leaves[n], saved[n], ends(n)) for n in members)


def nodes_of(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], CONVERSATIONS)
    found = trie.trie(*trie.lent(trie.saved(trie.placed(trie.turns(table)))))
    key = lambda r: tuple(-1 if v is None else v for v in r)
    return sorted((tuple(r) for r in found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=key)


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_brute_force(spark, seed):
    pick = random.Random(seed)
    rows = [(c, t, pick.choice(["user", "bot"]), pick.choice(["a", "bb", "ccc"])) for c in pick.sample(range(-5, 320), 60) for t in range(pick.randrange(1, 9))]
    rows += [(400 + i, t, "user", "same") for i in range(30) for t in range(12)]
    rows += [(500, t, "user", str(t % 7) * 40) for t in range(300)] + [(601, 0, "user", "all are lent")]
    assert nodes_of(spark, rows) == sorted(brute_nodes(rows), key=lambda r: tuple(-1 if v is None else v for v in r))


def test_trie_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (7, None, None, None), (7, 1, "user", "é" * 5000), (7, 1, "user", "é" * 5000), (8, 0, None, None), (8, 0, "user", None), (9, 3, "", "")]
    assert nodes_of(spark, rows) == sorted(brute_nodes(rows), key=lambda r: tuple(-1 if v is None else v for v in r))
    assert nodes_of(spark, []) == []
    assert nodes_of(spark, [(None, 0, "user", "x")]) == []


def test_members_are_hashed_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 3)
    several = [b for b in trie.pieces(iter([trie.pd.DataFrame({"cls": ["a"] * 7 + ["b"], "conv_id": [*range(7), 9]})]))]
    assert [(b["cls"][0], b["part"][0]) for b in several] == [("a", "0,1,2"), ("a", "3,4,5"), ("a", "6"), ("b", "9")]
    done = [(r["cls"][0], r["ends_sha256"][0]) for r in trie.digests(iter(several))]
    assert done == [("a", hashlib.sha256(b"0,1,2,3,4,5,6").hexdigest()), ("b", hashlib.sha256(b"9").hexdigest())]


# ---- archives

PAGES = "page_id long, url string, html string, digest string, path string"


def pages_of(spark):
    long = "ö" * 3_000_000
    rows = [(1, "http://a/x y", "p" * 1000), (5, None, "p" * 1000), (3, "http://b", "p" * 1000), (2, "http://c", "q" * 999), (4, "http://d", "q" * 999), (6, "http://e", None), (8, "http://e", ""), (9, "u", long), (None, "u", "p" * 1000), (7, "http://f", "\r\n\r\nWARC/1.1\r\n"), (5, None, "p" * 1000)]
    return rows, spark.createDataFrame([(*r, "d", "p") for r in rows], PAGES)


def brute_pages(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        held = max((p for p, _, h in rows if h == html and p is not None), default=None) if len(data) >= 1000 else None
        again = held is not None and page_id != held
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", held if again else None))
    return sorted(out, key=str)


def test_archives_round_trip(spark):
    rows, pages = pages_of(spark)
    manifest, index = warc.archived(pages, largest=2000)
    found = warc.read(index, warc.page, warc.PAGE, warc.PAGE_DDL, task=500)
    assert sorted(map(tuple, found.collect()), key=str) == brute_pages(rows)
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)
    for r in manifest.collect():  # one stream each
        raw = open(r["path"].removeprefix("file://"), "rb").read()
        inflate = zlib.decompressobj(31)
        inflate.decompress(raw)
        assert inflate.eof and not inflate.unused_data
    by_path = defaultdict(list)
    for r in index.collect():
        by_path[r["path"].removeprefix("file://")].append(r.asDict())
    for path, held in by_path.items():
        raw, at = open(path, "rb").read(), 0
        listed = [json.loads(line) for line in open(path.replace(".warc.gz", ".cdxj"))]
        held.sort(key=lambda r: r["offset"])
        assert [(r["offset"], r["length"]) for r in listed] == [(r["offset"], r["length"]) for r in held]
        for r in listed:  # members lie side by side, and each inflates alone to its record
            assert r["offset"] == at
            record = gzip.decompress(raw[at : at + r["length"]])
            assert record.startswith(b"WARC/1.1\r\n") and record.endswith(b"\r\n\r\n") and r["record_id"].encode() in record
            at += r["length"]
        assert at == len(raw) and b"".join(gzip.decompress(raw[r["offset"] : r["offset"] + r["length"]]) for r in listed) == gzip.decompress(raw)


def test_archives_that_are_torn_or_none(spark, tmp_path):
    record = warc.head(1, "http://a", 3, "d", None) + b"abc\r\n\r\n"
    files = {"whole": gzip.compress(record * 2), "members": gzip.compress(record) + gzip.compress(record), "torn": gzip.compress(record * 50)[:-9], "other": gzip.compress(record + b"no record\r\n\r\n"), "plain": b"text", "empty": b""}
    for name, data in files.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(data)
    index = warc.normalised(spark.createDataFrame([(f"file://{tmp_path}/{n}.warc.gz",) for n in files] + [(f"file://{tmp_path}/gone.warc.gz",)], "path string"), warc.folder(spark, "test"))
    error = {r["path"].rpartition("/")[2].partition(".")[0] for r in index.filter("error is not null").collect()}
    assert error == {"torn", "other", "plain", "gone"}
    ok = index.filter("error is null").groupBy(F.regexp_extract("path", "([a-z]+)-[^/]*$", 1).alias("n")).count()
    counts = {r["n"]: r["count"] for r in ok.collect()}
    assert (counts["whole"], counts["members"], counts["other"], counts.get("empty")) == (2, 2, 1, None)


def test_streams_in_small_steps(monkeypatch):
    record = warc.head(1, "http://a", 2000, "d", None) + b"x" * 2000 + b"\r\n\r\n"
    for step in (512, 640, 1000, len(record)):
        monkeypatch.setattr(warc, "STEP", step)
        got = [b"".join(block) for _, _, block in warc.records(io.BytesIO(gzip.compress(record * 3)))]
        assert len(got) == 3 and all(g.endswith(b"x" * 2000) for g in got)
        stream = warc.Inflated(io.BytesIO(gzip.compress(b"y" * 10 * step)))
        assert b"".join(stream.pieces(10 * step)) == b"y" * 10 * step and not stream.more()


def test_no_pages(spark):
    manifest, index = warc.archived(spark.createDataFrame([], PAGES))
    assert manifest.count() == 0 and warc.read(index, warc.page, warc.PAGE, warc.PAGE_DDL).count() == 0


# ---- vector codes


def brute_codes(vectors, parts, entries, rounds):
    kept = [[math.floor(256 * x) for x in v] for _, v in sorted(vectors, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    width = len(kept[0]) // parts
    cut = [[tuple(v[p * width : (p + 1) * width]) for p in range(parts)] for v in kept]
    book = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        code = [[min(range(len(book[p])), key=lambda e: (dist(v[p], book[p][e]), e)) for p in range(parts)] for v in cut]  # noqa: B023
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(book[p])):
                mine = [v[p] for v, c in zip(cut, code, strict=True) if c[p] == e]
                if mine:
                    book[p][e] = tuple(sum(x) // len(mine) for x in zip(*mine, strict=True))
    return sorted((bytes(c).hex(), sum(dist(v[p], book[p][c[p]]) for p in range(parts))) for v, c in zip(cut, code, strict=True)), [[list(e) for e in b] for b in book]


@pytest.mark.parametrize("grid", [1, 64])
def test_codes_equal_brute_force(spark, grid):
    """grid 1: components are few whole numbers, so distances tie all the time."""
    pick = random.Random(grid)
    vectors = [(i // 2 if i < 20 else i, [pick.randrange(-2 * grid, 2 * grid) / grid for _ in range(8)]) for i in range(300)]
    df = spark.createDataFrame([(i, v, "l", 0) for i, v in vectors], "vec_id long, embedding array<float>, label string, code int").repartition(3)
    found, book = vector_codes.compressed(df, parts=4, entries=16, rounds=3)
    got = found.select("code", "error", "compared").collect()
    want, want_book = brute_codes(vectors, 4, 16, 3)
    assert sorted((r["code"], r["error"]) for r in got) == want and book.tolist() == want_book
    assert sum(r["compared"] for r in got) < 300 * 4 * 16  # the last pass skips some


def test_bounds_prune_and_hold():
    pick = np.random.default_rng(3)
    middles = pick.integers(-900, 900, (2, 32, 4))
    x = (middles[:, pick.integers(0, 32, 400)] + pick.integers(-20, 20, (2, 400, 4))).transpose(1, 0, 2)
    book = middles.copy()
    code, upper, lower, _ = vector_codes.first(x, book)
    for _ in range(4):
        new = book + pick.integers(-3, 4, book.shape)
        code, upper, lower, compared = vector_codes.again(x, new, np.sqrt(((new - book) ** 2).sum(-1)), code, upper, lower)
        far = ((x[:, :, None] - new[None]) ** 2).sum(-1)
        assert (code == far.argmin(-1)).all() and compared < 0.2 * far.size
        assert (upper >= np.sqrt(far.min(-1))).all() and (lower <= np.sqrt(far)).all()
        book = new


def test_codes_odd_rows(spark):
    big = 2**60 + 1
    rows = [(big, [0.5] * 32, None), (None, [0.25] * 32, 1), (1, None, 1), (2, [float("nan")] * 32, 1), (3, [float("inf")] * 32, 1), (4, [None] * 32, 1), (5, [], 1), (6, [1.0] * 16, 1), (7, [1.0] * 17, 1), (8, [-0.001] * 32, None)]
    found, book = vector_codes.compressed(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    got = {r["vec_id"]: (r["code"], r["error"], r["label"]) for r in found.collect()}
    assert got == {8: ("00" * 16, 0, None), big: ("01" * 16, 0, None), None: ("02" * 16, 0, 1)} and book[0].tolist() == [[-1, -1], [128, 128], [64, 64]]
    for none in ([], [(1, None, 1)], [(1, [], None)]):
        assert vector_codes.compressed(spark.createDataFrame(none, "vec_id long, embedding array<float>, label int"))[0].count() == 0


def test_empty_tables_as_queries(spark, tmp_path):
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("op11_trie", "op12_warc", "op13_vector_codes"):
        assert queries.QUERIES[name](spark, str(tmp_path)).collect() == []


def test_label_errors_add_up(spark, tmp_path):
    rows = [(i, [float(i % 7)] * 15 + [i / 300], None if i % 3 else i % 2) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.QUERIES["op13_vector_codes"](spark, str(tmp_path)).collect()
    total = defaultdict(int)
    for r in got:
        total[rows[r["vec_id"]][2]] += r["error"]
    assert len(got) == 200 and all(r["label_error"] == total[rows[r["vec_id"]][2]] for r in got) and len({r["codebooks_sha256"] for r in got}) == 1
    assert len(total) == 3
