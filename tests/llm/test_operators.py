import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from quire.llm import decontamination, jaccard, language, line_dedup, media, mixing, pii, secrets, sharding, toxicity

SCHEMA = "doc_id long, text string, lang string, source string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a") for i, t in rows], SCHEMA)


ODD = [(1, None), (2, ""), (3, "   \n\t "), (4, "word"), (4, "word"), (None, "word"), (5, "x" * 20_000 + " y" * 3000), (6, "ÀÉ ñ 日本 🙂 <%")]


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def test_jaccard_against_all_pairs(spark):
    rng = random.Random(4)
    rows = []
    for _ in range(40):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.choice([3, 5, 6, 8, 11, 14, 25, 60, 150]))]
        for _ in range(rng.choice([1, 2, 5, 14])):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2])):
                t[rng.randrange(len(t))] = f"z{rng.randrange(10**6)}"
            rows.append((len(rows) + 10, " ".join(t)))
    rows += [r for r in ODD if r[0] is not None]
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    first = {i: i for i in sets}
    changed = True
    pairs = [(a, b) for a, b in combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in pairs:
            m = min(first[a], first[b])
            if first[a] != m or first[b] != m:
                first[a] = first[b] = m
                changed = True
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked(docs(spark, rows)).collect()}
    assert got == {i: (len(s), first[i]) for i, s in sets.items()}


def test_jaccard_null_ids_and_empty_table(spark):
    got = jaccard.linked(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.linked(docs(spark, [])).count() == 0


def test_jaccard_words_built_to_collide_stay_apart(spark):
    """Words in the order of Thue and Morse have equal sums over powers of any base modulo a power of two."""
    rows = []
    for k in (5, 6, 7, 10, 11, 12, 14):
        order = [bin(i).count("1") & 1 for i in range(1 << k)]
        rows += [(len(rows) + j, "".join("ab"[bit ^ j] for bit in order)) for j in (0, 1)]
    assert {r.doc_id: r.component_id for r in jaccard.linked(docs(spark, rows)).collect()} == {i: i for i, _ in rows}


def test_jaccard_word_hashes_know_words_apart_and_alike():
    rng = random.Random(9)
    made = {"".join(rng.choice("abcAB\u00e9") for _ in range(rng.choice([1, 2, 3, 60, 63, 64, 65, 66, 130]))) for _ in range(2000)}
    text = " \t".join(["", *made, *(w.swapcase() if w.isascii() else w for w in made), ""])
    low = words(text)
    got = jaccard.word_hashes(np.frombuffer(text.encode(), np.uint8)).tolist()
    assert len(got) == len(low) and len(set(got)) == len(set(low)) == len(set(zip(got, low, strict=True)))


def test_sharding(spark):
    rows = [(i, "t" * (i % 50) if i % 7 else "same") for i in range(300)] + ODD
    got = sharding.shards(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by_text = {}
    for r in got:
        by_text.setdefault((r.size, r.text_crc32), set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert {r.text_crc32 for r in got if r.doc_id == 6 and r.size > 10} >= {zlib.crc32(ODD[-1][1].encode())}
    assert sharding.shards(docs(spark, [])).count() == 0


def test_cuts_are_sought_in_few_branches(spark):
    """Segments where a cut can lie are hundreds, so the plan must not have a branch for each."""
    rng = random.Random(2)
    ends = np.cumsum([rng.randrange(8, 5000) for _ in range(4000)]).tolist()
    df, branches = spark.createDataFrame([(e,) for e in ends], "end long"), []

    class Seen:
        def filter(self, where):
            branches.append(str(where).count(" < "))
            return df.filter(where)

    cap, cuts = sharding.minimax_cuts(Seen(), ends[-1], 5000, 24, width=256)
    assert cap == sharding.smallest([0, *ends], 5000, ends[-1], 24) and len(branches) > 1 and max(branches) <= 24
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) <= cap and set(cuts) <= set(ends)
    assert sharding.stretches([0, 10, 20, 30, 90, 99], [0, 2, 4], 2) == [(0, 30), (90, 99)]


def test_minimax_is_the_smallest_capacity(spark):
    rng = random.Random(1)
    sizes = [rng.choice([8, 9, 1000, rng.randrange(8, 5000)]) for _ in range(700)]
    ends = np.cumsum(sizes).tolist()
    cap, cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), ends[-1], max(sizes), 7, width=16)
    assert cap == sharding.smallest([0, *ends], max(max(sizes), -(-ends[-1] // 7)), ends[-1], 7)
    assert max(b - a for a, b in zip([0, *cuts], cuts, strict=False)) <= cap and cuts[-1] == ends[-1]


def brute_base(text):
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_pii_base_spans():
    rng = random.Random(2)
    pieces = ["a@b.co", "@", ".", "x.y+z@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4785380592391139", "+1 (212) 555-0100", "+", "9", " ", "-", "é", "00000001.2.3.4", "a@b@c.d", "_q@w.e"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
        assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute_base(text), text


def brute_terms(rows):
    """PMI and the bound on chance counted by hand: term to its share."""
    word = re.compile(r"[^\W\d_]{3,}")
    texts = [t for _, t in rows if t is not None]
    holds, joint, of_entity, contexts, vocabulary, rows_of = {}, {}, {}, {}, set(), {}
    signed = lambda w: (xxhash.xxh64(w.encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    for i, t in enumerate(texts):
        spans = [(a, b) for _, a, b in brute_base(t)]
        for w in set(word.findall(t)):
            holds[w] = holds.get(w, 0) + 1
        names = {pii.entity(pii.KINDS.index(k), t[a:b]) for k, a, b in brute_base(t)}
        terms = {m[0] for m in word.finditer(t) if all(b <= m.start() or m.end() <= a for a, b in spans)}
        vocabulary |= terms if names else set()
        for e in names:
            of_entity[e] = of_entity.get(e, 0) + 1
            rows_of.setdefault(e, []).append(i)
            for w in terms:
                joint[e, w] = joint.get((e, w), 0) + 1
                contexts.setdefault((e, w), set()).add(min(map(signed, terms)))
    out, tries = {}, len(vocabulary) * len({tuple(r) for r in rows_of.values()})
    for (e, w), n in joint.items():
        content = math.log(len(texts) / of_entity[e])
        share = min(1.0, math.log((n - pii.DISCOUNT) * len(texts) / (holds[w] * of_entity[e])) / content) if content > 0 else 0.0
        k, mean = len(contexts[e, w]), holds[w] * of_entity[e] / len(texts)
        chance = math.exp(k - mean) * (mean / k) ** k if k > mean else 1.0
        if share >= pii.ALPHA and k >= pii.CONTEXTS and tries * chance <= pii.CHANCE:
            out[w] = max(share, out.get(w, 0.0))
    return out


AROUND = "amber birch cedar delta ember fjord grove heron".split()
OWN = [" ".join(w + c for c in "abcdefghijklmnopqrstuvwxyz") for w in AROUND]
PRIVATE = [(i, f"number {i} of {w} Zaphod Quill is q@mail.example today {w} mail") for i, w in enumerate(OWN)] + [(100 + i, f"number {i} is fine today") for i in range(300)] + [(7, "Solo a@b.co +1 212 555 0100 Solo")] * 2


def test_pii_terms_against_brute_force(spark):
    rows = PRIVATE + ODD
    got = {r.term: r.share for r in pii.disclosing(docs(spark, rows)).collect()}
    assert got == pytest.approx(brute_terms(rows)) and "Zaphod" in got and "today" not in got


def test_pii_spans_against_brute_force(spark):
    rows = PRIVATE + ODD
    terms = brute_terms(rows)
    want = []
    for i, t in rows:
        base = brute_base(t or "")
        more = [("term", *m.span()) for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0] in terms and all(b <= m.start() or m.end() <= a for _, a, b in base)]
        want.append((str(i), base + more))
    got = [(str(r.doc_id), [(pii.KINDS[x.kind], x.start, x.end) for x in r.spans]) for r in pii.private_spans(docs(spark, rows)).collect()]
    assert sorted(got) == sorted(want)
    assert pii.sanitised("a b@c.d e", [{"kind": 0, "start": 2, "end": 7, "remove": False}]) == "a [EMAIL] e"


def test_sanitise_keeps_rows_and_columns(spark):
    rows = [(None, "write to x@y.zz"), (None, "write to x@y.zz"), (1, "write to me"), (1, "write to me"), (2, None), (3, "")]
    d = docs(spark, rows).selectExpr("*", "1 as base", "2 as spans", "3 as rid", "4 as words")
    got = pii.sanitise(d)
    assert got.columns == d.columns
    texts = sorted(str(r.text) for r in got.collect())
    assert len(texts) == len(rows) and not any("@" in t for t in texts) and texts.count("write to me") == 2
    assert pii.sanitise(docs(spark, [])).count() == 0 and pii.private_spans(docs(spark, [])).count() == 0


def brute_secrets(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark):
    rng = random.Random(3)
    pieces = ["password: ", "Token=", "secret = '", "api_key:", "abc", "deadbeef" * 3, "AKIA" + "Q7" * 9, "AKIA", " ", "é🙂", "= ", "abcdef123", "\n"]
    rows = [(i, "".join(rng.choice(pieces) for _ in range(rng.randrange(15)))) for i in range(300)] + ODD
    got = secrets.secrets(docs(spark, rows)).select("doc_id", secrets.written(secrets.F.col("base")).alias("b")).collect()
    want = sorted((str(i), brute_secrets(t or "")) for i, t in rows)
    assert sorted((str(r.doc_id), r.b) for r in got) == want


def brute_battery(token):
    """(k, squares, deviates of uniformity, runs, serial correlation) in numpy."""
    letters = next(a for _, a in secrets.ENCODINGS if set(token) <= set(a))
    v = np.array([letters.index(c) for c in token], float)
    n, k = len(v), len(letters)
    c = np.bincount(v.astype(int), minlength=k)
    even = (((c - n / k) ** 2 / (n / k)).sum() - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    up = v > (k - 1) / 2
    a, b = up.sum(), (~up).sum()
    e = 2 * a * b / n + 1
    var = (e - 1) * (e - 2) / (n - 1)
    runs = (1 + (up[1:] != up[:-1]).sum() - e) / math.sqrt(var) if a and b and var > 0 else 99.0
    d = v - v.mean()
    serial = ((d[1:] * d[:-1]).sum() / (d * d).sum() + 1 / n) * math.sqrt(n) if (d * d).sum() else 99.0
    return [k, (c * c).sum(), even, runs, serial]


def test_battery_against_numpy(spark):
    rng = random.Random(9)
    made = ["".join(rng.choice(a) for _ in range(rng.randrange(20, 90))) for _, a in secrets.ENCODINGS for _ in range(6)]
    made += ["a" * 40, "abcdefghijklmnopqrstuvwxyz0123456789", "internationalizationofthings"]
    rows = [(i, f"see {t} now") for i, t in enumerate(made)]
    got = {r.doc_id: r.tested for r in secrets.scanned(docs(spark, rows)).collect()}
    seen = 0
    for i, t in enumerate(made):
        for x in got[i]:
            assert [x.k, x.squares, x.even, x.runs, x.serial] == pytest.approx(brute_battery(t)), t
            seen += 1
    assert seen >= 50  # hex tokens are pattern matches


def test_thresholds_are_those_of_benjamini_and_hochberg():
    rng = np.random.default_rng(2)
    p = np.concatenate((rng.uniform(size=900), rng.uniform(0, 1e-4, 100)))
    cells = np.floor(-50 * np.log10(p)).astype(int)
    at = secrets.thresholds([{"band": 0, "cell": int(c), "n": int(k)} for c, k in zip(*np.unique(cells, return_counts=True), strict=True)], 0.05)[0]
    s = np.sort(p)
    exact = max(k for k in range(1, 1001) if s[k - 1] <= 0.05 * k / 1000)
    assert abs((p <= at).sum() - exact) <= 20


def test_secrets_of_odd_tables(spark):
    assert secrets.secrets(docs(spark, [])).count() == 0
    d = docs(spark, ODD).selectExpr("*", "1 as base", "2 as tokens", "3 as low")
    assert secrets.secrets(d).count() == len(ODD)


def test_random_tokens_are_found(spark):
    rng = np.random.default_rng(0)
    alphabet = list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/")
    rows = [(i, "key " + "".join(rng.choice(alphabet, 60)) + " end") for i in range(30)] + [(100 + i, f"internationalization{i}ofthedocumentationofthings") for i in range(30)]
    got = {r.doc_id: r.n for r in secrets.secrets(docs(spark, rows)).selectExpr("doc_id", "size(spans) - size(base) as n").collect()}
    assert sum(got[i] for i in range(30)) >= 24 and sum(got[100 + i] for i in range(30)) == 0


def test_line_dedup(spark):
    rows = [(1, "a\nb\nc\n\nd"), (2, "x\nb\nc\ny"), (3, "b\nz"), *[r for r in ODD if r[0] not in (1, 2, 3)]]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, rows)).collect()}
    assert got[2] == ("x\ny", 4, 2) and got[1] == ("a\nb\nc\n\nd", 4, 0) and got[3] == ("b\nz", 2, 0)


def brute_lines(rows, min_lines, min_words):
    """Numbers of the lines that go, by comparing every run with every earlier one."""
    seqs = [(i, [x for x in (t or "").split("\n") if x.strip(" ")]) for i, t in sorted(rows)]
    places = [(i, k, s) for i, s in seqs for k in range(len(s))]
    gone = {i: set() for i, _ in seqs}
    for n in (1, min_lines):
        seen = set()
        for i, k, s in places:
            run = tuple(s[k : k + n])
            if len(run) == n and (n > 1 or min_lines == 1 or len(run[0].split()) >= min_words):
                if run in seen:
                    gone[i] |= set(range(k, k + n))
                seen.add(run)
    return gone


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_runs_against_brute_force(spark, min_lines):
    rng = random.Random(min_lines)
    long = " ".join(["w"] * 6)
    rows = [(i, "\n".join(rng.choice(["a", "b", "c", "d", "", long, f"u{i}"]) for _ in range(rng.randrange(14)))) for i in range(12)]
    rows += [(20, rows[3][1]), (21, rows[3][1] + "\n" + rows[4][1])]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.dedup_lines(docs(spark, rows), min_lines, 6).collect()}
    gone = brute_lines(rows, min_lines, 6)
    for i, t in rows:
        kept, k = [], 0
        for x in t.split("\n"):
            if not x.strip():
                kept.append(x)
            else:
                kept += [x] * (k not in gone[i])
                k += 1
        assert got[i] == ("\n".join(kept) if gone[i] else t, len(gone[i])), i


def test_line_runs_are_maximal(spark):
    rows = [(1, "\n".join(f"l{k}" for k in range(40))), (2, "x\n" + "\n".join(f"l{k}" for k in range(5, 28)) + "\ny"), (3, "z\nl1\nl2\nl3\nq")]
    got = {(r.doc_id, r.line, r.lines, r.source.doc_id, r.source.line) for r in line_dedup.runs(docs(spark, rows)).collect()}
    assert got == {(2, 1, 23, 1, 5), (3, 1, 3, 1, 1)}


def test_line_dedup_of_odd_tables(spark):
    d = docs(spark, ODD).selectExpr("*", "1 as n_lines", "2 as removed", "3 as twin")
    assert line_dedup.dedup_lines(d).count() == len(ODD)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    got = [r.text for r in line_dedup.dedup_lines(docs(spark, [(1, "a\nb"), (1, "a\nb"), (1, "a\nb\nc")])).collect()]
    assert sorted(got) in (["a\nb", "a\nb", "c"], ["", "", "a\nb\nc"])


def test_decontamination(spark):
    item = " ".join(f"w{i}" for i in range(20))
    bench = spark.createDataFrame([(1, item), (2, "two words"), (3, None), (4, "")], "item_id long, text string")
    rows = [(1, "a " * 5000 + item.upper() + " b" * 5000), (2, " ".join(item.split()[:12])), (3, "here two words there"), *ODD[3:]]
    got = {(r.doc_id, r.item_id): r.n_hits for r in decontamination.contained(docs(spark, rows), bench).collect()}
    assert got == {(1, 1): 16, (3, 2): 1}


def test_decontamination_against_brute_force(spark):
    rng = random.Random(12)
    vocab = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(n))) for i, n in enumerate([1, 2, 3, 4, 5, 6, 8, 9, 12, 20, 33, 40, 70, 150])]
    items += [(3, items[5][1]), (50, None), (51, ""), (None, "v1 v2"), (52, items[9][1])]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(40))) for _ in range(2)]
        w = (rng.choice(items[:14])[1]).split()
        for _ in range(rng.randrange(1 + len(w) // 10)):
            w[rng.randrange(len(w))] = "zz"
        rows.append((i, f"{parts[0]}  {' '.join(w).upper()}\t{parts[1]}"))
    rows += [*ODD, (7, rows[3][1])]

    def grams(text, k):
        w = words(text)
        return {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}

    want = {}
    for d, text in rows:
        for item, t in items:
            w = words(t)
            if d is None or item is None or not w:
                continue
            k = min(5, len(w))
            own = grams(t, k)
            both = len(own & grams(text, k))
            if 100 * both >= 75 * len(own):
                want[d, item] = max(want.get((d, item), (0.0,)), (both / len(own), both, len(own)))
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item", "2 as h")
    got = {(r.doc_id, r.item_id): (r.containment, r.n_hits, r.n_item_shingles) for r in decontamination.contained(docs(spark, rows).selectExpr("*", "1 as k"), bench).collect()}
    assert got == want and len(want) > 60
    empty = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.contained(docs(spark, rows), empty).count() == 0 == decontamination.contained(docs(spark, []), bench).count()


def test_mixing_meets_its_targets(spark):
    d = spark.range(4000).selectExpr("id as doc_id", "'t' as text", "'en' as lang", "if(id % 10 = 0, 'rare', 'common') as source")
    got = {r.source: r["count"] for r in mixing.replicate(d).groupBy("source").count().collect()}
    assert abs(got["rare"] - 2000) < 250 and abs(got["common"] - 2000) < 250
    assert mixing.replicate(docs(spark, ODD), {"a": 1.0}, 1000).count() > 500


def test_models_on_odd_rows(spark):
    rows = docs(spark, ODD)
    assert {r.lang_pred for r in language.identify(rows, language.learn(rows), ["doc_id", "text"]).collect() if not r.text or not r.text.strip()} == {"und"}
    assert language.learn(docs(spark, [])) is None
    assert toxicity.scored(rows, None).count() == len(ODD)


def test_misspelled_words_are_toxic():
    clean = [[f"plain{i}", f"word{i % 7}", "the"] for i in range(60)]
    toxic = [[f"plain{i}", "horrid", "the"] for i in range(60)]
    model = toxicity.fit(clean + toxic, [0] * 60 + [1] * 60, 0.5)
    assert toxicity.score(model, "the horridd plain3") > 0.5 > toxicity.score(model, "the word2 plain3")


@pytest.mark.parametrize("change", ["crop", "turn", "dim"])
def test_media_finds_edits(change):
    rng = np.random.default_rng(7)
    a = np.zeros((96, 128))
    for _ in range(40):
        y, x, h, w = rng.integers(0, 96), rng.integers(0, 128), rng.integers(5, 30), rng.integers(5, 30)
        a[y : y + h, x : x + w] += rng.normal() * 60
    a = np.clip(a + 128, 0, 255)
    b = {"crop": a[10:80, 20:110], "turn": np.rot90(a), "dim": a * 0.8}[change]
    pgm = lambda m: b"P5 %d %d 255\n" % (m.shape[1], m.shape[0]) + m.astype(np.uint8).tobytes()
    assert media.agree(media.corners(media.decoded(pgm(a))), media.corners(media.decoded(pgm(b)))) >= media.INLIERS
    assert media.decoded(b"junk") is None and not len(media.corners(None))


def test_pairs_of_corners_that_differ_meet():
    """Pairs whose descriptors differ in half the bits allowed, through index rows: more than half share a bucket and pass."""
    rng = np.random.default_rng(6)
    met = 0
    for _ in range(200):
        a = np.zeros(2, media.CORNER)
        a["bits"], a["x"], a["scale"], a["angle"] = rng.integers(0, 256, a["bits"].shape), [0, rng.uniform(8, 40)], 1, rng.uniform(-3, 3, 2)
        b = a.copy()
        for row in b["bits"]:
            row ^= np.packbits(np.isin(np.arange(media.BITS), rng.permutation(media.BITS)[: media.HAMMING // 2]))
        x, y = (media.pairs_of(k, n, range(media.TABLES)) for n, k in enumerate((a, b)))
        same = x["sig"] == y["sig"]
        met += bool((same & media.alike(x, y)).any())
    assert met > 100


def test_meetings_are_those_of_all_pairs():
    """Whatever the batches, small buckets give all pairs that are alike, large ones those with the first row and their rows."""
    rng = np.random.default_rng(4)
    x = np.zeros(3000, media.PAIR)
    x["sig"] = np.sort(np.where(rng.random(3000) < 0.2, 7, rng.integers(0, 400, 3000)))
    x["cls"], x["one"], x["form"] = rng.integers(0, 500, 3000), rng.integers(0, 2, 3000) * (2**40 - 1), rng.integers(0, 2, 3000) * 300
    want, rows = set(), 0
    for sig in np.unique(x["sig"]):
        b = x[x["sig"] == sig]
        rows += len(b) * (len(b) > media.LARGE)
        for i in range(1 if len(b) > media.LARGE else len(b)):
            at = b["cls"][i + 1 :][media.alike(np.repeat(b[i : i + 1], len(b) - i - 1), b[i + 1 :])]
            want |= {(min(c, b["cls"][i]), max(c, b["cls"][i])) for c in at}
    for cut in (3000, 97, 10):
        batches = [pa.RecordBatch.from_arrays(media.columns(x[i : i + cut], media.PAIR.names), list(media.PAIR.names)) for i in range(0, 3000, cut)]
        got = pa.Table.from_batches(list(media.meetings(iter(batches)))).to_pandas()
        assert set(got[~got.big][["a", "b"]].itertuples(index=False, name=None)) == want
        assert got.big.sum() == rows


def test_meetings_by_tree_leave_no_pair_out():
    """A row of a small bucket gives one pair at most; what that leaves out lies among the rows that come for later, whatever the batches."""
    rng = np.random.default_rng(5)
    x = np.zeros(3000, media.PAIR)
    x["sig"] = np.sort(rng.integers(0, 400, 3000))
    x["cls"], x["one"], x["form"] = rng.integers(0, 500, 3000), rng.integers(0, 2, 3000) * (2**40 - 1), rng.integers(0, 2, 3000) * 300

    def all_pairs(rows):
        found = set()
        for sig in np.unique(rows["sig"]):
            b = rows[rows["sig"] == sig]
            for i in range(len(b)):
                at = b["cls"][i + 1 :][media.alike(np.repeat(b[i : i + 1], len(b) - i - 1), b[i + 1 :])]
                found |= {(min(c, b["cls"][i]), max(c, b["cls"][i])) for c in at}
        return found

    for cut in (3000, 97, 10):
        batches = [pa.RecordBatch.from_arrays(media.columns(x[i : i + cut], media.PAIR.names), list(media.PAIR.names)) for i in range(0, 3000, cut)]
        got = pa.Table.from_batches(list(media.meetings(iter(batches), tree=True))).to_pandas()
        later = np.zeros(got.big.sum(), media.PAIR)
        for name, column in zip(("sig", "cls", *media.PAIR.names[2:]), ("a", "b", *media.PAIR.names[2:]), strict=True):
            later[name] = got[got.big][column]
        pairs = set(got[~got.big][["a", "b"]].itertuples(index=False, name=None))
        assert (~got.big).sum() < 3000 and pairs | all_pairs(later) == all_pairs(x)


def test_corners_alike_in_their_sketch_alone_do_not_meet():
    x = np.zeros(2, media.PAIR)
    x["cls"] = [1, 2]
    assert media.alike(x[:1], x[1:])
    x["two1"], x["two3"] = [0, 2**30 - 1], [0, 2**30 - 1]
    assert not media.alike(x[:1], x[1:])


def turned(a, degrees):
    t = np.deg2rad(degrees)
    cy, cx = (a.shape[0] - 1) / 2, (a.shape[1] - 1) / 2
    y, x = np.mgrid[0 : a.shape[0], 0 : a.shape[1]]
    ys, xs = cy + (y - cy) * np.cos(t) - (x - cx) * np.sin(t), cx + (y - cy) * np.sin(t) + (x - cx) * np.cos(t)
    inside = (ys >= 0) & (ys < a.shape[0] - 1) & (xs >= 0) & (xs < a.shape[1] - 1)
    ys, xs = np.where(inside, ys, 0), np.where(inside, xs, 0)
    i, j = ys.astype(int), xs.astype(int)
    u, v = ys - i, xs - j
    return np.where(inside, (1 - u) * ((1 - v) * a[i, j] + v * a[i, j + 1]) + u * ((1 - v) * a[i + 1, j] + v * a[i + 1, j + 1]), 128)


def test_media_recall_of_edits_through_the_join(spark):
    """copies() end to end: every edit of 12 pictures is linked with it, nine of ten at least, and no two pictures are."""
    rng = np.random.default_rng(21)
    edits = {"crop": lambda a: a[8:82, 6:108], "0.6": lambda a: media.scaled(a, 0.6), "0.8": lambda a: media.scaled(a, 0.8), "1.25": lambda a: media.scaled(a, 1.25), "15": lambda a: turned(a, 15), "37": lambda a: turned(a, 37), "noise": lambda a: np.clip(a + rng.normal(size=a.shape) * 5, 0, 255)}
    rows = []
    pgm = lambda m: bytearray(b"P5 %d %d 255\n" % (m.shape[1], m.shape[0]) + m.astype(np.uint8).tobytes())
    for k in range(12):
        a = np.clip(128 + 60 * media.scaled(rng.normal(size=(24, 32)), 4), 0, 255)
        rows += [(100 * k, pgm(a))] + [(100 * k + 1 + i, pgm(f(a))) for i, f in enumerate(edits.values())]
    got = {r.id: r.component_id for r in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert all(got[i] // 100 == i // 100 for i in got)
    for i, name in enumerate(edits):
        assert sum(got[100 * k + 1 + i] == 100 * k for k in range(12)) >= 11, name


def test_media_finds_small_crops_of_large_images(spark):
    rng = np.random.default_rng(8)
    a = np.zeros((480, 640))
    for _ in range(700):
        y, x, h, w = rng.integers(0, 480), rng.integers(0, 640), rng.integers(5, 30), rng.integers(5, 30)
        a[y : y + h, x : x + w] += rng.normal() * 60
    a = np.clip(a + 128, 0, 255)
    pgm = lambda m: bytearray(b"P5 %d %d 255\n" % (m.shape[1], m.shape[0]) + m.astype(np.uint8).tobytes())
    rows = [(1, pgm(a)), (2, pgm(a[100:196, 200:328])), (3, pgm(a[300:390, 50:170])), (4, pgm(rng.integers(0, 256, (96, 128))))]
    got = {r.id: r.component_id for r in media.copies(spark.createDataFrame(rows, "id long, image binary")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4}


def test_pii_terms_seen_once_or_in_copies_only_disclose_nothing(spark):
    filler = " ".join(["the number is fine today and so on"] * 3)
    rows = [(i, f"the number is fine today and so on {i}") for i in range(400)]
    once, often = f"Zaphod {filler} zq@mail.example", [f"Zaphod {w} {filler} zq@mail.example" for w in OWN]
    found = lambda more: {r.term for r in pii.disclosing(docs(spark, rows + [(1000 + i, t) for i, t in enumerate(more)])).collect()}
    assert found([once]) == found([once] * 8) == set()
    assert found(often) == {"Zaphod"}
