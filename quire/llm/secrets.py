"""Secret scans: fixed patterns plus a randomness test battery.

Tokens of 20 characters or more get the smallest of ENCODINGS that has all their symbols, padding left out; digits alone are no
secret. On the places of the symbols in that alphabet three tests ask whether the token may be random: Pearson's chi-squared statistic
of uniformity over the whole alphabet, the number of runs above and below the middle of the alphabet, and the correlation of
neighbours. How unlikely ordinary text is to look so even is a p-value: the sum of squared symbol counts, which orders tokens as the
chi-squared statistic does, has a mean and variance under text that follow from the corpus's own letter frequencies (all letters
of all texts; a text weighs as WEIGHT letters at most) and grow with the length; its lower tail, times the chance that all letters fall into the alphabet,
is p. Benjamini-Hochberg thresholds per length band bound the false discoveries. Discoveries that pass the three tests are
added as kind random, where they overlap no pattern match.

Only DataFrame functions are used. Offsets are code points, end exclusive. A null or empty text has no span. Every row
gives a row, repeated or not, with or without doc_id; other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, saved, table

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # the first AKIA of a run is its longest match, so the length can be asked for here
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ["assign", "access", "hex", "random"]
#: False discovery rate; two-sided level of each of the three tests, as normal deviate.
FDR, DEVIATE = 0.01, 2.81
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Alphabets in order of size; the first that has all symbols is taken. - and _ count as + and /.
ENCODINGS = [
    ("hex", "0123456789abcdef"),
    ("HEX", "0123456789ABCDEF"),
    ("letters", LETTERS),
    ("LETTERS", LETTERS.upper()),
    ("base32", LETTERS.upper() + "234567"),
    ("base36", LETTERS + "0123456789"),
    ("BASE36", LETTERS.upper() + "0123456789"),
    ("base52", LETTERS.upper() + LETTERS),
    ("base62", LETTERS.upper() + LETTERS + "0123456789"),
    ("base64", LETTERS.upper() + LETTERS + "0123456789+/"),
]
#: Most letters that a text adds to the frequencies.
WEIGHT = 10_000
BLOCK = 256


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches."""
    pieces, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def place(z: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(z, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
        before = let(blocks, lambda s: F.transform(s, lambda _, b: F.aggregate(F.slice(s, F.lit(1), b), F.lit(0), lambda a, x: a + x)))

        def at(x: Column, i: Column, sums: Column) -> Column:
            b = F.floor(i / BLOCK).cast("int")
            start = sums[b] + F.aggregate(F.slice(z, b * BLOCK + 1, i - b * BLOCK), F.lit(0), lambda a, y: a + y["gap"] + y["len"]) + x["gap"]
            return F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["match"].alias("match"))

        return F.when(F.size(z) > 0, let(before, lambda sums: F.transform(z, lambda x, i: at(x, i, sums))))

    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    zipped = let(matches, lambda m: F.when(F.size(m) > 0, F.zip_with(F.slice(pieces, F.lit(1), F.size(m)), m, lambda p, x: F.struct(F.length(p).alias("gap"), F.length(x).alias("len"), x.alias("match")))).otherwise(F.array().cast("array<struct<gap:int,len:int,match:string>>")))
    return let(zipped, lambda z: F.coalesce(place(z), none))


def symbols(token: Column) -> Column:
    return F.split(token, "")


def counts(token: Column) -> Column:
    """How often each symbol of the token occurs."""
    return F.transform(F.array_distinct(symbols(token)), lambda c: (F.length(token) - F.length(F.replace(token, c, F.lit("")))).cast("double"))


def plain(token: Column) -> Column:
    """Without padding, in the standard spelling."""
    return F.translate(F.regexp_replace(token, "=+$", ""), "-_", "+/")


def alphabet(token: Column) -> Column:
    """The encoding's symbols; null for digits alone and for = within."""
    out = F.when(token.rlike("^[0-9]*$"), F.lit(None).cast("string"))
    for _, symbols_of in ENCODINGS:
        out = out.when(token.rlike(f"^[{symbols_of}]+$"), F.lit(symbols_of))
    return out


def battery(start: Column, end: Column, token: Column, letters: Column) -> Column:
    """n symbols of k, letters among them, sum of squared counts; normal deviates of uniformity, runs and serial correlation."""
    n, k = F.length(token).cast("double"), F.length(letters).cast("double")
    values = F.transform(symbols(token), lambda c: F.position(c, letters).cast("double") - 1)
    middle = (k - 1) / 2

    def steps(v: Column, join) -> Column:
        return F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), join)

    def added(v: Column) -> Column:
        return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)

    def runs(up: Column) -> Column:
        def z(above: Column) -> Column:
            below = n - above
            turns = added(steps(up, lambda a, b: (a != b).cast("double"))) + 1
            expect = 2 * above * below / n + 1
            var = (expect - 1) * (expect - 2) / (n - 1)
            return F.when((above > 0) & (below > 0) & (var > 0), (turns - expect) / F.sqrt(var)).otherwise(F.lit(99.0))

        return let(added(up), z)

    def serial(v: Column) -> Column:
        def z(mean: Column) -> Column:
            square = added(F.transform(v, lambda x: (x - mean) * (x - mean)))
            lagged = added(steps(v, lambda a, b: (a - mean) * (b - mean)))
            return let(square, lambda q: F.when(q > 0, (lagged / q + 1 / n) * F.sqrt(n)).otherwise(F.lit(99.0)))

        return let(added(v) / n, z)

    def whole(v: Column) -> Column:
        def out(squares: Column) -> Column:
            even = (k * squares / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
            n_letters = F.length(F.regexp_replace(token, "[^A-Za-z]", "")).cast("double")
            up = F.transform(v, lambda x: (x > middle).cast("double"))
            return F.struct(start.alias("start"), end.alias("end"), n.alias("n"), k.alias("k"), n_letters.alias("letters"), squares.alias("squares"), even.alias("even"), let(up, runs).alias("runs"), serial(v).alias("serial"))

        return let(F.aggregate(counts(token), F.lit(0.0), lambda a, x: a + x * x), out)

    return let(values, whole)


def letter_shares(docs: DataFrame) -> list[float]:
    """Of a to z among the letters of all texts; an even share each where there are none."""
    low = F.lower(F.coalesce("text", F.lit("")))
    held = docs.select(low.alias("low")).select(*[(F.octet_length("low") - F.octet_length(F.replace("low", F.lit(c), F.lit("")))).cast("double").alias(c) for c in LETTERS])
    total = sum((F.col(c) for c in LETTERS), F.lit(0.0))
    share = F.when(total > WEIGHT, WEIGHT / total).otherwise(1.0)
    sums = held.agg(*[F.sum(F.col(c) * share).alias(c) for c in LETTERS]).first()
    whole = sum(x or 0.0 for x in sums)
    return [(x or 0.0) / whole if whole else 1 / 26 for x in sums]


def scanned(docs: DataFrame) -> DataFrame:
    """Per row the pattern spans and the tested tokens."""
    text = F.coalesce(F.col("text"), F.lit(""))
    kind = lambda name, found: F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(name)).alias("kind"), x["end"].alias("end")))
    assign = F.filter(located(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["match"], ASSIGN, 2)) >= 6)
    base = F.concat(kind("assign", assign), kind("access", located(text, ACCESS)), kind("hex", located(text, HEX)))
    out = docs.select("doc_id", F.array_sort(base).alias("base"), located(text, TOKEN).alias("tokens"))
    free = lambda x: ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))
    coded = F.transform(F.filter("tokens", free), lambda x: let(plain(x["match"]), lambda t: F.struct(x["start"].alias("start"), x["end"].alias("end"), t.alias("token"), alphabet(t).alias("letters"))))
    coded = F.filter(coded, lambda x: x["letters"].isNotNull() & (F.length(x["token"]) >= 2))
    return out.select("doc_id", "base", F.transform(coded, lambda x: battery(x["start"], x["end"], x["token"], x["letters"])).alias("tested"))


def tail(z: Column) -> Column:
    """Probability that a normal deviate is below z, for z below 0 (Abramowitz and Stegun 26.2.17); 1 otherwise."""
    t = 1 / (1 - 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.when(z < 0, F.greatest(F.exp(-z * z / 2) * 0.3989422804014327 * poly, F.lit(1e-30))).otherwise(F.lit(1.0))


def band(n: Column) -> Column:
    """Length band: tests on short tokens say less, so they answer for their own false discoveries."""
    return F.when(n < 28, 0).when(n < 40, 1).when(n < 64, 2).otherwise(3)


def with_p(tested: Column, shares: list[float]) -> Column:
    """start, end, length band, p under ordinary text, and whether the three tests leave the token random."""
    inside = sum(shares[:6]) or 1.0  # hex has six letters

    def moment(power: int, of_hex: Column) -> Column:
        whole, part = sum(q**power for q in shares), sum((q / inside) ** power for q in shares[:6])
        return F.when(of_hex, part).otherwise(whole)

    def p(x: Column) -> Column:
        n, of_hex = x["n"], x["k"] == 16
        two, three = moment(2, of_hex), moment(3, of_hex)
        mean = n + n * (n - 1) * two
        var = 2 * n * (n - 1) * (two + 2 * (n - 2) * three - (2 * n - 3) * two * two)
        chance = F.when(of_hex, F.pow(F.lit(min(1.0, inside)), x["letters"])).otherwise(1.0)
        value = F.greatest(tail((x["squares"] - mean + 0.5) / F.sqrt(F.greatest(var, F.lit(1e-9)))) * chance, F.lit(1e-30))
        passes = (F.abs(x["even"]) < DEVIATE) & (F.abs(x["runs"]) < DEVIATE) & (F.abs(x["serial"]) < DEVIATE)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), band(n).alias("band"), value.alias("p"), passes.alias("free"))

    return F.transform(tested, p)


def thresholds(histogram: list, rate: float = FDR) -> dict[int, float]:
    """Benjamini-Hochberg per band, from rows (band, cell, n); cell c holds p-values up to 10 ** (-c / 50)."""
    out: dict[int, float] = {}
    for b in {r["band"] for r in histogram}:
        cells = sorted(((r["cell"], r["n"]) for r in histogram if r["band"] == b), reverse=True)
        m, seen, out[b] = sum(n for _, n in cells), 0, -1.0
        for c, n in cells:
            seen += n
            if 10 ** (-c / 50) <= rate * seen / m:
                out[b] = 10 ** (-c / 50)
    return out


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and spans: sorted array of (start, kind, end), kind a number in KINDS; base: those of the patterns."""
    shares = letter_shares(docs)
    rows = saved(scanned(docs))
    rows = rows.select("doc_id", "base", with_p(F.col("tested"), shares).alias("tested"))
    cells = rows.select(F.explode("tested").alias("x")).select("x.band", F.floor(-50 * F.log10("x.p")).cast("int").alias("cell"))
    at = thresholds(cells.groupBy("band", "cell").agg(F.count("*").alias("n")).collect())
    limit = lambda x: F.element_at(F.array(*[F.lit(at.get(b, -1.0)) for b in range(4)]), x["band"] + 1)
    added = F.transform(F.filter("tested", lambda x: (x["p"] <= limit(x)) & x["free"]), lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), x["end"].alias("end")))
    return rows.select("doc_id", F.array_sort("base").alias("base"), F.array_sort(F.concat("base", added)).alias("spans"))


def written(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", name[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    n = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return secrets(table(spark, sf_dir, "documents")).select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
