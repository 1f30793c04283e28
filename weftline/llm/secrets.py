"""Secret scan: credential patterns, then a randomness test battery on long tokens.

Only SQL functions. Base kinds are found by pattern (leftmost, not overlapping
within a kind; matches that fail their length test are dropped). Any other
token of MIN_TOKEN or more characters of ``A-Za-z0-9+/_-`` is a candidate:

- its encoding is the smallest alphabet that holds it (hex, letters of one case,
  base32, base36, base62, base64); plain numbers are no candidates;
- under randomness: a chi-squared test of uniformity over the alphabet, a runs
  test (upper against lower half of the alphabet) and a lag-1 serial
  correlation test, Bonferroni-combined, must not reject at RANDOM_LEVEL;
- under ordinary text: letter pairs and changes of character class give the
  token's chance in ordinary text, and that over its chance in random text of its
  encoding bounds the p-value (Markov), which falls with the token's length; a
  Benjamini-Hochberg step over the document's candidates, weighted by the log of
  their length (of all lengths; weights sum to the candidates' number),
  controls false discoveries at FALSE_RATE.

What passes is a span of kind ``random`` unless it overlaps a base span.

Defined results: a null text is empty. Positions are code points, end
exclusive; spans of equal start are in the order assign, access, hex, random.
Rows, repeated ones and those without doc_id too, are scanned each on its own;
other columns don't matter, and an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.storage import table

#: The base kinds' patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
MIN_TOKEN = 20
TOKEN = rf"[A-Za-z0-9+/_-]{{{MIN_TOKEN},}}"
RANDOM_LEVEL = 0.01
FALSE_RATE = 0.001
#: Chances of the next character's class in ordinary text, after a lower-case letter, a capital, a digit and a sign.
CLASS_NEXT = ((0.85, 0.05, 0.03, 0.07), (0.3, 0.6, 0.05, 0.05), (0.1, 0.1, 0.7, 0.1), (0.5, 0.2, 0.2, 0.1))
MASK = "[SECRET]"

#: Minus log chance of a first letter and of the next letter after a, b, ..., in quarters, as digits of base 36 (from words and names
#: of program text, log-weighted, smoothed).
_FIRST = "bdacccfgbjiddcdckcabfgejkk"
_NEXT = (
    "iecdgifmdoi8c9jeo898ghkifn 8jdg8jklbcn8jiahnddf9nnmbn 9lhi8kladocbji6jodg8emnnjo 9jid5gjl8nnejhajnfcddlmjio "
    "ckcadeglhomce9ieg78akhjcin 9kiiabkl6oncjh7jo9edbnnnho ckii5kfbaondgccinaaeckmnkm 7lkj5lll9omhii8kodgbfnnnio "
    "egcddeemiokcc6afnea9lgoimg alih4kklemhijh7hohah9gmmkn dkhg4jhk8nmcidghngafgjcnjo 9kjd6fll8omakiahohbccklndo "
    "7eki5llmbomgega8oidhdmmnio alb99f9lcojgjfagoia8egmmio ffebffhmgnicc7ecn7dbbgelmn 8ljg7klidpmaki9co9ebemnnbo "
    "elkhgklliojcjhijlffg1llnmo 9kgf6jflaohhed9jobcaejknfo emej6jjeaohgihcdlh96clknho alfi6il98omgiibhoacddmjmcl "
    "ceeg9ghmdon9b8hbo9a9knommo 5ljk3lll9onjiiekoihhknmnlo 7kjh9kl96omhkcakoadhkmmmmo bh8g8emk9nnggih8nhg7kmlkgn "
    "fhggcihldomeedd5ne88kjfllj alkh2jljaomhiibinighjmmkhj "
).split()
#: Alphabets of the encodings, smallest first.
_ALPHABETS = {
    "hex": ("^[0-9a-f]+$", "0123456789abcdef"),
    "HEX": ("^[0-9A-F]+$", "0123456789ABCDEF"),
    "lower": ("^[a-z]+$", "abcdefghijklmnopqrstuvwxyz"),
    "UPPER": ("^[A-Z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base32": ("^[A-Z2-7]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    "base36": ("^[0-9a-z]+$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    "BASE36": ("^[0-9A-Z]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    "base62": ("^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    "base64": ("", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _tail(z: Column) -> Column:
    """Upper tail of the normal distribution (Abramowitz and Stegun 26.2.17)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    up = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, up).otherwise(1 - up)


def _two_sided(z: Column) -> Column:
    return 2 * _tail(F.abs(z))


_SPAN = "array<struct<start:bigint,ord:int,end:bigint>>"


def _found(text: Column, pattern: str, kind: int, keep) -> Column:
    """Spans of a pattern's matches m (i: number) for which keep(m, i) holds."""
    parts = F.struct(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))

    def walk(p: Column) -> Column:
        zero = F.struct(F.length(p["gap"][0]).cast("long").alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(acc: Column, i: Column) -> Column:
            n = F.length(p["m"][i]).cast("long")
            span = F.struct(acc["at"].alias("start"), F.lit(kind).alias("ord"), (acc["at"] + n).alias("end"))
            more = F.when(keep(p["m"][i], i), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct((acc["at"] + n + F.length(p["gap"][i + 1])).alias("at"), more.alias("out"))

        return F.aggregate(F.sequence(F.lit(0), F.size(p["m"]) - 1), zero, step)["out"]

    return F.when(text.rlike(pattern), let(parts, walk)).otherwise(F.array().cast(_SPAN))


def base_spans(text: Column) -> Column:
    values = F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2))
    assign = F.when(
        text.rlike(ASSIGN),
        let(values, lambda v: _found(text, ASSIGN, 0, lambda m, i: F.length(v[i]) >= 6)),
    ).otherwise(F.array().cast(_SPAN))
    access = _found(text, ACCESS, 1, lambda m, i: F.length(m) >= 20)
    #: runs are maximal, so those long enough can be asked for at once
    hexes = _found(text, HEX[:-1] + "{24,}", 2, lambda m, i: F.lit(True))
    return F.array_sort(F.concat(assign, access, hexes))


def _ordinary_cost(chars: Column) -> Column:
    """Minus the log chance of a token's characters (+ and / for signs) in ordinary text."""
    numbers = lambda v: F.array(*[F.lit(float(x)) for x in v])
    quarters = lambda text: numbers(int(c, 36) / 4 for c in text)
    first, follows, classes = quarters(_FIRST), quarters("".join(_NEXT)), numbers(-math.log(p) for row in CLASS_NEXT for p in row)
    kind = lambda x: F.when(x < 26, 0).when(x < 52, 1).when(x < 62, 2).otherwise(3)

    def step(p: Column, q: Column) -> Column:
        letter = F.when(p < 52, F.get(follows, p % 26 * 26 + q % 26)).otherwise(F.get(first, q % 26))
        return F.get(classes, kind(p) * 4 + kind(q)) + F.when(q < 52, letter).when(q < 62, math.log(10)).otherwise(math.log(2))

    def total(x: Column) -> Column:
        head = F.when(x[0] < 52, F.get(first, x[0] % 26)).when(x[0] < 62, math.log(10)).otherwise(math.log(2))
        costs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), step)
        return head + F.aggregate(costs, F.lit(0.0), lambda a, c: a + c)

    order = F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/")
    return let(F.transform(chars, lambda c: F.instr(order, c) - 1), total)


def _p_ordinary_and_random(token: Column) -> Column:
    """struct(natural, random): p-values of a token as ordinary text and as random."""
    code = F.lit("base64")
    for name, (pattern, _) in reversed(list(_ALPHABETS.items())[:-1]):
        code = F.when(token.rlike(pattern), F.lit(name)).otherwise(code)

    def battery(t: Column) -> Column:
        text = F.translate(t["token"], "-_", "+/")
        n = F.length(text).cast("double")
        alphabet = F.create_map(*[F.lit(x) for k, (_, a) in _ALPHABETS.items() for x in (k, a)])[t["code"]]
        return let(F.struct(text.alias("text"), n.alias("n"), alphabet.alias("alphabet")), tests)

    def tests(t: Column) -> Column:
        text, n, k = t["text"], t["n"], F.length(t["alphabet"]).cast("double")
        chars = F.split(text, "")
        chars = F.filter(chars, lambda c: c != "")
        counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
        squares = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c)
        value = F.transform(chars, lambda c: F.instr(t["alphabet"], c).cast("double") - 1)
        return let(F.struct(squares.alias("squares"), value.alias("x"), n.alias("n"), k.alias("k"), chars.alias("chars")), combine)

    def combine(t: Column) -> Column:
        n, k, x = t["n"], t["k"], t["x"]
        df = k - 1
        chi = t["squares"] * k / n - n
        z_chi = (F.pow(chi / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        upper = F.transform(x, lambda v: (v * 2 >= k).cast("int"))
        ones = F.aggregate(upper, F.lit(0.0), lambda a, v: a + v)
        pairs = F.zip_with(F.slice(x, 1, F.size(x) - 1), F.slice(x, 2, F.size(x) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + ((p["a"] * 2 >= k) != (p["b"] * 2 >= k)).cast("double"))
        mid = (k - 1) / 2
        serial = F.aggregate(pairs, F.lit(0.0), lambda s, p: s + (p["a"] - mid) * (p["b"] - mid))
        z_serial = serial / (F.sqrt(n - 1) * (k * k - 1) / 12)
        mean = 2 * ones * (n - ones) / n
        z_runs = F.when((ones == 0) | (ones == n), F.lit(9.0)).otherwise((turns - mean) / F.sqrt(F.greatest(mean * (mean - 1) / (n - 1), F.lit(1e-9))))
        random = F.least(F.lit(1.0), 3 * F.least(_two_sided(z_chi), _two_sided(z_runs), _two_sided(z_serial)))
        #: ordinary text: usual letter pairs, few changes of class
        natural = F.exp(F.least(F.lit(0.0), n * F.log(k) - _ordinary_cost(t["chars"])))
        return F.struct(natural.alias("natural"), random.alias("random"), n.alias("n"))

    return let(F.struct(token.alias("token"), code.alias("code")), battery)


def random_spans(text: Column) -> Column:
    """Spans of the tokens that the battery takes for secrets."""
    spans = _found(text, TOKEN, 3, lambda m, i: ~m.rlike("^[0-9]+$"))

    def tested(all_: Column) -> Column:
        each = F.transform(all_, lambda s: F.struct(s.alias("span"), _p_ordinary_and_random(F.substring(text, s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int"))).alias("p")))
        return let(each, discovered)

    def discovered(each: Column) -> Column:
        m = F.size(each)
        weight = F.aggregate(each, F.lit(0.0), lambda a, e: a + F.log(e["p"]["n"])) / m
        scaled = F.transform(each, lambda e: F.struct(e["span"].alias("span"), e["p"]["random"].alias("random"), (e["p"]["natural"] * weight / F.log(e["p"]["n"])).alias("q")))
        return let(scaled, lambda s: stepped(s, m))

    def stepped(scaled: Column, m: Column) -> Column:
        order = F.array_sort(F.transform(scaled, lambda e: e["q"]))
        most = F.array_max(F.filter(F.transform(order, lambda q, i: F.when(q <= (i + 1) * FALSE_RATE / m, q)), lambda q: q.isNotNull()))
        return let(F.coalesce(most, F.lit(-1.0)), lambda most: F.transform(F.filter(scaled, lambda e: (e["q"] <= most) & (e["random"] >= RANDOM_LEVEL)), lambda e: e["span"]))

    return let(spans, lambda s: F.when(F.size(s) > 0, tested(s)).otherwise(F.array().cast(_SPAN)))


def all_spans(text: Column) -> Column:
    """struct(base, spans): sorted base spans, and they with the random ones beside them."""
    return let(base_spans(text), lambda b: let(random_spans(text), lambda r: F.struct(
        b.alias("base"),
        F.array_sort(F.concat(b, F.filter(r, lambda x: ~F.exists(b, lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"]))))).alias("spans"),
    )))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["ord"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["ord"] == kind)).cast("long")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256 and spans of each document."""
    found = docs.select("doc_id", all_spans(F.coalesce("text", F.lit(""))).alias("f"))
    base = F.col("f.base")
    return found.select(
        "doc_id", *[_count(base, k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("f.spans")).alias("spans")
    )


def redact(docs: DataFrame) -> DataFrame:
    """The documents, in their own columns, with every span replaced by MASK; a
    null text stays null. Overlapping spans become one mask; n_chars follows."""
    text = F.col("text")

    def masked(spans: Column) -> Column:
        zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            gap = F.substring(text, acc["at"].cast("int") + 1, F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
            fresh = (s["start"] >= acc["at"]) | (acc["at"] == 0)
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], gap, F.when(fresh, F.lit(MASK)).otherwise(F.lit(""))).alias("out"))

        end = F.aggregate(spans, zero, step)
        return let(end, lambda e: F.concat(e["out"], F.substring(text, e["at"].cast("int") + 1, F.length(text))))

    clean = let(all_spans(F.coalesce("text", F.lit("")))["spans"], lambda s: F.when(F.size(s) > 0, masked(s)).otherwise(text))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
