"""Comparison of records that share a blocking key. A task holds the records of a key on both
sides (of a frequent key all candidates and a part of the queries) and compares them in place,
so that no pair is shuffled. Texts are ASCII."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import expr as X
from weftline.plans.blocks import KEYS
from weftline.storage import stored

#: Pairs that a part of a key forms, pairs compared at once and pairs whose distances are found at once, about.
PART, TILE, SLICE = 4_000_000, 1 << 18, 1 << 13
#: From so many pairs on distances are found by vectors.
FEW = 48


def grouped(records: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of each kind (the first of cp, bn, ba, or 3: content), key and part, candidates first,
    with what the earlier keys are. ``records`` have entity_id, src, the keys, content and columns."""
    records = stored(records.select("entity_id", (F.col("src") == "S1").alias("query"), *KEYS, "content", *columns), "compared")
    kinds = F.explode(F.array(*[
        F.struct(F.lit(k).alias("kind"), F.col(c).alias("key"), *[(F.col(e) if i < k else F.lit(None).cast("string")).alias(f"not_{e}") for i, e in enumerate(KEYS)])
        for k, c in enumerate((*KEYS, "content"))
    ])).alias("_")
    rows = records.select("entity_id", "query", "content", *columns, kinds).select("entity_id", "query", "content", *columns, "_.*").where("key IS NOT NULL")
    size = rows.groupBy("kind", "key").agg((F.count_if("query") * F.count_if(~F.col("query"))).alias("pairs")).where("pairs > 0")
    size = stored(size.select("*", F.ceil(F.col("pairs") / PART).cast("int").alias("parts")), "sizes")
    total = size.agg(F.sum("pairs")).first()[0] or 0
    own = F.array(F.pmod(F.xxhash64("entity_id"), F.col("parts")).cast("int"))
    part = F.explode(F.when(F.col("query"), own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = rows.join(size.drop("pairs"), ["kind", "key"]).withColumn("part", part).drop("parts")
    dealt = dealt.repartition(int(min(2000, max(24, 2 * total // PART))), "kind", "key", "part")
    return dealt.sortWithinPartitions("kind", "key", "part", "query")


def compared(rows: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """What ``kernel`` (a new one for each task) gives for each group of ``rows``, and at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, current, sides = kernel(), None, None
        for batch in batches:
            got = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            marks, query = list(zip(got["kind"], got["key"], got["part"], strict=True)), got["query"]
            at = 0
            while at < len(marks):
                end = at + 1
                while end < len(marks) and query[end] == query[at] and marks[end] == marks[at]:
                    end += 1
                if marks[at] != current:
                    if current is not None:
                        yield from _group(of, *sides)
                    current, sides = marks[at], ({c: [] for c in got}, {c: [] for c in got})
                for c, v in got.items():
                    sides[0 if query[at] else 1][c].extend(v[at:end])
                at = end
        if current is not None:
            yield from _group(of, *sides)
        yield from of.end()

    return rows.mapInArrow(run, schema)


def coded(one: list, two: list, missing: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Equal numbers for equal values of two lists; with ``missing`` a null equals none."""
    known: dict = {}
    a, b = (np.fromiter((known.setdefault(v, len(known)) for v in values), np.int64, len(values)) for values in (one, two))
    if missing and None in known:
        a[a == known[None]] = -1
        b[b == known[None]] = -2
    return a, b


def _group(of, one: dict, two: dict) -> Iterator[pa.RecordBatch]:
    """The pairs of a group, in tiles: those that no earlier key has."""
    if not one["entity_id"] or not two["entity_id"]:
        return
    earlier = [coded(one[f"not_{c}"], two[f"not_{c}"], missing=True) for c in KEYS[: one["kind"][0]]]
    #: equal texts one after the other
    order = sorted(range(len(one["entity_id"])), key=lambda k: one[of.order][k])
    made = None
    step = max(1, TILE // len(two["entity_id"]))
    for at in range(0, len(order), step):
        tile = np.array(order[at : at + step])
        ok = np.ones((len(tile), len(two["entity_id"])), bool)
        for a, b in earlier:
            ok &= a[tile][:, None] != b[None, :]
        if ok.any():
            if made is None:
                made = of.group(one, two)
            yield from of.tile(made, tile, ok)


def classes(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different pairs of the values of rows and columns where ``ok``: a, b, and the place of each."""
    one, x = np.unique(a, return_inverse=True)
    two, y = np.unique(b, return_inverse=True)
    keys = (x[:, None] * len(two) + y[None, :])[ok]
    seen = np.zeros(len(one) * len(two), bool)
    seen[keys] = True
    which = np.flatnonzero(seen)
    place = np.zeros(len(seen), np.int64)
    place[which] = np.arange(len(which))
    return one[which // len(two)], two[which % len(two)], place[keys]


def distance(a: str, b: str) -> int:
    """Levenshtein's, bit-parallel over a's places."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, n = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        plus, minus = down | ~(h | up) & full, up & h
        n += bool(plus & last) - bool(minus & last)
        plus, minus = (plus << 1 | 1) & full, minus << 1 & full
        up, down = minus | ~(x | plus) & full, plus & x
    return n


def _characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    n = np.array([len(t) for t in texts], np.int64)
    out = np.zeros((len(texts), max(1, int(n.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None, :] < n[:, None]] = np.frombuffer("".join(texts).encode("ascii"), np.uint8)
    return out, n


def distances(one: list[str], two: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Levenshtein's of the pairs one[a], two[b]; words of 64 places, one vector over many pairs."""
    if len(a) < FEW:
        return np.array([distance(one[i], two[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    out = np.zeros(len(a), np.int64)
    for at in range(0, len(a), SLICE):
        out[at : at + SLICE] = _distances(one, two, a[at : at + SLICE], b[at : at + SLICE])
    return out


def _distances(one: list[str], two: list[str], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    ua, a = np.unique(a, return_inverse=True)
    ub, b = np.unique(b, return_inverse=True)
    (x, nx), (y, ny) = _characters([one[i] for i in ua]), _characters([two[j] for j in ub])
    #: the longest text first, so that those under way are a head of the vectors
    order = np.argsort(-ny[b], kind="stable")
    a, b = a[order], b[order]
    words, bit = -(-x.shape[1] // 64), np.uint64(1)
    where = np.zeros((words, len(ua) * 128), np.uint64)
    for k in range(x.shape[1]):
        rows = np.flatnonzero(nx > k)
        where[k // 64, rows * 128 + x[rows, k]] |= bit << np.uint64(k % 64)
    n, last = nx[a].copy(), np.maximum(nx[a] - 1, 0)
    shift = (last % 64).astype(np.uint64)
    in_word = [(last // 64 == w).astype(np.uint64) for w in range(words)]
    up, down = np.full((words, len(a)), ~np.uint64(0)), np.zeros((words, len(a)), np.uint64)
    active = np.searchsorted(-ny[b], -np.arange(1, y.shape[1] + 1), side="right")
    text, base, top = np.ascontiguousarray(y.T), a * 128, np.uint64(63)
    for k in range(y.shape[1]):
        m = int(active[k])
        if not m:
            break
        at = base[:m] + text[k][b[:m]]
        plus_in, minus_in = np.ones(m, np.uint64), np.zeros(m, np.uint64)
        for w in range(words):
            p, q, eq = up[w, :m], down[w, :m], where[w][at]
            v = eq | q
            eq |= minus_in
            h = eq & p
            h += p
            h ^= p
            h |= eq
            plus = ~(h | p)
            plus |= q
            h &= p
            n[:m] += ((plus >> shift[:m]) & in_word[w][:m]).astype(np.int64)
            n[:m] -= ((h >> shift[:m]) & in_word[w][:m]).astype(np.int64)
            plus_out, minus_out = plus >> top, h >> top
            plus <<= bit
            plus |= plus_in
            h <<= bit
            h |= minus_in
            up[w, :m] = h | ~(v | plus)
            down[w, :m] = plus & v
            plus_in, minus_in = plus_out, minus_out
    n = np.where(nx[a] == 0, ny[b], n)
    out = np.zeros(len(n), np.int64)
    out[order] = n
    return out


def common(one: list[frozenset], two: list[frozenset], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many members the sets one[a] and two[b] share."""
    if len(a) < FEW:
        return np.array([len(one[i] & two[j]) for i, j in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    ua, x = np.unique(a, return_inverse=True)
    ub, y = np.unique(b, return_inverse=True)
    code: dict = {}
    for i in ua:
        for v in one[i]:
            code.setdefault(v, len(code))
    left = np.zeros((len(ua), max(1, len(code))), np.float32)
    for r, i in enumerate(ua):
        left[r, [code[v] for v in one[i]]] = 1
    out, width = np.zeros(len(a), np.int64), max(1, (1 << 22) // left.shape[1])
    order = np.argsort(y, kind="stable")
    bounds = np.searchsorted(y[order], np.arange(0, len(ub) + width, width))
    for k, at in enumerate(range(0, len(ub), width)):
        some = ub[at : at + width]
        right = np.zeros((left.shape[1], len(some)), np.float32)
        for c, j in enumerate(some):
            right[[code[v] for v in two[j] if v in code], c] = 1
        these = order[bounds[k] : bounds[k + 1]]
        out[these] = (left @ right)[x[these], y[these] - at]
    return out


def words(text: str) -> frozenset:
    return frozenset(t for t in text.split(" ") if t)


def grams(text: str) -> frozenset:
    """3-grams without spaces; a shorter text is its only one."""
    bare = text.replace(" ", "")
    return frozenset(bare[k : k + 3] for k in range(len(bare) - 2)) if len(bare) >= 3 else frozenset([bare] if bare else [])


#: names of the labels, a bit each: ``exact`` alone, ``other_variation`` if there is no other
NAME = ("exact", "other_variation", "case_only", "punctuation_only", "normalized_exact", "ampersand_and", *(f"suffix_{f}" for f in X.LEGAL_FORMS.values()), "word_order", "missing_or_extra_words", "minor_token_diff", "typo_or_substitution")
ADDRESS = ("exact", "other_variation", "case_only", "normalized_exact", *(f"abbrev_{f}" for f, ws in X.ADDRESS_FORMS.items() for _ in ws), "missing_numbers", "numeric_diff", "missing_postal", "postal_diff", "component_reorder")
LABELS = {"name": NAME, "address": ADDRESS}


def masks(d=X.SPARK) -> dict[str, str]:
    """Bits of the labels that one side's text gives: of legal forms in the name, of words in the address."""
    of = lambda x, first, patterns: " | ".join(f"(CASE WHEN {d.like(f"lower(coalesce({x}, ''))", p)} THEN {1 << first + k}L ELSE 0L END)" for k, p in enumerate(patterns))
    return {
        "name_mask": of("business_name", NAME.index("ampersand_and") + 1, list(X.LEGAL_FORMS)),
        "address_mask": of("business_address", ADDRESS.index("normalized_exact") + 1, [rf"\b{w}\b" for ws in X.ADDRESS_FORMS.values() for w in ws]),
    }


def _bits(names: tuple[str, ...], exact: np.ndarray, found: np.ndarray, flags: dict[str, np.ndarray]) -> np.ndarray:
    for label, holds in flags.items():
        found = found | holds.astype(np.int64) << names.index(label)
    return np.where(exact, 1, np.where(found == 0, 1 << names.index("other_variation"), found))


class Transforms:
    """Labels of how the names and addresses of pairs differ."""

    order, columns = "name", ("name", "nb", "nn", "name_mask", "addr", "ab", "an", "address_mask", "aset", "dg", "po")

    def group(self, one: dict, two: dict) -> dict:
        made = {"one": one, "two": two, "content": coded(one["content"], two["content"], missing=True)}
        for kind, columns in (("name", ("name", "nb", "nn", "name_mask")), ("addr", ("addr", "ab", "an", "address_mask", "aset", "dg", "po"))):
            #: different texts of both sides, and what follows from them
            rows: dict = {}
            for side in (one, two):
                for row in zip(*(side[c] for c in columns), strict=True):
                    rows.setdefault(row[0], row)
            place = {text: k for k, text in enumerate(rows)}
            made[kind] = tuple(np.array([place[t] for t in side[columns[0]]]) for side in (one, two))
            made[f"{kind}s"] = {c: [r[k] for r in rows.values()] for k, c in enumerate(columns)}
        n, a = made["names"], made["addrs"]
        swapped = [t.replace(" and ", " & ") for t in n["nb"]]
        both, _ = coded([*n["nb"], *swapped], [])
        n["nb_code"], n["swap_code"] = both[: len(swapped)], both[len(swapped) :]
        n["and_code"], n["nn_code"] = (coded(v, [])[0] for v in ([t.replace("&", "and") for t in n["nb"]], n["nn"]))
        n["has_and"] = np.array(["&" in t or " and " in t for t in n["nb"]])
        n["sets"] = [words(t) for t in n["nn"]]
        n["set_code"], n["set_size"], n["length"] = coded(n["sets"], [])[0], np.array([len(s) for s in n["sets"]]), np.array([len(t) for t in n["nn"]])
        for c in ("ab", "an", "aset", "dg", "po"):
            a[f"{c}_code"] = coded(a[c], [])[0]
        a["no_dg"], a["no_po"] = (np.array([not t for t in a[c]]) for c in ("dg", "po"))
        for v, c in ((n, "name_mask"), (a, "address_mask")):
            v[c] = np.array(v[c], np.int64)
        return made

    @staticmethod
    def names(n: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        eq = lambda c: n[c][x] == n[c][y]
        basic, normal, same = eq("nb_code"), eq("nn_code"), eq("set_code")
        spelled = (n["swap_code"][x] == n["nb_code"][y]) | (n["swap_code"][y] == n["nb_code"][x]) | eq("and_code")
        shared = common(n["sets"], n["sets"], x, y)
        near = ~same & (shared > 0) & (n["set_size"][x] + n["set_size"][y] - 2 * shared <= 2)
        sizes = n["set_size"][x] == n["set_size"][y]
        short, long = np.minimum(n["length"][x], n["length"][y]), np.maximum(n["length"][x], n["length"][y])
        #: their distance is the difference of their lengths at least
        may = np.flatnonzero((short > 3) & ~normal & (1 - (long - short) / np.maximum(long, 1) >= 0.7))
        typo = np.zeros(len(x), bool)
        typo[may] = 1 - distances(n["nn"], n["nn"], x[may], y[may]) / long[may] >= 0.7
        flags = {
            "case_only": basic, "punctuation_only": normal & ~basic, "normalized_exact": normal & basic, "ampersand_and": (n["has_and"][x] | n["has_and"][y]) & spelled,
            "word_order": same & ~normal, "missing_or_extra_words": near & ~sizes, "minor_token_diff": near & sizes, "typo_or_substitution": typo,
        }
        return _bits(NAME, x == y, n["name_mask"][x] | n["name_mask"][y], flags)

    @staticmethod
    def addresses(a: dict, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        eq = lambda c: a[c][x] == a[c][y]
        normal, flags = eq("an_code"), {"case_only": eq("ab_code")}
        flags |= {"normalized_exact": normal, "component_reorder": eq("aset_code") & ~normal}
        for c, missing, differ in (("dg", "missing_numbers", "numeric_diff"), ("po", "missing_postal", "postal_diff")):
            empty, other = a[f"no_{c}"][x] | a[f"no_{c}"][y], ~eq(f"{c}_code")
            flags |= {missing: other & empty, differ: other & ~empty}
        return _bits(ADDRESS, x == y, a["address_mask"][x] | a["address_mask"][y], flags)

    def labelled(self, made: dict, tile: np.ndarray, ok: np.ndarray) -> Iterator[tuple[str, np.ndarray]]:
        """For each field the bits of the pairs that are ``ok``."""
        for field, kind, f in (("name", "name", self.names), ("address", "addr", self.addresses)):
            one, two = made[kind]
            x, y, place = classes(one[tile], two, ok)
            yield field, f(made[f"{kind}s"], x, y)[place]


class Counts(Transforms):
    """Pairs by field, label of the difference and label of the pair."""

    schema = "field string, pattern string, label bigint, n bigint"

    def __init__(self):
        self.n: Counter = Counter()

    def tile(self, made: dict, tile: np.ndarray, ok: np.ndarray) -> tuple:
        one, two = made["content"]
        true = (one[tile][:, None] == two[None, :])[ok].astype(np.int64)
        for field, bits in self.labelled(made, tile, ok):
            values, n = np.unique(bits << 1 | true, return_counts=True)
            for v, m in zip(values.tolist(), n.tolist(), strict=True):
                self.n[field, v] += m
        return ()

    def end(self) -> Iterator[pa.RecordBatch]:
        out: Counter = Counter()
        for (field, v), n in self.n.items():
            for k, name in enumerate(LABELS[field]):
                if v >> k + 1 & 1:
                    out[field, name, v & 1] += n
        if out:
            yield pa.record_batch([*map(pa.array, zip(*out, strict=True)), pa.array(out.values())], ["field", "pattern", "label", "n"])


class Examples(Transforms):
    """Of each field and label of the difference the first pairs in the order of their ids."""

    schema = "field string, pattern string, s1_id string, cand_id string"

    def __init__(self, most: int):
        self.most, self.first = most, {}

    def tile(self, made: dict, tile: np.ndarray, ok: np.ndarray) -> tuple:
        ids = [made["one"]["entity_id"][k] for k in tile]
        by_id = np.array(sorted(range(len(ids)), key=ids.__getitem__))
        for field, bits in self.labelled(made, tile, ok):
            every = np.zeros(ok.shape, np.int64)
            every[ok] = bits
            any_of = np.bitwise_or.reduce(every, axis=1)
            found = int(np.bitwise_or.reduce(any_of))
            for k, name in enumerate(LABELS[field]):
                if found >> k & 1:
                    self.add(self.first.setdefault((field, name), []), ids, made["two"]["entity_id"], by_id[(any_of[by_id] >> k & 1) == 1], every, k)
        return ()

    def add(self, first: list, one: list[str], two: list[str], rows: np.ndarray, every: np.ndarray, k: int) -> None:
        #: no pair of a row beyond the first ``most`` can be among the first ``most``
        for r in rows[: self.most].tolist():
            if len(first) >= self.most and one[r] > first[-1][0]:
                return
            some = heapq.nsmallest(self.most, (two[c] for c in np.flatnonzero(every[r] >> k & 1).tolist()))
            first[:] = sorted({*first, *((one[r], c) for c in some)})[: self.most]

    def end(self) -> Iterator[pa.RecordBatch]:
        rows = [(*label, *pair) for label, pairs in self.first.items() for pair in pairs]
        if rows:
            yield pa.record_batch([pa.array(c) for c in zip(*rows, strict=True)], ["field", "pattern", "s1_id", "cand_id"])


def rounded(x: float) -> float:
    """To six places, as SQL rounds."""
    return float(Decimal(repr(x)).quantize(Decimal("0.000001"), ROUND_HALF_UP))


@cache
def _shares(one_less: bool, size: int) -> np.ndarray:
    """p / q (or 1 less it) for all p and q under ``size``, rounded."""
    return np.array([[rounded(1 - p / q if one_less else p / q) if q and p <= q else np.nan for q in range(size)] for p in range(size)])


def shares(p: np.ndarray, q: np.ndarray, none: float, one_less: bool = False) -> np.ndarray:
    """p / q, or 1 less it, rounded to six places; ``none`` where q is 0."""
    size = 64
    while size <= int(q.max(initial=0)):
        size *= 2
    return np.where(q == 0, none, _shares(one_less, size)[p, q])


class Features:
    """The thirteen features of pairs."""

    order, columns = "name", ("name", "nb", "nn", "addr", "ab", "an", "dg", "po", "country", "no_name", "no_addr")
    schema = (
        "s1_id string, cand_id string, label bigint, exact_name boolean, exact_address boolean, exact_country boolean, norm_name_eq boolean, norm_addr_eq boolean, name_sim double, addr_sim double, "
        "name_token_jaccard double, addr_token_jaccard double, name_trigram_jaccard double, addr_trigram_jaccard double, digit_jaccard double, postal_overlap boolean"
    )

    def group(self, one: dict, two: dict) -> dict:
        made = {"one": one, "two": two, "ids": (pa.array(one["entity_id"]), pa.array(two["entity_id"])), "content": coded(one["content"], two["content"], missing=True), "country": coded(one["country"], two["country"])}
        made["no_country"] = tuple(np.array([c is None for c in side["country"]]) for side in (one, two))
        made |= {c: tuple(np.array(side[c], bool) for side in (one, two)) for c in ("no_name", "no_addr")}
        for kind, columns in (("name", ("name", "nb", "nn")), ("addr", ("addr", "ab", "an", "dg", "po"))):
            rows: dict = {}
            for side in (one, two):
                for row in zip(*(side[c] for c in columns), strict=True):
                    rows.setdefault(row[0], row)
            place = {text: k for k, text in enumerate(rows)}
            made[kind] = tuple(np.array([place[t] for t in side[columns[0]]]) for side in (one, two))
            basic, normal = ([r[k] for r in rows.values()] for k in (1, 2))
            sets = [[words(t) for t in basic], [grams(t) for t in basic], *([words(r[k]) for r in rows.values()] for k in range(3, len(columns)))]
            made[f"{kind}s"] = {"normal": normal, "code": coded(normal, [])[0], "length": np.array([len(t) for t in normal]), "sets": sets, "sizes": [np.array([len(s) for s in of]) for of in sets]}
        return made

    @staticmethod
    def compare(v: dict, x: np.ndarray, y: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Whether the normal forms are equal and how similar they are, then of each set the share and number in common."""
        longest = np.maximum(v["length"][x], v["length"][y])
        both = [common(s, s, x, y) for s in v["sets"]]
        jaccard = [shares(n, size[x] + size[y] - n, 1.0) for n, size in zip(both, v["sizes"], strict=True)]
        return [v["code"][x] == v["code"][y], shares(distances(v["normal"], v["normal"], x, y), longest, 0.0, one_less=True), *jaccard], both

    def tile(self, made: dict, tile: np.ndarray, ok: np.ndarray) -> Iterator[pa.RecordBatch]:
        r, c = np.nonzero(ok)
        r = tile[r]
        at = lambda k: (made[k][0][r], made[k][1][c])
        same = lambda k: np.equal(*at(k))
        #: a missing value is neither equal nor not
        exact = [pa.array(same(k), mask=np.logical_or(*at(f"no_{k}"))) for k in ("name", "addr", "country")]
        x, y, place = classes(made["name"][0][tile], made["name"][1], ok)
        (nn, name_sim, name_tokens, name_grams), _ = self.compare(made["names"], x, y)
        u, v, where = classes(made["addr"][0][tile], made["addr"][1], ok)
        (an, addr_sim, addr_tokens, addr_grams, digits, _), both = self.compare(made["addrs"], u, v)
        named = [
            made["ids"][0].take(pa.array(r)), made["ids"][1].take(pa.array(c)), same("content").astype(np.int64), *exact, nn[place], an[where], name_sim[place], addr_sim[where],
            name_tokens[place], addr_tokens[where], name_grams[place], addr_grams[where], digits[where], (both[3] > 0)[where],
        ]
        yield pa.record_batch([v if isinstance(v, pa.Array) else pa.array(v) for v in named], [f.split()[0] for f in self.schema.split(", ")])

    def end(self) -> tuple:
        return ()
