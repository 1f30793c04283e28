"""How alike the records of pairs are, found in tasks that hold a key's records of both sides
(``compare``): once for each two different names and each two different addresses."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from weftline.operators import compare, ratios, scoring

#: Most numbers of a dense table of members.
DENSE = 1 << 22


class Sets:
    """Sets, or vectors where ``weights`` has those of their members."""

    def __init__(self, sets: list, weights: list | None = None):
        known: dict = {}
        self.n = np.array([len(s) for s in sets], np.int64)
        self.member = np.fromiter((known.setdefault(v, len(known)) for s in sets for v in s), np.int64, int(self.n.sum()))
        self.start, self.known = np.concatenate([[0], np.cumsum(self.n)]), len(known)
        self.weight = None if weights is None else np.fromiter((w for ws in weights for w in ws), np.float64, len(self.member))

    def _of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``member`` and the row of each."""
        n = self.n[rows]
        row = np.repeat(np.arange(len(rows)), n)
        return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.start[rows][row], row

    def products(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """How many members each two share, or the products of the vectors."""
        kind = np.float32 if self.weight is None else np.float64
        value = lambda at: 1 if self.weight is None else self.weight[at]
        at, row = self._of(rows)
        known, place = np.unique(self.member[at], return_inverse=True)
        left, where = np.zeros((len(rows), len(known)), kind), np.full(self.known, -1)
        left[row, place] = value(at)
        where[known] = np.arange(len(known))
        out, width = np.zeros((len(rows), len(columns)), kind), max(1, DENSE // max(1, len(known)))
        for k in range(0, len(columns), width):
            at, row = self._of(columns[k : k + width])
            place = where[self.member[at]]
            at, row, place = at[place >= 0], row[place >= 0], place[place >= 0]
            right = np.zeros((len(known), len(columns[k : k + width])), kind)
            right[place, row] = value(at)
            out[:, k : k + width] = left @ right
        return out if self.weight is not None else out.astype(np.int64)

    def jaccard(self, rows: np.ndarray, columns: np.ndarray, both: np.ndarray | None = None) -> np.ndarray:
        """1 of two empty sets."""
        both = self.products(rows, columns) if both is None else both
        either = self.n[rows][:, None] + self.n[columns][None, :] - both
        return np.where(either == 0, 1.0, both / np.maximum(either, 1))


class Different:
    """Different rows of some columns on both sides: their values by column, and the place of each record's."""

    def __init__(self, one: dict, two: dict, columns: tuple[str, ...]):
        rows: dict = {}
        self.at = tuple(np.array([rows.setdefault(row, len(rows)) for row in zip(*(side[c] for c in columns), strict=True)]) for side in (one, two))
        self.values = dict(zip(columns, map(list, zip(*rows, strict=True)), strict=True))

    def __getitem__(self, column: str) -> list:
        return self.values[column]

    def tile(self, tile: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Places of the rows ``tile`` and of the columns ``some``, and of each record its place among these."""
        x, r = np.unique(self.at[0][tile], return_inverse=True)
        y, c = np.unique(self.at[1][some], return_inverse=True)
        return x, y, r, c


def _lengths(n: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Difference and ratio of lengths."""
    a, b = n[x][:, None], n[y][None, :]
    longest = np.maximum(a, b)
    return np.abs(a - b), np.where(longest == 0, 1.0, np.minimum(a, b) / np.maximum(longest, 1))


def _equal(code: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether values are equal, of which -1 is none."""
    return (code[x][:, None] == code[y][None, :]) & (code[x] >= 0)[:, None]


def _codes(values: list, none: tuple) -> np.ndarray:
    known: dict = {}
    return np.array([-1 if v in none else known.setdefault(v, len(known)) for v in values], np.int64)


class Kernel:
    """Columns of pairs from values of their different names, addresses and countries."""

    def group(self, one: dict, two: dict) -> dict:
        made = {k: Different(one, two, columns) for k, columns in self.parts.items()}
        return made | {"ids": (pa.array(one["entity_id"]), pa.array(two["entity_id"])), "content": compare.coded(one["content"], two["content"], missing=True), "kind": one["kind"][0], "two": two["entity_id"], "forms": {}}

    @staticmethod
    def once(made: dict, form: str, make):
        """A form of a group's values, made when it is first needed."""
        if form not in made["forms"]:
            made["forms"][form] = make()
        return made["forms"][form]

    def tile(self, made: dict, tile: np.ndarray, ok: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(ok.any(axis=0))
        r, c = np.nonzero(ok[:, some])
        found = {"s1_id": made["ids"][0].take(pa.array(tile[r])), "cand_id": made["ids"][1].take(pa.array(some[c]))}
        one, two = made["content"]
        found["label"] = one[tile][r] == two[some][c]
        found["in_retrieval"] = np.full(len(r), made["kind"] < len(compare.KEYS))
        for part in self.parts:
            x, y, p, q = made[part].tile(tile, some)
            at = p[r] * len(y) + q[c]
            for name, values in getattr(self, part)(made, x, y).items():
                found[name] = values.ravel()[at]
        self.last(made, tile[r], some[c], found)
        fields = [f.split() for f in self.schema.split(", ")]
        yield pa.record_batch([v if isinstance(v := found[name], pa.Array) else pa.array(v.astype(TYPES[kind])) for name, kind in fields], [f[0] for f in fields])

    def last(self, made: dict, r: np.ndarray, c: np.ndarray, found: dict) -> None:
        """Columns of records ``r`` and ``c``."""

    def end(self) -> tuple:
        return ()


TYPES = {"double": np.float64, "float": np.float32, "int": np.int32, "tinyint": np.int8, "boolean": bool}


class Fuzzy(Kernel):
    """The four ratios of names."""

    order, columns, parts = "n", ("n",), {"names": ("n",)}
    schema = "s1_id string, cand_id string, ratio double, token_sort_ratio double, token_set_ratio double, wratio double"

    def names(self, made: dict, x: np.ndarray, y: np.ndarray) -> dict:
        texts = self.once(made, "n", lambda: ratios.Texts(made["names"]["n"]))
        return dict(zip(("ratio", "token_sort_ratio", "token_set_ratio", "wratio"), ratios.fuzzy(texts.take(x), texts.take(y)), strict=True))


class Features(Kernel):
    """The 24 features of pairs (``scoring.FEATURES``), without evidence."""

    order = "name"
    columns = ("name", "n", "b", "sql_name", "prefix", "addr", "a", "sql_addr", "digits", "country", "known")
    parts = {"names": ("name", "n", "b", "sql_name", "prefix"), "addresses": ("addr", "a", "sql_addr", "digits"), "countries": ("country", "known")}
    schema = ", ".join(["s1_id string, cand_id string, label int, in_retrieval boolean", *(f"{f} double" for f in scoring.FEATURES)])

    def names(self, made: dict, x: np.ndarray, y: np.ndarray) -> dict:
        v, once = made["names"], self.once
        texts = once(made, "n", lambda: ratios.Texts(v["n"]))
        n = once(made, "n_length", lambda: np.array([len(t) for t in v["n"]]))
        same = _equal(once(made, "sql_name", lambda: _codes(v["sql_name"], ("",))), x, y)
        plain, ordered, sets, weighted = ratios.fuzzy(texts.take(x), texts.take(y))
        differ, share = _lengths(n, x, y)
        return {
            "name_exact_sql_norm": same, "ctx_same_sql_norm_name": same, "name_fuzz_ratio": plain, "name_fuzz_wratio": weighted, "name_fuzz_token_set_ratio": sets, "name_fuzz_token_sort_ratio": ordered,
            "name_token_jaccard": once(made, "b", lambda: Sets([compare.words(t) for t in v["b"]])).jaccard(x, y),
            "name_char_ngram_jaccard": once(made, "grams", lambda: Sets([compare.grams(t) for t in v["n"]])).jaccard(x, y),
            "name_len_diff": differ, "name_len_ratio": share, "prefix": _equal(once(made, "prefix", lambda: _codes([t if len(t) >= 3 else "" for t in v["prefix"]], ("",))), x, y),
        }

    def addresses(self, made: dict, x: np.ndarray, y: np.ndarray) -> dict:
        v, once = made["addresses"], self.once
        texts = once(made, "a", lambda: ratios.Texts(v["a"]))
        same = _equal(once(made, "sql_addr", lambda: _codes(v["sql_addr"], ("",))), x, y)
        plain, sets = ratios.fuzzy_address(texts.take(x), texts.take(y))
        digits = once(made, "digits", lambda: Sets([compare.words(t) for t in v["digits"]]))
        both = digits.products(x, y)
        differ, share = _lengths(once(made, "a_length", lambda: np.array([len(t) for t in v["a"]])), x, y)
        return {
            "addr_exact_sql_norm": same, "ctx_same_sql_norm_addr": same, "addr_fuzz_ratio": plain, "addr_fuzz_token_set_ratio": sets,
            "addr_token_jaccard": once(made, "tokens", lambda: Sets([compare.words(t) for t in v["a"]])).jaccard(x, y),
            "addr_numeric_overlap_count": both, "addr_numeric_jaccard": digits.jaccard(x, y, both), "addr_len_diff": differ, "addr_len_ratio": share,
        }

    def countries(self, made: dict, x: np.ndarray, y: np.ndarray) -> dict:
        v = made["countries"]
        return {"country": _equal(_codes(v["country"], (None,)), x, y), "ctx_country_match": _equal(_codes(v["known"], ("UNKNOWN",)), x, y)}

    def last(self, made: dict, r: np.ndarray, c: np.ndarray, found: dict) -> None:
        found["ctx_same_cp_key"] = found["country"] & found["prefix"]
        sources = self.once(made, "sources", lambda: np.array([i[:2] for i in made["two"]]))[c]
        found |= {"ctx_candidate_is_s2": sources == "S2", "ctx_candidate_is_s3": sources == "S3", "ctx_retrieval_evidence_count": np.zeros(len(r))}


class SixFeatures(Kernel):
    """The six features of pairs; the grams' weights are those of ``idf``."""

    order = "name"
    columns = ("name", "n", "b", "addr", "a", "country", "text")
    parts = {"names": ("name", "n", "b"), "addresses": ("addr", "a"), "texts": ("text",), "countries": ("country",)}
    schema = "s1_id string, cand_id string, label tinyint, name_levenshtein_ratio float, name_token_jaccard float, name_address_tfidf_cosine float, address_token_jaccard float, country_match tinyint, name_length_diff int"

    def __init__(self, idf: dict[str, float]):
        self.idf = idf

    def names(self, made: dict, x: np.ndarray, y: np.ndarray) -> dict:
        v, once = made["names"], self.once
        codes = once(made, "n", lambda: ratios.Codes(v["n"]))
        return {
            "name_levenshtein_ratio": ratios.ratio(codes.take(x), codes.take(y)), "name_length_diff": _lengths(codes.n, x, y)[0],
            "name_token_jaccard": once(made, "b", lambda: Sets([compare.words(t) for t in v["b"]])).jaccard(x, y),
        }

    def addresses(self, made: dict, x: np.ndarray, y: np.ndarray) -> dict:
        return {"address_token_jaccard": self.once(made, "a", lambda: Sets([compare.words(t) for t in made["addresses"]["a"]])).jaccard(x, y)}

    def texts(self, made: dict, x: np.ndarray, y: np.ndarray) -> dict:
        return {"name_address_tfidf_cosine": self.once(made, "vectors", lambda: self.vectors(made["texts"]["text"])).products(x, y)}

    def vectors(self, texts: list[str]) -> Sets:
        members, weights = [], []
        for t in texts:
            tf = {g: (1 + math.log(n)) * self.idf[g] for g, n in word_grams(t).items() if g in self.idf}
            norm = math.sqrt(sum(w * w for w in tf.values()))
            members.append(tf)
            weights.append([w / norm for w in tf.values()])
        return Sets(members, weights)

    def countries(self, made: dict, x: np.ndarray, y: np.ndarray) -> dict:
        code = _codes(made["countries"]["country"], (None,))
        return {"country_match": _equal(code, x, y), "no_country": (code[x] < 0)[:, None] | (code[y] < 0)[None, :]}

    def last(self, made: dict, r: np.ndarray, c: np.ndarray, found: dict) -> None:
        #: a missing country is neither equal nor not
        found["country_match"] = pa.array(found["country_match"].astype(np.int8), mask=found["no_country"])


def word_grams(text: str) -> Counter:
    """3- and 4-grams within the words of a text, a space at both ends, and how often they occur."""
    return Counter(w[k : k + m] for t in text.split(" ") if t for w in (f" {t} ",) for m in (3, 4) for k in range(len(w) - m + 1))


def gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """gram, total and df of the rows' texts, some of them at a time."""
    total, df = Counter(), Counter()

    def out() -> pa.RecordBatch:
        return pa.record_batch([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64()), pa.array([df[g] for g in total], pa.int64())], ["gram", "total", "df"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            grams = word_grams(text)
            total.update(grams)
            df.update(grams.keys())
        if len(total) > 1_000_000:
            yield out()
            total, df = Counter(), Counter()
    if total:
        yield out()
