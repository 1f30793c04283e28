"""Functions that SQL lacks: Unicode decomposition, transliteration, indel similarities.

Arrow-batched pandas UDFs; everything else about these forms is SQL (see ``expr``).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Latin of Devanagari, Gujarati and Tamil letters, signs and digits, in the order of their code points.
DEVANAGARI = {
    "ं": "n", "ः": "h", "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ए": "e", "ऐ": "ai",
    "ओ": "o", "औ": "au", "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j",
    "झ": "jh", "ञ": "ny", "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d",
    "ध": "dh", "न": "n", "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l",
    "ळ": "l", "व": "v", "श": "sh", "ष": "sh", "स": "s", "ह": "h", "ा": "a", "ि": "i", "ी": "ee", "ु": "u",
    "ू": "oo", "े": "e", "ै": "ai", "ो": "o", "ौ": "au", "्": "", "०": "0", "१": "1", "२": "2", "३": "3",
    "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9",
}
GUJARATI = {
    "ં": "n", "ઃ": "h", "અ": "a", "આ": "aa", "ઇ": "i", "ઈ": "ee", "ઉ": "u", "ઊ": "oo", "એ": "e", "ઐ": "ai",
    "ઓ": "o", "ઔ": "au", "ક": "k", "ખ": "kh", "ગ": "g", "ઘ": "gh", "ઙ": "ng", "ચ": "ch", "છ": "chh", "જ": "j",
    "ઝ": "jh", "ઞ": "ny", "ટ": "t", "ઠ": "th", "ડ": "d", "ઢ": "dh", "ણ": "n", "ત": "t", "થ": "th", "દ": "d",
    "ધ": "dh", "ન": "n", "પ": "p", "ફ": "ph", "બ": "b", "ભ": "bh", "મ": "m", "ય": "y", "ર": "r", "લ": "l",
    "વ": "v", "શ": "sh", "સ": "s", "હ": "h", "ા": "a", "િ": "i", "ી": "ee", "ુ": "u", "ૂ": "oo", "ે": "e",
    "ૈ": "ai", "ો": "o", "ૌ": "au", "્": "",
}
TAMIL = {
    "அ": "a", "ஆ": "aa", "இ": "i", "ஈ": "ee", "உ": "u", "ஊ": "oo", "எ": "e", "ஏ": "ee", "ஐ": "ai", "ஒ": "o",
    "ஓ": "oo", "ஔ": "au", "க": "k", "ங": "ng", "ச": "s", "ஜ": "j", "ஞ": "ny", "ட": "t", "ண": "n", "த": "th",
    "ந": "n", "ன": "n", "ப": "p", "ம": "m", "ய": "y", "ர": "r", "ற": "r", "ல": "l", "ள": "l", "ழ": "zh",
    "வ": "v", "ா": "aa", "ி": "i", "ீ": "ee", "ு": "u", "ூ": "oo", "ெ": "e", "ே": "ee", "ை": "ai", "ொ": "o",
    "ோ": "oo", "ௌ": "au",
}
LATIN = DEVANAGARI | GUJARATI | TAMIL


def to_latin(text: str | None) -> str:
    """Each character by the tables, else by the first of its decomposition in lower case if that is ASCII, else dropped."""
    out = []
    for c in text or "":
        if (known := LATIN.get(c)) is not None:
            out.append(known)
        elif (first := unicodedata.normalize("NFKD", c)[:1]).isascii():
            out.append(first.lower())
    return "".join(out)


@F.pandas_udf(T.StringType())
def nfkd(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKD", x or ""))


@F.pandas_udf(T.StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFKC", x or ""))


@F.pandas_udf(T.StringType())
def transliterated(s: pd.Series) -> pd.Series:
    return s.map(to_latin)


def squeezed(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def basic_normalize(c: Column) -> Column:
    return squeezed(F.lower(nfkd(c)))


def normalize_name(c: Column) -> Column:
    return squeezed(F.regexp_replace(F.replace(basic_normalize(c), F.lit("&"), F.lit(" and ")), r"[^\p{L}\p{N}_\s]", " "))


def normalize_address(c: Column) -> Column:
    return squeezed(F.regexp_replace(basic_normalize(c), r"[^\p{L}\p{N}_\s]", " "))


def script(c: Column) -> Column:
    latin, other = c.rlike(r"\p{IsLatin}"), c.rlike(r"[\p{L}&&[^\p{IsLatin}]]")
    return F.when(latin & other, "mixed").when(latin, "Latin").when(other, "non-Latin").otherwise("no_letters")


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a's positions."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        u = row & where.get(c, 0)
        row = ((row + u) | (row - u)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Share of the characters in common, in order: 1 for two empty texts, 0 for one."""
    if a == b:
        return 1.0
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


def token_sort(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return float(not x and not y)
    same, left, right = (" ".join(sorted(s)) for s in (x & y, x - y, y - x))
    if same and (not left or not right):
        return 1.0
    one, two = f"{same} {left}".strip(), f"{same} {right}".strip()
    return max(ratio(one, two), *((ratio(same, one), ratio(same, two)) if same else (0.0,)))


def partial(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer, cut at its ends too."""
    a, b = sorted((a, b), key=len)
    if not a:
        return float(not b)
    best = _best_window(a, b, 0.0)
    #: neither of two equally long texts is the shorter
    return _best_window(b, a, best) if len(b) == len(a) else best


def _best_window(a: str, b: str, best: float) -> float:
    """``best`` or a better ratio of a with a window of b. No window has more in
    common with a than all of b has, so those that can't be better are left out."""
    n, most = len(a), common_subsequence(a, b)
    windows = {(max(0, k), min(len(b), k + n)) for k in range(1 - n, len(b))}
    for i, j in sorted(windows, key=lambda w: (w[0] - w[1], w[0])):
        if 2 * min(most, j - i) > best * (n + j - i):
            best = max(best, ratio(a, b[i:j]))
            if best == 1:
                break
    return best


def weighted(a: str, b: str) -> float:
    """Best of the plain, token and partial ratios, each with its published weight."""
    if not a or not b:
        return 0.0
    longer = max(len(a), len(b)) / min(len(a), len(b))
    tokens = 0.95 * max(token_sort(a, b), token_set(a, b))
    if longer < 1.5:
        return max(ratio(a, b), tokens)
    scale = 0.9 if longer <= 8 else 0.6
    both = max(partial(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial(a, b) if set(a.split()) & set(b.split()) else 0.0)
    return max(ratio(a, b), scale * partial(a, b), 0.95 * scale * both)


@F.pandas_udf(T.DoubleType())
def dot(g: pd.Series, v: pd.Series, h: pd.Series, w: pd.Series) -> pd.Series:
    """Products of two sparse vectors (keys, values); of a missing one 0."""
    out = []
    for a, x, b, y in zip(g, v, h, w, strict=True):
        other = {} if b is None else dict(zip(b, y, strict=True))
        out.append(0.0 if a is None else sum((p * other[k] for k, p in zip(a, x, strict=True) if k in other), 0.0))
    return pd.Series(out, dtype="float64")


FUZZY = {"ratio": ratio, "token_sort_ratio": token_sort, "token_set_ratio": token_set, "wratio": weighted}


def _each_once(ratios: dict, a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """Ratios of the rows' texts, computed once for each different pair of a batch."""
    pairs = list(zip(a.fillna(""), b.fillna(""), strict=True))
    known = {p: [f(*p) for f in ratios.values()] for p in set(pairs)}
    return pd.DataFrame([known[p] for p in pairs], columns=list(ratios), dtype="float64")


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in FUZZY]))
def fuzzy(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _each_once(FUZZY, a, b)


#: those that features of addresses have
FUZZY_ADDRESS = {name: FUZZY[name] for name in ("ratio", "token_set_ratio")}


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in FUZZY_ADDRESS]))
def fuzzy_address(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    return _each_once(FUZZY_ADDRESS, a, b)
