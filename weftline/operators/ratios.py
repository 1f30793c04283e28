"""The ratios of ``functions.unicode`` for all pairs of two lists of texts at once: bit-parallel
over the places of one text, a vector over the pairs. Words of a text are apart by one space."""

from __future__ import annotations

from functools import cached_property

import numpy as np

from weftline.functions import unicode as U

#: Pairs of a step, most texts in one table of masks, its most words, and pairs of which windows are compared at once, about.
CELLS, COLUMNS, TABLE, SLICE = 1 << 15, 4096, 1 << 21, 1 << 14
#: From so many pairs on ratios are found by vectors.
FEW = 48
NONE, ALL = np.uint64(0), ~np.uint64(0)


class Codes:
    """Texts as rows of code points."""

    def __init__(self, texts: list[str]):
        self.n = np.array([len(t) for t in texts], np.int64)
        self.code = np.zeros((len(texts), max(1, int(self.n.max(initial=0)))), np.uint32)
        self.code[self.inside(self.code.shape[1])] = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)

    def inside(self, width: int) -> np.ndarray:
        return np.arange(width)[None, :] < self.n[:, None]

    def take(self, rows: np.ndarray) -> Codes:
        out = object.__new__(Codes)
        out.n = self.n[rows]
        out.code = self.code[rows, : max(1, int(out.n.max(initial=0)))]
        return out


def subsequences(one: Codes, two: Codes, kept: tuple | None = None) -> np.ndarray:
    """Lengths of the longest common subsequences of each of one with each of two; ``kept`` has
    of both sides, for each pair, the places that count: words of 64 (word, one, two)."""
    out = np.zeros((len(one.n), len(two.n)), np.int64)
    for rows in (np.flatnonzero(one.n <= 64), np.flatnonzero(one.n > 64)):
        for columns in (np.flatnonzero(two.n <= 64), np.flatnonzero(two.n > 64)):
            if not len(rows) or not len(columns):
                continue
            a, b = one.take(rows), two.take(columns)
            some = None if kept is None else tuple(k[:, rows[:, None], columns[None, :]] for k in kept)
            #: the masks are of the short texts
            if b.code.shape[1] > 64 >= a.code.shape[1]:
                turned = None if some is None else tuple(np.ascontiguousarray(k.transpose(0, 2, 1)) for k in some[::-1])
                out[rows[:, None], columns[None, :]] = _subsequences(b, a, turned).T
            else:
                out[rows[:, None], columns[None, :]] = _subsequences(a, b, some)
    return out


def _subsequences(text: Codes, pattern: Codes, kept: tuple | None) -> np.ndarray:
    out = np.zeros((len(text.n), len(pattern.n)), np.int64)
    known = np.unique(text.code[text.inside(text.code.shape[1])])
    #: padding is len(known), of which no place has a mark; what no text has is one more
    codes = np.where(text.inside(text.code.shape[1]), np.searchsorted(known, text.code), len(known))
    at = np.minimum(np.searchsorted(known, pattern.code), max(0, len(known) - 1))
    marks = np.where(known[at] == pattern.code, at, len(known) + 1) if len(known) else np.ones(pattern.code.shape, np.int64)
    words, order = -(-pattern.code.shape[1] // 64), np.argsort(text.n, kind="stable")
    width = max(64, min(COLUMNS, TABLE // ((len(known) + 2) * words)))
    for left in range(0, len(pattern.n), width):
        some = slice(left, left + width)
        n = pattern.n[some]
        where = np.zeros((words, len(known) + 2, len(n)), np.uint64)
        for k in range(int(n.max(initial=0))):
            has = np.flatnonzero(n > k)
            where[k // 64, marks[some][has, k], has] |= np.uint64(1) << np.uint64(k % 64)
        step = max(1, CELLS // len(n))
        for top in range(0, len(order), step):
            rows = order[top : top + step]
            part = None if kept is None else tuple(np.ascontiguousarray(k[:, rows, some]) for k in kept)
            out[rows, some] = _lengths(codes[rows, : int(text.n[rows].max(initial=0))], where, part)
    return out


def _lengths(codes: np.ndarray, where: np.ndarray, kept: tuple | None) -> np.ndarray:
    words, shape = len(where), (len(codes), where.shape[2])
    row = np.full((words, *shape), ALL)
    eq, u, s, bit, carry = (np.empty(shape, np.uint64) for _ in range(5))
    for k in range(codes.shape[1]):
        c = codes[:, k]
        if kept is not None:
            np.right_shift(kept[0][k // 64], np.uint64(k % 64), out=bit)
            bit &= np.uint64(1)
            np.subtract(NONE, bit, out=bit)
        for w in range(words):
            r = row[w]
            np.take(where[w], c, axis=0, out=eq, mode="clip")
            if kept is not None:
                eq &= bit
                eq &= kept[1][w]
            np.bitwise_and(r, eq, out=u)
            np.add(r, u, out=s)
            if words > 1:
                over = s < r
                if w:
                    s += carry
                    over |= s < carry
                carry[...] = over
            r ^= u
            r |= s
    return 64 * words - np.bitwise_count(row).sum(axis=0, dtype=np.int64)


class Texts:
    """Texts with what their ratios need, made once it is needed: as they are, their words in
    order, and each word once (with the places of each word)."""

    def __init__(self, texts: list[str], of: tuple[Texts, np.ndarray] | None = None):
        self.texts, self.of = texts, of

    def take(self, rows: np.ndarray) -> Texts:
        return Texts([self.texts[i] for i in rows.tolist()], (self, rows))

    @cached_property
    def plain(self) -> Codes:
        return self.of[0].plain.take(self.of[1]) if self.of else Codes(self.texts)

    @cached_property
    def sorted(self) -> Codes:
        return self.of[0].sorted.take(self.of[1]) if self.of else Codes([" ".join(sorted(t.split())) for t in self.texts])

    @cached_property
    def once(self) -> Codes:
        return self.of[0].once.take(self.of[1]) if self.of else Codes([" ".join(sorted(set(t.split()))) for t in self.texts])

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text its words, their places with the space before each, and those of the spaces."""
        if self.of:
            word, masks, spaces = self.of[0].words
            rows, n = self.of[1], -(-self.once.code.shape[1] // 64)
            most = max(1, int((word[rows] >= 0).sum(axis=1).max(initial=0)))
            return word[rows, :most], masks[:n, rows, :most], spaces[:n, rows]
        once = [sorted(set(t.split())) for t in self.texts]
        known: dict[str, int] = {}
        most, n = max([1, *map(len, once)]), -(-self.once.code.shape[1] // 64)
        word = np.full((len(once), most), -1, np.int64)
        masks, spaces = np.zeros((n, len(once), most), np.uint64), np.zeros((n, len(once)), np.uint64)
        cut = (1 << 64) - 1
        for i, ws in enumerate(once):
            at = 0
            for t, w in enumerate(ws):
                word[i, t] = known.setdefault(w, len(known))
                first = at - (t > 0)
                bits = (1 << at + len(w)) - (1 << first)
                for k in range(first // 64, (at + len(w) - 1) // 64 + 1):
                    masks[k, i, t] = bits >> 64 * k & cut
                if t:
                    spaces[first // 64, i] |= np.uint64(1 << first % 64)
                at += len(w) + 1
        return word, masks, spaces


def _others(one: Texts, two: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Of both sides, for each pair, the places of the words that the other hasn't."""
    shape = (len(one.texts), len(two.texts))
    (word_a, masks_a, spaces_a), (word_b, masks_b, spaces_b) = one.words, two.words
    kept = tuple(np.zeros((len(masks), *shape), np.uint64) for masks in (masks_a, masks_b))
    width = min(shape[1], COLUMNS)
    step = max(1, CELLS // width)
    taken = np.empty((step, width), np.uint64)
    for top in range(0, shape[0], step):
        rows = slice(top, top + step)
        a = word_a[rows]
        known = np.unique(a[a >= 0])
        if not len(known):
            for left in range(0, shape[1], width):
                columns = slice(left, left + width)
                kept[1][:, rows, columns] = masks_b[:, columns].sum(axis=2, dtype=np.uint64)[:, None, :]
            continue
        local = lambda w, known=known: np.where(known[p := np.minimum(np.searchsorted(known, w), len(known) - 1)] == w, p, len(known))
        x = local(a)
        lacks_a = np.full((len(a), len(known) + 1), ALL)
        for t in range(x.shape[1]):
            lacks_a[np.arange(len(a)), x[:, t]] = NONE
        lacks_a[:, -1] = ALL
        for left in range(0, shape[1], width):
            columns = slice(left, left + width)
            y = local(word_b[columns])
            lacks_b = np.full((len(known) + 1, len(y)), ALL)
            for t in range(y.shape[1]):
                lacks_b[y[:, t], np.arange(len(y))] = NONE
            lacks_b[-1] = ALL
            got = taken if (len(a), len(y)) == taken.shape else np.empty((len(a), len(y)), np.uint64)
            for t in range(x.shape[1]):
                np.take(lacks_b, x[:, t], axis=0, out=got, mode="clip")
                for w in range(len(masks_a)):
                    kept[0][w, rows, columns] |= got & masks_a[w, rows, t][:, None]
            for t in range(y.shape[1]):
                np.take(lacks_a, y[:, t], axis=1, out=got, mode="clip")
                for w in range(len(masks_b)):
                    kept[1][w, rows, columns] |= got & masks_b[w, columns, t][None, :]
    #: the first word that is left has no space before it
    for k, spaces in ((kept[0], spaces_a[:, :, None]), (kept[1], spaces_b[:, None, :])):
        none_yet = np.ones(shape, bool)
        for w in range(len(k)):
            first = k[w] & (NONE - k[w]) & spaces[w]
            first[~none_yet] = 0
            none_yet &= k[w] == 0
            k[w] ^= first
    return kept


def _share(common: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The ratio of texts of that many characters together; 1 of empty ones."""
    return np.where(length == 0, 1.0, 2 * common / np.maximum(length, 1))


def ratio(one: Codes, two: Codes) -> np.ndarray:
    return _share(subsequences(one, two), one.n[:, None] + two.n[None, :])


def token_set(one: Texts, two: Texts) -> np.ndarray:
    kept = _others(one, two)
    left, right = (np.bitwise_count(k).sum(axis=0, dtype=np.int64) for k in kept)
    n, m = one.once.n[:, None], two.once.n[None, :]
    #: a head in common is in the longest common subsequence
    between = subsequences(one.once, two.once, kept)
    same = np.where(left > 0, n - left - 1, n)
    same = np.where((left < n) & (n > 0), same, 0)
    head = np.where(same > 0, same + 1, 0)
    out = _share(head + between, 2 * head + left + right)
    for other in (left, right):
        out = np.where(same > 0, np.maximum(out, 2 * same / np.maximum(2 * same + 1 + other, 1)), out)
    out = np.where((same > 0) & ((left == 0) | (right == 0)), 1.0, out)
    return np.where((n == 0) | (m == 0), ((n == 0) & (m == 0)).astype(float), out)


def partial(one: Codes, two: Codes, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of the pairs one[r], two[c], not equally long and none empty, the best ratio of the
    shorter text with a window of the longer, cut at its ends too."""
    out, turn = np.zeros(len(r)), one.n[r] > two.n[c]
    for which, (a, x), (b, y) in ((~turn, (one, r), (two, c)), (turn, (two, c), (one, r))):
        at = np.flatnonzero(which)
        at = at[np.lexsort((b.n[y[at]], a.n[x[at]]))]
        for k in range(0, len(at), SLICE):
            part = at[k : k + SLICE]
            out[part] = _windows(a.take(x[part]), b.take(y[part]))
    return out


def _windows(a: Codes, b: Codes) -> np.ndarray:
    """Strands start at the top at each place of b and cross as characters differ; a window of b
    has with a in common its width less the strands that start and end in it. Padding, on both
    sides, is like nothing."""
    n, m = a.code.shape[1], b.code.shape[1]
    known, code = np.unique(np.concatenate([a.code.ravel(), b.code.ravel()]), return_inverse=True)
    kind = np.uint8 if len(known) < 254 and m < 255 else np.uint16
    x = np.ascontiguousarray(np.where(a.inside(n), code[: a.code.size].reshape(a.code.shape), len(known)).T).astype(kind)
    y = np.ascontiguousarray(np.where(b.inside(m), code[a.code.size :].reshape(b.code.shape), len(known) + 1).T).astype(kind)
    ends = np.repeat(np.arange(1, m + 1, dtype=kind)[:, None], len(a.n), axis=1)
    full = np.array(np.iinfo(kind).max, kind)
    for i in range(n):
        equal = (y == x[i]).astype(kind)
        equal *= full
        left, across, turned = ends & ~equal, np.zeros(len(a.n), kind), np.empty(len(a.n), kind)
        for j in range(m):
            np.bitwise_or(across, equal[j], out=turned)
            np.minimum(turned, ends[j], out=turned)
            np.maximum(across, left[j], out=ends[j])
            across, turned = turned, across
    best, lost = np.zeros(len(a.n)), np.zeros(len(a.n), np.int64)
    for j in range(1, n):
        lost += ends[j - 1] >= 1
        best = np.maximum(best, np.where(j < a.n, 2 * (j - lost) / (a.n + j), 0.0))
    inside = np.ascontiguousarray(a.inside(n).T)
    for i in range(m):
        last = min(m, i + n)
        lost = ((ends[i:last] >= i + 1) & inside[: last - i]).sum(axis=0, dtype=kind)
        best = np.maximum(best, 2 * (np.minimum(last - i, a.n) - lost) / (a.n + np.clip(b.n - i, 0, a.n)))
    return best


def fuzzy(one: Texts, two: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``unicode.fuzzy`` of each of one with each of two: ratio, token_sort_ratio, token_set_ratio, wratio."""
    if len(one.texts) * len(two.texts) < FEW:
        return tuple(np.array([[f(a, b) for b in two.texts] for a in one.texts]) for f in U.FUZZY.values())
    common = subsequences(one.sorted, two.sorted)
    plain, ordered, sets = ratio(one.plain, two.plain), _share(common, one.sorted.n[:, None] + two.sorted.n[None, :]), token_set(one, two)
    short, long = (f(one.plain.n[:, None], two.plain.n[None, :]) for f in (np.minimum, np.maximum))
    longer = long / np.maximum(short, 1)
    weighted = np.maximum(plain, 0.95 * np.maximum(ordered, sets))
    r, c = np.nonzero((longer >= 1.5) & (short > 0))
    if len(r):
        scale = np.where(longer[r, c] <= 8, 0.9, 0.6)
        #: that of the words in order counts less, so the plain one beside it adds nothing
        best = np.maximum(plain[r, c], scale * partial(one.plain, two.plain, r, c))
        #: no window has more in common than the whole texts
        n, scale = short[r, c], 0.95 * scale
        common = common[r, c]
        may = np.flatnonzero(scale * (2 * common / (n + common)) > best)
        best[may] = np.maximum(best[may], scale[may] * partial(one.sorted, two.sorted, r[may], c[may]))
        weighted[r, c] = best
    return plain, ordered, sets, np.where(short == 0, 0.0, weighted)


def fuzzy_address(one: Texts, two: Texts) -> tuple[np.ndarray, np.ndarray]:
    """``unicode.fuzzy_address`` of each of one with each of two: ratio, token_set_ratio."""
    if len(one.texts) * len(two.texts) < FEW:
        return tuple(np.array([[f(a, b) for b in two.texts] for a in one.texts]) for f in U.FUZZY_ADDRESS.values())
    return ratio(one.plain, two.plain), token_set(one, two)
