"""Quality rules: base counts, and content or boilerplate lines by a linear-chain CRF.

Each line has a feature vector; a conditional random field with two states,
content and boilerplate, scores label sequences, and Viterbi decoding gives the
best one. A text is kept if the base rules pass and content lines hold at least
MIN_CONTENT of its word characters.

Fitting: maximum likelihood (forward-backward gradients, L2 penalty) over about
SAMPLE_DOCS labelled documents, drawn by a hash of doc_id from those whose
crc32(doc_id) mod 5 is not 0. Lines of documents of quality 1 count as content,
those of quality 0 and legal or navigation phrases as boilerplate. Without both
labels the weights are DEFAULT. A document's lines are one chain, however many.

Defined results: null, empty and blank texts have counts 0 and fail the base
rules. Lines without a word belong to no state and don't interrupt a sequence.
Repeated rows, and rows without doc_id, are judged each on its own (a null id
takes no part in the fit); other columns don't matter; an empty table gives no
rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.langid import holdout
from weftline.storage import table

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
MIN_CONTENT = 0.5
SAMPLE_DOCS = 800
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
_ROWS_OUT = 256
_SPACES = b" \t\n\r\x0b\x0c"

#: Phrases of legal and navigation lines.
_PHRASES = re.compile(rb"all rights reserved|copyright|licen[cs]e|terms of (?:use|service)|privacy policy|cookies?\b|subscribe|sign in|click here", re.I)
FEATURES = ("bias", "symbols", "upper", "digits", "bars", "other", "short", "open_end", "length", "copy", "phrase", "word_length")
#: Weights for boilerplate against content, where nothing can be learnt.
DEFAULT = {"weights": [-2.0, 12.0, 4.0, 3.0, 12.0, 2.0, 0.5, 0.5, -0.5, 2.0, 3.0, 0.0], "stay": 1.0}

_KIND = np.zeros(256, np.uint8)  #: 0 letters and the rest, 1 space, 2 symbol, 3 upper, 4 digit, 5 bar, 6 other
_KIND[list(_SPACES)] = 1
_KIND[list(b"!\"'()+,-./:;=?@[\\]^_`{}~")] = 6
_KIND[list(b"#*$%&<>!")] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[ord("|")] = 5


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of WINDOW words that occur at least twice in the list.
    Windows are ranked exactly by doubling: pairs, then fours, then eights."""
    n = len(words)
    if n <= WINDOW:
        return 0
    index: dict[bytes, int] = {}
    rank = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    for width in (1, 2, 4):
        pairs = rank[:-width] * (int(rank.max()) + 1) + rank[width:]
        _, rank, count = np.unique(pairs, return_inverse=True, return_counts=True)
        if count.max() == 1:
            return 0
    edge = np.zeros(n + 1, np.int64)
    at = np.flatnonzero(count[rank] > 1)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def line_features(raw: bytes, lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) and the word characters (bytes) of each line."""
    data, n = np.frombuffer(raw, np.uint8), len(lines)
    kind = _KIND[data]
    line = np.zeros(len(data), np.int64)
    line[1:] = np.cumsum(data[:-1] == 10)
    count = np.bincount(line * 7 + kind, minlength=n * 7).reshape(n, 7).astype(float)
    ink = count.sum(1) - count[:, 1]
    space = kind == 1
    start = ~space
    start[1:] &= space[:-1]
    words = np.bincount(line[start], minlength=n)
    per = np.maximum(ink, 1)
    seen = Counter(lines)
    phrase = bool(_PHRASES.search(raw))
    out = np.empty((n, len(FEATURES)))
    out[:, 0] = 1
    for at, k in ((1, 2), (2, 3), (3, 4), (4, 5), (5, 6)):
        out[:, at] = count[:, k] / per
    out[:, 6] = words < 4
    out[:, 7] = [x.rstrip(_SPACES)[-1:] not in (b".", b"!", b"?", b":") for x in lines]
    out[:, 8] = np.log1p(words) / 5
    out[:, 9] = [seen[x] > 1 for x in lines]
    out[:, 10] = [bool(_PHRASES.search(x)) for x in lines] if phrase else 0
    out[:, 11] = np.minimum(np.abs(per / np.maximum(words, 1) - 6) / 6, 2)
    return out, ink


def viterbi(scores: list[float], stay: float) -> list[bool]:
    """Whether each line is boilerplate in the best sequence; ``scores`` are its
    state's weight against content, ``stay`` what two equal neighbours gain."""
    content = boiler = 0.0
    back: list[tuple[bool, bool]] = []
    for k, s in enumerate(scores):
        if k == 0:
            boiler = s
            continue
        back.append((boiler > content + stay, boiler + stay > content))
        content, boiler = max(content + stay, boiler), max(boiler + stay, content) + s
    if not scores:
        return []
    state = boiler > content
    out = [state]
    for from_content, from_boiler in reversed(back):
        state = from_boiler if state else from_content
        out.append(state)
    return out[::-1]


def _chained(m: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Products (in logarithms) of each chain's 2 x 2 matrices up to each place, by
    doubling; a chain begins where ``first`` holds."""
    m, done, width = m.copy(), first.copy(), 1
    while not done.all():
        left, right = m[:-width], m[width:]
        both = np.logaddexp(left[:, :, 0, None] + right[:, None, 0, :], left[:, :, 1, None] + right[:, None, 1, :])
        m[width:] = np.where(done[width:, None, None], right, both)
        done = done | np.concatenate([np.ones(width, bool), done[:-width]])
        width *= 2
    return m


def _gradient(w: np.ndarray, stay: float, x: np.ndarray, y: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, float]:
    """Gradient of the mean log-likelihood a line, of the lines of all chains in
    one row: features, labels, and where a chain begins. Chains have any length."""
    n = len(x)
    e = np.stack([np.zeros(n), x @ w], 1)
    t = np.array([[stay, 0.0], [0.0, stay]])
    alpha = _chained(np.where(first[:, None, None], e[:, None, :], t + e[:, None, :]), first)[:, 0]
    last = np.append(first[1:], True)
    #: backwards: the last line's factor is 1, which its first column carries
    after = np.concatenate([t + e[1:, None, :], np.zeros((1, 2, 2))])
    after[last] = [[0.0, -1e300], [0.0, -1e300]]
    beta = _chained(after[::-1].transpose(0, 2, 1), last[::-1])[::-1].transpose(0, 2, 1)[:, :, 0]
    ends = np.flatnonzero(last)
    z = np.repeat(np.logaddexp(alpha[ends, 0], alpha[ends, 1]), np.diff(np.concatenate([[-1], ends])))
    p = np.exp(alpha[:, 1] + beta[:, 1] - z)
    gw = (y - p) @ x
    inner = np.flatnonzero(~first)
    same = sum(np.exp(alpha[inner - 1, s] + stay + e[inner, s] + beta[inner, s] - z[inner]).sum() for s in (0, 1))
    return gw / n, float((y[inner] == y[inner - 1]).sum() - same) / n


def _labelled_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for t in batch.column(1):
            raw = (t.as_py() or "").encode("utf-8", "surrogatepass")
            lines = raw.split(b"\n")
            x, ink = line_features(raw, lines) if raw else (np.zeros((0, len(FEATURES))), np.zeros(0))
            rows.append(x[ink > 0].ravel())
        yield pa.record_batch([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], ["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame) -> dict:
    """Weights of the features and of equal neighbours, from a bounded sample."""
    train = labels.where("quality in (0, 1)").where(~holdout()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    total = train.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    sample = train.where(draw < SAMPLE_DOCS / max(total, 1)).withColumnRenamed("doc_id", "_id")
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("_id")).select("quality", "text")
    got = rows.mapInArrow(_labelled_lines, "quality int, x array<double>").toPandas()
    k = len(FEATURES)
    chains = [(q, np.asarray(v).reshape(-1, k)) for q, v in zip(got.quality, got.x, strict=True) if len(v)]
    if len({q for q, _ in chains}) < 2:
        return DEFAULT
    chains.sort(key=lambda c: (c[0], len(c[1]), c[1].tobytes()))
    x = np.concatenate([m for _, m in chains])
    y = np.concatenate([np.maximum(1 - q, m[:, FEATURES.index("phrase")]) for q, m in chains])
    begins = np.zeros(len(x), bool)
    begins[np.cumsum([0, *(len(m) for _, m in chains[:-1])])] = True
    w, stay = np.zeros(k), 0.0
    first, second = np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, STEPS + 1):
        gw, gs = _gradient(w, stay, x, y, begins)
        g = np.append(gw - PENALTY * w, gs - PENALTY * stay)
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-9)
        w, stay = w + move[:k], stay + float(move[k])
    return {"weights": w.tolist(), "stay": stay}


def judge(text: str | None, weights: np.ndarray, stay: float) -> tuple:
    """The query's columns after doc_id, then the content share and the lines' states."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    if not n:
        return 0, 0, 0, 0, 0, True, False, 0.0, ""
    bare = raw.translate(None, _SPACES)
    chars = len(bare.decode("utf-8", "surrogatepass"))
    symbols = len(bare) - len(bare.translate(None, b"#*$%&|<>"))
    lines = raw.split(b"\n")
    full = [x for x in lines if x and not x.isspace()]
    repeat = repeated_words(words)
    failed = n < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * n
    x, ink = line_features(raw, lines)
    has = ink > 0
    boiler = np.array(viterbi((x[has] @ weights).tolist(), stay))
    share = float(ink[has][~boiler].sum() / ink.sum())
    state = "".join("B" if b else "C" for b in boiler)
    return n, chars, symbols, len(full) - len(set(full)), repeat, failed, not failed and share >= MIN_CONTENT, share, state


def _judge(model: dict, full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.array(model["weights"])
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64(), pa.string()] * full
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(lo, _ROWS_OUT)
                rows = [judge(t.as_py(), weights, model["stay"])[: len(kinds)] for t in part.column(1)]
                cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.record_batch([part.column(0), *cols], [f"c{i}" for i in range(len(kinds) + 1)])

    return run


def rules(docs: DataFrame, labels: DataFrame, full: bool = True) -> DataFrame:
    """doc_id, the counts, base_failed, kept and, with ``full``, content_share and
    line_states (C or B for each line that has a word)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"
    return docs.mapInArrow(_judge(fit(docs, labels), full), names + ", content_share double, line_states string" * full)


def op7_rules(spark, sf_dir: str) -> DataFrame:
    return rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), full=False)
