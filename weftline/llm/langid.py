"""Language identification by segmentation-marginalised unigram models.

Pieces are the lower-case letter tokens of a fixed public vocabulary, of any
length, and all single bytes, so any text can be segmented. A pre-token is a run
of letters, lower-cased, with a space before it; its probability in a language
is the sum, over all its segmentations, of the product of piece probabilities,
by a forward pass. A text's score is the posterior of the best language under a
uniform prior.

Forward passes run over many words at once, with piece probabilities scaled by a
constant to the power of their bytes, which cancels in the end; the few words
for which that leaves the range of numbers, and very long ones, have a pass of
their own in logarithms.

Fitting: piece probabilities by expectation-maximisation over all words of a
sample of about SAMPLE_DOCS labelled documents a language, drawn by a hash of
doc_id from those whose crc32(doc_id) mod 5 is not 0. Whole texts are read; the
expectations are taken in tasks and added up, so words stay off the driver.

Defined results: null text or text without a letter (``str.isalpha``) is ``und``
with score 0, as is everything when there is nothing to learn from. A null
doc_id counts as held out. Ties go to the language that sorts first. Repeated
rows are scored each; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import json
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._vocab import tokenizer_path
from weftline.llm._worker import kept
from weftline.llm.bpe import Grown, byte_alphabet
from weftline.storage import stored, table

#: Labelled documents a language in the fit, about.
SAMPLE_DOCS = 400
ROUNDS = 4
#: Expected count added to each piece of each language.
SMOOTHING = 0.02
CACHE_WORDS = 250_000
#: Words of more letters have a pass of their own and aren't kept.
LONG_WORD = 64
#: Nats a byte by which piece probabilities are raised in a pass over many words.
TILT = 2.0
_ROWS_OUT = 512
_letters = re.compile(r"[^\W\d_]+").findall


def holdout(doc_id="doc_id"):
    """Whether crc32 of the id as text leaves 0 by 5; true for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def pretokens(text: str | None) -> list[str]:
    words = _letters(text.lower()) if text else []
    if text and not text.isascii() and not "".join(words).isalpha():
        #: the pattern also takes numerals such as one half or Roman eight
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split(" ")
        words = [w for w in words if w]
    return words


def vocabulary_pieces(path: str) -> list[bytes]:
    """Lower-case letter pieces, with or without a space before them, then the bytes
    that are no piece yet."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    alphabet = byte_alphabet()
    pieces = {}
    for token in vocab:
        raw = bytes(alphabet[c] for c in token)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            continue
        if (word := text.removeprefix(" ")).isalpha() and word == word.lower():
            pieces[raw] = None
    return [*pieces, *(bytes([b]) for b in range(1, 256) if bytes([b]) not in pieces)]


class Pieces:
    """Exact look-up in a piece table: of up to eight bytes packed in a number, and of longer ones by their endings."""

    def __init__(self, pieces: list[bytes]):
        self.n = len(pieces)
        self.lengths = np.array([len(p) for p in pieces])
        self.long = {p: i for i, p in enumerate(pieces) if len(p) > 8}
        self.widest = max(map(len, pieces), default=1)
        #: endings of nine bytes and more lead on to longer pieces, those of eight start the search
        self.endings = {p[-k:] for p in self.long for k in range(9, len(p) + 1)}
        self.tails = np.unique(np.array([int.from_bytes(p[-8:], "little") for p in self.long], np.uint64))
        short = np.flatnonzero(self.lengths <= 8)
        keys = np.array([int.from_bytes(pieces[i], "little") for i in short], np.uint64)
        self.bits = 20
        slot = self._slot(keys, self.bits)
        self.key, self.at = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, self.n, np.int32)
        self.key[slot], self.at[slot] = keys, short
        lost = np.flatnonzero(self.key[slot] != keys)
        order = lost[np.argsort(keys[lost])]
        self.more, self.more_at = keys[order], short[order].astype(np.int32)

    def tail(self, keys: np.ndarray) -> np.ndarray:
        """Where a packed eight bytes end a longer piece."""
        if not len(self.tails):
            return np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.tails, keys), len(self.tails) - 1)
        return np.flatnonzero(self.tails[near] == keys)

    def long_ends(self, raw: bytes, end: int) -> list[tuple[int, int]]:
        """(length, piece) of the pieces over eight bytes that end there."""
        out = []
        for k in range(9, min(self.widest, end) + 1):
            part = raw[end - k : end]
            if part not in self.endings:
                break
            if (i := self.long.get(part)) is not None:
                out.append((k, i))
        return out

    @staticmethod
    def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key's piece, or the number of pieces."""
        slot = self._slot(keys, self.bits)
        out = np.where(self.key[slot] == keys, self.at[slot], self.n)
        if len(self.more):
            left = np.flatnonzero((out == self.n) & (self.key[slot] != 0))
            near = np.minimum(np.searchsorted(self.more, keys[left]), len(self.more) - 1)
            out[left] = np.where(self.more[near] == keys[left], self.more_at[near], self.n)
        return out


def _matrix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the words, longest first, one row each; lengths; the order."""
    coded = [b" " + w.encode("utf-8", "surrogatepass") for w in words]
    n = np.fromiter(map(len, coded), np.int64, len(coded))
    order = np.argsort(-n, kind="stable")
    width = int(n.max())
    rows = np.frombuffer(b"".join(coded[i].ljust(width, b"\0") for i in order), np.uint8).reshape(len(coded), width)
    return rows, n[order], order


def _ends(pieces: Pieces, rows: np.ndarray, n: np.ndarray):
    """For each end position j: the rows that reach it, the pieces of one to eight
    bytes that end there, and (length, row, piece) of longer ones."""
    for j in range(1, rows.shape[1] + 1):
        active = int(np.searchsorted(-n, -j, side="right"))
        key, found, longer = np.zeros(active, np.uint64), [], []
        for k in range(1, min(8, j) + 1):
            key = (key << np.uint64(8)) | rows[:active, j - k]
            found.append(pieces.find(key))
        if j > 8:
            longer = [(k, r, i) for r in pieces.tail(key).tolist() for k, i in pieces.long_ends(rows[r].tobytes(), j)]
        yield j, active, found, longer


def _tilted(pieces: Pieces, prob: np.ndarray) -> np.ndarray:
    raised = np.append(np.exp(TILT * pieces.lengths), 0.0)
    return prob * (raised[:, None] if prob.ndim > 1 else raised)


def _alone(pieces: Pieces, raw: bytes):
    """As ``_ends`` for one word: (j, [(length, piece)])."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint64)
    for lo in range(0, len(data), 1 << 15):
        hi = min(len(data), lo + (1 << 15))
        key, found = np.zeros(hi - lo, np.uint64), np.full((hi - lo, 8), pieces.n, np.int32)
        for k in range(1, 9):
            from_ = max(lo, k - 1)
            if from_ >= hi:
                break
            key[from_ - lo :] = (key[from_ - lo :] << np.uint64(8)) | data[from_ - k + 1 : hi - k + 1]
            found[from_ - lo :, k - 1] = pieces.find(key[from_ - lo :])
        tails = set(pieces.tail(key).tolist())
        for at, row in enumerate(found.tolist()):
            ends = [(k, i) for k, i in enumerate(row, 1) if i != pieces.n]
            yield lo + at + 1, ends + (pieces.long_ends(raw, lo + at + 1) if at in tails and lo + at >= 8 else [])


def _log_forward(pieces: Pieces, logs: np.ndarray, raw: bytes, keep: bool = False) -> np.ndarray:
    """Log of the probability summed over all segmentations, by language; with ``keep``, of all beginnings."""
    past = [np.zeros(logs.shape[1])]
    for _, ends in _alone(pieces, raw):
        each = np.stack([past[-k] + logs[i] for k, i in ends])
        top = each.max(0)
        past.append(top + np.log(np.exp(each - top).sum(0)))
        if not keep and len(past) > 2 * pieces.widest:
            past = past[-pieces.widest :]
    return np.stack(past) if keep else past[-1]


def _groups(words: list[str]) -> tuple[list[list[int]], list[int]]:
    """Words of like length in groups of up to 4096, and the very long ones."""
    short = [i for i, w in enumerate(words) if len(w) <= 24]
    middle = [i for i, w in enumerate(words) if 24 < len(w) <= LONG_WORD]
    return [part[lo : lo + 4096] for part in (short, middle) for lo in range(0, len(part), 4096)], [i for i, w in enumerate(words) if len(w) > LONG_WORD]


def _in_range(total: np.ndarray) -> np.ndarray:
    return (total > 1e-250) & (total < 1e250)


def log_likelihoods(pieces: Pieces, prob: np.ndarray, words: list[str]) -> np.ndarray:
    """(words, languages): log of the probability summed over all segmentations."""
    out = np.zeros((len(words), prob.shape[1]))
    raised = _tilted(pieces, prob)
    groups, alone = _groups(words)
    for at in groups:
        rows, n, order = _matrix([words[i] for i in at])
        past, total = [np.ones((len(at), prob.shape[1]))], np.empty((len(at), prob.shape[1]))
        for j, active, found, longer in _ends(pieces, rows, n):
            now = np.zeros((len(at), prob.shape[1]))
            for k, f in enumerate(found, 1):
                now[:active] += past[-k][:active] * raised[f]
            for k, r, i in longer:
                now[r] += past[-k][r] * raised[i]
            past = [*past[-pieces.widest + 1 :], now] if pieces.widest > 1 else [now]
            ended = slice(int(np.searchsorted(-n, -j, side="left")), active)
            total[ended] = now[ended]
        fine = _in_range(total).all(1)
        where = np.array(at)[order]
        out[where[fine]] = np.log(total[fine]) - TILT * n[fine, None]
        alone += where[~fine].tolist()
    if alone:
        with np.errstate(divide="ignore"):
            logs = np.log(prob)
        for i in alone:
            out[i] = _log_forward(pieces, logs, b" " + words[i].encode("utf-8", "surrogatepass"))
    return out


def expected(pieces: Pieces, prob: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected number of each piece in the words, each counted as often as ``counts`` says."""
    seen, raised = np.zeros(pieces.n + 1), _tilted(pieces, prob)
    groups, alone = _groups(words)
    for at in groups:
        rows, n, order = _matrix([words[i] for i in at])
        ends = list(_ends(pieces, rows, n))
        alpha = np.zeros((rows.shape[1] + 1, len(at)))
        beta = np.zeros_like(alpha)
        alpha[0] = 1
        for j, active, found, longer in ends:
            for k, f in enumerate(found, 1):
                alpha[j, :active] += alpha[j - k, :active] * raised[f]
            for k, r, i in longer:
                alpha[j, r] += alpha[j - k, r] * raised[i]
        total = alpha[n, np.arange(len(at))]
        fine = _in_range(total)
        where = np.array(at)[order]
        alone += where[~fine].tolist()
        beta[n, np.arange(len(at))] = np.where(fine, counts[where] / np.where(fine, total, 1.0), 0.0)
        for j, active, found, longer in reversed(ends):
            now = beta[j, :active].copy()
            for k, f in enumerate(found, 1):
                flow = now * raised[f]
                seen += np.bincount(f, alpha[j - k, :active] * flow, pieces.n + 1)
                beta[j - k, :active] += flow
            for k, r, i in longer:
                seen[i] += alpha[j - k, r] * now[r] * raised[i]
                beta[j - k, r] += now[r] * raised[i]
    if alone:
        with np.errstate(divide="ignore"):
            logs = np.log(prob)
        for w in alone:
            _add_expected(pieces, logs, b" " + words[w].encode("utf-8", "surrogatepass"), float(counts[w]), seen)
    return seen


def _add_expected(pieces: Pieces, logs: np.ndarray, raw: bytes, count: float, seen: np.ndarray) -> None:
    """The same for one word, in logarithms."""
    forward = _log_forward(pieces, logs[:, None], raw, keep=True)[:, 0]
    behind: list[list[float]] = [[] for _ in range(len(raw) + 1)]
    behind[-1] = [0.0]
    for j, ends in reversed(list(_alone(pieces, raw))):
        back = np.array(behind[j])
        top = back.max()
        back = top + np.log(np.exp(back - top).sum())
        behind[j] = []
        for k, i in ends:
            seen[i] += count * np.exp(forward[j - k] + logs[i] + back - forward[-1])
            behind[j - k].append(logs[i] + back)


def start(pieces: Pieces) -> np.ndarray:
    """Piece probabilities before the first round, with 0 for no piece at the end."""
    prob = np.append(1.0 / 30.0 ** np.minimum(pieces.lengths, 4), 0.0)
    return prob / prob.sum()


def raised_counts(seen: np.ndarray) -> np.ndarray:
    """Piece probabilities of expected counts."""
    prob = seen + SMOOTHING
    prob[-1] = 0
    return prob / prob.sum()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: Counter = Counter()
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            seen.update((lang, w) for w in pretokens(text.as_py()))
        yield pa.record_batch(
            [pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["lang", "word", "n"],
        )


def _expecting(shared, names: list[bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept("langid-pieces", lambda: Pieces(names))
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, words, n = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist(), batch.column(2).to_numpy()
            for lang in sorted(set(langs)):
                own = np.flatnonzero(langs == lang)
                sums[lang] = sums.get(lang, 0) + expected(pieces, shared.value[lang], [words[i] for i in own], n[own].astype(float))
        for lang, seen in sums.items():
            at = np.flatnonzero(seen)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(seen[at], pa.float64())], ["lang", "at", "x"])

    return run


def fit(docs: DataFrame, vocabulary: str | None = None) -> dict:
    """Languages, pieces and (pieces + 1, languages) probabilities."""
    labelled = docs.where(~holdout() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    names = vocabulary_pieces(vocabulary or tokenizer_path("byte_bpe_50k.json"))
    model = {"langs": sorted(sizes), "pieces": names, "prob": np.zeros((len(names) + 1, 0))}
    if not sizes:
        return model
    rates = F.create_map(*chain.from_iterable((F.lit(k), F.lit(SAMPLE_DOCS / n)) for k, n in sizes.items()))
    draw = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 30)) / (1 << 30)
    words = labelled.where(draw < rates[F.col("lang")]).select("lang", "text").mapInArrow(_count_words, "lang string, word string, n long")
    words = stored(words.groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    probs = {lang: start(Pieces(names)) for lang in model["langs"]}
    spark = docs.sparkSession
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast(probs)
        parts = words.mapInArrow(_expecting(shared, names), "lang string, at long, x double")
        sums = parts.groupBy("lang", "at").agg(F.sum("x").alias("x")).toArrow()  #: a row a language and piece at most
        for lang in probs:
            own = sums.filter(pc.equal(sums["lang"], lang))
            seen = np.zeros(len(names) + 1)
            seen[own["at"].to_numpy()] = own["x"].to_numpy()
            probs[lang] = raised_counts(seen)
        shared.destroy()
    return model | {"prob": np.stack([probs[lang] for lang in model["langs"]], 1)}


class Scorer:
    """Scores texts, keeping the vectors of words seen, up to CACHE_WORDS."""

    def __init__(self, model: dict):
        self.langs, self.prob, self.pieces = model["langs"], model["prob"], Pieces(model["pieces"])
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.vectors = Grown(float, (len(self.langs),))

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if len(self.known) >= CACHE_WORDS:
            self._reset()
        words = [pretokens(t) for t in texts]
        if not self.langs:
            return ["und"] * len(texts), [0.0] * len(texts)
        short = [[w for w in ws if len(w) <= LONG_WORD] for ws in words]
        new = [w for w in dict.fromkeys(chain.from_iterable(short)) if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.vectors.add(log_likelihoods(self.pieces, self.prob, new))
        names, scores = [], []
        for ws, own in zip(words, short, strict=True):
            if not ws:
                names.append("und")
                scores.append(0.0)
                continue
            total = self.vectors.room[np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))].sum(0)
            if len(own) < len(ws):
                long = Counter(w for w in ws if len(w) > LONG_WORD)
                total = total + np.array(list(long.values()), float) @ log_likelihoods(self.pieces, self.prob, list(long))
            best = int(total.argmax())
            names.append(self.langs[best])
            scores.append(float(1 / np.exp(total - total[best]).sum()))
        return names, scores


def _predict(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = kept(f"langid:{key}", lambda: Scorer(shared.value))
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(lo, _ROWS_OUT)
                names, scores = score(part.column(2).to_pylist())
                yield pa.record_batch([*part.columns[:2], pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document; fits on ``docs`` unless given a model."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *(["lang"] if model is None else []))
    shared = docs.sparkSession.sparkContext.broadcast(model if model is not None else fit(docs))
    key = uuid.uuid4().hex
    return docs.select("doc_id", holdout().alias("held_out"), "text").mapInArrow(
        _predict(shared, key), "doc_id long, held_out boolean, lang_pred string, score double"
    )


def op2_langid(spark, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
