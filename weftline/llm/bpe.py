"""Byte-level BPE encoding by backtracking over longest matches, and decoding.

A pre-token's encoding under BPE merges is the only token sequence in which each
neighbouring pair is compatible: merging across their border never comes before
the merges inside them. The encoder takes the longest token at each position,
shortens it while the pair with its predecessor is incompatible or the rest is
known to be a dead end, and steps back when no shorter token is left. Longest
matches of a whole batch of new pre-tokens come from one Aho-Corasick pass.
Every end position is visited a bounded number of times, so the work is linear.

Decoding gathers bytes by an offset table over one blob of all token bytes.

Defined results: null and empty texts have no tokens and decode to the empty
text. Special tokens' strings in a text are those tokens, as in the library.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm._vocab import tokenizer_path
from weftline.llm._worker import give_back, kept
from weftline.storage import table

#: Fixed value: the published pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Code points, in hexadecimal, that this module's regex library takes for letters or numbers and the
#: tokenizers library, with an older Unicode version, doesn't.
LATE = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE "
    "11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA "
    "18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE "
    "1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
_EARLY = bytes(range(0xD5))
#: Pre-tokens whose encodings a worker keeps; beyond it the cache starts anew.
CACHE_PRETOKENS = 400_000
#: Compatibilities of token pairs that a worker keeps, likewise.
CACHE_PAIRS = 1_000_000
#: Rows of an Arrow batch of texts, where the caller writes the result under ``arrow_rows``.
BATCH_ROWS = 1000
_ROWS_OUT = 256
#: Freed memory is given back after so many output batches.
_GIVE_BACK = 16


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in of each byte in a byte-level vocabulary file: printable
    Latin-1 bytes stand for themselves, the others for code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Grown:
    """Numbers, or rows of them, that numpy can look into while more are added; room doubles when it runs out."""

    def __init__(self, kind: type, row: tuple[int, ...] = ()):
        self.room, self.size = np.empty((1 << 12, *row), kind), 0

    def add(self, values) -> None:
        end = self.size + len(values)
        if end > len(self.room):
            self.room = np.concatenate([self.room[: self.size], np.empty((2 * end - self.size, *self.room.shape[1:]), self.room.dtype)])
        self.room[self.size : end] = values
        self.size = end


class Codec:
    """Vocabulary, merge table and caches of one worker; ``vocabulary`` is the JSON text."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        alphabet = byte_alphabet()
        latin = {ord(c): b for c, b in alphabet.items()}
        vocab = {t.translate(latin): i for t, i in spec["model"]["vocab"].items()}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.specials.values()]) + 1
        self.token: list[bytes] = [b""] * size
        for t, i in vocab.items():
            self.token[i] = t.encode("latin-1")
        for t, i in self.specials.items():
            self.token[i] = t.encode()
        #: merge order of the token that a pair makes; its parts; parts of single bytes are themselves
        self.made: dict[tuple[int, int], int] = {}
        self.order = [-1] * size
        self.left, self.right = list(range(size)), list(range(size))
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = vocab[a.translate(latin)], vocab[b.translate(latin)]
            whole = vocab[(a + b).translate(latin)]
            self.made[x, y] = k
            if self.order[whole] < 0:
                self.order[whole], self.left[whole], self.right[whole] = k, x, y
        self.longest = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.longest.add_word(t, (len(t) - 1, i))
        self.longest.make_automaton()
        #: the longest proper prefix of each token that is a token, or -1
        self.shorter = [-1] * size
        for t, i in vocab.items():
            for n in range(len(t) - 1, 0, -1):
                if (p := vocab.get(t[:n])) is not None:
                    self.shorter[i] = p
                    break
        self.length = [len(t) for t in self.token]
        self.pairs: dict[int, bool] = {}
        self.size = size
        blob = b"".join(self.token)
        self.blob = np.frombuffer(blob, np.uint8)
        self.offset = np.concatenate([[0], np.cumsum(self.length)]).astype(np.int64)
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("|".join(f"({regex.escape(s)})" for s in self.specials)).split if self.specials else None
        spans = [x.split("-") for x in LATE.split()]
        self.late = re.compile("[" + "".join(f"{chr(int(x[0], 16))}-{chr(int(x[-1], 16))}" for x in spans) + "]")
        self._reset()

    def _reset(self) -> None:
        self.known: dict[str, int] = {}
        self.text: list[str] = []
        self.flat, self.start, self.count = Grown(np.int32), Grown(np.int64), Grown(np.int64)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between tokens a and b unmerged."""
        key = a * self.size + b
        if (known := self.pairs.get(key)) is not None:
            return known
        made, order, left, right = self.made, self.order, self.left, self.right
        #: undo the merges inside both sides from the latest on; a merge across the
        #: border that would have come before the one undone decides against the pair
        x, y, limit, ok = a, b, len(order) + len(made), True
        while True:
            k = made.get((x, y))
            if k is not None and k < limit:
                ok = False
                break
            i, j = order[x], order[y]
            if i < 0 and j < 0:
                break
            if i > j:
                limit, x = i, right[x]
            else:
                #: of equal merges the left one comes first, so a tie across the border wins here
                limit, y = j + 1, left[y]
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def _backtrack(self, n: int, at: list[int]) -> list[int]:
        """Tokens of n bytes, of which at[i] is the longest token that starts at i."""
        length, shorter, pairs, size = self.length, self.shorter, self.pairs, self.size
        dead = bytearray(n + 1)
        out: list[int] = []
        pos, token = 0, at[0]
        while True:
            last = out[-1] if out else -1
            while True:
                end = pos + length[token]
                if not dead[end]:
                    if last < 0:
                        break
                    ok = pairs.get(last * size + token)
                    if ok or ok is None and self.compatible(last, token):
                        break
                token = shorter[token]
                if token < 0:
                    break
            if token >= 0:
                out.append(token)
                if end == n:
                    return out
                pos, token = end, at[end]
            else:
                dead[pos] = 1
                token = out.pop()
                pos -= length[token]

    def _learn(self, new: list[str]) -> None:
        """Encode pre-tokens that the cache lacks, in one pass of the automaton."""
        coded = [w.encode("utf-8", "surrogatepass") for w in new]
        #: no token holds the character between pre-tokens, so no match leaves its own
        text = "\u0100".join([c.decode("latin-1") for c in coded])
        best = [0] * (len(text) + 1)
        #: of the matches that start at a place, the last one found is the longest
        for end, (more, i) in self.longest.iter(text):
            best[end - more] = i
        start, encoded = 0, []
        for c in coded:
            end = start + len(c)
            encoded.append(self._backtrack(len(c), best[start:end]))
            start = end + 1
        self._keep(new, encoded)

    def _keep(self, words: list[str], encoded: list[list[int]]) -> None:
        """Put encodings of pre-tokens into the cache."""
        self.known.update(zip(words, range(len(self.text), len(self.text) + len(words)), strict=True))
        self.text.extend([",".join(map(str, ids)) for ids in encoded])
        counts = np.fromiter(map(len, encoded), np.int64, len(encoded))
        self.start.add(self.flat.size + np.cumsum(counts) - counts)
        self.count.add(counts)
        self.flat.add(np.fromiter(chain.from_iterable(encoded), np.int32, int(counts.sum())))

    def _parts(self, text: str) -> list[str]:
        #: UTF-8 of the first such code point begins with D5, so most texts are known by their bytes
        if text.isascii() or not text.encode("utf-8", "surrogatepass").translate(None, _EARLY) or not self.late.search(text):
            return self.split(text)
        #: split with a private character in place of each, then cut the text alike
        ends = np.cumsum([len(w) for w in self.split(self.late.sub("\ue000", text))]).tolist()
        return [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def pretokens(self, text: str) -> list[str]:
        if self.cut and any(s in text for s in self.specials):
            return [w for part in self.cut(text) if part for w in ([part] if part in self.specials else self._parts(part))]
        return self._parts(text)

    def encode_batch(self, texts: list[str]) -> list[tuple[np.ndarray, str]]:
        """(ids, decimal ids joined by commas) of each text."""
        if len(self.known) >= CACHE_PRETOKENS:
            self._reset()
        words = [self.pretokens(t) for t in texts]
        known = self.known
        new = set().union(*words).difference(known)
        if own := [w for w in new if w in self.specials]:
            self._keep(own, [[self.specials[w]] for w in own])
        if new := [w for w in new if w not in self.specials]:
            self._learn(new)
        flat, start, count = self.flat.room, self.start.room, self.count.room
        out = []
        for ws in words:
            if not ws:
                out.append((np.empty(0, np.int32), ""))
                continue
            at = list(map(known.__getitem__, ws))
            k = np.array(at)
            m = count[k]
            begin = np.cumsum(m) - m
            ids = flat[np.repeat(start[k] - begin, m) + np.arange(int(m.sum()))]
            out.append((ids, ",".join(map(self.text.__getitem__, at))))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids' text, gathered by the offset table."""
        if not len(ids):
            return b""
        start, n = self.offset[ids], self.offset[ids + 1] - self.offset[ids]
        begin = np.cumsum(n) - n
        raw = self.blob[np.repeat(start - begin, n) + np.arange(int(n.sum()))].tobytes()
        return raw.decode("utf-8", "replace").encode()


def codec(path: str) -> Codec:
    """Codec of a vocabulary file that this process can read."""
    with open(path, encoding="utf-8") as f:
        return Codec(f.read())


def _encoder(shared, name: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = kept(f"bpe:{name}", lambda: Codec(shared.value))
        sha = lambda b: hashlib.sha256(b).hexdigest()
        made = 0
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS_OUT):
                part = batch.slice(lo, _ROWS_OUT)
                done = c.encode_batch([t or "" for t in part.column(part.num_columns - 1).to_pylist()])
                cols = list(part.columns[:-1]) + [
                    pa.array([len(i) for i, _ in done], pa.int64()),
                    pa.array([sha(s.encode()) for _, s in done]),
                    pa.array([sha(c.decode(i)) for i, _ in done]),
                ]
                names = [*part.schema.names[:-1], "n_tokens", "ids_sha256", "decoded_sha256"]
                if keep_ids:
                    cols.append(pa.array([i for i, _ in done], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.record_batch(cols, names)
                made += 1
                if made % _GIVE_BACK == 0:
                    give_back()
        give_back()

    return run


def encode(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Columns ``keep``, n_tokens, ids_sha256, decoded_sha256 and, with keep_ids, ids."""
    with open(vocabulary or tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        text = f.read()
    #: workers get the vocabulary from the driver, so they need no folder in common
    shared = docs.sparkSession.sparkContext.broadcast(text)
    rows = docs.select(*[F.col(c) for c in keep], F.col(text_col).alias("_text"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    schema += "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return rows.mapInArrow(_encoder(shared, hashlib.sha256(text.encode()).hexdigest(), keep_ids), schema)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), keep_ids=False)
