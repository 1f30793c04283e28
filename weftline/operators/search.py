"""Retrieval of the best records by shared keys. A task holds the keys of all candidates of
one target and looks up a share of the queries in it, so that no hit travels."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.storage import stored

#: Queries looked up by one task, about, and most rows of a batch that it returns, about.
SHARE, ROWS = 4096, 500_000
#: Most tasks of a target: each gets a copy of its candidates, so what is written grows with the records only.
COPIES = 16
#: Texts of which the grams are found at once.
TEXTS = 8192
NONE = np.zeros(0, np.int64)


def grams(texts: list[str | None], spaces: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different 3-grams of each text, without its spaces unless ``spaces``, a number each
    (three code points of 21 bits), the place of their text and how often they occur in it."""
    bare = [(t or "") if spaces else (t or "").replace(" ", "") for t in texts]
    code = np.frombuffer("".join(bare).encode("utf-32-le"), np.uint32).astype(np.int64)
    at = np.repeat(np.arange(len(bare)), [len(t) for t in bare])
    within = at[2:] == at[:-2]
    gram, at = (code[:-2] << 42 | code[1:-1] << 21 | code[2:])[within], at[:-2][within]
    order = np.lexsort((gram, at))
    gram, at = gram[order], at[order]
    first = np.ones(len(gram), bool)
    first[1:] = (gram[1:] != gram[:-1]) | (at[1:] != at[:-1])
    return gram[first], at[first], np.diff(np.append(np.flatnonzero(first), len(first)))


class Postings:
    """Places by key (``values[code]``; a code under 0 is none), in order; of keys in more
    than ``max_df`` places none."""

    def __init__(self, code: np.ndarray, values: list, at: np.ndarray, n: int, max_df: int | None = None, weights: np.ndarray | None = None):
        known = np.argsort(code, kind="stable")[np.count_nonzero(code < 0) :]
        size = np.bincount(code[known], minlength=len(values))
        self.places, self.n, self.start = at[known].astype(np.int32), n, np.concatenate([[0], np.cumsum(size)])
        self.weights = None if weights is None else weights[known]
        self.code = {k: c for c, k in enumerate(values) if max_df is None or size[c] <= max_df}

    def of(self, key) -> np.ndarray:
        c = self.code.get(key)
        return NONE if c is None else self.places[self.start[c] : self.start[c + 1]]

    def counts(self, keys) -> np.ndarray:
        """How many of the keys each place has."""
        found = [self.of(k) for k in keys]
        return np.bincount(np.concatenate(found, dtype=np.int64) if found else NONE, minlength=self.n)

    def products(self, keys, weights) -> np.ndarray:
        """Sums over the keys of their weight times that of each place."""
        total = np.zeros(self.n)
        for key, weight in zip(keys, weights, strict=True):
            if (c := self.code.get(key)) is not None:
                part = slice(self.start[c], self.start[c + 1])
                total[self.places[part]] += weight * self.weights[part]
        return total


def of_grams(texts: pa.Array, max_df: int | None) -> Postings:
    #: some texts at a time, and short numbers: a worker holds those of all candidates of a target
    parts = [(gram, (at + k).astype(np.int32)) for k in range(0, len(texts), TEXTS) for gram, at, _ in [grams(texts.slice(k, TEXTS).to_pylist())]]
    gram, at = (np.concatenate([p[k] for p in parts]) if parts else NONE for k in (0, 1))
    del parts
    code, values = pd.factorize(gram)
    del gram
    return Postings(code.astype(np.int32), values.tolist(), at, len(texts), max_df)


def of_values(values: pa.Array) -> Postings:
    """Of a column of strings, of which null is none."""
    coded = values.dictionary_encode()
    return Postings(coded.indices.fill_null(-1).to_numpy(), coded.dictionary.to_pylist(), np.arange(len(values)), len(values))


def of_lists(lists: pa.Array, max_df: int | None) -> Postings:
    """Of a column of lists of strings."""
    coded = lists.flatten().dictionary_encode()
    at = np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
    return Postings(coded.indices.fill_null(-1).to_numpy(), coded.dictionary.to_pylist(), at, len(lists), max_df)


def best(scores: np.ndarray, least: int, most: int | None) -> np.ndarray:
    """The ``most`` places of highest score, those of equal score in order, or all; none under ``least``."""
    if most is None:
        return np.flatnonzero(scores >= least)
    size = np.bincount(scores, minlength=least + 1)
    size[:least] = 0
    upward = np.cumsum(size[::-1])[::-1]
    if upward[least] <= most:
        return np.flatnonzero(scores >= least)
    bound = np.flatnonzero(upward >= most)[-1]
    sure = np.flatnonzero(scores > bound)
    return np.concatenate([sure, np.flatnonzero(scores == bound)[: most - len(sure)]])


class GramChannel:
    """Candidates by the 3-grams of a text column, of which null has none."""

    def __init__(self, rows: dict[str, pa.Array], column: str, max_df: int | None, least: int, most: int | None):
        self.postings, self.column, self.least, self.most = of_grams(rows[column], max_df), column, least, most
        self.last, self.found = None, (NONE, NONE)

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores; those of an equal text before are used again."""
        if row[self.column] != self.last:
            scores = self.postings.counts(grams([row[self.column]])[0].tolist())
            places = best(scores, self.least, self.most)
            self.last, self.found = row[self.column], (places, scores[places])
        return self.found


class ListChannel:
    """Candidates by the keys of an array column."""

    def __init__(self, rows: dict[str, pa.Array], column: str, max_df: int | None, least: int, most: int | None):
        self.postings, self.column, self.least, self.most = of_lists(rows[column], max_df), column, least, most

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        scores = self.postings.counts(row[self.column] or ())
        places = best(scores, self.least, self.most)
        return places, scores[places]


def number(gram: str) -> int:
    """The number of a 3-gram."""
    return ord(gram[0]) << 42 | ord(gram[1]) << 21 | ord(gram[2])


class Cosines:
    """Of the candidates equal in one of the columns ``keys`` the cosines of TF-IDF vectors of
    3-grams of a text column, spaces among them, above 0; the ``most`` highest, or all."""

    def __init__(self, rows: dict[str, pa.Array], column: str, idf: dict[int, float], keys: tuple[str, ...], most: int | None = None):
        self.idf, self.column, self.met, self.most = idf, column, AnyOf(rows, keys), most
        gram, at, weights = self.vectors(rows[column].to_pylist())
        code, values = pd.factorize(gram)
        self.postings = Postings(code, values.tolist(), at, len(rows[column]), weights=weights)
        self.last, self.values = None, None

    def vectors(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram, at, n = grams(texts, spaces=True)
        w = (1 + np.log(n)) * np.array([self.idf[g] for g in gram.tolist()], float)
        return gram, at, w / np.sqrt(np.bincount(at, w * w, len(texts)))[at]

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        if self.values is None or row[self.column] != self.last:
            gram, _, w = self.vectors([row[self.column]])
            self.last, self.values = row[self.column], self.postings.products(gram.tolist(), w)
        places, _ = self.met(row)
        places = places[self.values[places] > 0]
        if self.most is not None:
            places = places[np.argsort(-np.round(self.values[places], 9), kind="stable")[: self.most]]
        return places, self.values[places]


class InOrder:
    """The first ``most`` candidates, those of the first key of an array column first."""

    def __init__(self, rows: dict[str, pa.Array], column: str, max_df: int, most: int):
        self.postings, self.column, self.most = of_lists(rows[column], max_df), column, most

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        found = NONE
        for key in row[self.column] or ():
            new = self.postings.of(key)
            new = new[~np.isin(new, found)]
            found = np.concatenate([found, new[: self.most - len(found)]])
            if len(found) == self.most:
                break
        return found, np.zeros(len(found), np.int64)


class AnyOf:
    """Candidates equal in one of the columns, the first ``most``."""

    def __init__(self, rows: dict[str, pa.Array], columns: tuple[str, ...], most: int | None = None):
        self.postings = {c: of_values(rows[c]) for c in columns}
        self.most = most

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        found = np.unique(np.concatenate([p.of(row[c]) if row[c] is not None else NONE for c, p in self.postings.items()]))[: self.most]
        return found, np.zeros(len(found), np.int64)


class EqualTo:
    """Candidates equal in one column, with score 1."""

    def __init__(self, rows: dict[str, pa.Array], column: str):
        self.any, self.column = AnyOf(rows, (column,)), column

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        places, scores = self.any(row)
        return places, scores + 1


class Together:
    """What any of the channels finds, once; scores are added."""

    def __init__(self, *channels: Callable[[dict], tuple[np.ndarray, np.ndarray]]):
        self.channels = channels

    def __call__(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        found = [c(row) for c in self.channels]
        every = np.concatenate([p for p, _ in found])
        total, has = np.bincount(every, np.concatenate([s for _, s in found])), np.bincount(every)
        places = np.flatnonzero(has)
        return places, total[places].astype(np.int64)


def _lookup(build: Callable, columns: list[str], kind: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by task, its candidates in the order of their ids first, then its queries."""

    def flush(queries: list[str], ids: pa.Array, found: list) -> pa.RecordBatch:
        at = np.repeat(np.arange(len(found)), [len(p) for p, _ in found])
        places, scores = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        return pa.record_batch([pa.array(queries, pa.string()).take(pa.array(at)), ids.take(pa.array(places)), pa.array(scores, kind)], ["s1_id", "cand_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, search, ids = None, [], None, None
        for batch in batches:
            task, query = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("task", "query"))
            mark = task * 2 + query
            for part in np.split(np.arange(len(mark)), np.flatnonzero(np.diff(mark)) + 1):
                if not len(part):
                    continue
                rows = pa.Table.from_batches([batch.slice(int(part[0]), len(part))])
                if task[part[0]] != current:
                    current, parts, search = int(task[part[0]]), [], None
                if not query[part[0]]:
                    parts.append(rows)
                    continue
                if not parts:
                    continue
                if search is None:
                    every = pa.concat_tables(parts).combine_chunks()
                    ids = every.column("entity_id").combine_chunks()
                    search = build({c: every.column(c).combine_chunks() for c in columns})
                    parts, every = parts[:1], None
                names, found, total = [], [], 0
                for row in rows.select(["entity_id", *columns]).to_pylist():
                    hit = search(row)
                    if len(hit[0]):
                        names.append(row["entity_id"])
                        found.append(hit)
                        total += len(hit[0])
                    if total >= ROWS:
                        yield flush(names, ids, found)
                        names, found, total = [], [], 0
                if found:
                    yield flush(names, ids, found)

    return run


def found(records: DataFrame, build: Callable, order: str, apart: bool = True, rank: tuple[str, ...] = ("entity_id",), score: str = "bigint") -> DataFrame:
    """s1_id, cand_id and score of what ``build`` finds, for each target unless not ``apart``.
    ``records`` have entity_id, src and the columns of the channels; places are in the order of
    the columns ``rank``; equal values of the column ``order`` are looked up one after the other."""
    columns = [c for c in records.columns if c not in ("entity_id", "src", *rank)]
    records = stored(records, "searched")
    targets = [r.src for r in records.where("src <> 'S1'").select("src").distinct().orderBy("src").collect()]
    shares = min(COPIES, -(-records.where("src = 'S1'").count() // SHARE))
    if not targets or not shares:
        return records.sparkSession.createDataFrame([], f"s1_id string, cand_id string, score {score}")
    groups = len(targets) if apart else 1
    number = F.array_position(F.array(*map(F.lit, targets)), F.col("src")).cast("int") - 1 if apart else F.lit(0)
    every = F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))
    candidates = records.where("src <> 'S1'").select("*", every.alias("share")).withColumns({"task": number * shares + F.col("share"), "query": F.lit(0)})
    share = F.pmod(F.xxhash64(order, "entity_id"), F.lit(shares)).cast("int")
    queries = records.where("src = 'S1'").withColumn("share", share).withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    queries = queries.withColumns({"task": F.col("target") * shares + F.col("share"), "query": F.lit(1)})
    keep = list(dict.fromkeys(["task", "query", "entity_id", *rank, *columns]))
    rows = candidates.select(keep).unionByName(queries.select(keep)).repartition(4 * shares * groups, "task")
    rows = rows.sortWithinPartitions("task", "query", F.when(F.col("query") == 1, F.col(order)), *rank).select("task", "query", "entity_id", *columns)
    return rows.mapInArrow(_lookup(build, columns, pa.float64() if score == "double" else pa.int64()), f"s1_id string, cand_id string, score {score}")
