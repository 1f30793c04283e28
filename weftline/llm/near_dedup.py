"""MinHash near-duplicates with tensored banding, then exact completion.

Keys. Two collections of HALVES minhash tuples (ROWS values each) are computed
per document: 2 * HALVES * ROWS minhashes. Table (i, j) is keyed by tuple i of
the first and tuple j of the second collection, so HALVES**2 tables cost about
the square root of the minhashes that independent tables would. Tuples of the
first collection that no other document has are dropped before pairs are
formed, so a document without relatives never emits its HALVES**2 keys. At a
similarity of 0.75 a pair shares a table with probability over 0.99998.

Links. Each table's documents are checked on their full shingle sets against
one representative, the document with the most partners (linear in a group of
copies). Links make components. Where a representative's documents still lie in
several components, pairs of them may be similar without being similar to it.
Those are found by what sets them apart: let D(x) be the shingles that x and
the representative r don't share, d its size and n that of x. Two documents'
sets differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, so a link needs
a common part of D(x) and D(y) of (A(x) + A(y)) / (2 (100 + PERCENT)) at least, where
A = (100 + PERCENT) d - (100 - PERCENT) n. Where that isn't positive, both are
linked to r. So an exact prefix join over the differences, rarest first, with
positions that must leave room, finds all pairs; what a group of copies has in
common is in no difference, so large groups form few pairs.

Identical shingle sets are one node from the start, so groups of exact copies,
even a third of all rows, are pre-aggregated and never compared.

Defined results: null, empty or blank text has n_shingles 0 and is linked with
nothing (component_id = doc_id). A null doc_id has a null component_id and is
kept. Rows that repeat a doc_id count as one document with several texts: it
is linked if one of them is. Other columns are ignored, whatever their names.
An empty table gives no rows. Results are a table in the shared folder; the
tables on the way to it are deleted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm import _shingles as S
from weftline.llm._worker import give_back, release
from weftline.storage import arrow_rows, finished, stored, table

HALVES = 14
ROWS = 2
#: Similarity in percent.
PERCENT = 75
#: Ids are broadcast to fetch texts only while their bytes stay below this.
BROADCAST_BYTES = 32 << 20
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 1000
_ROWS_OUT = 512


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    multipliers = S.constants(2 * HALVES * ROWS, 1000)
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS_OUT):
            part = batch.slice(lo, _ROWS_OUT)
            sets = [S.shingle_set(t.as_py()) for t in part.column(1)]
            full = [s for s in sets if len(s)]
            m = S.minhashes(full, multipliers)
            tuples = [S.fold(m[:, k * ROWS : (k + 1) * ROWS], k) for k in range(2 * HALVES)] if full else []
            keys, where = iter(np.stack(tuples, 1).tolist() if full else []), [len(s) > 0 for s in sets]
            both = [next(keys) if x else None for x in where]
            yield pa.record_batch(
                [
                    part.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([b and b[:HALVES] for b in both], pa.list_(pa.int64())),
                    pa.array([b and b[HALVES:] for b in both], pa.list_(pa.int64())),
                ],
                ["doc_id", "n_shingles", "set_key", "u", "v"],
            )
    give_back()


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for batch in batches:
        for lo in range(0, batch.num_rows, _ROWS_OUT):
            part = batch.slice(lo, _ROWS_OUT)
            packed = [S.shingle_set(t.as_py()).tobytes() for t in part.column(1)]
            yield pa.record_batch([part.column(0), pa.array(packed, pa.binary())], ["node", "shingles"])
    give_back()


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sizes of both sets of each row and the number of shingles that only one has."""
    release()
    for batch in batches:
        n = [[], [], []]
        for x, y in zip(batch.column(2), batch.column(3), strict=True):
            a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            for out, v in zip(n, (len(a), len(b), len(a) + len(b) - 2 * both), strict=True):
                out.append(v)
        yield pa.record_batch([batch.column(0), batch.column(1), *[pa.array(v, pa.int64()) for v in n]], ["a", "b", "n_a", "n_b", "d"])
    give_back()


def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle that a document and its representative don't share;
    the key holds both the shingle and the representative."""
    release()
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            part = batch.slice(lo, 64)
            reps = part.column(1).to_numpy(zero_copy_only=False)
            keys = []
            for rep, x, y in zip(reps, part.column(5), part.column(6), strict=True):
                apart = np.setxor1d(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), assume_unique=True)
                keys.append(S.salted(apart, int(rep)))
            n = np.array([len(k) for k in keys], np.int64)
            yield pa.record_batch(
                [pa.array(np.repeat(c.to_numpy(zero_copy_only=False), n), pa.int64()) for c in part.columns[:5]]
                + [pa.array(np.repeat(n, n), pa.int64()), pa.array(np.concatenate(keys) if keys else [], pa.int64())],
                ["node", "rep", "comp", "a", "need", "d", "key"],
            )
    give_back()


def _texts_of(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(columns of nodes, text) of the documents in ``nodes``; the ids are broadcast
    while their size is below BROADCAST_BYTES and joined by a shuffle beyond it."""
    ids = F.broadcast(nodes) if nodes.count() * 16 * len(nodes.columns) <= BROADCAST_BYTES else nodes
    return docs.join(ids, docs.doc_id == ids.node).select(*[ids[c] for c in nodes.columns], "text")


def _compare(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, d) of the pairs (a, b): sizes of the shingle sets and of their difference."""
    one = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    other = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y")
    with arrow_rows(pairs.sparkSession, 256):
        return stored(both.mapInArrow(_compared, "a long, b long, n_a long, n_b long, d long"), "compared")


#: 100 * common >= PERCENT * all, by the number of shingles that only one of the two has.
_SIMILAR = f"{100 + PERCENT} * d <= {100 - PERCENT} * (n_a + n_b)"


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node
    reachable. Minimum labels spread over links and then jump to their label's
    label, so chains shorten by half a round; each round is stored."""
    edges = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "edges")
    labels = stored(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        near = edges.join(labels, edges.b == labels.node).groupBy("a").agg(F.min("comp").alias("near"))
        spread = labels.join(near, labels.node == near.a, "left").select(
            "node", "comp", F.least("comp", F.coalesce("near", "comp")).alias("via")
        )
        target = labels.select(F.col("node").alias("via"), F.col("comp").alias("far"))
        new = spread.join(target, "via", "left").select("node", "comp", F.least("via", F.coalesce("far", "via")).alias("next"))
        new = stored(new, "labels")
        done = new.where("next <> comp").isEmpty()
        labels = new.select("node", F.col("next").alias("comp"))
        if done:
            return labels


def _tables(nodes: DataFrame) -> DataFrame:
    """(a, b): each document of a table entry of two or more, and the entry's representative."""
    firsts = nodes.select("node", F.explode("u").alias("uk"))
    common = stored(firsts.groupBy("uk").agg(F.count("*").alias("n")).where("n > 1"), "common")
    alive = firsts.join(common, "uk").groupBy("node").agg(F.collect_list("uk").alias("us"), F.sum("n").alias("partners"))
    keys = alive.join(nodes.select("node", "v"), "node").select("node", "partners", "v", F.explode("us").alias("uk"))
    keys = keys.select("node", "partners", "uk", F.explode("v").alias("vk")).select("node", "partners", F.xxhash64("uk", "vk").alias("key"))
    best = F.max(F.struct("partners", F.xxhash64("node").alias("tie"), "node"))
    entries = keys.groupBy("key").agg(F.count("*").alias("n"), best.alias("best")).where("n > 1")
    entries = stored(entries.select("key", F.col("best.node").alias("rep")), "entries")
    members = keys.join(entries, "key").where("node <> rep").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    return stored(members.distinct(), "members")


def _apart(members: DataFrame, sets: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, node, comp, a, left): the first differences, rarest first, of the documents
    whose representative has documents of several components; left counts those from there on."""
    own = F.expr(f"{100 + PERCENT} * d - {100 - PERCENT} * n_a")
    limit = F.col("n_b") * (100 - PERCENT)
    rows = members.join(comp, members.a == comp.node, "left").select(
        F.col("a").alias("node"), F.col("b").alias("rep"), F.coalesce("comp", "a").alias("comp"), own.alias("a"), limit.alias("limit"), "d"
    )
    rows = stored(rows, "compared")
    #: a document linked to the representative needs a partner that isn't
    reps = rows.groupBy("rep").agg(
        F.min("comp").alias("low"), F.max("comp").alias("high"),
        F.min(F.when(F.col("a") > F.col("limit"), F.col("a"))).alias("out"), F.min(F.when(F.col("a") <= F.col("limit"), F.col("a"))).alias("in"),
    )
    reps = stored(reps.where("low <> high and out is not null").select("rep", "out", "in"), "representatives")
    common = lambda partner: F.ceil((F.col("a") + partner) / (2 * (100 + PERCENT)))
    with_out = common(F.col("out"))
    need = F.when(F.col("a") <= F.col("limit"), with_out).otherwise(F.least(with_out, common(F.col("in"))))
    #: a partner's difference holds the common part, and its set is larger than the representative's by that difference at most
    need = F.greatest(F.lit(1), need, F.ceil((F.col("a") - F.col("limit")) / 200))
    open_ = rows.join(reps, "rep").select("node", "rep", "comp", "a", need.cast("long").alias("need"), "d").where("need <= d").drop("d")
    open_ = stored(open_, "open")
    x = sets.select("node", F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("rep"), F.col("shingles").alias("y"))
    both = open_.join(x, "node").join(y, "rep").select("node", "rep", "comp", "a", "need", "x", "y")
    with arrow_rows(members.sparkSession, 256):
        apart = both.mapInArrow(_differences, "node long, rep long, comp long, a long, need long, d long, key long")
        apart = stored(apart, "differences")
    #: only what documents of several components have can link two of them; the rest comes first and only shifts positions
    spread = apart.groupBy("key").agg(F.count("*").alias("df"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    spread = stored(spread.where("low <> high").select("key", "df"), "spread")
    lists = apart.join(spread, "key").groupBy("node", "rep", "comp", "a", "need", "d")
    lists = lists.agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("s"))
    size, room = F.size("s"), F.size("s") - F.col("need") + 1
    prefix = lists.where(room > 0).select("node", "comp", "a", size.alias("size"), F.posexplode(F.slice("s", F.lit(1), room.cast("int"))).alias("at", "s"))
    return stored(prefix.select("node", "comp", "a", (F.col("size") - F.col("at")).alias("left"), F.col("s.key").alias("key")), "prefix")


def _candidates(prefix: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a key where positions leave
    room for the similarity. A key's largest component is met by the others only."""
    sizes = prefix.groupBy("key", "comp").agg(F.count("*").alias("size"))
    main = sizes.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("size", "comp")).alias("top"))
    main = stored(main.where("comps > 1").select("key", F.col("top.comp").alias("main")), "main")
    split = stored(prefix.join(main, "key"), "split")
    x = split.where("comp <> main").select("key", *[F.col(c).alias(f"{c}_x") for c in ("node", "comp", "a", "left")])
    y = split.select("key", (F.col("comp") == F.col("main")).alias("in_main"), *[F.col(c).alias(f"{c}_y") for c in ("node", "comp", "a", "left")])
    room = F.least("left_x", "left_y") * (2 * (100 + PERCENT)) >= F.col("a_x") + F.col("a_y")
    once = F.col("in_main") | (F.col("node_x") < F.col("node_y"))
    pairs = x.join(y, (x.key == y.key) & (F.col("comp_x") != F.col("comp_y")) & room & once)
    return stored(pairs.select(F.least("node_x", "node_y").alias("a"), F.greatest("node_x", "node_y").alias("b")).distinct(), "pairs")


def similar(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) between nodes (node, u, v), checked on the full shingle sets of
    the documents; they join all that is similar and shares a table."""
    members = _tables(nodes)
    ids = stored(members.select(F.col("a").alias("node")).union(members.select("b")).distinct(), "ids")
    sets = stored(_texts_of(docs, ids).mapInArrow(_sets, "node long, shingles binary"), "sets")
    members = _compare(members, sets)
    links = members.where(_SIMILAR).select("a", "b")
    pairs = _candidates(_apart(members, sets, components(links)))
    return links.union(_compare(pairs, sets).where(_SIMILAR).select("a", "b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    with arrow_rows(docs.sparkSession, BATCH_ROWS):
        return finished(lambda: _near_duplicates(docs), "near-duplicates")


def _near_duplicates(docs: DataFrame) -> DataFrame:
    signed = stored(
        docs.mapInArrow(_signatures, "doc_id long, n_shingles long, set_key binary, u array<long>, v array<long>"), "signatures"
    )
    nodes = signed.where("set_key is not null and doc_id is not null").groupBy("set_key")
    nodes = stored(nodes.agg(F.min("doc_id").alias("node"), F.first("u").alias("u"), F.first("v").alias("v")), "nodes")
    links = similar(docs, nodes)
    #: rows of one doc_id with several texts: each text's node leads to that document
    same = signed.where("set_key is not null and doc_id is not null").join(nodes.select("set_key", "node"), "set_key")
    several = signed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    same = same.join(several, "doc_id").where("doc_id <> node").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    comp = components(links.union(same.distinct()))
    ids = nodes.select("set_key", "node").join(comp, "node", "left").select("set_key", F.coalesce("comp", "node").alias("comp"))
    out = signed.select("doc_id", "n_shingles", "set_key").join(ids, "set_key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def op9_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
