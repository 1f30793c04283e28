"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and, but for
the last, returns the columns of ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from weftline.llm import bpe, mixing, near_dedup, quality_qda, secrets
from weftline.storage import arrow_rows, finished, stored, table


def fresh(docs: DataFrame, name: str = "mark") -> str:
    """A name that no column of ``docs`` has."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality_qda.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates. Ids to drop are broadcast while
    they are small, else joined by a shuffle; rows that repeat a doc_id are one.
    Rows without doc_id stay."""
    found = near_dedup.near_duplicates(docs)
    mark = fresh(docs)
    drop = stored(found.where(~F.col("kept")).select(F.col("doc_id").alias(mark)).distinct(), "drop")
    ids = F.broadcast(drop) if drop.count() * 16 <= near_dedup.BROADCAST_BYTES else drop
    kept = docs.join(ids, docs["doc_id"] == ids[mark], "left_anti")
    several = docs.groupBy(F.col("doc_id").alias(mark)).agg(F.count("*").alias("n")).where("n > 1").select(mark)
    several = stored(several.where(F.col(mark).isNotNull()), "several")
    if several.isEmpty():
        return kept
    #: of the rows of one doc_id the first by text, then by the other columns, stays
    order = [F.col(f"`{c}`") for c in ("text", *docs.columns) if isinstance(docs.schema[c].dataType, AtomicType)]
    once = kept.join(several, kept["doc_id"] == several[mark], "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    once = once.groupBy(F.col("doc_id").alias(mark)).agg(F.min_by(row, F.struct(*order)).alias("row"))
    once = once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return once.unionByName(kept.join(several, kept["doc_id"] == several[mark], "left_anti"))


def redact_secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with secrets masked."""
    return secrets.redact(docs)


def mix_sources(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time a document is taken into the mix."""
    return mixing.mixed_documents(docs)


def encode(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests and token ids of each row. Written here, since only then
    do the texts reach the workers in batches that are small beside an executor's memory."""
    with arrow_rows(spark, bpe.BATCH_ROWS):
        return stored(bpe.encode(docs), "encoded")


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("secret scan", redact_secrets),
    ("mixing", mix_sources),
    ("BPE encoding", encode),
]


def run(spark, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written and read again;
    what they need on the way is deleted."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = finished(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
