"""Files that go in and out: splits, submissions, features, reports, models, the postings index."""

from __future__ import annotations

import json

from pyspark.ml.classification import GBTClassificationModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources import tsv

SOURCES = ("S1", "S2", "S3")


def load_split(spark: SparkSession, folder: str, split: str) -> DataFrame:
    """Records of the three sources of ``split`` (train or test), with a column src."""
    if split not in ("train", "test"):
        raise ValueError(f"no split {split!r}")
    return tsv.sources(spark, {s: f"{folder}/{split}_source{s[1]}.tsv" for s in SOURCES})


def candidate_source(c):
    """S2 or S3 by the id's beginning; any other id is an error."""
    bad = F.raise_error(F.concat(F.lit("no candidate id: "), F.coalesce(c, F.lit("null"))))
    return F.when(c.startswith("S2-"), "S2").when(c.startswith("S3-"), "S3").otherwise(bad)


def scan_candidates(spark: SparkSession, path: str, ids: str = "candidate_entity_ids") -> DataFrame:
    """(s1_id, cand_ids): each row's list in order, without repeats, blanks and empty items."""
    rows = tsv.read(spark, path, f"source1_entity_id string, {ids} string")
    items = F.filter(F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select(F.trim("source1_entity_id").alias("s1_id"), F.array_distinct(items).alias("cand_ids"))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    """One JSON document, in any file system that Spark reaches."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def write_candidates(pairs: DataFrame, s1: DataFrame, path: str) -> dict:
    """The candidate file, and beside it its metrics; they are returned too."""
    rows = tsv.write_lists(pairs, s1, path)
    n = F.when(F.col("candidate_entity_ids") == "", 0).otherwise(F.size(F.split("candidate_entity_ids", ",")))
    found = rows.select(n.alias("n")).agg(F.count("*").alias("s1_rows"), F.sum("n").alias("total_candidate_ids"), F.max("n").alias("max_per_s1"), F.count_if(F.col("n") == 0).alias("empty_rows")).first()
    metrics = found.asDict()
    write_json(pairs.sparkSession, metrics, f"{path}.metrics")
    return metrics


def write_features(features: DataFrame, path: str, append: bool = False) -> None:
    """Pair features as Parquet under zstd; ``append`` adds to what is there."""
    features.write.mode("append" if append else "overwrite").option("compression", "zstd").parquet(path)


def write_report(sections: dict[str, DataFrame], path: str, title: str = "Report", rows: int = 50) -> None:
    """Each section as CSV and JSON lines, whole, and all as one Markdown text of
    the first ``rows`` rows of each."""
    text = [f"# {title}"]
    for name, df in sections.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
        df.write.mode("overwrite").json(f"{path}/{name}.json")
        shown = df.orderBy(*df.columns).limit(rows).collect()
        cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
        lines = [f"| {' | '.join(map(cell, r))} |" for r in shown]
        text += ["", f"## {name}", "", f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *lines]
    spark = next(iter(sections.values())).sparkSession if sections else SparkSession.getActiveSession()
    spark.createDataFrame([("\n".join(text),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report.md")


def save_model(model: GBTClassificationModel, path: str, **facts) -> None:
    """The classifier, and beside it what it was trained with."""
    model.write().overwrite().save(f"{path}/model")
    write_json(SparkSession.getActiveSession(), {"trees": model.getNumTrees, "features": list(facts.pop("features", ())), **facts}, f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[GBTClassificationModel, dict]:
    return GBTClassificationModel.load(f"{path}/model"), read_json(spark, f"{path}/meta")


def replace_partitions(postings: DataFrame, path: str) -> None:
    """Postings (channel, target, key, entity_id) into the index: the partitions of
    channel and target that they hold are replaced, the others stay."""
    ordered = postings.repartitionByRange("channel", "target", "key").sortWithinPartitions("channel", "target", "key")
    writer = ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy("channel", "target").parquet(f"{path}/postings")


def look_up(queries: DataFrame, path: str, channel: str, target: str | None = None) -> DataFrame:
    """(s1_id, cand_id, key) of queries (s1_id, key) against the index: only the
    partitions of the channel (and target) are read; files are sorted by key, so
    runs of rows outside a key filter are skipped too."""
    index = queries.sparkSession.read.parquet(f"{path}/postings").where(F.col("channel") == channel)
    index = index if target is None else index.where(F.col("target") == target)
    return queries.join(index, "key").select("s1_id", F.col("entity_id").alias("cand_id"), "key")
