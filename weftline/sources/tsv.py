"""Tab-separated record files and result files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS = "entity_id string, business_name string, business_address string, country string"
TRUTH = "source1_entity_id string, matched_entity_ids string"
CANDIDATES = "source1_entity_id string, candidate_entity_ids string"
_PLAIN = {"sep": "\t", "header": True, "quote": "", "escape": "", "maxCharsPerColumn": "-1"}


def read(spark: SparkSession, path: str, schema: str = RECORDS) -> DataFrame:
    """Quotes are ordinary characters; an empty field is null."""
    return spark.read.options(**_PLAIN).schema(schema).csv(path)


def sources(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Records of several files with a column src, the country trimmed."""
    parts = [read(spark, p).withColumns({"src": F.lit(s), "country": F.trim("country")}) for s, p in paths.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """One row a file: lines, the header's tabs, lines with another number of tabs, bytes."""
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.col("_metadata.file_size").alias("n_bytes"))
    tabs = F.size(F.split("value", "\t")) - 1
    return lines.groupBy("file").agg(F.max("n_bytes").alias("n_bytes"), F.count("*").alias("n_lines"), F.max(tabs).alias("tabs"), F.count_if(tabs == 0).alias("malformed"))


def write_lists(pairs: DataFrame, s1: DataFrame, path: str, header: str = "candidate_entity_ids") -> DataFrame:
    """One row for each record of ``s1`` (entity_id), its sorted ids of ``pairs`` (s1_id, cand_id)."""
    ids = pairs.groupBy("s1_id").agg(F.array_join(F.array_sort(F.collect_set("cand_id")), ",").alias(header))
    rows = s1.join(ids, s1.entity_id == ids.s1_id, "left").select(F.col("entity_id").alias("source1_entity_id"), F.coalesce(header, F.lit("")).alias(header))
    rows.write.mode("overwrite").options(sep="\t", header=True, quote="", emptyValue="").csv(path)
    return rows


def write_index(postings: DataFrame, path: str, config: dict) -> bool:
    """Postings (channel, target, key, entity_id) by channel and target, each file
    sorted by key; skipped if the manifest beside it has the same configuration."""
    spark = postings.sparkSession
    wanted = json.dumps(config, sort_keys=True)
    try:
        if spark.read.text(f"{path}/_manifest").first()[0] == wanted:
            return False
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    ordered = postings.repartitionByRange("channel", "target", "key").sortWithinPartitions("channel", "target", "key")
    ordered.write.mode("overwrite").partitionBy("channel", "target").option("compression", "zstd").parquet(f"{path}/postings")
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/_manifest")
    return True
