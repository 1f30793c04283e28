"""Incremental retrieval: new records, as they arrive, against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import expr as X


def candidates(stream: DataFrame, postings: DataFrame) -> DataFrame:
    """(s1_id, cand_id, key) of a stream of records; a stateless stream-static join on
    the baseline keys, so each micro-batch costs what its own keys match."""
    keys = F.expr(X.baseline_keys(X.SPARK, "business_name", "business_address", "country"))
    queries = stream.select(F.col("entity_id").alias("s1_id"), F.explode(keys).alias("key"))
    return queries.join(postings.select("key", F.col("entity_id").alias("cand_id")), "key").select("s1_id", "cand_id", "key")
