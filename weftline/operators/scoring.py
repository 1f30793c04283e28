"""Pair features and the match classifier."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import expr as X
from weftline.functions.unicode import basic_normalize, fuzzy, fuzzy_address, normalize_address, normalize_name

#: Names of the pair features, in order.
FEATURES = [
    "name_exact_sql_norm", "name_fuzz_ratio", "name_fuzz_wratio", "name_fuzz_token_set_ratio", "name_fuzz_token_sort_ratio",
    "name_token_jaccard", "name_char_ngram_jaccard", "name_len_diff", "name_len_ratio",
    "addr_exact_sql_norm", "addr_fuzz_ratio", "addr_fuzz_token_set_ratio", "addr_token_jaccard",
    "addr_numeric_overlap_count", "addr_numeric_jaccard", "addr_len_diff", "addr_len_ratio",
    "ctx_country_match", "ctx_same_cp_key", "ctx_same_sql_norm_name", "ctx_same_sql_norm_addr",
    "ctx_candidate_is_s2", "ctx_candidate_is_s3", "ctx_retrieval_evidence_count",
]
#: A pair's names are called similar from this ratio on.
SIMILAR = 0.85


def evidence_count(df: DataFrame, column: str) -> Column:
    """How many values of a map column say something: true, a number other than 0, a
    string that isn't blank; 0 for null."""
    kind = df.schema[column].dataType.valueType
    says = (lambda v: F.trim(v) != "") if isinstance(kind, T.StringType) else (lambda v: v) if isinstance(kind, T.BooleanType) else (lambda v: v != 0)
    return F.coalesce(F.size(F.map_filter(column, lambda _, v: F.coalesce(says(v), F.lit(False)))), F.lit(0)).cast("double")


def hard_flags(features: DataFrame) -> DataFrame:
    """``features`` with flags of pairs that aren't true and look alike; all false for true ones."""
    no = F.col("label") == 0
    return features.withColumns({
        "hard_same_country": no & (F.col("ctx_country_match") == 1), "hard_same_name": no & (F.col("ctx_same_sql_norm_name") == 1),
        "hard_same_cp": no & (F.col("ctx_same_cp_key") == 1), "hard_similar_name": no & (F.col("name_fuzz_ratio") >= SIMILAR),
    })


def pair_features(pairs: DataFrame) -> DataFrame:
    """``pairs`` (name1, name2, addr1, addr2, country1, country2, candidate_source and,
    if there is one, a map evidence) with the columns FEATURES; all but the four fuzzy
    ratios are SQL."""
    d, side = X.SPARK, {}
    for k in ("1", "2"):
        side |= {f"n{k}": normalize_name(F.col(f"name{k}")), f"a{k}": normalize_address(F.col(f"addr{k}")), f"b{k}": basic_normalize(F.col(f"name{k}")), f"c{k}": F.expr(X.country(d, f"country{k}"))}
    df = pairs.withColumns(side)
    df = df.withColumns({"fn": fuzzy("n1", "n2"), "fa": fuzzy_address("a1", "a2")})
    equal = lambda a, b: f"CAST({a} = {b} AND {a} <> '' AS DOUBLE)"
    sets = lambda c: X.token_set(d, c)
    same_name, same_addr = equal(X.sql_name(d, "name1"), X.sql_name(d, "name2")), equal(X.sql_addr(d, "addr1"), X.sql_addr(d, "addr2"))
    number = {
        "name_exact_sql_norm": same_name, "addr_exact_sql_norm": same_addr, "ctx_same_sql_norm_name": same_name, "ctx_same_sql_norm_addr": same_addr,
        "name_fuzz_ratio": "fn.ratio", "name_fuzz_wratio": "fn.wratio", "name_fuzz_token_set_ratio": "fn.token_set_ratio", "name_fuzz_token_sort_ratio": "fn.token_sort_ratio",
        "name_token_jaccard": X.jaccard(d, sets("b1"), sets("b2")),
        "name_char_ngram_jaccard": X.jaccard(d, X.ngrams(d, "n1", 3), X.ngrams(d, "n2", 3)),
        "name_len_diff": "abs(length(n1) - length(n2))", "name_len_ratio": X.length_ratio(d, "n1", "n2"),
        "addr_fuzz_ratio": "fa.ratio", "addr_fuzz_token_set_ratio": "fa.token_set_ratio",
        "addr_token_jaccard": X.jaccard(d, sets("a1"), sets("a2")),
        "addr_len_diff": "abs(length(a1) - length(a2))", "addr_len_ratio": X.length_ratio(d, "a1", "a2"),
        "addr_numeric_overlap_count": d.size(d.both(X.digits(d, "addr1"), X.digits(d, "addr2"))), "addr_numeric_jaccard": X.jaccard(d, X.digits(d, "addr1"), X.digits(d, "addr2")),
        "ctx_country_match": "c1 = c2 AND c1 <> 'UNKNOWN'",
        "ctx_same_cp_key": f"country1 = country2 AND {X.prefix_key(d, 'name1')} = {X.prefix_key(d, 'name2')} AND length({X.prefix_key(d, 'name1')}) >= 3",
        "ctx_candidate_is_s2": "candidate_source = 'S2'", "ctx_candidate_is_s3": "candidate_source = 'S3'",
        "ctx_retrieval_evidence_count": "evidence_" if "evidence" in pairs.columns else "0",
    }
    if "evidence" in pairs.columns:
        df = df.withColumn("evidence_", evidence_count(pairs, "evidence"))
    df = df.withColumns({f: F.coalesce(F.expr(number[f]).cast("double"), F.lit(0.0)) for f in FEATURES})
    return df.drop(*side, "fn", "fa", "evidence_")


def train(features: DataFrame, rounds: int = 20, depth: int = 5):
    """A gradient-boosted classifier of ``label``, classes weighted to equal sums; of
    positives only those that were retrieved."""
    rows = features.where("label = 0 OR in_retrieval")
    n = rows.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    weight = F.when(F.col("label") == 1, (n.n - n.p) / max(n.p, 1)).otherwise(1.0)
    data = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows.withColumn("w", weight))
    return GBTClassifier(featuresCol="x", labelCol="label", weightCol="w", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=7).fit(data)


def predict(model, features: DataFrame) -> DataFrame:
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(features))
    return scored.withColumn("proba", vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")


def importance(model) -> dict[str, float]:
    """Each feature's share of the gain; the shares add up to 1."""
    shares = model.featureImportances.toArray()
    return dict(zip(FEATURES, (shares / (shares.sum() or 1)).tolist(), strict=True))


def split_val(ids: DataFrame, fraction: float = 0.2, seed: int = 7, column: str = "s1_id") -> DataFrame:
    """``ids`` with is_val, by md5 of seed and id alone."""
    at = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column))), 1, 8), 16, 10).cast("long") % 10000
    return ids.withColumn("is_val", at < round(fraction * 10000))
