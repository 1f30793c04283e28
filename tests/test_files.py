"""Files in and out, models, the postings index, and the checks of result files."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import scoring, validation
from weftline.sources import files, tsv

PAIR = "s1_id string, cand_id string, candidate_source string, label int, in_retrieval boolean, name1 string, name2 string, addr1 string, addr2 string, country1 string, country2 string"


def records(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "entity_id string")


def test_load_split(spark, tmp_path):
    for k in (1, 2, 3):
        (tmp_path / f"train_source{k}.tsv").write_text(f"entity_id\tbusiness_name\tbusiness_address\tcountry\nS{k}-1\tn\ta\t US \n")
    got = {r.src: r for r in files.load_split(spark, str(tmp_path), "train").collect()}
    assert sorted(got) == ["S1", "S2", "S3"] and got["S2"].entity_id == "S2-1" and got["S2"].country == "US"
    with pytest.raises(ValueError):
        files.load_split(spark, str(tmp_path), "dev")


def test_candidate_file_and_metrics(spark, tmp_path):
    pairs = spark.createDataFrame([("S1-1", "S2-2"), ("S1-1", "S3-1"), ("S1-2", "S2-9")], "s1_id string, cand_id string")
    metrics = files.write_candidates(pairs, records(spark, "S1-1", "S1-2", "S1-3"), str(tmp_path / "c"))
    assert metrics == {"s1_rows": 3, "total_candidate_ids": 3, "max_per_s1": 2, "empty_rows": 1} == files.read_json(spark, str(tmp_path / "c.metrics"))
    got = {r.s1_id: r.cand_ids for r in files.scan_candidates(spark, str(tmp_path / "c")).collect()}
    assert got == {"S1-1": ["S2-2", "S3-1"], "S1-2": ["S2-9"], "S1-3": []}
    assert validation.check_candidates(spark, str(tmp_path / "c"), records(spark, "S1-1", "S1-2", "S1-3"))["total_candidate_ids"] == 3


def test_scan_keeps_the_order_of_a_list(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("source1_entity_id\tcandidate_entity_ids\nS1-1\tS3-2, S2-1,,S3-2 ,S2-0\n")
    assert files.scan_candidates(spark, str(tmp_path / "c.tsv")).first().cand_ids == ["S3-2", "S2-1", "S2-0"]


@pytest.mark.parametrize("text, what", [
    ("", "empty"), ("source1_entity_id,candidate_entity_ids\nS1-1,S2-1\n", "comma"), ("a\tb\nS1-1\tS2-1\n", "unexpected header"),
    ("source1_entity_id\tcandidate_entity_ids\n\tS2-1\n", "empty source1_entity_id"), ("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1\nS1-1\tS2-2\n", "duplicate source1_entity_id"),
    ("source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S2-1\n", "duplicate candidate ids"), ("source1_entity_id\tcandidate_entity_ids\nS1-1\tS1-4\n", "no candidate source"),
    ("source1_entity_id\tcandidate_entity_ids\n", "missing ids"), ("source1_entity_id\tcandidate_entity_ids\nS1-1\t\nS1-7\tS2-1\n", "unexpected extra ids"),
])
def test_broken_candidate_files_are_refused(spark, tmp_path, text, what):
    (tmp_path / "c.tsv").write_text(text)
    with pytest.raises(ValueError, match=what):
        validation.check_candidates(spark, str(tmp_path / "c.tsv"), records(spark, "S1-1"))


def test_findings(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S2-1\nS1-1\t\nno tab\nS1-2\tS1-3,X-1,S2-404\nS1-9\tS3-1\n")
    got = {r.fault: r.n for r in validation.findings(spark, str(tmp_path / "m.tsv"), records(spark, "S1-1", "S1-2", "S1-5"), records(spark, "S2-1", "S3-1")).collect()}
    assert got == {"malformed row": 1, "duplicate row": 1, "duplicate id in a list": 1, "self match": 1, "wrong prefix": 1, "missing record": 1, "extra record": 1, "unknown id": 1}
    (tmp_path / "h.tsv").write_text("a,b\n")
    assert [r.fault for r in validation.findings(spark, str(tmp_path / "h.tsv"), records(spark)).collect()] == ["header: comma separated"]


def test_candidate_source_refuses_other_ids(spark):
    df = spark.createDataFrame([("S2-1",), ("S3-1",)], "id string")
    assert [r[0] for r in df.select(files.candidate_source(F.col("id"))).collect()] == ["S2", "S3"]
    with pytest.raises(Exception, match="no candidate id"):
        spark.createDataFrame([("S1-1",)], "id string").select(files.candidate_source(F.col("id"))).collect()


def test_merge_of_many_to_one(spark):
    left = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, x int")
    right = spark.createDataFrame([("a", "A"), ("b", "B")], "k string, y string")
    assert validation.merged(left, right, "k").count() == 3
    with pytest.raises(ValueError, match="unique"):
        validation.merged(left, right.union(right), "k")
    with pytest.raises(ValueError, match="isn't there"):
        validation.merged(left, right.where("k = 'a'"), "k")


def test_equal_retrievals(spark):
    one = spark.createDataFrame([("a", "x"), ("a", "y")], "s1_id string, cand_id string")
    assert validation.same_candidates(one, one.union(one)) and not validation.same_candidates(one, one.limit(1))
    assert validation.outside_candidates(one, one.where("cand_id = 'x'")).collect() == [("a", "y")]


def test_index_partitions_are_replaced_and_pruned(spark, tmp_path):
    schema = "channel string, target string, key string, entity_id string"
    old = spark.createDataFrame([("b", "S2", "k", "S2-1"), ("b", "S3", "k", "S3-1"), ("n", "S2", "k", "S2-7")], schema)
    tsv.write_index(old, str(tmp_path / "i"), {"n": 1})
    files.replace_partitions(spark.createDataFrame([("b", "S2", "k", "S2-5"), ("b", "S2", "j", "S2-6")], schema), str(tmp_path / "i"))
    queries = spark.createDataFrame([("S1-1", "k")], "s1_id string, key string")
    assert sorted(r.cand_id for r in files.look_up(queries, str(tmp_path / "i"), "b").collect()) == ["S2-5", "S3-1"]
    found = files.look_up(queries, str(tmp_path / "i"), "b", "S2")
    assert [r.cand_id for r in found.collect()] == ["S2-5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(channel" in plan and "(target" in plan.split("PartitionFilters")[1]


def pairs_of(spark):
    rows = [(f"S1-{k}", f"S2-{k}", "S2", k % 2, True, f"Acme Corp {k}", f"Acme Corp {k}" if k % 2 else f"Zeta {k * 7}", "1 Main St", "1 Main St" if k % 2 else "9 Oak", "US", "US") for k in range(40)]
    return spark.createDataFrame(rows, PAIR)


def test_model_and_features_are_kept(spark, tmp_path):
    features = scoring.pair_features(pairs_of(spark))
    files.write_features(features, str(tmp_path / "f"))
    files.write_features(features.limit(5), str(tmp_path / "f"), append=True)
    kept = spark.read.parquet(str(tmp_path / "f"))
    assert kept.count() == 45 and kept.columns == features.columns and any(".zstd." in p.name for p in (tmp_path / "f").iterdir())
    model = scoring.train(kept, rounds=2, depth=2)
    files.save_model(model, str(tmp_path / "m"), features=scoring.FEATURES, seed=7)
    again, facts = files.load_model(spark, str(tmp_path / "m"))
    assert facts == {"trees": 2, "features": scoring.FEATURES, "seed": 7}
    before, after = ({r.s1_id: r.proba for r in scoring.predict(m, features).collect()} for m in (model, again))
    assert before == after
    shares = scoring.importance(again)
    assert list(shares) == scoring.FEATURES and abs(sum(shares.values()) - 1) < 1e-9


def test_evidence_and_flags(spark):
    rows = spark.createDataFrame([(1, {"a": 2.0, "b": 0.0}, {"a": " ", "b": "x", "c": None}, {"a": True, "b": False}), (2, None, None, None)], "id int, n map<string,double>, s map<string,string>, b map<string,boolean>")
    got = rows.select("id", *[scoring.evidence_count(rows, c).alias(c) for c in "nsb"]).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 1.0, 1.0, 1.0), (2, 0.0, 0.0, 0.0)]
    pairs = pairs_of(spark).limit(3).withColumn("evidence", F.create_map(F.lit("bn"), F.lit(1), F.lit("ba"), F.lit(0)))
    assert {r[0] for r in scoring.pair_features(pairs).select("ctx_retrieval_evidence_count").collect()} == {1.0}
    alike = spark.createDataFrame([("1", "a", "S2", 0, True, "Acme Corp", "Acme Corp.", "x", "y", "US", "US"), ("2", "b", "S2", 1, True, "Acme Corp", "Acme Corp", "x", "x", "US", "US"), ("3", "c", "S2", 0, True, "Acme", "Other name", "x", "y", "US", "IN")], PAIR)
    flags = {r.s1_id: r for r in scoring.hard_flags(scoring.pair_features(alike)).collect()}
    assert flags["1"].hard_similar_name and flags["1"].hard_same_name and flags["1"].hard_same_country and flags["1"].hard_same_cp
    assert not any(flags[k][c] for k in "23" for c in ("hard_similar_name", "hard_same_name", "hard_same_country", "hard_same_cp"))


def test_report(spark, tmp_path):
    df = spark.createDataFrame([(2, "b|c"), (1, None)], "n int, t string")
    files.write_report({"part": df}, str(tmp_path / "r"), title="Facts")
    text = "\n".join(p.read_text() for p in (tmp_path / "r" / "report.md").glob("part-*"))
    assert text.startswith("# Facts") and "| n | t |" in text and "| 2 | b\\|c |" in text
    assert spark.read.option("header", True).csv(str(tmp_path / "r" / "part.csv")).count() == 2
    assert json.loads(spark.read.text(str(tmp_path / "r" / "part.json")).orderBy("value").first()[0])["n"] in (1, 2)
