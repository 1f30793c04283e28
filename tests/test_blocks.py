"""Queries over the pairs of the baseline keys, at blocks too large to form pairs one by one."""

import random

import pytest

from weftline.plans import blocks, registry


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def one_block(spark, tmp_path_factory):
    """30 000 documents with one name: 2e8 pairs, of which 5000 x 2 are true."""
    path = str(tmp_path_factory.mktemp("block"))
    text = "concat('Acme Widgets\n', repeat('x', 80), CASE WHEN id < 15000 THEN id DIV 3 ELSE id END)"
    spark.range(30_000).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "'web' AS source", f"length({text}) AS n_chars").write.parquet(f"{path}/documents.parquet")
    return path


def test_class_balance_of_a_large_block(spark, one_block):
    df = registry.queries()["class_balance"](spark, one_block)
    assert "Join" not in plan_of(df)
    r = df.first()
    assert (r.n_pos, r.n_neg) == (10_000, 10_000 * 20_000 - 10_000)


def test_candidate_quality_of_a_large_block(spark, one_block):
    df = registry.queries()["candidate_quality"](spark, one_block)
    assert "Join" not in plan_of(df)
    assert {r.candidate_source: (r.candidates, r.tp) for r in df.collect()} == {"S2": (10**8, 5000), "S3": (10**8, 5000)}


def test_entity_recall_of_a_large_block(spark, one_block):
    df = registry.queries()["entity_recall"](spark, one_block)
    assert "Generate" not in plan_of(df)
    assert tuple(df.first()) == (5000, 5000, 1.0)


def test_family_ablation_of_a_large_block(spark, one_block):
    df = registry.queries()["family_ablation"](spark, one_block)
    assert "Join" not in plan_of(df)
    got = {r.cond: (r.candidates, r.true_pairs) for r in df.collect()}
    assert got["bn"] == got["cp"] == got["bn+cp"] == got["all"] == (2 * 10**8, 10_000) and got["ba+cp"] == got["all"]


def test_each_pair_is_met_once(spark, monkeypatch):
    """In small chunks and parts: candidates under their first common key, and true pairs that share none."""
    monkeypatch.setattr(blocks, "CHUNK", 2)
    monkeypatch.setattr(blocks, "PART", 5)
    rng = random.Random(5)
    some = lambda *v: rng.choice([*v, None])
    rows = [(f"S{1 + k % 3}-{k}", f"S{1 + k % 3}", some("a", "b"), some(*"cdef"), some(*"ghij"), some(*"klmnop"), rng.choice("xy")) for k in range(60)]
    records = spark.createDataFrame(rows, "entity_id string, src string, cp string, bn string, ba string, content string, name string")
    got = [(r.s1_id, r.cand_id, r.kind) for r in blocks.unfolded(blocks.met(records, ["name"]), "kind").collect()]
    want = set()
    for a in (r for r in rows if r[1] == "S1"):
        for b in (r for r in rows if r[1] != "S1"):
            same = [k for k in range(4) if a[2 + k] is not None and a[2 + k] == b[2 + k]]
            want |= {(a[0], b[0], same[0])} if same else set()
    assert len(got) == len(set(got)) and set(got) == want and {k for _, _, k in want} == {0, 1, 2, 3}
