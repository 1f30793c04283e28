"""Comparison of records in tasks that hold a key's records of both sides."""

import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import expr as X
from weftline.functions import unicode as U
from weftline.operators import compare, ratios, scoring
from weftline.plans import frames, registry, relational


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("few", [0, 10**9])
def test_distances_are_levenshteins(monkeypatch, few):
    """In vectors and one by one, over no, one and several words of 64 places."""
    monkeypatch.setattr(compare, "FEW", few)
    monkeypatch.setattr(compare, "SLICE", 7)
    rng = random.Random(1)
    texts = ["", "a", "ab" * 32, "ab" * 64, "ba" * 70] + ["".join(rng.choice("abc ") for _ in range(rng.choice([3, 63, 64, 65, 130]))) for _ in range(9)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    got = compare.distances(texts, texts, *(compare.np.array(v) for v in zip(*pairs, strict=True)))
    assert got.tolist() == [plain(texts[i], texts[j]) for i, j in pairs]


@pytest.mark.parametrize("few", [0, 10**9])
def test_common_members(monkeypatch, few):
    monkeypatch.setattr(compare, "FEW", few)
    rng = random.Random(2)
    sets = [frozenset(rng.sample("abcdefgh", rng.randrange(6))) for _ in range(20)]
    pairs = [(i, j) for i in range(20) for j in range(20)]
    got = compare.common(sets, sets, *(compare.np.array(v) for v in zip(*pairs, strict=True)))
    assert got.tolist() == [len(sets[i] & sets[j]) for i, j in pairs]


def test_ratios_are_rounded_as_in_sql(spark):
    values = [(p, q) for q in (1, 3, 7, 64, 128, 160) for p in range(q + 1)]
    want = [(r.a, r.b) for r in spark.createDataFrame(values, "p int, q int").selectExpr("round(p / q, 6) AS a", "round(1 - p / q, 6) AS b").collect()]
    p, q = (compare.np.array(v) for v in zip(*values, strict=True))
    assert list(zip(compare.shares(p, q, 0.0).tolist(), compare.shares(p, q, 0.0, one_less=True).tolist(), strict=True)) == want


@pytest.fixture(scope="module")
def odd(spark):
    """Records of few words: legal forms twice, ampersands, orders of words, numbers, nothing, not ASCII."""
    rng = random.Random(4)
    names = ["Acme & Sons Ltd", "acme and sons ltd.", "Acme Sons", "ACME & SONS LTD", "Acme Corp Corporation", "Corporation Acme corp.", "Acme Wodgets Inc", "acme widgets inc", "Acmé", "", None, "acme"]
    addrs = ["12 Main St., 12345", "12 main street 12345", "Main St 12", "12345-6789 Rd road", "", None, "rd 9 123456", "Calle Ñ 1"]
    rows = [(f"S{1 + k % 3}-{k}", f"S{1 + k % 3}", rng.choice(names), rng.choice(addrs), rng.choice(["en", "de", "", None]), rng.choice([*"abcdefgh", None])) for k in range(300)]
    e = spark.createDataFrame(rows, "entity_id string, src string, business_name string, business_address string, country string, content string")
    e.createOrReplaceTempView("odd_records")
    return e


@pytest.mark.parametrize("small", [False, True])
@pytest.mark.parametrize("name,run", [("transform_labels", frames._transform_labels), ("transform_examples", frames._transform_examples), ("pair_features_13", frames._thirteen)])
def test_odd_records_as_by_sql(spark, odd, monkeypatch, name, run, small):
    """Also in many parts and tiles, with vectors for two pairs."""
    if small:
        for limit, value in (("PART", 40), ("TILE", 64), ("SLICE", 16), ("FEW", 2)):
            monkeypatch.setattr(compare, limit, value)
    monkeypatch.setitem(relational.CTES, "e", ((), lambda d: "SELECT * FROM odd_records"))
    sql = spark.sql(relational.render(name, X.SPARK))
    got = run(odd)
    assert [(f.name, f.dataType) for f in got.schema] == [(f.name, f.dataType) for f in sql.schema]
    want = sorted(map(tuple, sql.collect()), key=str)
    assert sorted(map(tuple, got.collect()), key=str) == want and len(want) > 20


def test_no_pair_is_shuffled(spark, tmp_path):
    """3000 records of one name: 2 million pairs, made and compared after the last exchange of a plan without a join of pairs."""
    text = "concat('Acme Widgets\n', repeat('x', 80), id)"
    spark.range(3000).selectExpr("id AS doc_id", f"{text} AS text", "'en' AS lang", "'web' AS source", f"length({text}) AS n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["pair_features_13"](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") >= 1 and plan.index("MapInArrow") < plan.index("Exchange") and df.count() == 1000 * 2000
    labels = {(r.field, r.pattern, r.label): r.n for r in registry.queries()["transform_labels"](spark, str(tmp_path)).collect()}
    assert labels["name", "exact", 0] == 1000 * 2000


@pytest.fixture(scope="module")
def many(spark, odd):
    """The odd records and some of longer names, in any script, with equal keys."""
    rng = random.Random(6)
    words = ["Acme", "Widgets", "Société", "Ltd", "&", "नगर", "of", "Northern", "Lights", "a", "12", "Bakery"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(f"S{1 + k % 3}-m{k}", f"S{1 + k % 3}", "Acme " + text(rng.choice([0, 1, 3, 12, 16])), rng.choice([None, text(4) + " 123", text(16)]), rng.choice(["en", "in", "India", None]), rng.choice([*"abcdefgh", None])) for k in range(240)]
    return frames.blocks.keyed(odd.unionByName(spark.createDataFrame(rows, odd.schema)))


def pairs_of(spark, records):
    """The plan of pairs over records."""
    records.drop("cp", "bn", "ba").createOrReplaceTempView("many_records")
    return spark.sql(relational.render_cte("pairs", X.SPARK))


def limits(monkeypatch):
    for limit, value in (("PART", 40), ("TILE", 64)):
        monkeypatch.setattr(compare, limit, value)
    monkeypatch.setattr(ratios, "FEW", 0)


@pytest.mark.parametrize("small", [False, True])
def test_fuzzy_ratios_of_each_pair(spark, many, monkeypatch, small):
    """Equal to those found pair by pair, and no pair is shuffled: they are made after the last exchange."""
    if small:
        limits(monkeypatch)
    monkeypatch.setitem(relational.CTES, "e", ((), lambda d: "SELECT * FROM many_records"))
    pairs = pairs_of(spark, many)
    of = pairs.select("s1_id", "cand_id", U.fuzzy(U.normalize_name(F.col("name1")), U.normalize_name(F.col("name2"))).alias("f")).select("s1_id", "cand_id", "f.*")
    got = frames._fuzzy_ratios(many)
    assert got.dtypes == of.dtypes and "Join" not in (plan := got._jdf.queryExecution().executedPlan().toString()).split("Exchange")[0] and "MapInArrow" in plan
    want = sorted(map(tuple, of.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5000


@pytest.mark.parametrize("small", [False, True])
def test_24_features_of_each_pair(spark, many, monkeypatch, small):
    """Equal to those of the pairs, one by one, labels and retrieval among them."""
    if small:
        limits(monkeypatch)
    monkeypatch.setitem(relational.CTES, "e", ((), lambda d: "SELECT * FROM many_records"))
    want = scoring.pair_features(pairs_of(spark, many)).select("s1_id", "cand_id", F.col("label").cast("int"), "in_retrieval", *scoring.FEATURES)
    got = frames._features(many)
    assert got.dtypes == want.dtypes
    want = sorted(map(tuple, want.collect()))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 5000


@pytest.mark.parametrize("small", [False, True])
def test_six_features_of_each_pair(spark, many, monkeypatch, small):
    """Equal to those of the pairs, one by one; the cosine, of which the order of the sum is free, nearly."""
    if small:
        limits(monkeypatch)
    monkeypatch.setitem(relational.CTES, "e", ((), lambda d: "SELECT * FROM many_records"))
    six = frames._record_cosine(many, scoring.pair_features(pairs_of(spark, many)))
    want = six.select(
        "s1_id", "cand_id", F.col("label").cast("tinyint"), F.col("name_fuzz_ratio").cast("float"), F.col("name_token_jaccard").cast("float"), F.col("addr_token_jaccard").cast("float"),
        (F.col("country1") == F.col("country2")).cast("tinyint"), F.col("name_len_diff").cast("int"), "cosine",
    )
    got = frames._six_features(many)
    assert [t for c, t in got.dtypes if c != "name_address_tfidf_cosine"] == [t for c, t in want.dtypes if c != "cosine"]
    want, got = ({(r[0], r[1]): r for r in df.collect()} for df in (want, got.select(*[c for c in got.columns if c != "name_address_tfidf_cosine"], "name_address_tfidf_cosine")))
    assert want.keys() == got.keys() and len(want) > 5000
    assert all(got[p][:-1] == want[p][:-1] and abs(got[p][-1] - want[p][-1]) < 1e-6 for p in want)
