"""Text functions, keys, metrics and every relational query against its oracle."""

import ast
import math
import re
import unicodedata
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.functions import expr as X
from weftline.functions import unicode as U
from weftline.operators import scoring
from weftline.plans import frames, registry
from weftline.sources import tsv
from weftline.streaming import retrieval

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[1]


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def rows(found, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    cell = lambda x: f"{x:.6f}" if isinstance(x, float) else str(x)
    return Counter(tuple(cell(r[k]) for k in order) for r in found)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_oracle(spark, oracle, name):
    df, want = registry.queries()[name](spark, SF), oracle.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.collect(), df.columns) == rows(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql()) - {"train_predict"}))
def test_query_without_oracle_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


@pytest.mark.parametrize("name", ["retrieval_exact", "retrieval_cp_max_df", "channel_char_ngram", "submission_candidates", "pair_recall"])
def test_candidates_come_from_equi_joins(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def value(spark, sql):
    return spark.sql(f"SELECT {sql} AS x").first().x


@pytest.mark.parametrize(("p", "r", "want"), [(2 / 3, 1, 5 / 7), (1, 1, 1), (0, 0, 0), (1 / 3, 1, 1.25 / 3 / (0.25 / 3 + 1))])
def test_f05(spark, p, r, want):
    assert math.isclose(value(spark, X.f_score(f"CAST({p} AS DOUBLE)", f"CAST({r} AS DOUBLE)")), want)


def test_text_forms(spark):
    df = spark.createDataFrame([("Société Générale & Cie", "सदर्न"), (None, "Acme")], "a string, b string")
    got = df.select(U.normalize_name(df.a).alias("n"), U.script(df.b).alias("s"), U.transliterated(df.b).alias("t")).collect()
    assert got[0].n == "socie te ge ne rale and cie" and (got[0].s, got[1].s) == ("non-Latin", "Latin")
    assert got[0].t == "sdrn" and got[1].n == "" and got[1].t == "Acme"
    assert value(spark, X.legal_text(X.SPARK, "'www.Acme_Corp & Sons Pvt. Ltd'")) == "acme corporation and sons private limited"
    assert value(spark, X.country(X.SPARK, "' india'")) == "IN" and value(spark, X.country(X.SPARK, "''")) == "UNKNOWN"


def labels_of(spark, field, a, b):
    """The labels of two names or addresses."""
    lit = lambda x: "CAST(NULL AS STRING)" if x is None else "'" + x + "'"
    d, parts = X.SPARK, []
    for k, x in (("1", lit(a)), ("2", lit(b))):
        n, t = X.norm_name(d, x), X.norm_addr(d, x)
        parts.append(f"{x} AS {field}{k}, {X.basic(d, x)} AS b{field[0]}{k}, {n if field == 'name' else t} AS n{field[0]}{k}, {X.token_set(d, n)} AS nt{k}, {X.token_set(d, t)} AS aset{k}, {X.digits(d, x)} AS dg{k}, {X.postal(d, x)} AS po{k}")
    rule = X.name_transforms(d) if field == "name" else X.address_transforms(d)
    return spark.sql(f"SELECT {rule} AS x FROM (SELECT {', '.join(parts)})").first().x


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Acme", "Acme", ["exact"]),
        (None, "", ["exact"]),
        ("Acme", " ACME", ["case_only", "normalized_exact"]),
        ("Acme-Web", "acme web", ["punctuation_only"]),
        ("Fox & Hen", "Fox and Hen", ["punctuation_only", "ampersand_and"]),
        ("Acme Ltd.", "Ltd Acme", ["suffix_limited", "word_order"]),
        ("Blue Fox", "Blue Fox Shop", ["missing_or_extra_words"]),
        ("Blue Foxes", "Blue Foxed", ["minor_token_diff", "typo_or_substitution"]),
        ("Corp Corporation", "x", ["suffix_corporation", "suffix_corporation"]),
        ("Alpha", "Omega Nine Zed", ["other_variation"]),
    ],
)
def test_name_labels(spark, a, b, want):
    assert labels_of(spark, "name", a, b) == want


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("1 Elm", "1 Elm", ["exact"]),
        ("1 ELM", "1 elm", ["case_only", "normalized_exact"]),
        ("1 Elm Rd.", "1 Elm Road", ["abbrev_road", "abbrev_road"]),
        ("Elm 12345", "Elm", ["missing_numbers", "missing_postal"]),
        ("Elm 12345", "Elm 54321", ["numeric_diff", "postal_diff"]),
        ("Elm, 7", "7 Elm", ["component_reorder"]),
        ("Elm", "Oak", ["other_variation"]),
    ],
)
def test_address_labels(spark, a, b, want):
    assert labels_of(spark, "addr", a, b) == want


@pytest.mark.parametrize(
    ("n1", "n2", "a1", "a2", "want"),
    [
        ("Caf\u00e9", "Cafe", "1 Elm", "1 Elm", "transliteration/multilingual"),
        ("Cafe", "Cafe", "1 Elm", None, "missing_address"),
        ("Cafe", "cafe", "1 Elm", "2 Elm", "address_normalization_failure"),
        ("Cafe", "Bistro", "1 Elm", "1 elm", "name_normalization_failure"),
        ("Blue Fox", "Fox Blue", "1 Elm", "2 Elm", "word_order"),
        ("Blue Pvt", "Red", "1 Elm", "2 Elm", "abbreviation/legal_suffix"),
        ("Blue Fox", "Blue Hen", "1 Elm", "2 Elm", "minor_token_diff/typo"),
        ("Blue", "Red", "1 Elm", "2 Elm", "common_name/short_name"),
        ("Northern Lights Bakery", "Harbour View Kitchen", "1 Elm", "2 Elm", "semantic_dba_or_other"),
    ],
)
def test_failure_categories(spark, n1, n2, a1, a2, want):
    df = spark.createDataFrame([(n1, n2, a1, a2)], "name1 string, name2 string, addr1 string, addr2 string")
    assert df.selectExpr(f"{X.failure_category(X.SPARK)} AS x").first().x == want


def test_structured_address_keys(spark):
    keys = value(spark, X.submission_keys(X.SPARK, "'Acme Widgets'", "'H.No.16-11-23/37/A'", "'in'"))
    assert "IN|hn:16-11-23/37/a" in keys and "IN|dg:37" in keys and sum("hn:" in k or "dg:" in k for k in keys) == 5
    runs = value(spark, X.structured_digits(X.SPARK, "'16-11-23/37/A 99 7.88'"))
    assert runs == ["16", "11", "23", "37", "88"]


def test_blocking_example(spark):
    records = [("S2-A", "Acme Widgets LLC", "100 Main Street", "US"), ("S2-B", "Acme Supplies Inc", "200 Oak Avenue", "US"), ("S2-C", "Beta Only Corp", "100 Main Street", "US"), ("S3-X", "Gamma Shop", "7 Gamma Road", "FR"), ("S1-P", "Acme Widgets LLC", "100 Main Street", "US")]
    df = spark.createDataFrame(records, tsv.RECORDS)
    keys = df.selectExpr("entity_id", f"explode({X.baseline_keys(X.SPARK, 'business_name', 'business_address', 'country')}) AS key")
    postings, query = keys.where("entity_id <> 'S1-P'"), df.where("entity_id = 'S1-P'")
    hits = retrieval.candidates(query, postings).collect()
    found = {}
    for h in hits:
        found.setdefault(h.cand_id, set()).add(h.key[:2])
    assert found == {"S2-A": {"bn", "ba", "cp"}, "S2-B": {"cp"}, "S2-C": {"ba"}}


def test_stream_of_records(spark, tmp_path):
    records = [("S1-1", "Acme Widgets", "1 Main", "US"), ("S1-2", "Other", "", "US")]
    spark.createDataFrame(records, tsv.RECORDS).write.parquet(str(tmp_path / "in"))
    postings = spark.createDataFrame([("bn:acme widgets", "S2-9")], "key string, entity_id string")
    stream = spark.readStream.schema(tsv.RECORDS).parquet(str(tmp_path / "in"))
    q = retrieval.candidates(stream, postings).writeStream.format("memory").queryName("found").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert [tuple(r) for r in spark.table("found").collect()] == [("S1-1", "S2-9", "bn:acme widgets")]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


@settings(max_examples=200, deadline=None)
@given(st.text("abc d", max_size=12), st.text("abc d", max_size=12))
def test_ratios(a, b):
    assert U.common_subsequence(a, b) == subsequence(a, b)
    for f in (U.ratio, U.token_sort, U.token_set, U.partial, U.weighted):
        assert 0 <= f(a, b) <= 1 and math.isclose(f(a, b), f(b, a))
    assert U.ratio(a, a) == 1 and U.partial(a, a + b) == 1 or not a


PAIR = "s1_id string, cand_id string, candidate_source string, label int, in_retrieval boolean, name1 string, name2 string, addr1 string, addr2 string, country1 string, country2 string"


def test_pair_features(spark):
    pairs = [
        ("1", "a", "S2", 1, True, "Acme Corp & Co.", "Acme Corp & Co.", "123 Main St, Boston", "123 Main St, Boston", "US", "US"),
        ("2", "b", "S3", 0, True, "Alpha LLC", "Totally Different GmbH", "1 A", "9 Zz", "US", "IN"),
        ("3", "c", "S2", 1, True, "Invictus & Co", "Invictus and Co", "123 Main Street", "124 Main Street", "US", "US"),
        ("4", "d", "S2", 0, True, None, "", "", None, None, ""),
    ]
    got = {r.s1_id: r for r in scoring.pair_features(spark.createDataFrame(pairs, PAIR)).collect()}
    assert got["1"].name_exact_sql_norm == got["1"].addr_exact_sql_norm == got["1"].ctx_country_match == 1 and got["1"].name_fuzz_ratio >= 0.99
    assert got["2"].name_exact_sql_norm == 0 and got["2"].name_fuzz_ratio < 0.5 and got["2"].ctx_country_match == 0 and got["2"].ctx_candidate_is_s3 == 1
    assert got["3"].name_fuzz_ratio > 0.7 and got["3"].name_token_jaccard >= 0.5 and got["3"].addr_numeric_overlap_count == 0 and got["3"].addr_fuzz_ratio > 0.8
    assert got["4"].name_fuzz_ratio == 1 and got["4"].name_len_diff == 0 and got["4"].ctx_country_match == 0
    assert [c for c in got["1"].asDict() if c in scoring.FEATURES] == scoring.FEATURES and len(scoring.FEATURES) == 24


def test_training(spark):
    got = frames.train_predict(spark, "/root/testdata/sf0.01").collect()
    assert got and all(0 <= r.proba <= 1 for r in got)
    pos, neg = ([r.proba for r in got if r.label == k] for k in (1, 0))
    assert not pos or sum(pos) / len(pos) > sum(neg) / len(neg)


def test_pairs_of_the_classifier_are_not_joined(spark, monkeypatch):
    """Its features are found in tasks that hold a key's records; all held-out pairs that were retrieved are scored."""
    pairs = scoring.split_val(frames._cte(spark, SF, "pairs")).where("is_val AND in_retrieval")
    want = {(r.s1_id, r.cand_id, r.label) for r in pairs.collect()}
    monkeypatch.setattr(scoring, "pair_features", None)
    got = [(r.s1_id, r.cand_id, r.label) for r in frames.train_predict(spark, SF).collect()]
    assert set(got) == want and len(got) == len(want) > 2


def test_split(spark):
    ids = scoring.split_val(spark.createDataFrame([(f"S1-{k}",) for k in range(500)], "s1_id string")).collect()
    assert 60 < sum(r.is_val for r in ids) < 140


def test_tsv(spark, tmp_path):
    path = tmp_path / "s2.tsv"
    path.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS2-1\t"open\t\t US \nS2-2\tx\ty\tFR\n')
    got = tsv.sources(spark, {"S2": str(path)}).orderBy("entity_id").collect()
    assert (got[0].business_name, got[0].business_address, got[0].country) == ('"open', None, "US")
    assert tsv.inventory(spark, str(path)).first().n_lines == 3
    s1 = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string")
    pairs = spark.createDataFrame([("S1-1", f"S2-{k:06d}") for k in range(20000)], "s1_id string, cand_id string")
    tsv.write_lists(pairs, s1, str(tmp_path / "out"))
    back = {r[0]: r[1] for r in tsv.read(spark, str(tmp_path / "out"), tsv.CANDIDATES).collect()}
    assert back["S1-1"].count(",") == 19999 and back["S1-2"] is None


def test_index_is_built_once(spark, tmp_path):
    postings = spark.createDataFrame([("b", "S2", "k", "S2-1")], "channel string, target string, key string, entity_id string")
    assert tsv.write_index(postings, str(tmp_path / "i"), {"n": 5}) and not tsv.write_index(postings, str(tmp_path / "i"), {"n": 5})
    assert tsv.write_index(postings, str(tmp_path / "i"), {"n": 6})
    assert spark.read.parquet(str(tmp_path / "i" / "postings")).count() == 1


def test_nothing_else_imports_llm():
    for p in (ROOT / "weftline").rglob("*.py"):
        if "llm" in p.relative_to(ROOT).parts:
            continue
        for node in ast.walk(ast.parse(p.read_text())):
            names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
            assert not any("llm" in n.split(".") for n in names), p


RECORDS = [
    ("S1-1", "S1", "Soci\u00e9t\u00e9 G\u00e9n\u00e9rale", "12 Rue \u00c9toile 75001", "FR"),
    ("S2-1", "S2", "Soci\u00e9t\u00e9 G\u00e9n\u00e9rale", "12 Rue \u00c9toile 75001", "FR"),
    ("S3-1", "S3", "\uff33ociete Generale & Cie", "9 Elm 75001", "DE"),
    ("S1-2", "S1", "\u0938\u0926\u0930\u094d\u0928 \u0928\u0917\u0930", "7 \u0928\u0917\u0930", "IN"),
    ("S2-2", "S2", "\u0938\u0926\u0930\u094d\u0928 \u0928\u0917\u0930", "77 Main", "IN"),
    ("S3-2", "S3", "sdrn ngr", "4500 Main", "IN"),
    ("S1-3", "S1", "Acme Widgets", "4500 Oak", "US"),
    ("S2-3", "S2", "", None, None),
]
VIEW = "entity_id string, src string, business_name string, business_address string, country string"


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(RECORDS, VIEW).withColumn("content", F.col("entity_id"))


def decomposed(x):
    return " ".join(unicodedata.normalize("NFKD", x or "").lower().split())


def grams_of(x, n=3):
    return {x[k : k + n] for k in range(len(x) - n + 1)} or ({x} if x else set())


def plain(x):
    return " ".join("".join(c if c.isalnum() or c in "_ " else " " for c in decomposed(x).replace("&", " and ")).split())


def test_grams_of_all_records(spark, records):
    got = {tuple(r) for r in frames._whole(spark, SF, "char_ngrams", records).collect()}
    assert got == {(i, g) for i, s, n, _, _ in RECORDS if s == "S1" for g in grams_of(decomposed(n).replace(" ", ""))}
    words = {tuple(r) for r in frames._whole(spark, SF, "token_rows", records).collect()}
    assert ("S1-2", "\u0938\u0926\u0930") in words and ("S1-1", "socie") in words and {i for i, _ in words} == {r[0] for r in RECORDS} - {"S2-3"}


def char_ngram_pairs(rows):
    keys = {r[0]: {g for g in grams_of(plain(r[2]).replace(" ", "")) if len(g) == 3} for r in rows}
    found = {(a[0], b[0]): len(keys[a[0]] & keys[b[0]]) for a in rows if a[1] == "S1" for b in rows if b[1] != "S1"}
    return {p: n for p, n in found.items() if n >= 2}


def test_char_ngram_channel_of_all_records(spark, records):
    got = {(r.s1_id, r.cand_id): r.score for r in frames._gram_hits(records).collect()}
    assert got == char_ngram_pairs(RECORDS) and {("S1-1", "S2-1"), ("S1-2", "S2-2")} <= set(got)


def test_cosine_of_all_records(spark, records):
    tf = {r[0]: Counter(f" {decomposed(r[2])} "[k : k + 3] for k in range(len(decomposed(r[2])))) for r in RECORDS}
    tf = {i: c for i, c in tf.items() if c}
    df = Counter(g for c in tf.values() for g in c)
    w = {i: {g: (1 + math.log(n)) * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, n in c.items()} for i, c in tf.items()}
    cos = lambda a, b: sum(a[g] * b.get(g, 0) for g in a) / math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    got = {(r.s1_id, r.cand_id): r.cosine for r in frames._whole(spark, SF, "tfidf_cosine", records).collect()}
    assert {("S1-1", "S2-1"), ("S1-2", "S2-2")} <= set(got)
    assert all(math.isclose(x, cos(w[a], w[b]), abs_tol=2e-6) for (a, b), x in got.items())


@pytest.mark.parametrize("name", ["similarity", "tokens_digits", "token_rows", "char_ngrams"])
def test_all_rows_hold_those_of_ascii_text(spark, name):
    whole, part = (rows((df := registry.queries()[n](spark, SF)).collect(), df.columns) for n in (name, f"{name}_ascii"))
    assert part <= whole and whole.total() > part.total()


def test_products_of_sparse_vectors():
    import random

    import pyarrow as pa

    from weftline.functions.vectors import dots

    rng = random.Random(2)
    side = [[dict((k, rng.random()) for k in rng.sample(range(10**12), 9) + rng.sample(range(20), rng.randrange(12))) for _ in range(50)] + [{}] for _ in range(2)]
    arrays = [pa.array([list(f(v)) for v in s], t) for s in side for f, t in ((dict.keys, pa.list_(pa.int64())), (dict.values, pa.list_(pa.float64())))]
    want = [sum(x * b[k] for k, x in a.items() if k in b) for a, b in zip(*side, strict=True)]
    assert all(math.isclose(x, y, abs_tol=1e-12) for x, y in zip(dots(*arrays), want, strict=True)) and any(want)


@pytest.mark.parametrize("name", ["tfidf_cosine", "bucket_knn"])
def test_gathered_vectors_give_the_joined_cosines(spark, name):
    one, other = registry.queries()[name](spark, SF), frames._whole(spark, SF, name)
    key = lambda df: {(r.s1_id, r.cand_id): r.cosine for r in df.collect()}
    one, other = key(one), key(other)
    assert one.keys() == other.keys() and all(abs(one[k] - other[k]) < 2e-6 for k in one)


def all_channel_pairs(rows):
    """Of records with at most a few candidates: pairs that any channel finds."""
    lower = lambda x: " ".join("".join(c if unicodedata.category(c)[0] in "LN" or c in "_&" else " " for c in (x or "").lower()).split())

    def baseline(r):
        n, a = lower(r[2]), lower(r[3]).replace("&", "")
        return {k for k in (("bn", n), ("ba", a), ("cp", r[4], n[:5]) if len(n[:5]) >= 3 and r[4] else None) if k and k[1]}

    def numbers(r):
        a = r[3] or ""
        house = re.match(r"\s*(\d+[a-zA-Z]?)\b", a, re.A)
        return {("num", x) for x in re.findall("[0-9]+", a) if len(x) >= 3} | ({("house", house[1].lower())} if house else set())

    def latin(r):
        t = plain(U.to_latin(r[2]))
        grams = {g for g in grams_of(t.replace(" ", "")) if len(g) == 3} if not (r[2] or "").isascii() else set()
        return t if len(t) >= 4 else None, grams

    found = set(char_ngram_pairs(rows))
    for a in (r for r in rows if r[1] == "S1"):
        for b in (r for r in rows if r[1] != "S1"):
            (x, g), (y, h) = latin(a), latin(b)
            if baseline(a) & baseline(b) or numbers(a) & numbers(b) or x and x == y or len(g & h) >= 2:
                found.add((a[0], b[0]))
    return found


def test_all_four_channels(spark, records):
    got = [tuple(r) for r in frames._all_channels(spark, SF, records).collect()]
    assert len(got) == len(set(got)) and set(got) == all_channel_pairs(RECORDS)
    #: by address numbers alone, and by transliteration alone
    assert {("S1-3", "S3-2"), ("S1-2", "S3-2")} <= set(got)


def test_family_keys_of_all_records(spark):
    rows = [
        ("S1-1", "S1", "\u092d\u093e\u0930\u0924 \u092c\u0948\u0902\u0915", "12-345 MG Road 560001", "India"),
        ("S2-1", "S2", "Caf\u00e9 BMW Ltd", None, "FR"),
        ("S3-1", "S3", None, "\u0967\u0968\u0969\u096a\u096b", "IN"),
        ("S3-2", "S3", "Acme Widgets", "", None),
        ("S3-3", "S3", "", "", ""),
    ]
    got = {}
    for i, key in frames._family_keys(spark.createDataFrame(rows, VIEW)).collect():
        got.setdefault(i, []).append(key)
    assert all(len(k) == len(set(k)) for k in got.values())
    want = {
        "S1-1": "India|sn:\u0930\u0924 India|np:bhar India|tl:bhar India|np:bain India|tl:bain India|pin:560001 India|dg:345 India|dg:560001 India|dg:12345",
        "S2-1": "FR|np:caf\u00e9 FR|np:cafe FR|tl:cafe FR|sn:bmw FR|ng:caf FR|ng:af\u00e9 FR|ng:lim",
        "S3-1": "IN|pin:\u0967\u0968\u0969\u096a\u096b IN|dg:\u0967\u0968\u0969\u096a\u096b",
        "S3-2": "|np:acme |np:widg |ng:acm |ng:cme |ng:wid",
        "S3-3": "|fb:_",
    }
    # a gram that is left out, and a legal form that is a stop word, give no key
    want["S2-1"] = want["S2-1"].replace(" FR|ng:lim", "")
    assert {i: set(k) for i, k in got.items()} == {i: set(k.split()) for i, k in want.items()}


def test_submission_cap_follows_key_order(spark):
    """The reference stops after the cap in the order of keys, then postings."""
    rows = [("S1-1", "S1", "Acme Widgets", "100 Oak", "US")]
    rows += [(f"S{2 + k % 2}-{k}", f"S{2 + k % 2}", "Other", "100 Elm", "US") for k in range(1, 8)]
    rows += [("S3-20", "S3", "Acme", "9 Elm", "US"), ("S2-100", "S2", "Acme", "8 Elm", "US"), ("S2-30", "S2", "Widgets", "7 Elm", "US")]
    df = spark.createDataFrame(rows, VIEW)
    want = ["S2-100", "S3-20", "S2-30", "S2-2", "S2-4", "S2-6", "S3-1", "S3-3", "S3-5", "S3-7"]
    for cap in (1, 3, 5, 10):
        assert {tuple(r) for r in frames._submission(df, cap).collect()} == {("S1-1", i) for i in want[:cap]}


def test_cosine_of_names_and_addresses(spark, records):
    texts = {}
    for i, _, n, a, _ in RECORDS:
        form = lambda x: " ".join("".join(c if re.match(r"[^\W_]", c) else " " for c in unicodedata.normalize("NFKC", x or "").lower().replace("&", " and ")).split())
        t = form(U.to_latin(n))
        texts[i] = " ".join(x for x in (form(n), t if not n.isascii() and t != form(n) else "", form(a)) if x)
    tf = {i: Counter(w[k : k + m] for w in (f" {w} " for w in t.split()) for m in (3, 4) for k in range(len(w) - m + 1)) for i, t in texts.items()}
    df = Counter(g for c in tf.values() for g in c)
    w = {i: {g: (1 + math.log(n)) * (math.log((1 + len(tf)) / (1 + df[g])) + 1) for g, n in c.items()} for i, c in tf.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in w.items()}
    pairs = spark.createDataFrame([(a[0], b[0]) for a in RECORDS if a[1] == "S1" for b in RECORDS if b[1] != "S1"], "s1_id string, cand_id string")
    got = {(r.s1_id, r.cand_id): r.cosine for r in frames._record_cosine(records, pairs).collect()}
    assert len(got) == 15 and math.isclose(got["S1-1", "S2-1"], 1) and got["S1-2", "S3-2"] > 0.1 and got["S1-3", "S2-3"] == 0
    for (a, b), x in got.items():
        assert math.isclose(x, sum(p * w[b].get(g, 0) for g, p in w[a].items()) / (norm[a] * norm[b] or 1), abs_tol=1e-9), (a, b)


def test_identical_records_have_cosine_one(spark):
    got = registry.queries()["pair_features_6"](spark, SF)
    same = frames._cte(spark, SF, "pairs").where("name1 = name2 AND addr1 = addr2 AND name1 <> ''").select("s1_id", "cand_id")
    low = [r for r in got.join(same, ["s1_id", "cand_id"]).collect() if r.name_address_tfidf_cosine < 0.999]
    assert not low and got.count() == frames._cte(spark, SF, "pairs").count()
