import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.functions import unicode as U
from weftline.operators import search
from weftline.plans import blocks, frames, relational


def test_grams_of_code_points():
    grams, at, n = search.grams(["ab cab c", None, "xy", "\U0001f600\U0001f601é"])
    number = lambda t: ord(t[0]) << 42 | ord(t[1]) << 21 | ord(t[2])
    assert set(zip(grams.tolist(), at.tolist(), strict=True)) == {(number(g), 0) for g in ("abc", "bca", "cab")} | {(number("\U0001f600\U0001f601é"), 3)}
    #: as often as each occurs: "abc" twice
    assert dict(zip(grams[at == 0].tolist(), n[at == 0].tolist(), strict=True))[number("abc")] == 2


@pytest.mark.parametrize("most", [1, 3, 7, 50])
def test_best_is_the_head_of_a_full_sort(most):
    rng = random.Random(most)
    for n in (1, 5, 40):
        scores = [rng.randrange(5) for _ in range(n)]
        want = sorted((k for k in range(n) if scores[k] >= 2), key=lambda k: (-scores[k], k))[:most]
        assert sorted(search.best(np.array(scores), 2, most).tolist()) == sorted(want)


def test_grams_of_some_texts_at_a_time(monkeypatch):
    texts = pa.array(["abcab", None, "bcab", "xyz", "abc", ""])
    whole = search.of_grams(texts, None)
    monkeypatch.setattr(search, "TEXTS", 2)
    parts = search.of_grams(texts, None)
    for g in ("abc", "bca", "cab", "xyz", "zzz"):
        assert parts.of(search.number(g)).tolist() == whole.of(search.number(g)).tolist()
    assert parts.of(search.number("abc")).tolist() == [0, 4] and parts.places.dtype == np.int32


def test_frequent_keys_are_left_out():
    p = search.of_lists(pa.array([["a", "b"], ["b"], None, ["b"]]), 2)
    assert p.counts(["a", "b", "c"]).tolist() == [1, 0, 0, 0] and p.counts([]).tolist() == [0, 0, 0, 0]


@pytest.fixture(scope="module")
def names(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randrange(2, 6)))
    rows = [(f"S{1 + k % 3}-{k}", f"S{1 + k % 3}", " ".join(word() for _ in range(3)) if k % 17 else None, "", "DE") for k in range(240)]
    return spark.createDataFrame(rows, "entity_id string, src string, business_name string, business_address string, country string")


@pytest.mark.parametrize("shares", [4096, 20])
def test_caps_of_the_gram_channel(names, monkeypatch, shares):
    """Caps on postings and on candidates that bind, in several shares of the queries."""
    monkeypatch.setattr(search, "SHARE", shares)
    monkeypatch.setitem(relational.CHANNELS, "char_ngram", (25, 2, 6))
    got = {(r.s1_id, r.cand_id, r.score) for r in frames._gram_hits(names).collect()}
    rows = [(r.entity_id, r.src, (r.n or "").replace(" ", "")) for r in names.select("entity_id", "src", U.normalize_name(F.col("business_name")).alias("n")).collect()]
    keys = {i: {n[k : k + 3] for k in range(len(n) - 2)} for i, _, n in rows}
    want = set()
    for target in ("S2", "S3"):
        ids = sorted(i for i, s, _ in rows if s == target)
        few = {g for i in ids for g in keys[i] if sum(g in keys[j] for j in ids) <= 25}
        for q in (i for i, s, _ in rows if s == "S1"):
            scores = [(-len(keys[q] & keys[c] & few), c) for c in ids]
            want |= {(q, c, -n) for n, c in sorted(x for x in scores if x[0] <= -2)[:6]}
    assert got == want and len(want) > 100


def test_two_channels_are_their_union(names):
    """Without shuffling a hit: baseline candidates of all records and those by grams of ASCII names."""
    got = [tuple(r) for r in frames._two_channels(names).collect()]
    grams = {(r.s1_id, r.cand_id) for r in frames._gram_hits(names, "ascii").collect()}
    keyed = [r for r in blocks.keyed(names).collect()]
    same = lambda a, b: any(a[k] is not None and a[k] == b[k] for k in blocks.KEYS)
    base = {(a.entity_id, b.entity_id) for a in keyed if a.src == "S1" for b in keyed if b.src != "S1" and same(a, b)}
    assert len(got) == len(set(got)) and set(got) == grams | base and base - grams


def test_copies_of_candidates_do_not_grow_with_the_queries(names, monkeypatch):
    """A target's candidates are written for COPIES tasks at most, and no candidate is lost."""
    want = {tuple(r) for r in frames._gram_hits(names).collect()}
    monkeypatch.setattr(search, "SHARE", 1)
    monkeypatch.setattr(search, "COPIES", 3)
    df = frames._gram_hits(names)
    df.collect()
    assert re.search(r"hashpartitioning\(task#\d+, 24\)", df._jdf.queryExecution().executedPlan().toString())
    assert {tuple(r) for r in df.collect()} == want and len(want) > 100


def test_all_channels_have_no_cap(spark, names, monkeypatch):
    """More candidates than any cap of a channel, and keys with more postings than are allowed there."""
    rows = spark.range(10_200).selectExpr("concat('S2-', id) AS entity_id", "'S2' AS src", "'Acm\u00e9 Widgets Ltd' AS business_name", "'4500 Oak' AS business_address", "'US' AS country")
    query = spark.createDataFrame([("S1-1", "S1", "Acm\u00e9 Widgets", "4500 Oak", "US")], rows.schema)
    assert frames._all_channels(spark, "", rows.unionByName(query)).distinct().count() == 10_200
    want = {tuple(r) for r in frames._all_channels(spark, "", names).collect()}
    monkeypatch.setattr(relational, "CHANNELS", {c: (2, least, 1) for c, (_, least, _) in relational.CHANNELS.items()})
    monkeypatch.setattr(relational, "BASELINE_CAP", 1)
    assert {tuple(r) for r in frames._all_channels(spark, "", names).collect()} == want and len(want) > 1000
