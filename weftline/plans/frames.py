"""Queries that need a function SQL lacks; checked by tests rather than an oracle."""

from __future__ import annotations

import math
import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import expr as X
from weftline.functions import unicode as U
from weftline.operators import alike, compare, scoring, search
from weftline.plans import blocks, relational
from weftline.storage import stored


def _cte(spark, sf_dir: str, name: str):
    """A shared table expression as a DataFrame."""
    return spark.sql(relational.render_cte(name, X.SPARK, sf_dir))


def _with_nfkd(e):
    """Records with their decomposed name and address."""
    return e.withColumns({X.Whole.columns[c]: U.nfkd(F.col(c)) for c in X.Whole.columns})


def _whole(spark, sf_dir: str, name: str, e=None, d=X.SPARK):
    """A relational query of ASCII text, over all records: ``e`` or those of the
    tables; or a shared table expression, rendered by ``d``."""
    view = f"records_{uuid.uuid4().hex}"
    _with_nfkd(_cte(spark, sf_dir, "e") if e is None else e).createOrReplaceTempView(view)
    kept = relational.CTES["e"]
    relational.CTES["e"] = ((), lambda d: f"SELECT * FROM {view}")
    try:
        if name in relational.CTES:
            return spark.sql(relational.render_cte(name, d, sf_dir))
        return spark.sql(relational.render(name, X.WHOLE, sf_dir))
    finally:
        relational.CTES["e"] = kept
        spark.catalog.dropTempView(view)


#: queries of which SQL has only the ASCII records (there under the name with _ascii)
WHOLE = ("channel_char_ngram", "tfidf_idf", "tfidf_transform", "tfidf_cosine", "bucket_knn", "similarity", "tokens_digits", "token_rows", "char_ngrams")


def normalize_unicode(spark, sf_dir):
    e = _cte(spark, sf_dir, "e")
    name = F.col("business_name")
    return e.select("entity_id", U.basic_normalize(name).alias("basic"), U.normalize_name(name).alias("name"), U.normalize_address(F.col("business_address")).alias("addr"), F.left(U.normalize_name(name), F.lit(5)).alias("prefix5"), U.nfkc(name).alias("nfkc"))


def transliteration(spark, sf_dir):
    e = _cte(spark, sf_dir, "e")
    return e.select("entity_id", U.transliterated("business_name").alias("latin"), U.script(F.col("business_name")).alias("script"))


def _translit_keys(e):
    """tl: of the whole name, and tng: grams only of names that aren't ASCII."""
    latin = e.select("entity_id", "src", "business_name", U.normalize_name(U.transliterated("business_name")).alias("t"))
    grams = F.expr(X.ngrams(X.SPARK, "t", 3))
    own = F.when(F.length("t") >= 4, F.array(F.concat(F.lit("tl:"), "t"))).otherwise(F.array().cast("array<string>"))
    more = F.when(F.col("business_name").rlike(r"[^\x00-\x7F]"), F.transform(F.filter(grams, lambda g: F.length(g) == 3), lambda g: F.concat(F.lit("tng:"), g))).otherwise(F.array().cast("array<string>"))
    return latin.select("entity_id", "src", F.explode(F.concat(own, more)).alias("key"))


def keys_transliteration(spark, sf_dir):
    return _translit_keys(_cte(spark, sf_dir, "e")).select("entity_id", "key")


def channel_transliteration(spark, sf_dir):
    """Records with an equal whole key, and of those that share two grams the best 3000 a target."""
    return _translit_hits(_cte(spark, sf_dir, "e"))


def _translit_hits(e):
    return search.found(_searched(e, "latin"), _by_latin, "t")


def _by_latin(rows, most=3000):
    #: equal whole keys count as one, beside the grams of names that aren't ASCII
    return search.Together(search.GramChannel(rows, "t_grams", None, 2, most), search.EqualTo(rows, "t"))


def _by_grams(rows, limits):
    return search.GramChannel(rows, "n", *limits)


def _by_address(rows, limits):
    return search.ListChannel(rows, "numbers", *limits)


def _searched(e, *forms: str):
    """Records with what the channels need of them: n (name), t (its transliteration if it has
    four characters) and t_grams, numbers (address), cp, bn and ba (baseline)."""
    out = e.select("entity_id", "src", "business_name", "business_address", "country")
    if "name" in forms:
        out = out.withColumn("n", U.normalize_name(F.col("business_name")))
    if "ascii" in forms:
        out = out.withColumn("n", F.when(F.expr(relational.ascii_(X.SPARK, "business_name")), F.expr(X.norm_name(X.SPARK, "business_name"))))
    if "latin" in forms:
        out = out.withColumn("latin", U.normalize_name(U.transliterated("business_name")))
        out = out.withColumns({"t": F.when(F.length("latin") >= 4, F.col("latin")), "t_grams": F.when(F.col("business_name").rlike(r"[^\x00-\x7F]"), F.col("latin"))}).drop("latin")
    if "address" in forms:
        out = out.withColumn("numbers", F.expr(X.address_keys(X.SPARK, "business_address", "country")))
    if "baseline" in forms:
        out = blocks.keyed(out, X.SPARK if "ascii" in forms else X.WHOLE)
    return out.drop("business_name", "business_address", "country")


def retrieve_all_channels(spark, sf_dir):
    return _all_channels(spark, sf_dir, _cte(spark, sf_dir, "e"))


def _all_channels(spark, sf_dir, e):
    """All candidates of any of the four channels over one entity view: no key is left out for
    its postings and no candidate for their number; only the least keys in common are the channels'."""
    grams, numbers = ((None, relational.CHANNELS[c][1], None) for c in ("char_ngram", "address_numeric"))
    build = lambda rows: search.Together(_by_latin(rows, None), _by_grams(rows, grams), search.AnyOf(rows, blocks.KEYS), _by_address(rows, numbers))
    return search.found(_searched(e, "name", "latin", "address", "baseline"), build, "n").select("s1_id", "cand_id")


def retrieve_two_channels_ascii(spark, sf_dir):
    """Candidates by baseline keys, and of ASCII names those by grams."""
    return _two_channels(_cte(spark, sf_dir, "e"))


def _two_channels(e):
    limits = relational.CHANNELS["char_ngram"]
    build = lambda rows: search.Together(_by_grams(rows, limits), search.AnyOf(rows, blocks.KEYS))
    return search.found(_searched(e, "ascii", "baseline"), build, "n").select("s1_id", "cand_id")


def channel_char_ngram(spark, sf_dir):
    return _gram_hits(_cte(spark, sf_dir, "e"))


def channel_char_ngram_ascii(spark, sf_dir):
    return _gram_hits(_cte(spark, sf_dir, "e"), "ascii")


def _gram_hits(e, form: str = "name"):
    """Records whose names share grams, the best a target; those of equal score in the order of their ids."""
    limits = relational.CHANNELS["char_ngram"]
    return search.found(_searched(e, form).where("n <> ''"), lambda rows: _by_grams(rows, limits), "n")


def keys_family(spark, sf_dir):
    return _family_keys(_cte(spark, sf_dir, "e"))


def _family_keys(e):
    """The family form's keys of all records, those of the transliterated name among them."""
    d = X.WHOLE
    latin = F.when(F.col("business_name").rlike(r"[^\x00-\x7F]"), U.transliterated("business_name"))
    text = e.select("entity_id", "business_address", "country", U.nfkc("business_name").alias("n0"), U.nfkc("business_address").alias("a0"), latin.alias("t0"))
    #: each form once a record
    forms = stored(text.select("entity_id", "business_address", "country", *[F.expr(X.legal_text(d, f"{c}0")).alias(c) for c in "nat"]), "forms")
    keys = X.family_keys_of(d, "n", "a", "coalesce(business_address, '')", "trim(coalesce(country, ''))", "t")
    return forms.select("entity_id", F.explode(F.expr(keys)).alias("key"))


def submission_candidates(spark, sf_dir):
    return _submission(_cte(spark, sf_dir, "p"))


def _submission(p, cap: int = relational.SUBMISSION_CAP):
    """The first ``cap`` candidates in the order of the record's keys, and of a key's postings
    in the order of their source and number."""
    keys = F.expr(X.submission_keys(X.SPARK, "business_name", "business_address", "country")).alias("keys")
    records = p.select("entity_id", "src", F.element_at(F.split("entity_id", "-"), -1).cast("long").alias("number"), F.col("src").alias("source"), keys)
    most = relational.SUBMISSION_BUCKET
    build = lambda rows: search.InOrder(rows, "keys", most, cap)
    return search.found(records, build, "entity_id", apart=False, rank=("source", "number", "entity_id")).select("s1_id", "cand_id")


def channel_address_numeric(spark, sf_dir):
    """Records of which addresses share numbers, the best a target."""
    limits = relational.CHANNELS["address_numeric"]
    records = _cte(spark, sf_dir, "p").select("entity_id", "src", F.expr(X.address_keys(X.SPARK, "business_address", "country")).alias("numbers"))
    return search.found(records, lambda rows: _by_address(rows, limits), "entity_id")


def fuzzy_ratios(spark, sf_dir):
    """Names are normalised once a record and compared once for each two different ones of a key,
    in tasks that hold a key's records."""
    return _fuzzy_ratios(_keyed(spark, sf_dir))


def _fuzzy_ratios(records):
    records = records.withColumn("n", U.normalize_name(F.col("business_name")))
    return compare.compared(compare.grouped(records, alike.Fuzzy.columns), alike.Fuzzy, alike.Fuzzy.schema)


def similarity(spark, sf_dir):
    """Compared once for each two classes of equal names and equal digits."""
    sets = _whole(spark, sf_dir, "ef", d=X.WHOLE).select("entity_id", F.col("name_set").alias("ns"), F.col("gram_set").alias("gs"), F.array_sort("digit_set").alias("ds"))
    records = _keyed(spark, sf_dir, X.WHOLE).join(sets, "entity_id").withColumnRenamed("business_name", "name")
    columns = re.search("SELECT s1_id, cand_id, (.*) FROM sets WHERE TRUE", relational.QUERIES["similarity"][1](X.WHOLE), re.S)[1]
    compared = blocks.met(records, ["name", "ds"], ("ns", "gs"))
    view = f"compared_{uuid.uuid4().hex}"
    compared.createOrReplaceTempView(view)
    try:
        values = spark.sql(f"SELECT ids1, ids2, {columns} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)
    return blocks.unfolded(values, *values.columns[2:])


def feature_summary(spark, sf_dir):
    """Over classes of records equal in content and in what is compared, by the number of their pairs."""
    return _feature_summary(_keyed(spark, sf_dir))


def _compared(records):
    """Classes of pairs with label, both similarities, equality of names and the number of pairs."""
    d = X.SPARK
    sets = {f"{v}_set": F.expr(X.token_set(d, f"coalesce({k}, '')")) for k, v in (("bn", "name"), ("ba", "addr"))}
    pairs = blocks.met(records.withColumns(sets), ["business_name", "name_set", "addr_set", "content"])
    label = F.when(F.col("content1") == F.col("content2"), 1).otherwise(0)
    sim = {f"{v}_sim": F.expr(X.jaccard(d, f"{v}_set1", f"{v}_set2")) for v in ("name", "addr")}
    same = F.coalesce((F.col("business_name1") == F.col("business_name2")).cast("double"), F.lit(0.0))
    return pairs.withColumns({"label": label, **sim, "same_name": same, "n": F.size("ids1").cast("long") * F.size("ids2")})


def _feature_summary(records):
    by = _compared(records).groupBy("label", "name_sim", "addr_sim", "same_name").agg(F.sum("n").alias("n"))
    mean = lambda c: F.sum(F.col(c) * F.col("n")) / F.sum("n")
    at = lambda c, p: F.expr(f"percentile({c}, {p}, n)")
    values = {"name_mean": mean("name_sim"), "name_median": at("name_sim", 0.5), "addr_p25": at("addr_sim", 0.25), "addr_p75": at("addr_sim", 0.75), "pct_same_name": 100 * mean("same_name")}
    return by.groupBy(F.col("label").cast("long").alias("label")).agg(*[F.round(v, 6).cast("double").alias(k) for k, v in values.items()])


def hard_cases(spark, sf_dir):
    """The 50 false pairs that look most alike."""
    return _hard_cases(_keyed(spark, sf_dir))


def _hard_cases(records, most: int = 50):
    pairs = _compared(records).where("label = 0").withColumn("both", F.expr("(name_sim + addr_sim) / 2")).withColumn("rank", F.round("both", 9))
    #: of two classes only their first ids can be among the first pairs
    first = pairs.select("rank", "both", *[F.slice(F.array_sort(c), 1, most).alias(c) for c in ("ids1", "ids2")])
    found = blocks.unfolded(first, "rank", "both").orderBy(F.desc("rank"), "s1_id", "cand_id").limit(most)
    return found.select("s1_id", "cand_id", F.round(1 - F.col("both"), 6).alias("difficulty"))


def pair_features_24(spark, sf_dir):
    """The 24 features, found in tasks that hold a key's records; no pair is shuffled."""
    return _features(_keyed(spark, sf_dir)).drop("in_retrieval")


def _text_forms(records):
    """Records with the forms of name and address that the 24 and the six features compare."""
    name, addr = F.col("business_name"), F.col("business_address")
    forms = {"n": U.normalize_name(name), "b": U.basic_normalize(name), "a": U.normalize_address(addr)}
    return records.withColumns({"name": F.coalesce(name, F.lit("")), "addr": F.coalesce(addr, F.lit("")), **forms})


def _features(records):
    """Pairs with label, in_retrieval and the 24 features (``scoring.pair_features`` has them for pairs that are there)."""
    d, name, addr = X.SPARK, "business_name", "business_address"
    forms = {"sql_name": X.sql_name(d, name), "sql_addr": X.sql_addr(d, addr), "prefix": X.prefix_key(d, name), "known": X.country(d, "country")}
    records = _text_forms(records).withColumns({k: F.expr(v) for k, v in forms.items()}).withColumn("digits", F.array_join(F.expr(X.digits(d, addr)), " "))
    return compare.compared(compare.grouped(records, alike.Features.columns), alike.Features, alike.Features.schema)


def hard_negative_flags(spark, sf_dir):
    """Flags of the pairs that aren't true and look alike, the similarity of names among them."""
    flags = ("hard_same_country", "hard_same_name", "hard_same_cp", "hard_similar_name")
    return scoring.hard_flags(scoring.pair_features(_cte(spark, sf_dir, "pairs"))).select("s1_id", "cand_id", F.col("label").cast("int"), *flags)


def _forms(e):
    """Records of ASCII text with their keys and the forms that labels and the thirteen features compare."""
    d = X.SPARK
    name, addr = "business_name", "business_address"
    listed = lambda x: F.array_join(F.array_sort(F.expr(x)), " ")
    forms = {"nb": X.basic(d, name), "ab": X.basic(d, addr), "nn": X.norm_name(d, name), "an": X.norm_addr(d, addr), **compare.masks(d)}
    sets = {"aset": X.token_set(d, X.norm_addr(d, addr)), "dg": X.digits(d, addr), "po": X.postal(d, addr)}
    records = blocks.keyed(e.where(relational.ascii_(d, name, addr)), d)
    records = records.withColumns({k: F.expr(v) for k, v in forms.items()} | {k: listed(v) for k, v in sets.items()})
    return records.withColumns({k: f for v, c in (("name", name), ("addr", addr)) for k, f in ((v, F.coalesce(c, F.lit(""))), (f"no_{v}", F.isnull(c)))})


def transform_labels(spark, sf_dir):
    """Pairs by how their names and addresses differ, counted in tasks that hold a key's records."""
    return _transform_labels(_cte(spark, sf_dir, "e"))


def _transform_labels(e):
    n = compare.compared(compare.grouped(_forms(e), compare.Counts.columns), compare.Counts, compare.Counts.schema)
    return n.groupBy("field", "pattern", "label").agg(F.sum("n").alias("n")).select("field", "pattern", "label", "n")


def transform_examples(spark, sf_dir):
    """The first pairs of each way in which names and addresses differ."""
    return _transform_examples(_cte(spark, sf_dir, "e"))


def _transform_examples(e, most: int = 15):
    first = compare.compared(compare.grouped(_forms(e), compare.Examples.columns), lambda: compare.Examples(most), compare.Examples.schema)
    place = F.row_number().over(Window.partitionBy("field", "pattern").orderBy("s1_id", "cand_id"))
    return first.withColumn("r", place).where(F.col("r") <= most).drop("r")


def pair_features_13(spark, sf_dir):
    """The thirteen features, found in tasks that hold a key's records; no pair is shuffled."""
    return _thirteen(_cte(spark, sf_dir, "e"))


def _thirteen(e):
    return compare.compared(compare.grouped(_forms(e), compare.Features.columns), compare.Features, compare.Features.schema)


def _keyed(spark, sf_dir, d=X.SPARK):
    """Records with their baseline keys, computed once."""
    columns = ("entity_id", "src", "business_name", "business_address", "country", "content", *blocks.KEYS)
    return stored(blocks.keyed(_cte(spark, sf_dir, "e"), d).select(*columns), "keyed")


def class_balance(spark, sf_dir):
    """Retrieved pairs, true and not, counted without forming them."""
    return _class_balance(_keyed(spark, sf_dir))


def _class_balance(records):
    n = blocks.counts(records).where("union = 'cp+bn+ba'").agg(F.sum("true_pairs").alias("n_pos"), F.sum("pairs").alias("n"))
    n = n.select("n_pos", (F.col("n") - F.col("n_pos")).alias("n_neg"))
    return n.withColumn("scale_pos_weight", F.round(F.col("n_neg") / F.greatest("n_pos", F.lit(1)).cast("double"), 6))


def candidate_quality(spark, sf_dir):
    """Retrieved pairs by target, and the true ones among them, counted without forming them."""
    return _candidate_quality(_keyed(spark, sf_dir))


def _candidate_quality(records):
    n = blocks.counts(records).where("union = 'cp+bn+ba'").select(F.col("target").alias("candidate_source"), F.col("pairs").alias("candidates"), F.col("true_pairs").alias("tp"))
    return n.withColumns({"tp_rate": F.round(F.col("tp") / F.col("candidates").cast("double"), 6), "per_true_match": F.round(F.col("candidates") / F.greatest("tp", F.lit(1)).cast("double"), 6)})


def family_ablation(spark, sf_dir):
    """Retrieved pairs by family of keys and by several, and the true ones among them, counted without forming them."""
    return _family_ablation(_keyed(spark, sf_dir))


#: conditions of the ablation by set of keys
CONDITIONS = {"bn": "bn", "ba": "ba", "cp": "cp", "bn+ba": "bn+ba", "cp+bn": "bn+cp", "cp+ba": "ba+cp", "cp+bn+ba": "all"}


def _family_ablation(records):
    cond = F.create_map(*[F.lit(x) for kv in CONDITIONS.items() for x in kv])
    return blocks.counts(records).groupBy(cond[F.col("union")].alias("cond")).agg(F.sum("pairs").alias("candidates"), F.sum("true_pairs").alias("true_pairs"))


def entity_recall(spark, sf_dir):
    """Records with true matches, and those of which all share a key. Records equal in content and
    keys are one class, and only the few classes of a content are compared."""
    return _entity_recall(_keyed(spark, sf_dir))


def _entity_recall(records):
    classes = records.where("content IS NOT NULL").groupBy("content", *blocks.KEYS).agg(F.count_if(F.col("src") == "S1").alias("m1"), F.count_if(F.col("src") != "S1").alias("m2"))
    side = lambda k: classes.where(f"m{k} > 0").select("content", F.col(f"m{k}"), *[F.col(c).alias(f"{c}{k}") for c in blocks.KEYS])
    found = F.expr(" OR ".join(f"coalesce({c}1 = {c}2, false)" for c in blocks.KEYS))
    full = side(1).join(side(2), "content").groupBy("content", "m1", *[f"{c}1" for c in blocks.KEYS]).agg(F.min(found.cast("long")).alias("full"))
    n = full.agg(F.coalesce(F.sum("m1"), F.lit(0)).alias("entities"), F.sum(F.col("m1") * F.col("full")).alias("covered"))
    return n.withColumn("entity_recall", F.round(F.col("covered") / F.nullif("entities", F.lit(0)).cast("double"), 6))


#: fixed value: most grams of the vectors of name and address
VOCABULARY = 100_000


def _record_texts(e):
    """Of each record name, its transliteration and address as one text: entity_id, text."""
    d = X.WHOLE
    forms = e.select("entity_id", "business_name", U.nfkc("business_name").alias("n0"), U.transliterated("business_name").alias("t0"), U.nfkc("business_address").alias("a0"))
    forms = forms.select("entity_id", "business_name", *[F.expr(X.legal_text(d, f"{c}0")).alias(c) for c in "nta"])
    latin = F.when(F.col("business_name").rlike(r"[^\x00-\x7F]") & (F.col("t") != F.col("n")), F.col("t"))
    return forms.select("entity_id", F.concat_ws(" ", "n", latin, "a").alias("text"))


def _record_vectors(e):
    """TF-IDF of the 3- and 4-grams within words of the records' texts: entity_id, grams, weights."""
    d, text = X.WHOLE, _record_texts(e)
    words = text.select("entity_id", F.explode(F.expr(X.tokens(d, "text"))).alias("w")).select("entity_id", F.concat(F.lit(" "), "w", F.lit(" ")).alias("w"))
    grams = F.expr(d.cat(X.ngrams_ordered(d, "w", 3), X.ngrams_ordered(d, "w", 4)))
    tf = words.select("entity_id", F.explode(grams).alias("gram")).groupBy("entity_id", "gram").count()
    known = tf.groupBy("gram").agg(F.sum("count").alias("total"), F.count("*").alias("df")).orderBy(F.desc("total"), "gram").limit(VOCABULARY)
    n = e.agg(F.count("*").alias("n_all"))
    idf = known.crossJoin(n).select("gram", (F.log((1 + F.col("n_all")) / (1 + F.col("df"))) + 1).alias("idf"))
    raw = tf.join(idf, "gram").select("entity_id", "gram", ((1 + F.log("count")) * F.col("idf")).alias("w"))
    both = raw.groupBy("entity_id").agg(F.collect_list(F.struct("gram", "w")).alias("v"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return both.select("entity_id", F.col("v.gram").alias("grams"), F.transform("v.w", lambda x: x / F.col("norm")).alias("weights"))


def _record_cosine(e, pairs):
    """``pairs`` with the cosine of both records' vectors, 0 only for an empty one or nothing shared."""
    v = _record_vectors(e)
    side = lambda k, c: v.select(F.col("entity_id").alias(c), F.col("grams").alias(f"g{k}"), F.col("weights").alias(f"w{k}"))
    both = pairs.join(side(1, "s1_id"), "s1_id", "left").join(side(2, "cand_id"), "cand_id", "left")
    return both.withColumn("cosine", U.dot("g1", "w1", "g2", "w2")).drop("g1", "w1", "g2", "w2")


def _name_cosines(spark, sf_dir, ascii_only: bool = False, most: int | None = None):
    """Candidates whose names share a gram, with their TF-IDF cosine; of each target the
    ``most`` nearest. Vectors are looked up in tasks that hold a target's candidates."""
    d = X.SPARK if ascii_only else X.WHOLE
    e = _keyed(spark, sf_dir).withColumn("name_nfkd", U.nfkd(F.col("business_name"))) if not ascii_only else _keyed(spark, sf_dir)
    text = F.expr(f"CASE WHEN {relational.ascii_(d, 'business_name')} THEN concat(' ', {X.basic(d, 'business_name')}, ' ') END")
    records = stored(e.select("entity_id", "src", *blocks.KEYS, text.alias("text")).where("length(text) >= 3"), "texts")
    n = records.count()
    each = records.groupBy("text").count().select(F.explode(F.array_distinct(F.expr(X.ngrams_ordered(d, "text", 3)))).alias("gram"), "count")
    #: the vocabulary of 3-grams, which grows with the alphabets and not with the records
    idf = {search.number(g): math.log((1 + n) / (1 + m)) + 1 for g, m in each.groupBy("gram").agg(F.sum("count")).collect()}
    build = lambda rows: search.Cosines(rows, "text", idf, blocks.KEYS, most)
    return search.found(records, build, "text", score="double").withColumnRenamed("score", "cosine")


def tfidf_cosine(spark, sf_dir):
    return _name_cosines(spark, sf_dir).withColumn("cosine", F.round("cosine", 6))


def tfidf_cosine_ascii(spark, sf_dir):
    return _name_cosines(spark, sf_dir, ascii_only=True).withColumn("cosine", F.round("cosine", 6))


def _nearest(cosines):
    """The five nearest candidates of each record."""
    best = Window.partitionBy("s1_id").orderBy(F.desc(F.round("cosine", 9)), "cand_id")
    near = cosines.withColumn("r", F.row_number().over(best)).where("r <= 5")
    return near.select("s1_id", "cand_id", F.round("cosine", 6).alias("cosine"))


def bucket_knn(spark, sf_dir):
    return _nearest(_name_cosines(spark, sf_dir, most=5))


def bucket_knn_ascii(spark, sf_dir):
    return _nearest(_name_cosines(spark, sf_dir, ascii_only=True, most=5))


def _six_features(records):
    """The six features, found in tasks that hold a key's records; no pair is shuffled."""
    texts = stored(_record_texts(records), "texts")
    n = records.count()
    counts = texts.select("text").mapInArrow(alike.gram_counts, "gram string, total bigint, df bigint").groupBy("gram").agg(F.sum("total").alias("total"), F.sum("df").alias("df"))
    #: a bounded vocabulary
    known = counts.orderBy(F.desc("total"), "gram").limit(VOCABULARY).collect()
    idf = {r.gram: math.log((1 + n) / (1 + r.df)) + 1 for r in known}
    records = _text_forms(records).join(texts, "entity_id")
    return compare.compared(compare.grouped(records, alike.SixFeatures.columns), lambda: alike.SixFeatures(idf), alike.SixFeatures.schema)


def pair_features_6(spark, sf_dir):
    return _six_features(_keyed(spark, sf_dir))


def train_predict(spark, sf_dir):
    """Probabilities of the held-out pairs by a model of the others."""
    f = stored(scoring.split_val(_features(_keyed(spark, sf_dir))), "features")
    model = scoring.train(f.where("NOT is_val"))
    return scoring.predict(model, f.where("is_val AND in_retrieval")).select("s1_id", "cand_id", F.col("label").cast("int"), "proba")


def _of_all(name: str):
    def run(spark, sf_dir):
        return _whole(spark, sf_dir, name)

    run.__name__ = name
    return run


QUERIES = {name: _of_all(name) for name in WHOLE}
QUERIES |= {f.__name__: f for f in (normalize_unicode, transliteration, keys_transliteration, channel_transliteration, retrieve_all_channels, retrieve_two_channels_ascii, channel_char_ngram, channel_char_ngram_ascii, keys_family, submission_candidates, channel_address_numeric, fuzzy_ratios, pair_features_24, pair_features_6, tfidf_cosine, bucket_knn, hard_negative_flags, train_predict)}
QUERIES |= {f.__name__: f for f in (tfidf_cosine_ascii, bucket_knn_ascii, similarity, feature_summary, hard_cases, class_balance, candidate_quality, entity_recall, family_ablation)}
QUERIES |= {f.__name__: f for f in (transform_labels, transform_examples, pair_features_13)}
