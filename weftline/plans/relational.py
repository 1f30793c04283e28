"""The record-linkage queries, each a plan over shared common table expressions.

A query is rendered twice from one description: for Spark SQL over the Parquet
tables, and for the oracle. Candidate generation is always an equi-join on keys
(a union of them, never an OR), and counts of candidates are products of counts
by key, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from weftline.functions import expr as X

TABLES = "region nation customer supplier part orders lineitem events documents labels".split()
CTES: dict[str, tuple[tuple[str, ...], Callable]] = {}
QUERIES: dict[str, tuple[tuple[str, ...], Callable]] = {}


def cte(name: str, *needs: str):
    return lambda f: CTES.__setitem__(name, (needs, f)) or f


def query(*needs: str):
    return lambda f: QUERIES.__setitem__(f.__name__.lstrip("_"), (needs, f)) or f


def render(name: str, d: X.Spark, sf_dir: str | None = None) -> str:
    needs, body = QUERIES[name]
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        if n in CTES:
            for m in CTES[n][0]:
                visit(m)
            order.append(n)
        elif sf_dir is not None:
            order.append(n)

    for n in needs:
        visit(n)
    parts = [f"{n} AS ({CTES[n][1](d) if n in CTES else f'SELECT * FROM parquet.`{sf_dir}/{n}.parquet`'})" for n in order]
    return f"WITH {', '.join(parts)} {body(d)}" if parts else body(d)


def render_cte(name: str, d: X.Spark, sf_dir: str | None = None) -> str:
    """A shared table expression as a query of its own."""
    QUERIES["_"] = ((name,), lambda d: f"SELECT * FROM {name}")
    try:
        return render("_", d, sf_dir)
    finally:
        del QUERIES["_"]


def ascii_(d: X.Spark, *cols: str) -> str:
    return "TRUE" if not d.ascii_only else " AND ".join(f"NOT {d.like(f"coalesce({c}, '')", r'[^\x00-\x7F]')}" for c in cols)


# Sources.


@cte("e", "documents")
def _e(d):
    return """SELECT concat('S', CAST(1 + doc_id % 3 AS STRING), '-', CAST(doc_id AS STRING)) AS entity_id, concat('S', CAST(1 + doc_id % 3 AS STRING)) AS src,
    left(split_part(text, chr(10), 1), 60) AS business_name, substr(replace(text, chr(10), ' '), 61, 80) AS business_address, lang AS country, md5(text) AS content FROM documents"""


@cte("p", "part")
def _p(d):
    return """SELECT concat('S', CAST(1 + p_partkey % 3 AS STRING), '-', CAST(p_partkey AS STRING)) AS entity_id, concat('S', CAST(1 + p_partkey % 3 AS STRING)) AS src,
    p_name AS business_name, concat(CAST(p_size AS STRING), '-', CAST(p_partkey % 100 AS STRING), '/', CAST(p_partkey AS STRING), ' ', p_brand) AS business_address, p_type AS country FROM part"""


cte("s1", "e")(lambda d: "SELECT * FROM e WHERE src = 'S1'")
cte("o", "e")(lambda d: "SELECT * FROM e WHERE src <> 'S1'")
cte("g", "s1", "o")(lambda d: "SELECT s1.entity_id AS s1_id, o.entity_id AS matched_id, o.src AS match_source FROM s1 JOIN o ON s1.content = o.content")
cte("gl", "s1", "g")(lambda d: f"SELECT s1.entity_id AS s1_id, coalesce(m.ids, '') AS ids FROM s1 LEFT JOIN (SELECT s1_id, {d.ordered('matched_id')} AS ids FROM g GROUP BY s1_id) m ON s1.entity_id = m.s1_id")
cte("gs", "s1", "g")(
    lambda d: """SELECT s1.entity_id AS s1_id, s1.country, coalesce(n, 0) AS match_count, coalesce(n2, 0) AS s2_match_count, coalesce(n3, 0) AS s3_match_count FROM s1 LEFT JOIN
    (SELECT s1_id, count(*) AS n, count(CASE WHEN match_source = 'S2' THEN 1 END) AS n2, count(CASE WHEN match_source = 'S3' THEN 1 END) AS n3 FROM g GROUP BY s1_id) m ON s1.entity_id = m.s1_id"""
)
#: baseline keys of every record
cte("k", "e")(lambda d: f"SELECT entity_id, src, country, key FROM (SELECT entity_id, src, country, {X.baseline_keys(d, 'business_name', 'business_address', 'country')} AS ks FROM e) t {d.unnest('ks', 'key')}")
cte("df", "k")(lambda d: "SELECT src AS target, key, count(DISTINCT entity_id) AS df FROM k WHERE src <> 'S1' GROUP BY src, key")
cte("hit", "k")(lambda d: "SELECT q.entity_id AS s1_id, c.entity_id AS cand_id, c.src AS target, c.key FROM k q JOIN k c ON q.key = c.key WHERE q.src = 'S1' AND c.src <> 'S1'")
cte("cand", "hit")(lambda d: "SELECT s1_id, cand_id, target, count(*) AS n_keys FROM hit GROUP BY s1_id, cand_id, target")
cte("per", "s1", "cand")(lambda d: "SELECT s1.entity_id AS s1_id, s1.country, coalesce(n, 0) AS n FROM s1 LEFT JOIN (SELECT s1_id, count(*) AS n FROM cand GROUP BY s1_id) c ON s1.entity_id = c.s1_id")
#: labelled pairs and a cheap score, for metrics
cte(
    "pairs", "g", "cand", "e"
)(
    lambda d: f"""SELECT t.s1_id, t.cand_id, left(t.cand_id, 2) AS candidate_source, t.label, t.in_retrieval, a.business_name AS name1, b.business_name AS name2, a.business_address AS addr1,
    b.business_address AS addr2, a.country AS country1, b.country AS country2 FROM (SELECT coalesce(g.s1_id, c.s1_id) AS s1_id, coalesce(g.matched_id, c.cand_id) AS cand_id,
    CASE WHEN g.s1_id IS NULL THEN 0 ELSE 1 END AS label, c.s1_id IS NOT NULL AS in_retrieval FROM g FULL OUTER JOIN cand c ON g.s1_id = c.s1_id AND g.matched_id = c.cand_id) t
    JOIN e a ON t.s1_id = a.entity_id JOIN e b ON t.cand_id = b.entity_id"""
)
#: what similarities need of a record, once a record rather than once a pair
cte("ef", "e")(
    lambda d: f"""SELECT entity_id, {X.token_set(d, X.sql_name(d, 'business_name'))} AS name_set, {X.token_set(d, X.sql_addr(d, 'business_address'))} AS addr_set,
    {X.ngrams(d, X.norm_name(d, 'business_name'), 3)} AS gram_set, {X.digits(d, 'business_address')} AS digit_set FROM e"""
)
cte("sets", "pairs", "ef")(
    lambda d: """SELECT p.*, a.name_set AS ns1, a.addr_set AS as1, a.gram_set AS gs1, a.digit_set AS ds1, b.name_set AS ns2, b.addr_set AS as2, b.gram_set AS gs2, b.digit_set AS ds2
    FROM pairs p JOIN ef a ON p.s1_id = a.entity_id JOIN ef b ON p.cand_id = b.entity_id"""
)
cte("sim", "sets")(lambda d: f"SELECT *, {X.jaccard(d, 'ns1', 'ns2')} AS name_sim, {X.jaccard(d, 'as1', 'as2')} AS addr_sim FROM sets")
cte("scored", "sim")(lambda d: "SELECT *, (name_sim + addr_sim) / 2 AS proba FROM sim WHERE in_retrieval")
TAUS = (0.3, 0.4, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9)
cte("tau")(lambda d: " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS tau" for t in TAUS))
#: per-record precision and recall at each threshold; no prediction and no truth is 1
cte("marked", "gs", "scored", "tau")(
    lambda d: """SELECT tau, s1_id, count(*) AS predicted, sum(label) AS tp FROM scored CROSS JOIN tau WHERE proba >= tau GROUP BY tau, s1_id"""
)
cte("prf", "gs", "marked", "tau")(
    lambda d: """SELECT t.tau, t.s1_id, t.country, t.match_count, coalesce(m.predicted, 0) AS predicted, coalesce(m.tp, 0) AS tp,
    CAST(CASE WHEN t.match_count = 0 AND m.predicted IS NULL THEN 1.0 WHEN m.predicted IS NULL THEN 0.0 ELSE m.tp / CAST(m.predicted AS DOUBLE) END AS DOUBLE) AS pr,
    CAST(CASE WHEN t.match_count = 0 AND m.predicted IS NULL THEN 1.0 WHEN t.match_count = 0 OR m.tp IS NULL THEN 0.0 ELSE m.tp / CAST(t.match_count AS DOUBLE) END AS DOUBLE) AS rc
    FROM (SELECT gs.*, tau FROM gs CROSS JOIN tau) t LEFT JOIN marked m ON t.s1_id = m.s1_id AND t.tau = m.tau"""
)
cte("f", "prf")(lambda d: f"SELECT *, {X.f_score('pr', 'rc')} AS f05, {X.f_score('pr', 'rc', 1.0)} AS f10 FROM prf")


def r6(x: str, name: str) -> str:
    return f"CAST(round({x}, 6) AS DOUBLE) AS {name}"


def big(x: str, name: str) -> str:
    return f"CAST({x} AS BIGINT) AS {name}"


@query("e")
def entity_view(d):
    return "SELECT entity_id, src, business_name, business_address, country FROM e"


QUERIES["gt_pairs"] = (("g",), lambda d: "SELECT s1_id, matched_id, match_source FROM g")
QUERIES["gt_summary"] = (("gs",), lambda d: f"SELECT s1_id, {big('match_count', 'match_count')}, {big('s2_match_count', 's2_match_count')}, {big('s3_match_count', 's3_match_count')} FROM gs")
QUERIES["gt_loader"] = (("gl",), lambda d: f"SELECT s1_id, ids, {d.size(d.keep(d.split('ids', ','), 't', "t <> ''"))} AS n FROM gl")
QUERIES["id_list_parse"] = (("gl",), lambda d: f"SELECT DISTINCT s1_id, trim(i) AS id FROM gl {d.unnest(d.split('ids', ','), 'i')} WHERE trim(i) <> ''")
QUERIES["candidate_sink"] = (("s1", "cand"), lambda d: f"SELECT s1.entity_id AS source1_entity_id, coalesce(c.ids, '') AS candidate_entity_ids FROM s1 LEFT JOIN (SELECT s1_id, {d.ordered('cand_id')} AS ids FROM cand GROUP BY s1_id) c ON s1.entity_id = c.s1_id")
QUERIES["filtered_scan"] = (("e", "g"), lambda d: "SELECT entity_id, business_name FROM e WHERE entity_id IN (SELECT matched_id FROM g)")
QUERIES["first_n_scan"] = (("s1",), lambda d: "SELECT entity_id FROM s1 ORDER BY entity_id LIMIT 100")
QUERIES["file_inventory"] = (("e",), lambda d: f"SELECT src, {big('count(*)', 'n_rows')}, {big('sum(length(business_name) + length(business_address))', 'chars')}, {big("count(CASE WHEN business_address LIKE '%' || chr(9) || '%' THEN 1 END)", 'with_tab')} FROM e GROUP BY src")

# Normal forms (rows of ASCII text where a form starts with compatibility decomposition).
NA = lambda d: ascii_(d, "business_name", "business_address")
QUERIES["norm_unicode_ascii"] = (("e",), lambda d: f"SELECT entity_id, {X.basic(d, 'business_name')} AS basic, {X.norm_name(d, 'business_name')} AS name, {X.norm_addr(d, 'business_address')} AS addr, left({X.norm_name(d, 'business_name')}, 5) AS prefix5 FROM e WHERE {NA(d)}")
QUERIES["norm_sql_style"] = (("e",), lambda d: f"SELECT entity_id, {X.sql_name(d, 'business_name')} AS name, {X.sql_addr(d, 'business_address')} AS addr, {X.prefix_key(d, 'business_name')} AS prefix_key FROM e")
QUERIES["norm_plain"] = (("e",), lambda d: f"SELECT entity_id, {X.plain_norm(d, 'business_name')} AS norm_name, {X.plain_norm(d, 'business_address')} AS norm_addr, {X.plain_prefix(d, 'business_name', 5)} AS prefix5, {X.plain_prefix(d, 'business_name', 10)} AS prefix10, split_part(lower(trim(business_name)), ' ', 1) AS first_token FROM e")
QUERIES["norm_legal_ascii"] = (("e",), lambda d: f"SELECT entity_id, {X.legal_text(d, 'business_name')} AS name, concat({X.legal_text(d, 'business_name')}, ' ', {X.legal_text(d, 'business_address')}) AS record_text FROM e WHERE {NA(d)}")
QUERIES["tokens_digits"] = (("e",), lambda d: f"SELECT entity_id, {d.size(X.token_set(d, X.basic(d, 'business_name')))} AS n_tokens, {d.size(X.digits(d, 'business_address'))} AS n_digits, {d.size(X.postal(d, 'business_address'))} AS n_postal FROM e WHERE {NA(d)}")
QUERIES["token_rows"] = (("e",), lambda d: f"SELECT entity_id, tok FROM (SELECT entity_id, {X.token_set(d, X.norm_addr(d, 'business_name'))} AS ts FROM e WHERE {NA(d)}) t {d.unnest('ts', 'tok')}")
QUERIES["digit_rows"] = (("p",), lambda d: f"SELECT entity_id, tok FROM (SELECT entity_id, {X.digits(d, 'business_address')} AS ts FROM p) t {d.unnest('ts', 'tok')}")
QUERIES["postal_rows"] = (("customer",), lambda d: f"SELECT c_custkey, tok FROM (SELECT c_custkey, {X.postal(d, "concat('Box ', CAST(10000 + c_custkey AS STRING), '-', CAST(1000 + c_custkey % 9000 AS STRING), ', ', CAST(100000 + c_custkey AS STRING))")} AS ts FROM customer) t {d.unnest('ts', 'tok')}")
QUERIES["patterns"] = (("e",), lambda d: f"SELECT entity_id, {d.like('lower(business_name)', '(the|and|of)')} AS has_word, {d.like('business_name', r'[^\x00-\x7F]')} AS non_ascii, {d.like('business_address', '[0-9]')} AS has_digit FROM e")
QUERIES["labels_of_ids"] = (("e", "gs"), lambda d: f"SELECT e.entity_id, {X.country(d, 'e.country')} AS country_label, CASE WHEN e.entity_id LIKE 'S2-%' THEN 'S2' WHEN e.entity_id LIKE 'S3-%' THEN 'S3' ELSE 'OTHER' END AS candidate_source, {X.match_bucket('coalesce(match_count, 0)').format(text='STRING')} AS bucket FROM e LEFT JOIN gs ON e.entity_id = gs.s1_id")

# Similarities over labelled pairs.
QUERIES["similarity"] = (("sets",), lambda d: f"""SELECT s1_id, cand_id, {r6(X.jaccard(d, 'ns1', 'ns2'), 'token_jaccard')}, {r6(X.jaccard(d, 'ns1', 'ns2', '0.0'), 'token_jaccard_zero')}, {r6(X.jaccard(d, 'gs1', 'gs2'), 'gram_jaccard')},
  {r6(X.levenshtein(d, 'lower(name1)', 'lower(name2)'), 'levenshtein')}, {big('abs(length(name1) - length(name2))', 'len_diff')}, {r6(X.length_ratio(d, 'name1', 'name2'), 'len_ratio')},
  {d.size(d.both('ds1', 'ds2'))} AS digit_overlap, {r6(X.jaccard(d, 'ds1', 'ds2'), 'digit_jaccard')} FROM sets WHERE {ascii_(d, 'name1', 'name2', 'addr1', 'addr2')}""")
QUERIES["char_ngrams"] = (("s1",), lambda d: f"SELECT entity_id, gram FROM (SELECT entity_id, {X.ngrams(d, X.basic(d, 'business_name'), 3)} AS gs_ FROM s1 WHERE {ascii_(d, 'business_name')}) t {d.unnest('gs_', 'gram')}")
QUERIES["percentiles"] = (("per",), lambda d: f"SELECT {', '.join(r6(d.quantile('n', q), f'p{int(q * 100)}') for q in (0.25, 0.5, 0.9, 0.95, 0.99))} FROM per")
def _quartile(d, k: int) -> str:
    """The value at place k * n / 4 in order: the first whose running count is above that place."""
    place = f"({k} * n_all) {'//' if isinstance(d, X.Duck) else 'DIV'} 4"
    return big(f"min(CASE WHEN upto > {place} THEN n END)", f"q{k}")


#: running counts over the different values, so no task sorts all records
QUERIES["order_quartiles"] = (("per",), lambda d: f"SELECT {', '.join(_quartile(d, k) for k in (1, 2, 3))} FROM (SELECT n, sum(c) OVER (ORDER BY n) AS upto, sum(c) OVER () AS n_all FROM (SELECT n, count(*) AS c FROM per GROUP BY n) v) t")
cte("grams", "e")(lambda d: f"SELECT entity_id, src, gram, count(*) AS tf FROM (SELECT entity_id, src, {X.ngrams_ordered(d, f"concat(' ', {X.basic(d, 'business_name')}, ' ')", 3)} AS gr FROM e WHERE {ascii_(d, 'business_name')}) t {d.unnest('gr', 'gram')} GROUP BY entity_id, src, gram")
cte("idf", "grams")(lambda d: "SELECT gram, ln((1 + (SELECT count(DISTINCT entity_id) FROM grams)) / CAST((1 + count(*)) AS DOUBLE)) + 1 AS idf FROM grams GROUP BY gram")
cte("w0", "grams", "idf")(lambda d: "SELECT entity_id, src, grams.gram, (1 + ln(tf)) * idf AS w FROM grams JOIN idf ON grams.gram = idf.gram")
cte("w", "w0")(lambda d: "SELECT w0.entity_id, src, gram, w / norm AS w FROM w0 JOIN (SELECT entity_id, sqrt(sum(w * w)) AS norm FROM w0 GROUP BY entity_id) n ON w0.entity_id = n.entity_id")
#: cosine of candidate pairs only: those that share a blocking key
cte("cos", "cand", "w")(lambda d: "SELECT s1_id, cand_id, sum(a.w * b.w) AS cosine FROM cand JOIN w a ON cand.s1_id = a.entity_id JOIN w b ON cand.cand_id = b.entity_id AND a.gram = b.gram GROUP BY s1_id, cand_id")
QUERIES["tfidf_idf"] = (("idf",), lambda d: f"SELECT gram, {r6('idf', 'idf')} FROM idf")
QUERIES["tfidf_transform"] = (("w",), lambda d: f"SELECT entity_id, gram, {r6('w', 'weight')} FROM w")
QUERIES["tfidf_cosine"] = (("cos",), lambda d: f"SELECT s1_id, cand_id, {r6('cosine', 'cosine')} FROM cos")
QUERIES["bucket_knn"] = (("cos",), lambda d: f"SELECT s1_id, cand_id, {r6('cosine', 'cosine')} FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY round(cosine, 9) DESC, cand_id) AS r FROM cos) t WHERE r <= 5")

# Keys.
for _name, _fn, _src in (
    ("keys_baseline", lambda d: X.baseline_keys(d, "business_name", "business_address", "country"), "e"),
    ("keys_prefix_3_8", lambda d: X.cp_keys(d, "business_name", "country"), "e"),
    ("keys_ngram_ascii", lambda d: X.gram_keys(d, "business_name"), "e"),
    ("keys_address", lambda d: X.address_keys(d, "business_address", "country"), "p"),
    ("keys_submission", lambda d: X.submission_keys(d, "business_name", "business_address", "country"), "p"),
    ("keys_family_ascii", lambda d: X.family_keys(d, "business_name", "business_address", "country"), "p"),
):
    #: forms that start with decomposition are of ASCII text here
    _which = "TRUE" if _name in ("keys_baseline", "keys_prefix_3_8") else None
    QUERIES[_name] = ((_src,), lambda d, f=_fn, s=_src, w=_which: f"SELECT entity_id, key FROM (SELECT entity_id, {f(d)} AS ks FROM {s} WHERE {w or ascii_(d, 'business_name', 'business_address')}) t {d.unnest('ks', 'key')}")
QUERIES["structured_digits"] = (("p",), lambda d: f"SELECT entity_id, run FROM (SELECT entity_id, {X.structured_digits(d, 'business_address')} AS rs FROM p) t {d.unnest('rs', 'run')}")
QUERIES["keys_family_documents_ascii"] = (("e",), lambda d: f"SELECT entity_id, key FROM (SELECT entity_id, {X.family_keys(d, 'business_name', 'business_address', 'country')} AS ks FROM e WHERE {ascii_(d, 'business_name', 'business_address')}) t {d.unnest('ks', 'key')}")
QUERIES["legal_forms"] = (("supplier",), lambda d: "SELECT s_suppkey, " + ", ".join(f"{d.like("lower(concat(s_name, ' Co. ', CASE WHEN s_suppkey % 2 = 0 THEN 'Pvt Ltd' ELSE 'Inc' END))", p)} AS f{k}" for k, p in enumerate(X.LEGAL_FORMS)) + " FROM supplier")
QUERIES["address_forms"] = (("p",), lambda d: "SELECT entity_id, " + ", ".join(f"{d.like("lower(concat(business_address, ' Main St. Fl 2'))", rf'\b({"|".join(v)})\b\.?')} AS has_{k}" for k, v in X.ADDRESS_FORMS.items()) + " FROM p")
QUERIES["key_families"] = (("k",), lambda d: f"SELECT split_part(key, ':', 1) AS family, {big('count(*)', 'postings')}, {big('count(DISTINCT key)', 'n_keys')} FROM k GROUP BY 1")

# Retrieval.
QUERIES["postings"] = (("k",), lambda d: "SELECT 'baseline' AS channel, src AS target, key, entity_id FROM k WHERE src <> 'S1'")
QUERIES["key_df"] = (("df",), lambda d: f"SELECT target, key, {big('df', 'df')} FROM df")
QUERIES["index_stats"] = (("k",), lambda d: f"SELECT src AS target, {big('count(DISTINCT key)', 'n_keys')}, {big('count(*)', 'postings')}, {big('count(DISTINCT entity_id)', 'entities')} FROM k WHERE src <> 'S1' GROUP BY src")
QUERIES["retrieval_exact"] = (("cand",), lambda d: "SELECT s1_id, cand_id FROM cand")
QUERIES["retrieval_scored"] = (("cand",), lambda d: f"SELECT s1_id, cand_id, {big('n_keys', 'score')} FROM cand")
QUERIES["retrieval_topk"] = (("cand",), lambda d: f"SELECT s1_id, cand_id, {big('n_keys', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY n_keys DESC, cand_id) AS r FROM cand) t WHERE r <= 10 AND n_keys >= 1")
QUERIES["retrieval_cap"] = (("cand",), lambda d: f"SELECT s1_id, target, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, target ORDER BY cand_id) AS r FROM cand) t WHERE r <= {BASELINE_CAP}")
QUERIES["retrieval_cp_max_df"] = (("hit", "df"), lambda d: "SELECT DISTINCT s1_id, cand_id FROM hit JOIN df ON hit.key = df.key AND hit.target = df.target WHERE hit.key NOT LIKE 'cp:%' OR df <= 5")
QUERIES["retrieval_summary"] = (("per",), lambda d: f"SELECT {big('sum(n)', 'total_candidates')}, {big('count(CASE WHEN n = 0 THEN 1 END)', 'zero_candidates')}, {r6('avg(n)', 'avg_candidates')}, {big('max(n)', 'max_candidates')}, {big('count(*)', 's1_rows')} FROM per")


#: fixed values: most postings of a key, least keys in common, most candidates of a record and target
CHANNELS = {"char_ngram": (50_000, 2, 5_000), "address_numeric": (20_000, 1, 3_000)}
#: fixed values: most candidates of the baseline channel a target; of the submission form, most postings of a key and most candidates
BASELINE_CAP, SUBMISSION_BUCKET, SUBMISSION_CAP = 10_000, 5_000, 500


def _channel(keys, max_df: int, overlap: int, cap: int):
    """Score by shared keys, keys above max_df left out, best cap of those with overlap."""
    return lambda d: f"""SELECT s1_id, cand_id, {big('score', 'score')} FROM (SELECT *, row_number() OVER (PARTITION BY s1_id, target ORDER BY score DESC, cand_id) AS r FROM
    (SELECT q.entity_id AS s1_id, c.entity_id AS cand_id, c.src AS target, count(*) AS score FROM ck q JOIN ck c ON q.key = c.key
     JOIN (SELECT src, key FROM ck WHERE src <> 'S1' GROUP BY src, key HAVING count(*) <= {max_df}) f ON c.src = f.src AND c.key = f.key
     WHERE q.src = 'S1' AND c.src <> 'S1' GROUP BY q.entity_id, c.entity_id, c.src) t WHERE score >= {overlap}) u WHERE r <= {cap}"""


#: the name is normalised once a record, not once a gram
cte("ckn", "e")(lambda d: f"SELECT entity_id, src, key FROM (SELECT entity_id, src, {X.gram_keys_of(d, 'n')} AS ks FROM (SELECT entity_id, src, {X.norm_name(d, 'business_name')} AS n FROM e WHERE {ascii_(d, 'business_name')}) t0) t {d.unnest('ks', 'key')}")
cte("cka", "p")(lambda d: f"SELECT entity_id, src, key FROM (SELECT entity_id, src, {X.address_keys(d, 'business_address', 'country')} AS ks FROM p) t {d.unnest('ks', 'key')}")
cte("ckae", "e")(lambda d: f"SELECT entity_id, src, key FROM (SELECT entity_id, src, {X.address_keys(d, 'business_address', 'country')} AS ks FROM e) t {d.unnest('ks', 'key')}")
#: of the view e, candidates by address numbers
cte("address_hits", "ckae")(lambda d: _channel("ckae", *CHANNELS["address_numeric"])(d).replace(" ck ", " ckae "))
QUERIES["channel_char_ngram"] = (("ckn",), lambda d: _channel("ckn", *CHANNELS["char_ngram"])(d).replace(" ck ", " ckn "))
QUERIES["channel_address_numeric"] = (("cka",), lambda d: _channel("cka", *CHANNELS["address_numeric"])(d).replace(" ck ", " cka "))
QUERIES["retrieve_all_channels"] = (("cand", "ckn"), lambda d: f"SELECT s1_id, cand_id FROM cand UNION SELECT s1_id, cand_id FROM ({_channel('ckn', *CHANNELS['char_ngram'])(d).replace(' ck ', ' ckn ')}) x")
QUERIES["family_ablation"] = (("hit", "g", "s1"), lambda d: f"""SELECT cond, {big('count(*)', 'candidates')}, {big('count(g.s1_id)', 'true_pairs')} FROM (
  SELECT DISTINCT cond, s1_id, cand_id FROM hit JOIN (SELECT 'bn' AS cond, 'bn' AS fam UNION ALL SELECT 'ba', 'ba' UNION ALL SELECT 'cp', 'cp' UNION ALL SELECT 'bn+ba', 'bn' UNION ALL SELECT 'bn+ba', 'ba'
  UNION ALL SELECT 'bn+cp', 'bn' UNION ALL SELECT 'bn+cp', 'cp' UNION ALL SELECT 'ba+cp', 'ba' UNION ALL SELECT 'ba+cp', 'cp' UNION ALL SELECT 'all', 'bn' UNION ALL SELECT 'all', 'ba' UNION ALL SELECT 'all', 'cp') c
  ON split_part(hit.key, ':', 1) = c.fam) h LEFT JOIN g ON h.s1_id = g.s1_id AND h.cand_id = g.matched_id GROUP BY cond""")
QUERIES["fanout_profile"] = (("k",), lambda d: f"""SELECT split_part(c.key, ':', 1) AS family, {big('count(*)', 'shared_keys')}, {big('sum(c.df * q.queries)', 'rows_joined')}, {big('max(q.queries)', 'max_sharing')}, {big('max(c.df)', 'max_postings')}
  FROM (SELECT key, count(*) AS df FROM k WHERE src <> 'S1' GROUP BY key) c JOIN (SELECT key, count(*) AS queries FROM k WHERE src = 'S1' GROUP BY key) q ON c.key = q.key GROUP BY 1""")
QUERIES["keys_present"] = (("k",), lambda d: f"SELECT {big('count(DISTINCT key)', 'present')} FROM k WHERE src = 'S1' AND key IN (SELECT key FROM k WHERE src <> 'S1')")
cte("sk", "p")(lambda d: f"SELECT entity_id, src, key FROM (SELECT entity_id, src, {X.submission_keys(d, 'business_name', 'business_address', 'country')} AS ks FROM p) t {d.unnest('ks', 'key')}")
QUERIES["submission_candidates"] = (("sk",), lambda d: f"""SELECT s1_id, cand_id FROM (SELECT s1_id, cand_id, row_number() OVER (PARTITION BY s1_id ORDER BY cand_id) AS r FROM (SELECT DISTINCT q.entity_id AS s1_id, c.entity_id AS cand_id
  FROM sk q JOIN sk c ON q.key = c.key JOIN (SELECT key FROM sk WHERE src <> 'S1' GROUP BY key HAVING count(*) <= {SUBMISSION_BUCKET}) f ON c.key = f.key WHERE q.src = 'S1' AND c.src <> 'S1') t) u WHERE r <= {SUBMISSION_CAP}""")
QUERIES["key_kind_hits"] = (("hit", "g"), lambda d: f"SELECT split_part(hit.key, ':', 1) AS kind, {big('count(DISTINCT concat(g.s1_id, g.matched_id))', 'true_pairs')} FROM hit JOIN g ON hit.s1_id = g.s1_id AND hit.cand_id = g.matched_id GROUP BY 1")
QUERIES["prefix_length_study"] = (("e", "g"), lambda d: f"""SELECT split_part(q.key, ':', 1) AS length_kind, {big('count(*)', 'candidates')}, {big('count(g.s1_id)', 'true_pairs')} FROM
  (SELECT entity_id, key FROM (SELECT entity_id, {X.cp_keys(d, 'business_name', 'country')} AS ks FROM e WHERE src = 'S1') t {d.unnest('ks', 'key')}) q JOIN
  (SELECT entity_id, key FROM (SELECT entity_id, {X.cp_keys(d, 'business_name', 'country')} AS ks FROM e WHERE src <> 'S1') t {d.unnest('ks', 'key')}) c ON q.key = c.key
  LEFT JOIN g ON q.entity_id = g.s1_id AND c.entity_id = g.matched_id GROUP BY 1""")

# Profiles and blocking simulation.
QUERIES["profile"] = (("e",), lambda d: f"""SELECT src, {big('count(*)', 'n')}, {big('count(DISTINCT entity_id)', 'ids')}, {big('count(DISTINCT business_name)', 'names')}, {big('count(DISTINCT business_address)', 'addresses')}, {big('count(DISTINCT country)', 'countries')},
  {big("count(CASE WHEN business_name IS NULL OR trim(business_name) = '' THEN 1 END)", 'blank_names')}, {big("count(CASE WHEN business_address IS NULL OR trim(business_address) = '' THEN 1 END)", 'blank_addresses')},
  {big('min(length(business_name))', 'min_len')}, {big('max(length(business_name))', 'max_len')}, {r6('avg(length(business_name))', 'avg_len')}, {r6('median(length(business_name))', 'median_len')}, {r6(d.quantile('length(business_name)', 0.25), 'p25_len')}, {r6(d.quantile('length(business_name)', 0.75), 'p75_len')} FROM e GROUP BY src""")
QUERIES["duplicate_stats"] = (("e",), lambda d: " UNION ALL ".join(f"SELECT src, '{c}' AS field, {big('count(*)', 'n_groups')}, {big('sum(cnt - 1)', 'extra')}, {big('sum(cnt)', 'n_rows')} FROM (SELECT src, {e} AS v, count(*) AS cnt FROM e GROUP BY src, {e} HAVING count(*) > 1) t GROUP BY src" for c, e in (("name", "business_name"), ("address", "business_address"), ("folded_name", "lower(business_name)"))))
QUERIES["compare_sources"] = (("e",), lambda d: "SELECT src, " + ", ".join(r6(f"sum(CASE WHEN {c} THEN 1 ELSE 0 END) * 100.0 / count(*)", n) for n, c in (("pct_punct", d.like("business_name", "[.,;:!|]")), ("pct_digit", d.like("business_name", "[0-9]")), ("pct_upper", "business_name = upper(business_name)"), ("pct_non_ascii", d.like("business_name", r"[^\x00-\x7F]")), ("pct_amp", "business_name LIKE '%&%'"), ("pct_double_space", "business_address LIKE '%  %'"), ("pct_addr_digit", d.like("business_address", "[0-9]")))) + " FROM e GROUP BY src")
QUERIES["match_distribution"] = (("gs",), lambda d: f"SELECT {big('match_count', 'match_count')}, {big('count(*)', 'n')} FROM gs GROUP BY match_count")
QUERIES["match_buckets"] = (("gs",), lambda d: f"SELECT CASE WHEN match_count = 0 THEN '0_singleton' WHEN match_count = 1 THEN '1_match' WHEN match_count <= 3 THEN '2-3_matches' ELSE '4+_matches' END AS bucket, {big('count(*)', 'n')}, {big('sum(s2_match_count)', 's2')}, {big('sum(s3_match_count)', 's3')} FROM gs GROUP BY 1")
QUERIES["multiplicity"] = (("g",), lambda d: f"SELECT match_source, {big('n', 's1_per_match')}, {big('count(*)', 'records')} FROM (SELECT match_source, matched_id, count(DISTINCT s1_id) AS n FROM g GROUP BY match_source, matched_id) t GROUP BY match_source, n")
QUERIES["many_to_one"] = (("g",), lambda d: f"SELECT matched_id, {big('count(DISTINCT s1_id)', 'n')} FROM g GROUP BY matched_id HAVING count(DISTINCT s1_id) > 1")
QUERIES["gt_malformed"] = (("gl",), lambda d: f"SELECT {big("count(CASE WHEN ids = '' THEN 1 END)", 'singletons')}, {big("count(CASE WHEN ids LIKE '%S1-%' THEN 1 END)", 'self_refs')}, {big("count(CASE WHEN ids LIKE '%,,%' OR ids LIKE ',%' THEN 1 END)", 'malformed')} FROM gl")
QUERIES["list_duplicates"] = (("g",), lambda d: f"SELECT s1_id, matched_id, {big('count(*)', 'n')} FROM g GROUP BY s1_id, matched_id HAVING count(*) > 1")
QUERIES["country_pivot"] = (("e",), lambda d: f"SELECT country, {', '.join(big(f"sum(CASE WHEN src = '{s}' THEN 1 ELSE 0 END)", s.lower()) for s in ('S1', 'S2', 'S3'))}, {r6('count(*) * 100.0 / sum(count(*)) OVER ()', 'pct')} FROM e GROUP BY country")
QUERIES["match_rate_by_country"] = (("gs",), lambda d: f"SELECT {X.country(d, 'country')} AS country, {big('count(*)', 'n')}, {r6('avg(CAST(CASE WHEN match_count > 0 THEN 1 ELSE 0 END AS DOUBLE))', 'match_rate')}, {r6('avg(match_count)', 'avg_matches')} FROM gs GROUP BY 1")
STRATEGIES = {
    "exact_name": lambda d: X.plain_norm(d, "business_name"), "exact_address": lambda d: X.plain_norm(d, "business_address"), "prefix5": lambda d: X.plain_prefix(d, "business_name", 5),
    "prefix10": lambda d: X.plain_prefix(d, "business_name", 10), "first_token": lambda d: "split_part(lower(trim(business_name)), ' ', 1)",
    "country_prefix5": lambda d: f"concat(country, '|', {X.plain_prefix(d, 'business_name', 5)})", "country_name": lambda d: f"concat(country, '|', {X.plain_norm(d, 'business_name')})",
}
cte("sk7", "e")(lambda d: "SELECT entity_id, src, strategy, key FROM (" + " UNION ALL ".join(f"SELECT entity_id, src, '{n}' AS strategy, {f(d)} AS key FROM e" for n, f in STRATEGIES.items()) + ") t WHERE length(key) >= 3")
cte("cnt7", "sk7")(lambda d: "SELECT q.strategy, c.src AS target, q.key, q.n AS s1_n, c.n AS o_n FROM (SELECT strategy, key, count(*) AS n FROM sk7 WHERE src = 'S1' GROUP BY strategy, key) q JOIN (SELECT strategy, src, key, count(*) AS n FROM sk7 WHERE src <> 'S1' GROUP BY strategy, src, key) c ON q.strategy = c.strategy AND q.key = c.key")
QUERIES["collision_stats"] = (("cnt7",), lambda d: f"SELECT strategy, target, {big('sum(s1_n * o_n)', 'candidates')}, {big('sum(s1_n)', 's1_with_hits')}, {r6('sum(s1_n * o_n) / CAST(sum(s1_n) AS DOUBLE)', 'avg_per_s1')}, {big('max(o_n)', 'max_block')} FROM cnt7 GROUP BY strategy, target")
cte("blk", "sk7", "s1")(lambda d: "SELECT q.strategy, q.entity_id AS s1_id, coalesce(c.n, 0) AS n FROM (SELECT * FROM sk7 WHERE src = 'S1') q LEFT JOIN (SELECT strategy, key, count(*) AS n FROM sk7 WHERE src <> 'S1' GROUP BY strategy, key) c ON q.strategy = c.strategy AND q.key = c.key")
QUERIES["block_percentiles"] = (("blk",), lambda d: f"SELECT strategy, {big('sum(n)', 'total')}, {', '.join(r6(d.quantile('n', q), f'p{int(q * 100)}') for q in (0.9, 0.95, 0.99))}, {big('count(CASE WHEN n = 0 THEN 1 END)', 'zeros')} FROM blk GROUP BY strategy")
QUERIES["strategy_recall"] = (("sk7", "g"), lambda d: f"SELECT a.strategy, {big('count(*)', 'true_pairs_kept')}, {r6('count(*) / CAST((SELECT count(*) FROM g) AS DOUBLE)', 'recall')} FROM g JOIN sk7 a ON g.s1_id = a.entity_id JOIN sk7 b ON g.matched_id = b.entity_id AND a.strategy = b.strategy AND a.key = b.key GROUP BY a.strategy")
QUERIES["combined_estimate"] = (("blk", "s1", "o"), lambda d: f"SELECT {big('sum(best)', 'lower_bound')}, {r6('1 - sum(best) / CAST((SELECT count(*) FROM s1) * (SELECT count(*) FROM o) AS DOUBLE)', 'reduction_ratio')} FROM (SELECT s1_id, max(n) AS best FROM blk WHERE strategy IN ('exact_name', 'exact_address', 'country_prefix5') GROUP BY s1_id) t")
QUERIES["recall_curve"] = (("blk", "g"), lambda d: "SELECT " + ", ".join(big(f"count(CASE WHEN best <= {k} THEN 1 END)", f"at_{k}") for k in (1, 5, 10, 50, 100, 1000, 10000)) + " FROM (SELECT g.s1_id, g.matched_id, coalesce(min(CASE WHEN n > 0 THEN n END), 999999) AS best FROM g LEFT JOIN blk ON g.s1_id = blk.s1_id GROUP BY g.s1_id, g.matched_id) t")
SIGNALS = {
    "norm_name": lambda d: f"lower(trim({d.rep('business_name', r'[^\w\s]', ' ')}))", "norm_address": lambda d: f"lower(trim({d.rep('business_address', r'[^\w\s]', ' ')}))",
    "country_name": lambda d: "CASE WHEN trim(business_name) <> '' THEN concat(country, '|', lower(trim(business_name))) END", "country": lambda d: "country",
    "raw_name": lambda d: "CASE WHEN trim(business_name) <> '' THEN business_name END", "raw_address": lambda d: "CASE WHEN trim(business_address) <> '' THEN business_address END",
}
cte("sig", "e")(lambda d: "SELECT entity_id, src, signal, key FROM (" + " UNION ALL ".join(f"SELECT entity_id, src, '{n}' AS signal, {f(d)} AS key FROM e" for n, f in SIGNALS.items()) + ") t WHERE key <> ''")
#: pairs with a signal are products of counts; only the true ones are looked up
QUERIES["match_signals"] = (("sig", "g"), lambda d: f"""SELECT a.signal, a.target, {big('a.pairs', 'pairs')}, {big('coalesce(t.n, 0)', 'true_pairs')}, {big('a.pairs - coalesce(t.n, 0)', 'false_pairs')}, {r6('coalesce(t.n, 0) / CAST(a.pairs AS DOUBLE)', 'p_match')} FROM
  (SELECT q.signal, c.src AS target, sum(q.n * c.n) AS pairs FROM (SELECT signal, key, count(*) AS n FROM sig WHERE src = 'S1' GROUP BY signal, key) q JOIN (SELECT signal, src, key, count(*) AS n FROM sig WHERE src <> 'S1' GROUP BY signal, src, key) c
   ON q.signal = c.signal AND q.key = c.key GROUP BY q.signal, c.src) a LEFT JOIN
  (SELECT x.signal, y.src AS target, count(*) AS n FROM g JOIN sig x ON g.s1_id = x.entity_id JOIN sig y ON g.matched_id = y.entity_id AND x.signal = y.signal AND x.key = y.key GROUP BY x.signal, y.src) t ON a.signal = t.signal AND a.target = t.target""")
QUERIES["pair_recall"] = (("g", "cand"), lambda d: f"SELECT match_source, {big('count(*)', 'pairs')}, {big('count(c.s1_id)', 'found')}, {r6('count(c.s1_id) / CAST(count(*) AS DOUBLE)', 'recall')} FROM g LEFT JOIN cand c ON g.s1_id = c.s1_id AND g.matched_id = c.cand_id GROUP BY match_source")
QUERIES["entity_recall"] = (("g", "cand"), lambda d: f"SELECT {big('count(*)', 'entities')}, {big('sum(full_)', 'covered')}, {r6('avg(full_)', 'entity_recall')} FROM (SELECT g.s1_id, min(CASE WHEN c.s1_id IS NULL THEN 0 ELSE 1 END) AS full_ FROM g LEFT JOIN cand c ON g.s1_id = c.s1_id AND g.matched_id = c.cand_id GROUP BY g.s1_id) t")
QUERIES["recall_by_bucket"] = (("g", "cand", "gs"), lambda d: f"SELECT {X.match_bucket('gs.match_count').format(text='STRING')} AS bucket, gs.country, {big('count(*)', 'pairs')}, {big('count(c.s1_id)', 'found')} FROM g JOIN gs ON g.s1_id = gs.s1_id LEFT JOIN cand c ON g.s1_id = c.s1_id AND g.matched_id = c.cand_id GROUP BY 1, 2")
QUERIES["target_evaluation"] = (("per", "gs"), lambda d: f"SELECT per.country, {big('count(*)', 'n')}, {r6('avg(n)', 'avg_n')}, {r6('median(n)', 'median_n')}, {r6(d.quantile('n', 0.95), 'p95_n')}, {big('max(n)', 'max_n')}, {big('count(CASE WHEN match_count = 0 THEN 1 END)', 'singletons')} FROM per JOIN gs ON per.s1_id = gs.s1_id GROUP BY per.country")
QUERIES["candidate_quality"] = (("pairs",), lambda d: f"SELECT candidate_source, {big('count(*)', 'candidates')}, {big('sum(label)', 'tp')}, {r6('sum(label) / CAST(count(*) AS DOUBLE)', 'tp_rate')}, {r6('count(*) / CAST(greatest(sum(label), 1) AS DOUBLE)', 'per_true_match')} FROM pairs WHERE in_retrieval GROUP BY candidate_source")
QUERIES["miss_diagnostics"] = (("g", "cand", "e"), lambda d: f"SELECT a.country, {big('count(*)', 'misses')}, {big('count(CASE WHEN length(a.business_name) < 5 THEN 1 END)', 'short_names')}, {big(f"count(CASE WHEN {d.like('a.business_name', r'[^\x00-\x7F]')} THEN 1 END)", 'non_ascii')} FROM g JOIN e a ON g.s1_id = a.entity_id LEFT JOIN cand c ON g.s1_id = c.s1_id AND g.matched_id = c.cand_id WHERE c.s1_id IS NULL GROUP BY a.country")

# Pairs, metrics, validation.
QUERIES["labeled_pairs"] = (("pairs",), lambda d: f"SELECT s1_id, cand_id, candidate_source, {big('label', 'label')}, in_retrieval, label = 0 AND lower(country1) = lower(country2) AS hard_same_country, label = 0 AND {X.sql_name(d, 'name1')} = {X.sql_name(d, 'name2')} AS hard_same_name, label = 0 AND country1 = country2 AND {X.prefix_key(d, 'name1')} = {X.prefix_key(d, 'name2')} AND length({X.prefix_key(d, 'name1')}) >= 3 AS hard_same_cp FROM pairs")
QUERIES["s1_split"] = (("s1",), lambda d: f"SELECT entity_id, CASE WHEN {d.bucket("concat('7:', entity_id)")} % 10000 < 2000 THEN 'val' ELSE 'train' END AS part FROM s1")
QUERIES["class_balance"] = (("pairs",), lambda d: f"SELECT {big('sum(label)', 'n_pos')}, {big('count(*) - sum(label)', 'n_neg')}, {r6('(count(*) - sum(label)) / CAST(greatest(sum(label), 1) AS DOUBLE)', 'scale_pos_weight')} FROM pairs WHERE label = 0 OR in_retrieval")
QUERIES["feature_summary"] = (("sim",), lambda d: f"SELECT {big('label', 'label')}, {r6('avg(name_sim)', 'name_mean')}, {r6('median(name_sim)', 'name_median')}, {r6(d.quantile('addr_sim', 0.25), 'addr_p25')}, {r6(d.quantile('addr_sim', 0.75), 'addr_p75')}, {r6('100 * avg(CAST(CASE WHEN name1 = name2 THEN 1 ELSE 0 END AS DOUBLE))', 'pct_same_name')} FROM sim GROUP BY label")
#: normal forms and sets of a record, for labels and the thirteen features
cte("nf", "e")(
    lambda d: f"""SELECT entity_id, business_name AS name, business_address AS addr, country, {X.basic(d, 'business_name')} AS bn, {X.basic(d, 'business_address')} AS ba, {X.norm_name(d, 'business_name')} AS nn,
    {X.norm_addr(d, 'business_address')} AS na, {X.token_set(d, X.norm_name(d, 'business_name'))} AS nt, {X.token_set(d, X.norm_addr(d, 'business_address'))} AS aset, {X.token_set(d, X.basic(d, 'business_name'))} AS bnt,
    {X.token_set(d, X.basic(d, 'business_address'))} AS bat, {X.ngrams(d, X.basic(d, 'business_name'), 3)} AS ng, {X.ngrams(d, X.basic(d, 'business_address'), 3)} AS ag, {X.digits(d, 'business_address')} AS dg, {X.postal(d, 'business_address')} AS po
    FROM e WHERE {ascii_(d, 'business_name', 'business_address')}"""
)
_BOTH = "name addr country bn ba nn na nt aset bnt bat ng ag dg po".split()
cte("nfp", "pairs", "nf")(lambda d: f"SELECT p.s1_id, p.cand_id, p.label, p.in_retrieval, {', '.join(f'{x}.{c} AS {c}{k}' for k, x in ((1, 'a'), (2, 'b')) for c in _BOTH)} FROM pairs p JOIN nf a ON p.s1_id = a.entity_id JOIN nf b ON p.cand_id = b.entity_id")
cte("labelled", "nfp")(
    lambda d: f"""SELECT s1_id, cand_id, label, 'name' AS field, {X.name_transforms(d)} AS patterns FROM nfp
    UNION ALL SELECT s1_id, cand_id, label, 'address' AS field, {X.address_transforms(d)} AS patterns FROM nfp"""
)
cte("pattern", "labelled")(lambda d: f"SELECT s1_id, cand_id, label, field, pattern FROM labelled {d.unnest('patterns', 'pattern')}")
QUERIES["transform_labels"] = (("pattern",), lambda d: f"SELECT field, pattern, {big('label', 'label')}, {big('count(*)', 'n')} FROM pattern GROUP BY field, pattern, label")
QUERIES["transform_examples"] = (("pattern",), lambda d: "SELECT field, pattern, s1_id, cand_id FROM (SELECT *, row_number() OVER (PARTITION BY field, pattern ORDER BY s1_id, cand_id) AS r FROM (SELECT DISTINCT field, pattern, s1_id, cand_id FROM pattern) u) t WHERE r <= 15")
QUERIES["pair_features_13"] = (("nfp",), lambda d: f"""SELECT s1_id, cand_id, {big('label', 'label')}, name1 = name2 AS exact_name, addr1 = addr2 AS exact_address, country1 = country2 AS exact_country, nn1 = nn2 AS norm_name_eq, na1 = na2 AS norm_addr_eq,
  {r6(X.levenshtein(d, 'nn1', 'nn2'), 'name_sim')}, {r6(X.levenshtein(d, 'na1', 'na2'), 'addr_sim')}, {r6(X.jaccard(d, 'bnt1', 'bnt2'), 'name_token_jaccard')}, {r6(X.jaccard(d, 'bat1', 'bat2'), 'addr_token_jaccard')},
  {r6(X.jaccard(d, 'ng1', 'ng2'), 'name_trigram_jaccard')}, {r6(X.jaccard(d, 'ag1', 'ag2'), 'addr_trigram_jaccard')}, {r6(X.jaccard(d, 'dg1', 'dg2'), 'digit_jaccard')}, {d.size(d.both('po1', 'po2'))} > 0 AS postal_overlap FROM nfp""")
#: true pairs that no key finds, and all labelled pairs by the same rules
QUERIES["failure_categories"] = (("pairs",), lambda d: f"SELECT category, {big('count(*)', 'n')} FROM (SELECT {X.failure_category(d)} AS category FROM pairs WHERE label = 1 AND NOT in_retrieval) t GROUP BY category")
QUERIES["pair_categories"] = (("pairs",), lambda d: f"SELECT category, {big('label', 'label')}, {big('count(*)', 'n')} FROM (SELECT label, {X.failure_category(d)} AS category FROM pairs) t GROUP BY category, label")
QUERIES["hard_negatives"] = (("s1", "o", "g"), lambda d: f"SELECT kind, {big('count(*)', 'n')} FROM (SELECT kind, h.s1_id, h.cand_id FROM (SELECT 'same_name_other_address' AS kind, s1.entity_id AS s1_id, o.entity_id AS cand_id FROM s1 JOIN o ON s1.country = o.country AND lower(s1.business_name) = lower(o.business_name) WHERE s1.business_address <> o.business_address UNION ALL SELECT 'same_address_other_name', s1.entity_id, o.entity_id FROM s1 JOIN o ON s1.business_address = o.business_address WHERE s1.business_name <> o.business_name AND s1.business_address <> '') h LEFT JOIN g ON h.s1_id = g.s1_id AND h.cand_id = g.matched_id WHERE g.s1_id IS NULL) t GROUP BY kind")
QUERIES["hard_cases"] = (("sim",), lambda d: f"SELECT s1_id, cand_id, {r6('1 - (name_sim + addr_sim) / 2', 'difficulty')} FROM sim WHERE label = 0 ORDER BY round((name_sim + addr_sim) / 2, 9) DESC, s1_id, cand_id LIMIT 50")
QUERIES["seeded_sample"] = (("pairs",), lambda d: "SELECT s1_id, cand_id FROM pairs ORDER BY md5(concat('42', s1_id, cand_id)), s1_id, cand_id LIMIT 100")
QUERIES["stratified_sample"] = (("e",), lambda d: "SELECT entity_id, src FROM (SELECT entity_id, src, row_number() OVER (PARTITION BY src ORDER BY md5(concat('42', entity_id)), entity_id) AS r FROM e) t WHERE r <= 50")
QUERIES["leakage"] = (("s1", "o"), lambda d: f"SELECT 'name' AS field, {big('count(*)', 'n')} FROM (SELECT business_name FROM s1 INTERSECT SELECT business_name FROM o) t UNION ALL SELECT 'record', {big('count(*)', 'n')} FROM (SELECT business_name, business_address, country FROM s1 INTERSECT SELECT business_name, business_address, country FROM o) t")
QUERIES["only_in_s1"] = (("s1", "o"), lambda d: "SELECT business_name FROM s1 EXCEPT SELECT business_name FROM o")
QUERIES["macro_metrics"] = (("f",), lambda d: f"SELECT country, CASE WHEN match_count = 0 THEN 'singleton' ELSE 'matched' END AS kind, {big('count(*)', 'n')}, {r6('avg(f05)', 'macro_f05')}, {r6('avg(pr)', 'macro_p')}, {r6('avg(rc)', 'macro_r')} FROM f WHERE tau = 0.5 GROUP BY 1, 2")
QUERIES["threshold_sweep"] = (("f",), lambda d: f"SELECT tau, {r6('avg(f05)', 'macro_f05')}, {r6('avg(f10)', 'macro_f10')}, {r6('avg(round(pr, 6))', 'macro_p')}, {r6('avg(round(rc, 6))', 'macro_r')}, {big('sum(predicted)', 'n_pred')}, {r6('avg(CAST(CASE WHEN predicted > 0 THEN 1 ELSE 0 END AS DOUBLE))', 'coverage')} FROM f GROUP BY tau")
QUERIES["unretrieved_positives"] = (("pairs",), lambda d: f"SELECT {big('count(CASE WHEN label = 1 THEN 1 END)', 'positives')}, {big('count(CASE WHEN label = 1 AND NOT in_retrieval THEN 1 END)', 'unretrieved')}, {big('count(DISTINCT CASE WHEN label = 1 AND NOT in_retrieval THEN s1_id END)', 's1_affected')} FROM pairs")
QUERIES["predictions"] = (("s1", "scored"), lambda d: f"SELECT s1.entity_id AS source1_entity_id, coalesce(p.ids, '') AS matched_entity_ids FROM s1 LEFT JOIN (SELECT s1_id, {d.ordered('cand_id')} AS ids FROM scored WHERE proba >= 0.6 GROUP BY s1_id) p ON s1.entity_id = p.s1_id")
#: a submission with planted faults: a self match, an unknown id, a missing and an extra row
cte("sub", "gl")(lambda d: "SELECT s1_id, CASE WHEN s1_id LIKE '%3' THEN concat(ids, ',', s1_id) WHEN s1_id LIKE '%6' THEN concat(ids, ',S2-unknown') ELSE ids END AS ids FROM gl WHERE s1_id NOT LIKE '%9' UNION ALL SELECT 'S1-extra', '' UNION ALL SELECT s1_id, ids FROM gl WHERE s1_id LIKE '%00'")
cte("subp", "sub")(lambda d: f"SELECT s1_id, trim(i) AS id FROM sub {d.unnest(d.split('ids', ','), 'i')} WHERE trim(i) <> ''")
QUERIES["validate_submission"] = (("sub", "subp", "s1", "o", "cand"), lambda d: f"""SELECT 'duplicate_rows' AS fault, {big('count(*)', 'n')} FROM (SELECT s1_id FROM sub GROUP BY s1_id HAVING count(*) > 1) t
  UNION ALL SELECT 'duplicate_ids', {big('count(*)', 'n')} FROM (SELECT s1_id, id FROM subp GROUP BY s1_id, id HAVING count(*) > 1) t
  UNION ALL SELECT 'self_or_wrong_prefix', {big('count(*)', 'n')} FROM subp WHERE id NOT LIKE 'S2-%' AND id NOT LIKE 'S3-%'
  UNION ALL SELECT 'unknown_id', {big('count(*)', 'n')} FROM subp LEFT JOIN o ON subp.id = o.entity_id WHERE o.entity_id IS NULL AND (id LIKE 'S2-%' OR id LIKE 'S3-%')
  UNION ALL SELECT 'missing_s1', {big('count(*)', 'n')} FROM s1 LEFT JOIN sub ON s1.entity_id = sub.s1_id WHERE sub.s1_id IS NULL
  UNION ALL SELECT 'extra_s1', {big('count(*)', 'n')} FROM sub LEFT JOIN s1 ON s1.entity_id = sub.s1_id WHERE s1.entity_id IS NULL
  UNION ALL SELECT 'not_in_candidates', {big('count(*)', 'n')} FROM subp LEFT JOIN cand c ON subp.s1_id = c.s1_id AND subp.id = c.cand_id WHERE c.s1_id IS NULL""")
