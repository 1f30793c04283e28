"""SQL expressions of the text, key and similarity functions.

Each is written once over the few primitives in which Spark SQL and the oracle's
SQL differ; ``SPARK`` renders what runs, ``DUCK`` what checks it.
"""

from __future__ import annotations


class Spark:
    """Primitives in Spark SQL."""

    def lit(self, p: str) -> str:
        return "r'" + p + "'" if "'" not in p else "'" + p.replace("\\", "\\\\").replace("'", "\\'") + "'"

    def rep(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, '{r}')"

    def like(self, x: str, p: str) -> str:
        return f"({x} RLIKE {self.lit(p)})"

    def found(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)}, 0)"

    def first(self, x: str, p: str) -> str:
        return f"regexp_extract({x}, {self.lit(p)}, 0)"

    def split(self, x: str, sep: str) -> str:
        return f"split({x}, {self.lit('[' + sep + ']')}, -1)"

    def keep(self, a: str, v: str, cond: str) -> str:
        return f"filter({a}, {v} -> {cond})"

    def each(self, a: str, v: str, e: str) -> str:
        return f"transform({a}, {v} -> {e})"

    def cut(self, a: str, k: int) -> str:
        return f"slice({a}, 1, {k})"

    def size(self, a: str) -> str:
        return f"CAST(size({a}) AS BIGINT)"

    def set(self, a: str) -> str:
        return f"array_distinct({a})"

    def unique(self, a: str) -> str:
        """Without repeats, in order."""
        return f"array_distinct({a})"

    def at(self, a: str, i: str) -> str:
        return f"try_element_at({a}, CAST({i} AS INT))"

    def both(self, a: str, b: str) -> str:
        return f"array_intersect({a}, {b})"

    def cat(self, *a: str) -> str:
        return f"concat({', '.join(a)})"

    def arr(self, *a: str) -> str:
        return f"array({', '.join(a)})"

    def seq(self, a: str, b: str) -> str:
        return f"(CASE WHEN {b} >= {a} THEN sequence({a}, {b}) ELSE array() END)"

    def unnest(self, a: str, alias: str) -> str:
        return f"LATERAL VIEW explode({a}) _{alias} AS {alias}"

    def join(self, a: str, sep: str) -> str:
        return f"array_join({a}, '{sep}')"

    def ordered(self, x: str) -> str:
        return f"array_join(array_sort(collect_set({x})), ',')"

    def quantile(self, x: str, p: float) -> str:
        return f"percentile({x}, {p})"

    def bucket(self, x: str) -> str:
        return f"CAST(conv(substr(md5({x}), 1, 8), 16, 10) AS BIGINT)"

    #: SQL has no compatibility decomposition: forms that start with it are of ASCII text
    ascii_only = True

    def decomposed(self, x: str) -> str:
        return x

    empty = "CAST(array() AS ARRAY<STRING>)"
    real = "CAST({} AS DOUBLE)"


class Duck(Spark):
    """Primitives in the oracle's SQL."""

    def lit(self, p: str) -> str:
        return "'" + p.replace("'", "''") + "'"

    def rep(self, x: str, p: str, r: str) -> str:
        return f"regexp_replace({x}, {self.lit(p)}, '{r}', 'g')"

    def like(self, x: str, p: str) -> str:
        return f"regexp_matches({x}, {self.lit(p)})"

    def found(self, x: str, p: str) -> str:
        return f"regexp_extract_all({x}, {self.lit(p)})"

    def first(self, x: str, p: str) -> str:
        return f"regexp_extract({x}, {self.lit(p)})"

    def split(self, x: str, sep: str) -> str:
        return f"string_split({x}, '{sep}')"

    def keep(self, a: str, v: str, cond: str) -> str:
        return f"list_filter({a}, lambda {v}: {cond})"

    def each(self, a: str, v: str, e: str) -> str:
        return f"list_transform({a}, lambda {v}: {e})"

    def cut(self, a: str, k: int) -> str:
        return f"list_slice({a}, 1, {k})"

    def size(self, a: str) -> str:
        return f"CAST(len({a}) AS BIGINT)"

    def set(self, a: str) -> str:
        return f"list_distinct({a})"

    def unique(self, a: str) -> str:
        return f"list_transform(list_filter(list_transform({a}, lambda x, i: {{'x': x, 'i': i}}), lambda s: list_position({a}, s.x) = s.i), lambda s: s.x)"

    def at(self, a: str, i: str) -> str:
        return f"list_extract({a}, CAST({i} AS BIGINT))"

    def both(self, a: str, b: str) -> str:
        return f"list_intersect({a}, {b})"

    def cat(self, *a: str) -> str:
        out = a[0]
        for x in a[1:]:
            out = f"list_concat({out}, {x})"
        return out

    def arr(self, *a: str) -> str:
        return f"[{', '.join(a)}]"

    def seq(self, a: str, b: str) -> str:
        return f"(CASE WHEN {b} >= {a} THEN range(CAST({a} AS BIGINT), CAST({b} AS BIGINT) + 1) ELSE CAST([] AS BIGINT[]) END)"

    def unnest(self, a: str, alias: str) -> str:
        return f", unnest({a}) AS _{alias}({alias})"

    def join(self, a: str, sep: str) -> str:
        return f"array_to_string({a}, '{sep}')"

    def ordered(self, x: str) -> str:
        return f"coalesce(string_agg(DISTINCT {x}, ',' ORDER BY {x}), '')"

    def quantile(self, x: str, p: float) -> str:
        return f"quantile_cont({x}, {p})"

    def bucket(self, x: str) -> str:
        return f"CAST(('0x' || substr(md5({x}), 1, 8)) AS BIGINT)"

    empty = "CAST([] AS VARCHAR[])"


class Whole(Spark):
    """Spark SQL over records of any script, with their decomposed text as columns;
    white space, digits and word boundaries are those of Unicode."""

    ascii_only = False
    columns = {"business_name": "name_nfkd", "business_address": "address_nfkd"}

    def decomposed(self, x: str) -> str:
        return self.columns.get(x, x)

    def rep(self, x: str, p: str, r: str) -> str:
        return super().rep(x, f"(?U){p}", r)

    def like(self, x: str, p: str) -> str:
        return super().like(x, f"(?U){p}")

    def found(self, x: str, p: str) -> str:
        return super().found(x, f"(?U){p}")


SPARK, DUCK, WHOLE = Spark(), Duck(), Whole()

#: Letters, digits and underscore of any script; ASCII where an operator's form asks for it.
WORDS = r"[^\pL\pN_\s]"
WORDS_AND = r"[^\pL\pN_\s&]"

#: Words left out of the address keys of the submission form and of the family form.
ADDRESS_STOP = (
    "road street near opp opposite behind beside floor flat house plot building cross main lane avenue dist district post state india "
    "area nagar colony block sector layout circle bhavan complex tower phase stage dept ward village mandal taluk town city line room"
).split()
FAMILY_ADDRESS_STOP = (
    "road street avenue lane drive plot house floor block sector phase colony nagar layout cross main area village district state india near "
    "behind opposite beside apartment building complex tower society number post office shop market south north east west city town station door flat room gate park"
).split()
#: Name words and grams left out of the family form's keys.
NAME_STOP = "private limited incorporated corporation llc llp plc company and the of dba services service group holdings holding".split()
GRAM_STOP = "the and inc ltd pvt cor ion ent ing com llc plc ser gro hol lim ite ted ati".split()
#: Legal forms by pattern, and the form each stands for.
LEGAL_FORMS = {
    r"\bcorp\b\.?": "corporation", r"\bcorporation\b": "corporation", r"\binc\b\.?": "incorporated", r"\bincorporated\b": "incorporated",
    r"\bltd\b\.?": "limited", r"\blimited\b": "limited", r"\bllc\b\.?": "llc", r"\bllp\b\.?": "llp", r"\blp\b\.?": "lp", r"\bco\b\.?": "company",
    r"\bcompany\b": "company", r"\bpvt\b\.?": "private", r"\bprivate\b": "private", r"\bplc\b\.?": "plc", r"\bgmbh\b": "gmbh", r"\bsa\b\.?": "sa", r"\bsrl\b": "srl", r"\bpty\b": "pty",
}
#: Address words and their abbreviations.
ADDRESS_FORMS = {
    "road": ("rd", "road"), "street": ("st", "street"), "avenue": ("ave", "avenue"), "boulevard": ("blvd", "boulevard"), "drive": ("dr", "drive"), "lane": ("ln", "lane"),
    "court": ("ct", "court"), "apartment": ("apt", "apartment"), "suite": ("ste", "suite"), "floor": ("fl", "floor"), "number": ("no", "num"),
}
#: Legal forms written out, and web parts left out.
LEGAL = {"corp": "corporation", "inc": "incorporated", "pvt": "private", "ltd": "limited"}
WEB = ("www", "http", "https", "com", "net", "org")


def squeeze(d: Spark, x: str) -> str:
    return f"trim({d.rep(x, r'\s+', ' ')})"


def basic(d: Spark, x: str) -> str:
    """Lower case, white space collapsed; equals the NFKD form on ASCII text."""
    return squeeze(d, f"lower(coalesce({d.decomposed(x)}, ''))")


def norm_name(d: Spark, x: str) -> str:
    amp = f"replace({basic(d, x)}, '&', ' and ')"
    return squeeze(d, d.rep(amp, WORDS, " "))


def norm_addr(d: Spark, x: str) -> str:
    return squeeze(d, d.rep(basic(d, x), WORDS, " "))


def sql_name(d: Spark, x: str) -> str:
    return squeeze(d, d.rep(f"lower(coalesce({x}, ''))", WORDS_AND, " "))


def sql_addr(d: Spark, x: str) -> str:
    return squeeze(d, d.rep(f"lower(coalesce({x}, ''))", WORDS, " "))


def plain_norm(d: Spark, x: str) -> str:
    """ASCII word class, spaces kept, trimmed."""
    return f"lower(trim({d.rep(f"coalesce({x}, '')", r'[^\w\s&]', ' ')}))"


def plain_prefix(d: Spark, x: str, n: int) -> str:
    return f"left(lower(trim({d.rep(f"coalesce({x}, '')", r'[^\w\s]', ' ')})), {n})"


def prefix_key(d: Spark, x: str, n: int = 5) -> str:
    return f"left({sql_addr(d, x)}, {n})"


def legal_text(d: Spark, x: str) -> str:
    out = d.rep(f"lower(coalesce({x}, ''))", r"[&+]", " and ")
    out = d.rep(d.rep(out, "_", " "), WORDS, " ")
    for short, long in LEGAL.items():
        out = d.rep(out, rf"\b{short}\b", long)
    out = d.rep(out, rf"\b({'|'.join(WEB)})\b", " ")
    return f"(CASE WHEN lower(trim({x})) = 'nan' THEN '' ELSE {squeeze(d, out)} END)"


def tokens(d: Spark, text: str) -> str:
    return d.keep(d.split(text, " "), "t", "t <> ''")


def token_set(d: Spark, text: str) -> str:
    return d.set(tokens(d, text))


def digits(d: Spark, x: str) -> str:
    return d.set(d.found(f"coalesce({x}, '')", r"[0-9]+"))


def postal(d: Spark, x: str) -> str:
    return d.set(d.found(f"coalesce({x}, '')", r"\b\d{5}(?:-\d{4})?\b|\b\d{6}\b"))


def ngrams(d: Spark, text: str, n: int) -> str:
    """Distinct n-grams of text without spaces; a shorter text is its only one."""
    bare = f"replace({text}, ' ', '')"
    grams = d.each(d.seq("1", f"(length({bare}) - {n - 1})"), "i", f"substr({bare}, i, {n})")
    return d.set(f"(CASE WHEN length({bare}) = 0 THEN {d.empty} WHEN length({bare}) < {n} THEN {d.arr(bare)} ELSE {grams} END)")


def jaccard(d: Spark, a: str, b: str, both_empty: str = "1.0") -> str:
    """Of two lists without repeats."""
    same, na, nb = d.size(d.both(a, b)), d.size(a), d.size(b)
    return f"CAST(CASE WHEN {na} = 0 AND {nb} = 0 THEN {both_empty} ELSE {same} / CAST(({na} + {nb} - {same}) AS DOUBLE) END AS DOUBLE)"


def levenshtein(d: Spark, a: str, b: str) -> str:
    longest = f"greatest(length({a}), length({b}))"
    return f"CAST(CASE WHEN {longest} = 0 THEN 0.0 ELSE 1 - levenshtein({a}, {b}) / CAST({longest} AS DOUBLE) END AS DOUBLE)"


def length_ratio(d: Spark, a: str, b: str) -> str:
    return f"CAST(CASE WHEN length({a}) = 0 AND length({b}) = 0 THEN 1.0 ELSE least(length({a}), length({b})) / CAST(greatest(length({a}), length({b})) AS DOUBLE) END AS DOUBLE)"


def f_score(p: str, r: str, beta2: float = 0.25) -> str:
    return f"CAST(CASE WHEN {p} <= 0 AND {r} <= 0 OR {beta2} * {p} + {r} <= 0 THEN 0.0 ELSE {1 + beta2} * {p} * {r} / ({beta2} * {p} + {r}) END AS DOUBLE)"


def country(d: Spark, x: str) -> str:
    up = f"upper(trim(coalesce({x}, '')))"
    return f"(CASE WHEN {up} IN ('INDIA', 'IN') THEN 'IN' WHEN {up} = '' THEN 'UNKNOWN' ELSE {up} END)"


def match_bucket(n: str) -> str:
    return f"(CASE WHEN {n} >= 4 THEN '4+' ELSE CAST({n} AS {{text}}) END)"


# Labels of a pair: lists of strings, over forms of both sides that are computed once a record.


def _same_set(d: Spark, a: str, b: str) -> str:
    return f"({d.size(d.both(a, b))} = {d.size(a)} AND {d.size(a)} = {d.size(b)})"


def _either(d: Spark, x: str, pattern: str) -> str:
    return f"({d.like(f"lower(coalesce({x}1, ''))", pattern)} OR {d.like(f"lower(coalesce({x}2, ''))", pattern)})"


def _labels(d: Spark, field: str, *found: str) -> str:
    """All labels that apply, of equal texts only ``exact``, else at least one."""
    every = d.cat(*found)
    return f"(CASE WHEN coalesce({field}1, '') = coalesce({field}2, '') THEN {d.arr("'exact'")} WHEN {d.size(every)} = 0 THEN {d.arr("'other_variation'")} ELSE {every} END)"


def name_transforms(d: Spark) -> str:
    """How the names of a pair differ: name, bn (basic), nn (normal), nt (its tokens)."""
    same, close = _same_set(d, "nt1", "nt2"), levenshtein(d, "nn1", "nn2")
    shared = d.size(d.both("nt1", "nt2"))
    near = f"(NOT {same} AND {shared} > 0 AND {d.size('nt1')} + {d.size('nt2')} - 2 * {shared} <= 2)"
    swap = lambda x: f"replace({x}, ' and ', ' & ')"
    spelled = f"({swap('bn1')} = bn2 OR {swap('bn2')} = bn1 OR replace(bn1, '&', 'and') = replace(bn2, '&', 'and'))"
    return _labels(
        d,
        "name",
        _when(d, "bn1 = bn2", "'case_only'"),
        _when(d, "nn1 = nn2 AND bn1 <> bn2", "'punctuation_only'"),
        _when(d, "nn1 = nn2 AND bn1 = bn2", "'normalized_exact'"),
        _when(d, f"{d.like("concat(bn1, '|', bn2)", '&| and ')} AND {spelled}", "'ampersand_and'"),
        *[_when(d, _either(d, "name", p), f"'suffix_{form}'") for p, form in LEGAL_FORMS.items()],
        _when(d, f"{same} AND nn1 <> nn2", "'word_order'"),
        _when(d, f"{near} AND {d.size('nt1')} <> {d.size('nt2')}", "'missing_or_extra_words'"),
        _when(d, f"{near} AND {d.size('nt1')} = {d.size('nt2')}", "'minor_token_diff'"),
        _when(d, f"length(nn1) > 3 AND length(nn2) > 3 AND {close} >= 0.7 AND {close} < 1", "'typo_or_substitution'"),
    )


def address_transforms(d: Spark) -> str:
    """How the addresses of a pair differ: addr, ba (basic), na (normal), aset (its tokens),
    dg (digit runs), po (postal codes)."""

    def sets(a: str, missing: str, differ: str) -> list[str]:
        one_empty = f"({d.size(a + '1')} = 0 OR {d.size(a + '2')} = 0)"
        other = f"NOT {_same_set(d, a + '1', a + '2')}"
        return [_when(d, f"{other} AND {one_empty}", f"'{missing}'"), _when(d, f"{other} AND NOT {one_empty}", f"'{differ}'")]

    return _labels(
        d,
        "addr",
        _when(d, "ba1 = ba2", "'case_only'"),
        _when(d, "na1 = na2", "'normalized_exact'"),
        *[_when(d, _either(d, "addr", rf"\b{w}\b"), f"'abbrev_{form}'") for form, words in ADDRESS_FORMS.items() for w in words],
        *sets("dg", "missing_numbers", "numeric_diff"),
        *sets("po", "missing_postal", "postal_diff"),
        _when(d, f"{_same_set(d, 'aset1', 'aset2')} AND na1 <> na2", "'component_reorder'"),
    )


def failure_category(d: Spark) -> str:
    """Why a pair may have been missed; the first rule that holds."""
    blank = lambda x: f"trim(coalesce({x}, '')) = ''"
    n1, n2, a1, a2 = (f"trim({d.rep(f"lower(coalesce({x}, ''))", WORDS, ' ')})" for x in ("name1", "name2", "addr1", "addr2"))
    t1, t2 = tokens(d, squeeze(d, n1)), tokens(d, squeeze(d, n2))
    s1, s2 = d.set(t1), d.set(t2)
    legal = "ltd|limited|pvt|private|corp"
    rules = [
        (d.like("concat(coalesce(name1, ''), coalesce(name2, ''))", r"[^\x00-\x7F]"), "transliteration/multilingual"),
        (f"{blank('addr1')} OR {blank('addr2')}", "missing_address"),
        (f"{n1} = {n2} AND {a1} <> {a2}", "address_normalization_failure"),
        (f"{a1} = {a2} AND {n1} <> {n2}", "name_normalization_failure"),
        (f"{_same_set(d, s1, s2)} AND {n1} <> {n2}", "word_order"),
        (f"{d.like(n1, legal)} OR {d.like(n2, legal)}", "abbreviation/legal_suffix"),
        (f"{d.size(d.both(s1, s2))} >= greatest(1, least({d.size(t1)}, {d.size(t2)}) - 1)", "minor_token_diff/typo"),
        (f"length({n1}) < 10 OR length({n2}) < 10", "common_name/short_name"),
    ]
    return f"(CASE {' '.join(f"WHEN {c} THEN '{k}'" for c, k in rules)} ELSE 'semantic_dba_or_other' END)"


# Blocking keys: lists of strings.


def _when(d: Spark, cond: str, *keys: str) -> str:
    return f"(CASE WHEN {cond} THEN {d.arr(*keys)} ELSE {d.empty} END)"


def baseline_keys(d: Spark, name: str, addr: str, ctry: str) -> str:
    n, a, p = sql_name(d, name), sql_addr(d, addr), prefix_key(d, name)
    return d.cat(
        _when(d, f"{n} <> ''", f"concat('bn:', {n})"),
        _when(d, f"{a} <> ''", f"concat('ba:', {a})"),
        _when(d, f"length({p}) >= 3 AND trim(coalesce({ctry}, '')) <> ''", f"concat('cp:', {ctry}, '|', {p})"),
    )


def baseline_parts(d: Spark, name: str, addr: str, ctry: str) -> dict[str, str]:
    """The baseline keys without their prefix, each null where there is none."""
    n, a, p = sql_name(d, name), sql_addr(d, addr), prefix_key(d, name)
    return {
        "bn": f"(CASE WHEN {n} <> '' THEN {n} END)",
        "ba": f"(CASE WHEN {a} <> '' THEN {a} END)",
        "cp": f"(CASE WHEN length({p}) >= 3 AND trim(coalesce({ctry}, '')) <> '' THEN concat({ctry}, '|', {p}) END)",
    }


def cp_keys(d: Spark, name: str, ctry: str) -> str:
    """One key for each prefix length from 3 to 8."""
    p = lambda k: prefix_key(d, name, k)
    return d.cat(*[_when(d, f"length({p(k)}) >= 3 AND trim(coalesce({ctry}, '')) <> ''", f"concat('cp{k}:', {ctry}, '|', {p(k)})") for k in range(3, 9)])


def gram_keys(d: Spark, name: str) -> str:
    return gram_keys_of(d, norm_name(d, name))


def gram_keys_of(d: Spark, n: str) -> str:
    """Of a normal form; give a column, since the form is named once for each gram."""
    return d.each(d.keep(ngrams(d, n, 3), "t", "length(t) = 3"), "t", "concat('ng:', t)")


def address_keys(d: Spark, addr: str, ctry: str) -> str:
    """Postal codes, house number and numbers of three digits, each with and without country."""
    a, c = f"coalesce({addr}, '')", f"coalesce({ctry}, '')"
    house = f"lower(trim({d.first(a, r'^\s*\d+[a-zA-Z]?\b')}))"
    sets = [("postal", postal(d, addr)), ("num", d.keep(digits(d, addr), "t", "length(t) >= 3")), ("house", f"(CASE WHEN {house} = '' THEN {d.empty} ELSE {d.arr(house)} END)")]
    parts = []
    for kind, values in sets:
        parts.append(d.each(values, "t", f"concat('{kind}:', t)"))
        parts.append(f"(CASE WHEN trim({c}) = '' THEN {d.empty} ELSE {d.each(values, 't', f"concat('{kind}:', {c}, '|', t)")} END)")
    return d.set(d.cat(*parts))


def submission_keys(d: Spark, name: str, addr: str, ctry: str) -> str:
    """nm, ad, dg and hn keys: first four characters of up to three name tokens and of
    up to three address tokens, digit runs, structured numbers and their parts."""
    c, raw = f"upper(trim(coalesce({ctry}, '')))", f"coalesce({addr}, '')"
    good = "length(t) >= 4 AND NOT " + d.like("t", "^[0-9]+$")
    names = d.cut(d.keep(tokens(d, norm_addr(d, name)), "t", good), 3)
    stop = ", ".join(f"'{w}'" for w in ADDRESS_STOP)
    addrs = d.cut(d.keep(tokens(d, norm_addr(d, addr)), "t", f"{good} AND t NOT IN ({stop})"), 3)
    nums = d.cat(d.found(norm_addr(d, addr), r"\d{3,}"), d.found(raw, r"\d{3,}"))
    #: a structured number and its parts share one cap, in order
    whole = d.found(raw, r"\b\d{1,5}(?:[-/][0-9a-zA-Z]+)+\b")
    parts = d.each(whole, "m", d.cat(d.arr(f"concat('{{c}}hn:', lower(m))"), d.each(d.found("m", r"\d{2,}"), "t", "concat('{c}dg:', t)")))
    flat = f"flatten({parts})"
    keys = d.cat(
        d.each(names, "t", f"concat({c}, '|nm:', left(t, 4))"),
        d.each(addrs, "t", f"concat({c}, '|ad:', left(t, 4))"),
        d.each(nums, "t", f"concat({c}, '|dg:', t)"),
        d.each(d.cut(flat.replace("{c}", ""), 5), "t", f"concat({c}, '|', t)"),
    )
    return d.set(keys)


def structured_digits(d: Spark, x: str) -> str:
    """Runs of two or more digits beside a dash, slash or point. These are doubled
    first, so that each side of one has its own."""
    twice = f"replace(replace(replace(coalesce({x}, ''), '-', '--'), '/', '//'), '.', '..')"
    return d.each(d.found(twice, r"[-./]\d{2,}|\d{2,}[-./]"), "m", d.rep("m", "[^0-9]", ""))


def _among(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def family_keys(d: Spark, name: str, addr: str, ctry: str) -> str:
    """The family form's keys of a record's own columns."""
    return family_keys_of(d, legal_text(d, name), legal_text(d, addr), f"coalesce({addr}, '')", f"trim(coalesce({ctry}, ''))")


def family_keys_of(d: Spark, n: str, a: str, raw: str, c: str, latin: str | None = None) -> str:
    """np, sn, tl, ng, ad, pin, dg and fb keys of the legal forms n and a of name and address, the
    address as given, the country, and the legal form of the transliterated name ('' if there is none)."""
    number = d.like("t", r"^\d+$")
    long = lambda x: d.keep(tokens(d, x), "t", f"length(t) >= 4 AND t NOT IN ({_among(NAME_STOP)})")
    brief = lambda x: d.keep(tokens(d, x), "t", f"length(t) BETWEEN 2 AND 3 AND NOT {number} AND t NOT IN ({_among(NAME_STOP)})")
    content = long(n)
    #: of the first two content tokens, the first three grams that are not left out, repeats aside
    grams = f"flatten({d.each(d.cut(content, 2), 'w', ngrams_ordered(d, 'w', 3))})"
    grams = d.keep(grams, "t", f"t NOT IN ({_among(GRAM_STOP)})")
    addrs = d.keep(tokens(d, a), "t", f"length(t) >= 4 AND NOT {number} AND t NOT IN ({_among(FAMILY_ADDRESS_STOP)})")
    pin = d.cat(d.found(a, r"\b\d{5,6}\b"), d.found(raw, r"\b\d{5,6}\b"))
    runs = structured_digits(d, raw)
    pairs = d.each(d.seq("1", f"least({d.size(runs)} - 1, 2)"), "i", f"concat({d.at(runs, 'i')}, {d.at(runs, 'i + 1')})")
    whole = f"length({n}) BETWEEN 2 AND 5 AND NOT {d.like(n, r'^\d+$')}"
    kind = lambda k, v: d.each(v, "t", f"concat({c}, '|{k}:', t)")
    start = lambda v: d.each(v, "t", "left(t, 4)")
    own = [kind(k, start(d.cut(long(latin), 4))) for k in ("np", "tl")] + [kind("sn", d.cut(brief(latin), 2))] if latin else []
    keys = d.cat(
        kind("np", start(d.cut(content, 4))),
        _when(d, whole, f"concat({c}, '|sn:', replace({n}, ' ', ''))"),
        kind("sn", d.cut(brief(n), 3)),
        *own,
        kind("ng", d.cut(d.unique(grams), 3)),
        kind("ad", start(d.cut(addrs, 4))),
        kind("pin", pin),
        kind("dg", d.cat(d.cut(d.found(a, r"\d{3,}"), 3), pairs, d.keep(runs, "t", "length(t) >= 3"))),
    )
    fallback = f"concat({c}, '|fb:', CASE WHEN {n} = '' THEN '_' ELSE left({n}, 3) END)"
    return f"(CASE WHEN {d.size(keys)} = 0 THEN {d.arr(fallback)} ELSE {d.set(keys)} END)"


def ngrams_ordered(d: Spark, bare: str, n: int) -> str:
    grams = d.each(d.seq("1", f"(length({bare}) - {n - 1})"), "i", f"substr({bare}, i, {n})")
    return f"(CASE WHEN length({bare}) < {n} THEN {d.empty} ELSE {grams} END)"
