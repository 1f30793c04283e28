"""URL filter: rules, then empirical-Bayes reputation of the host.

Only SQL functions. A rule names a host and a path prefix; it fits the host and
its subdomains, and the longest that fits decides. Other pages are judged by
their host: labelled outcomes (good or not) of its pages are shrunk towards its
registered domain's, those towards its suffix's, and those towards all pages',
each by a beta-binomial prior whose strength is estimated from the groups'
spread by moments. A page is blocked if the upper bound of its host's share of
good pages (normal approximation at Z) is below MIN_GOOD, so a host without
labels, or with few, is only blocked on the strength of its domain or suffix.

Outcomes are a table (page_id, good); the query takes ``labels.quality`` where
its id is the page's, the only labels there are. Hosts' counts are stored once;
their bounds are broadcast while their number is below BROADCAST_HOSTS and
joined by a shuffle, which splits frequent hosts, beyond it.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and the verdict of all pages that have no host. Repeated rows count
each time; an outcome other than 0 or 1, or of no page_id, isn't used. Letters
other than A-Z aren't lower-cased. Other columns don't matter; an empty table
gives no rows, and without outcomes no page is blocked but by a rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.storage import finished, stored, table

#: (host, path prefix, verdict)
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
MIN_GOOD = 0.5
Z = 1.645
STRENGTHS = (1.0, 1000.0)
BROADCAST_HOSTS = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Public suffixes of two labels (a parameter of ``judge``); any other suffix is the last label.
TWO_LABELS = tuple(
    "ac.uk co.uk gov.uk ltd.uk me.uk net.uk org.uk plc.uk com.au edu.au gov.au id.au net.au org.au com.br gov.br net.br org.br com.cn edu.cn gov.cn net.cn org.cn "
    "ac.in co.in firm.in gen.in gov.in net.in org.in ac.jp co.jp go.jp ne.jp or.jp ac.kr co.kr go.kr or.kr com.mx gob.mx org.mx ac.nz co.nz govt.nz net.nz org.nz "
    "com.sg edu.sg gov.sg com.tr edu.tr gov.tr org.tr com.tw edu.tw gov.tw org.tw ac.za co.za gov.za org.za co.il ac.il org.il com.ar gob.ar com.hk edu.hk com.my com.ph com.vn co.id or.id co.th in.th".split()
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, as host and path in one string, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r[0] + r[1])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def domain_of(host: Column, two_labels=TWO_LABELS) -> tuple[Column, Column]:
    """Registered domain (suffix and a label before it, if any) and suffix."""
    labels = F.split(host, r"\.")
    last = lambda n: F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), F.lit(n)), ".")
    two = last(2).isin(*two_labels)
    return F.when(two, last(3)).otherwise(last(2)), F.when(two, last(2)).otherwise(last(1))


def _strength(groups: DataFrame, name: str) -> DataFrame:
    """One row: the prior's strength for groups (n, good), by moments, and overall counts."""
    sums = groups.agg(
        F.count("*").alias("g"), F.sum("n").alias("n"), F.sum("good").alias("good"),
        F.sum(F.col("n") * F.col("n")).alias("n2"), F.sum(F.col("good") * F.col("good") / F.col("n")).alias("share2"),
    )
    p = F.col("good") / F.col("n")
    spread = F.col("share2") - F.col("n") * p * p
    room = F.col("n") - F.col("n2") / F.col("n") - (F.col("g") - 1)
    rho = (spread / (p * (1 - p)) - (F.col("g") - 1)) / room
    bounded = F.least(F.greatest(1 / rho - 1, F.lit(STRENGTHS[0])), F.lit(STRENGTHS[1]))
    k = F.when((F.col("good") > 0) & (F.col("good") < F.col("n")) & (room > 0) & (rho > 0), bounded).otherwise(F.lit(STRENGTHS[1]))
    return sums.select(k.alias(name))


def reputation(pages: DataFrame, outcomes: DataFrame, two_labels=TWO_LABELS) -> DataFrame:
    """(host, upper): the bound of each host of ``pages`` (page_id, host)."""
    good = outcomes.where("good in (0, 1)").select(F.col("page_id").alias("_id"), F.col("good").cast("long").alias("good"))
    #: only pages with an outcome are joined, so rows without page_id don't meet in one task
    seen = pages.where("page_id is not null").join(good, F.col("page_id") == F.col("_id")).groupBy("host").agg(F.count("*").alias("n"), F.sum("good").alias("good"))
    hosts = pages.select("host").distinct().join(seen, "host", "left").na.fill(0, ["n", "good"])
    domain, suffix = domain_of(F.col("host"), two_labels)
    hosts = stored(hosts.select("host", domain.alias("domain"), suffix.alias("suffix"), "n", "good"), "hosts")
    domains = stored(hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("good").alias("dgood")), "domains")
    suffixes = stored(domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dgood").alias("sgood")), "suffixes")
    whole = suffixes.agg(F.coalesce(F.sum("sn"), F.lit(0)).alias("tn"), F.coalesce(F.sum("sgood"), F.lit(0)).alias("tgood"))
    ks = [
        _strength(hosts.where("n > 0").select("n", "good"), "kh"),
        _strength(domains.where("dn > 0").select(F.col("dn").alias("n"), F.col("dgood").alias("good")), "kd"),
        _strength(suffixes.where("sn > 0").select(F.col("sn").alias("n"), F.col("sgood").alias("good")), "ks"),
    ]
    #: one row of numbers
    for k in ks:
        whole = whole.join(F.broadcast(k))
    chain = hosts.join(domains, ["domain", "suffix"]).join(suffixes, "suffix").join(F.broadcast(whole))
    top = (F.col("tgood") + 1) / (F.col("tn") + 2)
    of_suffix = (F.col("sgood") + F.col("ks") * top) / (F.col("sn") + F.col("ks"))
    of_domain = (F.col("dgood") + F.col("kd") * of_suffix) / (F.col("dn") + F.col("kd"))
    weight = F.col("n") + F.col("kh")
    mean = (F.col("good") + F.col("kh") * of_domain) / weight
    return chain.select(F.col("host"), (mean + Z * F.sqrt(mean * (1 - mean) / (weight + 1))).alias("upper"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, two_labels=TWO_LABELS) -> DataFrame:
    """page_id, host, path, rule, verdict of each page."""
    return finished(lambda: _judge(pages, outcomes, rules, two_labels), "verdicts")


def _judge(pages: DataFrame, outcomes: DataFrame, rules, two_labels) -> DataFrame:
    host, path = parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = rule_of(F.col("host"), F.col("path"), rules)
    known = stored(reputation(split, outcomes, two_labels).withColumnRenamed("host", "_host"), "bounds")
    known = F.broadcast(known) if known.count() <= BROADCAST_HOSTS else known
    out = split.join(known, F.col("host") == F.col("_host"), "left")
    own = F.when(F.col("upper") < MIN_GOOD, "block").otherwise("allow")
    return out.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, own).alias("verdict"))


def op8_urls(spark, sf_dir: str) -> DataFrame:
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), F.col("quality").alias("good"))
    return judge(table(spark, sf_dir, "pages"), outcomes)


def _strength_sql(groups: str, n: str, good: str) -> str:
    p, room = f"(g.good / g.n)", "(g.n - g.n2 / g.n - (g.g - 1))"
    rho = f"(((g.share2 - g.n * {p} * {p}) / nullif({p} * (1 - {p}), 0) - (g.g - 1)) / nullif({room}, 0))"
    return f"""(SELECT CASE WHEN g.good > 0 AND g.good < g.n AND {room} > 0 AND {rho} > 0
      THEN least(greatest(1 / {rho} - 1, {STRENGTHS[0]}::DOUBLE), {STRENGTHS[1]}::DOUBLE) ELSE {STRENGTHS[1]}::DOUBLE END AS k
      FROM (SELECT count(*)::DOUBLE AS g, sum({n})::DOUBLE AS n, sum({good})::DOUBLE AS good, sum({n} * {n})::DOUBLE AS n2,
      sum({good} * {good} / {n}::DOUBLE)::DOUBLE AS share2 FROM {groups} WHERE {n} > 0) g)"""


def _rule_sql(value: str) -> str:
    order = sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))
    whens = " ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if value == 'rule' else v}'" for h, p, v in order
    )
    return f"CASE {whens} ELSE NULL END"


_TWO = ", ".join(f"'{x}'" for x in TWO_LABELS)
OP8_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
p AS (SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
h0 AS (SELECT host, count(quality) AS n, coalesce(sum(quality), 0) AS good
       FROM p LEFT JOIN (SELECT doc_id, quality FROM labels WHERE quality IN (0, 1)) ON doc_id = page_id GROUP BY host),
h1 AS (SELECT *, string_split(host, '.') AS l FROM h0),
h2 AS (SELECT *, array_to_string(list_slice(l, greatest(len(l) - 1, 1), len(l)), '.') AS l2,
         array_to_string(list_slice(l, greatest(len(l) - 2, 1), len(l)), '.') AS l3, l[len(l)] AS l1 FROM h1),
h AS (SELECT host, n, good, CASE WHEN l2 IN ({_TWO}) THEN l3 ELSE l2 END AS domain, CASE WHEN l2 IN ({_TWO}) THEN l2 ELSE l1 END AS suffix FROM h2),
d AS (SELECT domain, suffix, sum(n) AS dn, sum(good) AS dgood FROM h GROUP BY domain, suffix),
s AS (SELECT suffix, sum(dn) AS sn, sum(dgood) AS sgood FROM d GROUP BY suffix),
t AS (SELECT coalesce(sum(sn), 0)::DOUBLE AS tn, coalesce(sum(sgood), 0)::DOUBLE AS tgood FROM s),
m AS (SELECT host, n, kh.k AS kh, (good + kh.k * ((dgood + kd.k * ((sgood + ks.k * ((tgood + 1) / (tn + 2))) / (sn + ks.k))) / (dn + kd.k))) / (n + kh.k) AS mean
      FROM h JOIN d USING (domain, suffix) JOIN s USING (suffix), t,
      {_strength_sql('h', 'n', 'good')} kh, {_strength_sql('d', 'dn', 'dgood')} kd, {_strength_sql('s', 'sn', 'sgood')} ks),
u AS (SELECT host, mean + {Z}::DOUBLE * sqrt(mean * (1 - mean) / (n + kh + 1)) AS upper FROM m)
SELECT page_id, p.host, path, {_rule_sql('rule')} AS rule,
  coalesce({_rule_sql('verdict')}, CASE WHEN upper < {MIN_GOOD} THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT * FROM p) p LEFT JOIN u ON p.host = u.host
""".replace("CASE WHEN (host", "CASE WHEN (p.host").replace("OR ends_with(host", "OR ends_with(p.host").replace("WHEN (host", "WHEN (p.host")
