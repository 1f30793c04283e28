"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Only SQL functions. Sources by code point, null last, weigh WEIGHTS in turn and
share BUDGET times the words of all documents; a target stops at MAX_REPEAT
times its source's words and the excess goes to the others by weight.

A source's documents, permuted by md5 of doc_id, lie end to end on a line, twice
over. The line's first words, as many as the target rounded, are its quota; it
is a number of blocks of BLOCK words, the last of which may be shorter. The
blocks of all sources are dealt among SHARDS output shards of equal size, as if
in random order: a range of sources is halved again and again, and how many of
each shard's blocks belong to the lower half is a multivariate-hypergeometric
draw, made in a binary tree over the shards (exact at every size, by Stadlober's
ratio of uniforms; uniforms come from md5, so reruns agree). Each source's
block numbers are then permuted and dealt in runs as long as its draws say. A
document belongs to the block in which it begins, once for each of the two
rounds, and goes to that block's shard whole; a shard's documents are shuffled.

Prefix sums are taken in two levels, over ranges of rows of about equal size and
then within them, so neither a source nor a bucket is in one task.

Defined results: a null text has size 0; null sources are one source. Repeated
rows, and rows of one doc_id, are documents of their own; of rows with equal
doc_id and size the one whose text has the smaller hash comes first, and rows
without doc_id are ordered by that hash. A source without words has target 0;
an empty table gives no rows. Other columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from weftline.llm.secrets import let
from weftline.storage import finished, stored, table

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_REPEAT = 2
BLOCK = 1024
DEPTH = 3
SHARDS = 1 << DEPTH
SEED = 17
WORD = r"[^\x20\x09-\x0D]+"
#: Words of the mix in an output partition, about.
PART_WORDS = 1 << 23
#: Tries of a draw; each is accepted with a chance of about 0.7.
TRIES = 200
#: Primes whose product is above any number of blocks: one of them doesn't divide it.
PRIMES = (15485863, 1299709, 104729)


def running(rows: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sum of each of ``sums`` over all rows before, in the order of the columns."""
    rows = stored(rows.select("*", *[v.alias(k) for k, v in sums.items()]).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ranges")
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  #: one row a partition
    parts = rows.groupBy("part").agg(*[F.sum(k).alias(k) for k in sums])
    parts = parts.select("part", *[F.coalesce(F.sum(k).over(before), F.lit(0)).alias(f"{k}_offset") for k in sums])
    inside = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = rows.select("*", *[F.coalesce(F.sum(k).over(inside), F.lit(0)).alias(f"{k}_within") for k in sums])
    keep = [F.col(c) for c in rows.columns if c != "part" and c not in sums]
    return within.join(parts, "part").select(*keep, *[(F.col(f"{k}_offset") + F.col(f"{k}_within")).alias(k) for k in sums])


def _ln_factorial(x: str) -> str:
    """Stirling's series, eight steps further up."""
    z = f"(({x}) + 9D)"
    product = " * ".join(f"(({x}) + {k}D)" for k in range(1, 9))
    return f"(({z} - 0.5D) * ln({z}) - {z} + 0.918938533204672742D + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) + 1 / (1260 * {z} * {z} * {z} * {z} * {z}) - ln({product}))"


def hypergeometric(total: str, own: str, draws: str, seed: str) -> str:
    """SQL: how many of ``draws`` taken from ``total`` without replacement are among
    ``own``. Arrays of one element name what is used several times."""
    weight = lambda x: " + ".join(_ln_factorial(v) for v in (x, f"p.k - {x}", f"p.n - {x}", f"p.t - p.k - p.n + {x}"))
    uniform = lambda which: f"((cast(conv(substring(md5(concat_ws(':', {seed}, a, '{which}')), 1, 12), 16, 10) as double) + 0.5D) / {1 << 48}D)"
    parts = f"""named_struct('t', cast({total} as double), 'k', cast({own} as double), 'n', cast({draws} as double),
      'low', greatest(0D, cast({draws} as double) + {own} - {total}), 'high', cast(least({draws}, {own}) as double),
      'mode', cast(floor((cast({draws} as double) + 1) * (cast({own} as double) + 1) / (cast({total} as double) + 2)) as double))"""
    hat = f"""named_struct('middle', p.n * (p.k / p.t) + 0.5D,
      'width', 1.7155277699214135D * sqrt((p.t - p.n) * p.n * (p.k / p.t) * (1 - p.k / p.t) / greatest(p.t - 1, 1D) + 0.5D) + 0.8989161620588988D,
      'top', {weight("p.mode")})"""
    tries = f"transform(sequence(0, {TRIES - 1}), a -> transform(array({uniform(0)}), u -> named_struct('u', u, 'x', cast(floor(h.middle + h.width * ({uniform(1)} - 0.5D) / u) as double)))[0])"
    fine = f"filter(filter({tries}, c -> c.x >= p.low and c.x <= p.high), c -> 2 * ln(c.u) <= h.top - ({weight('c.x')}))"
    drawn = f"transform(array({hat}), h -> cast(coalesce(get({fine}, 0).x, p.mode) as bigint))[0]"
    return f"transform(array({parts}), p -> if(p.high <= p.low, cast(p.low as bigint), {drawn}))[0]"


def targets(sizes: DataFrame) -> DataFrame:
    """(key, source_size, rank, at, target, quota, blocks) of each source of (key, size)."""
    totals = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    out = running(totals, ["key"], {"rank": F.lit(1).cast("long"), "at": F.col("source_size")})
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    out = out.withColumn("weight", F.get(weights, (F.col("rank") % len(WEIGHTS)).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * MAX_REPEAT)
    out = out.withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    #: sources by how soon they are full: one is full if its share, were all before it full, is above its cap
    out = running(out, ["ratio", "rank"], {"cap_before": F.col("cap"), "weight_before": F.col("weight")})
    every = out.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = BUDGET * (every.words or 0), float(every.weight or 0)
    out = stored(out.withColumn("full", F.col("ratio") < (words - F.col("cap_before")) / (weight - F.col("weight_before"))), "full")
    full = out.where("full").agg(F.sum("cap").alias("cap"), F.sum("weight").alias("weight")).first()
    rest, left = words - float(full.cap or 0), weight - float(full.weight or 0)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight").cast("double") * (rest / left if left else 0.0))
    quota = F.least(F.floor(target + 0.5), F.col("cap"))
    return out.select("key", "source_size", "rank", "at", target.alias("target"), quota.alias("quota"), F.ceil(quota / BLOCK).alias("blocks"))


def shard_cuts(sources: DataFrame) -> DataFrame:
    """(rank, cuts): where each shard's run of a source's permuted blocks begins and
    ends. Ranges of sources are halved level by level; a row is a range and holds
    its blocks in each shard."""
    found = sources.agg(F.max("rank").alias("last"), F.sum("blocks").alias("blocks")).first()
    levels, total = int(found.last or 0).bit_length(), int(found.blocks or 0)
    sizes = [total * (h + 1) // SHARDS - total * h // SHARDS for h in range(SHARDS)]
    ranges = sources.sparkSession.range(1).select(F.col("id").alias("range"), F.array(*[F.lit(n).cast("long") for n in sizes]).alias("shards"))
    for level in range(levels):
        part = F.shiftright("rank", levels - level - 1)
        low = sources.where(part % 2 == 0).groupBy(F.shiftright("rank", levels - level).alias("low_of")).agg(F.sum("blocks").alias("low"))
        halved = ranges.join(low, ranges.range == low.low_of, "left").select("range", "shards", F.coalesce("low", F.lit(0)).alias("low"), F.lit(level).alias("level"))
        ranges = stored(halved.select(F.explode(F.expr(_HALVES)).alias("half")).select("half.*"), "split")
    sums = F.aggregate("shards", F.array(F.lit(0).cast("long")), lambda a, q: F.concat(a, F.array(F.element_at(a, -1) + q)))
    return ranges.join(sources, F.col("range") == F.col("rank")).select("rank", sums.alias("cuts"))


def _deeper(drawn: str, depth: int) -> str:
    """SQL: ``drawn``, the lower half's blocks in each of 2**depth groups of shards, for groups of half the size."""
    width = SHARDS >> depth
    total = lambda n: f"aggregate(slice(shards, i * {width} + 1, {n}), 0L, (s, x) -> s + x)"
    got = hypergeometric(total(width), total(width // 2), "n", f"concat_ws(':', {SEED}, level, range, {depth}, i)")
    return f"flatten(transform({drawn}, (n, i) -> transform(array({got}), g -> array(g, n - g))[0]))"


_DRAWN = "array(low)"
for _depth in range(DEPTH):
    _DRAWN = _deeper(_DRAWN, _depth)
#: SQL: both halves of a range, of the columns range, shards, low (blocks of its lower half) and level
_HALVES = f"""transform(array({_DRAWN}), d -> array(
    struct(range * 2 as range, d as shards), struct(range * 2 + 1 as range, zip_with(shards, d, (s, x) -> s - x) as shards)))[0]"""


def _permuted(block: Column, blocks: Column, rank: Column) -> Column:
    """The place of a block among its source's ``blocks`` in the order in which they are dealt."""
    prime = F.when(blocks % PRIMES[0] != 0, PRIMES[0]).when(blocks % PRIMES[1] != 0, PRIMES[1]).otherwise(PRIMES[2]).cast("long")
    return (block * prime + rank * 7919) % blocks


def _place(docs: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, source_size, target, order, the extra columns and rounds: for each
    of the two rounds its number, how many words are taken and the shard (null if none)."""
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t"))
    tie = F.xxhash64("text")
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), tie.cast("string"))))
    sized = stored(docs.select("doc_id", *extra, size.alias("size"), key.alias("key"), order.alias("order"), tie.alias("tie")), "sizes")
    sources = stored(targets(sized), "sources")
    plan = sources.join(shard_cuts(sources), "rank")
    line = running(sized, ["key", "order", "size", "tie", *extra], {"before": F.col("size")})
    line = line.join(plan, "key").withColumn("start", F.col("before") - F.col("at"))

    def round_(number: int) -> Column:
        start = F.col("start") + F.col("source_size") * number
        words = F.greatest(F.least(start + F.col("size"), F.col("quota")) - start, F.lit(0).cast("long"))
        at = _permuted(F.floor(start / BLOCK), F.col("blocks"), F.col("rank"))
        shard = F.when(words > 0, let(at, lambda at: F.size(F.filter("cuts", lambda c: c <= at)) - 1))
        return F.struct(F.lit(number).alias("number"), words.alias("words"), shard.alias("shard"))

    return line.select("doc_id", *extra, "size", "source_size", "target", "order", "tie", F.array(round_(0), round_(1)).alias("rounds"))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of each document, and the words taken
    in each round with the shard that they go to."""
    first, again = F.col("rounds")[0], F.col("rounds")[1]
    columns = [(first["words"] + again["words"]).alias("taken"), first["words"].alias("taken_first"), first["shard"].alias("shard_first"), again["words"].alias("taken_again"), again["shard"].alias("shard_again")]
    return finished(lambda: _place(docs).select("doc_id", "size", "source_size", "target", *columns), "mix")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix in the documents' own columns: a row for each time a document is
    taken, its text cut where the quota ends inside it. Output partitions hold
    parts of one shard each, in shuffled order."""
    return finished(lambda: _mixed_documents(docs), "mix")


def _mixed_documents(docs: DataFrame) -> DataFrame:
    #: the documents' columns are in one struct, so no name of theirs meets one used here
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    where = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
    #: a row is known by its place in a Parquet file; other tables are written first
    try:
        placed = row.select("row", *where) if "_metadata" not in (c.lower() for c in docs.columns) else None
    except AnalysisException:
        placed = None
    if placed is None:
        placed = stored(row, "rows").select("row", *where)
    plain = placed.select("row.doc_id", "row.source", "row.text", "file", F.col("at").alias("line"))
    taken = stored(
        _place(plain, ("file", "line")).select("file", F.col("line").alias("at"), "size", "order", "tie", F.explode("rounds").alias("taken")).where("taken.words > 0"), "taken"
    )
    words = taken.agg(F.sum("taken.words")).first()[0] or 0
    pieces = -(-words // (SHARDS * PART_WORDS)) or 1
    out = placed.join(taken, ["file", "at"])
    text = F.col("row.text")
    split = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])", -1)
    lead = F.when(text.rlike(r"^[\x20\x09-\x0D]"), 1).otherwise(0)
    cut = F.array_join(F.slice(split, 1, (F.col("taken.words") + lead).cast("int")), "")
    text = F.when(F.col("taken.words") < F.col("size"), cut).otherwise(text)
    draw = F.xxhash64(F.lit(SEED), "order", "tie", "taken.number", "file", "at")
    out = out.select("row", text.alias("text"), F.col("taken.shard").alias("shard"), draw.alias("draw"))
    part = F.col("shard") * pieces + F.pmod("draw", F.lit(pieces)).cast("int")
    out = out.repartitionById(SHARDS * pieces, part).sortWithinPartitions("shard", "draw")
    replaced = {"text": F.col("text"), "n_chars": F.length("text")}
    types = {f.name: f.dataType for f in docs.schema}
    return out.select(*[(replaced[c].cast(types[c]) if c in replaced else F.col("row")[c]).alias(c) for c in docs.columns])


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def _sql_ln_factorial(x: str) -> str:
    z = f"(({x}) + 9.0::DOUBLE)"
    product = " * ".join(f"(({x}) + {k}.0::DOUBLE)" for k in range(1, 9))
    return f"(({z} - 0.5) * ln({z}) - {z} + 0.918938533204672742::DOUBLE + 1 / (12 * {z}) - 1 / (360 * {z} * {z} * {z}) + 1 / (1260 * {z} * {z} * {z} * {z} * {z}) - ln({product}))"


def _sql_draw(total: str, own: str, draws: str, seed: str) -> str:
    """The draw in DuckDB: lists of one element name what is used several times."""
    weight = lambda x: " + ".join(_sql_ln_factorial(v) for v in (x, f"p.k - ({x})", f"p.n - ({x})", f"p.t - p.k - p.n + ({x})"))
    uniform = lambda which: f"((('0x' || substr(md5({seed} || ':' || a || ':{which}'), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0::DOUBLE)"
    tries = f"list_transform(range(0, {TRIES}), lambda a: {{'u': {uniform(0)}, 'x': floor(h.middle + h.width * ({uniform(1)} - 0.5) / {uniform(0)})}})"
    fine = f"list_filter(list_filter({tries}, lambda c: c.x >= p.low AND c.x <= p.high), lambda c: 2 * ln(c.u) <= h.top - ({weight('c.x')}))"
    hat = f"""{{'middle': p.n * (p.k / p.t) + 0.5::DOUBLE,
      'width': 1.7155277699214135::DOUBLE * sqrt((p.t - p.n) * p.n * (p.k / p.t) * (1 - p.k / p.t) / greatest(p.t - 1, 1.0::DOUBLE) + 0.5::DOUBLE) + 0.8989161620588988::DOUBLE,
      'top': {weight('p.mode')}}}"""
    parts = f"""{{'t': ({total})::DOUBLE, 'k': ({own})::DOUBLE, 'n': ({draws})::DOUBLE,
      'low': greatest(0.0::DOUBLE, ({draws})::DOUBLE + ({own}) - ({total})), 'high': least({draws}, {own})::DOUBLE,
      'mode': floor((({draws})::DOUBLE + 1) * (({own})::DOUBLE + 1) / (({total})::DOUBLE + 2))}}"""
    return f"""list_transform([{parts}], lambda p: CASE WHEN p.high <= p.low THEN p.low::BIGINT ELSE
      list_transform([{hat}], lambda h: coalesce(({fine})[1].x, p.mode)::BIGINT)[1] END)[1]"""


def _sql_deeper(drawn: str, depth: int) -> str:
    width = SHARDS >> depth
    total = lambda n: f"list_sum(shards[(i - 1) * {width} + 1 : (i - 1) * {width} + {n}])::BIGINT"
    seed = f"'{SEED}:' || level || ':' || range_ || ':{depth}:' || (i - 1)"
    got = _sql_draw(total(width), total(width // 2), "n", seed)
    return f"flatten(list_transform({drawn}, lambda n, i: list_transform([{got}], lambda g: [g, n - g])[1]))"


_SQL_DRAWN = "[low]"
for _depth in range(DEPTH):
    _SQL_DRAWN = _sql_deeper(_SQL_DRAWN, _depth)

OP10_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS ord
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, CASE rank % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight, CAST(source_size * {MAX_REPEAT} AS DOUBLE) AS cap FROM r),
o AS (SELECT *, cap / weight AS ratio,
        {BUDGET}::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS words, sum(weight) OVER () AS whole,
        coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
        coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w),
f AS (SELECT *, ratio < (words - cap_before) / (whole - weight_before) AS is_full FROM o),
g AS (SELECT *, words - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0) AS rest, whole - coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0) AS remaining FROM f),
t AS (SELECT source, rank, source_size, CASE WHEN is_full THEN cap ELSE weight * (rest / remaining) END AS target FROM g),
q AS (SELECT *, CAST(least(floor(target + 0.5), source_size * {MAX_REPEAT}) AS BIGINT) AS quota FROM t),
b AS MATERIALIZED (SELECT *, (quota + {BLOCK - 1}) // {BLOCK} AS blocks FROM q),
top AS (SELECT CAST(sum(blocks) AS BIGINT) AS total, CASE WHEN max(rank) = 0 THEN 0 ELSE CAST(floor(log2(max(rank))) AS INT) + 1 END AS levels FROM b),
tree AS (
  SELECT 0 AS level, 0::BIGINT AS range_, levels, list_transform(range(0, {SHARDS}), lambda h: total * (h + 1) // {SHARDS} - total * h // {SHARDS}) AS shards FROM top
  UNION ALL
  SELECT level + 1, range_ * 2 + side, levels, CASE side WHEN 0 THEN drawn ELSE list_transform(shards, lambda x, i: x - drawn[i]) END
  FROM (SELECT level, range_, levels, shards, {_SQL_DRAWN} AS drawn
        FROM (SELECT level, range_, levels, shards, coalesce((SELECT CAST(sum(blocks) AS BIGINT) FROM b WHERE b.rank >> (tree.levels - tree.level - 1) = tree.range_ * 2), 0) AS low
              FROM tree WHERE level < levels) l) x, (VALUES (0), (1)) v(side)),
dealt AS MATERIALIZED (SELECT b.*, list_transform(range(0, {SHARDS + 1}), lambda h: coalesce(list_sum(shards[1:h]), 0)::BIGINT) AS cuts FROM b JOIN tree ON tree.level = tree.levels AND tree.range_ = b.rank),
p AS (SELECT d.doc_id, d.size, k.source_size, k.target, k.quota, k.blocks, k.rank, k.cuts,
        CASE WHEN k.blocks % {PRIMES[0]} <> 0 THEN {PRIMES[0]} WHEN k.blocks % {PRIMES[1]} <> 0 THEN {PRIMES[1]} ELSE {PRIMES[2]} END AS prime,
        CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.ord, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
      FROM d JOIN dealt k ON d.source IS NOT DISTINCT FROM k.source),
n AS (SELECT *, greatest(least(start + size, quota) - start, 0) AS taken_first, greatest(least(start + source_size + size, quota) - start - source_size, 0) AS taken_again,
        ((start // {BLOCK}) * prime + rank * 7919) % blocks AS at_first, (((start + source_size) // {BLOCK}) * prime + rank * 7919) % blocks AS at_again FROM p)
SELECT doc_id, size, source_size, target, CAST(taken_first + taken_again AS BIGINT) AS taken,
  CAST(taken_first AS BIGINT) AS taken_first, CASE WHEN taken_first > 0 THEN CAST(len(list_filter(cuts, lambda c: c <= at_first)) - 1 AS INTEGER) END AS shard_first,
  CAST(taken_again AS BIGINT) AS taken_again, CASE WHEN taken_again > 0 THEN CAST(len(list_filter(cuts, lambda c: c <= at_again)) - 1 AS INTEGER) END AS shard_again
FROM n
"""
