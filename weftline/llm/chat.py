"""Chat formatting: tool calls linked with results, ordered, validated, in canonical JSON.

Only SQL functions. A message is JSON text with ``tool_calls`` (of an assistant:
id, name, arguments) or with ``tool_call_id`` (of a tool), or else plain text.

- Calls and results are joined by conversation and identifier; a result links to
  the call if that doesn't come later. Of calls that share an identifier the
  first counts, by turn and place.
- A call depends on the calls whose ids its arguments hold as {"$ref": id}. Its
  depth is one more than the deepest of them, so depth is a topological order;
  a message's calls are written in it (of equal depth, by place). Runs of calls
  with one reference each are crossed by pointer doubling (a chain of n calls
  takes log n rounds); those with several are then settled level by level.
  Calls that refer to one that isn't there, or lead to such a one or into a cycle,
  have depth -1 and come last.
- Arguments are valid if the tool is known, required ones are there and each has
  its type (variant schema names, e.g. STRING, BIGINT).
- Canonical JSON has keys in order, no white space, and arguments as an object.

Results are one row a message, so no conversation is gathered in one place.

Defined results: null text is null content; JSON that doesn't parse, or has
another shape, is plain text. Repeated rows keep a row each; a null conv_id
links with nothing. Other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.storage import stored, table

#: Tools: argument -> (type, required).
SCHEMAS = {
    "search": {"query": ("STRING", True), "limit": ("BIGINT", False)},
    "calculator": {"expression": ("STRING", True)},
    "weather": {"city": ("STRING", True), "days": ("BIGINT", False), "metric": ("BOOLEAN", False)},
    "lookup": {"key": ("STRING", True)},
}
_KEYS = ["conv_id", "turn", "mark"]


def _json_string(text: Column) -> Column:
    """A string as JSON; null for null."""
    whole = F.to_json(F.struct(text.alias("x")))
    return F.when(text.isNotNull(), F.substring(whole, F.lit(6), F.length(whole) - 6))


def valid_arguments(name: Column, arguments: Column, schemas=None) -> Column:
    """Whether a variant of arguments fits the tool's schema."""
    out = F.lit(False)
    for tool, fields in (SCHEMAS if schemas is None else schemas).items():
        ok = F.schema_of_variant(arguments).startswith("OBJECT")
        for field, (kind, required) in fields.items():
            value = F.try_variant_get(arguments, f"$['{field}']", "variant")
            missing = value.isNull()
            ok = ok & F.when(missing, F.lit(not required)).otherwise(F.schema_of_variant(value) == kind)
        out = F.when(name == tool, ok).otherwise(out)
    return F.coalesce(out, F.lit(False))


def _parsed(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, mark, and the message's JSON or null."""
    looks = F.col("role").isin("assistant", "tool") & F.col("text").rlike(r"^\s*\{")
    value = F.when(looks, F.try_parse_json("text"))
    return conversations.select("conv_id", "turn", "role", "text", value.alias("v")).select(
        "*",
        F.when(F.col("role") == "assistant", F.try_variant_get("v", "$.tool_calls", "array<variant>")).alias("raw_calls"),
        F.when(F.col("role") == "tool", F.try_variant_get("v", "$.tool_call_id", "string")).alias("result_of"),
        F.xxhash64("text").alias("mark"),
    )


def _calls(special: DataFrame) -> DataFrame:
    """A row a call: its message's keys, place, id, name, arguments, refs."""
    each = special.where("raw_calls is not null").select(*_KEYS, F.posexplode("raw_calls").alias("place", "c"))
    given = F.try_variant_get("c", "$.arguments", "variant")
    text = F.try_variant_get("c", "$.arguments", "string")
    own = F.when(F.schema_of_variant(given) == "STRING", F.try_parse_json(text)).otherwise(given)
    each = each.select(*_KEYS, "place", F.try_variant_get("c", "$.id", "string").alias("id"), F.try_variant_get("c", "$.name", "string").alias("name"), own.alias("arguments"))
    json = F.coalesce(F.to_json("arguments"), F.lit("null"))
    refs = F.array_distinct(F.regexp_extract_all(json, F.lit(r'\{"\$ref":"([^"]+)"\}'), F.lit(1)))
    return each.select(*_KEYS, "place", "id", "name", json.alias("json"), valid_arguments(F.col("name"), F.col("arguments")).alias("valid"), refs.alias("refs"))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, id, depth) of each call id; -1 where there is none."""
    key = ["conv_id", "id"]
    first = F.min_by(F.struct("refs"), F.struct("turn", "place")).alias("f")
    nodes = calls.where("id is not null and conv_id is not null").groupBy(*key).agg(first).select(*key, "f.refs")
    nodes = stored(nodes.select(*key, "refs", F.size("refs").alias("n")), "calls")
    runs = _runs(nodes)
    #: what a call rests on: itself if it has no reference or several, else the end of its run
    rests = stored(nodes.where("n <> 1").select(*key, F.col("id").alias("base"), F.lit(0).cast("long").alias("steps")).union(runs), "rests")
    edges = nodes.where("n > 1").select("conv_id", "id", "n", F.explode("refs").alias("ref"))
    edges = edges.join(rests.select("conv_id", F.col("id").alias("ref"), "base", "steps"), ["conv_id", "ref"])
    waiting = stored(edges.select(*key, "n", "base", "steps"), "waiting")
    done = stored(nodes.where("n = 0").select("conv_id", F.col("id").alias("base"), F.lit(0).cast("long").alias("depth")), "done")
    latest = done
    while not waiting.isEmpty():
        ready = waiting.join(done, ["conv_id", "base"]).groupBy(*key, "n").agg(F.count("*").alias("known"), F.max(F.col("depth") + F.col("steps") + 1).alias("depth"))
        latest = stored(ready.where("known = n").select("conv_id", F.col("id").alias("base"), "depth"), "ready")
        if latest.isEmpty():
            break
        done = stored(done.union(latest), "done")
        waiting = stored(waiting.join(latest.select("conv_id", F.col("base").alias("id")), key, "left_anti"), "waiting")
    known = rests.join(done, ["conv_id", "base"]).select(*key, (F.col("depth") + F.col("steps")).cast("int").alias("depth"))
    return nodes.select(*key).join(known, key, "left").select(*key, F.coalesce("depth", F.lit(-1)).alias("depth"))


def _runs(nodes: DataFrame) -> DataFrame:
    """(conv_id, id, base, steps) of the calls with one reference: the first call
    with none or several that following references leads to, and how many lead
    there. Calls that get into a cycle, or to one that isn't there, are left out."""
    one = nodes.where("n = 1").select("conv_id", "id", F.col("refs")[0].alias("base"), F.lit(1).cast("long").alias("steps"))
    pointers, rounds = stored(one, "runs"), nodes.count().bit_length()
    for _ in range(rounds):
        on = pointers.select("conv_id", F.col("id").alias("base"), F.col("base").alias("next"), F.col("steps").alias("more"))
        pointers = stored(
            pointers.join(on, ["conv_id", "base"], "left").select("conv_id", "id", F.coalesce("next", "base").alias("base"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")), "runs"
        )
        moved = pointers.where("moved")
        pointers = pointers.drop("moved")
        if moved.isEmpty():
            break
    return pointers.join(nodes.where("n <> 1").select("conv_id", F.col("id").alias("base")), ["conv_id", "base"], "left_semi").select("conv_id", "id", "base", "steps")


def link(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, n_calls, n_valid, n_answered, linked, depth, message_json."""
    parsed = _parsed(conversations)
    plain = parsed.where("raw_calls is null and result_of is null").select(
        "conv_id", "turn", "role", *[F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_valid", "n_answered")],
        F.lit(None).cast("boolean").alias("linked"), F.lit(0).alias("depth"),
        F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"}).alias("message_json"),
    )
    special = parsed.where("raw_calls is not null or result_of is not null")
    content = F.when(F.try_variant_get("v", "$.content", "variant").isNull(), F.lit("null")).otherwise(F.coalesce(F.to_json(F.try_variant_get("v", "$.content", "variant")), F.lit("null")))
    special = stored(special.select("conv_id", "turn", "role", "mark", "raw_calls", "result_of", content.alias("content")), "tools")
    if special.isEmpty():
        return plain
    calls = stored(_calls(special), "calls")
    known = depths(calls)
    ids = calls.where("id is not null").groupBy("conv_id", "id").agg(F.min("turn").alias("call_turn"))
    results = special.where("result_of is not null").select(*_KEYS, F.col("result_of").alias("id"))
    joined = results.join(ids, ["conv_id", "id"], "left").join(known, ["conv_id", "id"], "left")
    of_result = joined.select(*_KEYS, "id", F.coalesce(F.col("turn") >= F.col("call_turn"), F.lit(False)).alias("linked"), "depth").distinct()
    answered = of_result.where("linked").select("conv_id", "id", F.lit(1).alias("answered")).distinct()
    each = calls.join(answered, ["conv_id", "id"], "left").join(known, ["conv_id", "id"], "left").distinct().withColumn("depth", F.coalesce("depth", F.lit(0)))
    item = F.concat(F.lit('{"arguments":'), "json", F.lit(',"id":'), F.coalesce(_json_string(F.col("id")), F.lit("null")), F.lit(',"name":'), F.coalesce(_json_string(F.col("name")), F.lit("null")), F.lit("}"))
    of_call = each.groupBy(*_KEYS).agg(
        F.count("*").alias("n_calls"), F.count_if("valid").alias("n_valid"), F.count("answered").alias("n_answered"),
        F.max(F.coalesce("depth", F.lit(0))).alias("depth"), F.array_sort(F.collect_list(F.struct((F.col("depth") < 0).alias("last"), F.col("depth").alias("after"), "place", item.alias("item")))).alias("items"),
    )
    def same(right: DataFrame):
        """The messages beside what their keys have; the conversation may be null."""
        r = right.select(*[F.col(c).alias(f"_{c}") if c in _KEYS else F.col(c) for c in right.columns])
        on = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("turn").eqNullSafe(F.col("_turn")) & F.col("mark").eqNullSafe(F.col("_mark"))
        return r, on

    right, on = same(of_call)
    with_calls = special.where("raw_calls is not null").join(right, on, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    with_calls = with_calls.select(
        "conv_id", "turn", "role", zero("n_calls"), zero("n_valid"), zero("n_answered"), F.lit(None).cast("boolean").alias("linked"), F.coalesce("depth", F.lit(0)).alias("depth"),
        F.concat(F.lit('{"content":'), "content", F.lit(',"role":"assistant","tool_calls":['), F.coalesce(F.array_join("items.item", ","), F.lit("")), F.lit("]}")).alias("message_json"),
    )
    right, on = same(of_result.withColumnRenamed("id", "_id"))
    with_result = special.where("result_of is not null").join(right, on & (F.col("result_of") == F.col("_id")), "left").select(
        "conv_id", "turn", "role", *[F.lit(0).cast("long").alias(c) for c in ("n_calls", "n_valid", "n_answered")], F.coalesce("linked", F.lit(False)).alias("linked"),
        F.coalesce("depth", F.lit(-1)).alias("depth"),
        F.concat(F.lit('{"content":'), "content", F.lit(',"role":"tool","tool_call_id":'), _json_string(F.col("result_of")), F.lit("}")).alias("message_json"),
    )
    return plain.unionByName(with_calls).unionByName(with_result)


def op6_chat(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "conversations"))


#: For tables whose messages are plain text, as the given ones.
OP6_SQL = """
SELECT conv_id, turn, role, 0::BIGINT AS n_calls, 0::BIGINT AS n_valid, 0::BIGINT AS n_answered, NULL::BOOLEAN AS linked, 0::INTEGER AS depth,
  '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS message_json
FROM conversations
WHERE NOT coalesce(role IN ('assistant', 'tool') AND regexp_matches(text, '^\\s*\\{'), false)
"""
