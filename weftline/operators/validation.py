"""Checks of result files and tables: findings as rows, or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.files import candidate_source

CANDIDATES = ("source1_entity_id", "candidate_entity_ids")
MATCHES = ("source1_entity_id", "matched_entity_ids")


def header_fault(spark: SparkSession, path: str, expected: tuple[str, ...] = CANDIDATES) -> str | None:
    """What is wrong with the first line: no file content, commas for tabs, other columns; null if nothing."""
    first = spark.read.text(path).first()
    if first is None:
        return "empty"
    line = first[0]
    if "\t" not in line and "," in line:
        return "comma separated"
    columns = [c.strip().lower() for c in line.split("\t")]
    return None if columns == list(expected) else f"unexpected header {columns}"


def parsed(spark: SparkSession, path: str) -> DataFrame:
    """(line, s1_id, ids) of the lines after the header; s1_id is null where a line has no tab."""
    lines = spark.read.text(path).where("value <> '' and value not like 'source1_entity_id%'")
    tab = F.instr("value", "\t")
    ids = F.substring("value", tab + 1, F.length("value"))
    items = F.when(F.trim(ids) == "", F.array().cast("array<string>")).otherwise(F.split(ids, ","))
    return lines.select(F.col("value").alias("line"), F.when(tab > 0, F.substring("value", F.lit(1), tab - 1)).alias("s1_id"), F.when(tab > 0, items).alias("ids"))


def findings(spark: SparkSession, path: str, required: DataFrame, known: DataFrame | None = None, expected: tuple[str, ...] = MATCHES) -> DataFrame:
    """(fault, n) of a result file against the records it needs (entity_id) and,
    if given, the ids it may name (entity_id). A broken header stops the rest."""
    schema = "fault string, n long"
    if fault := header_fault(spark, path, expected):
        return spark.createDataFrame([(f"header: {fault}", 1)], schema)
    rows = parsed(spark, path)
    good = rows.where("s1_id is not null")
    items = good.select("s1_id", F.explode("ids").alias("id"))
    s1 = required.select(F.col("entity_id").alias("s1_id"))
    faults = {
        "malformed row": rows.where("s1_id is null and trim(line) <> ''"),
        "duplicate row": good.groupBy("s1_id").count().where("count > 1"),
        "duplicate id in a list": good.where(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1_id").distinct(),
        "self match": items.where("id like 'S1-%'").select("id").distinct(),
        "wrong prefix": items.where("id not like 'S1-%' and id not like 'S2-%' and id not like 'S3-%'").select("id").distinct(),
        "missing record": s1.join(good, "s1_id", "left_anti"),
        "extra record": good.select("s1_id").distinct().join(s1, "s1_id", "left_anti"),
    }
    if known is not None:
        ours = items.where("id like 'S2-%' or id like 'S3-%'").select("id").distinct()
        faults["unknown id"] = ours.join(known.select(F.col("entity_id").alias("id")), "id", "left_anti")
    out = None
    for name, df in faults.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("fault"), "n").where("n > 0")
        out = one if out is None else out.union(one)
    return out


def outside_candidates(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matches (s1_id, cand_id) that aren't among the candidates: a warning, not a fault."""
    return matches.join(candidates, ["s1_id", "cand_id"], "left_anti")


def check_candidates(spark: SparkSession, path: str, expected: DataFrame | None = None) -> dict:
    """Counts of a candidate file; ValueError on a broken header, an empty or
    repeated record, a repeated id in a list, an id of no candidate source, or, if
    the records it needs are given, a missing or extra one."""
    if fault := header_fault(spark, path):
        raise ValueError(f"bad header: {fault}")
    rows = parsed(spark, path).select("line", F.trim("s1_id").alias("s1_id"), F.filter(F.transform("ids", lambda x: F.trim(x)), lambda x: x != "").alias("ids"))

    def refuse(bad: DataFrame, what: str, column: str = "s1_id") -> None:
        some = [r[0] for r in bad.select(column).limit(5).collect()]
        if some:
            raise ValueError(f"{what}: {some}")

    refuse(rows.where("coalesce(s1_id, '') = ''"), "empty source1_entity_id", "line")
    refuse(rows.groupBy("s1_id").count().where("count > 1"), "duplicate source1_entity_id")
    refuse(rows.where(F.size("ids") != F.size(F.array_distinct("ids"))), "duplicate candidate ids")
    refuse(rows.select(F.explode("ids").alias("id")).where("id not like 'S2-%' and id not like 'S3-%'"), "no candidate source", "id")
    if expected is not None:
        wanted = expected.select(F.col("entity_id").alias("s1_id"))
        refuse(wanted.join(rows, "s1_id", "left_anti"), "missing ids")
        refuse(rows.join(wanted, "s1_id", "left_anti"), "unexpected extra ids")
    found = rows.agg(F.count("*").alias("s1_rows"), F.coalesce(F.sum(F.size("ids")), F.lit(0)).alias("total_candidate_ids")).first()
    return {"path": path, **found.asDict(), "ok": True}


def merged(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with its one row of ``right`` each; ValueError if a key of ``right`` is
    repeated or one of ``left`` has no row there."""
    if not right.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} isn't unique on the right side")
    if not left.join(right, key, "left_anti").isEmpty():
        raise ValueError(f"some {key} of the left side isn't there")
    return left.join(right, key)


def same_candidates(left: DataFrame, right: DataFrame) -> bool:
    """Whether two retrievals (s1_id, cand_id) give equal sets."""
    one, other = (df.select("s1_id", "cand_id").distinct() for df in (left, right))
    return one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


__all__ = ["CANDIDATES", "MATCHES", "candidate_source", "check_candidates", "findings", "header_fault", "merged", "outside_candidates", "same_candidates"]
