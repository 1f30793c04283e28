"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from weftline.functions.expr import DUCK, SPARK
from weftline.plans import frames, handwritten, relational


def _run(name: str):
    def run(spark, sf_dir):
        return spark.sql(relational.render(name, SPARK, sf_dir))

    run.__name__ = name
    return run


#: SQL of less than the whole query, under a name that says so
RENAMED = {"retrieve_all_channels": "retrieve_two_channels_ascii"}


def _sql_name(name: str) -> str:
    """Of a query that SQL has for ASCII records only."""
    return f"{name}_ascii" if name in frames.WHOLE else RENAMED.get(name, name)


def queries() -> dict:
    return {_sql_name(name): _run(name) for name in relational.QUERIES} | frames.QUERIES | handwritten.QUERIES


def oracle_sql() -> dict[str, str]:
    return {_sql_name(name): relational.render(name, DUCK) for name in relational.QUERIES} | handwritten.ORACLE
