"""Queries register here with the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name; without SQL it is tested against a plain version instead."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


def values(rows: list[tuple], columns: list[str]) -> str:
    """A VALUES list as a derived table of text, number and boolean columns."""
    one = lambda v: quoted(v) if v is None or isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return "(VALUES " + ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows) + f") AS v({', '.join(columns)})"


def planted(spark: SparkSession, sf_dir: str, cases: list[tuple], schema: str) -> DataFrame:
    """Every document with one of the cases, in turn by doc_id."""
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"case_ bigint, {schema}")
    return table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % len(cases)).alias("case_")).join(F.broadcast(rows), "case_").drop("case_")  # a list in this file


def planted_sql(cases: list[tuple], columns: list[str]) -> str:
    return f"(SELECT doc_id, {', '.join(columns)} FROM documents JOIN {values([(k, *c) for k, c in enumerate(cases)], ['case_', *columns])} ON doc_id % {len(cases)} = case_)"
