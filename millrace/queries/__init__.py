"""Registered queries: each runs operations of the library over whole tables, beside SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..operators import Context, apply

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def query(name: str, sql: str | None) -> Callable:
    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def context(spark: SparkSession, sf_dir: str) -> Context:
    return Context(spark, {t: (lambda t=t: table(spark, sf_dir, t)) for t in TABLES})


def flow(name: str, source: str, steps: list[dict] | Callable[[], list[dict]], sql: str | None) -> None:
    """Register a flow of operations over a table."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return apply(table(spark, sf_dir, source), steps, context(spark, sf_dir))

    query(name, sql)(run)


def step(kind: str, **params) -> dict:
    return {"type": kind, "params": params}
