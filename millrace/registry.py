"""All queries of the library with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .queries import ORACLES, QUERIES, analysis, flows, outcomes, skewed, storage  # noqa: F401  (importing registers)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flagship"](spark, sf_dir)
