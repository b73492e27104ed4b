"""Reading files and normalising them to Parquet."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import OperationError, SourceNotFound
from ..functions.types import type_of
from ..operators.base import quoted
from .delimited import read_delimited

#: Formats by file extension.
FORMATS = {
    ".csv": "csv", ".txt": "csv", ".tsv": "tsv", ".json": "json", ".ndjson": "ndjson", ".jsonl": "ndjson",
    ".xlsx": "excel", ".xls": "excel", ".parquet": "parquet", ".pq": "parquet",
}


def format_of(name: str) -> str:
    """The format a file name's extension stands for."""
    lower = name.lower()
    for extension, kind in FORMATS.items():
        if lower.endswith(extension):
            return kind
    raise OperationError(f"unknown file format of {name!r}; known: {', '.join(FORMATS)}")


def _found(read, path) -> DataFrame:
    try:
        return read(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "Path does not exist" in str(e):
            raise SourceNotFound(f"source not found: {path}") from e
        raise


def overridden(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns cast to the given types; unknown names are an error, values that don't convert become null."""
    if missing := [c for c in types if c not in df.columns]:
        raise OperationError(f"unknown column {missing[0]!r}")
    return df.withColumns({c: F.col(quoted(c)).try_cast(type_of(t)) for c, t in types.items()})


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return _found(spark.read.parquet, path)


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """CSV files; for the options see ``read_delimited``."""
    return _found(lambda p: read_delimited(spark, p, **options), path)


def read_tsv(spark: SparkSession, path: str, **options) -> DataFrame:
    return read_csv(spark, path, **{**options, "separator": "\t"})


def read_ndjson(spark: SparkSession, path: str, sampling_ratio: float = 1.0, types: Mapping[str, str] | None = None) -> DataFrame:
    """One JSON object a line."""
    return overridden(_found(spark.read.option("samplingRatio", sampling_ratio).json, path), types or {})


def read_json(spark: SparkSession, path: str, types: Mapping[str, str] | None = None) -> DataFrame:
    """Files that hold a JSON array each; parallel across files only."""
    return overridden(_found(spark.read.option("multiLine", True).json, path), types or {})


def read_any(spark: SparkSession, path: str, **options) -> DataFrame:
    """A file or folder by the format its name stands for."""
    from .workbooks import read_workbooks

    if path.lower().endswith(".xls"):
        raise OperationError("workbooks of the old binary format can't be read; save them as .xlsx")
    readers = {"csv": read_csv, "tsv": read_tsv, "json": read_json, "ndjson": read_ndjson, "parquet": read_parquet, "excel": read_workbooks}
    return readers[format_of(path)](spark, path, **options)


def normalise(df: DataFrame, path: str) -> tuple[int, list[tuple[str, str]]]:
    """Write a Parquet dataset; returns rows (counted during the write) and columns."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").option("compression", "zstd").parquet(path)
    return seen.get["rows"], df.dtypes
