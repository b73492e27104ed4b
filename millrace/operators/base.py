"""The registry of operations and how a flow is applied."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..functions.errors import OperationError

OPERATIONS: dict[str, Callable] = {}


@dataclass
class Context:
    """What operations need beside their input: named sources, limits, and how many loop passes were planned.

    Without a ``cross_join_limit`` cross joins have 50 000 000 rows at most, and loops pair as many only if they have more than
    ``loop_limit`` passes.
    """

    spark: SparkSession
    sources: Mapping[str, DataFrame | Callable[[], DataFrame]] = field(default_factory=dict)
    cross_join_limit: int | None = None
    pivot_limit: int = 500
    median_rows: int = 1_000_000
    loop_limit: int = 1_000
    loop_total: int = 100_000
    passes: int = 0

    def source(self, spec: Any) -> DataFrame:
        """A named source, a path, a DataFrame, or a sub-flow ``{"source": ..., "operations": [...]}``."""
        if isinstance(spec, DataFrame):
            return spec
        if isinstance(spec, Mapping) and ("source" in spec or "operations" in spec):
            return apply(self.source(needed(spec, "source")), spec.get("operations") or [], self)
        if isinstance(spec, Mapping) and "path" in spec:
            from ..sources.files import read_parquet

            return read_parquet(self.spark, spec["path"])
        if spec not in self.sources:
            raise OperationError(f"unknown source {spec!r}")
        found = self.sources[spec]
        return found if isinstance(found, DataFrame) else found()


def register(name: str) -> Callable:
    """Add an operation ``(df, params, context) -> df`` under a name."""

    def put(f: Callable) -> Callable:
        OPERATIONS[name] = f
        return f

    return put


def apply(df: DataFrame, steps: Sequence[Mapping], context: Context | None = None) -> DataFrame:
    """Apply the steps one after the other. Nothing runs: the result is a plan (guards that count rows excepted)."""
    context = context or Context(df.sparkSession)
    for position, step in enumerate(steps, 1):
        kind = step.get("type")
        if kind not in OPERATIONS:
            raise OperationError(f"unknown operation; known: {', '.join(sorted(OPERATIONS))}", str(kind), position)
        try:
            df = OPERATIONS[kind](df, step.get("params") or {}, context)
        except OperationError as e:
            raise type(e)(e.reason if e.kind is None else str(e), kind, position) from e
        except PySparkException as e:
            raise OperationError(str(e).splitlines()[0], kind, position) from e
    return df


def needed(params: Mapping, key: str) -> Any:
    """A parameter that must be there and not be empty."""
    value = params.get(key)
    if value is None or (hasattr(value, "__len__") and not isinstance(value, DataFrame) and len(value) == 0):
        raise OperationError(f"parameter {key!r} is missing")
    return value


def listed(value: Any) -> list:
    return [value] if isinstance(value, str) else list(value)


def existing(df: DataFrame, names: Sequence[str]) -> list[str]:
    """The names, all of which must be columns."""
    if missing := [n for n in names if n not in df.columns]:
        raise OperationError(f"unknown column {', '.join(map(repr, missing))}; known: {', '.join(df.columns)}")
    return list(names)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have."""
    while name in df.columns:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
