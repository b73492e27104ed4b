"""Type names of the operations, and what two types have in common."""

from __future__ import annotations

from pyspark.sql import types as T

from .errors import OperationError

#: The names a user may write, in any case.
NAMES = {
    "int": T.LongType(), "int64": T.LongType(), "int32": T.IntegerType(),
    "float": T.DoubleType(), "float64": T.DoubleType(), "float32": T.FloatType(),
    "str": T.StringType(), "string": T.StringType(), "utf8": T.StringType(),
    "bool": T.BooleanType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(),
}
_WIDTH = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 3, T.LongType: 4, T.FloatType: 5, T.DoubleType: 6}


def type_of(name: str) -> T.DataType:
    """The Spark type of a type name."""
    try:
        return NAMES[name.lower()]
    except (KeyError, AttributeError):
        raise OperationError(f"unknown type {name!r}; known: {', '.join(NAMES)}") from None


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type both can be held in: wider numbers, strings beside anything, timestamps beside dates."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if type(a) in _WIDTH and type(b) in _WIDTH:
        wide = max(a, b, key=lambda t: _WIDTH[type(t)])
        return T.DoubleType() if isinstance(wide, T.FloatType) and T.LongType() in (a, b) else wide
    if isinstance(a, T.DecimalType) and isinstance(b, T.DecimalType):
        scale = max(a.scale, b.scale)
        return T.DecimalType(min(38, scale + max(a.precision - a.scale, b.precision - b.scale)), scale)
    for x, y in ((a, b), (b, a)):
        if isinstance(x, T.DecimalType) and type(y) in _WIDTH:
            return T.DoubleType() if isinstance(y, (T.FloatType, T.DoubleType)) else T.DecimalType(min(38, max(19, x.precision - x.scale) + x.scale), x.scale)
        if isinstance(x, (T.TimestampType, T.TimestampNTZType)) and isinstance(y, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return x if isinstance(y, T.DateType) else T.TimestampType()
    raise OperationError(f"types {a.simpleString()} and {b.simpleString()} have no common type")
