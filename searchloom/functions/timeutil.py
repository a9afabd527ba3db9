"""Times as microseconds since the epoch, whatever the kind of timestamp column and the session's zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds of a timestamp column; one without a zone means UTC."""
    kind = next(f.dataType for f in df.schema.fields if f.name == name)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`)")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(F.col(f"`{name}`"))
    raise TypeError(f"{name} is no timestamp: {kind.simpleString()}")


def floor_div(a: Column, b: Column) -> Column:
    """Integer division that rounds down, also below zero, without going through floating point."""
    return F.call_function("div", a - F.pmod(a, b), b)
