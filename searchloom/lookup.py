"""Joins of a large table with a lookup table whose size is not known in advance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows up to which a lookup table is sent to every executor.
BROADCAST_ROWS = 50_000
#: Parts into which each key's rows are spread when the lookup table is too large to send.
SALT = 32


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def lookup_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join ``big`` with ``small`` (unique ``keys``), safe when one key holds a large share of ``big``.

    The lookup is counted first. Up to ``rows`` rows it is broadcast and ``big`` isn't shuffled. Beyond that the
    rows of each key are spread over ``SALT`` parts and the lookup is repeated once per part. Spark's estimate of sizes
    leaves that repetition out, so the join is told to sort: else a lookup under ``spark.sql.autoBroadcastJoinThreshold``
    would be sent to the driver ``SALT`` times as large. A null key matches nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"lookup_join does inner and left joins, not {how}")
    if is_small(small, rows):
        return big.join(F.broadcast(small), keys, how)
    salted = big.withColumn("__salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(SALT)))
    spread = small.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALT - 1).cast("bigint"))))
    return salted.join(spread.hint("merge"), [*keys, "__salt"], how).drop("__salt")
