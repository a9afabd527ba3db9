"""Buckets of a metric that lie far from what was normal before."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WARM_UP, THRESHOLD = 4, 3.0


def buckets(df: DataFrame, time: str, span: str, metric: str, field: str | None = None, by: list[str] | None = None) -> DataFrame:
    """The metric (count, mean, min, max, sum) of every bucket of ``span`` that has rows."""
    f = {"count": lambda c: F.count("*").cast("double"), "mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum}[metric]
    v = f(F.col(field)) if field else F.count("*").cast("double")
    w = F.window(F.col(time), span)["start"]
    return df.where(F.col(time).isNotNull()).groupBy(*(by or []), w.cast("timestamp_ntz").alias("bucket")).agg(v.cast("double").alias("value"))


def fold(values: np.ndarray, warm_up: int = WARM_UP, threshold: float = THRESHOLD) -> pd.DataFrame:
    """Each value against the mean and population deviation of the earlier normal ones; flagged ones don't join them.

    With a deviation of 0 any other value is infinitely far; a value equal to the mean is at 0.
    """
    n, mean, m2 = 0, 0.0, 0.0
    out = []
    for x in values:
        if n < warm_up:
            z, flag, exp, sd = None, False, None, None
        else:
            sd = (m2 / n) ** 0.5
            exp = mean
            z = (x - mean) / sd if sd > 0 else 0.0 if x == mean else float("inf") if x > mean else float("-inf")
            flag = abs(z) > threshold
        out.append((exp, sd, z, 0.0 if z is None else 100 * (1 - 2 ** (-abs(z) / threshold)), flag))
        if not flag:
            n += 1
            d = x - mean
            mean += d / n
            m2 += d * (x - mean)
    return pd.DataFrame(out, columns=["expected", "std", "z", "score", "anomaly"])


def score(table: DataFrame, by: list[str] | None = None, warm_up: int = WARM_UP, threshold: float = THRESHOLD) -> DataFrame:
    """Scores of bucketed series. The fold is sequential by definition; its input is one row per bucket, not the raw rows."""
    keys = list(by or [])
    schema = ", ".join([f"`{k}` {table.schema[k].dataType.simpleString()}" for k in keys] + ["bucket timestamp_ntz, value double, expected double, std double, z double, score double, anomaly boolean"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["value"]).sort_values("bucket").reset_index(drop=True)
        return pd.concat([pdf[[*keys, "bucket", "value"]], fold(pdf["value"].to_numpy(), warm_up, threshold)], axis=1)

    return table.groupBy(*(keys or [F.lit("all").alias("__all")])).applyInPandas(run, schema)
