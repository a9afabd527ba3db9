"""Exact percentiles by rank, without holding a large group's values in one place.

Where no group has more than ``BUFFER`` different values, about, each group's counts are held in one buffer. Else values are counted, and the counts are laid out in ranges of (group, value). A sum per range tells in which range each
wanted rank lies; only those ranges are looked into, and a window sorts the distinct values of one range at most. So a
group of any size is spread over many tasks, and the result is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.scratch import materialize

#: Different values of a group that one aggregation buffer may hold.
BUFFER = 500_000


def same_keys(a: DataFrame, b: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys that may be null; the keys come out once. ``b`` has one row per key, or one in all without keys."""
    if not keys:
        return a.crossJoin(F.broadcast(b))
    renamed = b
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"__key{i}")
    on = [F.col(f"`{k}`").eqNullSafe(F.col(f"__key{i}")) for i, k in enumerate(keys)]
    return a.join(renamed, on, how).drop(*[f"__key{i}" for i in range(len(keys))])


def exact_quantiles(values: DataFrame, keys: list[str], shares: list[float]) -> DataFrame:
    """``keys`` and ``__q``, an array with the quantile at each share (0 to 1), interpolated between the two nearest ranks.

    ``values`` has ``keys``, ``__v`` (null is left out) and ``__n``, how often the value occurs. A group without values gives no row.
    """
    values = values.where("__v is not null")
    most = values.groupBy(*keys).agg(F.approx_count_distinct("__v").alias("__d")).agg(F.max("__d")).first()[0] or 0
    if most <= BUFFER:
        return values.groupBy(*keys).agg(F.percentile("__v", F.array(*[F.lit(float(q)) for q in shares]), F.col("__n")).alias("__q"))
    counts = values.groupBy(*keys, "__v").agg(F.sum("__n").alias("__n"))
    ranges = counts.repartitionByRange(*keys, "__v").withColumn("__part", F.spark_partition_id())
    ranges = materialize(ranges, "quantiles")  # ranges are drawn from a sample, so they are drawn once
    w = Window.partitionBy(*keys)  # one row per range
    sums = ranges.groupBy(*keys, "__part").agg(F.sum("__n").alias("__s"))
    sums = sums.withColumns({"__upto": F.sum("__s").over(w.orderBy("__part")), "__all": F.sum("__s").over(w)})
    place = lambda q: F.lit(float(q)) * (F.col("__all") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(q)), F.ceil(place(q))) for q in shares])))
    start = F.col("__upto") - F.col("__s")
    picks = sums.select(*keys, "__part", "__all", start.alias("__base"), F.filter(ranks, lambda r: (r >= start) & (r < F.col("__upto"))).alias("__ranks")).where(F.size("__ranks") > 0)
    inside = same_keys(ranges, picks, [*keys, "__part"], "inner")
    upto = F.col("__base") + F.sum("__n").over(Window.partitionBy(*keys, "__part").orderBy("__v"))
    hit = inside.withColumn("__end", upto).select(*keys, "__all", "__v", F.explode(F.filter("__ranks", lambda r: (r >= F.col("__end") - F.col("__n")) & (r < F.col("__end")))).alias("__r"))
    found = hit.groupBy(*keys).agg(F.first("__all").alias("__all"), F.map_from_entries(F.collect_list(F.struct("__r", "__v"))).alias("__m"))

    def value(q: float) -> Column:
        lo, hi = F.floor(place(q)), F.ceil(place(q))
        a, b = F.element_at("__m", lo), F.element_at("__m", hi)
        return F.when((lo == hi) | (a == b), a).otherwise((hi - place(q)) * a + (place(q) - lo) * b)

    return found.select(*keys, F.array(*[value(q) for q in shares]).alias("__q"))
