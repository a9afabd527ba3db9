"""Aggregations over buckets: siblings reduce a table of buckets, parents add to its rows in the order of the last key."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions.script import compile_script

SIBLINGS = "avg_bucket sum_bucket min_bucket max_bucket stats_bucket extended_stats_bucket percentiles_bucket".split()
PARENTS = "derivative cumulative_sum serial_diff moving_fn moving_avg bucket_script bucket_selector bucket_sort".split()


def _path(p: str) -> str:
    return "doc_count" if p == "_count" else p.replace(">", "_").replace(".", "_")


def sibling(table: DataFrame, kind: str, name: str, metric: str, p: dict, parents: list[str], key: str) -> DataFrame:
    """One row per parent bucket: the reduction of a metric over the buckets. Null values are skipped unless ``insert_zeros``."""
    v = F.col(f"`{metric}`").cast("double")
    v = F.coalesce(v, F.lit(0.0)) if p.get("gap_policy") == "insert_zeros" else v
    t = table.withColumn("__v", v).where("__v is not null")
    g = t.groupBy(*parents)
    n = lambda part: f"{name}_{part}"
    if kind in ("avg_bucket", "sum_bucket"):
        return g.agg((F.avg("__v") if kind == "avg_bucket" else F.sum("__v")).alias(name))
    if kind in ("min_bucket", "max_bucket"):
        f = F.min if kind == "min_bucket" else F.max
        best = t.withColumn("__b", f("__v").over(Window.partitionBy(*parents)))
        return best.groupBy(*parents).agg(f("__v").alias(name), F.array_sort(F.collect_list(F.when(F.col("__v") == F.col("__b"), F.col(f"`{key}`").cast("string")))).alias(n("keys")))
    stats = [F.count("__v").alias(n("count")), F.min("__v").alias(n("min")), F.max("__v").alias(n("max")), F.avg("__v").alias(n("avg")), F.sum("__v").alias(n("sum"))]
    if kind == "stats_bucket":
        return g.agg(*stats)
    if kind == "extended_stats_bucket":
        sigma = float(p.get("sigma", 2.0))
        samp = lambda f: F.when(F.count("__v") == 1, 0.0).otherwise(f("__v"))
        return g.agg(*stats, F.sum(F.col("__v") * F.col("__v")).alias(n("sum_of_squares")), F.var_pop("__v").alias(n("variance")), samp(F.var_samp).alias(n("variance_sampling")), F.stddev_pop("__v").alias(n("std_deviation")), samp(F.stddev_samp).alias(n("std_deviation_sampling")), (F.avg("__v") + sigma * F.stddev_pop("__v")).alias(n("upper")), (F.avg("__v") - sigma * F.stddev_pop("__v")).alias(n("lower")))
    ps = p.get("percents", [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0])
    # The value at the nearest rank, without interpolation.
    w = Window.partitionBy(*parents)
    ranked = t.withColumn("__i", F.row_number().over(w.orderBy("__v")) - 1).withColumn("__n", F.count("*").over(w))
    at = lambda q: F.floor(F.lit(float(q) / 100) * (F.col("__n") - 1) + 0.5)
    return ranked.groupBy(*parents).agg(*[F.max(F.when(F.col("__i") == at(q), F.col("__v"))).alias(n(f"{float(q):g}".replace(".", "_"))) for q in ps])


def _moving(kind: str, window: Column, p: dict) -> Column:
    """A function over the array of the window's values, oldest first; null if it is empty."""
    n = F.size(window)
    total = F.aggregate(window, F.lit(0.0), lambda a, x: a + x)
    if kind == "sum":
        r = total
    elif kind in ("min", "max"):
        r = F.array_min(window) if kind == "min" else F.array_max(window)
    elif kind == "stdDev":
        mean = total / n
        r = F.sqrt(F.aggregate(window, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)
    elif kind == "linearWeightedAvg":
        weighted = F.aggregate(F.transform(window, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
        r = weighted / (n * (n + 1) / 2)
    elif kind == "ewma":
        a = float(p.get("alpha", 0.3))
        r = F.aggregate(F.slice(window, 2, F.greatest(n - 1, F.lit(0))), F.get(window, 0), lambda s, x: x * a + s * (1 - a))
    elif kind == "holt":
        a, b = float(p.get("alpha", 0.3)), float(p.get("beta", 0.1))
        start = F.struct(F.get(window, 0).alias("s"), F.lit(0.0).alias("b"))
        step = lambda t, x: F.struct((x * a + (t["s"] + t["b"]) * (1 - a)).alias("s"), (b * (x * a + (t["s"] + t["b"]) * (1 - a) - t["s"]) + (1 - b) * t["b"]).alias("b"))
        r = F.aggregate(F.slice(window, 2, F.greatest(n - 1, F.lit(0))), start, step, lambda t: t["s"] + t["b"])
    else:
        r = total / n
    return F.when(n > 0, r)


_FUNCTION = re.compile(r"MovingFunctions\.(\w+)\((.*)\)")


def parents(table: DataFrame, subs: dict, keys: list[str]) -> DataFrame:
    """Apply the parent pipelines among ``subs`` to the rows of a bucket table, in the order given."""
    if not keys:
        return table
    w = Window.partitionBy(*keys[:-1]).orderBy(F.col(f"`{keys[-1]}`").asc_nulls_last())
    for name, spec in subs.items():
        kind = next(k for k in spec if k not in ("aggs", "aggregations", "meta"))
        if kind not in PARENTS:
            continue
        p = spec[kind]
        if kind in ("bucket_script", "bucket_selector"):
            t = table
            scope = {}
            for var, path in (p["buckets_path"] if isinstance(p["buckets_path"], dict) else {"_value": p["buckets_path"]}).items():
                t = t.withColumn(f"__p_{var}", F.col(f"`{_path(path)}`").cast("double"))
                scope[var] = f"__p_{var}"
            src = p["script"]["source"] if isinstance(p["script"], dict) else p["script"]
            extra = p["script"].get("params", {}) if isinstance(p["script"], dict) else {}
            src = re.sub(r"params\.(\w+)", lambda m, scope=scope: f"doc['{scope[m[1]]}'].value" if m[1] in scope else m[0], src)
            value = compile_script({"source": src, "params": extra}, t.schema)
            t = t.withColumn(name, value) if kind == "bucket_script" else t.where(F.coalesce(value, F.lit(False)))
            table = t.drop(*scope.values())
            continue
        if kind == "bucket_sort":
            order = []
            for s in p.get("sort", []):
                (k, d), = s.items() if isinstance(s, dict) else [(s, "asc")]
                d = d["order"] if isinstance(d, dict) else d
                c = F.col(f"`{keys[-1] if k == '_key' else _path(k)}`")
                order.append(c.desc_nulls_last() if d == "desc" else c.asc_nulls_last())
            order.append(F.col(f"`{keys[-1]}`").asc_nulls_last())
            start, size = int(p.get("from", 0)), p.get("size")
            if not keys[:-1] and size is not None:
                table = table.orderBy(*order).offset(start).limit(int(size))
                continue
            r = F.row_number().over(Window.partitionBy(*keys[:-1]).orderBy(*order))
            table = table.withColumn("__r", r).where(F.col("__r") > start)
            table = (table.where(F.col("__r") <= start + int(size)) if size is not None else table).drop("__r")
            continue
        v = F.col(f"`{_path(p['buckets_path'])}`").cast("double")
        if p.get("gap_policy") == "insert_zeros":
            v = F.coalesce(v, F.lit(0.0))
        if kind == "cumulative_sum":
            table = table.withColumn(name, F.coalesce(F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
        elif kind == "derivative":
            before = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
            d = v - before
            if p.get("unit"):
                from searchloom.plans.dates import interval_ms

                gap = F.unix_millis(F.col(f"`{keys[-1]}`").cast("timestamp")) - F.unix_millis(F.lag(f"`{keys[-1]}`").over(w).cast("timestamp"))
                table = table.withColumn(f"{name}_normalized", d / (gap / interval_ms(p["unit"])))
            table = table.withColumn(name, d)
        elif kind == "serial_diff":
            table = table.withColumn(name, v - F.lag(v, int(p.get("lag", 1))).over(w))
        else:
            n, shift = int(p.get("window", 5)), int(p.get("shift", 0))
            if kind == "moving_avg":
                fn = {"simple": "unweightedAvg", "linear": "linearWeightedAvg", "ewma": "ewma", "holt": "holt"}[p.get("model", "simple")]
                settings = p.get("settings", {})
            else:
                m = _FUNCTION.search(p["script"] if isinstance(p["script"], str) else p["script"]["source"])
                if not m:
                    raise ValueError("moving_fn takes a function of MovingFunctions")
                fn = m[1]
                numbers = [float(x) for x in re.findall(r"(?<=,)\s*([\d.]+)", m[2])]
                settings = dict(zip(("alpha", "beta"), numbers))
            values = F.collect_list(v).over(w.rowsBetween(-n + shift, -1 + shift))
            table = table.withColumn("__w", values).withColumn(name, _moving(fn, F.col("__w"), settings)).drop("__w")
    return table
