"""Pivots and rollups described by a document: a table per group, made once or brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.operators.aggs import METRICS, Level, key_column, with_metrics
from searchloom.plans.query import QueryError, compile_query


def pivot(df: DataFrame, config: dict, id: str = "_id", **options) -> DataFrame:  # noqa: A002
    """One row per combination of the ``group_by`` keys with the metrics of ``aggregations``, over the rows of ``query``.

    Keys are of the kinds ``terms``, ``histogram``, ``date_histogram`` and ``geotile_grid``. A row without one of the keys is left
    out, unless that key has ``missing_bucket``. ``doc_count`` comes with each group.
    """
    body = config.get("pivot", config)
    if config.get("query"):
        df = df.where(compile_query(df, config["query"], id=id, **options)[0].match)
    level = Level(df, [], df, id, options)
    for name, spec in body["group_by"].items():
        (kind, p), = spec.items()
        if kind not in ("terms", "histogram", "date_histogram", "geotile_grid"):
            raise QueryError(f"a pivot has no groups of kind {kind}")
        keyed = level.df.withColumn(name, key_column(level, kind, p))
        level = Level(keyed if p.get("missing_bucket") else keyed.where(F.col(f"`{name}`").isNotNull()), [*level.keys, name], df, id, options)
    subs = body.get("aggregations") or body.get("aggs") or {}
    for name, spec in subs.items():
        kind = next(iter(spec))
        if kind not in METRICS + ["filter", "missing"] or kind == "top_hits":
            raise QueryError(f"a pivot has no aggregation of kind {kind}")
    return with_metrics(level, subs)


def rollup(df: DataFrame, config: dict, id: str = "_id", **options) -> DataFrame:  # noqa: A002
    """Counts and metrics per interval of time and group: ``config`` has ``groups`` (``date_histogram``, ``terms``, ``histogram``) and ``metrics``.

    Columns: the time field, the group fields, ``doc_count`` and ``{field}_{metric}``; an average comes as its sum and value count, so
    that rolled-up rows can be rolled up again.
    """
    groups = config["groups"]
    time = groups["date_histogram"]
    by = {time["field"]: {"date_histogram": {k: v for k, v in time.items() if k != "delay"}}}
    by |= {f: {"terms": {"field": f}} for f in (groups.get("terms") or {}).get("fields", [])}
    by |= {f: {"histogram": {"field": f, "interval": groups["histogram"]["interval"]}} for f in (groups.get("histogram") or {}).get("fields", [])}
    subs = {}
    for m in config.get("metrics", []):
        for kind in dict.fromkeys(k for one in m["metrics"] for k in (("sum", "value_count") if one == "avg" else (one,))):
            if kind not in ("min", "max", "sum", "value_count"):
                raise QueryError(f"a rollup has no metric {kind}")
            subs[f"{m['field']}_{kind}"] = {kind: {"field": m["field"]}}
    # The keys take the names of their fields only after the metrics have read these.
    made = pivot(df, {"group_by": {f"__{f}": s for f, s in by.items()}, "aggs": subs}, id, **options)
    return made.select(*[F.col(f"`__{f}`").alias(f) for f in by], "doc_count", *subs)
