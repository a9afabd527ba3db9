"""Aggregation trees as group-bys: one table per path of bucket names, keyed by all keys on the path.

Every level of a tree is one ``groupBy`` over the keys of the levels above and its own; the metrics beside each other in a
level are expressions of one ``agg``. Where a parent keeps only some buckets, its children are cut by a semi join.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.functions import geo, text
from searchloom.functions.script import compile_script
from searchloom.operators import pipelines
from searchloom.operators.quantiles import exact_quantiles, same_keys
from searchloom.plans import dates
from searchloom.plans.query import Context, QueryError, compile_query

MAX_BUCKETS = 65_536
METRICS = "avg sum min max value_count stats extended_stats cardinality percentiles percentile_ranks median_absolute_deviation boxplot matrix_stats string_stats top_metrics geo_bounds geo_centroid weighted_avg scripted_metric top_hits".split()
PIPELINES = pipelines.PARENTS + pipelines.SIBLINGS


@dataclass
class Level:
    """Rows with a key for each bucket level so far; the keys' names; and what the tree is compiled against."""

    df: DataFrame
    keys: list[str]
    base: DataFrame
    id: str
    options: dict = field(default_factory=dict)

    def ctx(self) -> Context:
        return Context(self.df.schema, id=self.id, **{k: v for k, v in self.options.items() if k != "max_buckets"})

    def col(self, name: str) -> tuple[Column, T.DataType]:
        return self.ctx().resolve(name)


def _number(level: Level, p: dict) -> Column:
    if "script" in p:
        return compile_script(p["script"], level.df.schema).cast("double")
    col, kind = level.col(p["field"])
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        col = F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast(`{p['field']}` as timestamp_ntz))") / 1000.0
    col = col.cast("double")
    return F.coalesce(col, F.lit(float(p["missing"]))) if p.get("missing") is not None else col


def percent_name(p: float) -> str:
    return f"{float(p):g}".replace(".", "_")


def metric_columns(level: Level, name: str, kind: str, p: dict) -> list[Column]:
    """The expressions of a metric that one aggregation can compute, named ``name`` or ``name_<part>``."""
    n = lambda part: f"{name}_{part}"
    weight = F.coalesce(F.col("_doc_count"), F.lit(1)) if "_doc_count" in level.df.columns else None
    if kind in ("avg", "min", "max", "sum"):
        v = _number(level, p)
        if kind == "sum":
            return [F.coalesce(F.sum(v), F.lit(0.0)).alias(name)]
        return [getattr(F, kind)(v).alias(name)]
    if kind == "value_count":
        col, t = level.col(p["field"])
        return [(F.coalesce(F.sum(F.size(col)), F.lit(0)) if isinstance(t, T.ArrayType) else F.count(col)).cast("bigint").alias(name)]
    if kind in ("stats", "extended_stats"):
        v = _number(level, p)
        out = [F.count(v).alias(n("count")), F.min(v).alias(n("min")), F.max(v).alias(n("max")), F.avg(v).alias(n("avg")), F.coalesce(F.sum(v), F.lit(0.0)).alias(n("sum"))]
        if kind == "extended_stats":
            sigma = float(p.get("sigma", 2.0))
            sd = F.stddev_pop(v)
            sampling = lambda f: F.when(F.count(v) == 1, 0.0).otherwise(f(v))
            out += [F.sum(v * v).alias(n("sum_of_squares")), F.var_pop(v).alias(n("variance")), F.var_pop(v).alias(n("variance_population")), sampling(F.var_samp).alias(n("variance_sampling")), sd.alias(n("std_deviation")), sampling(F.stddev_samp).alias(n("std_deviation_sampling")), (F.avg(v) + sigma * sd).alias(n("upper")), (F.avg(v) - sigma * sd).alias(n("lower"))]
        return out
    if kind == "cardinality":
        col, _ = level.col(p["field"])
        if p.get("missing") is not None:
            col = F.coalesce(col, F.lit(p["missing"]))
        return [(F.approx_count_distinct(col, 0.01) if p.get("approximate") else F.count_distinct(col)).alias(name)]
    if kind == "percentiles":
        v, ps = _number(level, p), p.get("percents", [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0])
        return [F.percentile_approx(v, float(q) / 100, 10_000).alias(n(percent_name(q))) for q in ps]
    if kind == "percentile_ranks":
        v = _number(level, p)
        return [F.avg(F.when(v.isNotNull(), F.when(v <= float(t), 100.0).otherwise(0.0))).alias(n(percent_name(t))) for t in sorted(p["values"])]
    if kind == "matrix_stats":
        fs = p["fields"]
        cols = {f: level.col(f)[0].cast("double") for f in fs}
        full = None
        for c in cols.values():
            full = c.isNotNull() if full is None else full & c.isNotNull()
        v = {f: F.when(full, c) for f, c in cols.items()}
        out = []
        for f in fs:
            out += [F.count(v[f]).alias(f"{name}_{f}_count"), F.avg(v[f]).alias(f"{name}_{f}_mean"), F.var_samp(v[f]).alias(f"{name}_{f}_variance"), F.skewness(v[f]).alias(f"{name}_{f}_skewness"), (F.kurtosis(v[f]) + 3).alias(f"{name}_{f}_kurtosis")]
        for i, f in enumerate(fs):
            for g in fs[i + 1 :]:
                out += [F.covar_samp(v[f], v[g]).alias(f"{name}_{f}_{g}_covariance"), F.corr(v[f], v[g]).alias(f"{name}_{f}_{g}_correlation")]
        return out
    if kind == "top_metrics":
        s = p["sort"][0] if isinstance(p["sort"], list) else p["sort"]
        (f, order), = s.items() if isinstance(s, dict) else [(s, "asc")]
        order = order["order"] if isinstance(order, dict) else order
        ms = p["metrics"] if isinstance(p["metrics"], list) else [p["metrics"]]
        key = level.col(f)[0]
        tie = F.col(f"`{level.id}`")
        rank = F.struct(key, -tie if order == "desc" and isinstance(level.df.schema[level.id].dataType, T.NumericType) else tie)
        pick = F.max_by if order == "desc" else F.min_by
        return [pick(level.col(m["field"])[0], F.when(key.isNotNull(), rank)).alias(n(m["field"])) for m in ms]
    if kind == "weighted_avg":
        v, w = _number(level, p["value"]), _number(level, p["weight"])
        both = v.isNotNull() & w.isNotNull()
        return [(F.sum(F.when(both, v * w)) / F.sum(F.when(both, w))).alias(name)]
    if kind == "geo_bounds":
        lat, lon = level.ctx().lat_lon(p["field"])
        return [F.max(lat).alias(n("top")), F.min(lon).alias(n("left")), F.min(lat).alias(n("bottom")), F.max(lon).alias(n("right"))]
    if kind == "geo_centroid":
        lat, lon = level.ctx().lat_lon(p["field"])
        return [F.avg(lat).alias(n("lat")), F.avg(lon).alias(n("lon")), F.count(lat).alias(n("count"))]
    if kind == "scripted_metric":
        # The map script is an expression whose values are added up, or combined as ``combine`` says.
        v = compile_script({"source": p["map_script"], "params": p.get("params", {})} if isinstance(p["map_script"], str) else p["map_script"], level.df.schema).cast("double")
        return [{"sum": F.coalesce(F.sum(v), F.lit(0.0)), "min": F.min(v), "max": F.max(v), "avg": F.avg(v)}[p.get("combine", "sum")].alias(name)]
    if kind == "doc_count":
        return [(F.count("*") if weight is None else F.sum(weight)).alias(name)]
    raise QueryError(f"unknown metric {kind}")


def _count(level: Level) -> Column:
    return metric_columns(level, "doc_count", "doc_count", {})[0]


def _by_rank(level: Level, name: str, kind: str, p: dict) -> DataFrame:
    """Percentiles, box plots and median absolute deviations: one row per bucket that has values."""
    v = _number(level, p)
    if "hdr" in p:
        digits = int(p["hdr"].get("number_of_significant_value_digits", 3))
        unit = F.pow(F.lit(10.0), F.floor(F.log10(v)) - (digits - 1))
        v = F.when(v > 0, F.floor(v / unit) * unit).otherwise(v)
    values = level.df.select(*level.keys, v.alias("__v"), F.lit(1).cast("bigint").alias("__n"))
    if kind == "percentiles":
        ps = p.get("percents", [1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0])
        out = exact_quantiles(values, level.keys, [float(q) / 100 for q in ps])
        return out.select(*level.keys, *[F.get("__q", i).alias(f"{name}_{percent_name(q)}") for i, q in enumerate(ps)])
    if kind == "boxplot":
        out = exact_quantiles(values, level.keys, [0.0, 0.25, 0.5, 0.75, 1.0])
        parts = {f"{name}_{part}": F.get("__q", i) for i, part in enumerate(("min", "q1", "q2", "q3", "max"))}
        if not p.get("whiskers"):
            return out.select(*level.keys, *[c.alias(n) for n, c in parts.items()])
        # The whiskers end at the outermost values within one and a half times the box beyond it.
        low, high = (F.get("__q", i) + f * (F.get("__q", 3) - F.get("__q", 1)) for i, f in ((1, -1.5), (3, 1.5)))
        fences = out.select(*level.keys, low.alias("__low"), high.alias("__high"), "__q")
        within = same_keys(values, fences.drop("__q"), level.keys, "inner").where(F.col("__v").between(F.col("__low"), F.col("__high")))
        ends = within.groupBy(*level.keys).agg(F.min("__v").alias(f"{name}_lower"), F.max("__v").alias(f"{name}_upper"))
        return same_keys(out, ends, level.keys).select(*level.keys, *[c.alias(n) for n, c in parts.items()], f"{name}_lower", f"{name}_upper")
    counts = values.where("__v is not null").groupBy(*level.keys, "__v").agg(F.sum("__n").alias("__n"))
    middle = exact_quantiles(values, level.keys, [0.5]).select(*level.keys, F.get("__q", 0).alias("__m"))
    beside = same_keys(counts, middle, level.keys, "inner").select(*level.keys, F.abs(F.col("__v") - F.col("__m")).alias("__v"), "__n")
    return exact_quantiles(beside, level.keys, [0.5]).select(*level.keys, F.get("__q", 0).alias(name))


def _string_stats(level: Level, name: str, p: dict) -> DataFrame:
    col = level.col(p["field"])[0].cast("string")
    rows = level.df.select(*level.keys, col.alias("__v")).where("__v is not null")
    out = rows.groupBy(*level.keys).agg(F.count("*").alias(f"{name}_count"), F.min(F.length("__v")).alias(f"{name}_min_length"), F.max(F.length("__v")).alias(f"{name}_max_length"), F.avg(F.length("__v")).alias(f"{name}_avg_length"))
    chars = rows.select(*level.keys, F.explode(F.split("__v", "")).alias("__c")).where("__c != ''").groupBy(*level.keys, "__c").agg(F.count("*").alias("__n"))
    tot = chars.groupBy(*level.keys).agg(F.sum("__n").alias("__t"), F.sum(F.col("__n") * F.log2("__n")).alias("__l"))
    tot = tot.select(*level.keys, (F.log2("__t") - F.col("__l") / F.col("__t")).alias(f"{name}_entropy"))
    return out.join(tot, level.keys, "left") if level.keys else out.crossJoin(F.broadcast(tot))


def top_hits(level: Level, p: dict) -> DataFrame:
    """The first hits of each bucket, with ``rank`` from 1."""
    from searchloom.plans.search import order_by, sort_columns, source_columns

    ctx = level.ctx()
    keys = sort_columns(p.get("sort", ["_doc"]), ctx, F.lit(1.0))
    keys.append(("_doc", F.col(f"`{level.id}`"), False, "_last"))
    w = Window.partitionBy(*level.keys).orderBy(*order_by(keys))
    start, size = p.get("from", 0), p.get("size", 3)
    kept = [c for c in source_columns(level.df.schema, p.get("_source")) if c not in level.keys]
    rows = level.df.withColumn("rank", F.row_number().over(w)).where((F.col("rank") > start) & (F.col("rank") <= start + size))
    return rows.select(*level.keys, *kept, "rank")


def with_metrics(level: Level, subs: dict) -> DataFrame:
    """One row per bucket: its keys, ``doc_count`` and the metrics of ``subs``."""
    exprs, extra = [_count(level)], []
    for name, spec in subs.items():
        kind = _kind(spec)
        if kind in ("median_absolute_deviation", "boxplot") or kind == "percentiles" and not spec[kind].get("approximate"):
            extra.append(_by_rank(level, name, kind, spec[kind]))
        elif kind == "string_stats":
            extra.append(_string_stats(level, name, spec[kind]))
        elif kind in METRICS and kind != "top_hits":
            exprs += metric_columns(level, name, kind, spec[kind])
        elif kind == "filter" and not _subs(spec):
            exprs.append(F.count_if(compile_query(level.df, spec[kind], id=level.id, **_query_options(level))[0].match).alias(name))
        elif kind == "missing" and not _subs(spec):
            exprs.append(F.sum(level.col(spec[kind]["field"])[0].isNull().cast("bigint")).alias(name))
    out = level.df.groupBy(*level.keys).agg(*exprs)
    for e in extra:  # one row per bucket; no row where a bucket has no values
        out = same_keys(out, e, level.keys) if level.keys else out.join(F.broadcast(e), how="left")
    return out


#: Aggregations whose buckets a request names, so that rows fall into few combinations of them; metrics whose parts can be added up.
NAMED = ("filters", "adjacency_matrix", "range", "date_range", "ip_range", "geo_distance")
ADDED = ("sum", "min", "max", "avg", "value_count", "stats")


def _by_combination(level: Level, name: str, key: Column, subs: dict) -> DataFrame | None:
    """The buckets of an array key: rows are summed up per combination of keys first, and only these sums are repeated for each key.

    None if a metric can't be put together from parts.
    """
    metrics = {n: s for n, s in subs.items() if _kind(s) in METRICS and _kind(s) != "top_hits" or _kind(s) in ("filter", "missing") and not _subs(s)}
    if any(_kind(s) not in ADDED for s in metrics.values()):
        return None
    parts, whole = [metric_columns(level, "__n", "doc_count", {})[0]], [F.sum("__n").alias("doc_count")]
    for i, (n, spec) in enumerate(metrics.items()):
        kind = _kind(spec)
        if kind == "value_count":
            parts += metric_columns(level, f"__c{i}", kind, spec[kind])
            whole.append(F.sum(f"__c{i}").alias(n))
            continue
        v = _number(level, spec[kind])
        parts += [F.sum(v).alias(f"__s{i}"), F.count(v).alias(f"__c{i}"), F.min(v).alias(f"__a{i}"), F.max(v).alias(f"__b{i}")]
        mean = F.when(F.sum(f"__c{i}") > 0, F.sum(f"__s{i}") / F.sum(f"__c{i}"))
        made = {"sum": F.coalesce(F.sum(f"__s{i}"), F.lit(0.0)), "min": F.min(f"__a{i}"), "max": F.max(f"__b{i}"), "avg": mean, "count": F.sum(f"__c{i}")}
        whole += [made[k].alias(f"{n}_{k}") for k in ("count", "min", "max", "avg", "sum")] if kind == "stats" else [made[kind].alias(n)]
    sums = level.df.withColumn("__keys", key).where(F.size("__keys") > 0).groupBy(*level.keys, "__keys").agg(*parts)
    return sums.withColumn(name, F.explode("__keys")).groupBy(*level.keys, name).agg(*whole)


def _query_options(level: Level) -> dict:
    return {k: v for k, v in level.options.items() if k in ("now", "analyzers", "text_fields", "geo")}


def _kind(spec: dict) -> str:
    return next(k for k in spec if k not in ("aggs", "aggregations", "meta"))


def _subs(spec: dict) -> dict:
    return spec.get("aggs") or spec.get("aggregations") or {}


# bucket keys


def _range_bounds(p: dict, date: bool, now: datetime | None) -> list[tuple[str, object, object]]:
    out = []
    for r in p["ranges"]:
        lo, hi = r.get("from"), r.get("to")
        if date:
            lo, hi = (dates.resolve(x, False, now, p.get("format")) if x is not None else None for x in (lo, hi))
            shift = timedelta(milliseconds=_offset_ms(p.get("time_zone")) or 0)
            if p.get("time_zone") and _offset_ms(p["time_zone"]) is None:
                raise QueryError("date_range takes a zone as an offset, such as +01:00")
            lo, hi = (x - shift if x is not None else None for x in (lo, hi))
            show = lambda t: "*" if t is None else t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"
        else:
            show = lambda t: "*" if t is None else str(float(t))
        out.append((r.get("key") or f"{show(lo)}-{show(hi)}", lo, hi))
    return out


def _ranges(v: Column, bounds, lit) -> Column:
    """The keys of all ranges that hold the value, half-open."""
    hits = []
    for key, lo, hi in bounds:
        c = v.isNotNull()
        if lo is not None:
            c &= v >= lit(lo)
        if hi is not None:
            c &= v < lit(hi)
        hits.append(F.when(c, F.lit(key)))
    return F.array_compact(F.array(*hits))


def _ip_key(c: Column) -> Column:
    """An address as 32 hexadecimal digits, which sort as addresses do; one of version 4 is mapped into version 6. Null if it is none."""
    c = F.trim(c)
    four = c.rlike(r"^(\d{1,3}\.){3}\d{1,3}$")
    bytes4 = F.transform(F.split(c, r"\."), lambda x: x.try_cast("int"))
    ok4 = F.forall(bytes4, lambda x: x.between(0, 255))
    v4 = F.concat(F.lit("0" * 20 + "ffff"), F.array_join(F.transform(bytes4, lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), ""))
    six = c.rlike(r"^(::|[0-9A-Fa-f])[0-9A-Fa-f:]*$") & ~c.rlike(r":::|[^:]:$") & c.contains(":")
    halves = F.split(F.lower(c), "::")
    groups = lambda h: F.filter(F.split(h, ":"), lambda x: x != "")
    left, right = groups(F.get(halves, 0)), groups(F.coalesce(F.get(halves, 1), F.lit("")))
    gap = F.lit(8) - F.size(left) - F.size(right)
    ok6 = F.when(F.size(halves) == 2, gap >= 1).otherwise((F.size(halves) == 1) & (gap == 0)) & F.forall(F.concat(left, right), lambda x: F.length(x) <= 4)
    pad = lambda g: F.array_join(F.transform(g, lambda x: F.lpad(x, 4, "0")), "")
    v6 = F.concat(pad(left), F.repeat(F.lit("0000"), F.greatest(gap, F.lit(0))), pad(right))
    return F.when(four & ok4, v4).when(six & ok6, v6)


def _ip_bounds(r: dict) -> tuple[str, str | None, str | None]:
    import ipaddress

    mapped = lambda a: int(a) + (0xFFFF << 32 if a.version == 4 else 0)
    as_int = lambda x: None if x is None else f"{mapped(ipaddress.ip_address(x)):032x}"
    if "mask" in r:
        net = ipaddress.ip_network(r["mask"], strict=False)
        return r.get("key") or r["mask"], f"{mapped(net.network_address):032x}", f"{mapped(net.broadcast_address) + 1:032x}"
    return r.get("key") or f"{r.get('from', '*')}-{r.get('to', '*')}", as_int(r.get("from")), as_int(r.get("to"))


def _epoch_ms(level: Level, name: str) -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', cast(`{name}` as timestamp_ntz))") / 1000


def _from_ms(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("bigint")).cast("timestamp_ntz")


def _offset_ms(zone: str | None) -> int | None:
    """Milliseconds of a fixed zone such as ``+05:30``; None for a named one."""
    if not zone or zone in ("UTC", "Z"):
        return 0
    m = re.fullmatch(r"([+-])(\d\d):?(\d\d)", zone)
    return None if m is None else (1 if m[1] == "+" else -1) * (int(m[2]) * 60 + int(m[3])) * 60_000


def to_zone(c: Column, zone: str | None) -> Column:
    """The wall-clock time of a zone, of a time in UTC."""
    return c if not zone or zone in ("UTC", "Z") else F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz"))


def from_zone(c: Column, zone: str | None) -> Column:
    return c if not zone or zone in ("UTC", "Z") else F.convert_timezone(F.lit(zone), F.lit("UTC"), c)


def _shown(local: Column, fmt: str) -> Column:
    """A time in the first of the formats that a request names."""
    fmt = fmt.split("||")[0]
    if fmt in ("epoch_millis", "epoch_second"):
        return F.call_function("div", F.unix_millis(local.cast("timestamp")), F.lit(1 if fmt == "epoch_millis" else 1000)).cast("string")
    return F.date_format(local, fmt)


def key_strings(table: DataFrame, name: str, p: dict) -> DataFrame:
    """``{name}_as_string``, the bucket's time in the zone and format that the request names (keyed buckets go by it)."""
    if not (p.get("format") or p.get("time_zone") or p.get("keyed")):
        return table
    local = to_zone(F.col(f"`{name}`"), p.get("time_zone"))
    iso = F.concat(F.date_format(local, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit(p.get("time_zone", "Z") if _offset_ms(p.get("time_zone")) not in (0, None) else "Z"))
    return table.withColumn(f"{name}_as_string", _shown(local, p["format"]) if p.get("format") else iso)


def calendar_floor(c: Column, unit: str) -> Column:
    name = {"s": "second", "m": "minute", "h": "hour", "d": "day", "w": "week", "M": "month", "q": "quarter", "y": "year"}[unit]
    return F.date_trunc(name, c.cast("timestamp")).cast("timestamp_ntz")


def key_column(level: Level, kind: str, p: dict) -> Column | None:
    """The bucket key of a row: a scalar, or an array of keys if a row may fall into several. None: not keyed by row."""
    now = level.options.get("now")
    if kind in ("terms", "rare_terms", "significant_terms"):
        if "script" in p:
            return compile_script(p["script"], level.df.schema)
        col, t = level.col(p["field"])
        if p.get("missing") is not None:
            col = F.coalesce(col, F.lit(p["missing"]).cast(t))
        return F.array_distinct(col) if isinstance(t, T.ArrayType) else col
    if kind == "multi_terms":
        cols = [level.col(t["field"])[0] for t in p["terms"]]
        some = None
        for c in cols:
            some = c.isNotNull() if some is None else some & c.isNotNull()
        return F.when(some, F.concat_ws("|", *[c.cast("string") for c in cols]))
    if kind == "significant_text":
        return F.array_distinct(level.ctx().tokens(p["field"]))
    if kind == "range":
        return _ranges(_number(level, p), _range_bounds(p, False, now), lambda x: F.lit(float(x)))
    if kind == "date_range":
        col = level.col(p["field"])[0].cast("timestamp_ntz")
        return _ranges(col, _range_bounds(p, True, now), lambda t: F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz"))
    if kind == "ip_range":
        return _ranges(_ip_key(level.col(p["field"])[0]), [_ip_bounds(r) for r in p["ranges"]], F.lit)
    if kind == "ip_prefix":
        # Of version 4 unless ``is_ipv6``; addresses of the other version have no bucket, as the prefix says nothing of them.
        six, n = bool(p.get("is_ipv6")), int(p["prefix_length"])
        h = _ip_key(level.col(p["field"])[0])
        is4 = h.startswith("0" * 20 + "ffff")
        digits = F.when(is4 != F.lit(six), h if six else F.substring(h, 25, 8))
        whole, bits = n // 4, n % 4
        part = F.conv(F.substring(digits, whole + 1, 1), 16, 10).cast("int")
        middle = F.lower(F.hex(part - part % (1 << (4 - bits)))) if bits else F.lit("")
        kept = F.rpad(F.concat(F.substring(digits, 1, whole), middle), 32 if six else 8, "0")
        if six:
            return F.when(kept.isNotNull(), F.concat_ws(":", *[F.substring(kept, 4 * i + 1, 4) for i in range(8)]))
        return F.when(digits.isNotNull(), F.concat_ws(".", *[F.conv(F.substring(kept, 2 * i + 1, 2), 16, 10) for i in range(4)]))
    if kind == "histogram":
        i, o = float(p["interval"]), float(p.get("offset", 0))
        return F.floor((_number(level, p) - o) / i) * i + o
    if kind == "date_histogram":
        unit = p.get("calendar_interval") or (p["interval"] if p.get("interval") in dates.CALENDAR else None)
        if unit:
            if unit not in dates.CALENDAR:
                raise QueryError(f"not a calendar interval: {unit}")
            return from_zone(calendar_floor(to_zone(level.col(p["field"])[0], p.get("time_zone")), dates.CALENDAR[unit]), p.get("time_zone"))
        step = dates.interval_ms(p.get("fixed_interval") or p["interval"])
        if p.get("time_zone"):  # cells begin at the zone's midnight
            local = to_zone(level.col(p["field"])[0].cast("timestamp_ntz"), p["time_zone"])
            ms = F.unix_millis(local.cast("timestamp"))
            return from_zone(_from_ms(F.floor(ms / step) * step), p["time_zone"])
        o = p.get("offset", 0)
        if isinstance(o, str):
            o = -dates.interval_ms(o[1:]) if o[0] == "-" else dates.interval_ms(o.lstrip("+"))
        return _from_ms(F.floor((_epoch_ms(level, p["field"]) - o) / step) * step + o)
    if kind == "geo_distance":
        lat, lon = level.ctx().lat_lon(p["field"])
        d = geo.haversine(lat, lon, *geo.point(p["origin"])) / geo.UNITS_M[p.get("unit", "m")]
        return _ranges(d, _range_bounds(p, False, now), lambda x: F.lit(float(x)))
    if kind in ("geohash_grid", "geotile_grid"):
        f = geo.geohash if kind == "geohash_grid" else geo.geotile
        lat, lon = level.ctx().lat_lon(p["field"])
        return F.when(lat.isNotNull() & lon.isNotNull(), f(lat, lon, int(p.get("precision", 5 if kind == "geohash_grid" else 7))))
    if kind == "time_series":
        return F.concat_ws(",", *[F.concat(F.lit(f + "="), level.col(f)[0].cast("string")) for f in p["dimensions"]])
    if kind == "filters":
        fs = p["filters"]
        named = fs.items() if isinstance(fs, dict) else ((str(i), q) for i, q in enumerate(fs))
        hits = [F.when(compile_query(level.df, q, id=level.id, **_query_options(level))[0].match, F.lit(n)) for n, q in named]
        key = F.array_compact(F.array(*hits))
        if p.get("other_bucket") or p.get("other_bucket_key"):
            key = F.when(F.size(key) == 0, F.array(F.lit(p.get("other_bucket_key", "_other_")))).otherwise(key)
        return key
    if kind == "adjacency_matrix":
        sep = p.get("separator", "&")
        ms = {n: compile_query(level.df, q, id=level.id, **_query_options(level))[0].match for n, q in sorted(p["filters"].items())}
        names = sorted(ms)
        hits = [F.when(ms[a], F.lit(a)) for a in names] + [F.when(ms[a] & ms[b], F.lit(f"{a}{sep}{b}")) for i, a in enumerate(names) for b in names[i + 1 :]]
        return F.array_compact(F.array(*hits))
    return None


def _is_array(df: DataFrame, c: Column) -> bool:
    return isinstance(df.select(c.alias("c")).schema["c"].dataType, T.ArrayType)


def _keyed(level: Level, name: str, key: Column) -> Level:
    """Rows with the key column; rows without a key leave, rows with several are repeated."""
    if _is_array(level.df, key):
        df = level.df.withColumn(name, F.explode(key))
    else:
        df = level.df.withColumn(name, key)
    return Level(df.where(F.col(f"`{name}`").isNotNull()), [*level.keys, name], level.base, level.id, level.options)


def _top(buckets: DataFrame, parents: list[str], order: list[Column], size: int) -> DataFrame:
    if not parents:
        return buckets.orderBy(*order).limit(size)
    w = Window.partitionBy(*parents).orderBy(*order)
    return buckets.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= size).drop("__r")


def _terms_order(p: dict, name: str) -> list[Column]:
    spec = p.get("order", {"_count": "desc"})
    out, seen = [], False
    for o in spec if isinstance(spec, list) else [spec]:
        (k, d), = o.items()
        seen |= k in ("_key", "_term")
        c = F.col("doc_count") if k == "_count" else F.col(f"`{name}`") if k in ("_key", "_term") else F.col(f"`{k.replace('.', '_').replace('>', '_')}`")
        out.append(c.desc_nulls_last() if d == "desc" else c.asc_nulls_last())
    return out if seen else [*out, F.col(f"`{name}`").asc()]


def fill_gaps(buckets: DataFrame, keys: list[str], p: dict, date: bool, unit: str | None, step: float | None, zero: list[str], options: dict) -> DataFrame:
    """Rows for the empty cells between each parent's first and last bucket, or the extended bounds."""
    name, parents = keys[-1], keys[:-1]
    lo, hi = F.min(f"`{name}`"), F.max(f"`{name}`")
    ends = buckets.groupBy(*parents).agg(lo.alias("__lo"), hi.alias("__hi"))
    b = p.get("extended_bounds")
    if b:
        as_lit = (lambda x: F.lit(dates.resolve(x, False, options.get("now")).isoformat(sep=" ")).cast("timestamp_ntz")) if date else (lambda x: F.lit(float(x)))
        fl = lambda c: calendar_floor(c, unit) if date and unit else _from_ms(F.floor(F.expr("1") * F.unix_millis(c.cast("timestamp")) / step) * step) if date else F.floor(c / step) * step
        ends = ends.withColumn("__lo", F.least("__lo", fl(as_lit(b["min"])))).withColumn("__hi", F.greatest("__hi", fl(as_lit(b["max"]))))
    limit = int(options.get("max_buckets", MAX_BUCKETS))
    zone = p.get("time_zone") if date else None
    if zone:
        ends = ends.withColumns({c: to_zone(F.col(c), zone) for c in ("__lo", "__hi")})
    if date:
        width = float(step or {"M": 28, "q": 84, "y": 365}.get(unit, 0) * 86_400_000 or dates.UNIT_MS[unit])
        many = (F.unix_millis(F.col("__hi").cast("timestamp")) - F.unix_millis(F.col("__lo").cast("timestamp"))) / width >= limit
        ends = ends.withColumn("__hi", F.when(many, F.raise_error(F.lit(f"Trying to create too many buckets: over {limit}")).cast("timestamp_ntz")).otherwise(F.col("__hi")))
    if date and unit:
        n = {"s": "1 second", "m": "1 minute", "h": "1 hour", "d": "1 day", "w": "7 day", "M": "1 month", "q": "3 month", "y": "1 year"}[unit]
        cells = F.expr(f"sequence(__lo, __hi, interval {n})")
    elif date:
        cells = F.transform(F.sequence(F.unix_millis(F.col("__lo").cast("timestamp")), F.unix_millis(F.col("__hi").cast("timestamp")), F.lit(int(step)).cast("bigint")), lambda m: _from_ms(m))
    else:
        count = F.round((F.col("__hi") - F.col("__lo")) / step).cast("int")
        count = F.when(count >= limit, F.raise_error(F.lit(f"Trying to create too many buckets: over {limit}")).cast("int")).otherwise(count)
        cells = F.transform(F.sequence(F.lit(0), count), lambda i: F.col("__lo") + i * step)
    if zone:
        cells = F.transform(cells, lambda c: from_zone(c, zone))
    spine = ends.where("__lo is not null").select(*parents, F.explode(cells).alias(name))
    out = spine.join(buckets, keys, "left")
    out = out.fillna(0, subset=[c for c in zero if c in out.columns])
    if p.get("hard_bounds") and "min" in p["hard_bounds"] and "max" in p["hard_bounds"]:
        out = out.where(F.col(f"`{name}`").between(F.lit(p["hard_bounds"]["min"]), F.lit(p["hard_bounds"]["max"])))
    return out


def run_aggs(df: DataFrame, aggs: dict, base: DataFrame | None = None, id: str = "_id", **options) -> dict[str, DataFrame]:  # noqa: A002
    """All tables of an aggregation tree. A path joins names with ``>``; the metrics at the top come as the table ``_metrics``."""
    out: dict[str, DataFrame] = {}
    level = Level(df, [], base if base is not None else df, id, options)
    _walk(level, aggs, "", out)
    return out


def _walk(level: Level, aggs: dict, path: str, out: dict[str, DataFrame]) -> None:
    metrics = {n: s for n, s in aggs.items() if _kind(s) in METRICS and _kind(s) != "top_hits"}
    if metrics and not path:
        out["_metrics"] = with_metrics(level, metrics)
    for name, spec in aggs.items():
        kind = _kind(spec)
        here = f"{path}>{name}" if path else name
        if kind == "top_hits":
            out[here] = top_hits(level, spec[kind])
        elif kind not in METRICS and kind not in PIPELINES:
            _bucket(level, name, kind, spec[kind], _subs(spec), here, out)
    for name, spec in aggs.items():
        if _kind(spec) in pipelines.SIBLINGS:
            kind = _kind(spec)
            source, _, metric = spec[kind]["buckets_path"].partition(">")
            table = out[f"{path}>{source}" if path else source]
            out[f"{path}>{name}" if path else name] = pipelines.sibling(table, kind, name, metric.replace(".", "_").replace("_count", "doc_count") if metric == "_count" else (metric.replace(".", "_") or "doc_count"), spec[kind], level.keys, source)


def _bucket(level: Level, name: str, kind: str, p: dict, subs: dict, here: str, out: dict[str, DataFrame]) -> None:
    if kind == "global":
        level = Level(level.base, [], level.base, level.id, level.options)
        inner = level
    elif kind == "filter":
        inner = Level(level.df.where(compile_query(level.df, p, id=level.id, **_query_options(level))[0].match), level.keys, level.base, level.id, level.options)
    elif kind == "missing":
        inner = Level(level.df.where(level.col(p["field"])[0].isNull()), level.keys, level.base, level.id, level.options)
    elif kind == "nested":
        col, t = level.col(p["path"])
        inner = Level(level.df.withColumn("__parent", F.monotonically_increasing_id()).withColumn(p["path"], F.explode(col)), level.keys, level.base, level.id, level.options)
    elif kind == "reverse_nested":
        inner = Level(level.df.dropDuplicates([*level.keys, "__parent"]), level.keys, level.base, level.id, level.options)
    elif kind in ("sampler", "random_sampler", "diversified_sampler"):
        inner = Level(sample(level, p, kind), level.keys, level.base, level.id, level.options)
    elif kind == "composite":
        out[here] = composite(level, p, subs)
        return
    elif kind == "auto_date_histogram":
        inner = _auto_date(level, name, p)
        out[here] = _finish(inner, name, "date_histogram", {"min_doc_count": 0, "__unit": inner.options["__auto"]}, subs)
        _children(inner, out[here], subs, here, out)
        return
    elif kind == "variable_width_histogram":
        out[here] = variable_width(level, name, p)
        return
    elif kind in ("significant_terms", "significant_text"):
        out[here] = significant(level, name, kind, p)
        return
    else:
        key = key_column(level, kind, p)
        if key is None:
            raise QueryError(f"unknown aggregation {kind}")
        inner = _keyed(level, name, key)
        if kind == "terms":
            for how, yes in (("include", True), ("exclude", False)):
                if how in p:
                    c = F.col(f"`{name}`")
                    m = c.isin(p[how]) if isinstance(p[how], list) else c.cast("string").rlike(f"^(?:{p[how]})$")
                    inner.df = inner.df.where(m if yes else ~m)
        out[here] = _finish(inner, name, kind, p, subs, _by_combination(level, name, key, subs) if kind in NAMED else None)
        _children(inner, out[here], subs, here, out)
        return
    out[here] = pipelines.parents(with_metrics(inner, subs), subs, inner.keys)
    _walk_children(inner, subs, here, out)


def _finish(inner: Level, name: str, kind: str, p: dict, subs: dict, table: DataFrame | None = None) -> DataFrame:
    """The buckets of a keyed aggregation after gap filling, ordering, cutting and pipelines."""
    table = with_metrics(inner, subs) if table is None else table
    parents = inner.keys[:-1]
    if kind in ("terms", "multi_terms", "geohash_grid", "geotile_grid"):
        size = int(p.get("size", 10 if "terms" in kind else 10_000))
        order = _terms_order(p, name)
        if kind == "terms" and p.get("show_other"):
            w = Window.partitionBy(*parents)
            table = table.withColumn("__all", F.sum("doc_count").over(w))
        table = _top(table, parents, order, size or 2**31 - 1)
        if kind == "terms" and p.get("show_other"):
            table = table.withColumn("sum_other_doc_count", F.col("__all") - F.sum("doc_count").over(Window.partitionBy(*parents))).drop("__all")
        if int(p.get("min_doc_count", 1)) > 1:
            table = table.where(F.col("doc_count") >= int(p["min_doc_count"]))
    elif kind == "rare_terms":
        table = table.where((F.col("doc_count") <= int(p.get("max_doc_count", 1))) & (F.col(f"`{name}`").cast("string") != ""))
    elif kind in ("histogram", "date_histogram"):
        least = int(p.get("min_doc_count", 0))
        if least == 0:
            zero = ["doc_count", *[c for n, s in subs.items() for c in ([n] if _kind(s) in ("sum", "value_count", "filter", "missing", "scripted_metric", "cardinality") else [f"{n}_count", f"{n}_sum"] if "stats" in _kind(s) else [])]]
            if kind == "histogram":
                table = fill_gaps(table, inner.keys, p, False, None, float(p["interval"]), zero, inner.options)
            else:
                unit = p.get("calendar_interval") or (p.get("interval") if p.get("interval") in dates.CALENDAR else None)
                if "__unit" in p:
                    u, k = p["__unit"]
                    table = fill_gaps(table, inner.keys, p, True, u if k == 1 else None, None if k == 1 else k * dates.UNIT_MS.get(u, 0), zero, inner.options) if k == 1 or u in dates.UNIT_MS else table
                else:
                    table = fill_gaps(table, inner.keys, p, True, dates.CALENDAR[unit] if unit else None, None if unit else dates.interval_ms(p.get("fixed_interval") or p["interval"]), zero, inner.options)
        elif least > 1:
            table = table.where(F.col("doc_count") >= least)
        if kind == "date_histogram":
            table = key_strings(table, name, p)
    elif kind in ("filters", "range", "date_range", "ip_range", "geo_distance"):
        # Empty ranges and filters are buckets too.
        if kind == "filters":
            names = list(p["filters"]) if isinstance(p["filters"], dict) else [str(i) for i in range(len(p["filters"]))]
            if p.get("other_bucket") or p.get("other_bucket_key"):
                names.append(p.get("other_bucket_key", "_other_"))
        elif kind == "ip_range":
            names = [_ip_bounds(r)[0] for r in p["ranges"]]
        else:
            names = [b[0] for b in _range_bounds(p, kind == "date_range", inner.options.get("now"))]
        spark = table.sparkSession
        spine = spark.createDataFrame([(n,) for n in names], f"`{name}` string")
        if parents:
            spine = table.select(*parents).distinct().crossJoin(F.broadcast(spine))
        table = spine.join(table, inner.keys, "left").fillna(0, subset=["doc_count"])
    return pipelines.parents(table, subs, inner.keys)


def _children(inner: Level, table: DataFrame, subs: dict, here: str, out: dict) -> None:
    """Bucket and top-hit aggregations below, over the buckets that the parent kept."""
    below = {n: s for n, s in subs.items() if _kind(s) not in METRICS + PIPELINES or _kind(s) == "top_hits" or _kind(s) in pipelines.SIBLINGS}
    if not below:
        return
    kept = table.select(*inner.keys)
    df = inner.df.join(kept, inner.keys, "left_semi")
    _walk(Level(df, inner.keys, inner.base, inner.id, inner.options), below, here, out)


def _walk_children(inner: Level, subs: dict, here: str, out: dict) -> None:
    below = {n: s for n, s in subs.items() if _kind(s) not in METRICS + pipelines.PARENTS or _kind(s) == "top_hits"}
    if below:
        _walk(inner, below, here, out)


def sample(level: Level, p: dict, kind: str) -> DataFrame:
    """The first ``shard_size`` rows by score, then id; of each value at most ``max_docs_per_value`` for the diversified one."""
    n = int(p.get("shard_size", 200))
    order = ([F.desc("_score")] if "_score" in level.df.columns else []) + [F.asc(f"`{level.id}`")]
    df = level.df
    if kind == "diversified_sampler":
        w = Window.partitionBy(level.col(p["field"])[0]).orderBy(*order)
        df = df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= int(p.get("max_docs_per_value", 1))).drop("__r")
    return df.orderBy(*order).limit(n)


def composite(level: Level, p: dict, subs: dict) -> DataFrame:
    """Pages of buckets over several sources, in the order of the sources."""
    cur, orders, names = level, [], []
    for s in p["sources"]:
        (name, spec), = s.items()
        kind = _kind(spec)
        q = spec[kind]
        key = key_column(cur, kind, q)
        df = cur.df.withColumn(name, key)
        if not q.get("missing_bucket"):
            df = df.where(F.col(f"`{name}`").isNotNull())
        cur = Level(df, [*cur.keys, name], cur.base, cur.id, cur.options)
        names.append(name)
        orders.append(q.get("order", "asc"))
    table = with_metrics(cur, subs)
    if p.get("after"):
        later, same = F.lit(False), F.lit(True)
        for name, o in zip(names, orders):
            c, v = F.col(f"`{name}`"), F.lit(p["after"][name])
            later = later | (same & ((c > v) if o == "asc" else (c < v)))
            same = same & (c == v)
        table = table.where(later)
    order = [F.col(f"`{n}`").asc_nulls_first() if o == "asc" else F.col(f"`{n}`").desc_nulls_last() for n, o in zip(names, orders)]
    return table.orderBy(*order).limit(int(p.get("size", 10)))


def significant(level: Level, name: str, kind: str, p: dict) -> DataFrame:
    """Terms more frequent among the matches than in the whole table: score = (fg% - bg%) x fg% / bg%."""
    fg = _keyed(level, name, key_column(level, kind, p))
    bg_level = Level(level.base, [], level.base, level.id, level.options)
    if p.get("background_filter"):
        bg_level.df = level.base.where(compile_query(level.base, p["background_filter"], id=level.id, **_query_options(level))[0].match)
    bg = _keyed(bg_level, name, key_column(bg_level, kind, p))
    f = fg.df.groupBy(*fg.keys).agg(F.count("*").alias("doc_count"))
    b = bg.df.groupBy(name).agg(F.count("*").alias("bg_count"))
    total = bg_level.df.count()
    if level.keys:
        sizes = level.df.groupBy(*level.keys).agg(F.count("*").alias("__fg"))
        f = f.join(sizes, level.keys)
    else:
        f = f.withColumn("__fg", F.lit(level.df.count()))
    j = f.where(F.col("doc_count") >= int(p.get("min_doc_count", 3))).join(b, name)
    a, c = F.col("doc_count") / F.col("__fg"), F.col("bg_count") / F.lit(total)
    j = j.withColumn("score", (a - c) * a / c).where("score > 0").drop("__fg")
    return _top(j, level.keys, [F.desc("score"), F.asc(f"`{name}`")], int(p.get("size", 10)))


def _auto_date(level: Level, name: str, p: dict) -> Level:
    """Rows keyed by an interval that the table's first and last time and the wanted number of buckets decide."""
    col = level.col(p["field"])[0].cast("timestamp_ntz")
    lo, hi = level.df.agg(F.min(col), F.max(col)).first()
    if lo is None:
        inner = _keyed(level, name, col)
        inner.options = {**level.options, "__auto": ("d", 1)}
        return inner
    unit, k = dates.auto_interval(lo, hi, int(p.get("buckets", 10)))
    if unit in ("M", "y"):
        start = dates.floor(lo, unit)
        months = (F.year(col) * 12 + F.month(col)) - (start.year * 12 + start.month)
        per = k * (12 if unit == "y" else 1)
        key = F.expr(f"TIMESTAMP_NTZ'{start.isoformat(sep=' ')}'") + F.make_interval(months=(F.floor(months / per) * per).cast("int"))
    else:
        step = k * dates.UNIT_MS[unit]
        origin = int((dates.floor(lo, unit) - datetime(1970, 1, 1)).total_seconds() * 1000)
        key = _from_ms(F.floor((_epoch_ms(level, p["field"]) - origin) / step) * step + origin)
    inner = _keyed(level, name, key)
    inner.options = {**level.options, "__auto": (unit, k)}
    return inner


def variable_width(level: Level, name: str, p: dict) -> DataFrame:
    """Clusters of neighbouring values. Values are first counted; where there are more than max(5000, 50 x buckets) distinct ones, neighbours are put together
    into at most that many groups of equal weight. Only the groups are merged in one task per parent.
    """
    import pandas as pd
    import pyarrow as pa

    want, keys = int(p.get("buckets", 10)), list(level.keys)
    cap = max(5000, 50 * want)
    v = _number(level, p)
    counts = level.df.select(*level.keys, v.alias("__v")).where("__v is not null").groupBy(*level.keys, "__v").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*level.keys)
    per = F.when(F.count("*").over(w) > cap, F.ceil(F.sum("n").over(w) / cap)).otherwise(1)
    counts = counts.withColumns({"__per": per.cast("long"), "__first": (F.row_number().over(w.orderBy("__v")) == 1) | F.isnan("__v")}).sortWithinPartitions(*level.keys, "__v")

    def number(batches):
        """Numbers the groups along the sorted values: a group ends when it has its weight, as upstream does, and before a NaN."""
        g, weight = 0, 0
        for b in batches:
            groups = []
            for n, per, first in zip(*(b.column(c).to_pylist() for c in ("n", "__per", "__first"))):
                if first or weight >= per:
                    g, weight = g + 1, 0
                weight += n
                groups.append(g)
            yield b.append_column("__g", pa.array(groups, pa.int64()))

    numbered = counts.mapInArrow(number, T.StructType([*counts.schema.fields, T.StructField("__g", T.LongType())]))
    cells = numbered.groupBy(*level.keys, "__g").agg(F.sum("n").alias("n"), F.sum(F.col("__v") * F.col("n")).alias("s"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        import heapq

        pdf = pdf.sort_values("lo").reset_index(drop=True)
        n, s, lo, hi = (pdf[c].tolist() for c in ("n", "s", "lo", "hi"))
        m = len(n)
        nxt, prv, alive, ver = list(range(1, m + 1)), list(range(-1, m - 1)), [True] * m, [0] * m

        def gap(i, j):
            d = s[j] / n[j] - s[i] / n[i]
            return d if d == d else float("inf")  # a NaN has no order, which the heap needs

        heap = [(gap(i, i + 1), i, 0, 0) for i in range(m - 1)]
        heapq.heapify(heap)
        left = m
        while left > want and heap:
            _, i, vi, vj = heapq.heappop(heap)
            j = nxt[i] if alive[i] else m
            if not alive[i] or j >= m or ver[i] != vi or ver[j] != vj:
                continue
            n[i], s[i], hi[i], alive[j] = n[i] + n[j], s[i] + s[j], hi[j], False
            ver[i] += 1
            nxt[i] = nxt[j]
            if nxt[i] < m:
                k = nxt[i]
                prv[k] = i
                heapq.heappush(heap, (gap(i, k), i, ver[i], ver[k]))
            if prv[i] >= 0:
                h = prv[i]
                heapq.heappush(heap, (gap(h, i), h, ver[h], ver[i]))
            left -= 1
        keep = [i for i in range(m) if alive[i]]
        made = pd.DataFrame({"key": [s[i] / n[i] for i in keep], "min": [lo[i] for i in keep], "max": [hi[i] for i in keep], "doc_count": [n[i] for i in keep]})
        for k in keys:
            made[k] = pdf[k].iloc[0]
        return made[[*keys, "key", "min", "max", "doc_count"]]

    schema = T.StructType([cells.schema[k] for k in level.keys] + [T.StructField(c, T.DoubleType()) for c in ("key", "min", "max")] + [T.StructField("doc_count", T.LongType())])
    grouped = cells.groupBy(*(level.keys or [F.lit("all").alias("__all")]))
    return grouped.applyInPandas(merge, schema).withColumnRenamed("key", name)
