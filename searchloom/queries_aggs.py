"""Queries of aggregations, each from its request document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.operators.aggs import run_aggs
from searchloom.plans.search import search
from searchloom.queries_search import CUSTOMER_GEO, GEO, _customers, _orders_nested, _tags, table, tok

R = 4


def _agg(name: str, key: str, aggs: dict, path: str, prepare=None, query: dict | None = None, digits: int = R, strip: str = "", drop=(), **options):
    """One table of an aggregation tree; doubles are rounded and a prefix of the metric's name is taken off."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, name)
        if prepare:
            df = prepare(df, spark, sf)
        if query:
            t = search(df, {"query": query, "size": 0, "aggs": aggs}, key, **options).aggs[path]
        else:
            t = run_aggs(df, aggs, id=key, **options)[path]
        out = []
        for c, kind in t.dtypes:
            if c in drop:
                continue
            col = F.round(F.col(f"`{c}`"), digits) if kind == "double" else F.col(f"`{c}`")
            out.append(col.alias(c.removeprefix(strip)))
        return t.select(*out)

    return run


def _metric(kind: str, p: dict, name: str = "lineitem", key: str = "l_orderkey", **how):
    return _agg(name, key, {"m": {kind: p}}, "_metrics", strip="m_", drop=("doc_count",), **how)


def _line_id(df, *_):
    return df.withColumn("line_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


def _events_ip(df, *_):
    u = F.col("user_id")
    return df.withColumn("ip", F.concat_ws(".", F.lit("10"), F.pmod(F.floor(u / 65536), F.lit(256)).cast("string"), F.pmod(F.floor(u / 256), F.lit(256)).cast("string"), F.pmod(u, F.lit(256)).cast("string")))


PRICE = {"field": "l_extendedprice"}
MONTHLY = {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month"}}


def _monthly(pipe: dict, path: str = "months", **how):
    sibling = next(iter(pipe.values()))
    kind = next(iter(sibling))
    if kind.endswith("_bucket") and kind not in ("bucket_script",):
        return _agg("orders", "o_orderkey", {"months": MONTHLY | {"aggs": {"total": {"sum": {"field": "o_totalprice"}}}}} | pipe, next(iter(pipe)), **{"digits": 2} | how)
    return _agg("orders", "o_orderkey", {"months": MONTHLY | {"aggs": {"total": {"sum": {"field": "o_totalprice"}}} | pipe}}, path, **{"digits": 2} | how)


FLAGS = {"a": {"term": {"l_returnflag": "R"}}, "b": {"range": {"l_quantity": {"gte": 25}}}, "c": {"term": {"l_linestatus": "O"}}}

QUERIES = {
    "m_avg": _metric("avg", PRICE),
    "m_sum": _metric("sum", PRICE, digits=1),
    "m_min": _metric("min", PRICE),
    "m_max": _metric("max", PRICE),
    "m_value_count": _metric("value_count", {"field": "duration_ms"}, "error_logs", "span_id"),
    "m_stats": _metric("stats", {"field": "l_quantity"}),
    "m_extended_stats": _metric("extended_stats", {"field": "l_quantity"}),
    "m_cardinality": _metric("cardinality", {"field": "l_partkey"}),
    "m_percentiles": _metric("percentiles", PRICE),
    "m_percentile_ranks": _metric("percentile_ranks", {"field": "l_extendedprice", "values": [10000, 30000.5]}),
    "m_mad": _metric("median_absolute_deviation", PRICE),
    "m_boxplot": _metric("boxplot", PRICE),
    "m_matrix_stats": _metric("matrix_stats", {"fields": ["l_quantity", "l_extendedprice"]}, digits=3),
    "m_string_stats": _metric("string_stats", {"field": "p_type"}, "part", "p_partkey"),
    "m_top_metrics": _metric("top_metrics", {"sort": [{"o_totalprice": "desc"}], "metrics": [{"field": "o_custkey"}, {"field": "o_orderstatus"}]}, "orders", "o_orderkey"),
    "m_top_hits": _agg("orders", "o_orderkey", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"top": {"top_hits": {"sort": [{"o_totalprice": "desc"}], "size": 2, "_source": ["o_orderkey", "o_totalprice"]}}}}}, "s>top"),
    "m_scripted": _metric("scripted_metric", {"map_script": "doc['l_returnflag'].value == 'R' ? -doc['l_extendedprice'].value : doc['l_extendedprice'].value"}, digits=1),
    "m_geo_bounds": _metric("geo_bounds", {"field": "loc"}, "customer", "c_custkey", prepare=_customers, **GEO),
    "m_geo_centroid": _metric("geo_centroid", {"field": "loc"}, "customer", "c_custkey", prepare=_customers, **GEO),
    "m_weighted_avg": _metric("weighted_avg", {"value": {"field": "l_extendedprice"}, "weight": {"field": "l_quantity"}}),
    "b_terms": _agg("lineitem", "l_orderkey", {"k": {"terms": {"field": "l_suppkey", "size": 7, "show_other": True}}}, "k"),
    "b_terms_sub": _agg("lineitem", "l_orderkey", {"by_flag": {"terms": {"field": "l_returnflag"}, "aggs": {"q": {"sum": {"field": "l_quantity"}}, "p": {"avg": PRICE}}}}, "by_flag", query={"bool": {"filter": [{"range": {"l_shipdate": {"gte": "1995-01-01"}}}]}}),
    "b_terms_nested": _agg("orders", "o_orderkey", {"c": {"terms": {"field": "o_custkey", "size": 5, "order": {"spent": "desc"}}, "aggs": {"spent": {"sum": {"field": "o_totalprice"}}, "s": {"terms": {"field": "o_orderstatus", "size": 2}}}}}, "c>s"),
    "b_terms_multivalue": _agg("part", "p_partkey", {"k": {"terms": {"field": "tags", "size": 20}}}, "k", prepare=_tags),
    "b_terms_include": _agg("orders", "o_orderkey", {"k": {"terms": {"field": "o_orderpriority", "include": "[1-3].*", "order": {"_key": "asc"}}}}, "k"),
    "b_multi_terms": _agg("lineitem", "l_orderkey", {"k": {"multi_terms": {"terms": [{"field": "l_returnflag"}, {"field": "l_linestatus"}]}}}, "k"),
    "b_rare_terms": _agg("lineitem", "l_orderkey", {"k": {"rare_terms": {"field": "l_partkey", "max_doc_count": 15}}}, "k"),
    "b_significant_terms": _agg("error_logs", "span_id", {"k": {"significant_terms": {"field": "service"}}}, "k", query={"term": {"level": "ERROR"}}),
    "b_significant_text": _agg("documents", "doc_id", {"k": {"significant_text": {"field": "text"}}}, "k", query={"prefix": {"source": "releases"}}),
    "b_range": _agg("lineitem", "l_orderkey", {"k": {"range": {"field": "l_quantity", "ranges": [{"to": 10}, {"from": 10, "to": 30}, {"from": 20}, {"from": 900, "key": "none"}]}, "aggs": {"p": {"avg": PRICE}}}}, "k"),
    "b_date_range": _agg("orders", "o_orderkey", {"k": {"date_range": {"field": "o_orderdate", "ranges": [{"to": "1995-01-01", "key": "old"}, {"from": "1995-01-01", "to": "1996-01-01||+6M/M", "key": "mid"}]}}}, "k"),
    "b_ip_range": _agg("events", "event_id", {"k": {"ip_range": {"field": "ip", "ranges": [{"to": "10.0.1.0"}, {"mask": "10.0.1.0/24"}, {"from": "10.0.2.0"}]}}}, "k", prepare=_events_ip),
    "b_ip_prefix": _agg("events", "event_id", {"k": {"ip_prefix": {"field": "ip", "prefix_length": 24}}}, "k", prepare=_events_ip),
    "b_histogram": _agg("lineitem", "l_orderkey", {"k": {"histogram": {"field": "l_extendedprice", "interval": 1000, "offset": 100}, "aggs": {"q": {"sum": {"field": "l_quantity"}}}}}, "k"),
    "b_date_histogram": _agg("orders", "o_orderkey", {"k": {"date_histogram": {"field": "o_orderdate", "fixed_interval": "90d"}}}, "k"),
    "b_date_histogram_calendar": _agg("orders", "o_orderkey", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"k": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "week"}, "aggs": {"t": {"sum": {"field": "o_totalprice"}}}}}}}, "s>k"),
    "b_auto_date": _agg("orders", "o_orderkey", {"k": {"auto_date_histogram": {"field": "o_orderdate", "buckets": 10}}}, "k"),
    "b_vwh": _agg("part", "p_partkey", {"k": {"variable_width_histogram": {"field": "p_retailprice", "buckets": 6}}}, "k"),
    "b_filter": _agg("lineitem", "l_orderkey", {"k": {"filter": {"term": {"l_returnflag": "R"}}, "aggs": {"p": {"avg": PRICE}}}}, "k"),
    "b_filters": _agg("lineitem", "l_orderkey", {"k": {"filters": {"filters": FLAGS, "other_bucket": True}, "aggs": {"q": {"sum": {"field": "l_quantity"}}}}}, "k"),
    "b_missing": _agg("error_logs", "span_id", {"k": {"missing": {"field": "trace_id"}, "aggs": {"d": {"max": {"field": "duration_ms"}}}}}, "k"),
    "b_composite": _agg("lineitem", "l_orderkey", {"k": {"composite": {"size": 40, "sources": [{"flag": {"terms": {"field": "l_returnflag"}}}, {"q": {"histogram": {"field": "l_quantity", "interval": 5}}}]}, "aggs": {"p": {"max": PRICE}}}}, "k"),
    "b_composite_after": _agg("lineitem", "l_orderkey", {"k": {"composite": {"size": 12, "after": {"flag": "N", "m": "1996-05-01 00:00:00"}, "sources": [{"flag": {"terms": {"field": "l_returnflag"}}}, {"m": {"date_histogram": {"field": "l_shipdate", "calendar_interval": "month"}}}]}}}, "k"),
    "b_adjacency": _agg("lineitem", "l_orderkey", {"k": {"adjacency_matrix": {"filters": FLAGS}}}, "k"),
    "b_global": _agg("lineitem", "l_orderkey", {"k": {"global": {}, "aggs": {"p": {"avg": PRICE}}}}, "k", query={"term": {"l_returnflag": "R"}}),
    "b_time_series": _agg("error_logs", "span_id", {"k": {"time_series": {"dimensions": ["service", "hostname"]}, "aggs": {"d": {"max": {"field": "duration_ms"}}}}}, "k"),
    "b_sampler": _agg("orders", "o_orderkey", {"k": {"sampler": {"shard_size": 300}, "aggs": {"p": {"avg": {"field": "o_totalprice"}}}}}, "k"),
    "b_diversified": _agg("orders", "o_orderkey", {"k": {"diversified_sampler": {"field": "o_custkey", "shard_size": 200, "max_docs_per_value": 2}, "aggs": {"p": {"avg": {"field": "o_totalprice"}}}}}, "k"),
    "b_nested": _agg("orders", "o_orderkey", {"n": {"nested": {"path": "lines"}, "aggs": {"k": {"terms": {"field": "lines.l_returnflag"}, "aggs": {"q": {"sum": {"field": "lines.l_quantity"}}}}}}}, "n>k", prepare=_orders_nested),
    "b_reverse_nested": _agg("orders", "o_orderkey", {"n": {"nested": {"path": "lines"}, "aggs": {"k": {"terms": {"field": "lines.l_returnflag"}, "aggs": {"r": {"reverse_nested": {}, "aggs": {"t": {"sum": {"field": "o_totalprice"}}}}}}}}}, "n>k>r", prepare=_orders_nested, digits=1),
    "b_geo_distance": _agg("customer", "c_custkey", {"k": {"geo_distance": {"field": "loc", "origin": {"lat": 40.0, "lon": -70.0}, "unit": "km", "ranges": [{"to": 2000, "key": "near"}, {"from": 2000, "to": 9000, "key": "mid"}, {"from": 9000, "key": "far"}]}}}, "k", prepare=_customers, **GEO),
    "b_geohash": _agg("customer", "c_custkey", {"k": {"geohash_grid": {"field": "loc", "precision": 3}}}, "k", prepare=_customers, **GEO),
    "b_geotile": _agg("customer", "c_custkey", {"k": {"geotile_grid": {"field": "loc", "precision": 4}}}, "k", prepare=_customers, **GEO),
    "w_avg_bucket": _monthly({"x": {"avg_bucket": {"buckets_path": "months>total"}}}),
    "w_sum_bucket": _monthly({"x": {"sum_bucket": {"buckets_path": "months>total"}}}),
    "w_min_bucket": _monthly({"x": {"min_bucket": {"buckets_path": "months>total"}}}),
    "w_max_bucket": _monthly({"x": {"max_bucket": {"buckets_path": "months>_count"}}}),
    "w_stats_bucket": _monthly({"x": {"stats_bucket": {"buckets_path": "months>total"}}}, strip="x_"),
    "w_extended_stats_bucket": _monthly({"x": {"extended_stats_bucket": {"buckets_path": "months>_count"}}}, strip="x_", digits=3),
    "w_percentiles_bucket": _monthly({"x": {"percentiles_bucket": {"buckets_path": "months>total", "percents": [25, 50, 90]}}}, strip="x_"),
    "w_derivative": _monthly({"x": {"derivative": {"buckets_path": "total"}}}),
    "w_cumulative_sum": _monthly({"x": {"cumulative_sum": {"buckets_path": "_count"}}}),
    "w_serial_diff": _monthly({"x": {"serial_diff": {"buckets_path": "_count", "lag": 12}}}),
    "w_moving_avg": _monthly({"x": {"moving_avg": {"buckets_path": "_count", "window": 4}}}),
    "w_moving_fn_min": _monthly({"x": {"moving_fn": {"buckets_path": "_count", "window": 3, "script": "MovingFunctions.min(values)"}}}),
    "w_moving_fn_ewma": _monthly({"x": {"moving_fn": {"buckets_path": "_count", "window": 5, "script": "MovingFunctions.ewma(values, 0.4)"}}}),
    "w_bucket_script": _monthly({"x": {"bucket_script": {"buckets_path": {"t": "total", "n": "_count"}, "script": "params.t / params.n"}}}),
    "w_bucket_selector": _monthly({"x": {"bucket_selector": {"buckets_path": {"n": "_count"}, "script": "params.n > 185"}}}),
    "w_bucket_sort": _monthly({"x": {"bucket_sort": {"sort": [{"total": "desc"}], "from": 2, "size": 6}}}),
}


def _one(select: str, source: str = "lineitem") -> str:
    return f"select {select} from {source}"


_Q = "round(quantile_cont(l_extendedprice, {p}), 4) as \"{n}\""
_MONTHS = "with m as (select date_trunc('month', o_orderdate)::timestamp as months, count(*) doc_count, sum(o_totalprice) total from orders group by 1)"
_SPINE = _MONTHS + ", s as (select unnest(generate_series(min(months), max(months), interval 1 month)) as months from m), g as (select months, coalesce(doc_count, 0) doc_count, coalesce(total, 0) total from s left join m using (months))"
_GEOJ = CUSTOMER_GEO
_HAV = "2 * 6371008.7714 * asin(sqrt(least(1.0, pow(sin(radians(lat - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(lat)) * pow(sin(radians(lon - -70.0) / 2), 2))))"
_IP = "(select *, 10 * 16777216 + (user_id // 65536 % 256) * 65536 + (user_id // 256 % 256) * 256 + user_id % 256 ip from events)"
_FLAGS = "(select *, l_returnflag = 'R' a, l_quantity >= 25 b, l_linestatus = 'O' c from lineitem)"


def _moment(x: str) -> str:
    return f"count({x}) as \"{x}_count\", round(avg({x}), 3) as \"{x}_mean\", round(var_samp({x}), 3) as \"{x}_variance\""


_M3 = "round(avg(pow({x} - m_{x}, 3)) / pow(avg(pow({x} - m_{x}, 2)), 1.5), 3) as {x}_skewness, round(avg(pow({x} - m_{x}, 4)) / pow(avg(pow({x} - m_{x}, 2)), 2), 3) as {x}_kurtosis"

SQL = {
    "m_avg": _one("round(avg(l_extendedprice), 4) m"),
    "m_sum": _one("round(sum(l_extendedprice), 1) m"),
    "m_min": _one("min(l_extendedprice) m"),
    "m_max": _one("max(l_extendedprice) m"),
    "m_value_count": _one("count(duration_ms) m", "error_logs"),
    "m_stats": _one("count(l_quantity) as count, min(l_quantity) as min, max(l_quantity) as max, round(avg(l_quantity), 4) as avg, sum(l_quantity) as sum"),
    "m_extended_stats": _one("""count(l_quantity) as count, min(l_quantity) as min, max(l_quantity) as max, round(avg(l_quantity), 4) as avg, sum(l_quantity) as sum, sum(l_quantity * l_quantity) sum_of_squares,
round(var_pop(l_quantity), 4) as variance, round(var_pop(l_quantity), 4) variance_population, round(var_samp(l_quantity), 4) variance_sampling, round(stddev_pop(l_quantity), 4) std_deviation,
round(stddev_samp(l_quantity), 4) std_deviation_sampling, round(avg(l_quantity) + 2 * stddev_pop(l_quantity), 4) as upper, round(avg(l_quantity) - 2 * stddev_pop(l_quantity), 4) as lower"""),
    "m_cardinality": _one("count(distinct l_partkey) m"),
    "m_percentiles": _one(", ".join(_Q.format(p=p / 100, n=n) for p, n in ((1, "1"), (5, "5"), (25, "25"), (50, "50"), (75, "75"), (95, "95"), (99, "99")))),
    "m_percentile_ranks": _one("round(100.0 * avg((l_extendedprice <= 10000)::int), 4) as \"10000\", round(100.0 * avg((l_extendedprice <= 30000.5)::int), 4) as \"30000_5\""),
    "m_mad": _one("round(mad(l_extendedprice), 4) m"),
    "m_boxplot": _one("min(l_extendedprice) as min, max(l_extendedprice) as max, " + ", ".join(_Q.format(p=p, n=n) for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3")))),
    "m_matrix_stats": "select " + ", ".join(_moment(x) + ", " + _M3.format(x=x) for x in ("l_quantity", "l_extendedprice")) + ", round(covar_samp(l_quantity, l_extendedprice), 3) l_quantity_l_extendedprice_covariance, round(corr(l_quantity, l_extendedprice), 3) l_quantity_l_extendedprice_correlation from lineitem, (select avg(l_quantity) m_l_quantity, avg(l_extendedprice) m_l_extendedprice from lineitem)",
    "m_string_stats": "with c as (select unnest(string_split(p_type, '')) c from part), n as (select c, count(*) n from c group by c) select count(*) as count, min(len(p_type))::int min_length, max(len(p_type))::int max_length, round(avg(len(p_type)), 4) avg_length, (select round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 4) from n) entropy from part",
    "m_top_metrics": "select o_custkey, o_orderstatus from orders order by o_totalprice desc, o_orderkey limit 1",
    "m_top_hits": "select o_orderstatus s, o_orderkey, o_totalprice, row_number() over (partition by o_orderstatus order by o_totalprice desc, o_orderkey)::int as rank from orders qualify rank <= 2",
    "m_scripted": _one("round(sum(case when l_returnflag = 'R' then -l_extendedprice else l_extendedprice end), 1) m"),
    "m_geo_bounds": f"select max(lat)::double as top, min(lon)::double as \"left\", min(lat)::double as bottom, max(lon)::double as \"right\" from {_GEOJ}",
    "m_geo_centroid": f"select round(avg(lat), 4) lat, round(avg(lon), 4) lon, count(*) as count from {_GEOJ}",
    "m_weighted_avg": _one("round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) m"),
    "b_terms": "with t as (select l_suppkey k, count(*) doc_count from lineitem group by 1), k as (select * from t order by doc_count desc, k limit 7) select k, doc_count, ((select sum(doc_count) from t) - (select sum(doc_count) from k))::bigint sum_other_doc_count from k",
    "b_terms_sub": "select l_returnflag by_flag, count(*) doc_count, round(sum(l_quantity), 4) q, round(avg(l_extendedprice), 4) p from lineitem where l_shipdate >= timestamp '1995-01-01' group by 1",
    "b_terms_nested": "with c as (select o_custkey c, sum(o_totalprice) spent from orders group by 1 order by spent desc, c limit 5) select o_custkey c, o_orderstatus s, count(*) doc_count from orders where o_custkey in (select c from c) group by 1, 2 qualify row_number() over (partition by o_custkey order by count(*) desc, o_orderstatus) <= 2",
    "b_terms_multivalue": "select k, count(*) doc_count from (select unnest(list_distinct(string_split(p_name, ' '))) k from part) group by k order by doc_count desc, k limit 20",
    "b_terms_include": "select o_orderpriority k, count(*) doc_count from orders where regexp_full_match(o_orderpriority, '[1-3].*') group by 1",
    "b_multi_terms": "select l_returnflag || '|' || l_linestatus k, count(*) doc_count from lineitem group by 1 order by 2 desc, 1 limit 10",
    "b_rare_terms": "select l_partkey k, count(*) doc_count from lineitem group by 1 having count(*) <= 15",
    "b_significant_terms": "with f as (select service k, count(*) c from error_logs where level = 'ERROR' group by 1 having count(*) >= 3), b as (select service k, count(*) b from error_logs group by 1), n as (select count(*) n, count(*) filter (where level = 'ERROR') f from error_logs), s as (select k, c, b, (c / n.f - b / n.n) * (c / n.f) / (b / n.n) s from f join b using (k), n) select k, c doc_count, b bg_count, round(s, 4) score from s where s > 0 order by s desc, k limit 10",
    "b_significant_text": f"with w as (select doc_id, starts_with(source, 'releases') f, unnest(list_distinct({tok('text')})) k from documents), t as (select k, count(*) b, count(*) filter (where f) c from w group by k having c >= 3), n as (select count(*) n, count(*) filter (where starts_with(source, 'releases')) f from documents), s as (select k, c, b, (c / n.f - b / n.n) * (c / n.f) / (b / n.n) s from t, n) select k, c doc_count, b bg_count, round(s, 4) score from s where s > 0 order by s desc, k limit 10",
    "b_range": "select k, count(l_quantity) doc_count, round(avg(l_extendedprice), 4) p from (values ('*-10.0', -1e9, 10), ('10.0-30.0', 10, 30), ('20.0-*', 20, 1e9), ('none', 900, 1e9)) r(k, lo, hi) left join lineitem on l_quantity >= lo and l_quantity < hi group by k",
    "b_date_range": "select k, count(o_orderkey) doc_count from (values ('old', timestamp '1900-01-01', timestamp '1995-01-01'), ('mid', timestamp '1995-01-01', timestamp '1996-07-01')) r(k, lo, hi) left join orders on o_orderdate >= lo and o_orderdate < hi group by k",
    "b_ip_range": f"select k, count(ip) doc_count from (values ('*-10.0.1.0', 0, 167772416), ('10.0.1.0/24', 167772416, 167772672), ('10.0.2.0-*', 167772672, 1e12)) r(k, lo, hi) left join {_IP} on ip >= lo and ip < hi group by k",
    "b_ip_prefix": f"select '10.' || (ip // 65536 % 256) || '.' || (ip // 256 % 256) || '.0' k, count(*) doc_count from {_IP} group by 1",
    "b_histogram": "with h as (select floor((l_extendedprice - 100) / 1000) * 1000 + 100 k, count(*) doc_count, sum(l_quantity) q from lineitem group by 1), s as (select unnest(generate_series(min(k)::bigint, max(k)::bigint, 1000))::double k from h) select k, coalesce(doc_count, 0) doc_count, coalesce(q, 0) q from s left join h using (k)",
    "b_date_histogram": "with h as (select epoch_ms(o_orderdate) // 7776000000 b, count(*) doc_count from orders group by 1), s as (select unnest(generate_series(min(b), max(b))) b from h) select make_timestamp(b * 7776000000000) k, coalesce(doc_count, 0) doc_count from s left join h using (b)",
    "b_date_histogram_calendar": "with h as (select o_orderstatus s, date_trunc('week', o_orderdate)::timestamp k, count(*) doc_count, sum(o_totalprice) t from orders group by 1, 2), e as (select s, unnest(generate_series(min(k), max(k), interval 7 day)) k from h group by s) select s, k, coalesce(doc_count, 0) doc_count, round(coalesce(t, 0), 4) t from e left join h using (s, k)",
    "b_auto_date": "select date_trunc('year', o_orderdate)::timestamp k, count(*) doc_count from orders group by 1",
    "b_filter": _one("count(*) doc_count, round(avg(l_extendedprice), 4) p", "lineitem where l_returnflag = 'R'"),
    "b_filters": f"select k, count(l_orderkey) doc_count, sum(l_quantity) q from (values ('a'), ('b'), ('c'), ('_other_')) v(k) left join {_FLAGS} x on case k when 'a' then x.a when 'b' then x.b when 'c' then x.c else not (x.a or x.b or x.c) end group by k",
    "b_missing": "select count(*) doc_count, max(duration_ms)::double d from error_logs where trace_id is null",
    "b_composite": "select l_returnflag flag, floor(l_quantity / 5) * 5 q, count(*) doc_count, max(l_extendedprice) p from lineitem group by 1, 2 order by 1, 2 limit 40",
    "b_composite_after": "select l_returnflag flag, date_trunc('month', l_shipdate)::timestamp m, count(*) doc_count from lineitem group by 1, 2 having (flag, m) > ('N', timestamp '1996-05-01') order by 1, 2 limit 12",
    "b_adjacency": f"select * from (select k, count(*) doc_count from (values ('a'), ('b'), ('c'), ('a&b'), ('a&c'), ('b&c')) v(k), {_FLAGS} x where case k when 'a' then x.a when 'b' then x.b when 'c' then x.c when 'a&b' then x.a and x.b when 'a&c' then x.a and x.c else x.b and x.c end group by k)",
    "b_global": _one("count(*) doc_count, round(avg(l_extendedprice), 4) p"),
    "b_time_series": "select 'service=' || service || ',hostname=' || hostname k, count(*) doc_count, max(duration_ms)::double d from error_logs group by 1",
    "b_sampler": "select count(*) doc_count, round(avg(o_totalprice), 4) p from (select * from orders order by o_orderkey limit 300)",
    "b_diversified": "select count(*) doc_count, round(avg(o_totalprice), 4) p from (select * from (select *, row_number() over (partition by o_custkey order by o_orderkey) r from orders) where r <= 2 order by o_orderkey limit 200)",
    "b_nested": "select l_returnflag k, count(*) doc_count, sum(l_quantity) q from lineitem group by 1",
    "b_reverse_nested": "select l_returnflag k, count(*) doc_count, round(sum(o_totalprice), 1) t from (select distinct l_returnflag, o_orderkey, o_totalprice from lineitem join orders on l_orderkey = o_orderkey) group by 1",
    "b_geo_distance": f"select case when d < 2000 then 'near' when d < 9000 then 'mid' else 'far' end k, count(*) doc_count from (select {_HAV} / 1000 d from {_GEOJ}) group by 1",
    "b_geotile": f"select '4/' || least(15, greatest(0, floor((lon + 180) / 360 * 16)::int)) || '/' || least(15, greatest(0, floor((0.5 - ln((1 + s) / (1 - s)) / (4 * pi())) * 16)::int)) k, count(*) doc_count from (select *, sin(radians(greatest(-85.05112878, least(85.05112878, lat)))) s from {_GEOJ}) group by 1",
    "w_avg_bucket": _SPINE + " select round(avg(total), 2) x from g",
    "w_sum_bucket": _SPINE + " select round(sum(total), 2) x from g",
    "w_min_bucket": _SPINE + " select round(min(total), 2) x, list(strftime(months, '%Y-%m-%d %H:%M:%S')) x_keys from g where total = (select min(total) from g)",
    "w_max_bucket": _SPINE + " select max(doc_count)::double x, list(strftime(months, '%Y-%m-%d %H:%M:%S') order by months) x_keys from g where doc_count = (select max(doc_count) from g)",
    "w_stats_bucket": _SPINE + " select count(*) as count, round(min(total), 2) as min, round(max(total), 2) as max, round(avg(total), 2) as avg, round(sum(total), 2) as sum from g",
    "w_extended_stats_bucket": _SPINE + " select count(*) as count, min(doc_count)::double as min, max(doc_count)::double as max, round(avg(doc_count), 3) as avg, sum(doc_count)::double as sum, sum(doc_count * doc_count)::double sum_of_squares, round(var_pop(doc_count), 3) as variance, round(var_samp(doc_count), 3) variance_sampling, round(stddev_pop(doc_count), 3) std_deviation, round(stddev_samp(doc_count), 3) std_deviation_sampling, round(avg(doc_count) + 2 * stddev_pop(doc_count), 3) as upper, round(avg(doc_count) - 2 * stddev_pop(doc_count), 3) as lower from g",
    "w_percentiles_bucket": _SPINE + ", r as (select total, row_number() over (order by total) - 1 i, count(*) over () n from g) select " + ", ".join(f"round(max(total) filter (where i = floor({p} / 100.0 * (n - 1) + 0.5)), 2) as \"{p}\"" for p in (25, 50, 90)) + " from r",
    "w_derivative": _SPINE + " select months, doc_count, round(total, 2) total, round(total - lag(total) over (order by months), 2) x from g",
    "w_cumulative_sum": _SPINE + " select months, doc_count, round(total, 2) total, sum(doc_count) over (order by months)::double x from g",
    "w_serial_diff": _SPINE + " select months, doc_count, round(total, 2) total, (doc_count - lag(doc_count, 12) over (order by months))::double x from g",
    "w_moving_avg": _SPINE + " select months, doc_count, round(total, 2) total, round(avg(doc_count) over (order by months rows between 4 preceding and 1 preceding), 2) x from g",
    "w_moving_fn_min": _SPINE + " select months, doc_count, round(total, 2) total, (min(doc_count) over (order by months rows between 3 preceding and 1 preceding))::double x from g",
    "w_moving_fn_ewma": _SPINE + " select months, doc_count, round(total, 2) total, round(list_reduce(list(doc_count::double) over (order by months rows between 5 preceding and 1 preceding), lambda s, x: x * 0.4 + s * 0.6), 2) x from g",
    "w_bucket_script": _SPINE + " select months, doc_count, round(total, 2) total, round(total / doc_count, 2) x from g",
    "w_bucket_selector": _SPINE + " select months, doc_count, round(total, 2) total from g where doc_count > 185",
    "w_bucket_sort": _SPINE + " select months, doc_count, round(total, 2) total from g order by g.total desc, months limit 6 offset 2",
}
