from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.errors import PySparkException

from searchloom.operators.aggs import run_aggs
from searchloom.plans.query import QueryError

GEO = {"geo": {"loc": ("lat", "lon")}}


def hourly(spark, values):
    t = datetime(2022, 1, 1)
    return spark.createDataFrame([(i, t + timedelta(hours=i), float(v)) for i, v in enumerate(values)], "_id int, ts timestamp_ntz, v double")


def pipe(spark, values, spec, name="x"):
    aggs = {"h": {"date_histogram": {"field": "ts", "fixed_interval": "1h"}, "aggs": {"s": {"sum": {"field": "v"}}, name: spec}}}
    return [r[name] for r in run_aggs(hourly(spark, values), aggs)["h"].orderBy("h").collect()]


@pytest.mark.parametrize(
    "values,spec,want",
    [
        ([1, 2, 1, 4, 5, 9], {"moving_fn": {"buckets_path": "s", "window": 2, "script": "MovingFunctions.min(values)"}}, [None, 1, 1, 1, 1, 4]),
        ([1, 2, 1, 4, 5, 9], {"derivative": {"buckets_path": "s"}}, [None, 1, -1, 3, 1, 4]),
        ([1, 2, 3, 1], {"serial_diff": {"buckets_path": "s", "lag": 2}}, [None, None, 2, -1]),
        ([1, 2, 1], {"cumulative_sum": {"buckets_path": "s"}}, [1, 3, 4]),
        ([1, 2, 1], {"bucket_script": {"buckets_path": {"a": "s", "n": "_count"}, "script": "params.a / params.n * 10"}}, [10, 20, 10]),
    ],
)
def test_parent_pipelines(spark, values, spec, want):
    assert pipe(spark, values, spec) == want


def test_sibling_pipelines(spark):
    aggs = {
        "h": {"date_histogram": {"field": "ts", "fixed_interval": "1h"}, "aggs": {"s": {"sum": {"field": "v"}}}},
        "p": {"percentiles_bucket": {"buckets_path": "h>s"}},
        "e": {"extended_stats_bucket": {"buckets_path": "h>s"}},
        "m": {"max_bucket": {"buckets_path": "h>s"}},
    }
    out = run_aggs(hourly(spark, [1, 2, 1]), aggs)
    p = out["p"].first()
    assert (p["p_1"], p["p_50"], p["p_75"], p["p_99"]) == (1.0, 1.0, 2.0, 2.0)
    e = out["e"].first()
    assert (e["e_sum"], e["e_sum_of_squares"], round(e["e_variance"], 3), round(e["e_variance_sampling"], 3)) == (4.0, 6.0, 0.222, 0.333)
    assert out["m"].first()["m_keys"] == ["2022-01-01 01:00:00"]


def test_percentiles_interpolate(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate((1, 51, 101, 151))], "_id int, v int")
    r = run_aggs(df, {"p": {"percentiles": {"field": "v"}}})["_metrics"].first()
    assert [round(r[f"p_{q}"], 6) for q in (1, 5, 25, 50, 75, 95, 99)] == [2.5, 8.5, 38.5, 76, 113.5, 143.5, 149.5]


def test_variable_width(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate((-3, -2, 1, 4, 5, 6, 7, 8, 9, 10, 11))], "_id int, v int")
    r = run_aggs(df, {"k": {"variable_width_histogram": {"field": "v", "buckets": 3}}})["k"].orderBy("k").collect()
    assert [(round(x["k"], 3), x["doc_count"]) for x in r] == [(-1.333, 3), (5.5, 4), (9.5, 4)]


def test_variable_width_of_many_values_with_an_outlier(spark):
    v = [float(c * 1000 + i / 10) for c in range(4) for i in range(2000)] + [1e9]
    df = spark.createDataFrame([(k, i, x) for k in (None, "a") for i, x in enumerate(v)], "p string, _id int, v double")
    agg = {"variable_width_histogram": {"field": "v", "buckets": 5}}
    want = [(0.0, 199.9, 2000), (1000.0, 1199.9, 2000), (2000.0, 2199.9, 2000), (3000.0, 3199.9, 2000), (1e9, 1e9, 1)]
    assert [(x["min"], x["max"], x["doc_count"]) for x in run_aggs(df.where("p = 'a'"), {"k": agg})["k"].orderBy("k").collect()] == want
    by = run_aggs(df, {"p": {"terms": {"field": "p", "missing": "none"}, "aggs": {"k": agg}}})["p>k"].orderBy("p", "k").collect()
    assert [(x["p"], x["min"], x["max"], x["doc_count"]) for x in by] == [(p, *x) for p in ("a", "none") for x in want]


def test_variable_width_sets_nan_apart(spark):
    df = spark.createDataFrame(list(enumerate([1.0, 2.0, 10.0, 11.0, 30.0, float("nan"), float("nan")])), "_id int, v double")
    r = run_aggs(df, {"k": {"variable_width_histogram": {"field": "v", "buckets": 4}}})["k"].orderBy("min").collect()
    assert [x["doc_count"] for x in r if x["min"] is not None and x["min"] == x["min"]] == [2, 2, 1] and sum(x["doc_count"] for x in r) == 7


def test_variable_width_groups_have_equal_weight(spark):
    rows = [(i, float(i)) for i in range(6001) for _ in range(1 + i % 3)]
    per, got, weight = -(-len(rows) // 5000), [], 0
    for i in range(6001):
        weight += 1 + i % 3
        if weight >= per or i == 6000:
            got.append(weight)
            weight = 0
    k = run_aggs(spark.createDataFrame(rows, "_id int, v double"), {"k": {"variable_width_histogram": {"field": "v", "buckets": 100}}})["k"].orderBy("k").collect()
    ends = {sum(got[: n + 1]) for n in range(len(got))}
    assert len(k) == 100 and {sum(x["doc_count"] for x in k[: n + 1]) for n in range(100)} <= ends


def test_auto_date(spark):
    d = [datetime(2020, 3, 1), datetime(2020, 3, 2), datetime(2020, 3, 8), datetime(2020, 3, 9)]
    df = spark.createDataFrame(list(enumerate(d)), "_id int, d timestamp_ntz")
    r = run_aggs(df, {"k": {"auto_date_histogram": {"field": "d", "buckets": 2}}})["k"].orderBy("k").collect()
    assert [(x["k"], x["doc_count"]) for x in r] == [(d[0], 2), (d[2], 2)]


def test_geo(spark):
    pts = [(52.374081, 4.912350), (52.369219, 4.901618), (52.371667, 4.914722), (51.2229, 4.4052), (48.861111, 2.336389), (48.86, 2.327)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "_id int, lat double, lon double")
    out = run_aggs(df, {"h": {"geohash_grid": {"field": "loc", "precision": 5}}, "t": {"geotile_grid": {"field": "loc", "precision": 7}}, "c": {"geo_centroid": {"field": "loc"}}}, **GEO)
    assert {r["h"]: r["doc_count"] for r in out["h"].collect()} == {"u173z": 3, "u155k": 1, "u09tv": 1, "u09tu": 1}
    assert {r["t"]: r["doc_count"] for r in out["t"].collect()} == {"7/65/42": 4, "7/64/44": 2}
    assert round(out["_metrics"].first()["c_lat"], 6) == 51.009830


def test_ip(spark):
    df = spark.createDataFrame([(i, f"192.168.{1 + i // 5}.{i}") for i in range(10)] + [(10, None), (11, "::1")], "_id int, ip string")
    out = run_aggs(df, {"p": {"ip_prefix": {"field": "ip", "prefix_length": 24}}, "r": {"ip_range": {"field": "ip", "ranges": [{"mask": "192.168.1.0/24"}, {"from": "192.168.2.0"}]}}})
    assert {r["p"]: r["doc_count"] for r in out["p"].collect()} == {"192.168.1.0": 5, "192.168.2.0": 5}
    assert {r["r"]: r["doc_count"] for r in out["r"].collect()} == {"192.168.1.0/24": 5, "192.168.2.0-*": 5}


def test_scripted_metric(spark):
    df = spark.createDataFrame([(1, "sale", 80.0), (2, "cost", 10.0), (3, "cost", 30.0), (4, "sale", 130.0)], "_id int, k string, a double")
    r = run_aggs(df, {"p": {"scripted_metric": {"map_script": "doc['k'].value == 'sale' ? doc['a'].value : -doc['a'].value"}}})
    assert r["_metrics"].first()["p"] == 170.0


def test_gap_filling_and_limits(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 31.0)], "_id int, v double")
    r = run_aggs(df, {"h": {"histogram": {"field": "v", "interval": 10, "extended_bounds": {"min": -10, "max": 50}}, "aggs": {"s": {"sum": {"field": "v"}}, "a": {"avg": {"field": "v"}}}}})["h"].orderBy("h").collect()
    assert [(x["h"], x["doc_count"], x["s"], x["a"]) for x in r][:3] == [(-10.0, 0, 0.0, None), (0.0, 1, 1.0, 1.0), (10.0, 0, 0.0, None)] and r[-1]["h"] == 50.0
    with pytest.raises(PySparkException):
        run_aggs(df, {"h": {"histogram": {"field": "v", "interval": 0.001}}}, max_buckets=100)["h"].collect()


def test_significant_text(spark):
    rows = [(1, "good", "good"), (2, "good", "good"), (3, "bad", "bad"), (4, "bad", "bad"), (5, "good bad", "good"), (6, "good bad", "bad"), (7, "bad", "bad")]
    df = spark.createDataFrame(rows, "_id int, text string, class string")
    out = run_aggs(df, {"c": {"terms": {"field": "class"}, "aggs": {"s": {"significant_text": {"field": "text"}}}}})["c>s"]
    assert {(r["c"], r["s"]) for r in out.collect()} == {("good", "good"), ("bad", "bad")}


def test_empty_table(spark):
    df = hourly(spark, [1]).limit(0)
    out = run_aggs(df, {"t": {"terms": {"field": "v"}}, "h": {"date_histogram": {"field": "ts", "calendar_interval": "day"}}, "s": {"stats": {"field": "v"}}, "x": {"extended_stats": {"field": "v"}}})
    assert out["t"].count() == 0 and out["h"].count() == 0 and out["_metrics"].first()["s_count"] == 0


def test_unknown_aggregation(spark):
    with pytest.raises(QueryError):
        run_aggs(hourly(spark, [1]), {"t": {"nope": {"field": "v"}}})
