from __future__ import annotations

import ipaddress
import random
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchloom import catalog, scratch
from searchloom.functions import polytope
from searchloom.functions.embed import embed_with
from searchloom.operators import quantiles, transforms
from searchloom.operators.aggs import _ip_key, run_aggs
from searchloom.operators.quantiles import exact_quantiles
from searchloom.operators.textindex import TextIndex
from searchloom.operators.vectorindex import VectorIndex
from searchloom.plans.eql import parse_eql
from searchloom.plans.indexed import IndexedQuery
from searchloom.plans.query import QueryError, compile_query
from searchloom.plans.search import search
from searchloom.sources import ingest, readers


@pytest.mark.parametrize("buffer", [500_000, -1])
def test_quantiles_equal_brute_force(spark, monkeypatch, buffer):
    monkeypatch.setattr(quantiles, "BUFFER", buffer)
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, float(rng.randrange(-40, 40)), rng.random()])) for _ in range(3000)] + [("one", 5.0), ("none", None)]
    df = spark.createDataFrame(rows, "k string, __v double").withColumn("__n", F.lit(1).cast("bigint"))
    shares = [0.0, 0.1, 0.25, 0.5, 0.99, 1.0]
    got = {r["k"]: r["__q"] for r in exact_quantiles(df, ["k"], shares).collect()}
    for k in ("a", "b", None, "one"):
        v = np.array([x for g, x in rows if g == k and x is not None])
        assert np.allclose(got[k], np.quantile(v, shares), rtol=1e-12)
    assert set(got) == {"a", "b", None, "one"}
    assert exact_quantiles(df.limit(0), ["k"], [0.5]).count() == 0
    whole = exact_quantiles(df, [], [0.5]).first()["__q"][0]
    assert abs(whole - np.quantile([x for _, x in rows if x is not None], 0.5)) < 1e-12


@pytest.mark.parametrize("buffer", [500_000, -1])
def test_rank_metrics_of_buckets_without_values(spark, monkeypatch, buffer):
    monkeypatch.setattr(quantiles, "BUFFER", buffer)
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", 9.0), (3, "b", None)], "_id int, k string, v double")
    subs = {"p": {"percentiles": {"field": "v", "percents": [50]}}, "m": {"median_absolute_deviation": {"field": "v"}}, "b": {"boxplot": {"field": "v", "whiskers": True}}}
    out = {r["k"]: r for r in run_aggs(df, {"k": {"terms": {"field": "k"}, "aggs": subs}})["k"].collect()}
    assert out["a"]["p_50"] == 5.0 and out["a"]["m"] == 4.0 and (out["a"]["b_lower"], out["a"]["b_upper"]) == (1.0, 9.0)
    assert out["b"]["p_50"] is None and out["b"]["m"] is None and out["b"]["b_q2"] is None
    none = run_aggs(df.where("k = 'b'"), {"p": {"percentiles": {"field": "v"}}})["_metrics"].collect()
    assert len(none) == 1 and none[0]["p_50"] is None


def test_text_index_in_segments_equals_the_scan(spark):
    rows = [(1, "the token cache"), (2, "cache of the token"), (3, None), (4, ""), (5, "token token cache token cache"), (6, "other words " * 2000), (7, "cache")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, term string")
    index = TextIndex(spark, scratch.scratch_path(spark, "t")).add(df.where("doc_id < 4"), "doc_id", "text").add(df.where("doc_id >= 4"), "doc_id", "text")
    for q in ("token cache", "words", "absent", ""):
        want = {r["doc_id"]: round(r["_score"], 9) for r in search(df, {"query": {"match": {"text": q}}, "size": 100}, "doc_id").hits.collect()}
        assert {r["id"]: round(r["_score"], 9) for r in index.match(q).collect()} == want
    assert {r["id"] for r in index.match("token cache", "and").collect()} == {1, 2, 5}
    assert {r["id"] for r in index.match("token cache words", minimum_should_match=2).collect()} == {1, 2, 5}
    assert {r["id"] for r in index.phrase("token cache").collect()} == {1, 5}
    assert {r["id"] for r in index.phrase("cache token cache").collect()} == {5}
    assert {r["id"] for r in index.phrase("token the cache").collect()} == set()
    assert [r["term"] for r in index.terms("to").collect()] == ["token"]
    assert index.suggest("tokne").first()["term"] == "token"
    assert "PushedFilters: [" in index.postings(["token"])._jdf.queryExecution().toString() and "In(term" in index.postings(["token", "cache"])._jdf.queryExecution().toString()
    none = TextIndex(spark, scratch.scratch_path(spark, "t")).add(df.limit(0), "doc_id", "text")
    assert none.match("token").count() == 0


def test_vector_index_recall(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 16))
    x = centres[rng.integers(0, 60, 4000)] + 0.2 * rng.normal(size=(4000, 16))
    rows = [(i, [float(e) for e in v]) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [1.0]), (9003, [float("nan")] * 16)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    index = VectorIndex.build(df, "id", "v", scratch.scratch_path(spark, "v"), 16, 200)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, 4000, 400):
        want = set(np.argsort(-(u @ u[i]), kind="stable")[:10].tolist())
        hits += len(want & {r["id"] for r in index.search(x[i].tolist(), 10, 800).collect()})
    assert hits >= 90
    with pytest.raises(ValueError):
        index.search(x[0].tolist(), 10, 5)
    assert VectorIndex.build(df.limit(0), "id", "v", scratch.scratch_path(spark, "v"), 16).search(x[0].tolist()).count() == 0


def test_knn_takes_its_k_best_only(spark):
    df = spark.createDataFrame([(i, [1.0, float(i // 2)]) for i in range(20)] + [(99, None)], "_id long, v array<double>")
    knn = {"field": "v", "query_vector": [1.0, 0.0], "k": 3}
    r = search(df, {"query": {"knn": knn}, "size": 50, "aggs": {"n": {"value_count": {"field": "_id"}}}})
    assert {x["_id"] for x in r.hits.collect()} == {0, 1, 2} and r.total() == (3, "eq") and r.aggs["_metrics"].first()["n"] == 3
    assert search(df, {"query": {"knn": knn | {"k": 50}}, "size": 50}).hits.count() == 20
    assert {x["_id"] for x in search(df, {"query": {"knn": knn | {"filter": {"range": {"_id": {"gte": 5}}}}}}).hits.collect()} == {5, 6, 7}
    for bad in ({"k": 0}, {"k": 10, "num_candidates": 5}):
        with pytest.raises(QueryError):
            search(df, {"query": {"knn": knn | bad}})


def test_inner_hits(spark):
    df = spark.createDataFrame([(i, ["a", "b", None][i % 3], float(i)) for i in range(12)], "_id int, k string, v double")
    r = search(df, {"collapse": {"field": "k", "inner_hits": [{"name": "low", "size": 2, "sort": [{"v": "asc"}]}, {"name": "high", "size": 1, "sort": [{"v": "desc"}]}]}, "sort": [{"v": "desc"}], "size": 3})
    assert sorted((x["k"] or "", x["_id"], x["rank"]) for x in r.inner["low"].collect()) == [("", 2, 1), ("", 5, 2), ("a", 0, 1), ("a", 3, 2), ("b", 1, 1), ("b", 4, 2)]
    assert {x["_id"] for x in r.inner["high"].collect()} == {9, 10, 11}


def test_eql():
    assert parse_eql('process where name == "x" and not pid in (1, 2)') == {"bool": {"filter": [{"term": {"event.category": "process"}}, {"bool": {"filter": [{"term": {"name": "x"}}, {"bool": {"must_not": [{"terms": {"pid": [1, 2]}}]}}]}}]}}
    assert parse_eql("any where true") == {"match_all": {}}
    assert parse_eql('any where a.b not in ("x")') == {"bool": {"must_not": [{"terms": {"a.b": ["x"]}}]}}
    assert parse_eql(r'any where p : ("C:\\*", "d?")')["bool"]["should"][0] == {"wildcard": {"p": {"value": "C:\\*", "case_insensitive": True}}}
    for bad in ("sequence [any where true]", "any where", "any where a ==", "any where a == 1 b", "where a == 1", "any where (a == 1"):
        with pytest.raises(QueryError):
            parse_eql(bad)


def test_addresses(spark):
    rng = random.Random(2)
    good = [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(20)] + [str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 60, 100, 120]))) for _ in range(20)] + ["::", "::1", "1::", "2001:DB8::8:800:200c:417A"]
    bad = ["", "1.2.3", "1.2.3.256", ":::", "1::2::3", "12345::", "x", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:", ":1:2:3:4:5:6:7:8", None]
    df = spark.createDataFrame([(a,) for a in good + bad], "a string").select("a", _ip_key(F.col("a")).alias("k"))
    got = {r["a"]: r["k"] for r in df.collect()}
    for a in good:
        ip = ipaddress.ip_address(a)
        assert got[a] == f"{int(ip) + (0xFFFF << 32 if ip.version == 4 else 0):032x}", a
    assert all(got[a] is None for a in bad)


def test_date_spines_are_bounded(spark):
    df = spark.createDataFrame([(1, datetime(1970, 1, 1)), (2, datetime(2024, 1, 1))], "_id int, t timestamp_ntz")
    with pytest.raises(Exception, match="too many buckets"):
        run_aggs(df, {"k": {"date_histogram": {"field": "t", "fixed_interval": "1s"}}})["k"].collect()
    with pytest.raises(Exception, match="too many buckets"):
        run_aggs(df, {"k": {"date_histogram": {"field": "t", "calendar_interval": "minute"}}})["k"].collect()
    assert run_aggs(df, {"k": {"date_histogram": {"field": "t", "calendar_interval": "month"}}})["k"].count() == 649


def test_named_zones(spark):
    """A day of a zone with summer time begins at that zone's midnight."""
    df = spark.createDataFrame([(1, datetime(2024, 3, 31, 0, 30)), (2, datetime(2024, 3, 31, 22, 30)), (3, datetime(2024, 3, 30, 22, 30))], "_id int, t timestamp_ntz")
    out = run_aggs(df, {"k": {"date_histogram": {"field": "t", "calendar_interval": "day", "time_zone": "Europe/Berlin", "format": "yyyy-MM-dd"}}})["k"]
    assert {(r["k"], r["k_as_string"], r["doc_count"]) for r in out.collect()} == {(datetime(2024, 3, 29, 23), "2024-03-30", 1), (datetime(2024, 3, 30, 23), "2024-03-31", 1), (datetime(2024, 3, 31, 22), "2024-04-01", 1)}


def test_fragments(spark):
    df = spark.createDataFrame([(1, "one two token three four five six seven cache eight"), (2, "token"), (3, "none"), (4, None)], "_id int, text string")
    body = {"query": {"match": {"text": "token cache"}}, "highlight": {"fields": {"text": {"fragment_size": 15, "number_of_fragments": 1}}}}
    got = {r["_id"]: r["highlight_text"] for r in search(df, body).hits.collect()}
    assert got == {1: ["one two <em>token</em>"], 2: ["<em>token</em>"]}


def test_transforms_refuse_what_they_lack(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], "_id int, k string, v double")
    assert transforms.pivot(df, {"group_by": {"k": {"terms": {"field": "k"}}}, "aggs": {}}).collect()[0]["doc_count"] == 1
    assert transforms.pivot(df, {"group_by": {"k": {"terms": {"field": "k", "missing_bucket": True}}}}).count() == 2
    with pytest.raises(QueryError):
        transforms.pivot(df, {"group_by": {"k": {"range": {"field": "v"}}}})
    with pytest.raises(QueryError):
        transforms.pivot(df, {"group_by": {"k": {"terms": {"field": "k"}}}, "aggs": {"x": {"terms": {"field": "v"}}}})


def test_policies_and_bulk_results(spark):
    c = catalog.Catalog()
    c.add("a-000001", spark.range(10).toDF("id"), created=datetime(2025, 1, 1))
    c.aliases["a"] = ["a-000001"]
    assert c.rollover_if("a", {"max_docs": 11, "max_age": "2d"}, datetime(2025, 1, 2)) == {"max_docs": False, "max_age": False}
    assert c.rollover_if("a", {"max_docs": 10}, datetime(2025, 1, 2)) == {"max_docs": True} and c.aliases["a"] == ["a-000001", "a-000002"]
    c.read_only.add("a-000001")
    with pytest.raises(PermissionError):
        c.append("a-000001", spark.range(1).toDF("id"))
    t = spark.createDataFrame([(1, 3)], "id int, _version int")
    acts = spark.createDataFrame([(1, "update", 2, 1), (1, "delete", 3, 2), (2, "update", None, 1), (3, "upsert", None, 1), (None, "index", None, 1)], "id int, action string, if_version int, seq_no int")
    got = {(r["id"], r["action"]): r["result"] for r in ingest.bulk_results(t, acts, "id").collect()}
    assert got == {(1, "update"): "conflict", (1, "delete"): "conflict", (2, "update"): "not_found", (3, "upsert"): "created", (None, "index"): "created"}


def test_cell_trees_split_what_hashes_do_not():
    """Vectors of one tight cluster are split by the hashes of their differences, so that no cell holds most of them."""
    rng = np.random.default_rng(4)
    x = np.ones((5000, 8)) + 1e-6 * rng.normal(size=(5000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = polytope.CellTree(x, polytope.Rotations(8, 1), 1.0, 100)
    _, sizes = np.unique(tree.cells(x), return_counts=True)
    assert sizes.max() <= 100
    wide = polytope.Rotations(100, 1)
    y = rng.normal(size=(3, 100))
    assert np.allclose((wide.signed_axes(y, 0)[:, :128] ** 2).sum(axis=1), (y**2).sum(axis=1))


def test_a_cluster_without_a_shared_folder_is_refused():
    from unittest.mock import MagicMock

    session = MagicMock()
    session.conf.get.return_value = None
    session.sparkContext._jsc.sc().getCheckpointDir().isDefined.return_value = False
    for master in ("spark://host:7077", "local-cluster[2,1,1024]", "yarn"):
        session.sparkContext.master = master
        with pytest.raises(ValueError):
            scratch.shared_root(session)
    session.sparkContext.master = "local[4]"
    assert scratch.shared_root(session)


def test_negated_query_of_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "_id int, k string")
    assert df.where(compile_query(df, parse_eql('any where k != "a"'))[0].match).count() == 0
    assert df.where(compile_query(df, parse_eql("any where k == null"))[0].match).count() == 1


def test_files_of_several_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"a,b\n1,2\n3,4\n")
    (tmp_path / "b.jsonl").write_bytes(b'{"a":1}\n{"a":2}\n{"a":3}\n')
    (tmp_path / "c.csv").write_bytes(b"a,c\n1,2\n3,4\n")
    (tmp_path / "_SUCCESS").write_bytes(b"")
    with pytest.raises(ValueError, match="csv.*jsonl"):
        readers.read_any(spark, str(tmp_path))
    got = readers.read_folder(spark, str(tmp_path))
    assert {k: v.count() for k, v in got.items()} == {"csv": 4, "jsonl": 3} and set(got["csv"].columns) == {"a", "b", "c"}
    with pytest.raises(FileNotFoundError):
        readers.read_any(spark, str(tmp_path / "none"))


def test_csv_files_of_a_header_alone(spark, tmp_path):
    """Spark's first task writes the header even if it has no rows."""
    rows = spark.range(0, 8, 1, 4).select("id", F.concat(F.lit("n "), "id").alias("name"), (F.col("id") + 0.5).alias("v"))
    kept = rows.where("id >= 2")
    kept.write.csv(str(tmp_path / "t"), header=True, sep=";")
    assert sorted(len(p.read_text().splitlines()) for p in (tmp_path / "t").glob("part-*")) == [1, 3, 3, 3]
    got = readers.read_any(spark, str(tmp_path / "t"))
    assert dict(got.dtypes) == {"id": "int", "name": "string", "v": "double"} and sorted(map(tuple, got.collect())) == sorted(map(tuple, kept.collect()))
    got = readers.read_folder(spark, str(tmp_path / "t"))
    assert set(got) == {"csv"} and dict(got["csv"].dtypes) == {"id": "int", "name": "string", "v": "double"} and got["csv"].count() == 6
    rows.where("id < 0").write.csv(str(tmp_path / "none"), header=True, sep=";")
    none = readers.read_any(spark, str(tmp_path / "none"))
    assert none.columns == ["id", "name", "v"] and none.count() == 0 and readers.read_folder(spark, str(tmp_path / "none"))["csv"].count() == 0


def test_csv_files_of_one_row(spark, tmp_path):
    for i, text in enumerate(("1;a\n2;b\n", "3;c\n", "4;\"d;e\"\n")):
        (tmp_path / f"part-{i}").write_text(text)
    assert sorted(map(tuple, readers.read_any(spark, str(tmp_path)).collect())) == [(1, "a"), (2, "b"), (3, "c"), (4, "d;e")]
    assert readers.read_folder(spark, str(tmp_path))["csv"].count() == 4
    (tmp_path / "part-1").write_text("k;v\n5;x\n")
    (tmp_path / "part-0").write_text("k;v\n1;a\n")
    with pytest.raises(ValueError, match="csv.*lines"):  # a row that would be taken for a header
        readers.read_any(spark, str(tmp_path))


def test_csv_dialect_is_that_of_the_file_with_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"k;v\n")
    (tmp_path / "b.csv").write_bytes(b"k;v\na;1,5\nb;2,25\n")
    assert sorted(map(tuple, readers.read_any(spark, str(tmp_path)).collect())) == [("a", 1.5), ("b", 2.25)]


def test_indexed_queries_equal_the_scan(spark):
    rng = random.Random(7)
    words = "token cache replica index vector job queue the of".split()
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(0, 12))) or None, " ".join(rng.choices(words, k=3)), rng.randrange(100)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, title string, n int")
    indexes = {f: TextIndex(spark, scratch.scratch_path(spark, "t")).add(df, "doc_id", f) for f in ("text", "title")}
    iq = IndexedQuery(df, "doc_id", indexes)
    for q in (
        {"bool": {"must": [{"match": {"text": "token cache"}}], "must_not": [{"match": {"title": "job"}}], "should": [{"match_phrase": {"text": "the token"}}, {"range": {"n": {"gte": 50}}}]}},
        {"bool": {"should": [{"match": {"text": "token"}}, {"match": {"title": "queue"}}, {"term": {"n": 5}}], "minimum_should_match": 2}},
        {"bool": {"must_not": [{"match": {"text": "token"}}]}},
        {"bool": {"filter": [{"match": {"text": {"query": "token cache", "operator": "and"}}}]}},
        {"multi_match": {"query": "token vector", "fields": ["title^2", "text"], "tie_breaker": 0.3}},
        {"multi_match": {"query": "token vector", "fields": ["title", "text"], "type": "most_fields"}},
        {"query_string": {"query": "token AND (cache OR title:queue) -replica"}},
        {"constant_score": {"filter": {"match": {"text": "vector"}}, "boost": 2.0}},
        {"match_phrase": {"text": {"query": "token cache", "slop": 2}}},
        {"match": {"text": {"query": "tokem", "fuzziness": 1}}},
        {"match": {"text": ""}},
    ):
        options = {"text_fields": ["text", "title"]}
        want = {r["doc_id"]: round(r["_score"], 9) for r in search(df, {"query": q, "size": 1000}, "doc_id", **options).hits.collect()}
        got = {r["id"]: round(r["_score"], 9) for r in iq.matches(q).collect()}
        assert got == want, q
    top = iq.search({"match": {"text": "token cache"}}, 5).collect()
    assert [r["doc_id"] for r in top] == [r["doc_id"] for r in search(df, {"query": {"match": {"text": "token cache"}}, "size": 5}, "doc_id").hits.collect()]


def test_decay_functions(spark):
    df = spark.createDataFrame([(1, 10.0, datetime(2024, 1, 1), (0.0, 0.0)), (2, 20.0, datetime(2024, 1, 8), (1.0, 0.0)), (3, None, None, None)], "_id int, v double, t timestamp_ntz, loc struct<lat:double,lon:double>")

    def scores(**f):
        body = {"query": {"function_score": f | {"boost_mode": "replace"}}}
        return {r["_id"]: round(r["_score"], 6) for r in search(df, body).hits.collect()}

    assert scores(linear={"v": {"origin": 10, "scale": 10}}) == {1: 1.0, 2: 0.5, 3: 1.0}
    assert scores(gauss={"v": {"origin": 10, "scale": 5, "decay": 0.5}}) == {1: 1.0, 2: 0.0625, 3: 1.0}
    assert scores(exp={"t": {"origin": "2024-01-01", "scale": "7d", "decay": 0.25}}) == {1: 1.0, 2: 0.25, 3: 1.0}
    assert scores(exp={"loc": {"origin": {"lat": 0, "lon": 0}, "scale": "111.19km", "offset": "111.19km"}})[2] > 0.99
    with pytest.raises(QueryError):
        scores(exp={"v": {"origin": 1, "scale": 0}})


def test_any_model_embeds(spark):
    def factory():
        return lambda texts: np.array([[len(t), t.count("a")] for t in texts], dtype=float)

    df = spark.createDataFrame([(1, "banana"), (2, None), (3, "")], "_id int, t string").select("_id", embed_with(F.col("t"), factory).alias("v"))
    assert {r["_id"]: r["v"] for r in df.collect()} == {1: [6.0, 3.0], 2: None, 3: [0.0, 0.0]}
