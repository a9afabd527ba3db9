"""Queries of predicates, full text, scoring, vectors and result handling, each from its request document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import text, vectors
from searchloom.plans import query, search, sql

NOW = None


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _where(name: str, key: str, q: dict, keep: list[str] | None = None, prepare=None, **options):
    """A query's matching rows: the key and some columns."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, name)
        if prepare:
            df = prepare(df, spark, sf)
        clause, _ = query.compile_query(df, q, id=key, **options)
        return df.where(clause.match).select(key, *(keep or []))

    return run


def _hits(name: str, key: str, body: dict, keep: list[str], prepare=None, digits: int = 6, score: bool = True, **options):
    """A search's page of hits: the key, some columns and the rounded score."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, name)
        if prepare:
            df = prepare(df, spark, sf)
        h = search.search(df, body, key, **options).hits
        return h.select(key, *keep, *([F.round("_score", digits).alias("score")] if score else []))

    return run


def _customers(df: DataFrame, *_) -> DataFrame:
    return df.withColumn("lat", (F.col("c_custkey") % 180) - 90 + 0.5).withColumn("lon", (F.col("c_custkey") * 7 % 360) - 180 + 0.5)


def _orders_nested(df: DataFrame, spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct("l_quantity", "l_returnflag", "l_linestatus")).alias("lines"))
    return df.join(li, df.o_orderkey == li.l_orderkey, "left").drop("l_orderkey")


def _tags(df: DataFrame, *_) -> DataFrame:
    return df.withColumn("tags", F.split("p_name", " "))


GEO = {"geo": {"loc": ("lat", "lon")}}
CUSTOMER_GEO = "(select *, (c_custkey % 180) - 90 + 0.5 lat, (c_custkey * 7 % 360) - 180 + 0.5 lon from customer)"
_TOK = "regexp_extract_all(lower({c}), '[\\p{{L}}\\p{{N}}_]+')"


def tok(c: str) -> str:
    return _TOK.format(c=c)


def bm25(source: str, key: str, column: str, terms: list[str], tag: str = "") -> str:
    """Common table expressions: w(key, words), st(n, avgdl), q(term), and b(key, score) summed over the terms; their names end in ``tag``."""
    values = ", ".join(f"('{t}')" for t in terms)
    return f"""w{tag} as (select {key}, coalesce({tok(column)}, []) words from {source}),
 st{tag} as (select count(*) n, avg(len(words)) filter (where len(words) > 0) avgdl from w{tag}),
 q{tag} as (select * from (values {values}) q(term)),
 dfs{tag} as (select term, count(*) filter (where list_contains(words, term)) df from w{tag}, q{tag} group by term),
 b{tag} as (select {key}, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / avgdl))) score
       from (select w.{key}, w.words, q.term, len(list_filter(w.words, lambda x: x = q.term)) f from w{tag} w, q{tag} q) t join dfs{tag} using (term), st{tag} group by {key})"""


def terms_lookup(spark, sf):
    """Nations of a region, found in another table."""
    nations = table(spark, sf, "nation").where("n_regionkey = 2")
    return query.terms_lookup(table(spark, sf, "customer"), "c_nationkey", nations, "n_nationkey").select("c_custkey")


def anti_lookup(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return query.terms_lookup(table(spark, sf, "customer"), "c_custkey", orders, "o_custkey", negate=True).select("c_custkey")


def percolated(spark, sf):
    stored = [("vectors", {"match": {"text": "vector"}}), ("queue", {"term": {"source": "tickets/main-queue"}}), ("long", {"range": {"n_chars": {"gte": 1000}}}), ("both", {"bool": {"must": [{"match": {"text": "token cache"}}], "must_not": [{"term": {"lang": "de"}}]}})]
    out = query.percolate(stored, table(spark, sf, "documents"), id="doc_id")
    return out.select("doc_id", F.explode("matched_queries").alias("query"))


def named(spark, sf):
    q = {"bool": {"should": [{"term": {"o_orderstatus": {"value": "F", "_name": "done"}}}, {"range": {"o_totalprice": {"gte": 200000, "_name": "large"}}}]}}
    q["bool"]["should"] = [{"term": {"o_orderstatus": "F", "_name": "done"}}, {"range": {"o_totalprice": {"gte": 200000}, "_name": "large"}}]
    df = table(spark, sf, "orders")
    clause, ctx = query.compile_query(df, q, id="o_orderkey")
    names = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in ctx.named])
    return df.where(clause.match).select("o_orderkey", names.alias("matched"))


def terms_enum(spark, sf):
    t = table(spark, sf, "documents").select(F.explode(text.standard(F.col("text"))).alias("term"))
    return t.where(F.col("term").startswith("se")).groupBy("term").agg(F.count("*").alias("n")).orderBy("term").limit(50)


def suggest(spark, sf):
    """Terms of the vocabulary near a misspelt word, by distance and then frequency."""
    t = table(spark, sf, "documents").select(F.explode(F.array_distinct(text.standard(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    d = F.levenshtein("term", F.lit("segmant"))
    return t.withColumn("distance", d).where("distance <= 2").orderBy("distance", F.desc("df"), "term").limit(5)


def analyzed(spark, sf):
    t = table(spark, sf, "part").select("p_partkey", F.posexplode(text.standard(F.col("p_name"))).alias("position", "token"))
    return t


def highlighted(spark, sf):
    body = {"query": {"match": {"text": "token cache"}}, "size": 50, "highlight": {"fields": {"text": {}}}}
    h = search.search(table(spark, sf, "documents"), body, "doc_id").hits
    return h.select("doc_id", F.regexp_count("highlight_text", F.lit("<em>")).alias("marks"))


def explained(spark, sf):
    e = search.explain_score(table(spark, sf, "documents"), "text", "token cache", "doc_id")
    return e.select("doc_id", "term", F.round("idf", 6).alias("idf"), "tf", "dl", F.round("score", 6).alias("score"))


def ranked(spark, sf):
    """A text ranking judged against the source of the documents."""
    df = table(spark, sf, "documents")
    h = search.search(df, {"query": {"match": {"text": "token cache"}}, "size": 20}, "doc_id").hits
    from pyspark.sql import Window

    r = h.select(F.lit("q").alias("query"), F.col("doc_id").alias("doc"), F.row_number().over(Window.orderBy(F.desc("_score"), "doc_id")).alias("rank"))
    ratings = df.select(F.lit("q").alias("query"), F.col("doc_id").alias("doc"), F.col("source").startswith("releases").cast("int").alias("rating"))
    out = search.rank_eval(r, ratings, 10)
    return out.select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "reciprocal_rank", "ndcg")])


def knn(kind: str, **extra):
    def run(spark, sf):
        df = table(spark, sf, "embeddings")
        v = [((i * 37 % 19) - 9) / 10 for i in range(64)]
        h = search.search(df, {"query": {"knn": {"field": "embedding", "query_vector": v, "similarity_function": kind, **extra}}, "size": 10}, "vec_id").hits
        return h.select("vec_id", F.round("_score", 5).alias("score"))

    return run


def _knn_sql(expr: str, where: str = "true") -> str:
    v = "[" + ", ".join(str(((i * 37 % 19) - 9) / 10) for i in range(64)) + "]::double[]"
    return f"with e as (select vec_id, label, list_transform(embedding, lambda x: x::double) x, {v} q from embeddings) select vec_id, round(s, 5) score from (select vec_id, {expr} s from e where {where}) order by s desc, vec_id limit 10"


def knn_batch(spark, sf):
    """Every vector divisible by 50 as a query against all rows, in blocks of queries."""
    df = table(spark, sf, "embeddings")
    q = df.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    from pyspark.sql import Window

    pairs = q.join(df, F.col("query_id") != F.col("vec_id")).select("query_id", "vec_id", F.round(vectors.cosine("q", "embedding"), 6).alias("similarity"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id"))
    return pairs.withColumn("rank", r).where("rank <= 5")


def fused(kind: str):
    def run(spark, sf):
        df = table(spark, sf, "documents")
        body = {"query": {"hybrid": {"queries": [{"query": {"match": {"text": "token cache"}}, "weight": 2.0}, {"query": {"match": {"text": "vector index"}}}], "fusion": {"type": kind, "rank_window_size": 50}}}, "size": 20}
        return search.search(df, body, "doc_id").hits.select("doc_id", F.round("_score", 6).alias("score"))

    return run


def quantized(spark, sf):
    df = table(spark, sf, "embeddings")
    lo, hi = df.select(F.array_min("embedding").alias("a"), F.array_max("embedding").alias("b")).agg(F.min("a"), F.max("b")).first()
    q = vectors.quantize("embedding", F.lit(float(lo)), F.lit(float(hi)))
    return df.select("vec_id", F.aggregate(q, F.lit(0), lambda a, x: a + x).alias("code_sum"))


def sql_group(spark, sf):
    return sql.run_sql(spark, {"orders": table(spark, sf, "orders")}, "SELECT o_orderstatus, COUNT(*) FROM orders WHERE o_totalprice > 100000 AND o_orderpriority LIKE '1*' GROUP BY o_orderstatus ORDER BY o_orderstatus", id="o_orderkey")


def sql_distinct(spark, sf):
    return sql.run_sql(spark, {"customer": table(spark, sf, "customer")}, "SELECT DISTINCT c_mktsegment FROM customer WHERE NOT c_acctbal < 0", id="c_custkey")


QUERIES = {
    "q_match_all": _where("region", "r_regionkey", {"match_all": {}}, ["r_name"]),
    "q_match_none": _where("region", "r_regionkey", {"match_none": {}}),
    "q_term": _where("orders", "o_orderkey", {"term": {"o_orderstatus": "F"}}),
    "q_term_case": _where("customer", "c_custkey", {"term": {"c_mktsegment": {"value": "building", "case_insensitive": True}}}),
    "q_terms": _where("orders", "o_orderkey", {"terms": {"o_orderstatus": ["F", "P"]}}),
    "q_terms_lookup": terms_lookup,
    "q_anti_lookup": anti_lookup,
    "q_terms_set": _where("part", "p_partkey", {"terms_set": {"tags": {"terms": ["blue", "red", "small", "widget", "bolt"], "minimum_should_match": 2}}}, prepare=_tags),
    "q_range_num": _where("lineitem", "l_orderkey", {"range": {"l_quantity": {"gte": 10, "lt": 20}}}, ["l_linenumber"]),
    "q_range_date_math": _where("orders", "o_orderkey", {"range": {"o_orderdate": {"gte": "1996-02-01||-1M/M", "lte": "1996-03-01||/M"}}}),
    "q_range_string": _where("customer", "c_custkey", {"range": {"c_mktsegment": {"gt": "B", "lte": "FURNITURE"}}}),
    "q_prefix": _where("part", "p_partkey", {"prefix": {"p_brand": "Brand#1"}}),
    "q_wildcard": _where("customer", "c_custkey", {"wildcard": {"c_mktsegment": "*UI?D*"}}),
    "q_regexp": _where("customer", "c_custkey", {"regexp": {"c_mktsegment": "[A-F].*E"}}),
    "q_fuzzy": _where("customer", "c_custkey", {"fuzzy": {"c_mktsegment": {"value": "bulidnig", "fuzziness": 2}}}),
    "q_exists": _where("error_logs", "span_id", {"exists": {"field": "stack_trace"}}),
    "q_ids": _where("orders", "o_orderkey", {"ids": {"values": [1, 2, 3, 4, 5, 99]}}),
    "q_bool_msm": _where("orders", "o_orderkey", {"bool": {"should": [{"term": {"o_orderstatus": "F"}}, {"range": {"o_totalprice": {"gte": 150000}}}, {"prefix": {"o_orderpriority": "1"}}], "must_not": [{"range": {"o_orderdate": {"lt": "1994-01-01"}}}], "minimum_should_match": "67%"}}),
    "q_constant_score": _hits("orders", "o_orderkey", {"query": {"constant_score": {"filter": {"term": {"o_orderstatus": "F"}}, "boost": 1.5}}, "size": 20}, []),
    "q_nested": _where("orders", "o_orderkey", {"nested": {"path": "lines", "query": {"bool": {"must": [{"range": {"lines.l_quantity": {"gte": 45}}}, {"term": {"lines.l_returnflag": "R"}}]}}}}, prepare=_orders_nested),
    "q_percolate": percolated,
    "q_named": named,
    "q_geo_distance": _where("customer", "c_custkey", {"geo_distance": {"distance": "2000km", "loc": {"lat": 40.0, "lon": -70.0}}}, prepare=_customers, **GEO),
    "q_geo_box": _where("customer", "c_custkey", {"geo_bounding_box": {"loc": {"top_left": [170.0, 30.0], "bottom_right": [-150.0, -30.0]}}}, prepare=_customers, **GEO),
    "q_geo_polygon": _where("customer", "c_custkey", {"geo_polygon": {"loc": {"points": ["0.1,0.2", "50.3,10.4", "30.7,60.1"]}}}, prepare=_customers, **GEO),
    "q_geo_shape": _where("customer", "c_custkey", {"geo_shape": {"loc": {"shape": {"type": "envelope", "coordinates": [[-20.0, 40.0], [20.0, -40.0]]}}}}, prepare=_customers, **GEO),
    "q_script_filter": _where("lineitem", "l_orderkey", {"script": {"script": {"source": "doc['l_extendedprice'].value * (1 - doc['l_discount'].value) > params.least && doc['l_shipdate'].value.getMonthValue() == 3", "params": {"least": 50000}}}}, ["l_linenumber"]),
    "q_wrapper": _where("region", "r_regionkey", {"wrapper": {"query": "eyJ0ZXJtIjogeyJyX3JlZ2lvbmtleSI6IDF9fQ=="}}),
    "t_match_or": _where("documents", "doc_id", {"match": {"text": "token cache"}}),
    "t_match_and": _where("documents", "doc_id", {"match": {"text": {"query": "token cache", "operator": "and"}}}),
    "t_bm25": _hits("documents", "doc_id", {"query": {"match": {"text": "token cache replica"}}, "size": 25}, []),
    "t_phrase": _where("documents", "doc_id", {"match_phrase": {"text": "the token cache"}}),
    "t_phrase_slop": _where("documents", "doc_id", {"match_phrase": {"text": {"query": "token back", "slop": 3}}}),
    "t_phrase_prefix": _where("documents", "doc_id", {"match_phrase_prefix": {"text": "the token ca"}}),
    "t_bool_prefix": _where("documents", "doc_id", {"match_bool_prefix": {"text": {"query": "token ca", "operator": "and"}}}),
    "t_multi_match_best": _hits("ai_kb", "id", {"query": {"multi_match": {"query": "cache shard", "fields": ["title^2", "content"], "tie_breaker": 0.3}}, "size": 20}, []),
    "t_multi_match_cross": _where("ai_kb", "id", {"multi_match": {"query": "question small", "fields": ["title", "content"], "type": "cross_fields", "operator": "and"}}),
    "t_query_string": _where("documents", "doc_id", {"query_string": {"query": "(token OR vector) AND cache AND n_chars:[100 TO 900] -lang:de", "default_field": "text"}}),
    "t_simple_query_string": _where("documents", "doc_id", {"simple_query_string": {"query": "+token -replica", "fields": ["text"]}}),
    "t_mlt": _where("documents", "doc_id", {"more_like_this": {"fields": ["text"], "like": ["large index", "snapshot job"]}}),
    "t_intervals": _where("documents", "doc_id", {"intervals": {"text": {"all_of": {"ordered": True, "max_gaps": 4, "intervals": [{"match": {"query": "token cache", "ordered": True, "max_gaps": 0}}, {"any_of": {"intervals": [{"match": {"query": "clean"}}, {"prefix": {"prefix": "ret"}}]}}]}}}}),
    "t_span_near": _where("documents", "doc_id", {"span_near": {"clauses": [{"span_term": {"text": "token"}}, {"span_or": {"clauses": [{"span_term": {"text": "back"}}, {"span_term": {"text": "clean"}}]}}], "slop": 4, "in_order": True}}),
    "t_span_first": _where("documents", "doc_id", {"span_first": {"match": {"span_term": {"text": "the"}}, "end": 2}}),
    "t_span_not": _where("documents", "doc_id", {"span_not": {"include": {"span_term": {"text": "cache"}}, "exclude": {"span_term": {"text": "token"}}, "pre": 1}}),
    "t_span_within": _where("documents", "doc_id", {"span_within": {"little": {"span_term": {"text": "cache"}}, "big": {"span_near": {"clauses": [{"span_term": {"text": "the"}}, {"span_term": {"text": "clean"}}], "slop": 6, "in_order": True}}}}),
    "t_highlight": highlighted,
    "t_suggest_term": suggest,
    "t_terms_enum": terms_enum,
    "t_analyze": analyzed,
    "t_explain": explained,
    "s_boosting": _hits("documents", "doc_id", {"query": {"boosting": {"positive": {"match": {"text": "token cache"}}, "negative": {"term": {"lang": "en"}}, "negative_boost": 0.5}}, "size": 20}, []),
    "s_dis_max": _hits("documents", "doc_id", {"query": {"dis_max": {"queries": [{"constant_score": {"filter": {"term": {"lang": "en"}}, "boost": 2.0}}, {"constant_score": {"filter": {"range": {"n_chars": {"gte": 300}}}, "boost": 3.0}}], "tie_breaker": 0.5}}, "size": 20}, []),
    "s_function_score": _hits("customer", "c_custkey", {"query": {"function_score": {"query": {"range": {"c_acctbal": {"gt": 0}}}, "functions": [{"filter": {"term": {"c_mktsegment": "BUILDING"}}, "weight": 3.0}, {"field_value_factor": {"field": "c_acctbal", "factor": 0.001, "modifier": "sqrt"}}], "score_mode": "sum", "boost_mode": "replace", "max_boost": 5.5}}, "size": 20}, []),
    "s_field_value_factor": _hits("customer", "c_custkey", {"query": {"function_score": {"query": {"range": {"c_acctbal": {"gt": 0}}}, "field_value_factor": {"field": "c_acctbal", "factor": 1.2, "modifier": "log1p"}}}, "size": 20}, []),
    "s_script_score": _hits("part", "p_partkey", {"query": {"script_score": {"query": {"match_all": {}}, "script": {"source": "def x = doc['p_retailprice'].value; if (x > 1000) { return Math.log(x) * params.k; } return x / 1000;", "params": {"k": 0.5}}}}, "size": 20}, []),
    "s_distance_feature": _hits("orders", "o_orderkey", {"query": {"distance_feature": {"field": "o_orderdate", "origin": "1996-01-01T00:00:00", "pivot": "7d"}}, "size": 20}, [], digits=5),
    "s_rank_feature": _hits("part", "p_partkey", {"query": {"rank_feature": {"field": "p_size", "saturation": {"pivot": 8}}}, "size": 20}, []),
    "s_pinned": _hits("orders", "o_orderkey", {"query": {"pinned": {"ids": ["7", "3", "5"], "organic": {"range": {"o_totalprice": {"gte": 200000}}}}}, "size": 10}, [], score=False),
    "s_rescore": _hits("part", "p_partkey", {"query": {"function_score": {"field_value_factor": {"field": "p_size"}}}, "rescore": {"window_size": 30, "query": {"rescore_query": {"function_score": {"field_value_factor": {"field": "p_retailprice", "factor": 0.01}}}, "query_weight": 0.5, "rescore_query_weight": 2.0}}, "size": 10}, []),
    "s_collapse": _hits("orders", "o_orderkey", {"query": {"match_all": {}}, "collapse": {"field": "o_custkey"}, "sort": [{"o_totalprice": "desc"}], "size": 50}, ["o_custkey", "o_totalprice"], score=False),
    "s_search_after": _hits("orders", "o_orderkey", {"sort": [{"o_totalprice": "desc"}], "search_after": [150000.0, 0], "size": 20}, ["o_totalprice"], score=False),
    "s_sort_missing": _hits("ai_kb", "id", {"sort": [{"word_count": {"order": "asc", "missing": "_first"}}, {"indexed_at": {"order": "desc"}}], "from": 5, "size": 30}, ["word_count"], score=False),
    "s_source_filter": _hits("orders", "o_orderkey", {"sort": [{"o_orderkey": "asc"}], "_source": {"includes": ["o_*"], "excludes": ["*date", "*priority"]}, "size": 20}, ["o_custkey", "o_orderstatus", "o_totalprice"], score=False),
    "s_script_fields": _hits("orders", "o_orderkey", {"sort": ["o_orderkey"], "script_fields": {"taxed": {"script": "doc['o_totalprice'].value * 1.19"}}, "size": 20}, ["taxed"], score=False),
    "s_runtime_mappings": _hits("orders", "o_orderkey", {"runtime_mappings": {"day": {"type": "long", "script": {"source": "emit(doc['o_orderdate'].value.getDayOfWeek())"}}}, "query": {"term": {"day": 7}}, "sort": ["o_orderkey"], "size": 20}, ["day"], score=False),
    "s_min_score": _hits("part", "p_partkey", {"query": {"function_score": {"field_value_factor": {"field": "p_size"}}}, "min_score": 48, "size": 40}, []),
    "s_rank_eval": ranked,
    "v_knn_cosine": knn("cosine"),
    "v_knn_l2": knn("l2_norm"),
    "v_knn_dot": knn("dot_product"),
    "v_knn_filtered": knn("cosine", filter={"term": {"label": 3}}),
    "v_knn_batch": knn_batch,
    "v_hybrid_rrf": fused("rrf"),
    "v_hybrid_linear": fused("linear"),
    "v_sq8": quantized,
    "d_sql_group": sql_group,
    "d_sql_distinct": sql_distinct,
}

_D = tok("text")
_TC = "list_contains(w, 'token') or list_contains(w, 'cache')"
_DOCS = f"(select *, coalesce({_D}, []) w from documents)"
_HAV = "2 * 6371008.7714 * asin(sqrt(least(1.0, pow(sin(radians(lat - 40.0) / 2), 2) + cos(radians(40.0)) * cos(radians(lat)) * pow(sin(radians(lon - -70.0) / 2), 2))))"
_RING = [(0.1, 0.2), (50.3, 10.4), (30.7, 60.1)]
_POLY = " + ".join(f"(case when ({ya} > lat) <> ({yb} > lat) and lon < (lat - {ya}) * {xb - xa} / {yb - ya} + {xa} then 1 else 0 end)" for (ya, xa), (yb, xb) in zip(_RING, _RING[1:] + _RING[:1]))


def _hybrid_sql(value: str) -> str:
    top = "(select doc_id, {w} * {v} s from b{t} where score > 0 order by score desc, doc_id limit 50)"
    parts = " union all ".join("select * from " + top.format(w=w, v=value, t=t) for w, t in ((2, "1"), (1, "2")))
    return f"with {bm25('documents', 'doc_id', 'text', ['token', 'cache'], '1')}, {bm25('documents', 'doc_id', 'text', ['vector', 'index'], '2')} select doc_id, round(sum(s), 6)::double score from ({parts}) group by doc_id order by sum(s) desc, doc_id limit 20"


def _ids(source: str, key: str, where: str) -> str:
    return f"select {key} from {source} where {where}"


SQL = {
    "q_match_all": "select r_regionkey, r_name from region",
    "q_match_none": "select r_regionkey from region where false",
    "q_term": _ids("orders", "o_orderkey", "o_orderstatus = 'F'"),
    "q_term_case": _ids("customer", "c_custkey", "lower(c_mktsegment) = 'building'"),
    "q_terms": _ids("orders", "o_orderkey", "o_orderstatus in ('F', 'P')"),
    "q_terms_lookup": _ids("customer", "c_custkey", "c_nationkey in (select n_nationkey from nation where n_regionkey = 2)"),
    "q_anti_lookup": _ids("customer", "c_custkey", "not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')"),
    "q_terms_set": _ids("part", "p_partkey", "len(list_intersect(string_split(p_name, ' '), ['blue', 'red', 'small', 'widget', 'bolt'])) >= 2"),
    "q_range_num": "select l_orderkey, l_linenumber from lineitem where l_quantity >= 10 and l_quantity < 20",
    "q_range_date_math": _ids("orders", "o_orderkey", "o_orderdate >= timestamp '1996-01-01' and o_orderdate <= timestamp '1996-03-31 23:59:59.999'"),
    "q_range_string": _ids("customer", "c_custkey", "c_mktsegment > 'B' and c_mktsegment <= 'FURNITURE'"),
    "q_prefix": _ids("part", "p_partkey", "starts_with(p_brand, 'Brand#1')"),
    "q_wildcard": _ids("customer", "c_custkey", "c_mktsegment ilike '%UI_D%'"),
    "q_regexp": _ids("customer", "c_custkey", "regexp_full_match(c_mktsegment, '[A-F].*E')"),
    "q_fuzzy": _ids("customer", "c_custkey", "damerau_levenshtein(lower(c_mktsegment), 'bulidnig') <= 2"),
    "q_exists": _ids("error_logs", "span_id", "stack_trace is not null"),
    "q_ids": _ids("orders", "o_orderkey", "o_orderkey in (1, 2, 3, 4, 5, 99)"),
    "q_bool_msm": _ids("orders", "o_orderkey", "(o_orderstatus = 'F')::int + (o_totalprice >= 150000)::int + (starts_with(o_orderpriority, '1'))::int >= 2 and not o_orderdate < timestamp '1994-01-01'"),
    "q_constant_score": "select o_orderkey, 1.5::double score from orders where o_orderstatus = 'F' order by o_orderkey limit 20",
    "q_nested": "select distinct l_orderkey o_orderkey from lineitem where l_quantity >= 45 and l_returnflag = 'R'",
    "q_percolate": f"""select doc_id, q as query from {_DOCS}, (values ('vectors'), ('queue'), ('long'), ('both')) v(q)
where case q when 'vectors' then list_contains(w, 'vector') when 'queue' then source = 'tickets/main-queue' when 'long' then n_chars >= 1000 else ({_TC}) and coalesce(lang, '') <> 'de' end""",
    "q_named": "select o_orderkey, concat_ws(',', case when o_orderstatus = 'F' then 'done' end, case when o_totalprice >= 200000 then 'large' end) as matched from orders where o_orderstatus = 'F' or o_totalprice >= 200000",
    "q_geo_distance": _ids(CUSTOMER_GEO, "c_custkey", f"{_HAV} <= 2000000"),
    "q_geo_box": _ids(CUSTOMER_GEO, "c_custkey", "lat between -30 and 30 and (lon >= 170 or lon <= -150)"),
    "q_geo_polygon": _ids(CUSTOMER_GEO, "c_custkey", f"({_POLY}) % 2 = 1"),
    "q_geo_shape": _ids(CUSTOMER_GEO, "c_custkey", "lat between -40 and 40 and lon between -20 and 20"),
    "q_script_filter": "select l_orderkey, l_linenumber from lineitem where l_extendedprice * (1 - l_discount) > 50000 and month(l_shipdate) = 3",
    "q_wrapper": "select r_regionkey from region where r_regionkey = 1",
    "t_match_or": _ids(_DOCS, "doc_id", _TC),
    "t_match_and": _ids(_DOCS, "doc_id", "list_contains(w, 'token') and list_contains(w, 'cache')"),
    "t_bm25": "with " + bm25("documents", "doc_id", "text", ["token", "cache", "replica"]) + " select doc_id, round(score, 6) score from b where score > 0 order by b.score desc, doc_id limit 25",
    "t_phrase": _ids(_DOCS, "doc_id", "contains(' ' || array_to_string(w, ' ') || ' ', ' the token cache ')"),
    "t_phrase_slop": _ids(_DOCS, "doc_id", "regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' token ([^ ]+ ){0,3}?back ')"),
    "t_phrase_prefix": _ids(_DOCS, "doc_id", "contains(' ' || array_to_string(w, ' '), ' the token ca')"),
    "t_bool_prefix": _ids(_DOCS, "doc_id", "list_contains(w, 'token') and contains(' ' || array_to_string(w, ' '), ' ca')"),
    "t_multi_match_best": "with "
    + bm25("ai_kb", "id", "title", ["cache", "shard"], "1")
    + ", "
    + bm25("ai_kb", "id", "content", ["cache", "shard"], "2")
    + " select id, round(s, 6) score from (select id, greatest(x, y) + 0.3 * (x + y - greatest(x, y)) s from (select id, 2 * b1.score x, b2.score y from b1 join b2 using (id))) where s > 0 order by s desc, id limit 20",
    "t_highlight": "with " + bm25("documents", "doc_id", "text", ["token", "cache"]) + " select doc_id, len(list_filter(words, lambda x: x in ('token', 'cache')))::int marks from b join w using (doc_id) where score > 0 order by score desc, doc_id limit 50",
    "s_rank_eval": "with "
    + bm25("documents", "doc_id", "text", ["token", "cache"])
    + """, r as (select doc_id, row_number() over (order by score desc, doc_id) k from b where score > 0 qualify k <= 10),
j as (select k, starts_with(source, 'releases')::int rel from r join documents using (doc_id)), n as (select count(*) n from documents where starts_with(source, 'releases')),
i as (select sum(1 / log2(x + 1)) idcg from n, range(1, 11) t(x) where x <= n)
select round(avg(rel), 6) as precision, round(sum(rel) / any_value(n), 6) recall, round(max(rel / k), 6) reciprocal_rank, round(sum(rel / log2(k + 1)) / any_value(idcg), 6) ndcg from j, n, i""",
    "v_hybrid_rrf": _hybrid_sql("1.0 / (60 + row_number() over (order by score desc, doc_id))"),
    "v_hybrid_linear": _hybrid_sql("score"),
    "v_sq8": "with m as (select min(list_min(embedding))::double lo, max(list_max(embedding))::double hi from embeddings) select vec_id, list_sum(list_transform(embedding, lambda x: round((x::double - lo) / ((hi - lo) / 255.0))))::int code_sum from embeddings, m",
    "t_multi_match_cross": f"select id from (select id, list_concat(coalesce({tok('title')}, []), coalesce({tok('content')}, [])) w from ai_kb) where list_contains(w, 'question') and list_contains(w, 'small')",
    "t_query_string": _ids(_DOCS, "doc_id", "(list_contains(w, 'token') or list_contains(w, 'vector')) and list_contains(w, 'cache') and coalesce(lang, '') <> 'de' and n_chars between 100 and 900"),
    "t_simple_query_string": _ids(_DOCS, "doc_id", "list_contains(w, 'token') and not list_contains(w, 'replica')"),
    "t_mlt": _ids(_DOCS, "doc_id", "list_has_any(w, ['large', 'index', 'snapshot', 'job'])"),
    "t_intervals": _ids(_DOCS, "doc_id", "regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' token cache ([^ ]+ ){0,4}?(clean|ret[^ ]*) ')"),
    "t_span_near": _ids(_DOCS, "doc_id", "regexp_matches(' ' || array_to_string(w, ' ') || ' ', ' token ([^ ]+ ){0,4}?(back|clean) ')"),
    "t_span_first": _ids(_DOCS, "doc_id", "w[1] = 'the' or w[2] = 'the'"),
    "t_span_not": _ids(_DOCS, "doc_id", "len(list_filter(list_zip(list_concat([''], w[:-2]), w), lambda p: p[2] = 'cache' and p[1] <> 'token')) > 0"),
    "t_span_within": _ids(_DOCS, "doc_id", "len(list_filter(range(1, len(w) + 1), lambda i: w[i] = 'the' and len(list_filter(range(i + 1, i + 8), lambda j: w[j] = 'clean' and list_contains(w[i:j], 'cache'))) > 0)) > 0"),
    "t_suggest_term": f"select term, df, levenshtein(term, 'segmant')::int distance from (select term, count(*) df from (select doc_id, unnest(list_distinct({_D})) term from documents) group by term) where levenshtein(term, 'segmant') <= 2 order by distance, df desc, term limit 5",
    "t_terms_enum": f"select term, count(*) n from (select unnest({_D}) term from documents) where starts_with(term, 'se') group by term order by term limit 50",
    "t_analyze": f"select p_partkey, (unnest(range(1, len(w) + 1)) - 1)::int as position, unnest(w) token from (select p_partkey, {tok('p_name')} w from part)",
    "t_explain": "with " + bm25("documents", "doc_id", "text", ["token", "cache"]) + """ select doc_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) idf, f::int tf, len(words)::int dl,
round(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / avgdl)), 6) score
from (select doc_id, words, term, len(list_filter(words, lambda x: x = term)) f from w, q) join dfs using (term), st where f > 0""",
    "s_boosting": "with " + bm25("documents", "doc_id", "text", ["token", "cache"]) + " select doc_id, round(s, 6) score from (select doc_id, case when lang = 'en' then b.score * 0.5 else b.score end s from b join documents using (doc_id) where b.score > 0) order by s desc, doc_id limit 20",
    "s_dis_max": "select doc_id, s score from (select doc_id, greatest(a, b) + 0.5 * least(a, b) s from (select doc_id, case when lang = 'en' then 2.0 else 0 end::double a, case when n_chars >= 300 then 3.0 else 0 end::double b from documents)) where s > 0 order by s desc, doc_id limit 20",
    "s_function_score": "select c_custkey, round(s, 6) score from (select c_custkey, least(5.5, case when c_mktsegment = 'BUILDING' then 3.0 else 0 end + sqrt(c_acctbal * 0.001)) s from customer where c_acctbal > 0) order by s desc, c_custkey limit 20",
    "s_field_value_factor": "select c_custkey, round(s, 6) score from (select c_custkey, log10(c_acctbal * 1.2 + 1) s from customer where c_acctbal > 0) order by s desc, c_custkey limit 20",
    "s_script_score": "select p_partkey, round(s, 6) score from (select p_partkey, case when p_retailprice > 1000 then ln(p_retailprice) * 0.5 else p_retailprice / 1000 end s from part) order by s desc, p_partkey limit 20",
    "s_distance_feature": "select o_orderkey, round(s, 5) score from (select o_orderkey, 604800000.0 / (604800000.0 + abs(epoch_us(o_orderdate) - epoch_us(timestamp '1996-01-01')) / 1000.0) s from orders) order by s desc, o_orderkey limit 20",
    "s_rank_feature": "select p_partkey, round(s, 6) score from (select p_partkey, p_size / (p_size + 8.0) s from part where p_size > 0) order by s desc, p_partkey limit 20",
    "s_pinned": "select o_orderkey from orders where o_orderkey in (7, 3, 5) or o_totalprice >= 200000 order by case o_orderkey when 7 then 1 when 3 then 2 when 5 then 3 else 4 end, o_orderkey limit 10",
    "s_rescore": "select p_partkey, round(0.5 * p_size + 2 * p_retailprice * 0.01, 6) score from (select * from part order by p_size desc, p_partkey limit 30) order by 0.5 * p_size + 2 * p_retailprice * 0.01 desc, p_partkey limit 10",
    "s_collapse": "select o_orderkey, o_custkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1 order by o_totalprice desc, o_orderkey limit 50",
    "s_search_after": "select o_orderkey, o_totalprice from orders where o_totalprice < 150000 or (o_totalprice = 150000 and o_orderkey > 0) order by o_totalprice desc, o_orderkey limit 20",
    "s_sort_missing": "select id, word_count from ai_kb order by word_count asc nulls first, indexed_at desc nulls last, id limit 30 offset 5",
    "s_source_filter": "select o_orderkey, o_custkey, o_orderstatus, o_totalprice from orders order by o_orderkey limit 20",
    "s_script_fields": "select o_orderkey, o_totalprice * 1.19 taxed from orders order by o_orderkey limit 20",
    "s_runtime_mappings": "select o_orderkey, isodow(o_orderdate)::bigint as day from orders where isodow(o_orderdate) = 7 order by o_orderkey limit 20",
    "s_min_score": "select p_partkey, p_size::double score from part where p_size >= 48 order by p_size desc, p_partkey limit 40",
    "v_knn_cosine": _knn_sql("(1 + list_cosine_similarity(x, q)) / 2"),
    "v_knn_l2": _knn_sql("1 / (1 + list_distance(x, q) * list_distance(x, q))"),
    "v_knn_dot": _knn_sql("(1 + list_dot_product(x, q)) / 2"),
    "v_knn_filtered": _knn_sql("(1 + list_cosine_similarity(x, q)) / 2", "label = 3"),
    "v_knn_batch": """with e as (select vec_id, list_transform(embedding, lambda x: x::double) x from embeddings)
select query_id, vec_id, similarity, row_number() over (partition by query_id order by similarity desc, vec_id)::int as rank
from (select a.vec_id query_id, b.vec_id, round(list_cosine_similarity(a.x, b.x), 6) similarity from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
qualify row_number() over (partition by query_id order by similarity desc, vec_id) <= 5""",
    "d_sql_group": "select o_orderstatus, count(*) as count from orders where o_totalprice > 100000 and starts_with(o_orderpriority, '1') group by o_orderstatus",
    "d_sql_distinct": "select distinct c_mktsegment from customer where not c_acctbal < 0",
}
