"""Queries of the operators beside the main paths: indexes, catalog, scripts, request options, readers over files written from the tables, notes and edges."""

from __future__ import annotations

import json
import sqlite3
import zipfile
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom import catalog
from searchloom.functions import embed as emb
from searchloom.operators import graph, memory, transforms
from searchloom.operators.textindex import TextIndex
from searchloom.operators.vectorindex import VectorIndex
from searchloom.plans import query, search
from searchloom.plans.eql import parse_eql
from searchloom.plans.indexed import IndexedQuery
from searchloom.queries_aggs import PRICE, _agg, _metric
from searchloom.queries_data import AS_OF
from searchloom.queries_search import SQL as _SEARCH_SQL
from searchloom.queries_search import CUSTOMER_GEO, _hits, _knn_sql, _orders_nested, _where, bm25, table, tok
from searchloom.scratch import scratch_path
from searchloom.sources import infer, ingest, logs, readers
from searchloom.streaming import jobs


def _text_index(spark: SparkSession, sf: str) -> TextIndex:
    return TextIndex(spark, scratch_path(spark, "text")).add(table(spark, sf, "documents"), "doc_id", "text")


def t_index_bm25(spark, sf):
    """The best documents from postings of the query's terms."""
    hits = _text_index(spark, sf).top(table(spark, sf, "documents"), "doc_id", "token cache replica", 25)
    return hits.select("doc_id", F.round("_score", 6).alias("score"))


def t_index_and(spark, sf):
    return _text_index(spark, sf).match("token cache", "and").select(F.col("id").alias("doc_id"))


def t_index_phrase(spark, sf):
    return _text_index(spark, sf).phrase("the token cache").select(F.col("id").alias("doc_id"))


def t_index_terms(spark, sf):
    return _text_index(spark, sf).terms("se")


def t_index_suggest(spark, sf):
    return _text_index(spark, sf).suggest("segmant")


def _indexed(q: dict, keep: bool = False):
    """A query over the documents from their postings; with ``keep`` the best 25 with their scores."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        docs = table(spark, sf, "documents")
        iq = IndexedQuery(docs, "doc_id", {"text": _text_index(spark, sf)})
        if keep:
            return iq.search(q, 25).select("doc_id", F.round("_score", 6).alias("score"))
        return iq.matches(q).select(F.col("id").alias("doc_id"))

    return run


KNN = [((i * 37 % 19) - 9) / 10 for i in range(64)]


def v_knn_total(spark, sf):
    """Matches and an aggregation of a search for the 25 nearest: both see these 25 only."""
    df = table(spark, sf, "embeddings")
    q = {"knn": {"field": "embedding", "query_vector": KNN, "k": 25, "num_candidates": 100}}
    r = search.search(df, {"query": q, "size": 0, "aggs": {"top": {"max": {"field": "vec_id"}}}}, "vec_id")
    return r.matched.agg(F.count("*").alias("n")).crossJoin(r.aggs["_metrics"].select(F.col("top").alias("highest")))


def v_index_knn(spark, sf):
    """Recall of the approximate index: of every row divisible by 50 as a query, the share of its ten nearest that are found; at least 0.9."""
    df = table(spark, sf, "embeddings")
    index = VectorIndex.build(df, "vec_id", "embedding", scratch_path(spark, "vectors"), 64, 64)
    hits = index.search(KNN, 10, 1500)
    exact = search.search(df, {"query": {"knn": {"field": "embedding", "query_vector": KNN}}, "size": 10}, "vec_id").hits
    return exact.join(hits, exact["vec_id"] == hits["id"], "left").agg((F.count("id") >= 9).alias("found"))


def c_scan(spark, sf):
    """A pattern over tables with different columns."""
    c = catalog.Catalog()
    c.add("geo-region", table(spark, sf, "region"))
    c.add("geo-nation", table(spark, sf, "nation"))
    c.add("geo-old", table(spark, sf, "nation"))
    return c.scan("geo-*,-geo-old").groupBy("_index").agg(F.count("*").alias("n"), F.count("n_name").alias("named"))


def c_field_caps(spark, sf):
    c = catalog.Catalog()
    c.add("region", table(spark, sf, "region"))
    c.add("nation", table(spark, sf, "nation"))
    rows = [(f, sorted(n for ns in kinds.values() for n in ns)) for f, kinds in c.field_caps("*").items()]
    return spark.createDataFrame([(f, len(ns), ",".join(ns)) for f, ns in rows], "field string, tables int, names string")


def c_validate(spark, sf):
    c = catalog.Catalog()
    c.add("orders", table(spark, sf, "orders"))
    asked = {"term": {"term": {"o_orderstatus": "F"}}, "no field": {"term": {"absent": 1}}, "no type": {"absent": {}}, "child": {"has_child": {"type": "x", "query": {"match_all": {}}}}, "type": {"type": {"value": "_doc"}}}
    return spark.createDataFrame([(n, c.validate("orders", q, "o_orderkey")[0]) for n, q in asked.items()], "asked string, valid boolean")


def c_rollover(spark, sf):
    c = catalog.Catalog()
    c.add("logs-000001", table(spark, sf, "error_logs"))
    c.aliases["logs"] = ["logs-000001"]
    new = c.rollover("logs")
    c.tables[new] = c.tables[new].unionByName(table(spark, sf, "error_logs").where("level = 'ERROR'"))
    return c.scan("logs").groupBy("_index").agg(F.count("*").alias("n"))


def c_check_batch(spark, sf):
    """A batch under a strict and a lenient mapping: unknown fields are refused or left out, types are converted."""
    n = table(spark, sf, "nation")
    batch = n.select(F.col("n_nationkey").cast("string").alias("n_nationkey"), "n_name", F.lit(1).alias("extra"))
    try:
        catalog.check_batch(n.schema, batch, "strict")
        refused = False
    except ValueError:
        refused = True
    kept = catalog.check_batch(n.schema, batch, "runtime")
    return kept.select(F.col("n_nationkey").cast("bigint").alias("n_nationkey"), F.lit(len(kept.columns)).alias("fields"), F.lit(refused).alias("refused"))


def s_totals(spark, sf):
    """Hits counted in full, up to a bound, and not at all."""
    r = search.search(table(spark, sf, "orders"), {"query": {"term": {"o_orderstatus": "F"}}, "size": 1}, "o_orderkey")
    rows = [("all", *r.total(True)), ("bound", *r.total(100)), ("none", *(r.total(False) or (None, None)))]
    return spark.createDataFrame(rows, "tracked string, value bigint, relation string")


def s_count(spark, sf):
    return search.search(table(spark, sf, "documents"), {"query": {"match": {"text": "token cache"}}, "size": 0}, "doc_id").matched.agg(F.count("*").alias("n"))


def s_slices(spark, sf):
    """A search in three slices, which share no hit and miss none."""
    df = table(spark, sf, "part")
    out = None
    for i in range(3):
        h = search.search(df, {"query": {"range": {"p_size": {"gte": 25}}}, "slice": {"id": i, "max": 3}, "size": 10_000, "sort": ["p_partkey"]}, "p_partkey").hits.select("p_partkey")
        out = h if out is None else out.unionByName(h)
    return out


def s_indices_boost(spark, sf):
    c = catalog.Catalog()
    c.add("a", table(spark, sf, "region").select(F.col("r_regionkey").cast("bigint").alias("key"), F.col("r_name").alias("name")))
    c.add("b", table(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("bigint").alias("key"), F.col("n_name").alias("name")))
    h = search.search(c.scan("a,b"), {"query": {"match_all": {}}, "indices_boost": [{"b": 2.5}], "size": 8}, "key").hits
    return h.select("key", F.round("_score", 4).alias("score"))


def s_random_score(spark, sf):
    """Random scores: the same at each run, within 0 and 1, different between rows."""
    body = {"query": {"function_score": {"query": {"term": {"o_orderstatus": "P"}}, "random_score": {"seed": 7}, "boost_mode": "replace"}}, "size": 5000}
    h, again = (search.search(table(spark, sf, "orders"), body, "o_orderkey").hits.select("o_orderkey", F.col("_score").alias(n)) for n in ("s", "t"))
    j = h.join(again, "o_orderkey")
    return j.agg(F.count("*").alias("n"), F.bool_and((F.col("s") >= 0) & (F.col("s") <= 1) & (F.col("s") == F.col("t"))).alias("sound"), (F.count_distinct("s") > 0.9 * F.count("*")).alias("varied"))


def s_template(spark, sf):
    body = search.fill_template('{"query": {"terms": {"o_orderstatus": {{#toJson}}kinds{{/toJson}}}}, "sort": ["o_orderkey"], "size": "{{size}}"}', {"kinds": ["F", "P"], "size": 15})
    return search.search(table(spark, sf, "orders"), body | {"size": int(body["size"])}, "o_orderkey").hits.select("o_orderkey", "o_orderstatus")


def s_post_filter(spark, sf):
    """Hits after a filter that the aggregation doesn't see."""
    body = {"query": {"range": {"p_size": {"gte": 40}}}, "post_filter": {"prefix": {"p_brand": "Brand#1"}}, "aggs": {"n": {"value_count": {"field": "p_size"}}}, "size": 5000, "sort": ["p_partkey"]}
    r = search.search(table(spark, sf, "part"), body, "p_partkey")
    return r.hits.agg(F.count("*").alias("hits")).crossJoin(r.aggs["_metrics"].select(F.col("n").alias("matched")))


def s_fields(spark, sf):
    body = {"sort": ["o_orderkey"], "size": 20, "docvalue_fields": [{"field": "o_orderdate", "format": "yyyy/MM"}, "o_orderstatus"], "_source": False}
    h = search.search(table(spark, sf, "orders"), body, "o_orderkey").hits
    return h.select("o_orderkey", F.col("field_o_orderdate").alias("month"), F.col("field_o_orderstatus").alias("status"))


def s_inner_hits(spark, sf):
    """The two dearest orders of each of the first customers."""
    body = {"collapse": {"field": "o_custkey", "inner_hits": {"name": "dear", "size": 2, "sort": [{"o_totalprice": "desc"}], "_source": ["o_totalprice"]}}, "sort": [{"o_totalprice": "desc"}], "size": 10}
    r = search.search(table(spark, sf, "orders"), body, "o_orderkey")
    return r.inner["dear"].select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"), "rank")


def d_eql(spark, sf):
    q = parse_eql('any where (level : "err*" or duration_ms > 5000) and stack_trace != null and not service in ("indexer", "gateway")')
    df = table(spark, sf, "error_logs")
    return df.where(query.compile_query(df, q, id="span_id")[0].match).groupBy("service").agg(F.count("*").alias("n"))


def d_eql_category(spark, sf):
    q = parse_eql('click where value >= 10 and value < 20', "event_type")
    df = table(spark, sf, "events")
    return df.where(query.compile_query(df, q, id="event_id")[0].match).select("event_id")


def d_pivot(spark, sf):
    config = {"query": {"term": {"o_orderstatus": "F"}}, "pivot": {"group_by": {"c": {"terms": {"field": "o_custkey"}}, "m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "year"}}}, "aggregations": {"spent": {"sum": {"field": "o_totalprice"}}, "dearest": {"max": {"field": "o_totalprice"}}}}}
    t = transforms.pivot(table(spark, sf, "orders"), config, "o_orderkey")
    return t.select("c", "m", "doc_count", F.round("spent", 2).alias("spent"), "dearest")


def d_rollup_job(spark, sf):
    config = {"groups": {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "terms": {"fields": ["event_type"]}}, "metrics": [{"field": "value", "metrics": ["avg", "max"]}]}
    t = transforms.rollup(table(spark, sf, "events"), config, "event_id")
    return t.select(F.col("ts").alias("day"), "event_type", "doc_count", F.round("value_sum", 4).alias("total"), F.col("value_value_count").alias("n"), F.col("value_max").alias("highest"))


def s_lookup_field(spark, sf):
    """Fields of another table as a runtime field."""
    body = {"runtime_mappings": {"nation": {"type": "lookup", "target_index": "nation", "input_field": "c_nationkey", "target_field": "n_nationkey", "fetch_fields": ["n_name"]}}, "sort": ["c_custkey"], "size": 30}
    h = search.search(table(spark, sf, "customer"), body, "c_custkey", tables={"nation": table(spark, sf, "nation")}).hits
    return h.select("c_custkey", F.get("nation", 0)["n_name"].alias("n_name"))


def s_scroll(spark, sf):
    """All hits of a point in time, page by page: as many as there are, none twice."""
    p = search.PointInTime(table(spark, sf, "customer"), "c_custkey")
    total, keys = 0, set()
    for page in p.scroll({"query": {"term": {"c_mktsegment": "BUILDING"}}, "sort": [{"c_nationkey": "desc"}]}, 1000):
        total += len(page)
        keys |= {r["c_custkey"] for r in page}
    return spark.createDataFrame([(total, len(keys))], "hits bigint, different bigint")


def c_policy(spark, sf):
    """Three ticks of a lifecycle: rolled over when it is large, read-only after a day, deleted after a week."""
    c = catalog.Catalog()
    c.add("logs-000001", table(spark, sf, "error_logs"), created=datetime(2025, 1, 1))
    c.aliases["logs"] = ["logs-000001"]
    policy = {"default_state": "hot", "states": [
        {"name": "hot", "actions": [{"rollover": {"max_docs": 100, "max_age": "30d"}}], "transitions": [{"state_name": "warm", "conditions": {"min_index_age": "1d"}}]},
        {"name": "warm", "actions": [{"read_only": {}}], "transitions": [{"state_name": "gone", "conditions": {"min_index_age": "7d"}}]},
        {"name": "gone", "actions": [{"delete": {}}], "transitions": []}]}
    done = []
    for tick, day in enumerate((1, 3, 9, 10)):
        done += [(tick, *x) for x in c.apply_policy("logs", policy, datetime(2025, 1, day))]
    return spark.createDataFrame([*done, (9, ",".join(c.aliases["logs"]), "", "left")], "tick int, name string, state string, action string")


def _mixed_ip(df: DataFrame, *_) -> DataFrame:
    """Addresses of both versions, in short and long notation."""
    u = F.pmod(F.col("user_id"), F.lit(200))
    return df.withColumn("ip", F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("10.0.0."), u.cast("string"))).otherwise(F.concat(F.lit("2001:DB8::"), F.lower(F.hex(u)))))


def _fragments(spark, sf):
    """The marked pieces of the best documents for two words."""
    body = {"query": {"match": {"text": "token cache"}}, "size": 50, "highlight": {"fields": {"text": {"fragment_size": 40, "number_of_fragments": 2}}}}
    h = search.search(table(spark, sf, "documents"), body, "doc_id").hits
    part = F.transform("highlight_text", lambda x: F.regexp_replace(x, "</?em>", ""))
    return h.select("doc_id", (F.size("highlight_text").between(1, 2)).alias("some_"), F.forall(part, lambda x: F.length(x) <= 40).alias("short"))


def _script(name: str, key: str, scripts: dict[str, str], prepare=None):
    """Script fields over whole tables."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = table(spark, sf, name)
        df = prepare(df) if prepare else df
        from searchloom.functions.script import compile_script

        out = {n: compile_script(s, df.schema) for n, s in scripts.items()}
        return df.select(key, *[c.alias(n) for n, c in out.items()])

    return run


def m_doc_count(spark, sf):
    """Rows that stand for several records."""
    from searchloom.operators.aggs import run_aggs

    df = table(spark, sf, "lineitem").withColumn("_doc_count", F.col("l_quantity").cast("bigint"))
    return run_aggs(df, {"k": {"terms": {"field": "l_returnflag"}}}, id="l_orderkey")["k"]


def d_parse_time(spark, sf):
    """Times in four notations come back as the same instant."""
    e = table(spark, sf, "events").select("event_id", F.date_trunc("second", "ts").alias("t"))
    forms = {"iso": "yyyy-MM-dd'T'HH:mm:ss", "plain": "yyyy-MM-dd HH:mm:ss", "web": "dd/MMM/yyyy:HH:mm:ss '+0000'"}
    e = e.withColumns({n: F.date_format("t", f) for n, f in forms.items()}).withColumn("epoch", F.unix_timestamp(F.col("t").cast("timestamp")).cast("string"))
    same = None
    for n in (*forms, "epoch"):
        hit = ingest.parse_time(F.col(n)).cast("timestamp_ntz") == F.col("t").cast("timestamp_ntz")
        same = hit if same is None else same & hit
    return e.select("event_id", same.alias("same"))


def d_convert(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_totalprice").cast("string").alias("p"), "o_orderpriority")
    out = ingest.run_pipeline(o, [{"convert": {"field": "p", "type": "float", "target_field": "price"}}, {"convert": {"field": "o_orderpriority", "type": "integer", "target_field": "bad"}}, {"split": {"field": "o_orderpriority", "separator": "-", "target_field": "parts"}}])
    return out.select("o_orderkey", F.round("price", 2).alias("price"), F.col("bad").isNull().alias("bad"), F.size("parts").alias("parts"))


def d_on_failure(spark, sf):
    """Keys that are no number are marked by the handler of the failed conversion; small ones aren't asked."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "x").otherwise(F.col("c_custkey").cast("string")).alias("k"), F.lit("ok").alias("state"))
    steps = [{"convert": {"field": "k", "type": "integer", "target_field": "n", "if": "doc['c_custkey'].value >= 10", "on_failure": [{"set": {"field": "state", "value": "failed"}}]}}]
    return ingest.simulate(c, steps)[-1].select("c_custkey", F.col("n").cast("bigint").alias("n"), "state")


def d_enrich_policy(spark, sf):
    """A policy built from a table, executed to a lookup, and used by name."""
    p = ingest.EnrichPolicy(table(spark, sf, "nation"), "n_nationkey", ["n_name"]).execute(spark)
    return p.apply(table(spark, sf, "customer"), "c_nationkey").groupBy("n_name").agg(F.count("*").alias("n"))


def d_time_field(spark, sf):
    return spark.createDataFrame([(t, infer.time_field(infer.infer_fields(table(spark, sf, t)))) for t in ("events", "region")], "name string, field string")


def d_cluster_schemas(spark, sf):
    names = {t: table(spark, sf, t).columns for t in ("region", "nation", "events")} | {"events2": table(spark, sf, "events").drop("props").columns}
    groups = sorted(sorted(g) for g in readers.cluster_schemas(names))
    return spark.createDataFrame([(i, ",".join(g)) for i, g in enumerate(groups)], "cluster int, names string")


def d_flatten(spark, sf):
    nested = table(spark, sf, "nation").select(F.struct("n_nationkey", F.struct(F.col("n_name").alias("full name")).alias("inner")).alias("outer"))
    flat = readers.flatten(nested)
    return flat.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(sorted(flat.columns, reverse=True))])


def d_bulk_results(spark, sf):
    """What each bulk action did: creates of what exists and outdated writes are refused, upserts make new rows."""
    t = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("v"), F.lit(1).cast("bigint").alias("_version"))
    a = t.select((F.col("k") + F.when(F.col("k") % 5 == 4, 100).otherwise(0)).alias("k"), F.lit("x").alias("v"), F.element_at(F.array(*map(F.lit, ("index", "create", "update", "delete", "upsert"))), (F.col("k") % 5 + 1).cast("int")).alias("action"), F.when(F.col("k") % 10 == 0, 7).otherwise(1).cast("bigint").alias("if_version"), F.lit(1).alias("seq_no"))
    return ingest.bulk_results(t, a, "k").groupBy("action", "result").agg(F.count("*").alias("n"))


def _nations(spark, sf) -> list:
    return table(spark, sf, "nation").orderBy("n_nationkey").collect()  # 25 rows at any scale


def _put(spark, name: str, data: bytes) -> str:
    """A file in the shared folder."""
    path = scratch_path(spark, "file") + "/" + name
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    out.write(bytearray(data))
    out.close()
    return path


def _nation(key: str, name: str, columns: list | None = None):
    return lambda df: df.select(F.expr(key).cast("bigint").alias("n_nationkey"), F.expr(name).alias("n_name"))


def r_csv(spark, sf):
    path = scratch_path(spark, "csv")
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal").write.csv(path, header=True, sep=";")
    return readers.read_any(spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))


def r_jsonl(spark, sf):
    path = scratch_path(spark, "json")
    table(spark, sf, "customer").select("c_custkey", "c_name").write.json(path)
    return readers.read_any(spark, path).select(F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name")


def r_json(spark, sf):
    path = _put(spark, "n.json", json.dumps([{"k": r["n_nationkey"], "n": {"name": r["n_name"]}} for r in _nations(spark, sf)], indent=1).encode())
    return _nation("k", "n.name")(readers.read_any(spark, path))


def r_xml(spark, sf):
    data = "<?xml version='1.0'?><all>" + "".join(f"<n><k>{r['n_nationkey']}</k><name>{r['n_name']}</name></n>" for r in _nations(spark, sf)) + "</all>"
    return _nation("k", "name")(readers.read_any(spark, _put(spark, "n.xml", data.encode())))


def r_html(spark, sf):
    data = "<!doctype html><html><head><title>Nations</title></head><body>" + "".join(f"<p>{r['n_name']} <a href='/n/{r['n_nationkey']}'>more</a></p>" for r in _nations(spark, sf)) + "</body></html>"
    page = readers.read_any(spark, _put(spark, "n.html", data.encode()))
    return page.select("title", F.size("links").alias("links"))


def r_yaml(spark, sf):
    data = "\n".join(f"---\nkey: {r['n_nationkey']}\ninner:\n  name: {r['n_name']}" for r in _nations(spark, sf))
    return _nation("fields['key']", "fields['inner.name']")(readers.read_any(spark, _put(spark, "n.yaml", data.encode())))


def r_sql_dump(spark, sf):
    rows = ",\n".join(f"({r['n_nationkey']}, '{r['n_name']}')" for r in _nations(spark, sf))
    return _nation("row['k']", "row['name']")(readers.read_any(spark, _put(spark, "n.sql", f"CREATE TABLE n (k int, name text);\nINSERT INTO n VALUES {rows};\n".encode())))


def r_sqlite(spark, sf):
    import os
    import tempfile

    with tempfile.TemporaryDirectory() as d:  # the driver makes a file to read
        db = sqlite3.connect(os.path.join(d, "n.db"))
        db.execute("create table n (k int, name text)")
        db.executemany("insert into n values (?, ?)", [(r["n_nationkey"], r["n_name"]) for r in _nations(spark, sf)])
        db.commit()
        db.close()
        with open(os.path.join(d, "n.db"), "rb") as f:
            path = _put(spark, "n.db", f.read())
    return _nation("row['k']", "row['name']")(readers.read_any(spark, path))


def r_docx(spark, sf):
    import io

    body = "".join(f"<w:p><w:r><w:t>{r['n_nationkey']} {r['n_name']}</w:t></w:r></w:p>" for r in _nations(spark, sf))
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return _nation("split(text, ' ', 2)[0]", "split(text, ' ', 2)[1]")(readers.read_any(spark, _put(spark, "n.docx", b.getvalue())))


def r_sections(spark, sf):
    data = "\n".join(f"# {r['n_name']}\nThis is a line of ordinary prose about one of the nations of the world, number {r['n_nationkey']}.\n" for r in _nations(spark, sf))
    return readers.read_sections(spark, _put(spark, "n.md", data.encode())).select(F.col("title").alias("n_name"))


def r_code(spark, sf):
    data = "\n".join(f"def nation_{r['n_nationkey']}():\n    return 1\n" for r in _nations(spark, sf))
    return readers.read_code(spark, _put(spark, "n.py", data.encode())).select("kind", F.regexp_extract("name", r"(\d+)$", 1).cast("bigint").alias("n_nationkey"))


def r_log_ndjson(spark, sf):
    path = scratch_path(spark, "logs")
    e = table(spark, sf, "error_logs").select(F.date_format("event_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "level", "message")
    e.where("message is not null").write.json(path)
    return logs.read_ndjson(spark, path).groupBy(F.col("hour").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


def r_otlp(spark, sf):
    """Log records of every service in OTLP form, and back."""
    e = table(spark, sf, "error_logs").where("message is not null and service is not null")
    rec = F.struct(F.lit("1700000000000000000").alias("timeUnixNano"), F.col("level").alias("severityText"), F.struct(F.col("message").alias("stringValue")).alias("body"))
    one = F.struct(F.struct(F.array(F.struct(F.lit("service.name").alias("key"), F.struct(F.col("service").alias("stringValue")).alias("value"))).alias("attributes")).alias("resource"), F.array(F.struct(F.struct(F.lit("lib").alias("name")).alias("scope"), F.array(rec).alias("logRecords"))).alias("scopeLogs"))
    flat = logs.flatten_otlp(e.select(F.to_json(F.struct(F.array(one).alias("resourceLogs"))).alias("value")))
    return flat.groupBy(F.col("resource")["service.name"].alias("service"), F.upper("level").alias("level")).agg(F.count("*").alias("n"))


def r_access_log(spark, sf):
    o = table(spark, sf, "orders")
    line = F.concat(F.lit("10.0.0.1 - u [10/Oct/2000:13:55:36 -0700] \"GET /o/"), F.col("o_orderkey").cast("string"), F.lit(" HTTP/1.1\" "), F.when(F.col("o_orderstatus") == "F", "200").otherwise("404"), F.lit(" "), F.col("o_custkey").cast("string"))
    r = logs.read_access_log(o.select(line.alias("value")))
    return r.groupBy("status").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))


def r_sniff(spark, sf):
    """The family of each format from its first bytes."""
    made = {"csv": b"a,b\n1,2\n3,4\n", "jsonl": b'{"a":1}\n{"a":2}\n', "json": b'[{"a":1}]', "xml": b"<?xml version='1.0'?><r><x/></r>", "html": b"<html></html>", "pdf": b"%PDF-1.4", "sqlite": b"SQLite format 3\x00", "yaml": b"name: x\nitems:\n  - a\n"}
    return spark.createDataFrame([(n, readers.sniff(d)["family"]) for n, d in made.items()], "made string, family string")


def w_windows(spark, sf):
    """Closed hourly windows of a stream of all events, from one run over what is there."""
    src, out = scratch_path(spark, "stream"), scratch_path(spark, "windows")
    e = table(spark, sf, "events")
    e.write.parquet(src)
    stream = spark.readStream.schema(e.schema).parquet(src)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.run(jobs.tumbling(stream, "ts", "1 hour", "1 hour", ["event_type"]), out, scratch_path(spark, "progress")).awaitTermination()
    made = spark.read.parquet(out)
    start = next(c for c in made.columns if c in ("start", "bucket", "window"))
    start = F.col("window.start") if start == "window" else F.col(start)
    n = next(c for c in made.columns if c in ("n", "count"))
    return made.select(start.cast("timestamp_ntz").alias("bucket"), "event_type", F.col(n).alias("n"))


def g_link(spark, sf):
    """New edges beside the old ones; repeated ones change nothing."""
    edges = table(spark, sf, "graph_edges")
    new = table(spark, sf, "ai_kb").where("category is not null").select(F.concat(F.lit("kb:"), F.col("id").cast("string")).alias("src"), F.lit("kb:hub").alias("dst"), F.lit("category").alias("edge_type"), F.lit(0.5).alias("weight"), F.lit("2025-01-01").cast("timestamp_ntz").alias("valid_at"))
    once = graph.link(edges, new)
    return graph.link(once, new).groupBy("edge_type").agg(F.count("*").alias("n"))


def g_unlink(spark, sf):
    """All edges of one type end; none is removed."""
    edges = table(spark, sf, "graph_edges")
    kind = edges.agg(F.min("edge_type")).first()[0]
    out = graph.unlink(edges, edges.where(F.col("edge_type") == kind).select("edge_id"), AS_OF)
    return out.groupBy("edge_type").agg(F.count("*").alias("n"), F.count_if(F.col("invalid_at").isNull()).alias("alive"))


def g_ego(spark, sf):
    """Articles at the ends of the edges around the heaviest ones' sources."""
    edges = table(spark, sf, "graph_edges")
    seeds = edges.where("weight is not null").orderBy(F.desc("weight"), "edge_id").limit(10).select(F.col("src").alias("node")).distinct()
    kb = table(spark, sf, "ai_kb")
    return graph.ego(edges, kb, F.concat(F.lit("kb:"), F.col("id").cast("string")), seeds, 100_000).select("id", "hop")


def g_memory_store(spark, sf):
    """Notes are stored but for near copies: a batch made of the notes themselves adds none, one of new directions adds all."""
    kb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    again = kb.where("id % 50 = 0").withColumn("id", F.col("id") + 1_000_000)
    kept = memory.store(kb, again)
    return kept.agg(F.count("*").alias("n"))


def g_shared_pairs(spark, sf):
    """All pairs of documents that share two of the terms they repeat most, before any budget of edges."""
    return graph.shared_terms(table(spark, sf, "documents"), "doc_id", "text", edges_per_doc=None).select("src", "dst", "shared")


def g_recall_vector(spark, sf):
    h = memory.recall(table(spark, sf, "embeddings"), {"knn": {"field": "embedding", "query_vector": KNN}}, 10, "vec_id")
    return h.select("vec_id", F.round("_score", 5).alias("score"))


def g_passage(spark, sf):
    """The chunk of each document with the most words of a query."""
    c = emb.chunks(table(spark, sf, "documents"), "doc_id", "text", 400, 50)
    c = c.withColumn("score", F.regexp_count(F.lower("chunk"), F.lit("token")).cast("double"))
    best = memory.best_passage(c, "doc_id", "score")
    return best.select("doc_id", F.col("passage.ordinal").alias("ordinal"))


_PART = {
    "upper": "doc['p_name'].value.toUpperCase()",
    "long": "doc['p_name'].value.length() > 10 ? 1 : 0",
    "starts": "doc['p_brand'].value.startsWith('Brand#1')",
    "root": "Math.sqrt(doc['p_size'].value) + Math.pow(2, 3) - Math.abs(-1) + Math.max(1, doc['p_size'].value)",
    "clip": "Math.floor(doc['p_retailprice'].value / 7) + Math.min(doc['p_size'].value, 10)",
}
_ORDER = {"year": "doc['o_orderdate'].value.getYear()", "month": "doc['o_orderdate'].value.getMonthValue()", "day": "doc['o_orderdate'].value.getDayOfMonth()", "week": "doc['o_orderdate'].value.getDayOfWeek()"}
_TAGS = {"n": "doc['tags'].length", "none": "doc['tags'].empty"}
_V = {"dot": {"source": "dotProduct(params.q, 'embedding')", "params": {"q": KNN}}, "l1": {"source": "l1norm(params.q, 'embedding')", "params": {"q": KNN}}, "l2": {"source": "l2norm(params.q, 'embedding')", "params": {"q": KNN}}}


def x_vectors(spark, sf):
    out = _script("embeddings", "vec_id", _V)(spark, sf)
    return out.select("vec_id", *[F.round(c, 4).alias(c) for c in _V])


def x_math(spark, sf):
    out = _script("part", "p_partkey", _PART)(spark, sf)
    return out.select("p_partkey", "upper", F.col("long").cast("int").alias("long"), "starts", F.round("root", 6).alias("root"), F.round("clip", 6).alias("clip"))


def x_dates(spark, sf):
    out = _script("orders", "o_orderkey", _ORDER)(spark, sf)
    return out.select("o_orderkey", *[F.col(c).cast("int").alias(c) for c in _ORDER])


def x_lists(spark, sf):
    out = _script("part", "p_partkey", _TAGS, lambda d: d.withColumn("tags", F.split("p_name", " ")))(spark, sf)
    return out.select("p_partkey", F.col("n").cast("int").alias("n"), "none")


def x_limits(spark, sf):
    """Scripts and queries beyond the limits are refused."""
    from searchloom.functions.script import ScriptError, compile_script

    df = table(spark, sf, "region")
    rows = []
    for name, f in {"deep script": lambda: compile_script("(" * 500 + "1" + ")" * 500, df.schema), "unknown": lambda: compile_script("System.exit(0)", df.schema), "deep query": lambda: query.compile_query(df, json.loads('{"dis_max":{"queries":[' * 100 + '{"match_all":{}}' + "]}}" * 100)), "plain": lambda: compile_script("1 + 1", df.schema)}.items():
        try:
            f()
            rows.append((name, False))
        except (ScriptError, query.QueryError, RecursionError):
            rows.append((name, True))
    return spark.createDataFrame(rows, "script string, refused boolean")


QUERIES = {k: f for k, f in list(globals().items()) if k[:2] in ("t_", "v_", "c_", "s_", "m_", "d_", "r_", "w_", "g_", "x_") and callable(f)} | {
    "t_index_search": _indexed({"match": {"text": "token cache replica"}}, True),
    "t_index_query_string": _indexed({"query_string": {"query": "(token OR vector) AND cache AND n_chars:[100 TO 900] -lang:de", "default_field": "text"}}),
    "t_index_simple": _indexed({"simple_query_string": {"query": "+token -replica", "fields": ["text"]}}),
    "t_index_mlt": _indexed({"more_like_this": {"fields": ["text"], "like": ["large index", "snapshot job"]}}),
    "t_index_bool": _indexed({"bool": {"must": [{"match_phrase": {"text": "the token cache"}}], "should": [{"match": {"text": "replica"}}], "filter": [{"range": {"n_chars": {"gte": 100}}}]}}),
    "s_decay": _hits("part", "p_partkey", {"query": {"function_score": {"gauss": {"p_retailprice": {"origin": 1200, "scale": 100, "offset": 20}}, "boost_mode": "replace"}}, "size": 40}, []),
    "s_decay_date": _hits("orders", "o_orderkey", {"query": {"function_score": {"query": {"term": {"o_orderstatus": "F"}}, "functions": [{"exp": {"o_orderdate": {"origin": "1995-06-01", "scale": "30d"}}}], "boost_mode": "replace"}}, "size": 40}, []),
    "q_type": _where("region", "r_regionkey", {"type": {"value": "_doc"}}),
    "q_intersect": _where("part", "p_partkey", {"bool": {"must": [{"range": {"p_size": {"gte": 10}}}, {"prefix": {"p_brand": "Brand#2"}}], "must_not": [{"range": {"p_size": {"gte": 30}}}]}}),
    "t_combined_fields": _where("ai_kb", "id", {"combined_fields": {"query": "question small", "fields": ["title", "content"], "operator": "and"}}),
    "t_span_term": _where("documents", "doc_id", {"span_term": {"text": "token"}}),
    "t_span_or": _where("documents", "doc_id", {"span_or": {"clauses": [{"span_term": {"text": "token"}}, {"span_term": {"text": "replica"}}]}}),
    "v_knn_k": _hits("embeddings", "vec_id", {"query": {"knn": {"field": "embedding", "query_vector": KNN, "k": 5}}, "size": 50}, [], digits=5),
    "m_percentiles_hdr": _metric("percentiles", PRICE | {"percents": [50, 95], "hdr": {"number_of_significant_value_digits": 2}}),
    "m_boxplot_whiskers": _metric("boxplot", PRICE | {"whiskers": True}),
    "b_date_histogram_zone": _agg("orders", "o_orderkey", {"k": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "month", "time_zone": "+05:30", "format": "yyyy-MM", "keyed": True}}}, "k"),
    "b_date_histogram_cells": _agg("events", "event_id", {"k": {"date_histogram": {"field": "ts", "fixed_interval": "6h", "time_zone": "-01:00"}}}, "k"),
    "b_date_range_zone": _agg("orders", "o_orderkey", {"k": {"date_range": {"field": "o_orderdate", "time_zone": "+02:00", "ranges": [{"to": "1995-03-01", "key": "old"}, {"from": "1995-03-01", "key": "new"}]}}}, "k"),
    "b_ip_mixed": _agg("events", "event_id", {"k": {"ip_range": {"field": "ip", "ranges": [{"mask": "2001:db8::/33", "key": "six"}, {"mask": "10.0.0.0/24", "key": "four"}]}}}, "k", prepare=_mixed_ip),
    "b_ip_prefix6": _agg("events", "event_id", {"k": {"ip_prefix": {"field": "ip", "prefix_length": 125, "is_ipv6": True}}}, "k", prepare=_mixed_ip),
    "q_nested_score": _hits("orders", "o_orderkey", {"query": {"nested": {"path": "lines", "score_mode": "sum", "query": {"constant_score": {"filter": {"range": {"lines.l_quantity": {"gte": 40}}}, "boost": 2.0}}}}, "size": 30}, [], prepare=_orders_nested),
    "t_fragments": _fragments,
    "b_percentiles": _agg("lineitem", "l_orderkey", {"k": {"terms": {"field": "l_returnflag"}, "aggs": {"p": {"percentiles": {"field": "l_extendedprice", "percents": [10, 50]}}, "d": {"median_absolute_deviation": {"field": "l_quantity"}}}}}, "k"),
}

_W = f"coalesce({tok('text')}, [])"
_NATION = "select n_nationkey::bigint n_nationkey, n_name from nation"
_EMB = "[" + ", ".join(map(str, KNN)) + "]::double[]"

_BITS = [f"((x >> {7 - b // 2}) & 1)" if b % 2 == 0 else f"((y >> {6 - b // 2}) & 1)" for b in range(15)]
_LETTERS = " || ".join("substr('0123456789bcdefghjkmnpqrstuvwxyz', (" + " + ".join(f"{_BITS[5 * k + j]} * {1 << (4 - j)}" for j in range(5)) + " + 1)::int, 1)" for k in range(3))
#: Ranges joined to the rows that they hold, so that an empty range has a row.
_TWO = "(values ('{a}'), ('{b}')) v(k) left join {rows} on v.k = case when {cond} then '{a}' else '{b}' end"

SQL = {
    "b_geohash": f"select {_LETTERS} k, count(*) doc_count from (select least(floor((lon + 180) / 360 * 256)::bigint, 255) x, least(floor((lat + 90) / 180 * 128)::bigint, 127) y from {CUSTOMER_GEO}) group by 1",
    "b_vwh": """with recursive c as (select p_retailprice v, count(*) n from part where p_retailprice is not null group by 1),
s as (select list(n order by v) n, list(v * n order by v) t, list(v order by v) lo, list(v order by v) hi from c),
g as (select *, list_transform(range(1, len(n)), lambda i: t[i + 1] / n[i + 1] - t[i] / n[i]) d from s),
r as (select n, t, lo, hi, list_position(d, list_min(d))::int m from g
      union all
      select n, t, lo, hi, list_position(d, list_min(d))::int m from (select *, list_transform(range(1, len(n)), lambda i: t[i + 1] / n[i + 1] - t[i] / n[i]) d from
        (select n[:m - 1] || [n[m] + n[m + 1]] || n[m + 2:] n, t[:m - 1] || [t[m] + t[m + 1]] || t[m + 2:] t, lo[:m] || lo[m + 2:] lo, hi[:m - 1] || hi[m + 1:] hi from r where len(n) > 6))),
f as (select * from r order by len(n) limit 1)
select round(unnest(list_transform(range(1, len(n) + 1), lambda i: t[i] / n[i])), 4) k, round(unnest(lo), 4) as min, round(unnest(hi), 4) as max, unnest(n) doc_count from f""",
    "d_anomaly_score": """with recursive b as (select event_type, date_trunc('hour', ts)::timestamp bucket, count(*)::double as value from events group by 1, 2),
o as (select *, row_number() over (partition by event_type order by bucket) i from b),
r as (select event_type, bucket, value, i, null::double expected, null::double std, null::double z, false anomaly, 1::bigint n, value mean, 0.0::double m2 from o where i = 1
      union all
      select event_type, bucket, value, i, expected, std, z, anomaly, case when anomaly then n else n + 1 end, case when anomaly then mean else mean + (value - mean) / (n + 1) end,
             case when anomaly then m2 else m2 + (value - mean) * (value - (mean + (value - mean) / (n + 1))) end
      from (select *, coalesce(abs(z) > 3, false) anomaly from
        (select *, case when expected is null then null when std > 0 then (value - expected) / std when value = expected then 0 when value > expected then 'inf'::double else '-inf'::double end z from
          (select o.event_type, o.bucket, o.value, o.i, case when r.n >= 4 then r.mean end expected, case when r.n >= 4 then sqrt(r.m2 / r.n) end std, r.n, r.mean, r.m2 from r join o on o.event_type = r.event_type and o.i = r.i + 1))))
select event_type, bucket, value, round(expected, 6) expected, round(std, 6) std, round(z, 6) z, round(coalesce(100 * (1 - pow(2, -abs(z) / 3)), 0), 6) score, anomaly from r""",
    "b_date_histogram_zone": """with l as (select date_trunc('month', o_orderdate::timestamp + interval 330 minute) m from orders), e as (select min(m) a, max(m) b from l),
g as (select unnest(generate_series(a, b, interval 1 month)) m from e)
select g.m - interval 330 minute k, count(l.m) doc_count, strftime(g.m, '%Y-%m') k_as_string from g left join l using (m) group by g.m""",
    "b_date_histogram_cells": """with l as (select time_bucket(interval 6 hour, ts - interval 1 hour, timestamp '1970-01-01') m from events), e as (select min(m) a, max(m) b from l), g as (select unnest(generate_series(a, b, interval 6 hour)) m from e)
select g.m + interval 1 hour k, count(l.m) doc_count, strftime(g.m, '%Y-%m-%dT%H:%M:%S.000-01:00') k_as_string from g left join l using (m) group by g.m""",
    "b_date_range_zone": "select v.k, count(o_orderkey) doc_count from " + _TWO.format(a="old", b="new", rows="orders", cond="o_orderdate::timestamp + interval 2 hour < timestamp '1995-03-01'") + " group by v.k",
    "b_ip_mixed": "select v.k, count(event_id) doc_count from " + _TWO.format(a="four", b="six", rows="events", cond="event_id % 2 = 0") + " group by v.k",
    "b_ip_prefix6": "select '2001:0db8:0000:0000:0000:0000:0000:' || lpad(printf('%x', ((user_id % 200) // 8 * 8)), 4, '0') k, count(*) doc_count from events where event_id % 2 = 1 group by 1",
    "q_nested_score": "select o_orderkey, score from (select l_orderkey o_orderkey, round(2.0 * count(*) filter (where l_quantity >= 40), 6)::double score from lineitem where l_orderkey in (select o_orderkey from orders) group by 1 having score > 0) order by score desc, o_orderkey limit 30",
    "t_fragments": "with " + bm25("documents", "doc_id", "text", ["token", "cache"]) + " select doc_id, true as some_, true as short from b where score > 0 order by b.score desc, doc_id limit 50",
    "t_index_search": _SEARCH_SQL["t_bm25"],
    "t_index_query_string": _SEARCH_SQL["t_query_string"],
    "t_index_simple": _SEARCH_SQL["t_simple_query_string"],
    "t_index_mlt": _SEARCH_SQL["t_mlt"],
    "t_index_bool": f"select doc_id from documents where contains(' ' || array_to_string({_W}, ' ') || ' ', ' the token cache ') and n_chars >= 100",
    "t_index_bm25": "with " + bm25("documents", "doc_id", "text", ["token", "cache", "replica"]) + " select doc_id, round(score, 6) score from b where score > 0 order by b.score desc, doc_id limit 25",
    "t_index_and": f"select doc_id from documents where list_contains({_W}, 'token') and list_contains({_W}, 'cache')",
    "t_index_phrase": f"select doc_id from documents where contains(' ' || array_to_string({_W}, ' ') || ' ', ' the token cache ')",
    "t_index_terms": f"select term, count(*) n from (select unnest({_W}) term from documents) where starts_with(term, 'se') group by 1 order by 1 limit 50",
    "t_index_suggest": f"select term, count(*) df, levenshtein(term, 'segmant')::int distance from (select unnest(list_distinct({_W})) term from documents) where levenshtein(term, 'segmant') <= 2 group by 1 order by 3, 2 desc, 1 limit 5",
    "v_knn_total": f"with r as (select vec_id from (select vec_id, list_cosine_similarity(list_transform(embedding, lambda x: x::double), {_EMB}) s from embeddings) order by s desc, vec_id limit 25) select count(*) n, max(vec_id)::double highest from r",
    "v_index_knn": "select true as found",
    "v_knn_k": _knn_sql("(1 + list_cosine_similarity(x, q)) / 2").replace("limit 10", "limit 5"),
    "c_scan": "select 'geo-region' _index, count(*) n, 0::bigint named from region union all select 'geo-nation', count(*), count(n_name) from nation",
    "c_field_caps": "select unnest(['r_regionkey', 'r_name']) field, 1 tables, 'region' as names union all select unnest(['n_nationkey', 'n_name', 'n_regionkey']), 1, 'nation'",
    "c_validate": "select * from (values ('term', true), ('no field', false), ('no type', false), ('child', false), ('type', true)) t(asked, valid)",
    "c_rollover": "select 'logs-000001' _index, count(*) n from error_logs union all select 'logs-000002', count(*) from error_logs where level = 'ERROR'",
    "c_check_batch": "select n_nationkey::bigint n_nationkey, 2 fields, true refused from nation",
    "s_totals": "select 'all' tracked, count(*) as value, 'eq' relation from orders where o_orderstatus = 'F' union all select 'bound', least(100, count(*)), case when count(*) > 100 then 'gte' else 'eq' end from orders where o_orderstatus = 'F' union all select 'none', null, null",
    "s_count": f"select count(*) n from documents where list_contains({_W}, 'token') or list_contains({_W}, 'cache')",
    "s_slices": "select p_partkey from part where p_size >= 25",
    "s_indices_boost": "select key, score from (select r_regionkey::bigint key, 1.0::double score from region union all select n_nationkey + 100, 2.5 from nation) order by score desc, key limit 8",
    "s_random_score": "select least(count(*), 5000) n, true sound, true varied from orders where o_orderstatus = 'P'",
    "s_template": "select o_orderkey, o_orderstatus from orders where o_orderstatus in ('F', 'P') order by o_orderkey limit 15",
    "s_post_filter": "select count(*) filter (where starts_with(p_brand, 'Brand#1')) hits, count(*) matched from part where p_size >= 40",
    "s_fields": "select o_orderkey, strftime(o_orderdate, '%Y/%m') as month, o_orderstatus status from orders order by o_orderkey limit 20",
    "s_inner_hits": """with best as (select o_custkey, max(o_totalprice) p, arg_min(o_orderkey, struct_pack(a := -o_totalprice, b := o_orderkey)) k from orders group by 1), top as (select * from best order by p desc, k limit 10),
r as (select o_custkey, o_orderkey, o_totalprice price, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey)::int as rank from orders where o_custkey in (select o_custkey from top)) select * from r where rank <= 2""",
    "m_doc_count": "select l_returnflag k, sum(l_quantity::bigint)::bigint doc_count from lineitem group by 1",
    "m_percentiles_hdr": 'with h as (select floor(l_extendedprice / u) * u v from (select l_extendedprice, pow(10, floor(log10(l_extendedprice)) - 1) u from lineitem where l_extendedprice > 0)) select round(quantile_cont(v, 0.5), 4) as "50", round(quantile_cont(v, 0.95), 4) as "95" from h',
    "m_boxplot_whiskers": """with q as (select min(l_extendedprice) mn, max(l_extendedprice) mx, quantile_cont(l_extendedprice, 0.25) a, quantile_cont(l_extendedprice, 0.5) b, quantile_cont(l_extendedprice, 0.75) c from lineitem)
select round(any_value(mn), 4) as min, round(any_value(a), 4) q1, round(any_value(b), 4) q2, round(any_value(c), 4) q3, round(any_value(mx), 4) as max, round(min(l_extendedprice), 4) as lower, round(max(l_extendedprice), 4) as upper
from lineitem, q where l_extendedprice between a - 1.5 * (c - a) and c + 1.5 * (c - a)""",
    "b_percentiles": 'with m as (select l_returnflag k, median(l_quantity) m from lineitem group by 1) select l_returnflag k, count(*) doc_count, round(quantile_cont(l_extendedprice, 0.1), 4) as p_10, round(quantile_cont(l_extendedprice, 0.5), 4) as p_50, round(median(abs(l_quantity - m)), 4) d from lineitem join m on l_returnflag = k group by 1',
    "s_decay": "select p_partkey, round(pow(0.5, pow(greatest(0, abs(p_retailprice - 1200) - 20) / 100, 2)), 6) score from part order by pow(0.5, pow(greatest(0, abs(p_retailprice - 1200) - 20) / 100, 2)) desc, p_partkey limit 40",
    "s_decay_date": "select o_orderkey, round(pow(0.5, d), 6) score from (select o_orderkey, abs(epoch_us(o_orderdate::timestamp) - epoch_us(timestamp '1995-06-01')) / 1000 / (30 * 86400000.0) d from orders where o_orderstatus = 'F') order by d, o_orderkey limit 40",
    "q_type": "select r_regionkey from region",
    "q_intersect": "select p_partkey from part where p_size >= 10 and p_size < 30 and starts_with(p_brand, 'Brand#2')",
    "t_combined_fields": f"select id from (select id, list_concat(coalesce({tok('title')}, []), coalesce({tok('content')}, [])) w from ai_kb) where list_contains(w, 'question') and list_contains(w, 'small')",
    "t_span_term": f"select doc_id from documents where list_contains({_W}, 'token')",
    "t_span_or": f"select doc_id from documents where list_contains({_W}, 'token') or list_contains({_W}, 'replica')",
    "d_parse_time": "select event_id, true same from events",
    "d_convert": "select o_orderkey, round(o_totalprice, 2) price, true bad, len(string_split(o_orderpriority, '-'))::int parts from orders",
    "d_on_failure": "select c_custkey, case when c_custkey >= 10 and c_custkey % 3 <> 0 then c_custkey end n, case when c_custkey >= 10 and c_custkey % 3 = 0 then 'failed' else 'ok' end state from customer",
    "d_enrich_policy": "select n_name, count(*) n from customer left join nation on c_nationkey = n_nationkey group by 1",
    "d_time_field": "select * from (values ('events', 'ts'), ('region', null)) t(name, field)",
    "d_cluster_schemas": "select * from (values (0, 'events,events2'), (1, 'nation'), (2, 'region')) t(cluster, names)",
    "d_flatten": "select n_nationkey c0, n_name c1 from nation",
    "d_bulk_results": """with a as (select n_nationkey k, ['index', 'create', 'update', 'delete', 'upsert'][(n_nationkey % 5 + 1)::int] action from nation)
select action, case when action = 'index' and k % 10 = 0 then 'conflict' when action = 'index' then 'updated' when action = 'create' then 'conflict' when action = 'update' then 'updated' when action = 'delete' then 'deleted' else 'created' end result, count(*) n from a group by 1, 2""",
    "d_eql": "select service, count(*) n from error_logs where (lower(level) like 'err%' or duration_ms > 5000) and stack_trace is not null and coalesce(service not in ('indexer', 'gateway'), true) group by 1",
    "d_eql_category": "select event_id from events where event_type = 'click' and value >= 10 and value < 20",
    "d_pivot": "select o_custkey c, date_trunc('year', o_orderdate)::timestamp m, count(*) doc_count, round(sum(o_totalprice), 2) spent, max(o_totalprice) dearest from orders where o_orderstatus = 'F' group by 1, 2",
    "d_rollup_job": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) doc_count, round(sum(value), 4) total, count(value) n, max(value) highest from events group by 1, 2",
    "s_lookup_field": "select c_custkey, n_name from customer left join nation on c_nationkey = n_nationkey order by c_custkey limit 30",
    "s_scroll": "select count(*) hits, count(distinct c_custkey) as different from customer where c_mktsegment = 'BUILDING'",
    "c_policy": "select * from (values (0, 'logs-000001', 'hot', 'rollover'), (2, 'logs-000001', 'warm', 'read_only'), (2, 'logs-000002', 'warm', 'read_only'), (3, 'logs-000001', 'gone', 'delete'), (3, 'logs-000002', 'gone', 'delete'), (9, '', '', 'left')) t(tick, name, state, action)",
    "r_csv": "select c_custkey, c_name, c_acctbal from customer",
    "r_jsonl": "select c_custkey, c_name from customer",
    "r_html": "select 'Nations' title, count(*)::int links from nation",
    "r_sections": "select n_name from nation",
    "r_code": "select 'function' kind, n_nationkey::bigint n_nationkey from nation",
    "r_log_ndjson": "select date_trunc('hour', event_ts)::timestamp as hour, count(*) n from error_logs where message is not null group by 1",
    "r_otlp": "select service, upper(level) as level, count(*) n from error_logs where message is not null and service is not null group by 1, 2",
    "r_access_log": "select case when o_orderstatus = 'F' then 200 else 404 end status, count(*) n, sum(o_custkey)::bigint total from orders group by 1",
    "r_sniff": "select unnest(['csv', 'jsonl', 'json', 'xml', 'html', 'pdf', 'sqlite', 'yaml']) made, unnest(['csv', 'jsonl', 'json', 'xml', 'html', 'pdf', 'sqlite', 'yaml']) family",
    "w_windows": "with w as (select date_trunc('hour', ts)::timestamp bucket, event_type, count(*) n from events group by 1, 2) select * from w where bucket + interval 1 hour <= (select max(ts) - interval 1 hour from events)",
    "g_link": "select edge_type, count(*) n from graph_edges group by 1 union all select 'category', count(*) from ai_kb where category is not null",
    "g_unlink": "select edge_type, count(*) n, case when edge_type = (select min(edge_type) from graph_edges) then 0 else count(*) filter (where invalid_at is null) end alive from graph_edges group by 1",
    "g_ego": "with s as (select distinct src node from (select * from graph_edges where weight is not null order by weight desc, edge_id limit 10)), e as (select * from graph_edges where invalid_at is null and src in (select node from s)), n as (select src node from e union select dst from e) select id, 1 as hop from ai_kb where 'kb:' || id in (select node from n)",
    "g_memory_store": "select count(*) n from embeddings",
    "g_shared_pairs": f"""with t as (select d, t, count(*) n from (select doc_id d, unnest({_W}) t from documents) where len(t) > 2 group by 1, 2), n as (select count(*) n from documents),
f as (select t, count(*) df from t group by t having df >= 2 and df <= least(64, 0.1 * (select n from n))),
r as (select d, t from t join f using (t) qualify row_number() over (partition by d order by t.n desc, df, t) <= 24)
select a.d src, b.d dst, count(*) shared from r a join r b on a.t = b.t and a.d < b.d group by 1, 2 having shared >= 2""",
    "g_recall_vector": _knn_sql("(1 + list_cosine_similarity(x, q)) / 2"),
    "x_vectors": f"select vec_id, round(list_dot_product(x, q), 4) dot, round(list_sum(list_transform(list_zip(x, q), lambda p: abs(p[1] - p[2]))), 4) l1, round(list_distance(x, q), 4) l2 from (select vec_id, list_transform(embedding, lambda x: x::double) x, {_EMB} q from embeddings)",
    "x_math": "select p_partkey, upper(p_name) as upper, (len(p_name) > 10)::int as long, starts_with(p_brand, 'Brand#1') starts, round(sqrt(p_size) + 8 - 1 + greatest(1, p_size), 6) root, round(floor(p_retailprice / 7) + least(p_size, 10), 6) clip from part",
    "x_dates": "select o_orderkey, year(o_orderdate)::int as year, month(o_orderdate)::int as month, day(o_orderdate)::int as day, isodow(o_orderdate)::int as week from orders",
    "x_lists": "select p_partkey, len(string_split(p_name, ' '))::int n, false as none from part",
    "x_limits": "select * from (values ('deep script', true), ('unknown', true), ('deep query', true), ('plain', false)) t(script, refused)",
} | {n: _NATION for n in ("r_json", "r_xml", "r_yaml", "r_sql_dump", "r_sqlite", "r_docx")}
