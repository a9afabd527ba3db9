"""Queries of ingest, logs, inference, anomalies, graph and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import embed as emb
from searchloom.operators import anomaly, graph, memory
from searchloom.plans.search import search
from searchloom.queries_search import table, tok
from searchloom.sources import infer, ingest, logs

SEEDS = ["kb:1", "kb:2", "kb:3", "kb:5", "kb:8", "kb:13", "kb:21"]
AS_OF = "2025-01-01 00:00:00"


def d_enrich(spark, sf):
    o = ingest.enrich(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey", ["c_mktsegment"])
    return o.groupBy("c_mktsegment").agg(F.count("*").alias("n"))


def d_json_parse(spark, sf):
    e = ingest.run_pipeline(table(spark, sf, "events"), [{"json_parse": {"field": "props", "schema": "k int", "target_field": "parsed"}}, {"set": {"field": "seen", "value": True}}])
    return e.select("event_id", F.col("parsed.k").alias("k"), "seen")


def d_pii(spark, sf):
    d = table(spark, sf, "documents").where("text is not null")
    d = d.withColumn("text", F.concat("text", F.lit(" mail "), F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit("@example.org")), F.lit(" from 10.1.2."), (F.col("doc_id") % 256).cast("string")))
    r = ingest.redact(F.col("text"), ["email", "ip"])
    return d.select("doc_id", F.regexp_count(r, F.lit(r"\[REDACTED_EMAIL\]")).alias("emails"), F.regexp_count(r, F.lit(r"\[REDACTED_IP\]")).alias("ips"))


def d_grok(spark, sf):
    m = ingest.grok(table(spark, sf, "error_logs"), "message", "bulk of %{INT:rows} rows accepted in %{INT:ms} ms")
    return m.where("rows is not null").select("span_id", F.col("rows").cast("bigint").alias("rows"), F.col("ms").cast("bigint").alias("ms"))


def d_syslog(spark, sf):
    e = table(spark, sf, "error_logs").where("message is not null")
    line = F.concat(F.lit("<"), (F.length("message") % 192).cast("string"), F.lit(">Jan  2 03:04:05 "), "hostname", F.lit(" svc[42]: "), "message")
    p = logs.parse_syslog(e.select("span_id", line.alias("value")))
    return p.groupBy("facility", "severity").agg(F.count("*").alias("n"))


def d_url_decode(spark, sf):
    p = table(spark, sf, "part").withColumn("u", F.url_encode("p_name"))
    return ingest.run_pipeline(p, [{"url_decode": {"field": "u", "target_field": "name"}}, {"uppercase": {"field": "name"}}]).select("p_partkey", "name")


def d_conditional(spark, sf):
    o = ingest.run_pipeline(table(spark, sf, "orders"), [{"set": {"field": "o_orderpriority", "value": "big", "if": "doc['o_totalprice'].value > 200000"}}, {"drop": {"if": "doc['o_orderstatus'].value == 'P'"}}])
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("n"))


def d_bulk(spark, sf):
    """Changes to customers: later ones win, deletes remove, partial updates keep the rest."""
    c = table(spark, sf, "customer")
    a = c.where("c_custkey % 3 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("int").alias("c_nationkey"), F.lit(0.0).alias("c_acctbal"), F.lit(None).cast("string").alias("c_mktsegment"), F.lit("update").alias("action"), F.lit(1).alias("seq_no"))
    b = a.where("c_custkey % 2 = 0").withColumn("action", F.lit("delete")).withColumn("seq_no", F.lit(2))
    n = a.where("c_custkey % 9 = 0").withColumn("c_custkey", F.col("c_custkey") + 10_000_000).withColumn("c_name", F.lit("new")).withColumn("action", F.lit("index"))
    return ingest.bulk_apply(c, a.unionByName(b).unionByName(n), "c_custkey").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")


def d_update_by_query(spark, sf):
    o = ingest.update_by_query(table(spark, sf, "orders"), {"term": {"o_orderstatus": "F"}}, {"o_totalprice": "doc['o_totalprice'].value * 2"}, "o_orderkey")
    return ingest.delete_by_query(o, {"range": {"o_totalprice": {"lt": 100000}}}, "o_orderkey").select("o_orderkey", "o_totalprice")


def d_log_template(spark, sf):
    e = table(spark, sf, "error_logs").where("message is not null")
    return e.groupBy(logs.template(F.col("message")).alias("template")).agg(F.count("*").alias("n"))


def d_log_histogram(spark, sf):
    return logs.log_histogram(table(spark, sf, "error_logs"), 3600).select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "level", "n")


def d_log_filter(spark, sf):
    f = logs.log_filter(table(spark, sf, "error_logs"), level="error", contains={"message": "a"}, between={"duration_ms": (10, 100000)}, start="2025-01-01", end="2025-01-02 12:00:00")
    return f.select("span_id", "duration_ms")


def d_retention(spark, sf):
    return logs.retain(table(spark, sf, "error_logs"), "2025-01-03 00:00:00", 2).groupBy("service").agg(F.count("*").alias("n"))


def d_transform(spark, sf):
    """A pivot into an entity table."""
    return table(spark, sf, "events").groupBy("user_id").pivot("event_type", ["click", "view", "purchase"]).agg(F.count("event_id")).fillna(0)


def d_rollup(spark, sf):
    e = table(spark, sf, "events")
    d = F.date_trunc("day", F.col("ts")).cast("timestamp_ntz")
    return e.groupBy(d.alias("day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"), F.max("value").alias("highest"))


def d_anomaly_buckets(spark, sf):
    b = anomaly.buckets(table(spark, sf, "events"), "ts", "1 hour", "mean", "value")
    return b.select("bucket", F.round("value", 6).alias("value"))


def d_anomaly_score(spark, sf):
    s = anomaly.score(anomaly.buckets(table(spark, sf, "events"), "ts", "1 hour", "count", by=["event_type"]), ["event_type"])
    return s.select("event_type", "bucket", "value", *[F.round(c, 6).alias(c) for c in ("expected", "std", "z", "score")], "anomaly")


def d_key_overlap(spark, sf):
    o = infer.key_overlap(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer"), "c_custkey")
    return o.withColumn("containment", F.round("containment", 6))


def d_time_alignment(spark, sf):
    a = infer.time_alignment(table(spark, sf, "orders"), "o_orderdate", table(spark, sf, "lineitem"), "l_shipdate", "month")
    return a.withColumn("r", F.round("r", 6))


def d_infer_schema(spark, sf):
    rows = [(f["field"], f["type"], f["entity"]) for f in infer.infer_fields(table(spark, sf, "error_logs"))]
    return spark.createDataFrame(rows, "field string, type string, entity string")


def v_embed(spark, sf):
    d = table(spark, sf, "part").select("p_partkey", emb.embed(F.col("p_name"), 64).alias("v"))
    return d.select("p_partkey", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double")), 5).alias("total"))


def v_chunk(spark, sf):
    return emb.chunks(table(spark, sf, "documents"), "doc_id", "text", 400, 50).select("doc_id", "ordinal", "start", "end")


def v_semantic(spark, sf):
    """Documents by the likeness of their lexical embedding to a text's."""
    d = table(spark, sf, "part").withColumn("v", emb.embed(F.col("p_name"), 64))
    h = search(d, {"query": {"semantic": {"field": "v", "query": "small blue steel"}}, "size": 10}, "p_partkey", embed=lambda t: emb.embed_text(t, 64)).hits
    return h.select("p_partkey", F.round("_score", 5).alias("score"))


def _edges(spark, sf):
    return table(spark, sf, "graph_edges")


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """The ends of the edges of greatest weight."""
    e = _edges(spark, sf).where("weight is not null").orderBy(F.desc("weight"), "edge_id").limit(10)
    return e.select(F.col("src").alias("node")).distinct()


def g_expand_1hop(spark, sf):
    return graph.expand(_edges(spark, sf), _seeds(spark, sf)).select("edge_id", "hop")


def g_expand_2hop(spark, sf):
    return graph.expand(_edges(spark, sf), _seeds(spark, sf), 2, "both").select("edge_id", "hop")


def g_as_of(spark, sf):
    return graph.expand(_edges(spark, sf), _seeds(spark, sf), 1, "both", as_of=AS_OF).select("edge_id", "hop")


def g_overview(spark, sf):
    return graph.overview(_edges(spark, sf))


def g_degrees(spark, sf):
    return graph.degrees(_edges(spark, sf))


def g_proximity(spark, sf):
    return graph.proximity(_edges(spark, sf), _seeds(spark, sf), 1).withColumn("proximity", F.round("proximity", 6))


def g_shared_term(spark, sf):
    return graph.shared_terms(table(spark, sf, "documents"), "doc_id", "text").select("src", "dst", "shared")


def g_links(spark, sf):
    d = table(spark, sf, "ai_kb").select("id", F.concat(F.lit("see [[kb:"), F.col("id").cast("string"), F.lit("]] and [x](a/"), F.col("source"), F.lit(") in src/main.rs:12")).alias("t"))
    return graph.detect_links(d, "id", "t").select("src", "dst", "edge_type")


def g_recall_recency(spark, sf):
    kb = table(spark, sf, "ai_kb").where("indexed_at is not null")
    h = search(kb, {"query": {"match": {"content": "cache shard"}}, "size": 40}, "id").hits
    return memory.blend_recency(h, "indexed_at", 0.3).select("id", F.round("blended", 6).alias("blended"))


def g_recall_blend(spark, sf):
    h = search(table(spark, sf, "ai_kb"), {"query": {"match": {"content": "cache shard"}}, "size": 40}, "id").hits.withColumn("node", F.concat(F.lit("kb:"), F.col("id").cast("string")))
    near = graph.proximity(_edges(spark, sf), h.orderBy(F.desc("_score"), "id").limit(5).select("node"), 1)
    return memory.blend_graph(h, near, "node").select("id", F.round("blended", 6).alias("blended"))


QUERIES = {k: f for k, f in list(globals().items()) if k[:2] in ("d_", "g_", "v_") and callable(f)}

_SEEDS = "s as (select distinct src node from (select * from graph_edges where weight is not null order by weight desc, edge_id limit 10))"
_LIVE = "l as (select * from graph_edges where invalid_at is null)"
_W = f"coalesce({tok('content')}, [])"
_KB = f"""w as (select id, indexed_at, {_W} words from ai_kb), st as (select count(*) n, avg(len(words)) filter (where len(words) > 0) avgdl from w),
 q as (select * from (values ('cache'), ('shard')) q(term)), dfs as (select term, count(*) filter (where list_contains(words, term)) df from w, q group by term),
 b as (select id, any_value(indexed_at) indexed_at, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / avgdl))) score
       from (select w.*, q.term, len(list_filter(w.words, lambda x: x = q.term)) f from w, q) t join dfs using (term), st group by id),
 h as (select * from b where score > 0 order by score desc, id limit 40)"""

SQL = {
    "d_enrich": "select c_mktsegment, count(*) n from orders left join customer on o_custkey = c_custkey group by 1",
    "d_json_parse": "select event_id, (props ->> 'k')::int k, true seen from events",
    "d_pii": "select doc_id, len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'))::int + 1 emails, len(regexp_extract_all(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}', 'X', 'g'), '\\b([0-9]{1,3}\\.){3}[0-9]{1,3}\\b|\\b([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\\b'))::int + 1 ips from documents where text is not null",
    "d_grok": "select span_id, regexp_extract(message, 'bulk of ([+-]?[0-9]+) rows accepted in ([+-]?[0-9]+) ms', 1)::bigint as rows, regexp_extract(message, 'bulk of ([+-]?[0-9]+) rows accepted in ([+-]?[0-9]+) ms', 2)::bigint ms from error_logs where regexp_matches(message, 'bulk of ([+-]?[0-9]+) rows accepted in ([+-]?[0-9]+) ms')",
    "d_syslog": "select (len(message) % 192 // 8)::int facility, (len(message) % 192 % 8)::int severity, count(*) n from error_logs where message is not null group by 1, 2",
    "d_url_decode": "select p_partkey, upper(p_name) as name from part",
    "d_conditional": "select case when o_totalprice > 200000 then 'big' else o_orderpriority end o_orderpriority, count(*) n from orders where o_orderstatus <> 'P' group by 1",
    "d_bulk": """select c_custkey, c_name, case when c_custkey % 3 = 0 then 0 else c_acctbal end c_acctbal, c_mktsegment from customer where not (c_custkey % 3 = 0 and c_custkey % 2 = 0)
union all select c_custkey + 10000000, 'new', 0.0, null from customer where c_custkey % 9 = 0""",
    "d_update_by_query": "select o_orderkey, p o_totalprice from (select o_orderkey, case when o_orderstatus = 'F' then o_totalprice * 2 else o_totalprice end p from orders) where p >= 100000",
    "d_log_template": "select array_to_string(list_transform(regexp_split_to_array(message, '\\s+'), lambda t: case when regexp_matches(t, '[0-9]') then '{}' else t end), ' ') template, count(*) n from error_logs where message is not null group by 1",
    "d_log_histogram": "select date_trunc('hour', event_ts)::timestamp bucket, coalesce(upper(level), 'UNKNOWN') as level, count(*) n from error_logs where event_ts is not null group by 1, 2",
    "d_log_filter": "select span_id, duration_ms from error_logs where lower(level) = 'error' and contains(message, 'a') and duration_ms between 10 and 100000 and event_ts between timestamp '2025-01-01' and timestamp '2025-01-02 12:00:00'",
    "d_retention": "select service, count(*) n from error_logs where date_trunc('hour', event_ts) >= timestamp '2025-01-01' group by 1",
    "d_transform": "select user_id, count(*) filter (where event_type = 'click') click, count(*) filter (where event_type = 'view') as view, count(*) filter (where event_type = 'purchase') purchase from events group by 1",
    "d_rollup": "select date_trunc('day', ts)::timestamp as day, event_type, count(*) n, round(sum(value), 4) total, max(value) highest from events group by 1, 2",
    "d_anomaly_buckets": "select date_trunc('hour', ts)::timestamp bucket, round(avg(value), 6) as value from events group by 1",
    "d_key_overlap": "with a as (select distinct o_custkey v from orders where o_custkey is not null), b as (select distinct c_custkey v from customer where c_custkey is not null), n as (select (select count(*) from a) distinct_a, (select count(*) from b) distinct_b, (select count(*) from a join b using (v)) shared) select *, round(shared / least(distinct_a, distinct_b), 6) containment, case when shared < 25 or shared / least(distinct_a, distinct_b) < 0.3 then 'none' when shared / least(distinct_a, distinct_b) >= 0.7 then 'strong' else 'weak' end strength from n",
    "d_time_alignment": "with a as (select date_trunc('month', o_orderdate) t, count(*) x from orders group by 1), b as (select date_trunc('month', l_shipdate) t, count(*) y from lineitem group by 1) select count(*) pairs, round(corr(x, y), 6) r from a join b using (t)",
    "g_expand_1hop": f"with {_SEEDS}, {_LIVE} select distinct edge_id, 1 hop from l where src in (select node from s)",
    "g_expand_2hop": f"""with {_SEEDS}, {_LIVE}, e as (select * from l where src in (select node from s) or dst in (select node from s)),
f as (select src node from e union select dst from e), n as (select node from f where node not in (select node from s)),
e2 as (select * from l where src in (select node from n) or dst in (select node from n))
select edge_id, min(hop) hop from (select edge_id, 1 hop from e union all select edge_id, 2 from e2) group by 1""",
    "g_as_of": f"with {_SEEDS}, l as (select * from graph_edges where valid_at <= timestamp '{AS_OF}' and (invalid_at is null or invalid_at > timestamp '{AS_OF}')) select distinct edge_id, 1 hop from l where src in (select node from s) or dst in (select node from s)",
    "g_overview": "with e as (select distinct on (edge_id) * from graph_edges), n as (select edge_type, count(distinct node) nodes from (select edge_type, src node from e union all select edge_type, dst from e) group by 1) select edge_type, count(*) edges, count(*) filter (where invalid_at is null) alive, any_value(nodes) nodes from e join n using (edge_type) group by 1",
    "g_degrees": "with e as (select distinct on (edge_id) * from graph_edges) select node, sum(o)::bigint out_degree, sum(i)::bigint in_degree from (select src node, 1 o, 0 i from e union all select dst, 0, 1 from e) group by 1",
    "g_proximity": f"with {_SEEDS}, {_LIVE}, e as (select * from l where src in (select node from s) or dst in (select node from s)), p as (select src node, 0.5 * greatest(0, least(1, coalesce(weight, 0))) p from e union all select dst, 0.5 * greatest(0, least(1, coalesce(weight, 0))) from e union all select node, 1 from s) select node, round(max(p), 6)::double proximity from p group by 1",
    "g_shared_term": f"""with t as (select doc_id d, unnest(list_distinct({tok('text')})) t from documents), n as (select count(*) n from documents),
f as (select t, count(*) df from t where len(t) > 2 group by t having df >= 2 and df <= least(64, 0.1 * (select n from n))),
r as (select d, t from t join f using (t) qualify row_number() over (partition by d order by df, t) <= 24),
p as (select a.d src, b.d dst, count(*) shared from r a join r b on a.t = b.t and a.d < b.d group by 1, 2 having shared >= 2)
select src, dst, shared from p qualify row_number() over (partition by src order by shared desc, dst) <= 5""",
    "g_links": "select id src, unnest(['kb:' || id, 'a/' || source, 'src/main.rs']) dst, unnest(['wikilink', 'mdlink', 'pathcite']) edge_type from ai_kb where source is not null",
    "g_recall_recency": f"with {_KB.replace('from ai_kb', 'from ai_kb where indexed_at is not null', 1)}, m as (select min(score) a, max(score) b, min(epoch_us(indexed_at)) c, max(epoch_us(indexed_at)) d from h) select id, round(0.7 * (score - a) / (b - a) + 0.3 * (epoch_us(indexed_at) - c) / (d - c), 6) blended from h, m",
    "g_recall_blend": f"with {_KB}, s as (select 'kb:' || id node from h order by score desc, id limit 5), {_LIVE}, e as (select * from l where src in (select node from s) or dst in (select node from s)), p as (select src node, 0.5 * greatest(0, least(1, coalesce(weight, 0))) p from e union all select dst, 0.5 * greatest(0, least(1, coalesce(weight, 0))) from e union all select node, 1 from s), x as (select node, max(p) p from p group by 1) select id, round(0.7 * score + 0.3 * coalesce(p, 0), 6) blended from h left join x on node = 'kb:' || id",
}
