from __future__ import annotations

import gzip
import json
import math
import random
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from searchloom.functions import embed
from searchloom.operators import anomaly, graph, memory
from searchloom.sources import infer, ingest, logs, readers
from searchloom.streaming import jobs


@pytest.mark.parametrize(
    "data,family",
    [
        (b'{"a":1}\n{"a":2}\n', "jsonl"),
        (b'[{"a":1}]', "json"),
        (b"a,b\n1,2\n3,4\n", "csv"),
        (b"a;b\n1,5;2\n3,5;4\n", "csv"),
        (b"<html><body>x</body></html>", "html"),
        (b"<?xml version='1.0'?><r><x/><x/></r>", "xml"),
        (b"CREATE TABLE t (a int);\nINSERT INTO t VALUES (1);", "sqldump"),
        (b'1.2.3.4 - - [10/Oct/2000:13:55:36 -0700] "GET / HTTP/1.0" 200 23\n', "access_log"),
        (b"%PDF-1.4", "pdf"),
        (b"SQLite format 3\x00", "sqlite"),
        (b"", "empty"),
        (b"name: x\nitems:\n  - a\n", "yaml"),
        ("This is a long line of ordinary prose with many words in it.\n".encode() * 3, "prose"),
        (gzip.compress(b'{"a":1}\n{"a":2}\n'), "jsonl"),
    ],
)
def test_sniff(data, family):
    assert readers.sniff(data)["family"] == family


def test_read_any(spark, tmp_path):
    def put(name, data):
        (tmp_path / name).write_bytes(data)
        return str(tmp_path / name)

    csv = readers.read_any(spark, put("a.csv", b"k;v\na;1,5\nb;2,25\n"))
    assert csv.schema["v"].dataType.typeName() == "double" and csv.agg(F.sum("v")).first()[0] == 3.75
    assert readers.read_any(spark, put("a.jsonl", b'{"a":1}\n{"a":2}\n')).count() == 2
    assert readers.read_any(spark, put("a.json", json.dumps([{"a": {"b": 1}}]).encode())).select("a.b").first()[0] == 1
    assert readers.read_any(spark, put("a.xml", b"<?xml version='1.0'?><r><x><y>1</y></x><x><y>2</y></x></r>")).count() == 2
    page = readers.read_any(spark, put("a.html", b"<html><head><title>T</title></head><body><p>Hi <a href='/x'>you</a></p><script>no</script></body></html>")).first()
    assert page["title"] == "T" and page["text"] == "Hi you" and page["links"] == ["/x"]
    rows = readers.read_any(spark, put("a.sql", b"CREATE TABLE t (a int, b text);\nINSERT INTO t VALUES (1, 'it''s'), (2, NULL);")).collect()
    assert [r["row"] for r in rows] == [{"a": "1", "b": "it's"}, {"a": "2", "b": None}]
    db = sqlite3.connect(tmp_path / "a.db")
    db.execute("create table t (a int, b text)")
    db.execute("insert into t values (1, 'x')")
    db.commit()
    db.close()
    assert readers.read_any(spark, str(tmp_path / "a.db")).first()["row"] == {"a": "1", "b": "x"}
    with zipfile.ZipFile(tmp_path / "a.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>Hello</w:t></w:r></w:p></w:body></w:document>')
    assert readers.read_any(spark, str(tmp_path / "a.docx")).first()["text"] == "Hello"
    code = {(r["kind"], r["name"], r["line"]) for r in readers.read_code(spark, put("a.py", b"class A:\n    def f(self):\n        pass\n")).collect()}
    assert code == {("class", "A", 1), ("function", "f", 2)}
    assert {n for _, n, _ in readers.code_symbols("a.rs", "pub fn go(x: i32) {\n}\nstruct S {\n}")} == {"go", "S"}
    assert readers.read_any(spark, put("a.yaml", b"name: x\nouter:\n  inner: 2\n")).first()["fields"] == {"name": "x", "outer.inner": "2"}
    assert [r["title"] for r in readers.read_sections(spark, put("a.md", b"# One\ntext\n# Two\nmore\n")).orderBy("section").collect()] == ["One", "Two"]


def test_flatten_and_clusters(spark):
    df = spark.createDataFrame([((1, (2,)),)], "a struct<`b c`:int,d:struct<e:int>>")
    assert readers.flatten(df).columns == ["a.b_c", "a.d.e"]
    assert readers.cluster_schemas({"1": ["a", "b"], "2": ["a", "b", "c"], "3": ["x"]}) == [["1", "2"], ["3"]]


def test_processors(spark):
    df = spark.createDataFrame([("A b", "5", '{"k": 1}', None), (None, "x", "bad", None)], "s string, n string, j string, z string")
    out = ingest.run_pipeline(df, [{"lowercase": {"field": "s"}}, {"convert": {"field": "n", "type": "integer"}}, {"split": {"field": "s", "separator": " ", "target_field": "parts"}}, {"json_parse": {"field": "j", "schema": "k int"}}, {"rename": {"field": "z", "target_field": "y"}}, {"set": {"field": "q", "value": 1, "if": "doc['n'].value == 5"}}]).collect()
    assert out[0]["parts"] == ["a", "b"] and out[0]["n"] == 5 and out[1]["n"] is None and out[0]["j"]["k"] == 1 and [r["q"] for r in out] == [1, None]
    line = spark.createDataFrame([("mail a.b@c.de from 10.0.0.1, card 4111 1111 1111 1111, ssn 123-45-6789, call 555-123-4567",), (None,)], "t string")
    got = [r[0] for r in line.select(ingest.redact(F.col("t"))).collect()]
    assert got == ["mail [REDACTED_EMAIL] from [REDACTED_IP], card [REDACTED_CREDIT_CARD], ssn [REDACTED_SSN], call [REDACTED_PHONE]", None]
    g = ingest.grok(spark.createDataFrame([('1.2.3.4 - bob [10/Oct/2000:13:55:36 -0700] "GET /x HTTP/1.0" 200 23',), ("nope",)], "v string"), "v", "COMBINED").collect()
    assert (g[0]["path"], g[0]["status"], g[1]["path"]) == ("/x", "200", None)
    assert json.loads(ingest.remove_null(df).first()[0]) == {"s": "A b", "n": "5", "j": '{"k": 1}'}


def test_times(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02 03:04:05",), ("1704164645",), ("1704164645000",), ("02/Jan/2024:03:04:05 +0000",), ("Tue, 2 Jan 2024 03:04:05 +0000",), ("no",), (None,)], "t string")
    got = [r[0] for r in df.select(F.date_format(ingest.parse_time(F.col("t")), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-02 03:04:05"] * 6 + [None, None]


def test_logs(spark, tmp_path):
    (tmp_path / "l").write_text('{"timestamp":"2024-01-02T03:04:05Z","level":"INFO","message":"m"}\nbroken\n{"x"\n')
    assert [r["level"] for r in logs.read_ndjson(spark, str(tmp_path / "l")).collect()] == ["INFO"]
    otlp = {"resourceLogs": [{"resource": {"attributes": [{"key": "service", "value": {"stringValue": "a"}}]}, "scopeLogs": [{"scope": {"name": "s"}, "logRecords": [{"timeUnixNano": "1704164645000000000", "severityText": "WARN", "body": {"stringValue": "x"}}, {"body": {"stringValue": "y"}}]}]}]}
    rows = logs.flatten_otlp(spark.createDataFrame([(json.dumps(otlp),)], "value string")).collect()
    assert [(r["message"], r["level"], r["resource"]) for r in rows] == [("x", "WARN", {"service": "a"}), ("y", None, {"service": "a"})]
    s = logs.parse_syslog(spark.createDataFrame([("<34>Oct 11 22:14:15 box su[12]: failed",), ("nope",)], "value string")).collect()
    assert (s[0]["facility"], s[0]["severity"], s[0]["level"], s[0]["program"], s[0]["message"], s[1]["host"]) == (4, 2, "crit", "su", "failed", None)
    t = spark.createDataFrame([("took 12 ms at node-3",)], "m string").select(logs.template(F.col("m"))).first()[0]
    assert t == "took {} ms at {}"


def test_inference(spark):
    df = spark.createDataFrame([(f"u{i}@x.org", str(i), "2024-01-02", "some plain words here", f"10.0.0.{i}") for i in range(25)], "e string, n string, d string, p string, ip string")
    f = {x["field"]: x for x in infer.infer_fields(df)}
    assert (f["e"]["entity"], f["n"]["type"], f["d"]["type"], f["p"]["type"], f["ip"]["type"]) == ("email", "long", "date", "text", "ip")
    assert infer.time_field(list(f.values())) == "d"
    assert infer.time_field(infer.infer_fields(df.limit(0))) is None


def test_anomaly_golden(spark):
    v = [20, 21, 19, 20, 22, 18, 21, 20, 19, 21, 20, 22, 96, 20, 21, 19]
    out = anomaly.fold([float(x) for x in v])
    bad = out[out.anomaly]
    assert list(bad.index) == [12] and abs(bad.expected.iloc[0] - 20.25) < 1e-12
    assert abs(bad["std"].iloc[0] - 1.1636866703140785) < 1e-12 and abs(bad.z.iloc[0] - 65.09484205018445) < 1e-9 and round(bad.score.iloc[0], 1) == 100.0


def test_graph(spark):
    ts = "2024-01-01 00:00:00"
    rows = [("e1", "a", "b", "l", 0.5), ("e1", "a", "b", "l", 0.5), ("e2", "b", "c", "l", None), ("e3", "c", "d", "m", 1.0)]
    e = spark.createDataFrame(rows, "edge_id string, src string, dst string, edge_type string, weight double").withColumn("valid_at", F.lit(ts).cast("timestamp_ntz")).withColumn("invalid_at", F.lit(None).cast("timestamp_ntz"))
    seeds = spark.createDataFrame([("a",), (None,)], "node string")
    assert [(r["edge_id"], r["hop"]) for r in graph.ordered(graph.expand(e, seeds, 2)).collect()] == [("e1", 1), ("e2", 2)]
    assert graph.expand(e, seeds, 2, types=["m"]).count() == 0
    ended = graph.unlink(e, spark.createDataFrame([("e1",)], "edge_id string"), "2024-06-01 00:00:00")
    assert graph.expand(ended, seeds).count() == 0 and graph.expand(ended, seeds, as_of="2024-03-01 00:00:00").count() == 1
    more = graph.link(e, e.select("src", "dst", "edge_type", "weight", "valid_at"))
    assert graph.link(more, e.select("src", "dst", "edge_type", "weight", "valid_at")).count() == more.count() == 7
    near = {r["node"]: r["proximity"] for r in graph.proximity(e, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert near == {"a": 1.0, "b": 0.25, "c": 0.0}
    assert graph.expand(e.limit(0), seeds, 2).count() == 0


@pytest.mark.parametrize("n", [5000, 60_000])
def test_expansion_takes_the_whole_frontier(spark, n):
    hub = spark.range(n).selectExpr("'a' || id edge_id", "'hub' src", "'n' || id dst")
    rest = spark.range(n).selectExpr("'b' || id edge_id", "'n' || id src", "'m' || id dst")
    e = hub.unionByName(rest).selectExpr("*", "'l' edge_type", "1.0D weight", "timestamp_ntz'2024-01-01' valid_at", "cast(null as timestamp_ntz) invalid_at")
    count = lambda seeds, *how: {r["hop"]: r["count"] for r in graph.expand(e, seeds, *how).groupBy("hop").count().collect()}
    assert count(spark.createDataFrame([("hub",)], "node string"), 2) == {1: n, 2: n}
    assert count(spark.range(n).selectExpr("'n' || id node"), 1, "both") == {1: 2 * n}


def test_shared_terms_are_the_repeated_ones(spark):
    rare = {d: " ".join(f"rare{i:02}" for i in range(30) if (i % 2 == 0) == (d == "b")) for d in ("b", "c")}
    rows = [("a", "topic topic theme theme " + " ".join(f"rare{i:02}" for i in range(30))), ("b", rare["b"]), ("c", rare["c"])]
    rows += [(d, "topic theme") for d in ("d", "e")] + [(f"f{i:02}", f"filler{i}") for i in range(60)]
    got = {(r["src"], r["dst"]): r["shared"] for r in graph.shared_terms(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()}
    assert got == {("a", "b"): 11, ("a", "c"): 11, ("a", "d"): 2, ("a", "e"): 2, ("d", "e"): 2}


def test_shared_terms_spend_the_budget_on_both_ends(spark):
    rows = [(f"{i:02}", f"left{i} right{i}") for i in range(9)] + [("99", " ".join(f"left{i} right{i}" for i in range(9)))] + [(f"z{i:02}", f"filler{i}") for i in range(40)]
    got = graph.shared_terms(spark.createDataFrame(rows, "id string, body string"), "id", "body").collect()
    assert sorted((r["src"], r["dst"]) for r in got) == [(f"{i:02}", "99") for i in range(5)]


@pytest.mark.parametrize("seed", range(4))
def test_spending_equals_the_rounds(spark, seed):
    rnd = random.Random(seed)
    pairs = {tuple(sorted(rnd.sample(range(40), 2))): rnd.randint(2, 4) for _ in range(300)}
    lists = {d: sorted((-n, *(set(p) - {d})) for p, n in pairs.items() if d in p) for d in range(40)}
    degree, want = dict.fromkeys(lists, 0), set()
    for _ in range(5):
        for d in sorted(lists):
            while degree[d] < 5 and lists[d]:
                p = lists[d].pop(0)[1]
                if tuple(sorted((d, p))) not in want and degree[p] < 5:
                    want.add(tuple(sorted((d, p))))
                    degree[d], degree[p] = degree[d] + 1, degree[p] + 1
                    break
    made = graph._spend(spark.createDataFrame([(*p, n) for p, n in pairs.items()], "src int, dst int, shared long"), 5).collect()
    assert {(r["src"], r["dst"]) for r in made} == want and len(made) == len(want)


def test_memory(spark):
    notes = spark.createDataFrame([(1, [1.0, 0.0])], "id int, embedding array<double>")
    new = spark.createDataFrame([(2, [0.99, 0.01]), (3, [0.0, 1.0])], "id int, embedding array<double>")
    assert sorted(r["id"] for r in memory.store(notes, new).collect()) == [1, 3]


def test_memory_stores_no_near_copies_of_a_batch(spark):
    notes = spark.createDataFrame([(1, [0.0, 0.0, 1.0])], "id int, embedding array<double>")
    turned = lambda d: [math.cos(math.radians(d)), math.sin(math.radians(d)), 0.0]
    new = spark.createDataFrame([(2, turned(0)), (3, turned(15)), (4, turned(30)), (5, turned(90)), (6, turned(91)), (7, [0.0, 0.01, 1.0])], "id int, embedding array<double>")
    assert sorted(r["id"] for r in memory.store(notes, new).collect()) == [1, 2, 4, 5]  # 4 is like 3 only, which isn't kept


def test_embedder_and_chunker(spark):
    v = embed.embed_text("Hello world", 32)
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and embed.embed_text("", 8) == [0.0] * 8
    text = "One sentence here. Another one follows. " * 20
    cs = embed.chunk_text(text, 100, 20)
    assert cs[0][0] == 0 and cs[-1][1] == len(text) and all(b[0] == a[1] - 20 for a, b in zip(cs, cs[1:])) and all(text[s:e] == c for s, e, c in cs)
    assert embed.chunk_text("   ") == []
    df = spark.createDataFrame([(1, text), (2, None)], "id int, t string")
    assert embed.chunks(df, "id", "t", 100, 20).count() == len(cs)


def test_streaming(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/events.parquet").repartition(3).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = jobs.run(jobs.deduplicate(stream, "ts", ["event_id"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() > 0
    seen = []
    jobs.each_batch(stream, lambda df, i: seen.append(df.count()), str(tmp_path / "cp2")).awaitTermination(120)
    assert sum(seen) == spark.read.parquet(str(tmp_path / "in")).count()
    w = jobs.tumbling(stream, "ts", "1 hour", "1 hour", ["event_type"])
    jobs.run(w, str(tmp_path / "o3"), str(tmp_path / "cp3")).awaitTermination(120)
    q = jobs.sessions(stream, "ts", "10 minutes", "1 hour", ["user_id"])
    jobs.run(q, str(tmp_path / "o4"), str(tmp_path / "cp4")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "o4")).count() >= 0


def test_enrich_and_bulk_with_empty_tables(spark):
    t = spark.createDataFrame([(1, "a")], "id int, v string")
    none = t.limit(0).withColumn("action", F.lit("index")).withColumn("seq_no", F.lit(1))
    assert ingest.bulk_apply(t, none, "id").collect() == t.collect()
    assert ingest.enrich(t, t.limit(0).withColumnRenamed("v", "w"), "id", "id", ["w"]).first()["w"] is None
