"""Log sources and log analytics: JSON lines, OTLP, syslog, access logs, templates, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.sources.ingest import grok, parse_time

#: Syslog severities by number.
SEVERITIES = "emerg alert crit err warning notice info debug".split()


def read_ndjson(spark: SparkSession, path: str, schema: str = "timestamp string, level string, message string, fields map<string,string>") -> DataFrame:
    """Lines that are no JSON object are skipped; ``hour`` is the partition of a record's time."""
    rows = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r"), "value").where(F.col("value").rlike(r"^\s*\{") & F.col("r").isNotNull())
    rows = rows.select("r.*").where("message is not null or level is not null or timestamp is not null")
    return rows.withColumn("timestamp", parse_time(F.col("timestamp"))).withColumn("hour", F.date_trunc("hour", "timestamp"))


def flatten_otlp(df: DataFrame, column: str = "value") -> DataFrame:
    """Log records of OTLP JSON: resource, scope and record are unnested to one row each."""
    attr = "array<struct<key:string,value:struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>>>"
    schema = f"resourceLogs array<struct<resource:struct<attributes:{attr}>,scopeLogs:array<struct<scope:struct<name:string>,logRecords:array<struct<timeUnixNano:string,severityText:string,severityNumber:int,body:struct<stringValue:string>,traceId:string,spanId:string,attributes:{attr}>>>>>>"
    r = df.select(F.from_json(column, schema).alias("j")).select(F.explode("j.resourceLogs").alias("r"))
    s = r.select("r.resource", F.explode("r.scopeLogs").alias("s"))
    x = s.select("resource", F.col("s.scope.name").alias("scope"), F.explode("s.logRecords").alias("l"))
    text = lambda a: F.coalesce(a["stringValue"], a["intValue"], a["doubleValue"].cast("string"), a["boolValue"].cast("string"))
    pairs = lambda c: F.map_from_entries(F.transform(F.coalesce(c, F.array().cast(attr)), lambda a: F.struct(a["key"], text(a["value"]))))
    return x.select(F.timestamp_micros((F.col("l.timeUnixNano").try_cast("bigint") / 1000).cast("bigint")).alias("timestamp"), F.col("l.severityText").alias("level"), F.col("l.body.stringValue").alias("message"), F.col("l.traceId").alias("trace_id"), F.col("l.spanId").alias("span_id"), "scope", pairs(F.col("resource.attributes")).alias("resource"), pairs(F.col("l.attributes")).alias("attributes"))


def parse_syslog(df: DataFrame, column: str = "value") -> DataFrame:
    """Priority, facility, severity, time, host, program and message of syslog lines; null where a line doesn't match."""
    c = F.col(column)
    rx = r"^<(\d{1,3})>(?:1 )?(\w{3} +\d{1,2} \d\d:\d\d:\d\d|\S+) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?:? ?(.*)$"
    hit = c.rlike(rx)
    get = lambda i: F.when(hit, F.regexp_extract(c, rx, i))
    pri = get(1).try_cast("int")
    return df.withColumns({"facility": F.shiftright(pri, 3), "severity": pri % 8, "level": F.get(F.array(*map(F.lit, SEVERITIES)), pri % 8), "time": get(2), "host": get(3), "program": get(4), "pid": F.nullif(get(5), F.lit("")), "message": get(6)})


def read_access_log(df: DataFrame, column: str = "value") -> DataFrame:
    """Combined or common access log lines."""
    g = grok(df, column, "COMBINED")
    return g.withColumn("status", F.col("status").try_cast("int")).withColumn("bytes", F.col("bytes").try_cast("bigint")).withColumn("time", F.try_to_timestamp("time", F.lit("dd/MMM/yyyy:HH:mm:ss Z")))


def template(message: Column) -> Column:
    """The message with variable words (numbers, hex, addresses, anything with a digit) replaced by ``{}``."""
    return F.concat_ws(" ", F.transform(F.split(message, r"\s+"), lambda t: F.when(t.rlike(r"\d"), F.lit("{}")).otherwise(t)))


def log_filter(df: DataFrame, level: str | None = None, equals: dict | None = None, contains: dict | None = None, between: dict | None = None, time: str = "event_ts", start=None, end=None) -> DataFrame:
    """Conditions that all must hold; level regardless of case; time bounds inclusive."""
    if level is not None:
        df = df.where(F.lower("level") == level.lower())
    for k, v in (equals or {}).items():
        df = df.where(F.col(k) == v)
    for k, v in (contains or {}).items():
        df = df.where(F.col(k).contains(v))
    for k, (a, b) in (between or {}).items():
        df = df.where(F.col(k).between(a, b))
    if start is not None:
        df = df.where(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.where(F.col(time) <= F.lit(end).cast("timestamp_ntz"))
    return df


def log_histogram(df: DataFrame, seconds: int, time: str = "event_ts") -> DataFrame:
    """Records per interval and level; a missing level is UNKNOWN."""
    w = F.window(F.col(time), f"{seconds} seconds")["start"]
    return df.where(F.col(time).isNotNull()).groupBy(w.alias("bucket"), F.coalesce(F.upper("level"), F.lit("UNKNOWN")).alias("level")).agg(F.count("*").alias("n"))


def retain(df: DataFrame, now: str, days: int, time: str = "event_ts") -> DataFrame:
    """Rows of the hours that began no more than ``days`` before ``now``."""
    hour = F.date_trunc("hour", F.col(time).cast("timestamp"))
    return df.where(hour >= F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(days)))
