"""What the fields of a table are: types, dates, entities, prose, the time field; keys and times shared by tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.sources.ingest import parse_time

#: Entity kinds by pattern.
ENTITIES = {"email": r"^[^@\s]+@[^@\s]+\.[A-Za-z]{2,}$", "url": r"^https?://\S+$", "ip": r"^(?:\d{1,3}\.){3}\d{1,3}$", "uuid": r"^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"}
SHARE, LEAST = 0.9, 20


def infer_fields(df: DataFrame) -> list[dict]:
    """One description per column, from one pass over the table with a few counters per column."""
    exprs = [F.count("*").alias("n")]
    for i, f in enumerate(df.schema.fields):
        c = F.col(f"`{f.name}`")
        exprs += [F.count(c).alias(f"c{i}"), F.approx_count_distinct(c.cast("string") if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else c).alias(f"d{i}")]
        if isinstance(f.dataType, T.StringType):
            words = F.size(F.split(F.trim(c), r"\s+"))
            alpha = F.size(F.regexp_extract_all(c, F.lit(r"(?:^|\s)\p{L}{2,}"), F.lit(0)))
            exprs += [F.sum(c.rlike(rx).cast("long")).alias(f"{k}{i}") for k, rx in ENTITIES.items()]
            exprs += [F.sum(c.rlike(r"^-?\d+$").cast("long")).alias(f"int{i}"), F.sum(c.rlike(r"^-?\d+\.\d+$").cast("long")).alias(f"float{i}"), F.count(parse_time(c)).alias(f"date{i}"), F.avg(words).alias(f"words{i}"), F.avg(alpha / words).alias(f"alpha{i}"), F.max(F.length(c)).alias(f"len{i}")]
    r = df.agg(*exprs).first().asDict()
    out = []
    for i, f in enumerate(df.schema.fields):
        n = r[f"c{i}"]
        d = {"field": f.name, "count": n, "distinct": r[f"d{i}"], "coverage": n / r["n"] if r["n"] else 0.0, "type": None, "entity": None}
        t = f.dataType
        if isinstance(t, T.StringType) and n:
            d["entity"] = next((k for k in ENTITIES if n >= LEAST and r[f"{k}{i}"] >= SHARE * n), None)
            prose = r[f"alpha{i}"] >= 0.55 and r[f"words{i}"] >= 3
            d["type"] = "ip" if d["entity"] == "ip" else "long" if r[f"int{i}"] == n else "double" if r[f"int{i}"] + r[f"float{i}"] == n else "date" if r[f"date{i}"] >= SHARE * n else "text" if prose or r[f"len{i}"] > 256 else "keyword"
        elif isinstance(t, T.StringType):
            d["type"] = "keyword"
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            d["type"] = "date"
        elif isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            d["type"] = "double"
        elif isinstance(t, T.BooleanType):
            d["type"] = "boolean"
        elif isinstance(t, T.NumericType):
            d["type"] = "long"
        elif isinstance(t, T.ArrayType):
            d["type"] = "nested" if isinstance(t.elementType, T.StructType) else "vector" if isinstance(t.elementType, T.FloatType) else "keyword"
        else:
            d["type"] = "object"
        out.append(d)
    return out


def time_field(fields: list[dict]) -> str | None:
    """The date field that most rows have; of several the first by name."""
    dates = sorted((f for f in fields if f["type"] == "date" and f["count"]), key=lambda f: (-f["coverage"], f["field"]))
    return dates[0]["field"] if dates else None


def key_overlap(a: DataFrame, col_a: str, b: DataFrame, col_b: str, least: int = 25) -> DataFrame:
    """Shared distinct values of two columns: counts, containment in the smaller set and its strength."""
    x = a.select(F.col(col_a).cast("string").alias("v")).where("v is not null").distinct()
    y = b.select(F.col(col_b).cast("string").alias("v")).where("v is not null").distinct()
    both = x.withColumn("a", F.lit(1)).join(y.withColumn("b", F.lit(1)), "v", "full_outer")
    n = both.agg(F.count("a").alias("distinct_a"), F.count("b").alias("distinct_b"), F.sum((F.col("a").isNotNull() & F.col("b").isNotNull()).cast("long")).alias("shared"))
    c = F.try_divide(F.col("shared"), F.least("distinct_a", "distinct_b"))
    strength = F.when((F.col("shared") < least) | (c < 0.3), "none").when(c >= 0.7, "strong").otherwise("weak")
    return n.withColumn("containment", c).withColumn("strength", strength)


def time_alignment(a: DataFrame, time_a: str, b: DataFrame, time_b: str, unit: str = "day") -> DataFrame:
    """Correlation of the numbers of rows per unit of time that both tables have; null below three units."""
    f = lambda d, t, n: d.where(F.col(t).isNotNull()).groupBy(F.date_trunc(unit, F.col(t)).alias("t")).agg(F.count("*").cast("double").alias(n))
    j = f(a, time_a, "x").join(f(b, time_b, "y"), "t")
    return j.agg(F.count("*").alias("pairs"), F.when(F.count("*") >= 3, F.corr("x", "y")).alias("r"))
