"""Ingest processors as column transforms, bulk changes, and pipelines of them."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What is redacted, in this order, and its mark.
PII = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[REDACTED_EMAIL]"),
    ("ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b|\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b", "[REDACTED_IP]"),
    ("credit_card", r"\b(?:[0-9][ -]?){12,18}[0-9]\b", "[REDACTED_CREDIT_CARD]"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", "[REDACTED_SSN]"),
    ("phone", r"(?:\+1[ .-]?)?\(?\b[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}\b", "[REDACTED_PHONE]"),
)
#: The building blocks of grok patterns.
GROK = {
    "WORD": r"\w+", "NOTSPACE": r"\S+", "SPACE": r"\s*", "DATA": r".*?", "GREEDYDATA": r".*", "INT": r"[+-]?[0-9]+", "NUMBER": r"[+-]?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+)",
    "IP": r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}|[0-9A-Fa-f:]+", "IPORHOST": r"\S+", "HOSTNAME": r"[\w.-]+", "USER": r"[\w.@-]+", "QUOTEDSTRING": r'"(?:[^"\\]|\\.)*"', "LOGLEVEL": r"[A-Za-z]+",
    "HTTPDATE": r"[0-9]{2}/\w{3}/[0-9]{4}:[0-9]{2}:[0-9]{2}:[0-9]{2} [+-][0-9]{4}", "TIMESTAMP_ISO8601": r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:[.,][0-9]+)?)?(?:Z|[+-][0-9]{2}:?[0-9]{2})?",
    "SYSLOGTIMESTAMP": r"\w{3} +[0-9]{1,2} [0-9]{2}:[0-9]{2}:[0-9]{2}", "URIPATH": r"[^ ?]+", "URIPATHPARAM": r"\S+", "UUID": r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}",
}
#: Whole patterns by name.
GROK_LINES = {
    "COMBINED": '%{IPORHOST:client} %{USER:ident} %{NOTSPACE:auth} \\[%{HTTPDATE:time}\\] "%{WORD:method} %{NOTSPACE:path} HTTP/%{NUMBER:http}" %{INT:status} %{NOTSPACE:bytes}(?: %{QUOTEDSTRING:referrer} %{QUOTEDSTRING:agent})?',
    "SYSLOG": "%{SYSLOGTIMESTAMP:time} %{HOSTNAME:host} %{DATA:program}(?:\\[%{INT:pid}\\])?: %{GREEDYDATA:message}",
    "POSTGRESQL": "%{TIMESTAMP_ISO8601:time} %{WORD:zone} \\[%{INT:pid}\\] %{WORD:level}: +%{GREEDYDATA:message}",
}


def redact(c: Column, kinds: list[str] | None = None) -> Column:
    """Personal data replaced by marks; null stays null."""
    for name, rx, mark in PII:
        if kinds is None or name in kinds:
            c = F.regexp_replace(c, rx, mark)
    return c


def grok_regex(pattern: str) -> tuple[str, list[str]]:
    """The regular expression of a pattern and the names of its groups."""
    names: list[str] = []
    pattern = GROK_LINES.get(pattern, pattern)

    def block(m: re.Match) -> str:
        if m[1] not in GROK:
            raise ValueError(f"unknown grok pattern {m[1]}")
        if m[2]:
            names.append(m[2])
            return f"({GROK[m[1]]})"
        return f"(?:{GROK[m[1]]})"

    out = re.sub(r"%\{(\w+)(?::(\w+))?\}", block, pattern)
    return out, names


def grok(df: DataFrame, field: str, pattern: str) -> DataFrame:
    """A column per named group; null in rows that don't match."""
    rx, names = grok_regex(pattern)
    c = F.col(f"`{field}`")
    hit = c.rlike(rx)
    return df.withColumns({n: F.when(hit, F.regexp_extract(c, rx, i)) for i, n in enumerate(names, 1)})


def convert(c: Column, kind: str) -> Column:
    """``integer``, ``float``, ``boolean`` or ``string``; what can't be converted becomes null."""
    t = {"integer": "bigint", "long": "bigint", "float": "double", "double": "double", "boolean": "boolean", "string": "string"}.get(kind)
    if t is None:
        raise ValueError(f"unknown type {kind}")
    return c.try_cast(t)


def parse_time(c: Column, formats: list[str] | None = None) -> Column:
    """A time from text in any of the formats, or from a number of seconds since the epoch."""
    tries = [F.try_to_timestamp(c, F.lit(f)) for f in formats or ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd", "dd/MMM/yyyy:HH:mm:ss Z"]]
    mail = F.try_to_timestamp(F.regexp_replace(c, r"^[A-Z][a-z]{2}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    number = F.timestamp_seconds(F.when(c.rlike(r"^\d{9,10}(\.\d+)?$"), c.try_cast("double")))
    millis = F.timestamp_millis(F.when(c.rlike(r"^\d{12,13}$"), c.try_cast("bigint")))
    return F.coalesce(*tries, *([] if formats else [mail]), number, millis)


def remove_null(df: DataFrame, out: str = "json") -> DataFrame:
    """Each row as JSON without its null fields."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "true"}).alias(out))


def _processor(kind: str, p: dict) -> Callable[[DataFrame], DataFrame]:
    f = p.get("field", "")
    c = F.col(f"`{f}`")
    to = p.get("target_field", f)
    return {
        "set": lambda d: d.withColumn(f, F.lit(p["value"])) if p.get("override", True) or f not in d.columns else d.withColumn(f, F.coalesce(c, F.lit(p["value"]))),
        "add_field": lambda d: d if f in d.columns else d.withColumn(f, F.lit(p["value"])),
        "remove": lambda d: d.drop(*([f] if isinstance(f, str) else f)),
        "drop_field": lambda d: d.drop(f),
        "rename": lambda d: d.withColumnRenamed(f, to),
        "copy": lambda d: d.withColumn(to, c),
        "append": lambda d: d.withColumn(f, F.concat(c if d.schema[f].dataType.typeName() == "array" else F.array(c), F.array(*[F.lit(v) for v in (p["value"] if isinstance(p["value"], list) else [p["value"]])]))),
        "convert": lambda d: d.withColumn(to, convert(c, p["type"])),
        "lowercase": lambda d: d.withColumn(to, F.lower(c)),
        "uppercase": lambda d: d.withColumn(to, F.upper(c)),
        "trim": lambda d: d.withColumn(to, F.trim(c)),
        "split": lambda d: d.withColumn(to, F.split(c, p["separator"])),
        "json_parse": lambda d: d.withColumn(to, F.from_json(c, p["schema"])),
        "timestamp_parse": lambda d: d.withColumn(to, parse_time(c, p.get("formats"))),
        "grok": lambda d: grok(d, f, p["pattern"]),
        "pii_redaction": lambda d: d.withColumn(to, redact(c, p.get("types"))),
        "url_decode": lambda d: d.withColumn(to, F.try_url_decode(c)),
        "drop": lambda d: d.where(F.lit(False)),
        "route": lambda d: d.withColumn("_index", F.lit(p["destination"])),
    }[kind]


#: Processors that fail on a value they can't take; the result is null then.
FAILING = ("convert", "json_parse", "timestamp_parse", "url_decode")


def _only(df: DataFrame, cond: Column, f: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``f`` applied to the rows where ``cond`` is true; the others stay as they were."""
    marked = df.withColumns({f"__old_{c}": F.col(f"`{c}`") for c in df.columns}).withColumn("__yes", F.coalesce(cond, F.lit(False)))
    new = f(marked)
    cols = [F.when(F.col("__yes"), F.col(f"`{c}`")).otherwise(F.col(f"`__old_{c}`") if c in df.columns else F.lit(None)).alias(c) for c in new.columns if not c.startswith("__")]
    return new.select(*cols)


def _step(df: DataFrame, step: dict) -> DataFrame:
    from searchloom.functions.script import compile_script

    (kind, p), = step.items()
    p = dict(p)
    cond, handlers = p.pop("if", None), p.pop("on_failure", None)
    f = _processor(kind, p)
    yes = None if cond is None else F.coalesce(compile_script(cond, df.schema), F.lit(False))
    if kind == "drop" and yes is not None:
        return df.where(~yes)
    if not handlers:
        return f(df) if yes is None else _only(df, yes, f)
    if kind not in FAILING:
        raise ValueError(f"{kind} doesn't fail")
    field, to = p["field"], p.get("target_field", p["field"])
    # The value and the condition are kept beside the row, as the processor may replace what they come from.
    kept = df.withColumn("_given", F.col(f"`{field}`")).withColumn("_asked", F.lit(True) if yes is None else yes)
    new = _only(kept, F.col("_asked"), f) if yes is not None else f(kept)
    new = new.withColumn("_failed", F.col("_asked") & F.col("_given").isNotNull() & F.col(f"`{to}`").isNull()).drop("_given", "_asked")
    return _only(new, F.col("_failed"), lambda d: run_pipeline(d, handlers)).drop("_failed")


def run_pipeline(df: DataFrame, processors: list[dict]) -> DataFrame:
    """Processors in order. ``if`` is a script; where it isn't true the processor leaves the row as it was. ``on_failure`` has
    processors for the rows whose value a processor (of the kinds in ``FAILING``) couldn't take.
    """
    for step in processors:
        df = _step(df, step)
    return df


def simulate(df: DataFrame, processors: list[dict]) -> list[DataFrame]:
    """The rows after each processor."""
    out = []
    for step in processors:
        df = _step(df, step)
        out.append(df)
    return out


def bulk_apply(table: DataFrame, actions: DataFrame, key: str, seq: str = "seq_no", action: str = "action") -> DataFrame:
    """A table after index, create, update and delete actions, the latest of each key in force.

    ``actions`` has the table's columns with ``action`` and ``seq``; an update's null fields keep the old values; a create of an existing key changes nothing.
    Several actions on one key are folded in their order before the join, so a key meets the table once.
    """
    cols = [c for c in table.columns if c != key]
    w = Window.partitionBy(key).orderBy(seq)
    reset = F.max(F.when(F.col(action).isin("index", "delete", "create"), F.col(seq))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    live = actions.withColumn("__reset", reset).where(F.col("__reset").isNull() | (F.col(seq) >= F.col("__reset")))
    folded = live.groupBy(key).agg(F.first(action).alias("__first"), F.max_by(action, seq).alias("__last"), F.min_by(action, seq).alias("__kind"), *[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(seq))).alias(f"__n_{c}") for c in cols])
    j = table.withColumn("__old", F.lit(True)).join(folded, key, "full_outer")
    keep_old = F.col("__old") & (F.col("__kind").isNull() | F.col("__kind").isin("create"))
    fresh = F.col("__kind").isin("index", "create")
    out = [F.when(keep_old, F.col(f"`{c}`")).when(fresh, F.col(f"`__n_{c}`")).otherwise(F.coalesce(F.col(f"`__n_{c}`"), F.col(f"`{c}`"))).alias(c) for c in cols]
    gone = F.coalesce(F.col("__last") == "delete", F.lit(False)) | (F.col("__old").isNull() & F.coalesce(F.col("__kind") == "update", F.lit(False)))
    return j.where(~gone).select(key, *out)


def update_by_query(df: DataFrame, query: dict, changes: dict[str, str | dict], id: str = "_id") -> DataFrame:  # noqa: A002
    """Rows that match get new values from scripts; the others stay."""
    from searchloom.functions.script import compile_script
    from searchloom.plans.query import compile_query

    hit = compile_query(df, query, id=id)[0].match
    return df.withColumns({c: F.when(hit, compile_script(s, df.schema).cast(df.schema[c].dataType)).otherwise(F.col(f"`{c}`")) for c, s in changes.items()})


def delete_by_query(df: DataFrame, query: dict, id: str = "_id") -> DataFrame:  # noqa: A002
    from searchloom.plans.query import compile_query

    return df.where(~F.coalesce(compile_query(df, query, id=id)[0].match, F.lit(False)))


def enrich(df: DataFrame, lookup: DataFrame, match_field: str, lookup_field: str, fields: list[str]) -> DataFrame:
    """Fields of a lookup table (one row per value) beside each row; null without a partner."""
    from searchloom.lookup import lookup_join

    small = lookup.select(F.col(lookup_field).alias(match_field), *fields).dropDuplicates([match_field])
    return lookup_join(df, small, [match_field], "left")


@dataclass
class EnrichPolicy:
    """Fields of a source table by one of its columns. :meth:`execute` writes the lookup; until then, and after the source has changed, what was written holds."""

    source: DataFrame
    match_field: str
    fields: list[str]
    lookup: DataFrame | None = None

    def execute(self, spark) -> EnrichPolicy:
        """Write one row per value: of several the one with the smallest fields."""
        from searchloom.scratch import materialize

        rows = self.source.where(F.col(self.match_field).isNotNull()).groupBy(self.match_field).agg(F.min(F.struct(*self.fields)).alias("__f"))
        self.lookup = materialize(rows.select(self.match_field, *[F.col("__f")[f].alias(f) for f in self.fields]), "enrich")
        return self

    def apply(self, df: DataFrame, field: str) -> DataFrame:
        if self.lookup is None:
            raise ValueError("the policy was never executed")
        return enrich(df, self.lookup, field, self.match_field, self.fields)


def bulk_results(table: DataFrame, actions: DataFrame, key: str, version: str = "_version", expected: str = "if_version", action: str = "action", seq: str = "seq_no") -> DataFrame:
    """What each action would do: ``key``, ``seq``, ``action`` and ``result``.

    ``result`` is ``created``, ``updated``, ``deleted``, ``not_found`` (an update or delete of nothing) or ``conflict`` (a create of what
    exists, or an ``expected`` version that isn't the row's). One action per key and call: of several, those after the first are
    ``conflict``. An ``upsert`` updates or creates.
    """
    have = table.select(F.col(f"`{key}`").alias("__k"), F.col(version).alias("__version"), F.lit(True).alias("__there"))
    first = F.row_number().over(Window.partitionBy(key).orderBy(seq)) == 1
    j = actions.withColumn("__first", first).join(have, F.col(f"`{key}`").eqNullSafe(F.col("__k")), "left")
    there, a = F.coalesce(F.col("__there"), F.lit(False)), F.col(action)
    stale = F.col(expected).isNotNull() & there & (F.col(expected) != F.col("__version")) if expected in actions.columns else F.lit(False)
    result = F.when(~F.col("__first") | stale | ((a == "create") & there), "conflict").when(a.isin("update", "delete") & ~there, "not_found").when(a == "delete", "deleted").when(there, "updated").otherwise("created")
    return j.select(key, seq, action, result.alias("result"))
