"""The small SQL surface of searches: one table, filters, grouping, ordering, translated to a search plan."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.plans.query import compile_query

_TOKEN = re.compile(r"\s*('(?:[^']|'')*'|\"[^\"]*\"|-?\d+(?:\.\d+)?|<=|>=|<>|!=|[=<>(),*;]|[A-Za-z_][\w.]*)")


class SqlError(ValueError):
    """A statement outside the surface."""


def _tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"can't read {text[at : at + 20]!r}")
        out.append(m[1])
        at = m.end()
    return [t for t in out if t != ";"]


class _Reader:
    def __init__(self, text: str):
        self.t, self.i = _tokens(text), 0

    def peek(self, n: int = 0) -> str:
        return self.t[self.i + n].upper() if self.i + n < len(self.t) else ""

    def take(self, *want: str) -> str:
        if self.i >= len(self.t) or want and self.t[self.i].upper() not in want:
            raise SqlError(f"expected {' or '.join(want) or 'more'}, found {self.t[self.i] if self.i < len(self.t) else 'the end'}")
        self.i += 1
        return self.t[self.i - 1]

    def name(self) -> str:
        return self.take().strip('"')

    def value(self):
        t = self.take()
        if t[0] == "'":
            return t[1:-1].replace("''", "'")
        u = t.upper()
        if u in ("TRUE", "FALSE", "NULL"):
            return {"TRUE": True, "FALSE": False, "NULL": None}[u]
        try:
            return float(t) if "." in t else int(t)
        except ValueError:
            return t

    def condition(self, schema: T.StructType, depth: int = 0) -> dict:
        if depth > 64:
            raise SqlError("nested too deeply")
        left = self.conjunction(schema, depth)
        parts = [left]
        while self.peek() == "OR":
            self.take()
            parts.append(self.conjunction(schema, depth))
        return left if len(parts) == 1 else {"bool": {"should": parts, "minimum_should_match": 1}}

    def conjunction(self, schema, depth) -> dict:
        parts = [self.negation(schema, depth)]
        while self.peek() == "AND":
            self.take()
            parts.append(self.negation(schema, depth))
        return parts[0] if len(parts) == 1 else {"bool": {"must": parts}}

    def negation(self, schema, depth) -> dict:
        if self.peek() == "NOT":
            self.take()
            return {"bool": {"must_not": [self.negation(schema, depth + 1)]}}
        if self.peek() == "(":
            self.take()
            c = self.condition(schema, depth + 1)
            self.take(")")
            return c
        name = self.name()
        if self.peek() == "NOT":
            self.take()
            self.take("LIKE")
            return {"bool": {"must_not": [self.like(name)]}}
        op = self.take("=", "!=", "<>", "<", "<=", ">", ">=", "LIKE").upper()
        if op == "LIKE":
            return self.like(name)
        v = self.value()
        if op in ("=", "!=", "<>"):
            # A string is looked for as text: any of its words matches.
            q = {"bool": {"must_not": [{"exists": {"field": name}}]}} if v is None else {"match": {name: v}} if isinstance(v, str) else {"term": {name: v}}
            return q if op == "=" else {"bool": {"must_not": [q]}}
        return {"range": {name: {{"<": "lt", "<=": "lte", ">": "gt", ">=": "gte"}[op]: v}}}

    def like(self, name: str) -> dict:
        return {"wildcard": {name: str(self.value()).replace("%", "*").replace("_", "?")}}


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], text: str, id: str = "_id") -> DataFrame:  # noqa: A002
    """``SELECT [DISTINCT] columns | COUNT(*) | COUNT(c) | COUNT(DISTINCT c) FROM t [WHERE] [GROUP BY] [ORDER BY] [LIMIT]``.

    Counts are named ``count``, or ``count_c`` and ``count_distinct_c``. HAVING and joins are refused; Spark's own SQL has them.
    """
    r = _Reader(text)
    r.take("SELECT")
    distinct = r.peek() == "DISTINCT" and bool(r.take())
    cols: list[str] = []
    counts: list[tuple[str, object]] = []
    while True:
        if r.peek() == "COUNT" and r.peek(1) == "(":
            r.take()
            r.take("(")
            if r.peek() == "*":
                r.take()
                counts.append(("count", F.count("*")))
            elif r.peek() == "DISTINCT":
                r.take()
                c = r.name()
                counts.append((f"count_distinct_{c}", F.count_distinct(F.col(c))))
            else:
                c = r.name()
                counts.append((f"count_{c}", F.count(F.col(c))))
            r.take(")")
        elif r.peek() == "*":
            r.take()
            cols.append("*")
        else:
            cols.append(r.name())
        if r.peek() != ",":
            break
        r.take(",")
    r.take("FROM")
    source = r.name()
    if source not in tables:
        raise SqlError(f"no table {source}")
    df = tables[source]
    if r.peek() == "WHERE":
        r.take()
        df = df.where(compile_query(df, r.condition(df.schema), id=id)[0].match)
    group: list[str] = []
    if r.peek() == "GROUP":
        r.take()
        r.take("BY")
        group.append(r.name())
        while r.peek() == ",":
            r.take()
            group.append(r.name())
    if r.peek() == "HAVING":
        raise SqlError("HAVING isn't supported")
    if group or counts:
        df = df.groupBy(*group).agg(*[c.alias(n) for n, c in counts or [("count", F.count("*"))]])
        df = df.select(*cols, *[n for n, _ in counts]) if cols or counts else df
    elif cols != ["*"]:
        df = df.select(*cols)
    if distinct:
        df = df.distinct()
    if r.peek() == "ORDER":
        r.take()
        r.take("BY")
        order = []
        while True:
            n = r.name()
            if n.upper() == "COUNT" and r.peek() == "(":
                r.take("(")
                r.take("*")
                r.take(")")
                n = "count"
            down = r.peek() in ("ASC", "DESC") and r.take().upper() == "DESC"
            order.append(F.col(n).desc_nulls_last() if down else F.col(n).asc_nulls_last())
            if r.peek() != ",":
                break
            r.take()
        df = df.orderBy(*order)
    if r.peek() == "LIMIT":
        r.take()
        df = df.limit(int(r.take()))
    if r.i < len(r.t):
        raise SqlError(f"unexpected {r.t[r.i]}")
    return df
