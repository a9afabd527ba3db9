"""Query documents compiled to a boolean column and a score column.

A query never needs a join: text clauses work on the row's own token array, and the corpus statistics that relevance
needs (records, mean length, document frequency of the query's few terms) come from one aggregation over the table,
made only if a score is asked for. So a search is two scans and a top-k, whatever the size of the table.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.functions import geo, text, vectors
from searchloom.functions.script import compile_script
from searchloom.plans import dates
from searchloom.plans.querystring import parse_query_string, parse_simple
from searchloom.plans.rewrite import rewrite

K1, B = 1.2, 0.75
MAX_DEPTH, MAX_CLAUSES, MAX_EXPANSIONS, MAX_CANDIDATES = 64, 1024, 50, 10_000


class QueryError(ValueError):
    """A query that isn't understood or is refused."""


@dataclass
class Clause:
    match: Column
    score: Column
    text_terms: list[tuple[str, str]] = field(default_factory=list)


@dataclass
class Context:
    """What a query is compiled against."""

    schema: T.StructType
    id: str = "_id"
    now: datetime | None = None
    analyzers: dict[str, str] = field(default_factory=dict)
    text_fields: list[str] = field(default_factory=list)
    geo: dict[str, tuple[str, str]] = field(default_factory=dict)
    wanted: set[tuple[str, str]] = field(default_factory=set)
    stats: dict | None = None
    scoring: bool = True
    scope: tuple[str, Column] | None = None
    named: list[tuple[str, Column]] = field(default_factory=list)
    depth: int = 0
    embed: Callable[[str], list[float]] | None = None
    bound: dict[str, Column] = field(default_factory=dict)
    table: DataFrame | None = None

    def resolve(self, name: str) -> tuple[Column, T.DataType]:
        """The column of a dotted field name; a ``.keyword`` or ``.raw`` of a string is the string itself."""
        if self.scope and name.startswith(self.scope[0] + "."):
            kind = self._type(self.scope[0]).elementType
            col = self.scope[1]
            for part in name[len(self.scope[0]) + 1 :].split("."):
                col, kind = col[part], kind[part].dataType
            return col, kind
        for n in (name, re.sub(r"\.(keyword|raw)$", "", name)):
            try:
                return F.col(".".join(f"`{p}`" for p in self._path(n))), self._type(n)
            except KeyError:
                continue
        raise QueryError(f"no field {name}")

    def _path(self, name: str) -> list[str]:
        return [name] if name in self.schema.names else name.split(".")

    def _type(self, name: str) -> T.DataType:
        kind: T.DataType = self.schema
        for p in self._path(name):
            while isinstance(kind, T.ArrayType):
                kind = kind.elementType
            if not isinstance(kind, T.StructType):
                raise KeyError(name)
            kind = kind[p].dataType
        return kind

    def with_tokens(self, name: str, f: Callable[[Column], Column]) -> Column:
        """``f`` of a field's tokens, which are computed once for all uses within ``f``."""
        if name in self.bound:
            return f(self.bound[name])

        def run(w: Column) -> Column:
            self.bound[name] = w
            try:
                return f(w)
            finally:
                del self.bound[name]

        return text.let(self.tokens(name), run)

    def tokens(self, name: str) -> Column:
        if name in self.bound:
            return self.bound[name]
        col, kind = self.resolve(name)
        if isinstance(kind, T.ArrayType):
            col = F.concat_ws(" ", col)
        return text.ANALYZERS[self.analyzers.get(name, "standard")](col.cast("string"))

    def lat_lon(self, name: str) -> tuple[Column, Column]:
        if name in self.geo:
            return tuple(F.col(f"`{c}`") for c in self.geo[name])
        col, _ = self.resolve(name)
        return col["lat"], col["lon"]


def collect_stats(df: DataFrame, ctx: Context) -> dict:
    """Records, mean length and document frequencies of the terms that the query's scores use: one row from one scan."""
    if not ctx.wanted:
        return {}
    fields = sorted({f for f, _ in ctx.wanted})
    terms = sorted(ctx.wanted)
    tok = df.select(*[ctx.tokens(f).alias(f"t{i}") for i, f in enumerate(fields)])
    aggs = [F.count("*").alias("n")] + [F.avg(F.when(F.size(f"t{i}") > 0, F.size(f"t{i}"))).alias(f"l{i}") for i in range(len(fields))]
    aggs += [F.sum(F.array_contains(f"t{fields.index(f)}", t).cast("bigint")).alias(f"d{j}") for j, (f, t) in enumerate(terms)]
    row = tok.agg(*aggs).first()
    return {"n": row["n"], "avgdl": {f: max(1.0, row[f"l{i}"] or 1.0) for i, f in enumerate(fields)}, "df": {k: row[f"d{j}"] or 0 for j, k in enumerate(terms)}}


def all_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, cols) if cols else F.lit(True)


def any_of(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, cols) if cols else F.lit(False)


def total(cols: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, cols) if cols else F.lit(0.0)


def sure(c: Column) -> Column:
    """Null counts as no."""
    return F.coalesce(c, F.lit(False))


def should_match(spec, n: int) -> int:
    """How many of ``n`` optional clauses a ``minimum_should_match`` asks for."""
    if spec is None:
        return 0
    s = str(spec).strip()
    if s.endswith("%"):
        p = int(s[:-1])
        return max(0, int(n * (p if p >= 0 else 100 + p) / 100))
    k = int(s)
    return max(0, k if k >= 0 else n + k)


def _one(body: dict, key: str) -> tuple[str, dict]:
    """Field and parameters of ``{"field": value}`` or ``{"field": {...}}``."""
    names = [k for k in body if k not in ("boost", "_name")]
    if len(names) != 1:
        raise QueryError("exactly one field is expected")
    v = body[names[0]]
    p = dict(v) if isinstance(v, dict) else {key: v}
    return names[0], {"boost": body.get("boost", 1.0)} | p


def glob_regex(p: str) -> str:
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in p) + "$"


class Compiler:
    def __init__(self, ctx: Context):
        self.ctx = ctx

    def compile(self, query: dict) -> Clause:
        if not isinstance(query, dict) or len(query) != 1:
            raise QueryError(f"a query has one type, not {list(query) if isinstance(query, dict) else query!r}")
        (kind, body), = query.items()
        f = getattr(self, "q_" + kind, None)
        if f is None:
            raise QueryError(f"unknown query [{kind}]")
        self.ctx.depth += 1
        if self.ctx.depth > MAX_DEPTH:
            raise QueryError("the query is nested too deeply")
        c = f(body)
        self.ctx.depth -= 1
        # A match may be null, which a filter takes for no; it isn't wrapped here, so that comparisons reach the scan.
        name = body.get("_name") if isinstance(body, dict) else None
        if name:
            self.ctx.named.append((name, sure(c.match)))
        return c

    def many(self, body) -> list[Clause]:
        items = body if isinstance(body, list) else [body]
        if len(items) > MAX_CLAUSES:
            raise QueryError("too many clauses")
        return [self.compile(q) for q in items]

    def const(self, match: Column, boost=1.0) -> Clause:
        return Clause(match, F.when(sure(match), F.lit(float(boost))).otherwise(0.0))

    # term level
    def q_match_all(self, b):
        return self.const(F.lit(True), b.get("boost", 1.0))

    def q_match_none(self, b):
        return self.const(F.lit(False))

    def q_type(self, b):
        return self.const(F.lit(True))

    def _equal(self, name: str, value) -> Column:
        col, kind = self.ctx.resolve(name)
        if isinstance(kind, T.ArrayType):
            return F.array_contains(col, F.lit(value).cast(kind.elementType))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            return col == self._date(value, kind, False)
        if isinstance(kind, T.BooleanType) and isinstance(value, str):
            value = value == "true"
        if isinstance(kind, T.NumericType) and isinstance(value, str):
            return col == F.lit(float(value))
        if isinstance(kind, T.StringType):
            value = str(value)
        return col == F.lit(value)

    def _date(self, value, kind, up: bool, fmt=None) -> Column:
        t = dates.resolve(value, up, self.ctx.now, fmt)
        return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz").cast(kind)

    def q_term(self, b):
        name, p = _one(b, "value")
        if p.get("case_insensitive"):
            return self.q_wildcard({name: {"value": str(p["value"]), "case_insensitive": True, "boost": p["boost"]}})
        return self.const(self._equal(name, p["value"]), p["boost"])

    def q_terms(self, b):
        b = dict(b)
        boost = b.pop("boost", 1.0)
        b.pop("_name", None)
        (name, values), = b.items()
        if isinstance(values, dict):
            raise QueryError("a terms lookup is resolved by terms_lookup() before the query is compiled")
        col, kind = self.ctx.resolve(name)
        if isinstance(kind, T.ArrayType):
            return self.const(F.arrays_overlap(col, F.array(*[F.lit(v).cast(kind.elementType) for v in values])), boost)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return self.const(any_of([self._equal(name, v) for v in values]), boost)
        return self.const(col.isin(list(values)), boost)

    def q_terms_set(self, b):
        name, p = _one(b, "terms")
        col, kind = self.ctx.resolve(name)
        hits = total([sure(F.array_contains(col, t) if isinstance(kind, T.ArrayType) else col == t).cast("int") for t in p["terms"]])
        if "minimum_should_match_field" in p:
            need = self.ctx.resolve(p["minimum_should_match_field"])[0]
        elif "minimum_should_match_script" in p:
            s = p["minimum_should_match_script"]
            s = {"source": s} if isinstance(s, str) else dict(s)
            s["params"] = s.get("params", {}) | {"num_terms": len(p["terms"])}
            need = compile_script(s, self.ctx.schema)
        else:
            need = F.lit(should_match(p.get("minimum_should_match", 1), len(p["terms"])))
        return self.const((hits >= need) & (hits >= 1), p["boost"])

    def q_range(self, b):
        name, p = _one(b, "")
        col, kind = self.ctx.resolve(name)
        ops = [k for k in ("gt", "gte", "lt", "lte") if p.get(k) is not None]
        if not ops:
            raise QueryError("a range needs a bound")
        conds = []
        for op in ops:
            if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
                v = self._date(p[op], kind, op in ("gt", "lte"), p.get("format"))
            elif isinstance(kind, T.StringType):
                v = F.lit(str(p[op]))
            else:
                v = F.lit(p[op] if isinstance(p[op], (int, float)) else float(p[op]))
            conds.append({"gt": col > v, "gte": col >= v, "lt": col < v, "lte": col <= v}[op])
        return self.const(all_of(conds), p["boost"])

    def _strings(self, name: str, test: Callable[[Column], Column]) -> Column:
        col, kind = self.ctx.resolve(name)
        return F.exists(col, test) if isinstance(kind, T.ArrayType) else test(col.cast("string"))

    def q_prefix(self, b):
        name, p = _one(b, "value")
        v = str(p["value"])
        test = (lambda c: F.lower(c).startswith(v.lower())) if p.get("case_insensitive") else (lambda c: c.startswith(v))
        return self.const(self._strings(name, test), p["boost"])

    def q_wildcard(self, b):
        name, p = _one(b, "value")
        pattern = str(p.get("wildcard", p.get("value")))
        if name in self.ctx.text_fields:
            rx = glob_regex(pattern)
            return self.const(F.exists(self.ctx.tokens(name), lambda t: t.rlike(rx)), p["boost"])
        rx = "(?s)" + glob_regex(pattern.lower())
        parts = lambda c: F.exists(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t.rlike(rx))
        return self.const(self._strings(name, lambda c: F.lower(c).rlike(rx) | parts(c)), p["boost"])

    def q_regexp(self, b):
        name, p = _one(b, "value")
        rx = ("(?i)" if p.get("case_insensitive") else "") + f"^(?:{p['value']})$"
        return self.const(self._strings(name, lambda c: c.rlike(rx)), p["boost"])

    def q_fuzzy(self, b):
        name, p = _one(b, "value")
        term = str(p["value"]).lower()
        edits = text.fuzzy_edits(p.get("fuzziness", "AUTO"), term)
        col, kind = self.ctx.resolve(name)
        whole = F.concat_ws(" ", col) if isinstance(kind, T.ArrayType) else col.cast("string")
        words = F.concat(F.array(F.lower(whole)), F.split(F.lower(whole), r"[^\p{L}\p{N}]+"))
        return self.const(text.fuzzy_any(words, term, edits), p["boost"])

    def q_exists(self, b):
        col, kind = self.ctx.resolve(b["field"])
        return self.const(F.size(col) > 0 if isinstance(kind, T.ArrayType) else col.isNotNull(), b.get("boost", 1.0))

    def q_ids(self, b):
        col, kind = self.ctx.resolve(self.ctx.id)
        return self.const(col.cast("string").isin([str(v) for v in b["values"]]), b.get("boost", 1.0))

    def q_script(self, b):
        return self.const(compile_script(b["script"], self.ctx.schema), b.get("boost", 1.0))

    def q_wrapper(self, b):
        return self.compile(json.loads(base64.b64decode(b["query"])))

    def q_has_child(self, b):
        raise QueryError("parent and child documents aren't supported")

    q_has_parent = q_has_child

    def q_nested(self, b):
        path = b["path"]
        col, _ = self.ctx.resolve(path)
        outer = self.ctx.scope

        def inner(x: Column) -> Column:
            self.ctx.scope = (path, x)
            try:
                return self.compile(b["query"]).match
            finally:
                self.ctx.scope = outer

        c = self.const(F.exists(col, inner), b.get("boost", 1.0))
        mode = b.get("score_mode", "none")  # without one the score is constant, as upstream has it
        if mode == "none":
            return c

        def score(x: Column) -> Column:
            self.ctx.scope = (path, x)
            try:
                one = self.compile(b["query"])
                return F.when(sure(one.match), one.score.cast("double"))
            finally:
                self.ctx.scope = outer

        scores = F.filter(F.transform(col, score), lambda s: s.isNotNull())
        added = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s)
        by = {"sum": added, "avg": added / F.size(scores), "max": F.array_max(scores), "min": F.array_min(scores)}
        if mode not in by:
            raise QueryError(f"unknown score_mode {mode}")
        return Clause(c.match, F.coalesce(by[mode], F.lit(0.0)) * float(b.get("boost", 1.0)))

    # compound
    def q_bool(self, b):
        get = lambda k: self.many(b[k]) if b.get(k) else []
        must, filters, should, never = get("must"), get("filter"), get("should"), get("must_not")
        conds = [c.match for c in must + filters] + [~sure(c.match) for c in never]
        if should:
            need = should_match(b.get("minimum_should_match"), len(should)) if "minimum_should_match" in b else (0 if must or filters else 1)
            if need == 1:
                conds.append(any_of([c.match for c in should]))
            elif need > 1:
                conds.append(total([sure(c.match).cast("int") for c in should]) >= need)
        match = all_of(conds)
        scores = [F.when(c.match, c.score).otherwise(0.0) for c in must + should]
        if not scores and not filters and not never:
            scores = [F.lit(1.0)]
        terms = [t for c in must + should + filters for t in c.text_terms]
        return Clause(match, total(scores) * float(b.get("boost", 1.0)), terms)

    def q_constant_score(self, b):
        c = self.compile(b["filter"])
        return Clause(c.match, F.when(c.match, F.lit(float(b.get("boost", 1.0)))).otherwise(0.0), c.text_terms)

    def q_boosting(self, b):
        pos, neg = self.compile(b["positive"]), self.compile(b["negative"])
        return Clause(pos.match, F.when(neg.match, pos.score * float(b["negative_boost"])).otherwise(pos.score) * float(b.get("boost", 1.0)), pos.text_terms)

    def q_dis_max(self, b):
        cs = self.many(b["queries"])
        scores = [F.when(c.match, c.score).otherwise(0.0) for c in cs]
        best = F.greatest(*scores) if len(scores) > 1 else scores[0]
        tie = float(b.get("tie_breaker", 0.0))
        score = best + tie * (total(scores) - best) if tie else best
        return Clause(any_of([c.match for c in cs]), score * float(b.get("boost", 1.0)), [t for c in cs for t in c.text_terms])

    def q_function_score(self, b):
        base = self.compile(b.get("query", {"match_all": {}}))
        fs = b.get("functions") or [{k: v for k, v in b.items() if k in ("field_value_factor", "script_score", "random_score", "weight", "gauss", "exp", "linear")}]
        values, applies = [], []
        for f in fs:
            cond = self.compile(f["filter"]).match if "filter" in f else F.lit(True)
            values.append(self._function(f, base.score))
            applies.append(cond)
        mode = b.get("score_mode", "multiply")
        some = any_of(applies)
        if mode == "first":
            fn = F.coalesce(*[F.when(c, v) for c, v in zip(applies, values)])
        elif mode == "multiply":
            fn = reduce(lambda x, y: x * y, [F.when(c, v).otherwise(1.0) for c, v in zip(applies, values)])
        elif mode in ("sum", "avg"):
            fn = total([F.when(c, v).otherwise(0.0) for c, v in zip(applies, values)])
            if mode == "avg":
                weights = total([F.when(c, F.lit(float(f.get("weight", 1.0)))).otherwise(0.0) for c, f in zip(applies, fs)])
                fn = F.when(weights != 0, fn / weights)
        elif mode in ("max", "min"):
            opts = [F.when(c, v) for c, v in zip(applies, values)]
            fn = (F.greatest if mode == "max" else F.least)(*opts) if len(opts) > 1 else opts[0]
        else:
            raise QueryError(f"unknown score_mode {mode}")
        fn = F.when(some, fn)
        if "max_boost" in b:
            fn = F.least(fn, F.lit(float(b["max_boost"])))
        s, how = base.score, b.get("boost_mode", "multiply")
        one = F.coalesce(fn, F.lit(1.0))
        combined = {"multiply": s * one, "replace": F.coalesce(fn, s), "sum": s + F.coalesce(fn, F.lit(0.0)), "avg": F.coalesce((s + fn) / 2, s), "max": F.greatest(s, fn), "min": F.least(s, fn)}[how]
        score = combined * float(b.get("boost", 1.0))
        match = base.match & (score >= float(b["min_score"])) if "min_score" in b else base.match
        return Clause(match, score, base.text_terms)

    def _function(self, f: dict, score: Column) -> Column:
        w = float(f.get("weight", 1.0))
        if "field_value_factor" in f:
            p = f["field_value_factor"]
            v = self.ctx.resolve(p["field"])[0].cast("double")
            if "missing" in p:
                v = F.coalesce(v, F.lit(float(p["missing"])))
            v = v * float(p.get("factor", 1.0))
            return w * {"none": v, "log": F.log10(v), "log1p": F.log10(v + 1), "log2p": F.log10(v + 2), "ln": F.log(v), "ln1p": F.log1p(v), "ln2p": F.log(v + 2), "square": v * v, "sqrt": F.sqrt(v), "reciprocal": 1 / v}[p.get("modifier", "none")]
        if "script_score" in f:
            return w * compile_script(f["script_score"]["script"], self.ctx.schema, score)
        if "random_score" in f:
            p = f["random_score"] or {}
            col = self.ctx.resolve(p.get("field", self.ctx.id))[0]
            return w * F.pmod(F.xxhash64(col, F.lit(int(p.get("seed", 0)))), F.lit(1 << 24)) / float(1 << 24)
        for kind in ("gauss", "exp", "linear"):
            if kind in f:
                return w * self._decay(kind, f[kind])
        return F.lit(w)

    def _distance(self, name: str, origin, of: list) -> tuple[Column, list[float]]:
        """How far a field lies from a point, moment or number, and some distances in the same unit."""
        if name in self.ctx.geo or isinstance(self.ctx.resolve(name)[1], T.StructType):
            lat, lon = self.ctx.lat_lon(name)
            return geo.haversine(lat, lon, *geo.point(origin)), [geo.metres(x) if isinstance(x, str) else float(x) for x in of]
        col, kind = self.ctx.resolve(name)
        if isinstance(kind, T.NumericType):
            return F.abs(col.cast("double") - float(origin)), [float(x) for x in of]
        at = dates.resolve(origin, False, self.ctx.now)
        path = ".".join(f"`{p}`" for p in self.ctx._path(name))
        d = F.abs(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{at.isoformat(sep=' ')}', cast({path} as timestamp_ntz))")) / 1000.0
        return d, [float(dates.interval_ms(x)) if isinstance(x, str) else float(x) for x in of]

    def _decay(self, kind: str, p: dict) -> Column:
        """1 up to ``offset`` from the origin, ``decay`` at ``scale`` beyond it; a row without a value keeps 1."""
        name = next(k for k in p if k != "multi_value_mode")
        spec = p[name]
        decay = float(spec.get("decay", 0.5))
        d, (scale, offset) = self._distance(name, spec["origin"], [spec["scale"], spec.get("offset", 0)])
        if not 0 < decay < 1 or scale <= 0:
            raise QueryError("decay must be between 0 and 1, and scale above 0")
        x = F.greatest(F.lit(0.0), d - offset) / scale
        if kind == "linear":
            v = F.greatest(F.lit(0.0), 1 - (1 - decay) * x)
        else:
            v = F.pow(F.lit(decay), x * x if kind == "gauss" else x)
        return F.coalesce(v, F.lit(1.0))

    def q_script_score(self, b):
        c = self.compile(b["query"])
        score = compile_script(b["script"], self.ctx.schema, c.score).cast("double")
        match = c.match & (score >= float(b["min_score"])) if "min_score" in b else c.match
        return Clause(match, score * float(b.get("boost", 1.0)), c.text_terms)

    def q_distance_feature(self, b):
        boost = float(b.get("boost", 1.0))
        name = b["field"]
        if name in self.ctx.geo or isinstance(self.ctx.resolve(name)[1], T.StructType):
            lat, lon = self.ctx.lat_lon(name)
            d, pivot = geo.haversine(lat, lon, *geo.point(b["origin"])), geo.metres(b["pivot"])
        else:
            col, kind = self.ctx.resolve(name)
            at = dates.resolve(b["origin"], False, self.ctx.now)
            d = F.abs(F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'{at.isoformat(sep=' ')}', cast({'.'.join(f'`{p}`' for p in self.ctx._path(name))} as timestamp_ntz))")) / 1000.0
            pivot = float(dates.interval_ms(b["pivot"]))
        return Clause(d.isNotNull(), F.coalesce(boost * pivot / (pivot + d), F.lit(0.0)))

    def q_rank_feature(self, b):
        v = self.ctx.resolve(b["field"])[0].cast("double")
        boost = float(b.get("boost", 1.0))
        if "log" in b:
            s = F.log(v + float(b["log"]["scaling_factor"]))
        elif "sigmoid" in b:
            p, e = float(b["sigmoid"]["pivot"]), float(b["sigmoid"]["exponent"])
            s = F.pow(v, F.lit(e)) / (F.pow(v, F.lit(e)) + p**e)
        elif "linear" in b:
            s = v
        else:
            p = float((b.get("saturation") or {}).get("pivot", 1.0))
            s = v / (v + p)
        return Clause(v.isNotNull() & (v > 0), F.coalesce(boost * s, F.lit(0.0)))

    def q_pinned(self, b):
        c = self.compile(b["organic"])
        ids = [str(i) for i in b["ids"]]
        at = F.array_position(F.array(*map(F.lit, ids)), self.ctx.resolve(self.ctx.id)[0].cast("string"))
        # Above any organic score, in the given order.
        return Clause((at > 0) | c.match, F.when(at > 0, F.lit(1e9) - at).otherwise(c.score), c.text_terms)

    # geography
    def q_geo_distance(self, b):
        name = next(k for k in b if k not in ("distance", "distance_type", "validation_method", "boost", "_name", "unit"))
        lat, lon = self.ctx.lat_lon(name)
        return self.const(geo.haversine(lat, lon, *geo.point(b[name])) <= geo.metres(b["distance"]), b.get("boost", 1.0))

    def q_geo_bounding_box(self, b):
        name = next(k for k in b if k not in ("validation_method", "boost", "_name", "type"))
        p = b[name]
        if "top_left" in p:
            (top, left), (bottom, right) = geo.point(p["top_left"]), geo.point(p["bottom_right"])
        else:
            top, left, bottom, right = (float(p[k]) for k in ("top", "left", "bottom", "right"))
        return self.const(geo.in_box(*self.ctx.lat_lon(name), top, left, bottom, right), b.get("boost", 1.0))

    def q_geo_polygon(self, b):
        name = next(k for k in b if k not in ("validation_method", "boost", "_name"))
        return self.const(geo.in_polygon(*self.ctx.lat_lon(name), [geo.point(p) for p in b[name]["points"]]), b.get("boost", 1.0))

    def q_geo_shape(self, b):
        name = next(k for k in b if k not in ("boost", "_name", "ignore_unmapped"))
        s, (lat, lon) = b[name]["shape"], self.ctx.lat_lon(name)
        kind, c = s["type"].lower(), s.get("coordinates")
        if kind == "point":
            m = (lat == float(c[1])) & (lon == float(c[0]))
        elif kind == "envelope":
            m = geo.in_box(lat, lon, c[0][1], c[0][0], c[1][1], c[1][0])
        elif kind == "polygon":
            m = geo.in_polygon(lat, lon, [geo.point(p) for p in c[0]])
            for hole in c[1:]:
                m &= ~geo.in_polygon(lat, lon, [geo.point(p) for p in hole])
        elif kind == "circle":
            m = geo.haversine(lat, lon, *geo.point(c)) <= geo.metres(s["radius"])
        else:
            raise QueryError(f"unknown shape {kind}")
        return self.const(~sure(m) if b[name].get("relation") == "disjoint" else m, b.get("boost", 1.0))

    # text
    def _terms(self, name: str, query) -> list[str]:
        words = text.python_tokens(str(query))
        if self.ctx.analyzers.get(name) in ("english", "stemmer"):
            words = [text.stem_word(w) for w in words if self.ctx.analyzers[name] == "stemmer" or w not in text.STOPWORDS]
        if self.ctx.analyzers.get(name) in ("keyword",):
            return [str(query)]
        return words

    def _bm25(self, name: str, terms: list[str], boost: float) -> Column:
        """The summed relevance of the terms in this row."""
        if not self.ctx.scoring:
            return F.lit(0.0)
        for t in terms:
            self.ctx.wanted.add((name, t))
        st = self.ctx.stats
        if not st:
            return F.lit(0.0)

        def score(tok: Column) -> Column:
            length = K1 * (1 - B + B * F.size(tok) / st["avgdl"][name])
            parts = []
            for t in terms:
                f = text.tf(tok, t).cast("double")
                parts.append(F.lit(text.bm25_idf(st["n"], st["df"][(name, t)])) * f * (K1 + 1) / (f + length))
            return total(parts) * boost

        return self.ctx.with_tokens(name, score) if terms else F.lit(0.0)

    def q_match(self, b):
        name, p = _one(b, "query")
        terms = self._terms(name, p["query"])
        boost = float(p["boost"])
        if not terms:
            return self.const(F.lit(p.get("zero_terms_query") == "all"))
        distinct = list(dict.fromkeys(terms))

        def enough(hit: list[Column]) -> Column:
            if str(p.get("operator", "or")).lower() == "and":
                return all_of(hit)
            need = should_match(p.get("minimum_should_match"), len(terms))
            return any_of(hit) if need <= 1 else total([h.cast("int") for h in hit]) >= need

        if p.get("fuzziness") is not None:  # through Arrow, which can't happen inside a bound expression
            tok = self.ctx.tokens(name)
            m = enough([text.fuzzy_any(tok, t, text.fuzzy_edits(p["fuzziness"], t)) for t in terms])
        else:
            m = self.ctx.with_tokens(name, lambda tok: enough([F.array_contains(tok, t) for t in terms]))
        return Clause(m, self._bm25(name, distinct, boost), [(name, t) for t in distinct])

    def q_match_phrase(self, b):
        name, p = _one(b, "query")
        terms = self._terms(name, p["query"])
        if not terms:
            return self.const(F.lit(False))
        slop = int(p.get("slop", 0))
        m = self.ctx.with_tokens(name, lambda tok: text.phrase(tok, terms) if not slop else text.sloppy_phrase(tok, terms, slop))
        return Clause(m, self._bm25(name, list(dict.fromkeys(terms)), float(p["boost"])), [(name, t) for t in terms])

    def q_match_phrase_prefix(self, b):
        name, p = _one(b, "query")
        terms = self._terms(name, p["query"])
        if not terms:
            return self.const(F.lit(False))
        head = terms[:-1]
        m = text.phrase(self.ctx.tokens(name), terms, last_is_prefix=True)
        return Clause(m, self._bm25(name, list(dict.fromkeys(head)), float(p["boost"])) + F.when(sure(m), F.lit(float(p["boost"]))).otherwise(0.0), [(name, t) for t in head])

    def q_match_bool_prefix(self, b):
        name, p = _one(b, "query")
        terms = self._terms(name, p["query"])
        if not terms:
            return self.const(F.lit(False))
        *head, last = terms

        def enough(tok: Column) -> Column:
            hits = [F.array_contains(tok, t) for t in head] + [F.exists(tok, lambda t: t.startswith(last))]
            if str(p.get("operator", "or")).lower() == "and":
                return all_of(hits)
            need = should_match(p.get("minimum_should_match"), len(hits))
            return any_of(hits) if need <= 1 else total([h.cast("int") for h in hits]) >= need

        m = self.ctx.with_tokens(name, enough)
        begun = F.exists(self.ctx.tokens(name), lambda t: t.startswith(last))
        score = self._bm25(name, list(dict.fromkeys(head)), float(p["boost"])) + F.when(begun, F.lit(float(p["boost"]))).otherwise(0.0)
        return Clause(m, score, [(name, t) for t in head])

    def q_multi_match(self, b):
        kind = b.get("type", "best_fields")
        fields = [(f.partition("^")[0], float(f.partition("^")[2] or 1)) for f in b["fields"]]
        inner = {"phrase": "match_phrase", "phrase_prefix": "match_phrase_prefix", "bool_prefix": "match_bool_prefix"}.get(kind, "match")
        extra = {k: b[k] for k in ("operator", "minimum_should_match", "slop", "fuzziness") if k in b}
        if kind == "cross_fields":
            terms = text.python_tokens(b["query"])
            found = [self.ctx.with_tokens(f, lambda w: F.array(*[F.array_contains(w, t) for t in terms])) for f, _ in fields]
            per = [any_of([x[i] for x in found]) for i in range(len(terms))]
            m = all_of(per) if str(b.get("operator", "or")).lower() == "and" else any_of(per)
            scores = [self._bm25(f, list(dict.fromkeys(terms)), w) for f, w in fields]
            return Clause(m, F.greatest(*scores) if len(scores) > 1 else scores[0], [(f, t) for f, _ in fields for t in terms])
        cs = [self.compile({inner: {f: {"query": b["query"], "boost": w} | extra}}) for f, w in fields]
        scores = [F.when(c.match, c.score).otherwise(0.0) for c in cs]
        if kind in ("most_fields", "bool_prefix") or len(cs) == 1:
            s = total(scores)
        else:
            best, tie = F.greatest(*scores), float(b.get("tie_breaker", 0.0))
            s = best + tie * (total(scores) - best)
        return Clause(any_of([c.match for c in cs]), s * float(b.get("boost", 1.0)), [t for c in cs for t in c.text_terms])

    def q_combined_fields(self, b):
        return self.q_multi_match(b | {"type": "cross_fields"})

    def _default_fields(self, b) -> list[str]:
        f = b.get("fields") or ([b["default_field"]] if b.get("default_field") not in (None, "*") else None)
        return f or self.ctx.text_fields or [x.name for x in self.ctx.schema.fields if isinstance(x.dataType, T.StringType)]

    def q_query_string(self, b):
        return self.compile(parse_query_string(b["query"], self._default_fields(b), b.get("default_operator", "or")))

    def q_simple_query_string(self, b):
        return self.compile(parse_simple(b["query"], self._default_fields(b), b.get("default_operator", "or")))

    def q_more_like_this(self, b):
        likes = b["like"] if isinstance(b["like"], list) else [b["like"]]
        fields = b.get("fields") or self._default_fields(b)
        if len(likes) * len(fields) > 4096:
            raise QueryError("more_like_this has too many pairs of fields and texts")
        return self.compile({"bool": {"should": [{"match": {f: str(t)}} for f in fields for t in likes], "minimum_should_match": 1}})

    # spans: arrays of (s, e), e exclusive
    def _spans(self, q: dict) -> tuple[str, Column]:
        (kind, b), = q.items()
        if kind == "span_term":
            name, p = _one(b, "value")
            v = str(p.get("term", p.get("value"))).lower()
            return name, F.transform(text.positions(self.ctx.tokens(name), v), lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))
        if kind == "span_or":
            parts = [self._spans(c) for c in b["clauses"]]
            return parts[0][0], F.array_distinct(F.concat(*[p for _, p in parts]))
        if kind == "span_first":
            name, s = self._spans(b["match"])
            return name, F.filter(s, lambda x: x["e"] <= int(b["end"]))
        if kind == "span_not":
            (name, inc), (_, exc) = self._spans(b["include"]), self._spans(b["exclude"])
            pre, post = int(b.get("pre", b.get("dist", 0))), int(b.get("post", b.get("dist", 0)))
            return name, F.filter(inc, lambda x: ~F.exists(exc, lambda y: (y["s"] < x["e"] + post) & (y["e"] > x["s"] - pre)))
        if kind in ("span_containing", "span_within"):
            (name, big), (_, little) = self._spans(b["big"]), self._spans(b["little"])
            if kind == "span_containing":
                return name, F.filter(big, lambda x: F.exists(little, lambda y: (y["s"] >= x["s"]) & (y["e"] <= x["e"])))
            return name, F.filter(little, lambda y: F.exists(big, lambda x: (y["s"] >= x["s"]) & (y["e"] <= x["e"])))
        if kind == "span_near":
            parts = [self._spans(c) for c in b["clauses"]]
            return parts[0][0], near([p for _, p in parts], int(b.get("slop", 0)), bool(b.get("in_order", True)))
        if kind == "span_multi":
            (inner, ib), = b["match"].items()
            name, p = _one(ib, "value")
            v = str(p["value"])
            rx = {"prefix": "^" + re.escape(v.lower()), "wildcard": glob_regex(v.lower()), "regexp": f"^(?:{v})$"}[inner]
            return name, self._token_spans(name, rx)
        raise QueryError(f"unknown span query {kind}")

    def _token_spans(self, name: str, rx: str) -> Column:
        at = F.filter(F.transform(self.ctx.tokens(name), lambda t, i: F.when(t.rlike(rx), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(i.alias("s"), (i + 1).alias("e")))

    def _span(self, kind):
        def run(b):
            found = self.ctx.with_tokens(_span_field({kind: b}), lambda _: F.size(self._spans({kind: b})[1]))
            return self.const(found > 0, b.get("boost", 1.0) if isinstance(b, dict) else 1.0)

        return run

    def __getattr__(self, name):
        if name.startswith("q_span_"):
            return self._span(name[2:])
        raise AttributeError(name)

    def _interval(self, name: str, rule: dict) -> Column:
        (kind, p), = ((k, v) for k, v in rule.items() if k not in ("boost", "_name"))
        if kind == "match":
            parts = [F.transform(text.positions(self.ctx.tokens(name), t), lambda i: F.struct(i.alias("s"), (i + 1).alias("e"))) for t in self._terms(name, p["query"])]
            gaps = int(p.get("max_gaps", -1))
            s = near(parts, gaps if gaps >= 0 else 1 << 20, bool(p.get("ordered", False)))
        elif kind == "all_of":
            gaps = int(p.get("max_gaps", -1))
            s = near([self._interval(name, r) for r in p["intervals"]], gaps if gaps >= 0 else 1 << 20, bool(p.get("ordered", False)))
        elif kind == "any_of":
            s = F.concat(*[self._interval(name, r) for r in p["intervals"]])
        elif kind == "prefix":
            s = self._token_spans(name, "^" + re.escape(p["prefix"].lower()))
        elif kind == "wildcard":
            s = self._token_spans(name, glob_regex(p["pattern"].lower()))
        elif kind == "fuzzy":
            s = F.concat(*[self._token_spans(name, "^" + re.escape(p["term"].lower()) + "$")])
        else:
            raise QueryError(f"unknown interval rule {kind}")
        for how, r in (p.get("filter") or {}).items():
            o = self._interval(name, r)
            test = {"containing": lambda x, y: (y["s"] >= x["s"]) & (y["e"] <= x["e"]), "contained_by": lambda x, y: (x["s"] >= y["s"]) & (x["e"] <= y["e"]), "before": lambda x, y: x["e"] <= y["s"], "after": lambda x, y: x["s"] >= y["e"], "overlapping": lambda x, y: (x["s"] < y["e"]) & (y["s"] < x["e"])}
            negate = how.startswith("not_")
            f = test[how.removeprefix("not_")]
            s = F.filter(s, _beside(o, f, negate))
        return s

    def q_intervals(self, b):
        name, p = _one(b, "match")
        found = self.ctx.with_tokens(name, lambda _: F.size(self._interval(name, {k: v for k, v in p.items() if k != "boost"})))
        return self.const(found > 0, p["boost"])

    # vectors
    def q_knn(self, b):
        col, _ = self.ctx.resolve(b["field"])
        v = b["query_vector"] if "query_vector" in b else self.ctx.embed(b["query_vector_builder"]["text_embedding"]["model_text"])
        kind = b.get("similarity_function", "cosine")
        q = vectors.literal(v)
        raw = {"cosine": vectors.cosine, "dot_product": vectors.dot, "l2_norm": lambda a, c: F.sqrt(vectors.l2_squared(a, c))}[kind](col, q)
        m = col.isNotNull() & (F.size(col) == len(v))
        for f in ([b["filter"]] if isinstance(b.get("filter"), dict) else b.get("filter") or []):
            m &= self.compile(f).match
        if "similarity" in b:
            m &= raw <= float(b["similarity"]) if kind == "l2_norm" else raw >= float(b["similarity"])
        near = vectors.similarity(kind, col, q)
        if "k" in b:
            k = int(b["k"])
            if not 1 <= k <= int(b.get("num_candidates", MAX_CANDIDATES)) <= MAX_CANDIDATES:
                raise QueryError(f"k must be between 1 and num_candidates, and that at most {MAX_CANDIDATES}")
            m &= self._among(m, near, k)
        return Clause(m, F.coalesce(near, F.lit(0.0)) * float(b.get("boost", 1.0)))

    def _among(self, match: Column, near: Column, k: int) -> Column:
        """Whether a row is among the ``k`` nearest that match: not beyond the last of these, which a first pass over the table finds."""
        if self.ctx.scope is not None or self.ctx.table is None:
            raise QueryError("k takes a knn query over a table")
        by = F.col(f"`{self.ctx.id}`")
        rows = self.ctx.table.where(match).select(near.alias("__s"), by.alias("__i")).where("__s is not null")
        last = rows.orderBy(F.desc("__s"), F.asc("__i")).limit(k).agg(F.min(F.struct("__s", F.lit(0))).alias("m"), F.count("*").alias("n"), F.max_by("__i", F.struct(-F.col("__s"), "__i")).alias("i")).first()
        if last["n"] < k:
            return near.isNotNull()
        return (near > F.lit(last["m"][0])) | ((near == F.lit(last["m"][0])) & (by <= F.lit(last["i"])))

    def q_semantic(self, b):
        if self.ctx.embed is None:
            raise QueryError("semantic needs an embedder")
        return self.q_knn({"field": b["field"], "query_vector": self.ctx.embed(b["query"])})


def _beside(other: Column, test, negate: bool):
    def keep(x: Column) -> Column:
        hit = F.exists(other, lambda y: test(x, y))
        return ~hit if negate else hit

    return keep


def _grow(spans: Column, ordered: bool):
    """From a run to the runs that one more span makes of it."""

    def step(r: Column) -> Column:
        def fits(x: Column) -> Column:
            return x["s"] >= r["e"] if ordered else (x["s"] >= r["e"]) | (x["e"] <= r["s"])

        return F.transform(F.filter(spans, fits), lambda x: F.struct(F.least(r["s"], x["s"]).alias("s"), F.greatest(r["e"], x["e"]).alias("e"), (r["used"] + x["e"] - x["s"]).alias("used")))

    return step


def _grown(runs: Column, slop: int, ordered: bool):
    return lambda spans: F.filter(F.flatten(F.transform(runs, _grow(spans, ordered))), lambda r: r["e"] - r["s"] - r["used"] <= slop)


def _span_field(q: dict) -> str:
    """The field of a span query: that of its first term."""
    (kind, b), = q.items()
    if kind == "span_term":
        return _one(b, "value")[0]
    if kind == "span_multi":
        return _one(next(iter(b["match"].values())), "value")[0]
    return _span_field(b["clauses"][0] if "clauses" in b else b.get("match") or b.get("include") or b["little"])


def near(parts: list[Column], slop: int, ordered: bool) -> Column:
    """Spans made of one span of each part, not overlapping, with at most ``slop`` positions between them in all."""
    runs = F.transform(parts[0], lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), (x["e"] - x["s"]).alias("used")))
    for p in parts[1:]:
        runs = text.let(p, _grown(runs, slop, ordered))
    return F.transform(runs, lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e")))


def compile_query(df: DataFrame, query: dict, scoring: bool = False, **options) -> tuple[Clause, Context]:
    """The clause of a query over ``df``. With ``scoring`` the statistics of its text terms are collected first."""
    query = rewrite(query)
    ctx = Context(df.schema, scoring=scoring, table=df, **options)
    clause = Compiler(ctx).compile(query)
    if scoring and ctx.wanted:
        ctx.stats = collect_stats(df, ctx)
        ctx.named = []
        clause = Compiler(ctx).compile(query)
    return clause, ctx


def terms_lookup(df: DataFrame, field_name: str, other: DataFrame, path: str, negate: bool = False) -> DataFrame:
    """Rows whose field is among another table's values: a semi join, or an anti join with ``negate``."""
    values = other.select(F.col(path).alias("__v")).where("__v is not null").distinct()
    return df.join(values, df[field_name] == values["__v"], "left_anti" if negate else "left_semi")


def percolate(queries: list[tuple[str, dict]], docs: DataFrame, **options) -> DataFrame:
    """Each document with the names of the stored queries that match it: one column per query, no join."""
    hits = [F.when(compile_query(docs, q, **options)[0].match, F.lit(n)) for n, q in queries]
    return docs.withColumn("matched_queries", F.array_compact(F.array(*hits)))
