"""Search requests: query, filters after it, sorting, paging, collapsing, rescoring, computed fields, hybrid fusion."""

from __future__ import annotations

import fnmatch
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.functions import text
from searchloom.functions.script import compile_script
from searchloom.plans.query import Compiler, Context, QueryError, collect_stats, compile_query
from searchloom.plans.rewrite import rewrite

MAX_WINDOW = 10_000
DROPPED = ("__score",)


@dataclass
class SearchResult:
    """Lazy parts of an answer."""

    hits: DataFrame
    matched: DataFrame
    aggs: dict[str, DataFrame] = field(default_factory=dict)
    inner: dict[str, DataFrame] = field(default_factory=dict)

    def total(self, track: bool | int = True) -> tuple[int, str] | None:
        """Number of matches and whether it is exact (``eq``) or a lower bound (``gte``)."""
        if track is False:
            return None
        if track is True:
            return self.matched.count(), "eq"
        n = self.matched.limit(int(track) + 1).count()
        return (n, "eq") if n <= track else (int(track), "gte")


def flat_names(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted names of all leaves below structs."""
    out = []
    for f in schema.fields:
        n = prefix + f.name
        out += flat_names(f.dataType, n + ".") if isinstance(f.dataType, T.StructType) else [n]
    return out


def source_columns(schema: T.StructType, spec) -> list[str]:
    """Leaves kept by a source filter: a flag, patterns, or includes and excludes."""
    names = flat_names(schema)
    if spec is None or spec is True:
        return schema.names
    if spec is False:
        return []
    if isinstance(spec, (str, list)):
        spec = {"includes": spec}
    one = lambda v: [v] if isinstance(v, str) else list(v or [])
    inc, exc = one(spec.get("includes", spec.get("include"))), one(spec.get("excludes", spec.get("exclude")))
    hit = lambda n, ps: any(fnmatch.fnmatchcase(n, p) or n.startswith(p + ".") for p in ps)
    return [n for n in names if (not inc or hit(n, inc)) and not hit(n, exc)]


def sort_columns(sort, ctx: Context, score: Column) -> list[tuple[str, Column, bool, str | float]]:
    """(name, key, descending, missing) for each sort entry; the id breaks ties."""
    out = []
    for s in sort if isinstance(sort, list) else [sort]:
        if isinstance(s, str):
            s = {s: {"order": "desc" if s == "_score" else "asc"}}
        (name, p), = s.items()
        p = {"order": p} if isinstance(p, str) else p
        desc = p.get("order", "desc" if name == "_score" else "asc") == "desc"
        if name == "_score":
            out.append((name, score, desc, "_last"))
            continue
        if name == "_doc":
            out.append((name, ctx.resolve(ctx.id)[0], desc, "_last"))
            continue
        if name == "_script":
            out.append((name, compile_script(p["script"], ctx.schema, score), desc, "_last"))
            continue
        if name == "_geo_distance":
            from searchloom.functions import geo

            f = next(k for k in p if k not in ("order", "unit", "mode", "distance_type"))
            out.append((name, geo.haversine(*ctx.lat_lon(f), *geo.point(p[f])), desc, "_last"))
            continue
        col, kind = ctx.resolve(name)
        if isinstance(kind, T.ArrayType):
            mode = p.get("mode", "max" if desc else "min")
            as_double = F.transform(col, lambda x: x.cast("double"))
            mean = F.aggregate(as_double, F.lit(0.0), lambda a, x: a + x)
            col = {"min": F.array_min(col), "max": F.array_max(col), "sum": mean, "avg": mean / F.size(col)}.get(mode)
            if col is None:
                srt = F.array_sort(as_double)
                n = F.size(srt)
                col = F.when(n % 2 == 1, F.get(srt, F.floor(n / 2).cast("int"))).otherwise((F.get(srt, F.floor(n / 2).cast("int") - 1) + F.get(srt, F.floor(n / 2).cast("int"))) / 2)
        out.append((name, col, desc, p.get("missing", "_last")))
    return out


def order_by(keys) -> list[Column]:
    out = []
    for _, col, desc, missing in keys:
        if missing == "_first":
            out.append(col.desc_nulls_first() if desc else col.asc_nulls_first())
        elif missing == "_last":
            out.append(col.desc_nulls_last() if desc else col.asc_nulls_last())
        else:
            c = F.coalesce(col, F.lit(missing))
            out.append(c.desc() if desc else c.asc())
    return out


def after(keys, values: list) -> Column:
    """Rows that come later in the order than the given key values."""
    out, same = F.lit(False), F.lit(True)
    for (_, col, desc, missing), v in zip(keys, values):
        if v is None:
            later = F.lit(False) if missing == "_last" else col.isNotNull()
            equal = col.isNull()
        else:
            v = F.lit(v)
            later = (col < v) if desc else (col > v)
            if missing == "_last":
                later = later | col.isNull()
            equal = col == v
        out = out | (same & F.coalesce(later, F.lit(False)))
        same = same & F.coalesce(equal, F.lit(False))
    return out


def search(df: DataFrame, body: dict, id: str = "_id", **options) -> SearchResult:  # noqa: A002
    """Run a search request over ``df``, whose ``id`` column is unique and breaks ties.

    The hits carry the requested fields and ``_score``; and, where asked for, ``highlight_<field>``, ``matched_queries`` and
    the names of script fields. Aggregations are under ``aggs``, as one table per path of names.
    """
    tables = options.pop("tables", {})
    for name, p in (body.get("runtime_mappings") or {}).items():
        if p.get("type") == "lookup":
            df = lookup_field(df, name, p, tables)
            continue
        kind = {"long": "bigint", "double": "double", "boolean": "boolean", "date": "timestamp_ntz"}.get(p.get("type"), "string")
        df = df.withColumn(name, compile_script(p["script"], df.schema).cast(kind))
    query = body.get("query", {"match_all": {}})
    size, start = body.get("size", 10), body.get("from", 0)
    if start + size > MAX_WINDOW:
        raise QueryError(f"from + size is over {MAX_WINDOW}")
    if "hybrid" in query:
        if body.get("aggs") or body.get("aggregations"):
            raise QueryError("hybrid queries take no aggregations")
        fused = hybrid(df, query["hybrid"], id, start + size, **options)
        kept = source_columns(df.schema, body.get("_source"))
        ranked = fused.orderBy(F.desc("_score"), F.asc(id)).offset(start).limit(size)
        return SearchResult(ranked.select(*_select(kept, id), "_score"), fused)
    sort = body.get("sort")
    scoring = size > 0 and (sort is None or "_score" in json.dumps(sort) or bool(body.get("track_scores")) or "min_score" in body or "rescore" in body)
    clause, ctx = compile_query(df, query, scoring, id=id, **options)
    matched = df.where(clause.match)
    score = clause.score.cast("double") if scoring else F.lit(None).cast("double")
    hits = matched.withColumn("_score", score)
    if body.get("indices_boost") and "_index" in df.columns:
        boosts = body["indices_boost"]
        pairs = [p for b in (boosts if isinstance(boosts, list) else [boosts]) for p in b.items()]
        factor = F.lit(1.0)
        for name, f in reversed(pairs):
            factor = F.when(F.col("_index") == name, F.lit(float(f))).otherwise(factor)
        hits = hits.withColumn("_score", F.col("_score") * factor)
    if "min_score" in body:
        hits = matched = hits.where(F.col("_score") >= float(body["min_score"]))
    aggs = {}
    if body.get("aggs") or body.get("aggregations"):
        from searchloom.operators.aggs import run_aggs

        aggs = run_aggs(matched, body.get("aggs") or body["aggregations"], base=df, id=id, **options)
    if "post_filter" in body:
        hits = hits.where(compile_query(df, body["post_filter"], id=id, **options)[0].match)
    if ctx.named:
        hits = hits.withColumn("matched_queries", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in ctx.named])))
    for name, p in (body.get("script_fields") or {}).items():
        hits = hits.withColumn(name, compile_script(p["script"], df.schema, F.col("_score")))
    keys = sort_columns(sort or ["_score"], ctx, F.col("_score"))
    keys.append(("_doc", F.col(f"`{id}`"), False, "_last"))
    if "slice" in body:
        hits = hits.where(F.pmod(F.xxhash64(f"`{id}`"), F.lit(int(body["slice"]["max"]))) == int(body["slice"]["id"]))
    if "search_after" in body:
        hits = hits.where(after(keys, body["search_after"]))
    if "collapse" in body:
        c = body["collapse"]["field"]
        group = hits
        w = Window.partitionBy(ctx.resolve(c)[0]).orderBy(*order_by(keys))
        hits = hits.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    for r in body.get("rescore") if isinstance(body.get("rescore"), list) else [body["rescore"]] if body.get("rescore") else []:
        hits = rescore(df, hits, r, keys, id, **options)
        keys = [("_score", F.col("_score"), True, "_last"), ("_doc", F.col(f"`{id}`"), False, "_last")]
    page = hits.orderBy(*order_by(keys))
    if start:
        page = page.offset(start)
    page = page.limit(size)
    inner = {}
    for spec in _inner_hits(body):
        inner[spec["name"]] = inner_hits(group, page, body["collapse"]["field"], spec, ctx, id)
    kept = source_columns(df.schema, body.get("_source"))
    extra = [c for c in ("matched_queries", *(body.get("script_fields") or {})) if c in page.columns]
    marks = []
    hl = body.get("highlight")
    if hl:
        pre, post = (hl.get("pre_tags") or ["<em>"])[0], (hl.get("post_tags") or ["</em>"])[0]
        for f in hl["fields"]:
            words = sorted({t for g, t in clause.text_terms if g == f or not hl.get("require_field_match", True)})
            how = hl | hl["fields"][f]
            if how.get("number_of_fragments", "fragment_size" in how):
                marks.append(text.fragments(F.col(f), words, pre, post, int(how.get("fragment_size", 100)), int(how.get("number_of_fragments", 5))).alias(f"highlight_{f}"))
            else:
                marks.append(text.highlight(F.col(f), words, pre, post).alias(f"highlight_{f}"))
    for f in body.get("docvalue_fields") or body.get("fields") or []:
        f = {"field": f} if isinstance(f, str) else f
        col = ctx.resolve(f["field"])[0]
        marks.append((F.date_format(col, f["format"]) if f.get("format") else col).alias("field_" + f["field"].replace(".", "_")))
    return SearchResult(page.select(*_select(kept, id), "_score", *extra, *marks), matched, aggs, inner)


def lookup_field(df: DataFrame, name: str, p: dict, tables: dict[str, DataFrame]) -> DataFrame:
    """``df`` with an array of structs: the ``fetch_fields`` of the target's rows whose ``target_field`` has the row's ``input_field``; null without any."""
    from searchloom.lookup import lookup_join

    if p["target_index"] not in tables:
        raise QueryError(f"no table {p['target_index']} to look {name} up in")
    fetch = [f if isinstance(f, str) else f["field"] for f in p["fetch_fields"]]
    key = p["input_field"]
    t = tables[p["target_index"]].where(F.col(p["target_field"]).isNotNull())
    found = t.groupBy(F.col(p["target_field"]).alias(key)).agg(F.sort_array(F.collect_set(F.struct(*fetch))).alias(name))
    return lookup_join(df, found, [key], "left")


class PointInTime:
    """A table as it is now, written apart, and pages of a search over it that no later change shifts."""

    def __init__(self, df: DataFrame, id: str = "_id"):  # noqa: A002
        from searchloom.scratch import materialize

        self.df, self.id = materialize(df, "point-in-time"), id

    def scroll(self, body: dict, size: int = 1000, **options) -> Iterator[list]:
        """The hits page by page, each read from where the last one ended; sorted by the id unless the request says otherwise."""
        sort = list(body.get("sort") or [])
        names = [s if isinstance(s, str) else next(iter(s)) for s in sort]
        last = None
        while True:
            page = dict(body) | {"size": size, "sort": sort or [{self.id: "asc"}]} | ({"search_after": last} if last else {})
            rows = search(self.df, page, self.id, **options).hits.collect()  # one page
            if not rows:
                return
            yield rows
            last = [*[rows[-1][n] for n in names], *([] if self.id in names else [rows[-1][self.id]])] if sort else [rows[-1][self.id]]
            if len(rows) < size:
                return


def _inner_hits(body: dict) -> list[dict]:
    """The inner hits that a collapse asks for, each with a name."""
    spec = (body.get("collapse") or {}).get("inner_hits") or []
    return [{"name": f"inner_{i}" if i else "inner"} | s for i, s in enumerate(spec if isinstance(spec, list) else [spec])]


def inner_hits(group: DataFrame, page: DataFrame, name: str, spec: dict, ctx: Context, id: str) -> DataFrame:  # noqa: A002
    """The first hits of each group of a page: the group's value, the requested fields, the id, ``_score`` and ``rank`` from 1. The page has one row per group."""
    value = ctx.resolve(name)[0]
    groups = page.select(value.alias("__g"))
    keys = sort_columns(spec.get("sort", ["_score"]), ctx, F.col("_score"))
    keys.append(("_doc", F.col(f"`{id}`"), False, "_last"))
    rows = group.withColumn("__v", value).join(F.broadcast(groups), F.col("__v").eqNullSafe(F.col("__g")), "left_semi")  # at most MAX_WINDOW groups
    start, size = int(spec.get("from", 0)), int(spec.get("size", 3))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("__v").orderBy(*order_by(keys)))).where((F.col("rank") > start) & (F.col("rank") <= start + size))
    kept = [n for n in source_columns(ctx.schema, spec.get("_source")) if n not in (id, name)]
    return rows.select(F.col("__v").alias(name.replace(".", "_")), *_select([id, *kept], id), "_score", "rank")


def _select(names: list[str], id: str) -> list[Column]:  # noqa: A002
    cols = [F.col(".".join(f"`{p}`" for p in n.split("."))).alias(n.replace(".", "_")) for n in names]
    return cols if id in names else [F.col(f"`{id}`"), *cols]


def rescore(df: DataFrame, hits: DataFrame, spec: dict, keys, id: str, **options) -> DataFrame:  # noqa: A002
    """Scores of the first ``window_size`` hits, mixed with a second query or a script. Only the window is kept apart: the top hits are a limit, not a sort of all."""
    n = int(spec.get("window_size", 10))
    q = spec["query"] if "query" in spec else {"rescore_query": {"script_score": {"query": {"match_all": {}}, "script": spec["script"]["script"] if "script" in spec["script"] else spec["script"]}}, "score_mode": "total", "query_weight": 0.0}
    clause, _ = compile_query(df, q["rescore_query"], True, id=id, **options)
    qw, rw, mode = float(q.get("query_weight", 1.0)), float(q.get("rescore_query_weight", 1.0)), q.get("score_mode", "total")
    top = hits.orderBy(*order_by(keys)).limit(n)
    a, b = F.col("_score") * qw, clause.score * rw
    mixed = {"total": a + b, "multiply": a * b, "avg": (a + b) / 2, "max": F.greatest(a, b), "min": F.least(a, b)}[mode]
    return top.withColumn("_score", F.when(clause.match, mixed).otherwise(F.col("_score") * qw))


def hybrid(df: DataFrame, spec: dict, id: str, window: int, **options) -> DataFrame:  # noqa: A002
    """Sub-queries fused by reciprocal ranks or by weighted raw scores. Each sub-query gives its top ranks only."""
    fusion = spec.get("fusion", {})
    fusion = {"type": fusion} if isinstance(fusion, str) else fusion
    kind, k = fusion.get("type", fusion.get("method", "rrf")), int(fusion.get("k", fusion.get("rank_constant", 60)))
    if kind not in ("rrf", "linear"):
        raise QueryError(f"fusion [{kind}] isn't supported")
    depth = max(int(fusion.get("rank_window_size", 100)), window)
    parts = None
    for sub in spec["queries"]:
        q, weight = (sub["query"], float(sub.get("weight", 1.0))) if "query" in sub else (sub, 1.0)
        clause, _ = compile_query(df, q, True, id=id, **options)
        top = df.where(clause.match).select(F.col(f"`{id}`"), clause.score.alias("__s")).orderBy(F.desc("__s"), F.asc(f"`{id}`")).limit(depth)
        if kind == "rrf":  # at most `depth` rows are ranked in one task
            top = top.withColumn("__s", 1.0 / (k + F.row_number().over(Window.orderBy(F.desc("__s"), F.asc(f"`{id}`")))))
        top = top.select(f"`{id}`", (F.col("__s") * weight).alias("__s"))
        parts = top if parts is None else parts.unionByName(top)
    fused = parts.groupBy(f"`{id}`").agg(F.sum("__s").alias("_score"))
    return df.join(F.broadcast(fused), id)  # at most queries x depth rows


def explain_score(df: DataFrame, field_name: str, query: str, id: str = "_id") -> DataFrame:  # noqa: A002
    """The parts of a match score: one row per matching record and term, with idf, frequency and length."""
    ctx = Context(df.schema, id=id)
    terms = list(dict.fromkeys(text.python_tokens(query)))
    ctx.wanted = {(field_name, t) for t in terms}
    st = collect_stats(df, ctx)
    tok = F.col("__w")
    rows = df.select(id, ctx.tokens(field_name).alias("__w")).select(id, F.size(tok).alias("dl"), F.explode(F.array(*[F.struct(F.lit(t).alias("term"), F.lit(text.bm25_idf(st["n"], st["df"][(field_name, t)])).alias("idf"), text.tf(tok, t).alias("tf")) for t in terms])).alias("p"))
    rows = rows.select(id, "p.term", "p.idf", "p.tf", "dl").where("tf > 0")
    s = F.col("tf") * 2.2 / (F.col("tf") + 1.2 * (0.25 + 0.75 * F.col("dl") / st["avgdl"][field_name]))
    return rows.withColumn("score", F.col("idf") * s)


def rank_eval(ranked: DataFrame, ratings: DataFrame, k: int = 10, relevant: int = 1) -> DataFrame:
    """Precision, recall, reciprocal rank and nDCG at ``k`` per query.

    ``ranked``: query, doc, rank (from 1). ``ratings``: query, doc, rating. A query without relevant documents has recall and nDCG null.
    """
    top = ranked.where(F.col("rank") <= k).join(ratings, ["query", "doc"], "left").withColumn("rating", F.coalesce("rating", F.lit(0)))
    hit = (F.col("rating") >= relevant).cast("double")
    gain = (F.pow(F.lit(2.0), F.col("rating")) - 1) / F.log2(F.col("rank") + 1.0)
    per = top.groupBy("query").agg((F.sum(hit) / F.count("*")).alias("precision"), F.sum(hit).alias("hits"), F.max(hit / F.col("rank")).alias("reciprocal_rank"), F.sum(gain).alias("dcg"))
    w = Window.partitionBy("query").orderBy(F.desc("rating"), "doc")
    best = ratings.withColumn("r", F.row_number().over(w))
    ideal = best.groupBy("query").agg(F.sum((F.col("rating") >= relevant).cast("bigint")).alias("n"), F.sum(F.when(F.col("r") <= k, (F.pow(F.lit(2.0), F.col("rating")) - 1) / F.log2(F.col("r") + 1.0))).alias("idcg"))
    out = per.join(ideal, "query")
    return out.select("query", "precision", F.when(F.col("n") > 0, F.col("hits") / F.col("n")).alias("recall"), "reciprocal_rank", F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).alias("ndcg"))


def fill_template(template: str | dict, params: dict) -> dict:
    """A request from a template: ``{{name}}`` and ``{{#toJson}}name{{/toJson}}`` are replaced."""
    s = template if isinstance(template, str) else json.dumps(template)
    s = re.sub(r'"?\{\{#toJson\}\}(\w+)\{\{/toJson\}\}"?', lambda m: json.dumps(params.get(m[1])), s)
    whole = lambda m: json.dumps(params[m[1]]) if not isinstance(params.get(m[1], ""), str) else json.dumps(str(params.get(m[1], "")))
    s = re.sub(r'"\{\{(\w+)\}\}"', whole, s)
    return json.loads(re.sub(r"\{\{(\w+)\}\}", lambda m: str(params.get(m[1], "")), s))
