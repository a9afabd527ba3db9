"""Text queries answered from postings: each clause gives ids and scores, and compound clauses add them up per id.

A clause over an indexed field reads the postings of its terms. Any other clause (a range, a term of a plain field, a wildcard) is
evaluated over the table, of which only that clause's columns are read. The parts of a compound are laid on top of each other
and grouped by id once, so a query of many clauses needs one shuffle of its hits, and no text is tokenized.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.functions import text
from searchloom.operators.textindex import TextIndex
from searchloom.plans.query import QueryError, _one, compile_query, should_match
from searchloom.plans.querystring import parse_query_string, parse_simple
from searchloom.plans.rewrite import rewrite


class IndexedQuery:
    """Queries over ``df``, whose fields in ``indexes`` have postings by the same ids. Results equal those of a search over the table."""

    def __init__(self, df: DataFrame, id: str, indexes: dict[str, TextIndex], **options):  # noqa: A002
        self.df, self.id, self.indexes, self.options = df, id, indexes, options

    def matches(self, query: dict) -> DataFrame:
        """``id`` and ``_score`` of all records that match."""
        return self._run(rewrite(query))

    def search(self, query: dict, size: int = 10) -> DataFrame:
        """The best records with their columns and ``_score``. Their ids, ``size`` at most, are looked up as values, which the scan can skip by."""
        best = self.matches(query).orderBy(F.desc("_score"), F.asc("id")).limit(size).collect()
        scores = self.df.sparkSession.createDataFrame([(r["id"], r["_score"]) for r in best], f"`{self.id}` {self.df.schema[self.id].dataType.simpleString()}, _score double")
        rows = self.df.where(F.col(f"`{self.id}`").isin([r["id"] for r in best]))
        return rows.join(F.broadcast(scores), self.id).orderBy(F.desc("_score"), F.asc(f"`{self.id}`"))

    def _scan(self, query: dict) -> DataFrame:
        c, _ = compile_query(self.df, query, True, id=self.id, **self.options)
        return self.df.where(c.match).select(F.col(f"`{self.id}`").alias("id"), c.score.cast("double").alias("_score"))

    def _run(self, query: dict) -> DataFrame:
        (kind, b), = query.items()
        f = getattr(self, "_" + kind, None)
        return f(b) if f is not None and kind not in ("run", "scan", "combine") else self._scan(query)

    def _indexed(self, b: dict, key: str) -> tuple[TextIndex | None, dict]:
        name, p = _one(b, key)
        return self.indexes.get(name), p

    def _match(self, b: dict) -> DataFrame:
        index, p = self._indexed(b, "query")
        if index is None or p.get("fuzziness") is not None or not text.python_tokens(str(p["query"])):
            return self._scan({"match": b})
        return index.match(str(p["query"]), str(p.get("operator", "or")), p.get("minimum_should_match"), float(p["boost"]))

    def _match_phrase(self, b: dict) -> DataFrame:
        index, p = self._indexed(b, "query")
        if index is None or int(p.get("slop", 0)) or not text.python_tokens(str(p["query"])):
            return self._scan({"match_phrase": b})
        return index.match(str(p["query"]), "and", None, float(p["boost"])).join(index.phrase(str(p["query"])), "id", "left_semi")

    def _multi_match(self, b: dict) -> DataFrame:
        kind = b.get("type", "best_fields")
        fields = [(f.partition("^")[0], float(f.partition("^")[2] or 1)) for f in b["fields"]]
        if kind not in ("best_fields", "most_fields", "phrase") or any(f not in self.indexes for f, _ in fields):
            return self._scan({"multi_match": b})
        extra = {k: b[k] for k in ("operator", "minimum_should_match", "slop", "fuzziness") if k in b}
        parts = [self._run({"match_phrase" if kind == "phrase" else "match": {f: {"query": b["query"], "boost": w} | extra}}) for f, w in fields]
        hits = _stack(parts).groupBy("id").agg(F.sum("_score").alias("__t"), F.max("_score").alias("__m"))
        tie = 1.0 if kind == "most_fields" else float(b.get("tie_breaker", 0.0))
        return hits.select("id", ((F.col("__m") + tie * (F.col("__t") - F.col("__m"))) * float(b.get("boost", 1.0))).alias("_score"))

    def _fields(self, b: dict) -> list[str]:
        return b.get("fields") or ([b["default_field"]] if b.get("default_field") not in (None, "*") else list(self.indexes))

    def _query_string(self, b: dict) -> DataFrame:
        return self._run(rewrite(parse_query_string(b["query"], self._fields(b), b.get("default_operator", "or"))))

    def _simple_query_string(self, b: dict) -> DataFrame:
        return self._run(rewrite(parse_simple(b["query"], self._fields(b), b.get("default_operator", "or"))))

    def _more_like_this(self, b: dict) -> DataFrame:
        likes = b["like"] if isinstance(b["like"], list) else [b["like"]]
        return self._run({"bool": {"should": [{"match": {f: str(t)}} for f in self._fields(b) for t in likes], "minimum_should_match": 1}})

    def _constant_score(self, b: dict) -> DataFrame:
        return self._run(b["filter"]).select("id", F.lit(float(b.get("boost", 1.0))).alias("_score"))

    def _bool(self, b: dict) -> DataFrame:
        get = lambda k: b[k] if isinstance(b.get(k), list) else [b[k]] if b.get(k) else []
        must, filters, should, never = (get(k) for k in ("must", "filter", "should", "must_not"))
        need = (should_match(b["minimum_should_match"], len(should)) if "minimum_should_match" in b else 0 if must or filters else 1) if should else 0
        if not must and not filters and not need:
            return self._scan({"bool": b})  # what matches nothing needs the table
        kinds = [("m", must), ("f", filters), ("s", should), ("n", never)]
        hits = _stack([self._run(q).select("id", "_score", F.lit(k).alias("__k")) for k, qs in kinds for q in qs])
        of = lambda k: F.count_if(F.col("__k") == k)
        score = F.coalesce(F.sum(F.when(F.col("__k").isin("m", "s"), F.col("_score"))), F.lit(0.0)) * float(b.get("boost", 1.0))
        per = hits.groupBy("id").agg(score.alias("_score"), of("m").alias("__m"), of("f").alias("__f"), of("s").alias("__s"), of("n").alias("__n"))
        return per.where((F.col("__m") == len(must)) & (F.col("__f") == len(filters)) & (F.col("__s") >= need) & (F.col("__n") == 0)).select("id", "_score")


def _stack(parts: list[DataFrame]) -> DataFrame:
    if not parts:
        raise QueryError("a compound query needs a clause")
    return reduce(DataFrame.unionByName, parts)
