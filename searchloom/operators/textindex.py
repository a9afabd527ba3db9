"""A postings table for text: what a search reads follows its terms, not the table.

A posting has a term, a record, the record's length and the term's places in it. Postings are laid out in ranges of (term,
record) and sorted, so a search for some terms reads the row groups of these terms only, and a frequent term lies over many
files. Building sorts a record's tokens within its row; nothing but postings is shuffled. More records are added as further
segments; the statistics that scores need are sums over segments.

Defined results: a null text has no postings but its record counts in the number of records; ids should be unique; an empty
table gives an index without hits; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import text
from searchloom.plans.query import K1, B, QueryError, should_match


def _back(steps: int):
    return lambda place: place - steps


@dataclass
class TextIndex:
    spark: SparkSession
    path: str

    def add(self, df: DataFrame, id: str, field: str, analyzer: str = "standard") -> TextIndex:  # noqa: A002
        """Index further records."""
        words = text.ANALYZERS[analyzer](F.col(f"`{field}`").cast("string"))
        rows = df.select(F.col(f"`{id}`").alias("id"), F.array_sort(F.transform(words, lambda w, i: F.struct(w.alias("t"), i.alias("i")))).alias("w"))
        first = F.expr("filter(sequence(1, size(w)), j -> j = 1 or element_at(w, j).t != element_at(w, j - 1).t)")
        rows = rows.select("id", "w", F.expr("transform(w, x -> x.i)").alias("i"), F.when(F.size("w") > 0, first).otherwise(F.array().cast("array<int>")).alias("s"))
        entry = F.expr("transform(s, (a, j) -> struct(element_at(w, a).t as term, slice(i, a, coalesce(get(s, j + 1), size(w) + 1) - a) as places))")
        posted = rows.select("id", F.size("w").alias("dl"), F.explode(entry).alias("p")).select("p.term", "id", "dl", "p.places")
        posted.repartitionByRange("term", "id").sortWithinPartitions("term", "id").write.mode("append").parquet(f"{self.path}/postings")
        stats = rows.agg(F.count("*").alias("records"), F.count(F.when(F.size("w") > 0, 1)).alias("filled"), F.coalesce(F.sum(F.size("w")), F.lit(0)).alias("words"))
        stats.coalesce(1).write.mode("append").parquet(f"{self.path}/stats")
        return self

    def postings(self, terms: list[str]) -> DataFrame:
        """The postings of some terms; the comparison is pushed down to the sorted files."""
        schema = f"term string, id {self._id_type()}, dl int, places array<int>"
        return self.spark.read.schema(schema).parquet(f"{self.path}/postings").where(F.col("term").isin(terms))

    def _id_type(self) -> str:
        return self.spark.read.parquet(f"{self.path}/postings").schema["id"].dataType.simpleString()

    def _stats(self) -> tuple[int, float]:
        n, filled, words = self.spark.read.parquet(f"{self.path}/stats").agg(F.sum("records"), F.sum("filled"), F.sum("words")).first()
        return n or 0, max(1.0, words / filled if filled else 1.0)

    def match(self, query: str, operator: str = "or", minimum_should_match=None, boost: float = 1.0) -> DataFrame:
        """``id`` and ``_score`` of the records that match, as the ``match`` query has them."""
        asked = text.python_tokens(query)
        terms = sorted(set(asked))
        if not terms:
            return self.postings([""]).select("id", F.lit(0.0).alias("_score"))
        n, mean = self._stats()
        found = self.postings(terms)
        df = {r["term"]: r["count"] for r in found.groupBy("term").count().collect()}  # one row per term of the query
        tf = F.size("places").cast("double")
        part = self._idf(n, df, terms) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / mean))
        hits = found.groupBy("id").agg((F.sum(part) * boost).alias("_score"), F.collect_set("term").alias("t"))
        if operator.lower() == "and":
            hits = hits.where(F.size("t") == len(terms))
        elif (need := should_match(minimum_should_match, len(asked))) > 1:
            times = F.create_map(*[F.lit(x) for t in terms for x in (t, asked.count(t))])
            hits = hits.where(F.aggregate("t", F.lit(0), lambda a, t: a + times[t]) >= need)
        return hits.drop("t")

    def _idf(self, n: int, df: dict[str, int], terms: list[str]) -> Column:
        out = F.lit(0.0)
        for t in terms:
            out = F.when(F.col("term") == t, text.bm25_idf(n, df.get(t, 0))).otherwise(out)
        return out

    def phrase(self, query: str) -> DataFrame:
        """``id`` of the records that have the words next to each other, in order."""
        terms = text.python_tokens(query)
        if not terms:
            raise QueryError("a phrase needs a word")
        by = self.postings(sorted(set(terms))).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("m"))
        by = by.where(F.size("m") == len(set(terms)))
        starts = F.col("m")[terms[0]]
        for i, t in enumerate(terms[1:], 1):
            starts = F.array_intersect(starts, F.transform(F.col("m")[t], _back(i)))
        return by.where(F.size(starts) > 0).select("id")

    def top(self, df: DataFrame, id: str, query: str, size: int = 10, **how) -> DataFrame:  # noqa: A002
        """The best records of ``df`` for a query, with ``_score``; at most ``size`` ids are sent to the table."""
        best = self.match(query, **how).orderBy(F.desc("_score"), F.asc("id")).limit(size).withColumnRenamed("id", id)
        return df.join(F.broadcast(best), id).orderBy(F.desc("_score"), F.asc(id))

    def terms(self, prefix: str, size: int = 50) -> DataFrame:
        """``term`` and ``n`` (occurrences) of the indexed words that begin with a prefix, in order."""
        t = self.spark.read.parquet(f"{self.path}/postings").where(F.col("term").startswith(prefix))
        return t.groupBy("term").agg(F.sum(F.size("places")).alias("n")).orderBy("term").limit(size)

    def suggest(self, word: str, edits: int = 2, size: int = 5) -> DataFrame:
        """``term``, ``df`` and ``distance`` of the indexed words nearest to a misspelt one, the more frequent first among equals."""
        near = F.length("term").between(len(word) - edits, len(word) + edits)
        t = self.spark.read.parquet(f"{self.path}/postings").select("term").where(near).groupBy("term").agg(F.count("*").alias("df"))
        d = F.levenshtein("term", F.lit(word))
        return t.withColumn("distance", d).where(F.col("distance") <= edits).orderBy("distance", F.desc("df"), "term").limit(size)
