"""How characteristic each term is of its record: probabilistic relevance weighting.

score = idf x saturated frequency, with idf = ln(1 + (N - df + 0.5) / (df + 0.5)) and
saturation tf (k1 + 1) / (tf + k1 (1 - b + b dl / avgdl)); df, N and avgdl are taken over the whole collection.

Defined results: a null field counts as empty; a record without terms gives no rows but counts in N and avgdl; a
repeated record is scored each time; an empty collection gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from searchloom.llm.terms import record_terms
from searchloom.lookup import lookup_join
from searchloom.scratch import materialize

#: A term in more than one record in so many is frequent. At most avg_terms x FREQUENT terms can be that.
FREQUENT = 1000


def relevance(df: DataFrame, fields: list[str], key: str = "id", k1: float = 1.2, b: float = 0.75, min_tf: int = 1, min_df: int = 1, max_df: int | None = None, min_score: float = 0.0) -> DataFrame:
    """``key``, ``term``, ``tf``, ``df`` and ``score`` of every record and term within the given bounds that scores above ``min_score``.

    Every text is tokenized once: each record's length and distinct terms with their frequencies are written as one row,
    from which N, the average length, the document frequencies and the scores are taken.

    Frequent terms (in over 1/1000 of the records) are few: the document frequencies of all terms add up to at most
    N x the mean number of distinct terms of a record, so at most 1000 x that mean can be frequent, at any N. Their
    frequencies are counted and, as they are that few, broadcast, and the pairs holding them, most of all pairs, are never
    shuffled; should they be many, their pairs are salted. The others are joined by term; no such key has more than
    N/1000 rows.
    """
    records = materialize(record_terms(df, fields, [F.col(f"`{key}`").alias("__key")]), "relevance")
    n, avgdl = records.agg(F.count("*"), F.avg("dl")).first()
    avgdl = max(float(avgdl or 0.0), 1.0)
    dfs = records.select(F.explode("terms.term").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    cut = n / FREQUENT
    bounds = F.col("df") >= min_df
    if max_df is not None:
        bounds &= F.col("df") <= max_df
    pairs = records.select("__key", "dl", F.explode(F.filter("terms", lambda t: t.tf >= min_tf) if min_tf > 1 else F.col("terms")).alias("__t"))
    pairs = pairs.select("__key", "dl", F.col("__t.term").alias("term"), F.col("__t.tf").cast("bigint").alias("tf"))
    both = max_df is None or max_df > cut
    dfs = materialize(dfs.where(bounds), "relevance-df") if both else dfs.where(bounds)  # read for the rare terms and for the frequent ones
    joined = pairs.join(dfs.where(F.col("df") <= cut), "term")
    if both:
        joined = lookup_join(pairs, dfs.where(F.col("df") > cut), ["term"]).select(joined.columns).unionByName(joined)
    idf = F.log(1 + (F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    sat = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / avgdl))
    scored = joined.select(F.col("__key").alias(key), "term", "tf", "df", (idf * sat).alias("score"))
    return scored.where(F.col("score") > min_score)


def marks_lead(scores: DataFrame, key: str = "id", min_tf: int = 3, min_df: int = 2, max_df: int = 8) -> DataFrame:
    """Whether the score puts a record's marking terms ahead: ``key``, ``marks``, ``others`` and ``leading``, one row per record that has marks.

    A mark is a term of the bounds given; ``leading`` is how many of them score above every other term of the record.
    """
    mark = (F.col("tf") >= min_tf) & F.col("df").between(min_df, max_df)
    best = scores.groupBy(key).agg(F.max(F.when(~mark, F.col("score"))).alias("__best"), F.sort_array(F.collect_list(F.when(mark, F.col("score")))).alias("__marks"), F.count("*").alias("__n"))
    best = best.where(F.size("__marks") > 0)
    leads = F.size(F.filter("__marks", lambda s: F.col("__best").isNull() | (s > F.col("__best"))))
    return best.select(key, F.size("__marks").cast("bigint").alias("marks"), (F.col("__n") - F.size("__marks")).alias("others"), leads.cast("bigint").alias("leading"))
