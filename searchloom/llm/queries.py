"""Registered queries of this package's operators, and the SQL that checks those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.llm import bpe, knn, lookalike, packing, relevance, terms
from searchloom.scratch import materialize, scratch_path

ARTICLE = ["title", "content"]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _term_store(spark: SparkSession, sf: str) -> terms.TermCounts:
    """A store that has taken in the whole table in three changes, each merged into what was there."""
    store = terms.TermCounts(spark, scratch_path(spark, "terms"))
    kb = _table(spark, sf, "ai_kb")
    for batch in ("in_scope", "not in_scope", "in_scope is null"):
        store.apply(terms.signed_changes(None, kb.where(batch), ARTICLE), ARTICLE)
    return store


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms too rare or too common, from a store that takes in the table in three batches."""
    return _term_store(spark, sf).terms().where("mark is not null").select("term", "mark")


def p1_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Every term with its counts."""
    return _term_store(spark, sf).terms()


def p1_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The same counts, reached in two steps: an earlier state of the articles, then what has changed since.

    The earlier state has every article out of scope under its title alone and lacks those without an index time; so the second step adds,
    changes and, by their old form, removes records.
    """
    now = _table(spark, sf, "ai_kb")
    old = now.where("indexed_at is not null").withColumn("content", F.when(F.col("in_scope"), F.col("content")))
    store = terms.TermCounts(spark, scratch_path(spark, "terms"))
    store.apply(terms.signed_changes(None, old, ARTICLE), ARTICLE)
    store.apply(terms.signed_changes(old, now, ARTICLE), ARTICLE)
    return store.terms()


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return knn.similar_pairs(_table(spark, sf, "ai_kb"))


def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest articles of every article, without a bound on the similarity."""
    return knn.nearest(_table(spark, sf, "ai_kb"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Terms that mark their article: at least three times in it, found in two to eight articles, and of a score above 0."""
    return relevance.relevance(_table(spark, sf, "ai_kb"), ARTICLE, min_tf=3, min_df=2, max_df=8).select("id", "term")


def p5_scores(spark: SparkSession, sf: str) -> DataFrame:
    """The score of every term of every article."""
    return relevance.relevance(_table(spark, sf, "ai_kb"), ARTICLE).withColumn("score", F.round("score", 6))


def p5_ranking(spark: SparkSession, sf: str) -> DataFrame:
    """Of each article with marking terms (as in p5_found): how many of them the score puts ahead of all its other terms."""
    return relevance.marks_lead(relevance.relevance(_table(spark, sf, "ai_kb"), ARTICLE))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_table(_table(spark, sf, "documents"))


def p7_containers(spark: SparkSession, sf: str) -> DataFrame:
    """The container and place of every piece of every document."""
    return packing.pack_documents(_table(spark, sf, "documents"))


def p7_instruction(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as instructions and answers, the answer being all after the first line: at most 2,048 tokens, 16 pieces and 1,024 loss-bearing tokens in a container."""
    docs = _table(spark, sf, "documents")
    both = docs.select("doc_id", "text").unionByName(docs.select((-F.col("doc_id") - 1).alias("doc_id"), F.substring_index("text", "\n", 1).alias("text")))
    n = bpe.count_tokens(both, "text", ["doc_id"], "n")
    n = n.groupBy(F.when(F.col("doc_id") < 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")).alias("doc_id")).agg(F.max(F.when(F.col("doc_id") >= 0, F.col("n"))).alias("n_tokens"), F.max(F.when(F.col("doc_id") < 0, F.col("n"))).alias("prompt"))
    sizes = n.select("doc_id", "n_tokens", F.greatest(F.lit(0), F.col("n_tokens") - F.col("prompt")).alias("answer"))
    return packing.pack(materialize(sizes, "pack-instructions"), max_segments=16, max_loss=1024, loss="answer", cut_loss=True)


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return lookalike.lookalike_pairs(_table(spark, sf, "documents"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every document that has a partner, with the class of its look and the numbers of documents and strings there."""
    return lookalike.lookalike_members(_table(spark, sf, "documents"))


def p8_canonical(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's canonical form, by its fingerprint."""
    return lookalike.with_canonical(_table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", F.md5("canonical").alias("look"))


QUERIES = {f.__name__: f for f in (p1_found, p1_terms, p1_incremental, p4_found, p4_nearest, p5_found, p5_scores, p5_ranking, p6_ids, p7_containers, p7_instruction, p8_found, p8_classes, p8_canonical)}

_TERMS = r"""
with t as (select id, unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '[\p{L}\p{N}]+')) term from ai_kb),
     p as (select id, term, count(*) tf from t group by id, term),
     d as (select term, cast(sum(tf) as bigint) occurrences, count(*) records from p group by term),
     n as (select count(*) n from ai_kb),
     m as (select term, occurrences, records, case when records <= 2 then 'rare' when records * 3 > n then 'common' end mark from d, n)
"""
_SCORES = """, l as (select id, sum(tf) dl from p group by id), a as (select (select sum(tf) from p) / n avgdl, n from n),
     s as (select id, term, tf, records df, ln(1 + (n - records + 0.5) / (records + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) score
           from p join d using (term) join l using (id), a)
"""
_P1 = _TERMS + "select term, occurrences, records, mark from m"

SQL = {
    "p1_found": _TERMS + "select term, mark from m where mark is not null",
    "p1_terms": _P1,
    "p1_incremental": _P1,
    "p5_found": _TERMS + "select id, term from p join d using (term) where tf >= 3 and records between 2 and 8",
    "p5_scores": _TERMS + _SCORES + "select id, term, tf, df, round(score, 6) score from s",
    "p5_ranking": _TERMS
    + _SCORES
    + """, b as (select id, max(score) filter (where not (tf >= 3 and df between 2 and 8)) best from s group by id)
select id, count(*) filter (where tf >= 3 and df between 2 and 8) marks, count(*) filter (where not (tf >= 3 and df between 2 and 8)) others,
       count(*) filter (where tf >= 3 and df between 2 and 8 and (best is null or score > best)) as leading
from s join b using (id) group by id having marks > 0""",
    "p4_found": """
with u as (select id, list_transform(embedding, lambda x: x::double) e from ai_kb
           where len(embedding) = 8 and len(list_filter(embedding, lambda x: isfinite(x))) = 8 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
     s as (select a.id a, b.id b, list_cosine_similarity(a.e, b.e) c from u a join u b on a.id <> b.id),
     r as (select a, b, c, row_number() over (partition by a order by round(c, 12) desc, b) k from s where c >= 0.997)
select distinct least(a, b) id_a, greatest(a, b) id_b from r where k <= 10""",
}
