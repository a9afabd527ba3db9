"""Notes with vectors: storing without near copies, recall, and blends of score, age and closeness in the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions import vectors
from searchloom.plans.search import search


#: New notes that are compared with all stored ones at a time.
BLOCK = 20_000


def store(notes: DataFrame, new: DataFrame, key: str = "id", vector: str = "embedding", similarity: float = 0.95) -> DataFrame:
    """Notes and those of the new ones (a batch of some size) that are like none stored and like no earlier one kept of the batch, by key: the batch is compared in blocks with all notes, and with itself."""
    like = near_copies(notes, new, key, vector, similarity).withColumnRenamed(key, "__k")
    fresh = new.join(like, new[key] == like["__k"], "left_anti")
    one, two = (fresh.select(F.col(key).alias(k), F.col(vector).alias(v)) for k, v in (("__a", "__x"), ("__b", "__y")))
    pairs = one.join(two, (F.col("__a") < F.col("__b")) & (vectors.cosine("__x", "__y") >= similarity)).select("__a", "__b")
    copies = pairs.groupBy(F.lit("all").alias("__all")).applyInPandas(_copies, fresh.select(F.col(key).alias("__c")).schema)
    return notes.unionByName(fresh.join(copies, fresh[key] == copies["__c"], "left_anti"))


def near_copies(notes: DataFrame, new: DataFrame, key: str, vector: str, similarity: float) -> DataFrame:
    """``key`` of the new notes that are like a stored one. The batch is the stated query set: blocks of it, of bounded size, are sent to the notes and compared as matrices."""
    import numpy as np
    import pandas as pd

    blocks = max(1, -(-new.count() // BLOCK))
    schema, found = new.select(key).schema, None

    def units(vs) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By number of elements: the places of the usable vectors, and the vectors at length 1."""
        by: dict[int, list[int]] = {}
        for i, v in enumerate(vs):
            if v is not None and len(v):
                by.setdefault(len(v), []).append(i)
        out = {}
        for d, places in by.items():
            x = np.array([vs[i] for i in places], dtype=np.float64)
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.isfinite(norm) & (norm > 0)
            out[d] = (np.array(places)[good], x[good] / norm[good][:, None])
        return out

    for i in range(blocks):
        part = new.select(key, vector)
        part = part if blocks == 1 else part.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == i)
        block = part.toPandas()  # about BLOCK rows
        keys, asked = block[key].tolist(), units(block[vector].tolist())
        shared = notes.sparkSession.sparkContext.broadcast(asked)

        def run(batches, shared=shared, keys=keys):
            hit: dict[int, np.ndarray] = {d: np.zeros(len(p), dtype=bool) for d, (p, _) in shared.value.items()}
            for pdf in batches:
                for d, (_, x) in units(pdf[vector].tolist()).items():
                    if d in shared.value and len(x):
                        places, q = shared.value[d]
                        for at in range(0, len(x), 1024):
                            hit[d] |= (x[at : at + 1024] @ q.T >= similarity - 1e-12).any(axis=0)
            yield pd.DataFrame({key: [keys[p] for d, h in hit.items() for p in shared.value[d][0][h]]})

        one = notes.select(vector).mapInPandas(run, schema)
        found = one if found is None else found.unionByName(one)
    return found.where(F.col(key).isNotNull()).distinct()


def _copies(pairs):
    """The notes that are like an earlier one that is kept itself, in the order of keys; gets the like pairs (__a < __b) only."""
    gone = set()
    for a, b in pairs.sort_values(["__b", "__a"]).itertuples(index=False, name=None):
        if a not in gone:
            gone.add(b)
    return pairs[["__b"]].drop_duplicates().loc[lambda p: p["__b"].isin(gone)].rename(columns={"__b": "__c"})


def _scaled(c: str, w) -> F.Column:
    lo, hi = F.min(c).over(w), F.max(c).over(w)
    return F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(1.0))


def blend_recency(hits: DataFrame, stored: str, weight: float = 0.3, score: str = "_score") -> DataFrame:
    """(1 - w) x score + w x time, both scaled to 0..1 over the hits. The bounds are one row; the hits are not gathered in one task."""
    t = hits.withColumn("__t", F.unix_micros(F.col(stored).cast("timestamp")).cast("double"))
    b = t.agg(F.min(score).alias("__a"), F.max(score).alias("__b"), F.min("__t").alias("__c"), F.max("__t").alias("__d"))
    t = t.crossJoin(F.broadcast(b))  # one row
    unit = lambda v, lo, hi: F.when(F.col(hi) > F.col(lo), (F.col(v) - F.col(lo)) / (F.col(hi) - F.col(lo))).otherwise(F.lit(1.0))
    mixed = (1 - weight) * unit(score, "__a", "__b") + weight * F.coalesce(unit("__t", "__c", "__d"), F.lit(0.0))
    return t.withColumn("blended", mixed).drop("__a", "__b", "__c", "__d", "__t")


def blend_graph(hits: DataFrame, near: DataFrame, node: str, weight: float = 0.3, score: str = "_score") -> DataFrame:
    """(1 - w) x score + w x closeness; nodes out of reach have closeness 0."""
    j = hits.join(near.withColumnRenamed("node", node), node, "left")
    return j.withColumn("blended", (1 - weight) * F.col(score) + weight * F.coalesce("proximity", F.lit(0.0)))


def restrict(hits: DataFrame, near: DataFrame, node: str) -> DataFrame:
    """Only hits in reach."""
    return hits.join(near.select(F.col("node").alias(node)), node, "left_semi")


def recall(notes: DataFrame, query: dict, size: int = 10, id: str = "id", **options) -> DataFrame:  # noqa: A002
    """The best notes for a text, vector or mixed query."""
    return search(notes, {"query": query, "size": size}, id, **options).hits


def best_passage(chunks: DataFrame, parent: str, score: str) -> DataFrame:
    """The best chunk of each parent."""
    cols = [c for c in chunks.columns if c != parent]
    return chunks.groupBy(parent).agg(F.max_by(F.struct(*cols), F.struct(score, -F.col("ordinal"))).alias("passage"))


def first_of_each(df: DataFrame, group: str, order: str) -> DataFrame:
    w = Window.partitionBy(group).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
