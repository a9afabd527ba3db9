"""An approximate index for vector search: cells of a cross-polytope tree, of which a search reads the nearest few.

The tree is fitted on a bounded sample and every vector is written under its cell, in ranges of cells, sorted; a search
ranks cells by their distance from the query, takes as many as hold ``num_candidates`` vectors, reads these alone, and
compares them exactly.

Defined results: null vectors, those of another length, with a null, NaN or infinity, or all zero aren't indexed; similarity
is the cosine; ties go to the smaller id; fewer than k candidates give fewer hits; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.functions import vectors
from searchloom.functions.polytope import CellTree, Rotations

#: Vectors on which the tree is fitted, about; a node is split on twice ``LEAST`` of them at least.
SAMPLE, LEAST = 50_000, 4
#: Cells that a search ranks.
RANKED = 4096


@dataclass
class VectorIndex:
    spark: SparkSession
    path: str
    tree: CellTree | None
    dim: int

    @classmethod
    def build(cls, df: DataFrame, id: str, vector: str, path: str, dim: int, cell: int = 512) -> VectorIndex:  # noqa: A002
        """Index ``vector`` of every row; ``cell`` is how many vectors a cell should hold."""
        spark = df.sparkSession
        rows = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & (F.size("v") == dim))
        rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
        n = rows.count()
        if not n:
            rows.withColumn("cell", F.lit(0).cast("bigint")).write.parquet(f"{path}/vectors")
            return cls(spark, path, None, dim)
        share = min(1.0, 1.2 * SAMPLE / n)
        taken = rows if share == 1.0 else rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 31)) < int(share * (1 << 31)))
        x = np.array(taken.select("v").limit(2 * SAMPLE).toPandas()["v"].tolist(), dtype=np.float64).reshape(-1, dim)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        tree = CellTree(x, Rotations(dim, 7), n / len(x), cell, LEAST)
        shared = spark.sparkContext.broadcast(tree)  # bounded by the sample

        @F.pandas_udf("bigint")
        def cell_of(v: pd.Series) -> pd.Series:
            y = np.array(v.tolist(), dtype=np.float64)
            return pd.Series(shared.value.cells(y / np.linalg.norm(y, axis=1, keepdims=True)))

        rows.withColumn("cell", cell_of("v")).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.parquet(f"{path}/vectors")
        return cls(spark, path, tree, dim)

    def search(self, query: list[float], k: int = 10, num_candidates: int = 1000) -> DataFrame:
        """``id`` and ``similarity`` of the ``k`` best of about ``num_candidates`` vectors at least."""
        if k > num_candidates:
            raise ValueError("k must not be over num_candidates")
        if len(query) != self.dim:
            raise ValueError(f"the query has {len(query)} elements, not {self.dim}")
        rows = self.spark.read.parquet(f"{self.path}/vectors")
        if self.tree is not None and self.tree.depth:
            x = np.asarray(query, dtype=np.float64)[None] / np.linalg.norm(query)
            _, cells, _ = self.tree.probe(x, RANKED)
            sizes = dict(rows.where(F.col("cell").isin(cells.tolist())).groupBy("cell").count().collect())  # RANKED rows at most
            chosen, total = [], 0
            for c in cells.tolist():  # the nearest first
                chosen.append(c)
                total += sizes.get(c, 0)
                if total >= num_candidates:
                    break
            rows = rows.where(F.col("cell").isin(chosen))
        s = vectors.cosine("v", vectors.literal(query))
        return rows.select("id", s.alias("similarity")).orderBy(F.desc("similarity"), F.asc("id")).limit(k)
