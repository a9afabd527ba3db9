"""Packing of variable-length examples into containers under several limits at once.

A container holds at most ``capacity`` tokens, ``max_segments`` pieces and ``max_loss`` loss-bearing tokens (all tokens
of a piece but its first, which nothing precedes, unless a column has their number). Containers are filled one at a time: of the pieces that still fit,
the one whose demand vector has the largest dot product with the vector of remaining room, both as shares of the
limits, goes in next. Pieces of one size and loss are interchangeable, so the choice is made among those, not among pieces.

Pieces are spread over groups of bounded size that are packed in parallel; the worst-filled containers of each group are
opened again and their pieces packed together, in fewer groups, until one group is left. So what is lost is about one
part-filled container in all, not one per group.

Defined results: rows without tokens (null and empty texts) need no container and give no row; a row of more than
``capacity`` tokens is cut into full pieces and a rest, and only such a row is cut; repeated rows and null keys are
packed as rows of their own; equal sizes are taken in the order of a row number; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.llm.bpe import DEFAULT_RANKS, count_tokens
from searchloom.scratch import materialize

#: Tokens and pieces of one group, which is packed in one task; about as many at most.
GROUP_TOKENS, GROUP_PIECES = 4_000_000, 250_000
#: Containers of each group that are opened again for the next round, and the fill from which one is kept as it is.
REOPEN, FULL = 8, 0.995


def pack_group(sizes: np.ndarray, capacity: int, max_segments: int, max_loss: int, loss: np.ndarray | None = None) -> np.ndarray:
    """The container number of each piece, counted from 0. Every size is between 1 and ``capacity``, every loss at most ``max_loss``."""
    n = len(sizes)
    loss = np.maximum(sizes - 1, 0) if loss is None else loss
    order = np.lexsort((loss, sizes))
    kinds, first, left = np.unique(np.stack([sizes[order], loss[order]], axis=1), axis=0, return_index=True, return_counts=True)
    kinds, loss = np.ascontiguousarray(kinds.T)
    left, first = left.copy(), first.copy()
    limits = np.array([capacity, max_segments, max_loss], dtype=np.float64)
    need = np.stack([kinds, np.ones_like(kinds), loss], axis=1) / limits
    out = np.empty(n, dtype=np.int64)
    box, done = 0, 0
    while done < n:
        tokens, segments, bearing = capacity, max_segments, max_loss
        while segments:
            upto = np.searchsorted(kinds, tokens, side="right")
            fits = np.flatnonzero((left[:upto] > 0) & (loss[:upto] <= bearing))
            if not len(fits):
                break
            room = np.array([tokens, segments, bearing]) / limits
            i = fits[np.argmax(need[fits] @ room)]
            out[order[first[i]]] = box
            first[i] += 1
            left[i] -= 1
            tokens -= kinds[i]
            bearing -= loss[i]
            segments -= 1
            done += 1
        box += 1
    return out


def pack(sizes: DataFrame, size: str = "n_tokens", keys: list[str] | None = None, capacity: int = 2048, max_segments: int | None = None, max_loss: int | None = None, loss: str | None = None, cut_loss: bool = False) -> DataFrame:
    """``keys``, ``piece``, ``first_token``, ``n_tokens``, ``container``, ``slot`` and ``start`` for every piece.

    ``piece`` numbers the pieces of a row from 0, ``first_token`` is where it begins in the row; ``slot`` is the piece's
    number in its container and ``start`` its first place there. ``sizes`` should be a written table: it is read for
    the total and for the packing. Only keys and sizes travel, never texts. The column ``loss`` has the number of a row's
    loss-bearing tokens, its last ones (a prompt comes before its answer); a null means all but the first.

    A row with a piece of more than ``max_loss`` loss-bearing tokens fits into no container. It is refused, or with ``cut_loss`` cut
    into pieces of ``max_loss`` + 1 tokens (or ``capacity``, if that is less), of which the first bears none.
    """
    keys = keys or ["doc_id"]
    max_segments = max_segments or capacity
    max_loss = max_loss or capacity
    if min(capacity, max_segments) < 1 or max_loss < (capacity - 1 if loss is None else 0):
        raise ValueError("a piece of full size must fit into an empty container")
    rows = sizes.where(F.col(size) > 0).select(*[F.col(f"`{k}`").alias(f"__k{i}") for i, k in enumerate(keys)], F.col(f"`{size}`").cast("bigint").alias("__n"), *([F.col(f"`{loss}`").cast("bigint").alias("__l")] if loss else []))
    rows = rows.withColumn("__row", F.monotonically_increasing_id())
    bears = F.least(F.coalesce(F.col("__l"), F.col("__n")), F.col("__n") - 1) if loss else F.lit(0)
    much = (F.least(bears, F.lit(capacity - 1)) > max_loss) if cut_loss else F.lit(False)
    rows = rows.withColumn("__step", F.when(much, F.lit(min(capacity, max_loss + 1))).otherwise(F.lit(capacity)).cast("bigint"))
    cap = F.col("__step")
    cut = rows.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / cap))))
    end = F.least(F.col("__n"), (F.col("piece") + 1) * cap)
    bears = [F.greatest(F.lit(0), F.least(end - F.col("piece") * cap - 1, F.coalesce(F.col("__l"), F.col("__n")) - (F.col("__n") - end))).alias("__loss")] if loss else []
    cut = cut.select(*[f"__k{i}" for i in range(len(keys))], "__row", "piece", (F.col("piece") * cap).alias("first_token"), F.least(cap, F.col("__n") - F.col("piece") * cap).cast("bigint").alias("n_tokens"), *bears)
    pieces = materialize(cut, "pack-pieces")
    total, n, most = pieces.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.count("*"), F.max("__loss") if loss else F.lit(0)).first()
    if (most or 0) > max_loss:
        raise ValueError(f"a piece of {most} loss-bearing tokens must fit into an empty container")
    groups = max(1, -(-total // GROUP_TOKENS), -(-n // GROUP_PIECES))
    todo, kept, level = pieces, None, 0
    schema = T.StructType([*pieces.schema, T.StructField("container", T.LongType()), T.StructField("__open", T.BooleanType())])

    def packer(level: int, last: bool):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["__row", "piece"], kind="stable").reset_index(drop=True)
            n = pdf["n_tokens"].to_numpy()
            box = pack_group(n, capacity, max_segments, max_loss, pdf["__loss"].to_numpy() if loss else None)
            fill = np.bincount(box, weights=n)
            worst = np.argsort(fill, kind="stable")[:REOPEN]
            again = np.zeros(len(fill), dtype=bool)
            again[worst] = fill[worst] < FULL * capacity
            number = (level << 56) | (int(pdf["__g"].iloc[0]) << 24)
            pdf["container"] = number + box
            pdf["__open"] = again[box] & (not last)
            return pdf.drop(columns="__g")

        return run

    while True:
        g = F.pmod(F.xxhash64("__row", "piece", F.lit(level)), F.lit(groups)).alias("__g")
        done = todo.select("*", g).groupBy("__g").applyInPandas(packer(level, groups == 1), schema)
        done = materialize(done, f"pack-{level}")
        closed = done.where("not __open").drop("__open")
        kept = closed if kept is None else kept.unionByName(closed)
        if groups == 1:
            break
        todo = done.where("__open").drop("__open", "container")
        groups = max(1, groups // 64)
        level += 1

    return _places(kept, keys)


def _places(kept: DataFrame, keys: list[str]) -> DataFrame:
    """Number the pieces of each container and add up their lengths, within the container's few rows."""
    w = Window.partitionBy("container").orderBy("__row", "piece")
    out = kept.withColumn("slot", F.row_number().over(w) - 1)
    out = out.withColumn("start", F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_tokens"))
    names = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]
    return out.select(*names, F.col("piece").cast("int").alias("piece"), "first_token", "n_tokens", "container", "slot", "start")


def pack_documents(df: DataFrame, text: str = "text", keys: list[str] | None = None, capacity: int = 2048, max_segments: int | None = None, max_loss: int | None = None, ranks_path: str = DEFAULT_RANKS) -> DataFrame:
    """:func:`pack` of the texts by their number of tokens. Texts are read once; their sizes are written and reused."""
    keys = keys or ["doc_id"]
    sizes = materialize(count_tokens(df, text, keys, "__tokens", ranks_path), "pack-sizes")
    return pack(sizes, "__tokens", keys, capacity, max_segments, max_loss)
