"""The k most similar vectors of every vector, by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations and hashed to the nearest signed axis; a table's key is a sequence
of such hashes, longer where vectors are denser (:mod:`searchloom.functions.polytope`). The trees that say how long are
fitted on a bounded sample; every vector is then indexed in the cell of each of a few tables. A vector asks its own
cells and the nearest others of each table (multiprobe). A cell's vectors and queries meet in one task, where they are
compared exactly; a cell that holds more than the sample made expect is hashed further there.

Each vector is sent once per table and once per further cell that it asks, whatever the size of the table: a node of a
tree is split on at least ``LEAST`` sampled vectors on either side, so the trees stay bounded and a cell grows with the
table instead, up to ``CELL_MOST`` vectors. Beyond that, which takes over ``CELL_MOST`` x ``SAMPLE`` / (2 x ``LEAST``)
different directions or a cluster that residual hashes don't split, a cell is laid out as a grid of blocks: every query
still meets every vector of it.

Vectors of the same direction are indexed once with their smallest ids, and directions with more copies than k need no
search: their neighbours are copies. So a group of copies costs as much as one vector.

Defined results: a vector is usable if it has ``dim`` elements, all finite and not all zero; others, and rows without an
id, are no neighbours and get none. Similarity is the cosine to 12 digits; ties go to the smaller id. A repeated id counts
once; if it is stored with different vectors, the smallest of them counts. Fewer than k others give fewer neighbours; an
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from searchloom.functions.polytope import CellTree, Rotations, best_per_row, within_cell
from searchloom.lookup import lookup_join
from searchloom.scratch import materialize

#: Vectors of the sample on which the trees are fitted, at most twice as many.
SAMPLE = 50_000
#: Sampled vectors that a node needs on average on either side to be split.
LEAST = 4
#: Vectors of a cell beyond which it is laid out in blocks.
CELL_MOST = 200_000
#: Sampled vectors with which a vector is compared to bound its search.
KNOWN = 128
#: What a row carries: a vector of its cell, a query, a query of the cell from which its bound is known.
DATA, QUERY, HOME = 1, 2, 4


def _directions(dim: int, kind: str):
    """Arrow batches of (id, vector) to (id, x: the vector's bytes, u: the bytes of its rounded direction), usable ones only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column(0), batch.column(1)
            length = np.where(np.asarray(lists.is_valid()), np.diff(np.asarray(lists.offsets)), -1)
            rows = np.flatnonzero((length == dim) & np.asarray(ids.is_valid()))
            flat = lists.values
            at = np.asarray(lists.offsets)[rows][:, None] + np.arange(dim)
            good = np.asarray(flat.is_valid())[at].all(axis=1)
            x = np.asarray(flat.fill_null(0.0))[at].astype(kind)
            good &= np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            rows, x = rows[good], np.ascontiguousarray(x[good])
            u = np.round(unit(x), 12) + 0.0
            yield pa.record_batch([ids.take(pa.array(rows)), _fixed(x), _fixed(u)], names=["id", "x", "u"])

    return run


def unit(x: np.ndarray) -> np.ndarray:
    """The rows at length 1. They are scaled by their largest element first, so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _fixed(x: np.ndarray) -> pa.Array:
    """The rows of an array as binary values of one length."""
    n, width = len(x), x.dtype.itemsize * (x.shape[1] if x.ndim > 1 else 1)
    offsets = pa.py_buffer((np.arange(n + 1, dtype=np.int64) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _bytes(column: pa.Array, dtype, width: int) -> np.ndarray:
    """Binary values of one length as rows of an array."""
    n, item = len(column), np.dtype(dtype).itemsize * width
    if not n:
        return np.zeros((0, width), dtype=dtype)
    start = np.frombuffer(column.buffers()[1], dtype=np.int32, count=n + 1 + column.offset)[column.offset]
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[start : start + n * item].view(dtype).reshape(n, width)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches sorted by their first column, joined so that each run of equal values comes whole."""
    wait: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = np.asarray(batch.column(0))
        if wait and key[-1] == np.asarray(wait[0].column(0))[0]:
            wait.append(batch)
            continue
        cut = int(np.searchsorted(key, key[-1]))
        done = pa.Table.from_batches([*wait, batch.slice(0, cut)], schema=batch.schema)
        if done.num_rows:
            yield done.combine_chunks()
        wait = [batch.slice(cut)]
    if wait:
        yield pa.Table.from_batches(wait).combine_chunks()


def _column(t: pa.Table, name: str) -> pa.Array:
    """The column in one piece, at offset 0."""
    return pa.concat_arrays(t.column(name).chunks) if t.column(name).num_chunks else pa.array([], t.schema.field(name).type)


def nearest(df: DataFrame, vector: str = "embedding", key: str = "id", dim: int = 8, k: int = 10, min_similarity: float = -1.0, tables: int = 2, probes: int = 1, cell: int = 4096, bucket: int = 2048) -> DataFrame:
    """``{key}``, ``neighbour``, ``similarity`` and ``rank`` (from 1): up to ``k`` most similar others of every id.

    ``min_similarity`` leaves out pairs below it before anything is shuffled, and cells that can't hold such a pair.
    ``tables``, ``probes`` (further cells that a query looks into per table), ``cell`` (vectors expected in a cell) and
    ``bucket`` (half the vectors that are all compared within a cell) trade time for recall.
    """
    if dim < 1 or k < 1:
        raise ValueError("dim and k must be at least 1")
    single = isinstance(df.schema[vector].dataType.elementType, T.FloatType)
    kind = "float32" if single else "float64"
    given = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<float>" if single else "array<double>").alias("v"))
    rows = given.mapInArrow(_directions(dim, kind), "id bigint, x binary, u binary")
    rows = rows.groupBy("id").agg(F.min(F.struct("u", "x")).alias("m")).select("id", "m.x", F.unhex(F.md5("m.u")).alias("u"))
    rows = materialize(rows, "knn-rows")
    # The k + 1 smallest ids of each direction; each part of the table cuts its copies to those before they meet.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("id"))).where(F.col("r") <= k + 1)
    index = few.groupBy("u").agg(F.min(F.struct("id", "x")).alias("m"), F.sort_array(F.collect_list("id")).alias("ids"))
    index = index.select(F.col("m.id").alias("v"), F.col("m.x").alias("x"), F.when(F.size("ids") > 1, F.col("ids")).alias("ids"), "u")
    index = materialize(index, "knn-index")
    crowded = F.coalesce(F.size("ids") > k, F.lit(False))
    copies = lookup_join(rows.select("id", "u"), index.where(crowded).select("u", "ids"), ["u"])
    copies = copies.select(F.col("id").alias(key), F.posexplode(F.slice(F.expr("filter(ids, e -> e != id)"), 1, k)).alias("p", "neighbour"))
    copies = copies.select(key, "neighbour", F.lit(1.0).alias("similarity"), (F.col("p") + 1).cast("int").alias("rank"))
    n = index.count()
    if n == 0:
        return copies
    found = _search(index.select("v", "x", "ids", (~crowded).alias("asks")), n, dim, kind, k, min_similarity, tables, probes, cell, bucket)
    return found.toDF(key, "neighbour", "similarity", "rank").unionByName(copies).where(F.col("similarity") >= min_similarity)


def _search(index: DataFrame, n: int, dim: int, kind: str, k: int, floor: float, tables: int, probes: int, cell: int, bucket: int) -> DataFrame:
    """The lists of all ids of the directions that ask."""
    spark = index.sparkSession
    share = min(1.0, 1.2 * SAMPLE / n)
    taken = index.select("v", "x") if share == 1.0 else index.where(F.pmod(F.xxhash64("v"), F.lit(1 << 31)) < int(share * (1 << 31))).select("v", "x")
    sample = taken.limit(2 * SAMPLE).toArrow()
    sample_id = np.asarray(_column(sample, "v"))
    sample_x = unit(_bytes(_column(sample, "x"), kind, dim))
    scale = n / max(1, len(sample_x))
    trees = [CellTree(sample_x, Rotations(dim, 7 + t), scale, cell, LEAST) for t in range(tables)]
    # The first table's tree, split further: what the sample knows of a vector's neighbours lies in its cell of that table.
    known = CellTree(sample_x, Rotations(dim, 7), scale, min(cell, KNOWN * scale), LEAST)
    # Bounded by the sample: its vectors, and tables + 1 trees of at most MAX_DEPTH x sample / (2 x LEAST) nodes.
    shared = spark.sparkContext.broadcast((trees, known, sample_x, sample_id))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, known, sample_x, sample_id = shared.value
        for batch in batches:
            v, asks = np.asarray(batch.column(0)), np.asarray(batch.column(3).to_numpy(zero_copy_only=False), dtype=bool)
            raw = _bytes(batch.column(1), kind, dim)
            x = unit(raw)
            # The k-th best of the sample bounds what can be among the k best at all.
            bound = np.full(len(x), max(floor, -1.5))
            q, _, s = within_cell(sample_x, sample_id, x, v, k, bound, 0, KNOWN, 0, known)
            count = np.bincount(q, minlength=len(x))
            full = np.flatnonzero(count == k)
            bound[full] = np.maximum(bound[full], s[np.cumsum(count)[full] - 1])
            reach = np.sqrt(np.maximum(2.0 - 2.0 * bound, 0.0)) + 1e-6
            parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # group, row, what for
            for t, tree in enumerate(trees):
                rows, cells, own = tree.probe(x, probes, reach)
                use = np.where(own, DATA, 0) + np.where(asks[rows], QUERY + (HOME if t == 0 else 0) * own, 0)
                blocks = _blocks(tree, cells)
                if (blocks == 1).all():
                    parts.append((cells * tables + t, rows, use))
                    continue
                # In a grid of blocks a vector lies in one row of blocks, a query in one column.
                for what in (DATA, QUERY):  # no cell of a grid is known to hold all k, so none is home
                    at = np.flatnonzero(use & what)
                    rep = np.repeat(at, blocks[at])
                    other = np.arange(len(rep)) - np.repeat(np.cumsum(blocks[at]) - blocks[at], blocks[at])
                    mine = np.mod(v[rows[rep]] // (7 if what == QUERY else 1), blocks[rep])
                    block = other * blocks[rep] + mine if what == QUERY else mine * blocks[rep] + other
                    # One number names cell and block. Should two agree, their vectors are compared together, which changes no result.
                    parts.append(((cells[rep] * tables + t) ^ (block << 40), rows[rep], np.full(len(rep), what)))
            g, rows, use = (np.concatenate(p) for p in zip(*parts))
            use, g, rows = use[use > 0], g[use > 0], rows[use > 0]
            head = np.empty(len(rows), dtype=[("v", "<i8"), ("bound", "<f8"), ("use", "u1"), ("x", kind, dim)])
            head["v"], head["bound"], head["use"], head["x"] = v[rows], bound[rows], use, raw[rows]
            yield pa.record_batch([pa.array(g), _fixed(head), batch.column(2).take(pa.array(rows))], names=["g", "p", "ids"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = np.dtype([("v", "<i8"), ("bound", "<f8"), ("use", "u1"), ("x", kind, dim)])
        for t in _runs(batches):
            g, ids = np.asarray(_column(t, "g")), _column(t, "ids")
            p = _bytes(_column(t, "p"), packed, 1)[:, 0]
            x, copied = unit(np.ascontiguousarray(p["x"])), np.asarray(ids.is_valid())
            ends = np.flatnonzero(np.append(g[1:] != g[:-1], True)) + 1
            out = []
            for a, b in zip([0, *ends[:-1]], ends):
                data, query = a + np.flatnonzero(p["use"][a:b] & DATA), a + np.flatnonzero(p["use"][a:b] & QUERY)
                q, d, s = within_cell(x[data], p["v"][data], x[query], p["v"][query], k, p["bound"][query], 8, bucket, int(g[a]) & 0xFFFF)
                out.append((query[q], data[d], s))
                # Hashing within a large cell may miss what the bound promised; then the bound is given up.
                short = query[(np.bincount(q, minlength=len(query)) < k) & ((p["use"][query] & HOME) > 0) & (p["bound"][query] > max(floor, -1.5))]
                if len(short) and len(data) > 2 * bucket:
                    q, d, s = within_cell(x[data], p["v"][data], x[short], p["v"][short], k, np.full(len(short), max(floor, -1.5)), 8, bucket, int(g[a]) & 0xFFFF)
                    out.append((short[q], data[d], s))
                # A direction's own copies are its neighbours too; a query that has some brings them along.
                several = query[copied[query]]
                out.append((several, several, np.ones(len(several))))
            q, d, s = (np.concatenate(c) for c in zip(*out))
            d, near, times = _expand(ids, p["v"], d)
            yield _lists(np.repeat(p["v"][q], times), near, np.repeat(s, times), {int(p["v"][i]): ids[int(i)] for i in np.unique(q) if ids[int(i)].is_valid} if ids.null_count < len(ids) else {}, k + 1)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            q, lists, own = np.asarray(_column(t, "q")), _column(t, "e"), _column(t, "own")
            size = np.diff(np.frombuffer(lists.buffers()[1], dtype=np.int32, count=len(lists) + 1)) // 16 if len(lists) else np.zeros(0, dtype=np.int64)
            e = np.frombuffer(lists.buffers()[2], dtype=[("id", "<i8"), ("s", "<f8")], count=int(size.sum())) if size.sum() else np.zeros(0, dtype=[("id", "<i8"), ("s", "<f8")])
            names, first, number = np.unique(q, return_index=True, return_inverse=True)
            number = np.repeat(number, size)
            r, at, s = best_per_row(number, np.arange(len(e)), e["id"], e["s"], k + 1)
            near = e["id"][at]
            # Each id of the direction gets the list without itself.
            many, ids, times = _expand(own, q, first)
            owner = np.repeat(np.arange(len(names)), times)
            count, begin = np.bincount(r, minlength=len(names)), np.searchsorted(r, np.arange(len(names)))
            who = np.repeat(np.arange(len(ids)), count[owner])
            pos = np.arange(len(who)) - np.repeat(np.cumsum(count[owner]) - count[owner], count[owner]) + begin[owner][who]
            keep = near[pos] != ids[who]
            who, pos = who[keep], pos[keep]
            rank = np.arange(len(who)) - np.searchsorted(who, who) + 1
            keep = rank <= k
            who, pos, rank = who[keep], pos[keep], rank[keep]
            yield pa.record_batch([pa.array(ids[who]), pa.array(near[pos]), pa.array(s[pos]), pa.array(rank.astype(np.int32))], names=["id", "neighbour", "similarity", "rank"])

    routed = index.mapInArrow(route, "g bigint, p binary, ids array<bigint>")
    lists = routed.repartition("g").sortWithinPartitions("g").mapInArrow(cells, "q bigint, e binary, own array<bigint>")
    return lists.repartition("q").sortWithinPartitions("q").mapInArrow(merge, "id bigint, neighbour bigint, similarity double, rank int")


def _blocks(tree: CellTree, cells: np.ndarray) -> np.ndarray:
    """How many rows and columns of blocks a cell is laid out in."""
    large = {c: int(np.ceil(e / CELL_MOST)) for c, e in tree.expected.items() if e > CELL_MOST}
    return np.array([large.get(c, 1) for c in cells.tolist()], dtype=np.int64) if large else np.ones(len(cells), dtype=np.int64)


def _expand(ids: pa.Array, v: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows repeated once per id of their direction, those ids, and how many each row has."""
    if ids.null_count == len(ids):
        return rows, v[rows], np.ones(len(rows), dtype=np.int64)
    offsets, flat = np.asarray(ids.offsets), np.asarray(ids.values)
    length = np.where(np.asarray(ids.is_valid()), np.diff(offsets), 0)[rows]
    times = np.maximum(length, 1)
    out = np.repeat(rows, times)
    place = np.arange(len(out)) - np.repeat(np.cumsum(times) - times, times)
    near = v[out].copy()
    listed = np.repeat(length > 0, times)
    near[listed] = flat[offsets[out[listed]] + place[listed]]
    return out, near, times


def _lists(q: np.ndarray, near: np.ndarray, s: np.ndarray, own: dict, k: int) -> pa.RecordBatch:
    """One row per query: its best entries as bytes, and its own ids if it has several."""
    names, number = np.unique(q, return_inverse=True)
    r, at, s = best_per_row(number, np.arange(len(q)), near, s, k)
    e = np.empty(len(r), dtype=[("id", "<i8"), ("s", "<f8")])
    e["id"], e["s"] = near[at], s
    offsets = np.append(np.searchsorted(r, np.arange(len(names))), len(r)).astype(np.int32) * 16
    entries = pa.Array.from_buffers(pa.binary(), len(names), [None, pa.py_buffer(offsets), pa.py_buffer(e.tobytes())])
    kept = pa.array([own[int(x)].as_py() if int(x) in own else None for x in names] if own else [None] * len(names), pa.list_(pa.int64()))
    return pa.record_batch([pa.array(names), entries, kept], names=["q", "e", "own"])


def similar_pairs(df: DataFrame, vector: str = "embedding", key: str = "id", dim: int = 8, k: int = 10, min_similarity: float = 0.997, probes: int = 7, **how) -> DataFrame:
    """``{key}_a`` < ``{key}_b``: pairs of at least ``min_similarity`` of which one is among the other's k nearest.

    Only cells that can hold so similar a vector are looked into, so more probes cost little here.
    """
    near = nearest(df, vector, key, dim, k, min_similarity, probes=probes, **how)
    return near.select(F.least(key, "neighbour").alias(f"{key}_a"), F.greatest(key, "neighbour").alias(f"{key}_b")).distinct()
