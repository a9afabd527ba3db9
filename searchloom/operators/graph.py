"""Bi-temporal edges: expansion from seeds, links and their end, neighbourhoods, overview, edges found in texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions.text import standard
from searchloom.lookup import lookup_join
from searchloom.scratch import materialize

MAX_EDGES = 100_000


def alive(as_of: str | None) -> Column:
    """Whether an edge holds at a time; without one, whether it hasn't ended."""
    if as_of is None:
        return F.col("invalid_at").isNull()
    t = F.lit(as_of).cast("timestamp_ntz")
    return (F.col("valid_at") <= t) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def expand(edges: DataFrame, seeds: DataFrame, hops: int = 1, direction: str = "out", types: list[str] | None = None, as_of: str | None = None) -> DataFrame:
    """Edges within ``hops`` of the seeds (column ``node``), each once with the first hop that reaches it.

    Repeated edges count once; null weights are 0. All seeds and all new nodes of a hop go on. A hop's nodes are counted first: if few,
    they are broadcast and the edges are only filtered, else they are joined with a hub's edges spread.
    """
    if hops not in (1, 2) or direction not in ("out", "in", "both"):
        raise ValueError("hops must be 1 or 2 and direction out, in or both")
    live = edges.where(alive(as_of))
    if types:
        live = live.where(F.col("edge_type").isin(types))
    live = live.withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    seen = seeds.select("node").where("node is not null").distinct()
    ways = [w for w, d in ((("src", "dst"), "out"), (("dst", "src"), "in")) if direction in (d, "both")]
    ends = live.withColumn("__e", F.explode(F.array(*[F.struct(F.col(a).alias("__from"), F.col(b).alias("__to")) for a, b in ways]))).select(*live.columns, "__e.*")
    now, out = seen, None
    for hop in range(1, hops + 1):
        hit = lookup_join(ends, now.withColumnRenamed("node", "__from"), ["__from"]).drop("__from").withColumn("hop", F.lit(hop))
        out = hit if out is None else out.unionByName(hit)
        if hop < hops:
            new = hit.select(F.col("__to").alias("node")).where("node is not null").distinct()
            now = materialize(new.join(seen, "node", "left_anti"), "frontier")
    w = Window.partitionBy("edge_id").orderBy("hop", F.desc("weight"), "src", "dst", "valid_at")
    return out.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__to")


def ordered(expanded: DataFrame, limit: int = MAX_EDGES) -> DataFrame:
    """The report: nearest first, then by weight and id."""
    return expanded.orderBy("hop", F.desc("weight"), "edge_id").limit(limit)


def edge_id(src: Column, kind: Column, dst: Column, valid_at: Column) -> Column:
    """The id that an edge's parts determine."""
    return F.substring(F.sha2(F.concat_ws("\x1f", src, kind, dst, valid_at.cast("string")), 256), 1, 20)


def link(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Edges with new ones (src, dst, edge_type, weight, valid_at); one that is there already changes nothing."""
    made = new.select(edge_id(F.col("src"), F.col("edge_type"), F.col("dst"), F.col("valid_at")).alias("edge_id"), "src", "dst", "edge_type", "weight", "valid_at", F.lit(None).cast("timestamp_ntz").alias("invalid_at"))
    return edges.unionByName(made.dropDuplicates(["edge_id"]).join(edges.select("edge_id").distinct(), "edge_id", "left_anti"))


def unlink(edges: DataFrame, ids: DataFrame, at: str) -> DataFrame:
    """Edges end at a time; none is removed."""
    gone = ids.select("edge_id").distinct().withColumn("__gone", F.lit(True))
    j = edges.join(gone, "edge_id", "left")
    return j.withColumn("invalid_at", F.when(F.col("__gone") & F.col("invalid_at").isNull(), F.lit(at).cast("timestamp_ntz")).otherwise(F.col("invalid_at"))).drop("__gone")


def ego(edges: DataFrame, nodes: DataFrame, node_key: Column, seeds: DataFrame, limit: int = 1000, **how) -> DataFrame:
    """The nodes at the ends of the expanded edges, with their own columns, the nearest and heaviest first."""
    e = expand(edges, seeds, **how)
    ends = e.select(F.explode(F.array("src", "dst")).alias("node"), "hop", "weight").groupBy("node").agg(F.min("hop").alias("hop"), F.max("weight").alias("weight"))
    top = ends.orderBy("hop", F.desc("weight"), "node").limit(limit)
    return nodes.withColumn("node", node_key).join(F.broadcast(top), "node")


def overview(edges: DataFrame) -> DataFrame:
    """Edges, those alive, and nodes per type. Repeated edges count once."""
    once = edges.dropDuplicates(["edge_id"])
    ends = once.select("edge_type", F.explode(F.array("src", "dst")).alias("node"))
    n = ends.groupBy("edge_type").agg(F.count_distinct("node").alias("nodes"))
    return once.groupBy("edge_type").agg(F.count("*").alias("edges"), F.count_if(F.col("invalid_at").isNull()).alias("alive")).join(n, "edge_type")


def degrees(edges: DataFrame) -> DataFrame:
    """Out- and in-degree of every node, aggregated before the shuffle."""
    once = edges.dropDuplicates(["edge_id"])
    ends = once.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    return ends.groupBy("e.node").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def proximity(edges: DataFrame, seeds: DataFrame, hops: int = 2, **how) -> DataFrame:
    """Nodes in reach with their closeness: 1 for seeds, 0.5^hop x weight (0 to 1) for the ends of an edge, the best of all."""
    e = expand(edges, seeds, hops, **{"direction": "both"} | how)
    s = F.pow(F.lit(0.5), F.col("hop")) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("weight")))
    ends = e.select(F.explode(F.array("src", "dst")).alias("node"), s.alias("proximity")).unionByName(seeds.select("node", F.lit(1.0).alias("proximity")))
    return ends.groupBy("node").agg(F.max("proximity").alias("proximity"))


#: Patterns of links in texts, by the kind of edge.
LINKS = {"wikilink": r"\[\[([^\]|#]+)", "mdlink": r"\]\(([^)\s#]+)", "href": r"href=[\"']([^\"'#]+)", "pathcite": r"\b([\w./-]+\.[A-Za-z]{1,4}):\d+"}


def detect_links(docs: DataFrame, key: str, text: str, kinds: list[str] | None = None) -> DataFrame:
    """Targets that a text links to: ``src``, ``dst``, ``edge_type``."""
    found = F.flatten(F.array(*[F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(LINKS[k]), F.lit(1)), _target(k)) for k in kinds or LINKS]))
    return docs.select(F.col(key).alias("src"), F.explode(F.array_distinct(found)).alias("l")).select("src", "l.dst", "l.edge_type")


def _target(kind: str):
    return lambda t: F.struct(F.trim(t).alias("dst"), F.lit(kind).alias("edge_type"))


def sequence_edges(df: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """Each row to the next one of its group."""
    w = Window.partitionBy(group).orderBy(order, key)
    return df.select(F.col(key).alias("src"), F.lead(key).over(w).alias("dst")).where("dst is not null").withColumn("edge_type", F.lit("sequence"))


def shared_terms(docs: DataFrame, key: str, text: str, share: float = 0.1, most_docs: int = 64, per_doc: int = 24, least: int = 2, edges_per_doc: int | None = 5, weight: float = 0.45) -> DataFrame:
    """Documents that share the distinctive terms they repeat.

    A term joins documents if at most ``share`` of all and at most ``most_docs`` have it, so no term brings more than a fixed number
    of pairs; of a document its ``per_doc`` most repeated terms count (then the rarest), and no document has more than
    ``edges_per_doc`` partners on either side; without that budget all pairs come out.
    """
    words = docs.select(F.col(key).alias("d"), F.explode(standard(F.col(text))).alias("t")).where(F.length("t") > 2)
    toks = words.groupBy("d", "t").agg(F.count("*").alias("n"))
    n = docs.count()
    df = toks.groupBy("t").agg(F.count("*").alias("df")).where((F.col("df") >= 2) & (F.col("df") <= F.lit(min(most_docs, share * n))))
    j = toks.join(df, "t")
    r = j.withColumn("r", F.row_number().over(Window.partitionBy("d").orderBy(F.desc("n"), "df", "t"))).where(F.col("r") <= per_doc).select("d", "t")
    pairs = r.alias("a").join(r.alias("b"), "t").where("a.d < b.d").groupBy(F.col("a.d").alias("src"), F.col("b.d").alias("dst")).agg(F.count("*").alias("shared")).where(F.col("shared") >= least)
    return (pairs if edges_per_doc is None else _spend(pairs, edges_per_doc)).withColumn("edge_type", F.lit("shared_term")).withColumn("weight", F.lit(weight))


def _spend(pairs: DataFrame, budget: int) -> DataFrame:
    """Pairs (src, dst, shared) such that no document is in more than ``budget`` of them.

    In each of ``budget`` rounds every document, in the order of keys, takes its strongest pair left whose other end has room too. Each choice
    depends on those before it, so one task makes them all; it gets the pairs only, as numbers.
    """
    import numpy as np
    import pandas as pd

    def spend(pdf: pd.DataFrame) -> pd.DataFrame:
        m = len(pdf)
        names = pd.concat([pdf["src"], pdf["dst"]], ignore_index=True)
        codes = pd.factorize(names, sort=True)[0]
        ends, other = codes, np.concatenate([codes[m:], codes[:m]])
        order = np.lexsort((other, -np.tile(pdf["shared"].to_numpy(), 2), ends))
        stop = np.cumsum(np.bincount(ends)).tolist()
        at, room, taken = [0, *stop[:-1]], [budget] * len(stop), np.zeros(m, dtype=bool)
        other, pair = other[order], order % m
        for _ in range(budget):
            progressed = False
            for d in range(len(stop)):
                while room[d] and at[d] < stop[d]:
                    i = at[d]
                    at[d] += 1
                    if room[other[i]] and not taken[pair[i]]:
                        room[d] -= 1
                        room[other[i]] -= 1
                        taken[pair[i]] = progressed = True
                        break
            if not progressed:
                break
        return pdf[taken]

    return pairs.groupBy(F.lit("all").alias("__all")).applyInPandas(spend, pairs.schema)
