"""Implausible readings, by a hidden Markov model per source.

States: normal, spike, stuck and out of range. What a reading shows is (1) its residual, how far it lies beyond the
medians of the readings before and after it, on the scale of its source; (2) whether it repeats the value before; (3)
whether it breaks a physical bound, which forces the state. The source's normal behaviour sets the scale (a high
quantile of its own residuals, so noise, swing and regular switching all widen it) and the chance of a repeat (from
its short runs). Forward-backward probabilities then decide on each reading.

The readings are ordered by source and time over range partitions, so a source with a third of them, or one reading
that was delivered that often, is spread over many. Each partition cuts its readings into chunks of at most ``CHUNK``
distinct ones, however they lie in time, and a chunk is one row. What crosses a partition's border (the readings beside
it, the messages) is worked out on the driver from a bounded piece per partition. The forward and backward messages that
enter a chunk are products of 4 x 4 transfer matrices in two levels: over a partition's chunks in a task, over the
partitions on the driver. So the recursion is exact however long a source is, and no task holds a whole source.

Defined results: rows without source or time and null or NaN values are no readings and never flagged; readings of one
source with the same time and value are one reading and are flagged together; a source with few readings is judged by
the bounds alone until its scale is known (``MIN_READINGS``); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions.timeutil import epoch_micros
from searchloom.lookup import is_small, lookup_join
from searchloom.scratch import materialize

#: Readings of a chunk at most, readings on either side that a residual looks at.
CHUNK, SIDE = 4096, 7
#: A pause of more than so many usual distances cuts the series.
PAUSE = 8.0
#: Below absolute zero, and above what any contact thermometer reads.
LOWEST, HIGHEST = -273.15, 2000.0
#: The share of residuals within the scale, and the readings that a source needs for one.
WITHIN, MIN_READINGS = 0.95, 20
#: Bins of the residual histogram per factor of two, and its smallest residual as a power of two.
FINE, SMALLEST = 24, -14
#: Runs shorter than this tell how often a source repeats a value; longer ones than ``PLAIN_RUN`` don't tell what is normal beside them.
SHORT_RUN, PLAIN_RUN = 8, 5
#: Log odds of a spike, of being stuck; the chance that a spike or stuck state goes on.
SPIKE_ODDS, STUCK_ODDS, SPIKE_STAYS, STUCK_STAYS = -9.0, -15.0, 0.035, 0.97

NORMAL, SPIKE, STUCK, BEYOND = range(4)


def _median_beside(v: np.ndarray, segment: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Medians of the up to ``side`` readings before and after each one in its segment; NaN where there is none."""
    n = len(v)
    pad = np.full(side, np.nan)
    padded = np.concatenate([pad, v, pad])
    seg = np.concatenate([np.full(side, -1), segment, np.full(side, -2)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, side)
    segs = np.lib.stride_tricks.sliding_window_view(seg, side)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", RuntimeWarning)  # windows of nothing but NaN
        before = np.nanmedian(np.where(segs[:n] == segment[:, None], windows[:n], np.nan), axis=1)
        after = np.nanmedian(np.where(segs[side + 1 : side + 1 + n] == segment[:, None], windows[side + 1 : side + 1 + n], np.nan), axis=1)
    return before, after


def residuals(us: np.ndarray, v: np.ndarray, hard: np.ndarray, side: int = SIDE) -> tuple[np.ndarray, np.ndarray]:
    """Residual of each reading, NaN if there are no readings on one side at all, and whether it repeats the one before.

    The residual is the smaller of the distances to the two medians, and 0 if the reading lies between them: a rise, a
    fall and a step to a new level have one side that agrees.
    """
    n = len(us)
    gaps = np.diff(us)
    usual = np.median(gaps) if n > 1 else 0
    segment = np.concatenate([[0], np.cumsum(gaps > PAUSE * max(usual, 1))]) if n else np.zeros(0, dtype=np.int64)
    same = np.concatenate([[False], v[1:] == v[:-1]]) if n else np.zeros(0, dtype=bool)
    run = np.cumsum(~same)
    frozen = np.bincount(run)[run] > PLAIN_RUN if n else same
    clean = np.where(hard, np.nan, v)
    before, after = _median_beside(np.where(frozen, np.nan, clean), segment, side)
    alone = np.isnan(before) | np.isnan(after)
    if alone.any():  # beside a pause: compare across it, at half the weight
        far_before, far_after = _median_beside(np.where(frozen, np.nan, clean), np.zeros(n, dtype=np.int64), side)
        before, after = np.where(np.isnan(before), far_before, before), np.where(np.isnan(after), far_after, after)
    a, b = clean - before, clean - after
    r = np.where(a * b <= 0, 0.0, np.minimum(np.abs(a), np.abs(b))) * np.where(alone, 0.5, 1.0)
    r[np.isnan(a) | np.isnan(b)] = np.nan
    return r, same


def emissions(r: np.ndarray, same: np.ndarray, hard: np.ndarray, scale: float, repeat: float) -> np.ndarray:
    """Log likelihood of each reading in each state, relative to the normal one.

    Normal residuals fall off exponentially, so that a share ``WITHIN`` lies within the scale; residuals of spikes are
    even on the logarithm. A stuck reading repeats, whatever its residual; a spike repeats no more than a normal one.
    """
    n = len(r)
    out = np.zeros((n, 4))
    rate = -np.log(1 - WITHIN) / scale if scale > 0 else np.inf
    x = np.nan_to_num(r, nan=0.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        normal = np.log(rate) - rate * x if np.isfinite(rate) else np.zeros(n)
        spike = -np.log(np.maximum(x, scale) * np.log(1e6)) if scale > 0 else np.full(n, -np.inf)
    out[:, SPIKE] = np.where(np.isnan(r) | ~np.isfinite(rate), -np.inf, spike - normal)
    out[:, STUCK] = np.where(same, -np.log(min(max(repeat, 1e-3), 1 - 1e-6)), -np.inf)
    out[:, BEYOND] = -np.inf
    out[hard] = [-np.inf, -np.inf, -np.inf, 0.0]
    stuck_hard = hard & same
    out[stuck_hard, STUCK] = -np.log(min(max(repeat, 1e-3), 1 - 1e-6))
    return out


def transitions() -> np.ndarray:
    """Log transition probabilities. Spikes lead back to normal; a stuck run may end in any state."""
    spike, stuck = np.exp(SPIKE_ODDS), np.exp(STUCK_ODDS)
    beyond = 1e-3
    t = np.zeros((4, 4))
    t[NORMAL] = [1 - spike - stuck - beyond, spike, stuck, beyond]
    t[SPIKE] = [1 - SPIKE_STAYS - stuck - beyond, SPIKE_STAYS, stuck, beyond]
    t[STUCK] = [(1 - STUCK_STAYS) * 0.98, (1 - STUCK_STAYS) * 0.01, STUCK_STAYS, (1 - STUCK_STAYS) * 0.01]
    t[BEYOND] = [1 - 0.5 - spike - stuck, spike, stuck, 0.5]
    return t


#: Readings that are multiplied one after the other; that many such rows are multiplied side by side.
ROW = 64


def _steps(e: np.ndarray) -> np.ndarray:
    """Step matrices (transition, then emission) in rows of ``ROW``; the last row is filled up with identities."""
    n = len(e)
    p = np.exp(e - e.max(axis=1, keepdims=True))
    m = np.empty((-(-n // ROW) * ROW, 4, 4))
    m[:n] = transitions()[None] * p[:, None, :]
    m[n:] = np.eye(4)
    return m.reshape(-1, ROW, 4, 4)


def _unit(x: np.ndarray, axes) -> np.ndarray:
    top = x.max(axis=axes, keepdims=True)
    return x / np.where(top > 0, top, 1.0)


def _prefixes(m: np.ndarray) -> np.ndarray:
    """Products of each row's first, first two, ... step matrices, each scaled to a largest entry of 1."""
    p = np.empty_like(m)
    p[:, 0] = _unit(m[:, 0], (1, 2))
    for j in range(1, ROW):
        p[:, j] = _unit(p[:, j - 1] @ m[:, j], (1, 2))
    return p


def transfer(e: np.ndarray) -> np.ndarray:
    """Product of a chunk's step matrices, scaled to a largest entry of 1."""
    out = np.eye(4)
    for whole in _prefixes(_steps(e))[:, -1]:
        out = _unit(out @ whole, (0, 1))
    return out


def posterior(e: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Forward-backward probabilities of a chunk, given the messages that enter at its two ends."""
    m = _steps(e)
    rows = len(m)
    p = _prefixes(m)
    q = np.empty_like(m)  # products of the steps after each one in its row
    q[:, -1] = np.eye(4)
    for j in range(ROW - 2, -1, -1):
        q[:, j] = _unit(m[:, j + 1] @ q[:, j + 1], (1, 2))
    a, b = np.empty((rows, 4)), np.empty((rows, 4))
    x = alpha
    for i in range(rows):
        a[i] = x
        x = _unit(x @ p[i, -1], 0)
    x = beta
    for i in range(rows - 1, -1, -1):
        b[i] = x
        x = _unit(p[i, -1] @ x, 0)
    both = np.einsum("bi,blij->blj", a, p) * np.einsum("blij,bj->bli", q, b)
    both = both.reshape(-1, 4)[: len(e)]
    return both / np.maximum(both.sum(axis=1, keepdims=True), 1e-300)


def _histogram(r: np.ndarray) -> dict[int, int]:
    """Counts of residuals by logarithmic bin; bin -1 holds zero."""
    x = r[np.isfinite(r)]
    with np.errstate(divide="ignore"):
        bins = np.where(x > 0, np.floor((np.log2(np.maximum(x, 1e-300)) - SMALLEST) * FINE), -1)
    bins = np.clip(bins, -1, 60 * FINE).astype(int)
    kinds, counts = np.unique(bins, return_counts=True)
    return dict(zip(kinds.tolist(), counts.tolist()))


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Readings (s, us, v) in order, to chunks of at most ``most`` distinct ones with the readings on either side, as far as this partition has them.

    ``edge`` has 1 for the first and 2 for the last chunk of the partition, with 4 if the whole partition is of one source.
    """
    task = TaskContext.get()
    part, side = task.partitionId() if task else 0, SIDE + 1
    source, us, v = None, np.zeros(0, dtype=np.int64), np.zeros(0)
    before, number, runs, rows = (us, v), 0, 0, []

    def take(n: int) -> None:
        nonlocal us, v, before, number
        rows.append((source, part, number, us[:n], v[:n], *before, us[n : n + side], v[n : n + side]))
        before = (us[max(0, n - side) : n], v[max(0, n - side) : n])
        us, v, number = us[n:], v[n:], number + 1

    def made(last: bool) -> pa.RecordBatch:
        names = ["__s", "pid", "idx", "us", "v", "us_before", "v_before", "us_after", "v_after"]
        kinds = [pa.string(), pa.int32(), pa.int32(), *[pa.list_(pa.int64()), pa.list_(pa.float64())] * 3]
        edge = [(r[2] == 0) + (2 if last and i == len(rows) - 1 else 0) for i, r in enumerate(rows)]
        edge = [e + (4 if e & 2 and runs == 1 else 0) for e in edge]
        return pa.record_batch([*[pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], pa.array(edge, pa.int32())], names=[*names, "edge"])

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column(0).dictionary_encode()
        name, code = codes.dictionary, np.asarray(codes.indices)
        t, x = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        begin = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        for lo, hi in zip(begin, np.append(begin[1:], len(code))):
            s = name[int(code[lo])].as_py()
            if s != source:
                while len(us):
                    take(min(most, len(us)))
                source, before, runs = s, (np.zeros(0, dtype=np.int64), np.zeros(0)), runs + 1
            a, c = t[lo:hi], x[lo:hi]
            last = (us[-1], v[-1]) if len(us) else (before[0][-1], before[1][-1]) if len(before[0]) else (None, None)
            new = np.append((a[0], c[0]) != last, (a[1:] != a[:-1]) | (c[1:] != c[:-1]))
            us, v = np.append(us, a[new]), np.append(v, c[new])
            while len(us) >= most + side:
                take(most)
        if len(rows) > 64:  # the last one waits, as it may be the partition's last
            wait, rows = rows[-1:], rows[:-1]
            yield made(False)
            rows = wait
    while len(us):
        take(min(most, len(us)))
    if rows:
        yield made(True)


def _borders(edges: list) -> dict[int, tuple]:
    """What lies beside each partition: the readings of its first source before it, those of its last source after it, and whether its first reading is the copy of one before it.

    ``edges`` has one or two rows per partition: its first and its last chunk, cut to ``SIDE`` + 2 readings at each end.
    """
    parts: dict[int, dict] = {}
    for e in edges:
        p = parts.setdefault(e["pid"], {})
        if e["edge"] & 1:
            p["first"], p["head"] = e["__s"], list(zip(e["us_head"], e["v_head"]))
        if e["edge"] & 2:
            p["last"], p["tail"] = e["__s"], list(zip(e["us_tail"], e["v_tail"]))
            p["single"] = bool(e["edge"] & 4)
            p["length"] = e["length"] if e["idx"] == 0 else SIDE + 2  # of its last chunk, if that is all there is of the source
    side, out = SIDE + 1, {}
    source, near = None, []
    for pid in sorted(parts):
        p = parts[pid]
        before = near if source == p["first"] else []
        p["copy"] = bool(before) and before[-1] == p["head"][0]
        p["before"] = before
        tail = p["tail"]
        if p["copy"]:
            p["head"] = p["head"][1:]
            if p["single"] and p["length"] <= len(tail):
                tail = tail[1:]
        near = ([*before, *tail] if p["single"] else tail)[-side:]
        source = p["last"]
    source, near = None, []
    for pid in sorted(parts, reverse=True):
        p = parts[pid]
        after = near if source == p["last"] else []
        out[pid] = (p["before"], after, p["copy"])
        near = ([*p["head"], *after] if p["single"] else p["head"])[:side]
        source = p["first"]
    return out


def _scan(rows: list) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """The forward message that enters each partition's first source, and the backward one that enters its last, from the products of both."""
    start, alphas, betas = np.array([1.0, 0.0, 0.0, 0.0]), {}, {}
    rows = sorted(rows, key=lambda r: r["pid"])
    source, x = None, start
    for r in rows:
        first, last = (np.array(r[c]).reshape(4, 4) for c in ("m_first", "m_last"))
        alphas[r["pid"]] = x if source == r["s_first"] else start
        x = _unit((alphas[r["pid"]] if r["single"] else start) @ last, 0)
        source = r["s_last"]
    source, x = None, np.ones(4)
    for r in reversed(rows):
        first = np.array(r["m_first"]).reshape(4, 4)
        betas[r["pid"]] = x if source == r["s_last"] else np.ones(4)
        x = _unit(first @ (betas[r["pid"]] if r["single"] else np.ones(4)), 0)
        source = r["s_first"]
    return alphas, betas


def _products(pdf: pd.DataFrame) -> pd.DataFrame:
    """The products of the matrices of a partition's first and last source, in their chunks' order."""
    pdf = pdf.sort_values("idx")
    s, m = pdf["__s"].to_numpy(), np.stack(pdf["m"].to_list()).reshape(-1, 4, 4)

    def product(which: np.ndarray) -> np.ndarray:
        x = np.eye(4)
        for y in m[which]:
            x = _unit(x @ y, (0, 1))
        return x.ravel()

    return pd.DataFrame([{"pid": pdf["pid"].iloc[0], "s_first": s[0], "s_last": s[-1], "single": bool((s == s[0]).all()), "m_first": product(s == s[0]), "m_last": product(s == s[-1])}])


def implausible(readings: DataFrame, source: str = "geraet", time: str = "zeitpunkt", value: str = "temperatur_c", lowest: float = LOWEST, highest: float = HIGHEST) -> DataFrame:
    """``__s``, ``__us``, ``__v`` and ``state`` of the distinct readings whose likeliest state is not normal."""
    spark = readings.sparkSession
    v = F.col(f"`{value}`").cast("double") + F.lit(0.0)
    used = readings.select(F.col(f"`{source}`").alias("__s"), epoch_micros(readings, time).alias("__us"), v.alias("__v"))
    used = used.where("__s is not null and __us is not null and __v is not null and not isnan(__v)")
    # The last part of the key spreads the copies of one reading; it is the same when a task is repeated.
    order = ["__s", "__us", "__v"]
    sorted_rows = used.withColumn("__copy", F.spark_partition_id()).repartitionByRange(*order, "__copy").sortWithinPartitions(*order).select(*order)
    lists = "us array<bigint>, v array<double>, us_before array<bigint>, v_before array<double>, us_after array<bigint>, v_after array<double>"
    packed = materialize(sorted_rows.mapInArrow(lambda batches, most=CHUNK: _cut(batches, most), f"__s string, pid int, idx int, {lists}, edge int"), "hmm-chunks")

    ends = [F.slice(F.concat(c, f"{c}_after"), 1, SIDE + 2).alias(f"{c}_head") for c in ("us", "v")] + [F.reverse(F.slice(F.reverse(F.concat(f"{c}_before", c)), 1, SIDE + 1)).alias(f"{c}_tail") for c in ("us", "v")]
    edges = packed.where("edge > 0").select("__s", "pid", "idx", "edge", F.size("us").alias("length"), *ends).collect()  # two rows per partition
    beside = spark.sparkContext.broadcast(_borders(edges))

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        borders = beside.value
        for pdf in batches:
            out = []
            for c in pdf.to_dict("records"):
                own_us, own_v = np.asarray(c["us"], dtype=np.int64), np.asarray(c["v"], dtype=np.float64)
                b_us, b_v, a_us, a_v = (np.asarray(c[n]) for n in ("us_before", "v_before", "us_after", "v_after"))
                before, after, copy = borders[c["pid"]]
                if c["idx"] == 0:
                    b_us, b_v = np.array([t for t, _ in before], dtype=np.int64), np.array([x for _, x in before])
                    own_us, own_v = own_us[int(copy) :], own_v[int(copy) :]
                    if not len(own_us):
                        continue
                if c["edge"] & 2:
                    a_us, a_v = np.array([t for t, _ in after], dtype=np.int64), np.array([x for _, x in after])
                us, x = np.concatenate([b_us, own_us, a_us]).astype(np.int64), np.concatenate([b_v, own_v, a_v]).astype(np.float64)
                r, same = residuals(us, x, (x < lowest) | (x > highest))
                i, j = len(b_us), len(b_us) + len(own_us)
                run = np.diff(np.flatnonzero(np.concatenate([[True], ~same[i + 1 : j], [True]])))
                short = run[run < SHORT_RUN]
                last = (int(us[i - 1]), float(x[i - 1])) if i else (None, None)
                out.append((c["__s"], c["pid"], c["idx"], us[i:j], x[i:j], r[i:j], same[i:j], *last, _histogram(r[i:j]), int((short - 1).sum()), int(short.sum())))
            made = pd.DataFrame(out, columns=["__s", "pid", "idx", "us", "v", "r", "same", "us_0", "v_0", "hist", "repeats", "steps"])
            yield made.astype({"us_0": "Int64"})

    feature = packed.mapInPandas(features, "__s string, pid int, idx int, us array<bigint>, v array<double>, r array<double>, same array<boolean>, us_0 bigint, v_0 double, hist map<int,int>, repeats bigint, steps bigint")
    feature = materialize(feature, "hmm-features")

    bins = feature.select("__s", F.explode("hist").alias("b", "n")).groupBy("__s", "b").agg(F.sum("n").alias("n"))
    wb = Window.partitionBy("__s")  # a source has at most 61 x FINE bins
    bins = bins.withColumn("below", F.sum("n").over(wb.orderBy("b"))).withColumn("all", F.sum("n").over(wb))
    top = bins.where(F.col("below") >= F.col("all") * WITHIN).groupBy("__s").agg(F.min("b").alias("b"), F.first("all").alias("n"))
    usual = feature.groupBy("__s").agg(((F.sum("repeats") + 0.5) / (F.sum("steps") + 1.0)).alias("repeat"))
    tops = F.when(F.col("n") < MIN_READINGS, 0.0).otherwise(F.pow(F.lit(2.0), (F.greatest("b", F.lit(0)) + 1) / FINE + SMALLEST))
    behaviour = usual.join(top, "__s", "left").select("__s", "repeat", F.coalesce(tops, F.lit(0.0)).alias("scale"), (F.coalesce("n", F.lit(0)) >= MIN_READINGS).alias("known"))
    behaviour = materialize(behaviour, "hmm-behaviour")

    def arrays(row) -> np.ndarray:
        r, same, x = (np.array(row[c]) for c in ("r", "same", "v"))
        hard = (x < lowest) | (x > highest)
        e = emissions(r.astype(np.float64), same.astype(bool), hard, row["scale"], row["repeat"])
        if not row["known"]:
            e[~hard, SPIKE] = e[~hard, STUCK] = -np.inf
        return e

    def matrices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            m = [transfer(arrays(row)).ravel() for row in pdf.to_dict("records")]
            yield pd.DataFrame({"__s": pdf["__s"], "pid": pdf["pid"], "idx": pdf["idx"], "m": m})

    both = lookup_join(feature.drop("hist", "repeats", "steps"), behaviour, ["__s"])
    m = materialize(both.drop("us", "us_0", "v_0").mapInPandas(matrices, "__s string, pid int, idx int, m array<double>"), "hmm-matrices")
    products = m.groupBy("pid").applyInPandas(_products, "pid int, s_first string, s_last string, single boolean, m_first array<double>, m_last array<double>").collect()  # one row per partition
    entering = spark.sparkContext.broadcast(_scan(products))

    def messages(pdf: pd.DataFrame) -> pd.DataFrame:
        """The messages that enter each chunk of a partition."""
        pdf = pdf.sort_values("idx")
        s, m = pdf["__s"].to_numpy(), np.stack(pdf["m"].to_list()).reshape(-1, 4, 4)
        alphas, betas = entering.value
        pid, n = int(pdf["pid"].iloc[0]), len(s)
        alpha, beta = np.empty((n, 4)), np.empty((n, 4))
        x = alphas[pid]
        for i in range(n):
            alpha[i] = x if i == 0 or s[i] == s[i - 1] else (1.0, 0.0, 0.0, 0.0)
            x = _unit(alpha[i] @ m[i], 0)
        x = betas[pid]
        for i in range(n - 1, -1, -1):
            beta[i] = x if i == n - 1 or s[i] == s[i + 1] else 1.0
            x = _unit(m[i] @ beta[i], 0)
        return pd.DataFrame({"pid": pdf["pid"], "idx": pdf["idx"], "alpha": list(alpha), "beta": list(beta)})

    def decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parts = []
            for row in pdf.to_dict("records"):
                e = arrays(row)
                state = posterior(e, np.asarray(row["alpha"]), np.asarray(row["beta"])).argmax(axis=1)
                us, v = np.asarray(row["us"]), np.asarray(row["v"])
                # The reading that a stuck run repeats belongs to the run, also where it ended the chunk before.
                stuck = state == STUCK
                first = np.flatnonzero(stuck[1:] & ~stuck[:-1] & (state[:-1] == NORMAL))
                at = np.flatnonzero(state != NORMAL)
                parts.append(pd.DataFrame({"__s": row["__s"], "__us": np.concatenate([us[at], us[first]]), "__v": np.concatenate([v[at], v[first]]), "state": np.concatenate([state[at], np.full(len(first), STUCK)])}))
                if stuck[0] and not pd.isna(row["us_0"]):
                    parts.append(pd.DataFrame({"__s": [row["__s"]], "__us": [int(row["us_0"])], "__v": [row["v_0"]], "state": [STUCK]}))
            yield pd.concat(parts) if parts else pd.DataFrame({"__s": [], "__us": [], "__v": [], "state": []})

    entered = m.groupBy("pid").applyInPandas(messages, "pid int, idx int, alpha array<double>, beta array<double>")
    entered = materialize(entered, "hmm-messages")
    keys = ["pid", "idx"]  # each chunk once on either side
    whole = both.join(F.broadcast(entered) if is_small(entered) else entered, keys)
    return whole.mapInPandas(decide, "__s string, __us bigint, __v double, state int")


def flag_readings(readings: DataFrame, key: str = "mess_id", source: str = "geraet", time: str = "zeitpunkt", value: str = "temperatur_c", **bounds) -> DataFrame:
    """``key`` of every row whose reading is implausible; the copies of a reading are flagged with it."""
    bad = materialize(implausible(readings, source, time, value, **bounds).select("__s", "__us", "__v").distinct(), "hmm-flags")
    rows = readings.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{source}`").alias("__s"), epoch_micros(readings, time).alias("__us"), (F.col(f"`{value}`").cast("double") + F.lit(0.0)).alias("__v"))
    # Beyond what may be broadcast the sides are sorted; rows of one reading that are too many are split by the engine's skew join.
    return rows.join(F.broadcast(bad) if is_small(bad) else bad, ["__s", "__us", "__v"], "left_semi").select(F.col("__key").alias(key))
