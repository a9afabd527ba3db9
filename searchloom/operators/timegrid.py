"""Irregular readings on a regular grid, through intervals.

Each reading holds from its time until the next reading of its source: the readings become a step function whose
intervals tile the time from the first to the last one. The intervals are intersected with the cells of the source's
grid; a cell's value is the mean of the steps in it, weighted by time, over the part for which a reading is recent
enough (``hold``), and that part is the cell's coverage.

A source's time is cut into chunks of whole cells, and chunks are what is distributed: a source with a third of all
readings is spread like any other. A small table with one row per chunk carries the last value over chunk boundaries.

Defined results: readings with a null or NaN source, time or value are not used; readings of one source at one time
count as one with their mean value; a source without a grid, or with a step below 1, gives no cells; a source with one
reading gives one cell; an empty table gives no rows; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from searchloom.functions.timeutil import epoch_micros, floor_div
from searchloom.lookup import lookup_join
from searchloom.scratch import materialize

#: Cells of one chunk, and chunks of one span; a window sorts the chunks of one span, or the spans of one source.
CHUNK_CELLS, SPAN_CHUNKS = 4096, 4096


def _steps(sources: DataFrame, source: str, step_s: str) -> DataFrame:
    """One step per source in microseconds; of several the smallest."""
    s = sources.where(F.col(f"`{source}`").isNotNull() & (F.col(f"`{step_s}`") >= 1))
    return s.groupBy(F.col(f"`{source}`").alias("__s")).agg((F.min(f"`{step_s}`").cast("bigint") * 1_000_000).alias("__step"))


def _with_next(chunks: DataFrame) -> DataFrame:
    """``__next``: the source's next chunk. It is looked for within a span of chunks first, then among the first ones of the source's spans."""
    chunks = chunks.withColumn("__span", floor_div(F.col("__chunk"), F.lit(SPAN_CHUNKS).cast("bigint")))
    spans = chunks.groupBy("__s", "__span").agg(F.min("__chunk").alias("__first"))
    spans = spans.withColumn("__after", F.lead("__first").over(Window.partitionBy("__s").orderBy("__span"))).drop("__first")
    within = F.lead("__chunk").over(Window.partitionBy("__s", "__span").orderBy("__chunk"))
    chunks = chunks.withColumn("__next", within).join(spans, ["__s", "__span"])
    return chunks.withColumn("__next", F.coalesce("__next", "__after")).drop("__span", "__after")


def regular_grid(readings: DataFrame, sources: DataFrame, source: str = "geraet", time: str = "zeitpunkt", value: str = "temperatur_c", step_s: str = "takt_s", hold_cells: float = 2.0) -> DataFrame:
    """One row per source and cell between the source's first and last reading.

    Columns: ``source``, ``slot_start`` (epoch seconds), ``n_readings`` (distinct times), ``value`` (time-weighted mean
    over the covered part, null without any), ``coverage`` (0 to 1), ``filled`` (``value``, or the last value that
    held) and ``mark``: ``measured`` with a reading in the cell, ``held`` without one but covered by an earlier one,
    ``missing`` otherwise. A reading holds for ``hold_cells`` cells at most, the last one to the end of its cell.
    """
    v = F.col(f"`{value}`").cast("double")
    used = readings.select(F.col(f"`{source}`").alias("__s"), epoch_micros(readings, time).alias("__us"), v.alias("__v"))
    used = used.where("__s is not null and __us is not null and __v is not null and not isnan(__v)")
    used = lookup_join(used, _steps(sources, source, step_s), ["__s"])
    slot = floor_div(F.col("__us"), F.col("__step"))
    points = used.groupBy("__s", "__step", "__us").agg(F.avg("__v").alias("__v"))
    points = materialize(points.withColumn("__chunk", floor_div(slot, F.lit(CHUNK_CELLS).cast("bigint"))), "grid-points")

    last = points.groupBy("__s", "__step", "__chunk").agg(F.max(F.struct("__us", "__v")).alias("__last"))
    last = _with_next(last)
    length = F.lit(CHUNK_CELLS) * F.col("__step")
    # The end of every chunk: where its last interval stops. The last chunk ends with the cell of the last reading.
    final_end = (floor_div(F.col("__last.__us"), F.col("__step")) + 1) * F.col("__step")
    ends = last.select("__s", "__step", "__chunk", F.when(F.col("__next").isNull(), final_end).otherwise((F.col("__chunk") + 1) * length).alias("__us"))
    # The value that holds when a chunk begins, for chunks with and without readings of their own.
    carried = last.where("__next is not null").withColumn("__c", F.explode(F.expr("sequence(__chunk + 1, __next)")))
    carried = carried.select("__s", "__step", F.col("__c").alias("__chunk"), (F.col("__c") * length).alias("__us"), F.col("__last.__v").alias("__v"), F.col("__last.__us").alias("__from"), F.col("__next"))
    empty_ends = carried.where("__chunk < __next").select("__s", "__step", "__chunk", ((F.col("__chunk") + 1) * length).alias("__us"))

    kind = lambda df, n: df.select("__s", "__step", "__chunk", "__us", (F.col("__v") if n < 2 else F.lit(None).cast("double")).alias("__v"), (F.col("__from") if n == 1 else F.col("__us")).alias("__from"), F.lit(n).alias("__kind"))
    # At one time: the end of a chunk never meets a reading of it; a carried value gives way to a reading at once.
    marks = kind(points, 0).unionByName(kind(carried, 1)).unionByName(kind(ends, 2)).unionByName(kind(empty_ends, 2))
    w = Window.partitionBy("__s", "__chunk").orderBy("__us", F.desc("__kind"))
    spans = marks.withColumn("__end", F.lead("__us").over(w)).where("__kind < 2 and __end > __us")

    first_cell, last_cell = floor_div(F.col("__us"), F.col("__step")), floor_div(F.col("__end") - 1, F.col("__step"))
    cells = spans.withColumn("__cell", F.explode(F.sequence(first_cell, last_cell)))
    begin = F.greatest("__us", F.col("__cell") * F.col("__step"))
    hold = (F.col("__step") * F.lit(float(hold_cells))).cast("bigint")
    stop = F.least(F.col("__end"), (F.col("__cell") + 1) * F.col("__step"), F.col("__from") + hold)
    weight = F.greatest(F.lit(0).cast("bigint"), stop - begin)
    own = (F.col("__kind") == 0) & (F.col("__cell") == first_cell)
    per = cells.select("__s", "__step", "__chunk", "__cell", "__us", "__v", weight.alias("__w"), own.cast("bigint").alias("__own"))
    grid = per.groupBy("__s", "__chunk", "__cell", "__step").agg(F.sum("__own").alias("n_readings"), F.sum(F.col("__w") * F.col("__v")).alias("__wv"), F.sum("__w").alias("__w"), F.max_by("__v", "__us").alias("__held"))
    mean = F.when(F.col("__w") > 0, F.col("__wv") / F.col("__w"))
    mark = F.when(F.col("n_readings") > 0, "measured").when(F.col("__w") > 0, "held").otherwise("missing")
    return grid.select(
        F.col("__s").alias(source),
        F.call_function("div", F.col("__cell") * F.col("__step"), F.lit(1_000_000).cast("bigint")).alias("slot_start"),
        "n_readings",
        mean.alias("value"),
        (F.col("__w") / F.col("__step")).alias("coverage"),
        F.coalesce(mean, "__held").alias("filled"),
        mark.alias("mark"),
    )


def empty_slots(grid: DataFrame, source: str = "geraet") -> DataFrame:
    """The cells without a reading of their own."""
    return grid.where("n_readings = 0").select(source, "slot_start")
