"""Queries of the general data-preparation operators over the sensor tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from searchloom.operators import sensorhmm, timegrid


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _milli(name: str):
    """Rounded to thousandths, at a point where means of decimal values don't lie."""
    return F.floor(F.col(name) * 1000 + 0.50037) / 1000


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return timegrid.regular_grid(_table(spark, sf, "sensor_export"), _table(spark, sf, "geraete"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Slots without a reading between a device's first and last."""
    return timegrid.empty_slots(_grid(spark, sf))


def p2_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The whole grid with values, coverage and marks."""
    g = _grid(spark, sf)
    return g.select("geraet", "slot_start", "n_readings", _milli("value").alias("value"), F.round("coverage", 6).alias("coverage"), _milli("filled").alias("filled"), "mark")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Readings that are a spike, stuck or physically impossible."""
    return sensorhmm.flag_readings(_table(spark, sf, "sensor_export"))


QUERIES = {f.__name__: f for f in (p2_found, p2_grid, p3_found)}

_USED = """
with u as (select s.geraet, g.takt_s::bigint * 1000000 step, epoch_us(zeitpunkt) us, avg(temperatur_c) v
           from sensor_export s join geraete g using (geraet)
           where zeitpunkt is not null and temperatur_c is not null and not isnan(temperatur_c) group by all),
"""

SQL = {
    "p2_found": _USED
    + """ d as (select geraet, step, min(us // step) a, max(us // step) b from u group by all),
     c as (select geraet, step, unnest(range(a, b + 1)) cell from d)
select c.geraet, cell * step // 1000000 slot_start from c
where not exists (select 1 from u where u.geraet = c.geraet and u.us // u.step = c.cell)""",
    "p2_grid": _USED
    + """ l as (select *, coalesce(lead(us) over (partition by geraet order by us), (us // step + 1) * step) stop from u),
     c as (select *, unnest(range(us // step, (stop - 1) // step + 1)) cell from l),
     w as (select geraet, step, cell, us, v, (us // step = cell)::bigint own,
                  greatest(0, least(stop, (cell + 1) * step, us + 2 * step) - greatest(us, cell * step)) w from c),
     g as (select geraet, step, cell, sum(own)::bigint n_readings, sum(w * v) / nullif(sum(w), 0) m, sum(w) w, arg_max(v, us) held from w group by all)
select geraet, cell * step // 1000000 slot_start, n_readings, floor(m * 1000 + 0.50037) / 1000 as value, round(w / step, 6) coverage, floor(coalesce(m, held) * 1000 + 0.50037) / 1000 filled,
       case when n_readings > 0 then 'measured' when w > 0 then 'held' else 'missing' end mark from g""",
}
