"""Nominal time points by kernel density, and assignment of times to them."""

from __future__ import annotations

import logging
import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions import nearest_cut
from ..sources.shared import written

log = logging.getLogger(__name__)

GRID = 512
#: Bandwidths from which a time adds nothing to a grid point: the kernel is zero in double precision.
REACH = 39


def bandwidth(n: float, sd: float | None, iqr: float, first: float) -> float:
    """0.9 times the lesser of sd and IQR / 1.34, times n to the power -0.2; where that is zero the sd, a value, or 1 stands in."""
    low = min(x for x in (sd or 0.0, iqr / 1.34))
    low = low or sd or abs(first) or 1.0
    return 0.9 * low * n ** -0.2


def quantiles(values: DataFrame, n: int, probabilities: list[float]) -> list[float]:
    """Exact quantiles, linear between order statistics, of ``t`` that stand ``n`` times in all.

    ``values`` is a row per distinct ``t`` with its count ``n``.  It is dealt by
    ranges; the driver gets a row per range, and then looks for a rank only
    within the range that has it.
    """
    placed = written(values.repartitionByRange("t").sortWithinPartitions("t").withColumn("part", F.spark_partition_id()), "ranges")
    parts = sorted((r.low, r.part, r.n) for r in placed.groupBy("part").agg(F.min("t").alias("low"), F.sum("n").alias("n")).collect())
    held: dict[int, float] = {}

    def at(rank: int) -> float:
        """The value with ``rank`` others before it."""
        before = 0
        for _, part, size in parts:
            if rank < before + size:
                if rank not in held:
                    running = F.sum("n").over(Window.partitionBy("part").orderBy("t"))
                    held[rank] = placed.where(F.col("part") == part).withColumn("upto", running).where(F.col("upto") > rank - before).agg(F.min("t")).first()[0]
                return held[rank]
            before += size
        raise ValueError(f"no rank {rank}")

    out = []
    for p in probabilities:
        place = (n - 1) * p
        low = math.floor(place)
        first = at(low)
        out.append(first if place == low else first + (place - low) * (at(low + 1) - first))
    return out


def density(times: DataFrame, column: str, adjust: float = 0.5, bw: float | None = None, grid: int = GRID) -> DataFrame:
    """``i, gx, y``: the density of the times on ``grid`` points from three bandwidths below to three above them.

    Equal times are counted first.  The sum over the grid then runs on distinct
    times, each at the points that it reaches, with partial sums, so what is
    shuffled is a row per grid point and task.  The same for any number of rows.
    """
    t = F.col(column).cast("double")
    values = written(times.where(t.isNotNull()).groupBy(t.alias("t")).agg(F.count("*").alias("n")), "times")
    stats = values.agg(F.sum("n").alias("n"), F.min("t").alias("low"), F.max("t").alias("high"), (F.sum(F.col("n") * F.col("t")) / F.sum("n")).alias("mean")).first()
    if not stats.n:
        raise ValueError("no times")
    if bw is None:
        squares = values.agg(F.sum(F.col("n") * F.pow(F.col("t") - F.lit(stats["mean"]), F.lit(2.0)))).first()[0]
        sd = math.sqrt(squares / (stats.n - 1)) if stats.n > 1 else None
        low, high = quantiles(values, stats.n, [0.25, 0.75])
        bw = bandwidth(stats.n, sd, high - low, stats.low)
    h = adjust * bw
    start, stop = stats.low - 3 * h, stats.high + 3 * h
    step = (stop - start) / (grid - 1)
    nearest = lambda side: F.least(F.greatest(F.floor((F.col("t") + F.lit(side * REACH * h) - F.lit(start)) / F.lit(step)) + F.lit(0 if side < 0 else 1), F.lit(0)), F.lit(grid - 1)).cast("int")
    points = F.transform(F.sequence(nearest(-1), nearest(1)), lambda i: F.struct(i.alias("i"), (F.lit(start) + i * F.lit(step)).alias("gx")))
    on_grid = values.select("t", "n", F.explode(points).alias("g")).select("g.i", "g.gx", "t", "n")
    z = (F.col("gx") - F.col("t")) / F.lit(h)
    weight = 1.0 / (stats.n * h * math.sqrt(2 * math.pi))
    found = on_grid.groupBy("i").agg((F.sum(F.col("n") * F.exp(-0.5 * z * z)) * F.lit(weight)).alias("y"))
    every = times.sparkSession.range(grid).select(F.col("id").cast("int").alias("i"), (F.lit(start) + F.col("id") * F.lit(step)).alias("gx"))
    return every.join(found, "i", "left").select("i", "gx", F.coalesce("y", F.lit(0.0)).alias("y"))


def peaks(curve: DataFrame) -> DataFrame:
    """Grid points where a rise (or level) turns into a fall. The curve has as many rows as the grid, so one task sorts it."""
    order = Window.orderBy("i")
    delta = curve.withColumn("delta", F.coalesce(F.lead("y").over(order) - F.col("y"), F.lit(0.0)))
    before = delta.withColumn("before", F.coalesce(F.lag("delta").over(order), F.lit(0.0)))
    return before.where("delta < 0 and before >= 0").select("i", "gx")


def get_nominal_timepoints(times: DataFrame, column: str, adjust: float = 0.5, bw: float | None = None, na_rm: bool = False) -> list[int]:
    """Whole nominal times: the floor of every peak but the last, and the ceiling of that.

    A single peak gives its floor and its ceiling.  Missing times raise unless
    ``na_rm``; so does a density without peaks.
    """
    if not na_rm and times.where(F.col(column).isNull()).limit(1).count():
        raise ValueError("missing times; pass na_rm=True to leave them out")
    found = sorted(r.gx for r in peaks(density(times, column, adjust, bw)).collect())
    if not found:
        raise ValueError("no peaks found")
    if len(found) == 1:
        return [math.floor(found[0]), math.ceil(found[0])]
    return [math.floor(x) for x in found[:-1]] + [math.ceil(found[-1])]


def match_closest(df: DataFrame, column: str, values: list[float], out: str) -> DataFrame:
    """Adds the nearest of ``values`` (ascending); at a midpoint the later one."""
    return df.withColumn(out, nearest_cut(F.col(column), sorted(values)))


def add_nominal_timepoints(df: DataFrame, time_var: str = "time", nominal_time_var: str = "NOMINAL_TIME", verbose: bool = False, **options) -> DataFrame:
    """Adds (or replaces) each row's nearest nominal time."""
    values = get_nominal_timepoints(df, time_var, **options)
    if verbose:
        log.info("nominal times: %s", ", ".join(map(str, values)))
    return match_closest(df, time_var, [float(v) for v in values], nominal_time_var)
