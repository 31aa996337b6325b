"""Distributions, moments, regression, histograms and densities."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import ship
from quillmark.sources.readers import before_parts, in_order


def distribution(rows: DataFrame, key: str, by: str = "key", digits: int | None = None) -> DataFrame:
    """(key, count, percentage), ordered by key (null first) or by count descending and key.

    The total is an aggregate of the counts, so no task sees all rows.
    """
    counts = rows.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("__total"))
    share = F.col("count") * 100.0 / F.col("__total")
    out = counts.crossJoin(F.broadcast(total)).select("key", "count", (share if digits is None else F.round(share, digits)).alias("percentage"))  # one row
    return out.orderBy("key") if by == "key" else out.orderBy(F.desc("count"), "key")


def five_numbers(rows: DataFrame, x: str) -> DataFrame:
    """Count, least, quartiles, greatest, mean and both deviations; nulls do not count.

    Distinct values are counted and put in ranges; each range knows how many
    values lie before it, so the quartiles are looked up and no task holds all values.
    """
    values = rows.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("v")).agg(F.count("*").alias("n"))
    placed = in_order(values, ["v"])
    before = before_parts(placed, __before=F.sum("n"))
    total = placed.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    inside = Window.partitionBy("__part").orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.withColumn("upto", F.sum("n").over(inside)).join(F.broadcast(before), "__part").crossJoin(F.broadcast(total))  # one row
    last = F.col("__before") + F.col("upto")

    def at(rank: Column) -> Column:
        return F.max(F.when((last - F.col("n") <= rank) & (rank < last), F.col("v")))

    parts = {n: F.lit(p) * (F.col("total") - 1) for n, p in zip(("min", "q1", "median", "q3", "max"), (0.0, 0.25, 0.5, 0.75, 1.0), strict=True)}
    found = ranked.agg(F.max("total").alias("total"), *[at(f(k)).alias(f"{n}_{s}") for n, k in parts.items() for s, f in (("low", F.floor), ("high", F.ceil))])
    agg = rows.agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.stddev_pop(x).alias("sd_pop"))
    both = agg.crossJoin(F.broadcast(found))  # one row each
    return both.select("n", *[(F.col(f"{n}_low") + (F.col(f"{n}_high") - F.col(f"{n}_low")) * (k - F.floor(k))).alias(n) for n, k in parts.items()], "mean", "sd", "sd_pop")


def head_stats(rows: DataFrame, order: str, score: str, difficulty: str, n: int = 25) -> DataFrame:
    """Mean and sample variance of score and difficulty over the first rows."""
    head = rows.orderBy(order).limit(n)
    return head.agg(F.avg(score).alias("avg_score"), F.var_samp(score).alias("score_variance"), F.avg(difficulty).alias("avg_difficulty"), F.var_samp(difficulty).alias("difficulty_variance"))


def regression(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Least squares line of y on x with r2 and the number of pairs."""
    return rows.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


MODULUS = (1 << 31) - 1
#: u below the k-th cut means a weight of at most k - 1: Poisson(1), to the last step that a u of 31 bits can tell.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(13)]


def regression_band(rows: DataFrame, x: str, y: str, key: Column, points: int = 100, resamples: int = 200, seed: int = 1, level: float = 0.95) -> DataFrame:
    """(x, fit, low, high): the line and its bootstrap band on a grid.

    Every row takes a Poisson(1) weight for each resample, drawn from a hash of
    ``key``, a whole number that tells rows apart, so equal pairs are drawn
    apart and the band does not depend on partitions.  Each task adds up the
    weighted sums of all resamples; resamples times points rows follow.
    """
    ship(rows.sparkSession)
    x_, y_ = F.col(x).cast("double"), F.col(y).cast("double")
    h = F.pmod(key.cast("long"), F.lit(MODULUS))
    pairs = rows.select(x_.alias("x"), y_.alias("y"), h.alias("h")).where("x IS NOT NULL AND y IS NOT NULL")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = np.arange(resamples, dtype=np.int64)[None, :]
        total = np.zeros((resamples, 5))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                u, v, key_ = (batch.column(i).slice(lo, 2048).to_numpy(zero_copy_only=False) for i in range(3))
                r = (key_[:, None] * 48_271 + b * 40_692 + seed * 69_621) % MODULUS
                for add in (key_[:, None], 12_345):
                    r = (r * r + add) % MODULUS
                w = np.searchsorted(POISSON, r / MODULUS, side="right").astype(float)
                total += w.T @ np.stack([np.ones(len(u)), u, v, u * u, u * v], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(resamples)), *(pa.array(total[:, i]) for i in range(5))], ["b", "w", "sx", "sy", "sxx", "sxy"])

    names = ("w", "sx", "sy", "sxx", "sxy")
    s = pairs.mapInArrow(sums, "b bigint, w double, sx double, sy double, sxx double, sxy double").groupBy("b").agg(*[F.sum(n).alias(n) for n in names])
    slope = F.try_divide(F.expr("w * sxy - sx * sy"), F.expr("w * sxx - sx * sx"))
    lines = s.select(slope.alias("m"), F.try_divide(F.col("sy") - slope * F.col("sx"), F.col("w")).alias("c"))
    span = pairs.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.regr_slope("y", "x").alias("m0"), F.regr_intercept("y", "x").alias("c0"))
    grid = spark_range(rows, points, "i").crossJoin(F.broadcast(span)).select("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("i") / max(1, points - 1)).alias("x"), "m0", "c0")
    tail = (1 - level) / 2
    each = grid.crossJoin(F.broadcast(lines)).withColumn("f", F.col("m") * F.col("x") + F.col("c"))  # points x resamples
    out = each.groupBy("i", "x", "m0", "c0").agg(F.percentile("f", F.array(F.lit(tail), F.lit(1 - tail))).alias("q"))
    return out.select("x", (F.col("m0") * F.col("x") + F.col("c0")).alias("fit"), F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def spark_range(rows: DataFrame, n: int, name: str) -> DataFrame:
    return rows.sparkSession.range(n).withColumnRenamed("id", name)


def histogram(rows: DataFrame, x: str, bins: int = 10) -> DataFrame:
    """(bin, low, high, count) of equal bins over the range, the last one closed; bins without rows are there too."""
    span = rows.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))
    at = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(bins * (F.col(x) - F.col("lo")) / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).otherwise(0)
    counts = rows.where(F.col(x).isNotNull()).crossJoin(F.broadcast(span)).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("count"))  # one row
    grid = spark_range(rows, bins, "bin").select(F.col("bin").cast("int").alias("bin")).crossJoin(F.broadcast(span))
    width = (F.col("hi") - F.col("lo")) / bins
    return grid.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * width).alias("low"), (F.col("lo") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def kde(rows: DataFrame, x: str, points: int = 50, cut: float = 3.0) -> DataFrame:
    """(x, density): gaussian density with Scott's bandwidth on a grid of fixed size.

    A column with one value, or with one row, has no bandwidth: its grid is that
    value and its density null.  Without values there is no row.  Every task
    adds the kernels of its rows up, one sum for each point of the grid.
    """
    v = rows.select(F.col(x).cast("double").alias("v")).where("v IS NOT NULL")
    span = v.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), (F.stddev_samp("v") * F.pow(F.count("*").cast("double"), F.lit(-0.2))).alias("h"))
    span = span.select("lo", "hi", F.when(F.col("h") > 0, F.col("h")).alias("h"))
    wide = F.coalesce("h", F.lit(0.0)) * cut

    def at(i: int) -> Column:
        return (F.col("lo") - wide) + (F.col("hi") - F.col("lo") + 2 * wide) * float(i) / float(max(1, points - 1))

    def kernel(i: int) -> Column:
        return F.exp(-0.5 * F.pow((at(i) - F.col("v")) / F.col("h"), 2)) / (F.col("h") * math.sqrt(2 * math.pi))

    sums = [F.avg(kernel(i)).alias(f"d{i}") for i in range(points)]
    one = v.crossJoin(F.broadcast(span)).agg(F.max("lo").alias("lo"), F.max("hi").alias("hi"), F.max("h").alias("h"), *sums)  # one row on each side
    grid = F.array(*[F.struct(at(i).alias("x"), F.col(f"d{i}").alias("density")) for i in range(points)])
    return one.where("lo IS NOT NULL").select(F.explode(grid).alias("p")).select("p.x", "p.density")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")
