"""Means, intervals, paired tests, agreement, recovery, benchmarks, curve fits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgloom.session import staged


def mean_ci(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """N, mean and half of the 95% interval (null for under two values) of each group."""
    return df.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.when(F.count(value) >= 2, 1.96 * F.sqrt(F.var_samp(value) / F.count(value))).alias("ci"))


def improvement(base, value):
    """Per cent over a base of at least 1e-9."""
    return (value - base) / F.greatest(base, F.lit(1e-9)) * 100


def cumulated(by: DataFrame, order: list[str], count: str) -> DataFrame:
    """by with before, the sum of count over the rows before it in the order; no task holds more than a range of rows.

    Rows are dealt by ranges of the order and kept in the shared folder with their range; sums of ranges (a row a range)
    are cumulated, and within a range the rows are.
    """
    spark = by.sparkSession
    dealt = staged(spark, by.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("_part").agg(F.sum(count).alias("_sum"), F.min(F.struct(*order)).alias("_first"))
    parts = parts.withColumn("_offset", F.coalesce(F.sum("_sum").over(Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(F.broadcast(parts.select("_part", "_offset")), "_part").withColumn("before", F.col("_offset") + F.coalesce(F.sum(count).over(inside), F.lit(0))).drop("_part", "_offset")


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """Ranks from 1, ties sharing their mean. Equal values are counted, counts are cumulated by ranges, and joined back."""
    by = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t"))
    by = cumulated(by, [*keys, value], "_t")
    if keys:
        start = by.groupBy(*keys).agg(F.min("before").alias("_start"))
        by = by.join(start, keys)
    else:
        by = by.withColumn("_start", F.lit(0))
    by = by.withColumn(out, F.col("before") - F.col("_start") + (F.col("_t") + 1) / 2.0)
    return df.join(by.select(*keys, value, out), [*keys, value])


def paired_effect(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """n_eff, w_pos, w_neg and rank-biserial effect of b over a; zero differences are left out."""
    d = df.select(*keys, F.round(F.col(b) - F.col(a), 9).alias("d")).where("d != 0").withColumn("size", F.abs("d"))
    r = average_ranks(d, keys, "size")
    pos, neg = F.sum(F.when(F.col("d") > 0, F.col("rank")).otherwise(0.0)), F.sum(F.when(F.col("d") < 0, F.col("rank")).otherwise(0.0))
    n = F.count(F.lit(1))
    return r.groupBy(*keys).agg(n.alias("n_eff"), pos.alias("w_pos"), neg.alias("w_neg"), ((pos - neg) / (n * (n + 1) / 2)).alias("r_rb"))


def wilcoxon_p(n: int, w: float, ties: list[int] = ()) -> float | None:
    """Two-sided p of a signed-rank sum by the normal approximation with tie correction; null for no differences."""
    if not n:
        return None
    sd = math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - sum(t**3 - t for t in ties) / 48)
    return None if not sd else math.erfc(abs(w - n * (n + 1) / 4) / sd / math.sqrt(2))


def krippendorff(df: DataFrame, item: str, rater: str, value: str) -> DataFrame:
    """(alpha): interval agreement over items that all raters rated; null where it is undefined.

    The pooled differences of an item with m ratings are 2 (m sum of squares - square of the sum).
    """
    raters = df.agg(F.countDistinct(rater).alias("m"))
    items = df.groupBy(item).agg(F.count(value).alias("k"), F.sum(F.col(value).cast("double")).alias("s"), F.sum(F.col(value).cast("double") * F.col(value)).alias("q"))
    whole = items.crossJoin(F.broadcast(raters)).where("k = m and m > 1")
    t = whole.agg(F.count(F.lit(1)).alias("items"), F.max("m").alias("m"), F.sum(2 * (F.col("m") * F.col("q") - F.col("s") * F.col("s"))).alias("d"), F.sum("q").alias("q"), F.sum("s").alias("s"), F.sum("k").alias("n"))
    observed = F.col("d") / (F.col("items") * F.col("m") * (F.col("m") - 1))
    variance = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    expected = 2.0 * F.col("n") * variance / (F.col("n") - 1)
    return t.select(F.when(expected > 0, 1 - observed / expected).alias("alpha"))


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """(rho) of two columns by average ranks; key tells rows apart."""
    x, y = average_ranks(df.select(key, a), [], a, "ra").select(key, "ra"), average_ranks(df.select(key, b), [], b, "rb").select(key, "rb")
    return x.join(y, key).agg(F.corr("ra", "rb").alias("rho"))


def wilson(k, n, z: float = 1.96) -> dict:
    """P, low and high of the score interval; zeros for no trials."""
    p = k / n
    d = 1 + z * z / n
    centre = (p + z * z / (2 * n)) / d
    half = (z / d) * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    ok = lambda c: F.when(n > 0, c).otherwise(0.0)
    return {"p": ok(p), "low": ok(F.greatest(F.lit(0.0), centre - half)), "high": ok(F.least(F.lit(1.0), centre + half))}


def fidelity(df: DataFrame, stratum: str, label: str) -> DataFrame:
    """Per stratum the labels' counts, strict and lenient fidelity."""
    c = lambda v: F.sum(F.when(F.col(label) == v, 1).otherwise(0))
    n = F.count(F.lit(1))
    return df.groupBy(stratum).agg(n.alias("n"), c("correct").alias("correct"), c("partial").alias("partial"), c("incorrect").alias("incorrect"), (c("correct") / n).alias("strict"), ((c("correct") + c("partial")) / n).alias("lenient"))


def kappa(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of two raters' labels; kappa is null where chance agreement is 1."""
    cells = df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    rows, cols = cells.groupBy(F.col("a").alias("v")).agg(F.sum("n").alias("x")), cells.groupBy(F.col("b").alias("v")).agg(F.sum("n").alias("y"))
    chance = rows.join(cols, "v").agg(F.coalesce(F.sum(F.col("x").cast("double") * F.col("y")), F.lit(0.0)).alias("c"))
    t = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    pe, po = F.col("c") / (F.col("n").cast("double") * F.col("n")), F.col("same") / F.col("n")
    return t.crossJoin(chance).select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))


def precision_recall(df: DataFrame, gold: str, predicted: str) -> DataFrame:
    """(coverage, precision, recall, f1): predictions that are not null, and those that are right."""
    n, made = F.count(F.lit(1)), F.count(predicted)
    right = F.sum(F.when(F.col(gold) == F.col(predicted), 1).otherwise(0))
    p, r = right / made, right / n
    return df.agg((made / n).alias("coverage"), F.coalesce(F.when(made > 0, p), F.lit(0.0)).alias("precision"), r.alias("recall"), F.coalesce(F.when(right > 0, 2 * p * r / (p + r)), F.lit(0.0)).alias("f1"))


def alignment(a: DataFrame, b: DataFrame) -> DataFrame:
    """(jaccard, precision, recall) of the pairs of a against those of b."""
    one = a.distinct().withColumn("_a", F.lit(1)).join(b.distinct().withColumn("_b", F.lit(1)), a.columns, "full")
    both, na, nb = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)), F.count("_a"), F.count("_b")
    return one.agg((both / F.count(F.lit(1))).alias("jaccard"), (both / na).alias("precision"), (both / nb).alias("recall"))


def phases(df: DataFrame, run: str, phase: str, value: str, names: list[str], how: str = "sum") -> DataFrame:
    """A row a run with a column a phase; phases a run has not are 0."""
    agg = {"sum": F.sum, "max": F.max}[how]
    return df.groupBy(run).agg(*[F.coalesce(agg(F.when(F.col(phase) == n, F.col(value))), F.lit(0.0)).alias(n) for n in names])


def bucketed(df: DataFrame, run: str, phase: str, value: str, buckets: dict[str, str]) -> DataFrame:
    """Mean and sample deviation over runs of the sums of phases whose name holds a bucket's text; never below 0."""
    per = df.groupBy(run).agg(*[F.greatest(F.coalesce(F.sum(F.when(F.col(phase).contains(text), F.col(value))), F.lit(0.0)), F.lit(0.0)).alias(name) for name, text in buckets.items()])
    return per.agg(*[x for n in buckets for x in (F.avg(n).alias(f"{n}_mean"), F.stddev_samp(n).alias(f"{n}_std"))])


def quantiles(df: DataFrame, keys: list[str], value: str, wanted: dict[str, float]) -> DataFrame:
    """(keys.., a column for each wanted share): exact quantiles with linear interpolation, over values that are not null.

    Equal values are counted, counts cumulated by ranges, and each quantile is read off the one or two values around its
    place, so that no task or buffer holds a group's values. Null keys are left out.
    """
    by = cumulated(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_t")), [*keys, value], "_t")
    whole = by.groupBy(*keys).agg(F.min("before").alias("_start"), F.sum("_t").alias("_n"))
    at = by.join(whole, keys).withColumn("_from", F.col("before") - F.col("_start"))
    out = []
    for name, share in wanted.items():
        place = F.lit(float(share)) * (F.col("_n") - 1)
        low = F.floor(place)
        holds = lambda k: (F.col("_from") <= k) & (k < F.col("_from") + F.col("_t"))
        a, b, part = F.max(F.when(holds(low), F.col(value))), F.max(F.when(holds(F.ceil(place)), F.col(value))), F.max(place - low)
        out.append((a + (b - a) * part).alias(name))
    return at.groupBy(*keys).agg(*out)


def merged_stats(mean: DataFrame, std: DataFrame, key: str) -> DataFrame:
    """(key, category, value, std) of two wide tables with a row a key and a column a category; categories of both only."""
    names = [c for c in mean.columns if c != key and c in std.columns]
    long = lambda df, out: df.unpivot([key], names, "category", out)
    return long(mean.select(key, *names), "value").join(long(std.select(key, *names), "std"), [key, "category"])


def trimmed(df: DataFrame, key: str, value: str, width: float = 1.5) -> DataFrame:
    """N, mean and sample deviation of a group's values within 1.5 interquartile ranges (linear quartiles)."""
    q = quantiles(df, [key], value, {"q1": 0.25, "q3": 0.75})
    i = F.col("q3") - F.col("q1")
    kept = df.join(q, key).where((F.col(value) >= F.col("q1") - width * i) & (F.col(value) <= F.col("q3") + width * i))
    return kept.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))


def curve_fits(x: list[float], y: list[float]) -> list[tuple[str, float, list[float]]]:
    """(name, R squared, coefficients) of the three best of logarithmic, linear, n log n and quadratic fits.

    For benchmark tables of a few points, on the driver.
    """
    x_, y_ = np.asarray(x, float), np.asarray(y, float)
    terms = {"log": [np.log(x_)], "linear": [x_], "nlogn": [x_ * np.log(x_)], "quadratic": [x_ * x_, x_]}
    out = []
    for name, columns in terms.items():
        m = np.stack([*columns, np.ones_like(x_)], axis=1)
        w, *_ = np.linalg.lstsq(m, y_, rcond=None)
        total = ((y_ - y_.mean()) ** 2).sum()
        out.append((name, float(1 - ((y_ - m @ w) ** 2).sum() / total) if total else 1.0, w.tolist()))
    return sorted(out, key=lambda r: -r[1])[:3]
