"""Examples, per-case bundles, scores of judges, sweeps and paired comparisons."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.operators import audit, dedup, retrieve, stats


def judge_score(c) -> Column:
    """The whole number after "Score:", null where an answer has none. Numbers beyond a long are the greatest long."""
    n = F.regexp_replace(F.regexp_extract(F.col(c) if isinstance(c, str) else c, r"Score: (\d+)", 1), r"^0+(?=\d)", "")
    return F.when(n != "", F.coalesce(n.try_cast("long"), F.lit((1 << 63) - 1)))


def prioritised(t: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct triples with rank, those whose ends are the two keywords exactly first, then by their text."""
    from pyspark.sql import Window

    exact = (F.lower("s").isin(a.lower(), b.lower()) & F.lower("o").isin(a.lower(), b.lower())).cast("int")
    w = Window.orderBy(F.desc("exact"), "s", "p", "o")
    # a case's bridges: a report of one pair of keywords
    return t.select("s", "p", "o").distinct().withColumn("exact", exact).withColumn("rank", F.row_number().over(w))


def case(enriched: DataFrame, baseline: DataFrame, keywords: list[str], most_bridges: int = 10, most: int = 30) -> dict[str, DataFrame]:
    """Subgraphs, bridges, what the enriched graph adds, metrics and contexts of one test case."""
    sub = {"enriched": retrieve.subgraph(enriched, keywords), "baseline": retrieve.subgraph(baseline, keywords)}
    out = {f"subgraph_{k}": v for k, v in sub.items()}
    for k, g in (("enriched", enriched), ("baseline", baseline)):
        found = retrieve.bridges(g, keywords).select("s", "p", "o").distinct()
        out |= {f"bridges_{k}": found, f"metrics_{k}": retrieve.keyword_metrics(sub[k], keywords), f"context_{k}": retrieve.context(sub[k], found, keywords, most_bridges, most)}
    out["added"] = sub["enriched"].subtract(sub["baseline"])
    return out


def sweep(enriched: DataFrame, found: DataFrame, keywords: list[str], budgets: list[int], most_bridges: int = 10) -> dict[int, DataFrame]:
    """A context for each budget."""
    return {b: retrieve.context(enriched, found, keywords, most_bridges, b) for b in budgets}


def first_rows(df: DataFrame, key: str, order: str, defaults: dict[str, float]) -> DataFrame:
    """The first row of each key; missing numbers get their default."""
    return dedup.first_wins(df, [key], [order]).fillna(defaults)


def compared(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Means, intervals, improvement and effect of b over a for each group; keys may be empty."""
    one = df.withColumn("_all", F.lit(1))
    k = keys or ["_all"]
    x, y = stats.mean_ci(one, k, a).withColumnRenamed("mean", "mean_a").withColumnRenamed("ci", "ci_a"), stats.mean_ci(one, k, b).select(*k, F.col("mean").alias("mean_b"), F.col("ci").alias("ci_b"))
    out = x.join(y, k).join(stats.paired_effect(one, k, a, b), k, "left").withColumn("improvement", stats.improvement(F.col("mean_a"), F.col("mean_b")))
    return out if keys else out.drop("_all")


def averaged(df: DataFrame, item: str, a: str, b: str) -> DataFrame:
    """(item, a, b) means over models or judges, for tests over items."""
    return df.groupBy(item).agg(F.avg(a).alias(a), F.avg(b).alias(b))


def arms(df: DataFrame, arm: str, item: str, baseline: str, value: str) -> tuple[DataFrame, DataFrame]:
    """Means of each arm, and items whose baseline differs between arms at six digits (none, if runs agree)."""
    means = df.groupBy(arm).agg(F.avg(baseline).alias("baseline"), F.avg(value).alias("value"), F.count(F.lit(1)).alias("n"))
    bad = df.groupBy(item).agg(F.countDistinct(F.round(baseline, 6)).alias("values")).where("values > 1")
    return means, bad


def examples(relations: DataFrame, concepts: DataFrame) -> DataFrame:
    """(rel, start_term, end_term): one edge of each relation, least by its ends, between different terms."""
    c = concepts.select("concept", "term")
    a, b = c.select(F.col("concept").alias("start"), F.col("term").alias("start_term")), c.select(F.col("concept").alias("end"), F.col("term").alias("end_term"))
    named = relations.join(a, "start").join(b, "end").where("lower(start_term) != lower(end_term)")
    return dedup.first_wins(named, ["rel"], ["start", "end"]).select("rel", "start_term", "end_term")


def scalability(spark: SparkSession, concepts: DataFrame, urls: DataFrame, fractions: list[float], runs: int, work: Callable[[SparkSession, DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(fraction, run, concepts, seconds) of work over subsets of concepts in hash order."""
    rows = []
    for f in fractions:
        for run in range(runs):
            ids = audit.fraction_sample(concepts.select("concept").distinct(), "concept", f, str(run))
            began = time.time()
            n = work(spark, concepts.join(ids, "concept", "left_semi"), urls.join(ids, "concept", "left_semi")).count()
            rows.append((f, run, n, time.time() - began))
    return spark.createDataFrame(rows, "fraction double, run int, concepts long, seconds double")
