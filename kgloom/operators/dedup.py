"""First-wins union of concepts and idempotent edges, properties and URLs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row of each key, the least by order (nulls last). Null keys are a key like any other.

    Spark limits a rank to its first row within each task before the shuffle (WindowGroupLimit), so that a hot key brings
    one row a task.
    """
    w = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def union_sources(parts: list[DataFrame]) -> DataFrame:
    """Sources in order of priority, with src_rank."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("src_rank", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out


def concepts(df: DataFrame, unique_source: bool = False) -> DataFrame:
    """K1: the first row of each (term, pos, sense), and of each source too if unique_source. A null sense is the empty one.

    df has src_rank and seq (its order within a source).
    """
    df = df.withColumn("sense", F.coalesce("sense", F.lit("")))
    return first_wins(df, ["term", "pos", "sense", *(["source"] if unique_source else [])], ["src_rank", "seq"])


def relations(df: DataFrame, unique_source: bool = False) -> DataFrame:
    """K2: the first row of each (start, end, type, weight); edges of a concept to itself are dropped."""
    df = df.where(F.col("start") != F.col("end"))
    return first_wins(df, ["start", "end", "rel", "weight", *(["source"] if unique_source else [])], ["src_rank", "seq"])


def properties(df: DataFrame, unique_source: bool = False) -> DataFrame:
    """K2: the first row of each (concept, type, value)."""
    return first_wins(df, ["concept", "type", "value", *(["source"] if unique_source else [])], ["src_rank", "seq"])


def urls(df: DataFrame, unique_source: bool = False) -> DataFrame:
    """K2: the first row of each (concept, url)."""
    return first_wins(df, ["concept", "url", *(["source"] if unique_source else [])], ["src_rank", "seq"])


def sorted_first(df: DataFrame, key: list[str]) -> DataFrame:
    """K3: of rows in a flushed set, the least by all columns wins its conflict key."""
    return first_wins(df, key, df.columns)


def without_sources(df: DataFrame, sources: list[str]) -> DataFrame:
    """K4: rows of other sources; rows without a source stay."""
    return df.where(F.col("source").isNull() | ~F.col("source").isin(sources))
