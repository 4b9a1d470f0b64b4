"""A bounded, repeatable sample of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.llm.common import unused
from kgloom.session import small


def draw(drawn: list[str]) -> Column:
    """A number from 0 to 1 by a hash of the drawn columns."""
    return F.pmod(F.xxhash64(*drawn), F.lit(1 << 30)) / float(1 << 30)


def class_counts(rows: DataFrame, label: str, drawn: list[str]) -> DataFrame:
    """(label, n, least): all rows of each class, and the least number that one of them draws."""
    return rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"), F.min(draw(drawn)).alias("least"))


def in_sample(rows: DataFrame, label: str, counts: DataFrame, per_class: int, drawn: list[str]) -> tuple[DataFrame, Column]:
    """(rows, whether a row is in the sample of about per_class rows of its class).

    A row is in it if it draws less than its class's share, or the least of its class, so that every class is there. The
    draw needs no order and is repeatable. Counting covers all rows; only the sample is bounded, by per_class times the number
    of classes (with the spread of a hash draw). Rows that are alike in the drawn columns are in it together.
    """
    n, least = unused("n", rows.columns), unused("least", rows.columns)
    joined = rows.join(small(counts.select(label, F.col("n").alias(n), F.col("least").alias(least))), label)
    return joined, (draw(drawn) < F.lit(float(per_class)) / F.col(n)) | (draw(drawn) == F.col(least))
