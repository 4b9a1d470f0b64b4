"""String and vector similarity: token Jaccard, cosine, and the matching-blocks ratio."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType


def token_jaccard(a, b) -> Column:
    """Shared share of the distinct lower-case words of two texts; 0 where both have none."""
    x, y = (F.filter(F.array_distinct(F.split(F.lower(F.col(c) if isinstance(c, str) else c), r"\s+")), lambda w: w != "") for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / union)


def cosine(a, b) -> Column:
    """Cosine of two arrays in double precision; null for a zero vector."""
    x, y = ((F.col(c) if isinstance(c, str) else c).cast("array<double>") for c in (a, b))
    dot = lambda u, v: F.aggregate(F.zip_with(u, v, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when(norm != 0, dot(x, y) / norm)


@pandas_udf(DoubleType())
def sequence_ratio(a, b):
    """Twice the matched characters over all characters, by the longest matching blocks (no built-in does this)."""
    import pandas as pd
    from difflib import SequenceMatcher

    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")
