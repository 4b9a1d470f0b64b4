"""Operator 1: text quality by a factorisation machine.

Inputs are hashed words, structure statistics and the length as metadata. All pairs of inputs interact through
low-rank factors; a score takes linear time, as the sum over pairs is half of the square of the summed factors
less the sum of their squares. Fitted on the driver from a bounded sample of labelled texts, applied in one map.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import BoundedCache, ddl, held_out, map_rows, short_batches, unused
from kgloom.llm.sampling import class_counts, in_sample
from kgloom.session import table

WORDS = 1 << 15
RANK = 8
#: Labelled texts of each class that are fitted on, about.
PER_CLASS = 2500
#: Score from which a document is of good quality.
GOOD = 0.7
STATS = ("bias", "n_chars", "upper", "digit", "symbol", "punct", "space", "newline", "non_ascii", "word_len", "distinct", "line_len", "repeated_lines", "pipe", "shout", "marks", "short", "top_word")
SIZE = WORDS + len(STATS)

_PUNCT = np.frombuffer(b".,;:'\"()-?", np.uint8)
_SYMBOL = np.array([b for b in range(33, 127) if not chr(b).isalnum() and b not in set(_PUNCT)])


def bucket(word: str) -> int:
    return xxhash.xxh32_intdigest(word.encode("utf-8", "surrogatepass")) & (WORDS - 1)


def features(text: str | None, n_chars: int | None, buckets) -> tuple[np.ndarray, np.ndarray]:
    """(inputs, values) of a whole text; defined for null and empty ones too."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    by = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    count = Counter(map(str.lower, words))
    n, k = max(len(raw), 1), max(len(words), 1)
    lines = text.split("\n")
    upper = by[65:91].sum()
    stats = (
        1.0, np.log1p(len(text) if n_chars is None else max(n_chars, 0)) / 10, upper / n, by[48:58].sum() / n, by[_SYMBOL].sum() / n, by[_PUNCT].sum() / n, (by[32] + by[9]) / n, by[10] / k,
        by[128:].sum() / n, (n - by[32] - by[9:14].sum()) / k / 10, len(count) / k, np.log1p(n / len(lines)) / 8, 1 - len(set(lines)) / len(lines), by[124] / k, upper / max(by[97:123].sum() + upper, 1),
        (by[33] + by[42] + by[36] + by[37] + by[38] + by[35]) / k, 1 / (1 + k / 8), max(count.values(), default=0) / k,
    )
    at = np.fromiter(map(buckets.__getitem__, count), np.int64, len(count))
    x = 1 + np.log(np.fromiter(count.values(), np.float64, len(count)))
    at, x = (np.unique(at), np.bincount(np.unique(at, return_inverse=True)[1], x)) if len(at) else (at, x)
    x = x / np.sqrt(x @ x) if len(x) else x
    s = np.array(stats, np.float64)
    return np.append(at, WORDS + np.arange(len(STATS))), np.append(x, s)


class FactorisationMachine:
    """Second-order machine with a logistic loss, learned by AdaGrad."""

    def __init__(self, rank: int = RANK, seed: int = 1):
        self.w = np.zeros(SIZE)
        self.v = np.random.default_rng(seed).normal(0, 0.05, (SIZE, rank))
        self.gw, self.gv = np.full(SIZE, 1e-6), np.full((SIZE, rank), 1e-6)

    def raw(self, at: np.ndarray, x: np.ndarray) -> float:
        vx = self.v[at] * x[:, None]
        s = vx.sum(axis=0)
        return float(self.w[at] @ x + 0.5 * (s @ s - (vx * vx).sum()))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, rate: float = 0.1, decay: float = 1e-4) -> None:
        v = self.v[at]
        vx = v * x[:, None]
        s = vx.sum(axis=0)
        g = 1 / (1 + np.exp(-np.clip(self.w[at] @ x + 0.5 * (s @ s - (vx * vx).sum()), -30, 30))) - y
        dw = g * x + decay * self.w[at]
        dv = g * (x[:, None] * s - vx * x[:, None]) + decay * v
        self.gw[at] += dw * dw
        self.gv[at] += dv * dv
        self.w[at] -= rate * dw / np.sqrt(self.gw[at])
        self.v[at] -= rate * dv / np.sqrt(self.gv[at])


def fit(rows: list[tuple[int, int, np.ndarray, np.ndarray]], counts: dict[int, int], epochs: int = 6) -> dict | None:
    """Model of (doc_id, label, inputs, values) rows. counts: rows of each label in all data, for the prior.

    None without rows; with a single label, that label's share decides every score.
    """
    rows = sorted(rows, key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    if not rows:
        return None
    ones = sum(r[1] for r in rows)
    if ones in (0, len(rows)):
        return {"only": 1.0 if ones else 0.0}
    fm, rng = FactorisationMachine(), np.random.default_rng(1)
    for e in range(epochs):
        for i in rng.permutation(len(rows)):
            fm.learn(rows[i][2], rows[i][3], rows[i][1], 0.1 / (1 + e))
    prior = np.log(counts[1] / counts[0]) - np.log(ones / (len(rows) - ones))
    return {"w": fm.w.astype(np.float32), "v": fm.v.astype(np.float32), "prior": float(prior)}


def score(model: dict | None, at: np.ndarray, x: np.ndarray) -> float:
    """Probability of label 1; 0.5 where nothing was learned."""
    if model is None:
        return 0.5
    if "only" in model:
        return model["only"]
    vx = model["v"][at] * x[:, None]
    s = vx.sum(axis=0)
    raw = model["w"][at] @ x + 0.5 * (s @ s - (vx * vx).sum()) + model["prior"]
    return float(1 / (1 + np.exp(-np.clip(raw, -30, 30))))


_seen = BoundedCache(bucket)


def seen() -> BoundedCache:
    """Buckets of the words that this Python worker has met, for all its tasks and batches."""
    return _seen


def _length(docs: DataFrame):
    """Length metadata as a long; null where the table has none, or what is no number."""
    return F.col("n_chars").try_cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> dict | None:
    """Fits on about per_class texts of each label; labels (doc_id, quality) are thinned before the join.

    The thinned labels are bounded by per_class, so they are broadcast to the one scan of docs. Null ids, null labels and
    labels other than 0 and 1 teach nothing. Labels that repeat count once in the sample; a document with both labels
    teaches both. None where no text is labelled; empty and null texts are learned from like others.
    """
    known = labels.where("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    counts = class_counts(known, "quality", ["doc_id"])
    few, chosen = in_sample(known, "quality", counts, per_class, ["doc_id"])
    few = few.where(chosen).select("doc_id", "quality").distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _length(docs).alias("n")).join(F.broadcast(few), "doc_id").select("doc_id", "quality", "text", "n")

    def make():
        def work(x: dict) -> dict:
            both = [features(t, n, seen()) for t, n in zip(x["text"], x["n"])]
            return {"doc_id": x["doc_id"], "quality": x["quality"], "at": [a for a, _ in both], "x": [v for _, v in both]}

        return work

    found = map_rows(rows, make, "doc_id long, quality int, at array<int>, x array<double>").distinct().toArrow()
    at, x = found.column("at").combine_chunks(), found.column("x").combine_chunks()
    rows_ = [(i, q, at[k].values.to_numpy(), x[k].values.to_numpy()) for k, (i, q) in enumerate(zip(found.column("doc_id").to_pylist(), found.column("quality").to_pylist()))]
    return fit(rows_, {r["quality"]: r["n"] for r in counts.collect()})


def score_rows(docs: DataFrame, model: dict | None, keep: list[str], out: str = "score") -> DataFrame:
    """The kept columns with `out`, the score of each whole text. The model (about 1.2 MB) goes by broadcast.

    Null and empty texts have a score like others; repeated rows are scored each; an empty table gives no rows. Ties do not
    matter. A kept column that is called like `out` stays, and the score takes the name unused() gives.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    out = unused(out, keep)
    text, n = unused("text", keep), unused("n", keep)

    def make():
        m = sent.value

        def work(x: dict) -> dict:
            return {c: x[c] for c in keep} | {out: [score(m, *features(t, k, seen())) for t, k in zip(x[text], x[n])]}

        return work

    return map_rows(docs.select(*keep, F.col("text").alias(text), _length(docs).alias(n)), make, f"{ddl(docs, keep)}, `{out}` double")


def scored(docs: DataFrame, model: dict | None, out: str = "quality_score") -> DataFrame:
    """docs with the score of each row as its last column; only text and length go through Python, other columns stay where they are.

    The column is `out`, or, where docs has one of this name, the name that unused() gives; no column of docs is changed.
    Null and empty texts, repeated rows and empty tables are as in score_rows().
    """
    from pyspark.sql.pandas.functions import pandas_udf

    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("double")
    def of(text, n):
        import pandas as pd

        return pd.Series([score(sent.value, *features(t, None if pd.isna(k) else int(k), seen())) for t, k in zip(text, n)], dtype="float64")

    return short_batches(docs).select("*", of(F.col("text"), _length(docs)).alias(unused(out, docs.columns)))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of documents, learned from rows that are not held out.

    Other columns than doc_id, text and n_chars are not read. Odd cases are those of train() and score_rows().
    """
    docs = table(spark, sf_dir, "documents")
    n = ["n_chars"] if "n_chars" in docs.columns else []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *n).withColumn("held_out", held_out(4))
    model = train(docs.where("not held_out"), table(spark, sf_dir, "labels").where(~held_out(4)))
    return score_rows(docs, model, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= GOOD).cast("int"))
