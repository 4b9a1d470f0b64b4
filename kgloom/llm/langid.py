"""Operator 9: language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three characters over lower-cased letters are hashed to a fixed space. Their document frequencies
are counted over all labelled texts. Weights are learned on the driver by follow-the-regularised-leader with L1 and L2
penalties from a bounded sample of these texts, of which a fifth is kept to fit the temperature of the softmax.
Prediction is one map over whole texts. Every language is learned, however many there are: with many, the space of
n-grams shrinks so that the weights stay bounded.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import chunked_counts, ddl, give_back, held_out, map_rows, short_batches, summed_counts, unused
from kgloom.llm.sampling import class_counts, in_sample
from kgloom.session import discard, staged, table

#: Bits of the n-gram space with few languages, and with very many.
BITS, LEAST_BITS = 15, 12
#: Labelled texts that are fitted on, about: of each language, and of all languages together (but one a language at least).
PER_LANG, SAMPLE = 500, 20_000
#: Weights at most; with more languages than this allows at BITS, n-grams share fewer buckets.
WEIGHTS = 1 << 23
UNKNOWN = "und"

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def bits_for(languages: int) -> int:
    """Bits of the n-gram space, so that languages times buckets stay within WEIGHTS."""
    bits = BITS
    while bits > LEAST_BITS and languages << bits > WEIGHTS:
        bits -= 1
    if languages << bits > WEIGHTS << 2:
        raise ValueError(f"{languages} different values of lang are no languages")
    return bits


def ngram_counts(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts) of the n-grams of a whole text; both empty where it has no letter."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    good = letters()[code]
    if not good.any():
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    code = np.where(good, code, 32).astype(np.uint32)
    code = np.concatenate([[np.uint32(32)], code[good | np.append(True, good[:-1])], [np.uint32(32)]])
    h = code * np.uint32(0x9E3779B1)
    grams = []
    for n in range(3):
        if n:
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + code[n:] * np.uint32(0xC2B2AE35)
        grams.append(((h ^ (h >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - bits))
    counts = np.bincount(np.concatenate(grams), minlength=1 << bits)
    at = np.flatnonzero(counts)
    return at.astype(np.int32), counts[at]


class Ftrl:
    """Multinomial logistic regression by FTRL-proximal with elastic net."""

    def __init__(self, size: int, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.2):
        self.z, self.n = np.zeros((size, classes)), np.zeros((size, classes))
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def softmax(s: np.ndarray) -> np.ndarray:
    e = np.exp(s - s.max())
    return e / e.sum()


def fit(rows: list[tuple[int, str, np.ndarray, np.ndarray]], df: np.ndarray, texts: int, epochs: int = 3) -> dict | None:
    """Model of (doc_id, lang, buckets, counts) rows; df and texts: document frequencies and their number. None without rows."""
    rows = sorted((r for r in rows if len(r[2])), key=lambda r: (r[0], r[1], len(r[2]), r[2].tobytes(), r[3].tobytes()))
    if not rows:
        return None
    langs = sorted({r[1] for r in rows})
    number = {lang: i for i, lang in enumerate(langs)}
    idf = np.log((1 + texts) / (1 + df)) + 1
    data = [(at, vector(at, c, idf), number[lang]) for _, lang, at, c in rows]
    order = np.random.default_rng(9).permutation(len(data))
    # a fifth is kept for the temperature, but for the last text of each language
    last = {data[i][2]: i for i in order}
    kept = [i for i in order[: len(order) // 5] if last[data[i][2]] != i]
    held = set(kept)
    learned = [i for i in order if i not in held]
    kept = kept or order
    model = Ftrl(len(df), len(langs))
    for _ in range(epochs):
        for i in learned:
            model.learn(*data[i])
    w = model.weights()
    scores = [(data[i][1] @ w[data[i][0]], data[i][2]) for i in kept]
    loss = lambda t: -sum(np.log(max(softmax(s / t)[y], 1e-12)) for s, y in scores)
    temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    return {"langs": langs, "idf": idf.astype(np.float32), "w": w.astype(np.float32), "t": temperature, "bits": len(df).bit_length() - 1}


def vector(at: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(counts)) * idf[at]
    return x / np.sqrt(x @ x)


def train(docs: DataFrame, per_lang: int = PER_LANG, most: int = SAMPLE) -> dict | None:
    """Fits on docs (doc_id, text, lang); null languages and null texts teach nothing, nor do texts without a letter.

    Document frequencies and languages come from all labelled texts, by one scan that also makes the sample's n-grams. The
    sample has about per_lang texts of a language, and `most` in all unless there are more languages than that. Repeated rows
    are one row of the sample. None where nothing is labelled. ValueError where there are more values of lang than weights
    can be held for (8,192).
    """
    spark = docs.sparkSession
    known = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    counts = class_counts(known, "lang", ["doc_id", "text"])
    languages = counts.count()
    bits = bits_for(languages)
    rows, chosen = in_sample(known, "lang", counts, max(1, min(per_lang, most // max(1, languages))), ["doc_id", "text"])

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int64())), ("chunk", pa.int32()), ("counts", pa.binary()), ("texts", pa.int64())])
        df, texts = np.zeros(1 << bits, np.int64), 0
        for batch in batches:
            out = []
            for i, (text, lang, sample) in enumerate(zip(*[batch.column(c) for c in ("text", "lang", "sample")])):
                at, n = ngram_counts(text.as_py(), bits)
                df[at] += 1
                texts += len(at) > 0
                if sample.as_py() and len(at):
                    out.append((batch.column("doc_id")[i].as_py(), lang.as_py(), at, n))
            if out:
                ids, langs, ats, ns = zip(*out)
                none = lambda t: pa.nulls(len(out), t)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(langs), pa.array(ats, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int64())), none(pa.int32()), none(pa.binary()), none(pa.int64())], schema=schema)
        at, counts_ = chunked_counts(df)
        if texts:
            none = lambda t: pa.nulls(len(at), t)
            yield pa.RecordBatch.from_arrays([none(pa.int64()), none(pa.string()), none(pa.list_(pa.int32())), none(pa.list_(pa.int64())), pa.array(at), pa.array(counts_, pa.binary()), pa.array([texts, *[0] * (len(at) - 1)], pa.int64())], schema=schema)
        give_back()

    asked = short_batches(rows.select("doc_id", "lang", "text", chosen.alias("sample")))
    seen = staged(spark, asked.mapInArrow(run, "doc_id long, lang string, at array<int>, n array<long>, chunk int, counts binary, texts long"), "langid-seen")
    df = summed_counts(seen.where("chunk is not null").select("chunk", "counts"), 1 << bits)
    texts = seen.agg(F.coalesce(F.sum("texts"), F.lit(0))).first()[0]
    few = seen.where("chunk is null").select("doc_id", "lang", "at", "n").distinct().toArrow()
    discard(seen)
    at, n = few.column("at").combine_chunks(), few.column("n").combine_chunks()
    ids, langs = few.column("doc_id").to_pylist(), few.column("lang").to_pylist()
    return fit([(i if i is not None else -1, lang, at[k].values.to_numpy(), n[k].values.to_numpy()) for k, (i, lang) in enumerate(zip(ids, langs))], df, texts)


def predict(model: dict | None, text: str | None) -> tuple[str, float]:
    """(language, probability); (und, 0.0) where the text has no letter or nothing was learned. Ties go to the first language by name."""
    at, counts = ngram_counts(text, BITS if model is None else model["bits"])
    if model is None or not len(at):
        return UNKNOWN, 0.0
    p = softmax((vector(at, counts, model["idf"]) @ model["w"][at]).astype(np.float64) / model["t"])
    k = int(p.argmax())
    return model["langs"][k], float(p[k])


def identify(docs: DataFrame, model: dict | None, keep: list[str]) -> DataFrame:
    """The kept columns with lang_pred and score of each whole text. The model (128 MB at most, 0.6 MB for four languages) goes by broadcast.

    Null and empty texts and texts without a letter are `und` with score 0; repeated rows are predicted each; an empty table
    gives no rows. A kept column called lang_pred or score stays, and the new one takes the name unused() gives.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    pred, prob, text = unused("lang_pred", keep), unused("score", keep), unused("text", keep)

    def make():
        m = sent.value

        def work(x: dict) -> dict:
            found = [predict(m, t) for t in x[text]]
            return {c: x[c] for c in keep} | {pred: [a for a, _ in found], prob: [b for _, b in found]}

        return work

    return map_rows(docs.select(*keep, F.col("text").alias(text)), make, f"{ddl(docs, keep)}, `{pred}` string, `{prob}` double")


def identified(docs: DataFrame, model: dict | None) -> DataFrame:
    """docs with the predicted language and its probability as the last two columns; only the texts go through Python.

    They are lang_pred and lang_score, or, where docs has columns of these names, what unused() gives; no column of docs is
    changed. Odd cases are those of identify().
    """
    from pyspark.sql.pandas.functions import pandas_udf

    sent = docs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("p string, s double")
    def of(s):
        import pandas as pd

        return pd.DataFrame([predict(sent.value, t) for t in s], columns=["p", "s"])

    both = unused("lang", docs.columns)
    out = short_batches(docs).withColumn(both, of(F.col("text")))
    return out.select(*docs.columns, F.col(f"{both}.p").alias(unused("lang_pred", docs.columns)), F.col(f"{both}.s").alias(unused("lang_score", docs.columns)))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of documents, learned from rows that are not held out.

    Other columns than doc_id, text and lang are not read. Odd cases are those of train() and identify().
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(4))
    return identify(docs, train(docs.where("not held_out")), ["doc_id", "held_out"])
