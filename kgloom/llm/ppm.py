"""Operator 2: language-model scores by prediction by partial matching (PPM).

A text is a stream of bytes: each lower-cased word, then a separator, and an end symbol after the last. A trie of
byte contexts up to ORDER holds counts over all training texts, gathered by one shuffled aggregation of the
longest grams (shorter ones are their suffixes). A symbol's probability is that of the longest context known:
(2 count - 1) / 2n with escape q / 2n (method D; n symbols seen, q of them distinct), where after an escape the
symbols of the longer context are excluded from the shorter one. As the trie is fixed while scoring, the probability of each gram that training
saw is one lookup; only other positions walk down the orders, all of them at once in numpy.

All counts take part. The probabilities of the most frequent grams go by broadcast; every other gram of a text meets the
whole trie in a shuffle by its nearest context bytes, which all contexts of SHARED bytes and more have in common, so that a
bucket holds all that its walks need but for the orders below SHARED, whose counts go to every task.

Word counts for the unigram base are exact: the most frequent words go by broadcast, of bounded number and length,
and all others by a join on the word.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import give_back, held_out, map_rows, words_of
from kgloom.session import staged, table

ORDER = 5
#: Bytes that no word holds: padding before a text, the separator after a word, the end of a text.
START, SEP, END = 0x09, 0x20, 0x0A
#: Symbols that can follow: all bytes but white space, the separator and the end.
ALPHABET = 252
#: Grams and words of the broadcast tables, at most; what is rarer is looked up by a shuffle.
GRAMS, FREQUENT, WORD_BYTES = 2_000_000, 1 << 18, 48
#: Context bytes that deal the trie, and so many buckets of them; at most 252 ** SHARED grams are of lower orders.
SHARED, BUCKETS = 2, 1 << 10
#: Asked grams of a bucket that are answered at once.
ASKED = 1 << 17
#: Rows that one task holds before it hands its counts on.
HELD = 400_000
#: The end of a text as a token; no word holds white space.
END_WORD = b"\n"


def stream(words: list[bytes]) -> bytes:
    return b"\t" * ORDER + (b" ".join(words) + b" \n" if words else b"\n")


def grams_of(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(keys, positions) of each predicted byte of joined streams; the byte itself is lowest in its key."""
    a = np.frombuffer(buffer, np.uint8).astype(np.int64)
    key = a[ORDER:].copy()
    for j in range(1, ORDER + 1):
        key |= a[ORDER - j : len(a) - j] << (8 * j)
    at = np.flatnonzero(a[ORDER:] != START)
    return key[at], at + ORDER


def low(k: int) -> int:
    """Mask of a context of k bytes and its symbol."""
    return (1 << 8 * (k + 1)) - 1


class Table:
    """int64 keys to row numbers by open addressing; all lookups of an array at once."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(np.ceil(np.log2(max(len(keys), 1) * 2))))
        self.slots = np.full(1 << self.bits, -1, np.int32)
        rest, slot = np.arange(len(keys), dtype=np.int32), self.home(keys)
        while len(rest):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]
            lost = self.slots[slot] != rest
            rest, slot = rest[lost], (slot[lost] + 1) & ((1 << self.bits) - 1)

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row number of each key, -1 where it is not held."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        slot = self.home(keys)
        out = self.slots[slot]
        rest = np.flatnonzero((out >= 0) & (self.keys[out] != keys))
        slot = slot[rest]
        while len(rest):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            row = self.slots[slot]
            out[rest] = row
            more = (row >= 0) & (self.keys[row] != keys[rest])
            rest, slot = rest[more], slot[more]
        return out


class Model:
    """The fixed trie: per order its contexts (n, q, count excluded from the shorter one) and grams (count).

    keys may be whole buckets of the grams only; orders below SHARED then come from `short`, of all grams.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, short: tuple[np.ndarray, np.ndarray] | None = None):
        self.grams, self.count, self.contexts, self.n, self.q, self.out = [], [], [], [], [], []
        levels = []
        for k in range(ORDER, -1, -1):
            if short is not None and k == SHARED - 1:
                keys, counts = short
            cut = keys & low(k)
            order = np.argsort(cut, kind="stable")
            cut, counts = cut[order], counts[order]
            first = np.flatnonzero(np.append(True, cut[1:] != cut[:-1])) if len(cut) else order
            keys, counts = cut[first], np.add.reduceat(counts, first) if len(first) else counts
            levels.insert(0, (keys, counts))
        for k, (g, c) in enumerate(levels):
            ctx, first = np.unique(g >> 8, return_index=True)
            shorter = levels[k - 1][1][np.searchsorted(levels[k - 1][0], g & low(k - 1))] if k else np.zeros(len(g), np.int64)
            add = lambda x: np.add.reduceat(x, first) if len(first) else x
            self.grams.append(g)
            self.count.append(c)
            self.contexts.append(ctx)
            self.n.append(add(c))
            self.q.append(np.diff(np.append(first, len(g))))
            self.out.append(add(shorter))
        g, c = levels[ORDER]
        at = np.searchsorted(self.contexts[ORDER], g >> 8)
        self.known = np.log10((2 * c - 1) / (2 * self.n[ORDER][at])).astype(np.float32) if len(g) else np.zeros(0, np.float32)
        self.tables: tuple | None = None

    def __getstate__(self):
        return self.__dict__ | {"tables": None}

    def index(self) -> tuple[Table, list[Table], list[Table]]:
        if self.tables is None:
            grams, contexts = [Table(g) for g in self.grams], [Table(c) for c in self.contexts]
            self.tables = (grams[ORDER], grams, contexts)
        return self.tables

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """log10 probability of each key's symbol after its context."""
        top, _, _ = self.index()
        row = top.find(keys)
        out = np.zeros(len(keys))
        seen = row >= 0
        if len(self.known):
            out[seen] = self.known[row[seen]]
        if len(rest := np.flatnonzero(~seen)):
            distinct, back = np.unique(keys[rest], return_inverse=True)
            out[rest] = self.walk(distinct)[back]
        return out

    def walk(self, keys: np.ndarray) -> np.ndarray:
        """The same by escapes from the longest context down, with exclusion."""
        _, grams, contexts = self.index()
        out, open_ = np.zeros(len(keys)), np.arange(len(keys))
        gone_n, gone_q = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k in range(ORDER, -1, -1):
            gram = keys[open_] & low(k)
            c = contexts[k].find(gram >> 8)
            have = np.flatnonzero(c >= 0)
            who, c = open_[have], c[have]
            n, q = self.n[k][c] - gone_n[who], self.q[k][c] - gone_q[who]
            g = grams[k].find(gram[have])
            hit = g >= 0
            out[who[hit]] += np.log10((2 * self.count[k][g[hit]] - 1) / (2 * n[hit]))
            miss = ~hit & (n > 0)
            out[who[miss]] += np.log10(q[miss] / (2 * n[miss]))
            gone_n[who], gone_q[who] = self.out[k][c], self.q[k][c]
            open_ = np.setdiff1d(open_, who[hit], assume_unique=True)
        out[open_] -= np.log10(np.maximum(ALPHABET - gone_q[open_], 1))
        return out

    def text(self, words: list[bytes]) -> float:
        return float(self.log10(grams_of(stream(words))[0]).sum())


def _counts(docs: DataFrame) -> DataFrame:
    """(gram long, word binary, n long): counts of a task's part of the training texts, to be summed."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
        words: Counter = Counter()
        grams = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
        streams: list[bytes] = []
        held = 0

        def merge():
            nonlocal grams
            keys, n = np.unique(grams_of(b"".join(streams))[0], return_counts=True)
            both, back = np.unique(np.concatenate([grams[0], keys]), return_inverse=True)
            grams = [both, np.bincount(back, np.concatenate([grams[1], n]), len(both)).astype(np.int64)]
            streams.clear()

        def rows(keys, names, n):
            for at in range(0, len(n), 50_000):
                part = slice(at, at + 50_000)
                size = len(n[part])
                yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()) if keys is None else pa.array(keys[part]), pa.nulls(size, pa.binary()) if names is None else pa.array(names[part], pa.binary()), pa.array(n[part], pa.int64())], schema=schema)

        def word_rows():
            names, n = list(words), list(words.values())
            words.clear()
            yield from rows(None, names, n)

        for batch in batches:
            for text in batch.column("text"):
                w = words_of(text.as_py())
                words.update(w)
                words[END_WORD] += 1
                streams.append(stream(w))
                held += len(streams[-1])
                if held > 4_000_000:
                    merge()
                    held = 0
                    if len(grams[0]) > 4 * HELD:
                        yield from rows(grams[0], None, grams[1])
                        grams = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
                if len(words) > HELD:
                    yield from word_rows()
        if streams:
            merge()
        yield from rows(grams[0], None, grams[1])
        yield from word_rows()

    return docs.select("text").mapInArrow(run, "gram long, word binary, n long")


def _most(counts: DataFrame, most: int) -> int:
    """The least count such that at most `most` rows have it or more, from a histogram of eighths of powers of two.

    The histogram has a few hundred rows at any size.
    """
    step = F.floor(F.log2(F.col("n")) * 8)
    hist = sorted(((r["step"], r["rows"]) for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("rows")).collect()), reverse=True)
    total, least = 0, 1 << 62
    for s, rows in hist:
        total += rows
        if total > most:
            break
        least = int(np.ceil(2 ** (s / 8) - 1e-9))
    return 1 if total <= most else least


def train(spark: SparkSession, docs: DataFrame, grams: int = GRAMS, frequent: int = FREQUENT) -> tuple[DataFrame, tuple, tuple, tuple, DataFrame, int, int]:
    """(trie (gram, n), its orders below SHARED, frequent grams' log10 probabilities, frequent words' counts, all word counts (word, n), N, V) of the texts in docs."""
    both = staged(spark, _counts(docs), "ppm-counts")
    trie = staged(spark, both.where("gram is not null").groupBy("gram").agg(F.sum("n").alias("n")), "ppm-grams")
    short = trie.groupBy(F.col("gram").bitwiseAND(F.lit(low(SHARED - 1))).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    context = F.shiftright("gram", 8).alias("context")
    of = trie.groupBy(context).agg(F.sum("n").alias("of"))
    top = trie.where(F.col("n") >= _most(trie, grams)).select("gram", "n", context).join(of, "context").select("gram", F.log10((2 * F.col("n") - 1) / (2 * F.col("of"))).cast("float").alias("log")).toArrow()
    words = staged(spark, both.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "ppm-words")
    row = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    few = words.where((F.col("n") >= _most(words, frequent)) & (F.length("word") <= WORD_BYTES)).toArrow()
    # words are joined by the byte that none holds, so that a few buffers go by broadcast and not as many objects
    table_ = (b"\t".join(w for c in few.column("word").chunks for w in c.to_pylist()), few.column("n").to_numpy())
    numpy = lambda t, *names: tuple(t.column(c).to_numpy() for c in names)
    return trie, numpy(short, "gram", "n"), numpy(top, "gram", "log"), table_, words, row["n"], row["v"]


def _word_counts(table_: tuple[bytes, np.ndarray]) -> dict[bytes, int]:
    return dict(zip(table_[0].split(b"\t"), table_[1].tolist())) if len(table_[1]) else {}


def _rest_logs(trie: DataFrame, asked: DataFrame, short) -> DataFrame:
    """(key, gram_logs): log10 probabilities of the asked grams (key, gram, n) by the whole trie, summed by key.

    Trie and asked grams are dealt by bucket and sorted so that a bucket's part of the trie comes first; the asked ones
    are answered in pieces.
    """

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("key", pa.int64()), ("logs", pa.float64())])
        none = np.zeros(0, np.int64)
        now, model, size = None, None, 0
        held: list[tuple] = []
        waiting: list[tuple] = []

        def answer():
            nonlocal size
            if waiting:
                keys, grams, n = (np.concatenate(x) for x in zip(*waiting))
                waiting.clear()
                size = 0
                distinct, back = np.unique(keys, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(distinct), pa.array(np.bincount(back, n * model.log10(grams), len(distinct)))], schema=schema)

        for batch in batches:
            bucket, asks, keys, grams, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "asks", "key", "gram", "n"))
            kind = bucket.astype(np.int64) * 2 + asks
            edges = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if bucket[a] != now:
                    yield from answer()
                    now, model = bucket[a], None
                    held.clear()
                if not asks[a]:
                    held.append((grams[a:b], n[a:b]))
                    continue
                if model is None:
                    model = Model(*(np.concatenate(x) for x in zip((none, none), *held)), sent.value)
                    held.clear()
                waiting.append((keys[a:b], grams[a:b], n[a:b]))
                size += b - a
                if size >= ASKED:
                    yield from answer()
        yield from answer()
        del model
        give_back()

    sent = trie.sparkSession.sparkContext.broadcast(short)
    part = lambda df, asks, key: df.select(F.lit(asks).alias("asks"), key.alias("key"), "gram", F.col("n").cast("long").alias("n"))
    rows = part(trie, False, F.lit(-1).cast("long")).unionByName(part(asked, True, F.col("key")))
    near = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * SHARED) - 1))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(near), F.lit(BUCKETS)).cast("int"))
    return rows.repartition("bucket").sortWithinPartitions("bucket", "asks").mapInArrow(run, "key long, logs double").groupBy("key").agg(F.sum("logs").alias("gram_logs"))


def score(spark: SparkSession, docs: DataFrame, train_docs: DataFrame) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score and score of every whole text of docs (key, doc_id, held_out, text).

    Null and empty texts are their end alone. Repeated rows are scored each. A model of no training text spreads
    evenly over the alphabet.
    """
    trie, short, top, frequent, words, total, distinct = train(spark, train_docs)
    sent = spark.sparkContext.broadcast((top, frequent))

    def make():
        import pyarrow as pa

        (keys_, known_logs), counts = sent.value[0], _word_counts(sent.value[1])
        rows = Table(keys_)
        logs = {}

        def work(x: dict) -> dict:
            out: dict[str, list] = {c: x[c] for c in ("key", "doc_id", "held_out")} | {c: [] for c in ("n_tokens", "n_known", "logs", "rest")}
            streams = []
            for text in x["text"]:
                w = words_of(text)
                streams.append(stream(w))
                count = Counter(w)
                count[END_WORD] += 1
                known, sum_logs, rest = 0, 0.0, []
                for word, n in count.items():
                    c = counts.get(word)
                    if c is None:
                        rest.append((word, n))
                        continue
                    known += n
                    v = logs.get(c)
                    if v is None:
                        v = logs[c] = float(np.log10(c + 1))
                    sum_logs += n * v
                out["n_tokens"].append(len(w) + 1)
                out["n_known"].append(known)
                out["logs"].append(sum_logs)
                out["rest"].append([{"word": a, "n": n} for a, n in rest])
            keys, at = grams_of(b"".join(streams))
            ends = np.cumsum([len(s) for s in streams])
            cuts = np.searchsorted(at, np.append(0, ends))
            row = rows.find(keys)
            seen = np.zeros(len(keys))
            seen[row >= 0] = known_logs[row[row >= 0]]
            out["score"] = np.diff(np.append(0.0, np.cumsum(seen))[cuts]).tolist()
            asked, n, offsets = [], [], [0]
            for a, b in zip(cuts, cuts[1:]):
                g, c = np.unique(keys[a:b][row[a:b] < 0], return_counts=True)
                asked.append(g)
                n.append(c)
                offsets.append(offsets[-1] + len(g))
            grams = pa.StructArray.from_arrays([pa.array(np.concatenate(asked), pa.int64()), pa.array(np.concatenate(n), pa.int64())], ["gram", "n"])
            out["grams"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), grams)
            return out

        return work

    first = staged(spark, map_rows(docs.select("key", "doc_id", "held_out", "text"), make, "key long, doc_id long, held_out boolean, n_tokens long, n_known long, logs double, score double, rest array<struct<word:binary,n:long>>, grams array<struct<gram:long,n:long>>"), "ppm-first")
    rest = first.select("key", F.explode("rest").alias("r")).select("key", F.col("r.word").alias("word"), F.col("r.n").alias("k"))
    found = rest.join(words, "word").groupBy("key").agg(F.sum("k").alias("more_known"), F.sum(F.col("k") * F.log10(F.col("n") + 1)).alias("more_logs"))
    asked = first.select("key", F.explode("grams").alias("g")).select("key", "g.gram", "g.n")
    return first.drop("rest", "grams").join(found, "key", "left").join(_rest_logs(trie, asked, short), "key", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("score") + F.coalesce("gram_logs", F.lit(0.0))).alias("score"),
    )


def op2_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of documents, learned from rows
    that are not held out; odd cases are those of score(). Rows with a null doc_id are learned from."""
    docs = table(spark, sf_dir, "documents").select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out(7))
    return score(spark, docs, docs.where("not held_out"))
