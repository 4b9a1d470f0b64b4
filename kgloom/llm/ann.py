"""Operator 6: approximate nearest neighbours by an inverted file with product-quantised residuals.

Coarse centroids and residual codebooks are fitted on a bounded sample; every row is assigned, encoded and indexed.
How many lists a query probes is measured on that sample, so that data without clusters probe more. A list's rows
and the queries that probe it meet in cells of bounded size; in a cell, distances come from asymmetric tables, rows
within the quantiser's error of the best are ranked again on original vectors, and the best are handed on.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgloom.session import staged, table

#: Vectors fitted on, about: PER_LIST for each list, but FIT at least and FIT_MOST at most, which bounds the driver's memory.
FIT, FIT_MOST, PER_LIST = 20_000, 1 << 18, 32
#: Queries on which probing is measured; share of true neighbours that probing must cover.
TRIED, COVER = 256, 0.975
#: Lists that k-means finds in one level; more are found in two.
ONE_LEVEL = 256
#: Numbers of one matrix of distances.
PIECE = 1 << 22
#: Centroids of a codebook, and components that one of them stands for.
CODES, SPAN = 256, 4
#: Rows, and queries, of one cell, about.
CELL = 4096
#: Standard deviations of the quantiser's error that a row may be behind and still be ranked again.
MARGIN = 3.0


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 6) -> np.ndarray:
    """k centroids at most (float32) of the rows of x; empty ones keep their place."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].astype(np.float32)
    for _ in range(rounds):
        own = nearest(x, c)
        size = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], c).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Nearest centroid of each row, in pieces of bounded size."""
    half, step = 0.5 * (c * c).sum(axis=1), max(1, PIECE // len(c))
    return np.concatenate([(x[at : at + step] @ c.T - half).argmax(axis=1) for at in range(0, len(x), step)]) if len(x) else np.zeros(0, np.int64)


def coarse(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids; where these are many, k-means of the parts that a first k-means finds, by their share of the rows."""
    if k <= ONE_LEVEL:
        return kmeans(x, k)
    top = kmeans(x, round(k**0.5))
    own = nearest(x, top)
    parts = [x[own == i] for i in range(len(top))]
    return np.concatenate([kmeans(p, max(1, round(k * len(p) / len(x)))) for p in parts if len(p)])


def lists_for(rows: int) -> int:
    """Inverted lists: a power of two near a quarter of the root of the rows, as far as the largest sample can tell them apart."""
    return int(np.clip(2 ** round(np.log2(max(rows, 1) ** 0.5 / 4)), 1, FIT_MOST // PER_LIST))


class Index:
    """Coarse centroids, codebooks and the number of lists to probe."""

    def __init__(self, sample: np.ndarray, rows: int, k: int):
        lists = max(1, min(lists_for(rows), len(sample) // 8))
        self.dim, self.k = sample.shape[1], k
        self.centroids = coarse(sample, lists)
        own = nearest(sample, self.centroids)
        rest = sample - self.centroids[own]
        self.cuts = np.append(np.arange(0, self.dim, SPAN), self.dim)
        self.books = [kmeans(rest[:, a:b], CODES, 6) for a, b in zip(self.cuts, self.cuts[1:])]
        self.probes = self.measured(sample, own)

    def measured(self, sample: np.ndarray, own: np.ndarray) -> int:
        """Least number of lists that holds COVER of the true neighbours of sample queries within the sample."""
        who = np.arange(len(sample))[:: max(1, len(sample) // TRIED)][:TRIED]
        s = sample[who] @ sample.T
        s[np.arange(len(who)), who] = -np.inf
        k = min(self.k, len(sample) - 1)
        if k < 1:
            return len(self.centroids)
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(sample[who] @ self.centroids.T), axis=1), axis=1)
        ranks = np.sort(place[np.arange(len(who))[:, None], own[top]].ravel())
        return int(ranks[min(len(ranks) - 1, int(np.ceil(COVER * len(ranks))))]) + 1

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(list, codes, length of the error) of each row."""
        own = nearest(x, self.centroids)
        rest = x - self.centroids[own]
        codes = np.stack([nearest(rest[:, a:b], book) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)], axis=1).astype(np.uint8)
        made = np.concatenate([book[codes[:, i]] for i, book in enumerate(self.books)], axis=1)
        return own, codes, np.sqrt(((rest - made) ** 2).sum(axis=1))

    def probed(self, q: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Lists of each query, best first: the measured number, and more while they hold too few rows."""
        out, step = [], max(1, PIECE // len(self.centroids))
        for at in range(0, len(q), step):
            order = np.argsort(-(q[at : at + step] @ self.centroids.T), axis=1, kind="stable")
            held = np.cumsum(sizes[order], axis=1)
            need = np.maximum(self.probes, (held < 4 * (self.k + 1)).sum(axis=1) + 1)
            out += [o[:n][sizes[o[:n]] > 0] for o, n in zip(order, need)]
        return out

    def tables(self, q: np.ndarray, own: int) -> list[np.ndarray]:
        """Per subspace the inner products of queries with codebook entries; the first also holds the centroid's."""
        out = [q[:, a:b] @ book.T for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        out[0] = out[0] + (q @ self.centroids[own])[:, None]
        return out


def _search(index: Index, own: int, rows: dict, q: np.ndarray, q_ids: list, k: int) -> list[tuple]:
    """(query, vec_id, score) of the k best of a cell for each query; ties go to the smaller vec_id."""
    x, ids, codes = rows["x"], rows["id"], rows["codes"]
    about = np.zeros((len(q), len(x)), np.float32)
    for i, t in enumerate(index.tables(q.astype(np.float32), own)):
        about += t[:, codes[:, i]]
    slack = MARGIN * np.sqrt((q * q).sum(axis=1)) * rows["error"].max() / np.sqrt(index.dim)
    out = []
    for i, q_id in enumerate(q_ids):
        scores = about[i]
        least = np.partition(scores, -k - 1)[-k - 1] - slack[i] - 1e-4 if len(scores) > k + 1 else -np.inf
        at = np.flatnonzero((scores >= least) & (ids != q_id))
        exact = (x[at] * q[i]).sum(axis=1)
        best = np.lexsort((ids[at], -exact))[:k]
        out += [(q_id, int(ids[at[b]]), float(exact[b])) for b in best]
    return out


def _vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows that take part, as (id long, v array<double>): vectors without nulls, finite, and not zero."""
    v = F.col(vector).cast("array<double>")
    ok = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), F.when(ok, v).alias("v")).where("v is not null")


def search(spark: SparkSession, df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows by inner product of each row whose key is divisible by `every`.

    Vectors that are null, empty or zero, or hold nulls or non-finite components, take no part. Inner products need one
    length: where there are several, the most frequent takes part (of equally frequent ones the longest). A query never finds
    rows of its own key; of several rows of a query's key, the vector least in byte order is searched for. Ties go to the
    smaller key. An empty table gives no rows. Columns but key and vector are not read, so none can clash.
    """
    rows = _vectors(df, key, vector)
    stored = np.float32 if df.schema[vector].dataType.simpleString() == "array<float>" else np.float64
    dims = sorted(((r["n"], r["d"]) for r in rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    count, dim = dims[0]
    rows = rows.where(F.size("v") == dim)
    draw = F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) / float(1 << 30)
    wanted = int(np.clip(PER_LIST * lists_for(count), FIT, FIT_MOST))
    drawn = rows.where(draw < min(1.0, wanted / count)).orderBy("id", "v").select(F.col("v").cast("array<float>").alias("v")).toArrow().column("v")
    if not len(drawn):
        drawn = rows.orderBy("id", "v").limit(1).select(F.col("v").cast("array<float>").alias("v")).toArrow().column("v")
    sample = drawn.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    index = Index(sample, count, k)
    sent = spark.sparkContext.broadcast(index)

    def encode(batches):
        import pyarrow as pa

        ix = sent.value
        for batch in batches:
            flat = batch.column("v").flatten().to_numpy().reshape(-1, dim)
            own, codes, error = ix.encode(flat.astype(np.float32)) if len(flat) else (np.zeros(0, np.int64), np.zeros((0, 1), np.uint8), np.zeros(0))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(own, pa.int32()), pa.array([r.tobytes() for r in flat.astype(stored)], pa.binary()), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error, pa.float64())], names=["id", "list", "v", "codes", "error"])

    indexed = staged(spark, rows.mapInArrow(encode, "id long, list int, v binary, codes binary, error double"), "ann-index")
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in indexed.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["list"]] = r["n"]
    sent_sizes = spark.sparkContext.broadcast(sizes)

    def probe(batches):
        import pyarrow as pa

        ix, size = sent.value, sent_sizes.value
        for batch in batches:
            q = np.frombuffer(b"".join(batch.column("v").to_pylist()), stored).reshape(-1, dim)
            lists = ix.probed(q.astype(np.float32), size) if len(q) else []
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array([x.tolist() for x in lists], pa.list_(pa.int32()))], names=["id", "v", "lists"])

    asked = indexed.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"))
    asked = staged(spark, asked.mapInArrow(probe, "id long, v binary, lists array<int>"), "ann-queries")
    probes = asked.select("id", "v", F.explode("lists").alias("list"))
    asks = {r["list"]: r["n"] for r in asked.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect()}
    # one row a list, of at most FIT_MOST / PER_LIST lists
    grid = F.broadcast(spark.createDataFrame([(i, max(1, -(-int(n) // CELL)), max(1, -(-asks.get(i, 0) // CELL))) for i, n in enumerate(sizes)], "list int, row_parts int, query_parts int"))
    part = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    a = indexed.join(grid, "list").select("list", part(1, "row_parts").alias("rp"), spread("query_parts").alias("qp"), F.lit(0).alias("kind"), "id", "v", "codes", "error")
    b = probes.join(grid, "list").select("list", spread("row_parts").alias("rp"), part(2, "query_parts").alias("qp"), F.lit(1).alias("kind"), "id", "v", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("double").alias("error"))

    def meet(batches):
        import pyarrow as pa

        ix, cell, rows_ = sent.value, None, None
        types = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
        for batch in batches:
            names = np.stack([batch.column(c).to_numpy() for c in ("list", "rp", "qp", "kind")], axis=1)
            cuts = np.flatnonzero((names[1:] != names[:-1]).any(axis=1)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(names)]):
                if hi <= lo:
                    continue
                seg, here, kind = batch.slice(lo, hi - lo), tuple(names[lo, :3]), names[lo, 3]
                v = np.frombuffer(b"".join(seg.column("v").to_pylist()), stored).reshape(-1, dim).astype(np.float64)
                ids = seg.column("id").to_numpy()
                if kind == 0:
                    now = {"x": v, "id": ids, "codes": np.frombuffer(b"".join(seg.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1), "error": seg.column("error").to_numpy()}
                    rows_ = {c: np.concatenate([rows_[c], now[c]]) for c in now} if cell == here else now
                    cell = here
                elif cell == here:
                    for at in range(0, len(ids), 256):
                        found = _search(ix, int(here[0]), rows_, v[at : at + 256], ids[at : at + 256].tolist(), k)
                        if found:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types.types)], schema=types)

    cells = a.unionByName(b).repartition("list", "rp", "qp").sortWithinPartitions("list", "rp", "qp", "kind")
    found = cells.mapInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op6_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score over embeddings; odd cases are those of search()."""
    return search(spark, table(spark, sf_dir, "embeddings"))
