"""Keyword subgraphs, bridges, paths and contexts."""

from __future__ import annotations

import re
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.textnorm import clean_term
from kgloom.session import discard, staged

#: Weights of relations in a context's relevance.
RELEVANCE = [(("eq", "synonym", "equivalentTo", "sameAs"), 1.5), (("isA", "partOf", "instanceOf"), 1.0), (("relatedTo", "hasContext"), 0.2)]
#: Nodes that say little, and what a triple with one of them loses.
HUBS, HUB_LOSS = ("entity", "thing", "concept", "node", "item"), 0.5
PENALTY = (("derivedFrom", "etymologicallyRelatedTo", "formOf"), -1.0)
#: Tables of found nodes, one a hop, from which distances() makes one again.
UNITED = 32


def bounded(keyword: str, escape: bool = True) -> str:
    """Case-insensitive pattern of a keyword between characters that are no ASCII letters or digits."""
    return rf"(?i)(^|[^a-zA-Z0-9]){re.escape(keyword) if escape else keyword}([^a-zA-Z0-9]|$)"


def forms(keyword: str) -> list[str]:
    return list(dict.fromkeys([keyword.replace(" ", "_"), keyword]))


def mentions(c, keyword: str, escape: bool = False) -> Column:
    """Whether a node has the keyword, with underscores or as it is, at word bounds."""
    col = F.col(c) if isinstance(c, str) else c
    hit = F.lit(False)
    for f in forms(keyword):
        hit = hit | col.rlike(bounded(f.replace('"', ""), escape))
    return hit


def subgraph(t: DataFrame, keywords: list[str]) -> DataFrame:
    """Distinct triples with some keyword at an end: one scan, one disjunction. No keyword, no rows."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | mentions("s", k) | mentions("o", k)
    return t.where(hit).select("s", "p", "o").distinct()


def bridges(t: DataFrame, keywords: list[str]) -> DataFrame:
    """(s, p, o, a, b): triples between the ends of a keyword pair, in either direction."""
    marks = lambda c: F.array(*[F.when(mentions(c, k), F.lit(i)) for i, k in enumerate(keywords)])
    found = t.select("s", "p", "o", F.array_compact(marks("s")).alias("ms"), F.array_compact(marks("o")).alias("mo")).where("size(ms) > 0 and size(mo) > 0")
    pairs = found.select("s", "p", "o", F.explode("ms").alias("i"), "mo").select("s", "p", "o", "i", F.explode("mo").alias("j")).where("i != j")
    name = F.array(*[F.lit(k) for k in keywords])
    return pairs.select("s", "p", "o", F.get(name, F.least("i", "j")).alias("a"), F.get(name, F.greatest("i", "j")).alias("b")).distinct()


def contains(c, keyword: str) -> Column:
    """Whether a node has the keyword anywhere, with underscores or spaces, in any case."""
    low, k = F.lower(c), keyword.lower()
    return low.contains(k.replace(" ", "_")) | low.contains(k)


def substring_bridges(t: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct triples with one keyword in the subject and the other in the object, in either direction. Count them, or take examples()."""
    return t.where((contains("s", a) & contains("o", b)) | (contains("s", b) & contains("o", a))).select("s", "p", "o").distinct()


def examples(t: DataFrame, k: int) -> DataFrame:
    """The k least triples, for a report."""
    return t.orderBy("s", "p", "o").limit(k)


def relevance(keywords: list[str], hubs: tuple[str, ...] = HUBS) -> Column:
    """Additive score of a triple (s, p, o)."""
    score = F.lit(0.0)
    for k in keywords:
        n = float(len(k))
        for c in ("s", "o"):
            label = F.col(c)
            exact = F.lower(label).isin(*{k.lower(), k.replace(" ", "_").lower()})
            size = F.lit(n) / F.greatest(F.length(label), F.lit(1))
            wide = F.when(label.contains(" ") | label.contains("-"), -0.5).otherwise(0.0) if " " not in k else F.lit(0.0)
            hit = label.rlike(bounded(k)) | label.rlike(bounded(k.replace(" ", "_")))
            score = score + F.when(exact, 3.0).when(hit, size + wide).otherwise(0.0)
    kind = F.lit(0.0)
    for names, weight in [*RELEVANCE, PENALTY]:
        kind = F.when(F.col("p").isin(*names), weight).otherwise(kind)
    score = score + kind
    if hubs:
        score = score - F.when(F.lower("s").isin(*hubs) | F.lower("o").isin(*hubs), HUB_LOSS).otherwise(0.0)
    return score


def context(general: DataFrame, found: DataFrame, keywords: list[str], most_bridges: int, most: int, hubs: tuple[str, ...] = HUBS) -> DataFrame:
    """(section, s, p, o, score): bridges first by relevance, up to most_bridges; relevant others fill up to most.

    Ties go to the smaller triple. The limits are the operator's own budgets.
    """
    rank = lambda df: df.select("s", "p", "o").distinct().withColumn("score", F.round(relevance(keywords, hubs), 9))
    order = [F.desc("score"), "s", "p", "o"]
    first = rank(found).orderBy(*order).limit(most_bridges)
    used = first.agg(F.count(F.lit(1)).alias("used"))
    others = rank(general).join(found.select("s", "p", "o"), ["s", "p", "o"], "left_anti").where("score > 0").orderBy(*order).limit(most)
    from pyspark.sql import Window

    rest = others.withColumn("_n", F.row_number().over(Window.orderBy(*order))).crossJoin(used).where(F.col("_n") <= F.lit(most) - F.col("used")).select("s", "p", "o", "score")
    return first.withColumn("section", F.lit("bridge")).unionByName(rest.withColumn("section", F.lit("general"))).select("section", "s", "p", "o", "score")


def clean_context(t: DataFrame) -> DataFrame:
    """P25: cleaned triples without label and type; of those equal but for case the first by seq stays. t: (seq, s, p, o)."""
    from kgloom.operators.dedup import first_wins

    p = clean_term("p")
    p = F.concat(F.lower(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))
    c = t.select("seq", clean_term("s").alias("s"), p.alias("p"), clean_term("o").alias("o")).where(~F.col("p").isin("label", "type"))
    return first_wins(c.withColumn("_k", F.lower(F.concat_ws("\u0001", "s", "p", "o"))), ["_k"], ["seq"]).drop("_k")


def keyword_metrics(t: DataFrame, keywords: list[str]) -> DataFrame:
    """hit_rate, relation_diversity, subgraph_volume over distinct triples; keywords are escaped and lower case counts."""
    hits = [F.max(F.when(F.lower("s").rlike(bounded(k)) | F.lower("o").rlike(bounded(k)), 1).otherwise(0)) for k in keywords]
    rate = F.lit(0.0)
    for h in hits:
        rate = rate + F.coalesce(h, F.lit(0))
    return t.select("s", "p", "o").distinct().agg((rate * (100.0 / max(len(keywords), 1))).alias("hit_rate"), F.countDistinct("p").alias("relation_diversity"), F.count(F.lit(1)).alias("subgraph_volume"))


def distances(spark: SparkSession, edges: DataFrame, sources: DataFrame, most: int | None = None) -> DataFrame:
    """(source, node, hops, path, vias): shortest paths over undirected edges (a, b, via) from each source node.

    One join a hop with the frontier only, cut off by a table in the shared folder; of equal paths the least by its nodes
    stays. It goes on until no node is found, or for most hops. A repeated source counts once; a null node leads nowhere.
    """
    both = edges.select("a", "b", "via").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "via")).where("not (a <=> b)").groupBy("a", "b").agg(F.min("via").alias("via"))
    both = staged(spark, both, "bfs-edges")
    front = staged(spark, sources.select("node").distinct().select(F.col("node").alias("source"), "node", F.lit(0).alias("hops"), F.array("node").alias("path"), F.array().cast("array<string>").alias("vias")), "bfs-0")
    found = [front]
    for hop in count(1) if most is None else range(1, most + 1):
        step = front.join(both, front["node"] == both["a"]).select("source", F.col("b").alias("node"), F.lit(hop).alias("hops"), F.concat("path", F.array("b")).alias("path"), F.concat("vias", F.array("via")).alias("vias"))
        step = step.groupBy("source", "node").agg(F.min("hops").alias("hops"), F.min_by("path", "path").alias("path"), F.min_by("vias", "path").alias("vias"))
        seen = reduce(DataFrame.unionByName, found).select(F.col("source").alias("_s"), F.col("node").alias("_n"))
        front = staged(spark, step.join(seen, (F.col("source") == F.col("_s")) & F.col("node").eqNullSafe(F.col("_n")), "left_anti"), f"bfs-{hop}")
        if front.isEmpty():
            discard(front)
            break
        if len(found) == UNITED:
            whole = staged(spark, reduce(DataFrame.unionByName, found), "bfs-seen")
            discard(*found)
            found = [whole]
        found.append(front)
    discard(both)
    return reduce(DataFrame.unionByName, found)


def pair_distances(found: DataFrame, targets: DataFrame) -> DataFrame:
    """(u, v, hops): least hops between the nodes of keyword u and those of v. targets: (keyword, node)."""
    a, b = targets.select(F.col("keyword").alias("u"), F.col("node").alias("source")), targets.select(F.col("keyword").alias("v"), "node")
    return found.join(a, "source").join(b, "node").where("u < v").groupBy("u", "v").agg(F.min("hops").alias("hops"))


def _packed(df: DataFrame, key: str, vector: str, block: int) -> DataFrame:
    """(ids, m): blocks of at most `block` rows in the order of their keys, vectors as bytes of one matrix; zeros for null."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, block):
                ids = batch.column("id").slice(at, block).to_numpy(zero_copy_only=False)
                rows = batch.column("v").slice(at, block).to_pylist()
                wide = max((len(r) for r in rows if r is not None), default=0)
                m = np.array([r if r is not None else [0.0] * wide for r in rows], np.float32 if single else np.float64).reshape(len(ids), wide)
                order = np.argsort(ids, kind="stable")
                yield pa.RecordBatch.from_arrays([pa.array([ids[order].tolist()], pa.list_(pa.int64())), pa.array([m[order].tobytes()], pa.binary())], names=["ids", "m"])

    single = df.schema[vector].dataType.simpleString() == "array<float>"
    return staged(df.sparkSession, df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "ids array<long>, m binary"), "blocks")


def nearest(spark: SparkSession, rows: DataFrame, queries: DataFrame, key: str, vector: str, k: int, block: int = 1000) -> DataFrame:
    """(q, id, c): cosines that hold every query's k largest over all rows but those of its own key.

    Blocks of queries meet blocks of rows; each pair of blocks is one product of matrices, of which k rows a query stay
    (of equal cosines the smaller key). c is null where a vector is null or zero.
    """

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def unit(m, n):
            m = np.frombuffer(m, np.float32 if single else np.float64).reshape(n, -1).astype(float)
            size = np.sqrt((m * m).sum(axis=1))
            return m / np.where(size > 0, size, 1)[:, None], size > 0

        for batch in batches:
            for x in range(batch.num_rows):
                q, ids = (np.array(batch.column(c)[x].as_py(), np.int64) for c in ("q", "ids"))
                (a, some_a), (b, some_b) = unit(batch.column("qm")[x].as_py(), len(q)), unit(batch.column("m")[x].as_py(), len(ids))
                wide = max(a.shape[1], b.shape[1])
                a, b = (np.pad(y, ((0, 0), (0, wide - y.shape[1]))) for y in (a, b))
                c = np.where(some_a[:, None] & some_b[None, :], a @ b.T, -2.0)
                c[q[:, None] == ids[None, :]] = -3.0
                best = np.argsort(-c, axis=1, kind="stable")[:, :k]
                c = np.take_along_axis(c, best, axis=1).ravel()
                keep = c > -3
                c = c[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, best.shape[1])[keep]), pa.array(ids[best].ravel()[keep]), pa.array(c, pa.float64(), mask=c == -2)], names=["q", "id", "c"])

    single = rows.schema[vector].dataType.simpleString() == "array<float>" == queries.schema[vector].dataType.simpleString()
    pack = lambda df: _packed(df if single else df.withColumn(vector, F.col(vector).cast("array<double>")), key, vector, block)
    pairs = pack(rows).crossJoin(pack(queries).select(F.col("ids").alias("q"), F.col("m").alias("qm")))
    return pairs.mapInArrow(run, "q long, id long, c double")


def top_k_mean(scores: DataFrame, key: str, score: str, tie: str, k: int) -> DataFrame:
    """(key, mean) of the k largest scores."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(score), tie)
    return scores.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).groupBy(key).agg(F.avg(score).alias("mean"))
