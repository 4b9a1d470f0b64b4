"""Graph statistics and differences over triples (s, p, o)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.textnorm import good_label, pair_label
from kgloom.operators.components import connected_components
from kgloom.session import small

#: What pair mining skips in a predicate, and namespaces that are no types.
SKIPPED = ("rdf-syntax-ns#type", "rdf-schema#subClassOf", "owl#", "rdf-schema#label")
SCHEMA = ("<http://www.w3.org/2002/07/owl#", "<http://www.w3.org/2000/01/rdf-schema#")


def nodes(t: DataFrame) -> DataFrame:
    """A10: distinct subjects and objects."""
    return t.select(F.explode(F.array("s", "o")).alias("node")).distinct()


def degrees(t: DataFrame) -> DataFrame:
    """(node, degree), both ends counted, literals too. One scan: ends are exploded, counts combined before the shuffle."""
    return t.select(F.explode(F.array("s", "o")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def relation_counts(t: DataFrame) -> DataFrame:
    """(p, n)."""
    return t.groupBy("p").agg(F.count(F.lit(1)).alias("n"))


def type_counts(t: DataFrame, type_p: str, skipped: tuple[str, ...] = SCHEMA) -> DataFrame:
    """(o, n) of types outside the schema's namespaces."""
    rows = t.where(F.col("p") == type_p)
    for s in skipped:
        rows = rows.where(~F.col("o").startswith(s))
    return rows.groupBy("o").agg(F.count(F.lit(1)).alias("n"))


def density(t: DataFrame) -> DataFrame:
    """Nodes, edges, relations, density and average degree; 0 where they are undefined."""
    n = nodes(t).agg(F.count(F.lit(1)).alias("nodes"))
    e = t.agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("p").alias("relations"))
    return n.crossJoin(e).select("nodes", "edges", "relations", F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes").cast("double") * (F.col("nodes") - 1))).otherwise(0.0).alias("density"), F.when(F.col("nodes") > 0, 2.0 * F.col("edges") / F.col("nodes")).otherwise(0.0).alias("avg_degree"))


def degree_entropy(d: DataFrame) -> DataFrame:
    """Entropy of the degree distribution, 1e-9 inside the logarithm. d: (node, degree).

    Nodes are counted by degree first, so that the total is joined to as many rows as there are degrees.
    """
    by = d.groupBy("degree").agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("total"))
    p = F.col("n") / F.col("total")
    return by.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(-p * F.log2(p + F.lit(1e-9))), F.lit(0.0)).alias("entropy"))


def navigability(spark: SparkSession, edges: DataFrame, all_nodes: DataFrame, a: str = "s", b: str = "o") -> DataFrame:
    """Components, isolated nodes, share of the largest, and reachability (sum of squared sizes over squared nodes)."""
    found = connected_components(spark, edges, a, b)
    sizes = all_nodes.join(found, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.count(F.lit(1)).alias("size"))
    size = F.col("size").cast("double")
    return sizes.agg(F.count(F.lit(1)).alias("components"), F.coalesce(F.sum(F.when(F.col("size") == 1, 1).otherwise(0)), F.lit(0)).cast("long").alias("isolated"), F.coalesce(F.max("size") / F.sum("size"), F.lit(0.0)).alias("largest"), F.coalesce(F.sum(size * size) / (F.sum(size) * F.sum(size)), F.lit(0.0)).alias("reachability"))


def decomposed(types: DataFrame, category: DataFrame) -> DataFrame:
    """(category, n) of types by a small table (class, category); classes it lacks are other."""
    return types.join(small(category), "class", "left").groupBy(F.coalesce("category", F.lit("other")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


def sampled(a, b, k: int):
    """Whether a pair is in the sample: first byte of the md5 of its labels, modulo k."""
    return F.lit(True) if k <= 1 else F.conv(F.substring(F.md5(F.concat_ws("|", a, b)), 1, 2), 16, 10).cast("int") % k == 0


def label_pairs(t: DataFrame) -> DataFrame:
    """(a, b) labels of edges between IRIs that pass the gates, a < b."""
    skip = F.lit(False)
    for s in SKIPPED:
        skip = skip | F.col("p").contains(s)
    rows = t.where(F.col("s").startswith("<") & F.col("o").startswith("<") & ~skip).select(pair_label("s").alias("la"), pair_label("o").alias("lb"))
    return rows.where((F.col("la") != F.col("lb")) & good_label("la") & good_label("lb")).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))


def mined(pairs: DataFrame, k: int = 1, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs with n, degrees of labels). Sampled by hash before counting; pairs in keep are always counted."""
    d = pairs.select(F.explode(F.array("a", "b")).alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("degree"))
    chosen = sampled(F.col("a"), F.col("b"), k)
    if keep is not None:
        pairs = pairs.join(keep.select("a", "b").distinct().withColumn("_kept", F.lit(True)), ["a", "b"], "left").where(chosen | F.col("_kept")).select("a", "b")
    else:
        pairs = pairs.where(chosen)
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")), d


def differential(enriched: DataFrame, baseline: DataFrame, degree: DataFrame, most: int) -> DataFrame:
    """Pairs that the enriched graph has more often, without labels of over `most` degree. Missing counts are 0."""
    both = enriched.withColumnRenamed("n", "h").join(baseline.withColumnRenamed("n", "b_n"), ["a", "b"], "left").withColumn("base", F.coalesce("b_n", F.lit(0)))
    low = degree.where(F.col("degree") <= most)
    both = both.where(F.col("h") - F.col("base") > 0).join(low.select(F.col("label").alias("a")), "a", "left_semi").join(low.select(F.col("label").alias("b")), "b", "left_semi")
    return both.select("a", "b", "h", "base", (F.col("h") - F.col("base")).alias("gain"))


def bag_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of a that b lacks, by their number."""
    return a.exceptAll(b)


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that b lacks."""
    return a.subtract(b)


def overlap(a: DataFrame, b: DataFrame, by: str) -> DataFrame:
    """Per value of `by` the rows of a, the rows shared with b by number, and their share (recall)."""
    whole = a.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    both = a.intersectAll(b).groupBy(by).agg(F.count(F.lit(1)).alias("common"))
    return whole.join(both, by, "left").select(by, "n", F.coalesce("common", F.lit(0)).alias("common"), (F.coalesce("common", F.lit(0)) / F.col("n")).alias("recall"))


def same(a: DataFrame, b: DataFrame) -> bool:
    """Whether two builds have the same rows by number."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def relative_frequency(counts: DataFrame, key: str, k: int = 10) -> DataFrame:
    """Share of each value, the k largest; ties go to the smaller value."""
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(key, "n", (F.col("n") / F.col("total")).alias("share")).orderBy(F.desc("n"), key).limit(k)


def json_keys(df: DataFrame, column: str) -> DataFrame:
    """(key, n) of the top-level keys of JSON objects."""
    return df.select(F.explode(F.json_object_keys(column)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def hubs(t: DataFrame, k: int = 200) -> DataFrame:
    """(s, degree): the k subjects with most distinct objects, for a report; ties go to the smaller subject."""
    return t.groupBy("s").agg(F.countDistinct("o").alias("degree")).orderBy(F.desc("degree"), "s").limit(k)


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, columns..): rows that one build has and the other lacks, by their number; no rows where both are the same."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def largest_lists(df: DataFrame, key: str, item: str, k: int) -> DataFrame:
    """The k keys with most items."""
    return df.groupBy(key).agg(F.count(item).alias("n")).orderBy(F.desc("n"), key).limit(k)
