"""Entity resolution over shared URLs, lifting and expansion of relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.textnorm import supersense
from kgloom.operators.components import connected_components
from kgloom.session import staged


def url_edges(urls: DataFrame, reserved: str | None = None) -> DataFrame:
    """(a, b) between a concept and each of its URLs, as keys of two kinds."""
    return urls.where("concept is not null and url is not null").select(F.concat(F.lit("c:"), F.col("concept").cast("string")).alias("a"), F.concat(F.lit("u:"), F.col("url")).alias("b")).distinct()


def components(spark: SparkSession, urls: DataFrame) -> DataFrame:
    """G1: (concept, component) of concepts that have a URL; the component is its smallest concept.

    A concept's key sorts before every URL's, so the smallest node of a component is a concept.
    """
    found = connected_components(spark, url_edges(urls))
    bare = lambda c: F.substring(c, 3, 1 << 30).alias
    return found.where(F.col("node").startswith("c:")).select(bare("node")("concept"), bare("component")("component"))


def coherent(members: DataFrame, concepts: DataFrame, null_joins_single: bool = False) -> DataFrame:
    """(concept, cluster): a component split by supersense, null being a group of its own.

    With null_joins_single, members without a supersense join it where their component has exactly one.
    The cluster is named by its smallest concept.
    """
    m = members.join(concepts.select(F.col("concept"), supersense("sense").alias("kind")), "concept", "left")
    if null_joins_single:
        one = m.where("kind is not null").groupBy("component").agg(F.min("kind").alias("only"), F.countDistinct("kind").alias("kinds")).where("kinds = 1")
        m = m.join(one, "component", "left").withColumn("kind", F.coalesce("kind", "only"))
    low = m.groupBy("component", "kind").agg(F.min("concept").alias("cluster"))
    return m.join(low, (m["component"] == low["component"]) & m["kind"].eqNullSafe(low["kind"])).select("concept", "cluster")


def with_singletons(clusters: DataFrame, concepts: DataFrame) -> DataFrame:
    """Concepts of no cluster are clusters of their own."""
    rest = concepts.select("concept").distinct().join(clusters, "concept", "left_anti")
    return clusters.unionByName(rest.select("concept", F.col("concept").alias("cluster")))


def cluster(spark: SparkSession, concepts: DataFrame, urls: DataFrame, null_joins_single: bool = False) -> DataFrame:
    """Components, coherence split and singletons, as a table in the shared folder that all joins read."""
    return staged(spark, with_singletons(coherent(components(spark, urls), concepts, null_joins_single), concepts), "clusters")


def lift(relations: DataFrame, clusters: DataFrame) -> DataFrame:
    """Distinct relations between clusters (rel, weight and source kept apart)."""
    a, b = clusters.select(F.col("concept").alias("start"), F.col("cluster").alias("start_cluster")), clusters.select(F.col("concept").alias("end"), F.col("cluster").alias("end_cluster"))
    return relations.join(a, "start").join(b, "end").select("start_cluster", "end_cluster", "rel", "weight", "source").distinct()


def expand(lifted: DataFrame, clusters: DataFrame) -> DataFrame:
    """Lifted relations between all members, without a concept to itself. What is lifted is distinct before it fans out."""
    a, b = clusters.select(F.col("cluster").alias("start_cluster"), F.col("concept").alias("start")), clusters.select(F.col("cluster").alias("end_cluster"), F.col("concept").alias("end"))
    return lifted.join(a, "start_cluster").join(b, "end_cluster").where("start != end").select("start", "end", "rel", "weight", "source").distinct()


def constrained_endpoints(candidates: DataFrame, pos: str, wanted: str, key: list[str]) -> DataFrame:
    """Candidates of a key whose part of speech is the wanted one, or all of them where none has it (or none is wanted).

    Keys with a match are aggregated, a row a task and key, and joined back: a hot key is split, not gathered. A null in a
    key is a key like any other.
    """
    match = F.coalesce(F.col(pos) == F.col(wanted), F.lit(False))
    some = candidates.where(match).select(F.struct(*key).alias("_key")).distinct().withColumn("_some", F.lit(True))
    marked = candidates.withColumn("_key", F.struct(*key)).join(some, "_key", "left")
    return marked.where(match | F.col("_some").isNull()).select(*candidates.columns)


def cross_class_hints(edges: DataFrame, concepts: DataFrame) -> DataFrame:
    """(term, rel, start_pos, end_pos) of edges between two classes of one term, which one URI cannot hold as a triple.

    edges (start, end, rel), concepts (concept, term, pos).
    """
    side = lambda x: concepts.select(F.col("concept").alias(x), F.col("term").alias(f"{x}_term"), F.col("pos").alias(f"{x}_pos"))
    both = edges.join(side("start"), "start").join(side("end"), "end")
    return both.where("start_term = end_term and start_pos != end_pos").select(F.col("start_term").alias("term"), "rel", "start_pos", "end_pos").distinct()


def lifted_hints(hints: DataFrame, concepts: DataFrame, clusters: DataFrame) -> DataFrame:
    """(start_cluster, end_cluster, rel) of hints, between different clusters of the term's classes."""
    of = concepts.join(clusters, "concept").select("term", "pos", "cluster").distinct()
    side = lambda x: of.select("term", F.col("pos").alias(f"{x}_pos"), F.col("cluster").alias(f"{x}_cluster"))
    found = hints.join(side("start"), ["term", "start_pos"]).join(side("end"), ["term", "end_pos"])
    return found.where("start_cluster != end_cluster").select("start_cluster", "end_cluster", "rel").distinct()


def predicate_metadata(t: DataFrame, names: list[str]) -> DataFrame:
    """(p, name, value): what triples (s, p, o) say of the predicates that they use, by the named metadata predicates."""
    used = t.select(F.col("p").alias("predicate")).distinct()
    said = t.where(F.col("p").isin(*names)).select(F.col("s").alias("predicate"), F.col("p").alias("name"), F.col("o").alias("value")).distinct()
    return used.join(said, "predicate").select(F.col("predicate").alias("p"), "name", "value")
