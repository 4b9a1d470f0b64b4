"""Mappings as small broadcast tables, and class trees."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.session import small

#: Keys of a class tree that are structure, not classes.
STRUCTURE = ("properties", "classes", "sameAs")


def edge_map(spark: SparkSession, maps: list[dict]) -> DataFrame:
    """(label, rel, negated, swap); labels lower-cased, later maps win."""
    merged: dict[str, dict] = {}
    for m in maps:
        merged |= {k.lower(): v for k, v in m.items()}
    return spark.createDataFrame([(k, v["rel"], bool(v.get("relNegated", False)), bool(v.get("swap", False))) for k, v in sorted(merged.items())], "label string, mapped string, negated boolean, swap boolean")


def pos_map(spark: SparkSession, maps: list[dict]) -> DataFrame:
    """(label, class); labels lower-cased, later maps win."""
    merged: dict[str, str] = {}
    for m in maps:
        merged |= {k.lower(): v for k, v in m.items()}
    return spark.createDataFrame(sorted(merged.items()), "label string, class string")


def load_json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def map_pos(df: DataFrame, mapping: DataFrame, pos: str = "pos") -> DataFrame:
    """Mapped class, or the label itself; the label is looked up as it is while keys are lower case."""
    m = small(mapping.select(F.col("label").alias("_label"), "class"))
    return df.join(m, F.col(pos) == F.col("_label"), "left").withColumn(pos, F.coalesce("class", pos)).drop("_label", "class")


def map_relations(df: DataFrame, mapping: DataFrame, rel: str = "rel") -> DataFrame:
    """Relations renamed by lower-cased label, with negated; swapped ones have their ends exchanged."""
    m = small(mapping.withColumnRenamed("label", "_label"))
    out = df.join(m, F.lower(F.col(rel)) == F.col("_label"), "left")
    swap = F.coalesce("swap", F.lit(False))
    return out.select(
        *[c for c in df.columns if c not in ("start", "end", rel)],
        F.when(swap, F.col("end")).otherwise(F.col("start")).alias("start"),
        F.when(swap, F.col("start")).otherwise(F.col("end")).alias("end"),
        F.coalesce("mapped", rel).alias(rel),
        F.coalesce("negated", F.lit(False)).alias("negated"),
    )


def without_classes(df: DataFrame, ignored: list[str], pos: str = "pos") -> DataFrame:
    """Rows whose lower-cased class is not rejected; rows without a class stay."""
    return df.where(F.col(pos).isNull() | ~F.lower(pos).isin([c.lower() for c in ignored]))


def with_aliases(df: DataFrame, aliases: dict[str, str], pos: str = "pos") -> DataFrame:
    """A row more for each class that has an alias."""
    if not aliases:
        return df
    alias = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])[F.col(pos)]
    return df.withColumn(pos, F.explode(F.when(alias.isNull(), F.array(pos)).otherwise(F.array(F.col(pos), alias))))


def class_edges(tree: dict, parent: str | None = None) -> list[tuple[str, str | None, str | None]]:
    """(class, parent, alias) rows of a nested class tree."""
    out = []
    for name, body in tree.items():
        if name in STRUCTURE:
            continue
        body = body if isinstance(body, dict) else {}
        out.append((name, parent, body.get("sameAs")))
        out += class_edges(body.get("classes", {}), name)
        out += class_edges({k: v for k, v in body.items() if isinstance(v, dict)}, name)
    return out


def class_table(spark: SparkSession, tree: dict) -> DataFrame:
    return spark.createDataFrame(class_edges(tree), "class string, parent string, alias string")


def all_keys(tree: dict) -> list[str]:
    """All keys of a nested dict, outer ones first."""
    out = []
    for k, v in tree.items():
        out.append(k)
        if isinstance(v, dict):
            out += all_keys(v)
    return out


def ancestors(spark: SparkSession, classes: DataFrame) -> DataFrame:
    """(class, ancestor, depth) by a recursive query; the tree has no cycle, and 64 levels at most."""
    classes.select("class", "parent").where("parent is not null").createOrReplaceTempView("_class_edges")
    return spark.sql("""
        with recursive up(class, ancestor, depth) as (
          select class, parent, 1 from _class_edges
          union all
          select up.class, e.parent, up.depth + 1 from up join _class_edges e on up.ancestor = e.class where up.depth < 64)
        select class, ancestor, depth from up""")


def dangling(mapping: DataFrame, target: str, classes: DataFrame) -> DataFrame:
    """Mapping rows whose target is no class."""
    return mapping.join(classes.select(F.col("class").alias("_class")), F.col(target) == F.col("_class"), "left_anti")


def reversed_map(mapping: DataFrame) -> DataFrame:
    """(mapped, originals) with the swap flag of each label."""
    return mapping.groupBy("mapped").agg(F.array_sort(F.collect_list(F.struct("label", "swap"))).alias("originals"))


def probability_table(mapping: DataFrame, p: float = 0.9) -> DataFrame:
    """(label, mapped, p) of mappings that are neither negated nor swapped."""
    return mapping.where("not negated and not swap").select("label", "mapped", F.lit(p).alias("p"))


def clique_leader(members: DataFrame) -> DataFrame:
    """(clique, leader): isA where it is a member, else the first name."""
    return members.groupBy("clique").agg(F.coalesce(F.max(F.when(F.col("name") == "isA", F.col("name"))), F.min("name")).alias("leader"))
