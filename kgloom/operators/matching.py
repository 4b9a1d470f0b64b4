"""Vocabularies to align, best matches of each label, and groups of scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgloom.functions.similarity import sequence_ratio
from kgloom.functions.textnorm import camel_words, fragment

SOURCE, CANONICAL = "http://kgloom.example/source#", "http://kgloom.example/canonical#"


def top_k(df: DataFrame, score: str, ties: list[str], k: int) -> DataFrame:
    """The k rows of the highest score, equal ones by the tie columns; a bounded report. Spark keeps k rows a task."""
    return df.orderBy(F.desc(score), *ties).limit(k)


def gloss(name: Column, glosses: dict[str, str] | None = None) -> Column:
    """What a class means: of a relation (lower-case name) its gloss or its words, of a part of speech its words."""
    known = F.create_map(*[F.lit(x) for kv in (glosses or {"": ""}).items() for x in kv])[name]
    relation = F.coalesce(known, F.concat(F.lit("the "), camel_words(name), F.lit(" relation")))
    return F.when(name.rlike("^[a-z]"), relation).otherwise(F.concat(F.lit("part-of-speech category: a "), camel_words(name)))


def vocabularies(gold: DataFrame, glosses: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Source (iri, label), canonical (iri, label, gloss) and reference tables of gold (source, target, kb, kind, swap, neg).

    Names that become one IRI are one class, with the least label. A correspondence of a name with itself, whatever the
    case, is an identity.
    """
    s = F.concat(F.lit(SOURCE), F.col("kb"), F.lit("."), fragment("source"))
    c = F.concat(F.lit(CANONICAL), fragment("target"))
    source = gold.select(s.alias("iri"), camel_words("source").alias("label")).groupBy("iri").agg(F.min("label").alias("label"))
    canonical = gold.select(c.alias("iri"), camel_words("target").alias("label"), gloss(F.col("target"), glosses).alias("gloss")).groupBy("iri").agg(F.min("label").alias("label"), F.min("gloss").alias("gloss"))
    same = F.lower("source") == F.lower("target")
    reference = gold.select(s.alias("source_iri"), c.alias("canonical_iri"), "kind", F.when(same, "identity").otherwise("nonidentity").alias("class"), "swap", "neg")
    return {"source": source, "canonical": canonical, "reference": reference}


def _tokens(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), 1))


def token_candidates(sources: DataFrame, canonical: DataFrame) -> DataFrame:
    """(source, target, source_label, target_label, jaccard) of labels that share a token; tables (iri, label).

    An equi-join on tokens with the shared ones counted, so that only pairs with a positive Jaccard are made.
    """
    side = lambda df, name: df.select(F.col("iri").alias(name), F.col("label").alias(f"{name}_label"), _tokens("label").alias("t")).select("*", F.size("t").alias(f"{name}_n"), F.explode("t").alias("token")).drop("t")
    both = side(sources, "source").join(side(canonical, "target"), "token")
    pairs = both.groupBy("source", "target", "source_label", "target_label", "source_n", "target_n").agg(F.count(F.lit(1)).alias("common"))
    return pairs.select("source", "target", "source_label", "target_label", (F.col("common") / (F.col("source_n") + F.col("target_n") - F.col("common"))).alias("jaccard"))


def lexical(sources: DataFrame, canonical: DataFrame) -> DataFrame:
    """(source, target, score): the greater of the token Jaccard and the matching-blocks ratio, of labels that share a token.

    Labels without a common token are no candidates: their ratio comes from single letters.
    """
    p = token_candidates(sources, canonical)
    return p.select("source", "target", F.greatest("jaccard", sequence_ratio(F.lower("source_label"), F.lower("target_label"))).alias("score"))


def best(scores: DataFrame, k: int = 1) -> DataFrame:
    """(source, rank, target, score) of the k best targets of each source, equal scores by the smaller target."""
    w = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("source", "rank", "target", "score")


def judged(found: DataFrame, reference: DataFrame) -> DataFrame:
    """The best target of each reference row with whether it is right; sources without a match are wrong."""
    one = found.where("rank = 1").select(F.col("source").alias("source_iri"), F.col("target").alias("predicted"))
    return reference.join(one, "source_iri", "left").withColumn("correct", F.coalesce(F.col("predicted") == F.col("canonical_iri"), F.lit(False)))


def grouped(pairs: list[tuple[str, str, float]], size: int = 3) -> list[tuple[list[str], float]]:
    """(keywords, total gain) of groups grown around the better connected end of a pair, for a short report's pairs.

    Pairs come best first. A pair is passed over if one of its keywords is in a group. A group takes the pivot's partners in
    the order of the pairs until it has `size` keywords; its total is that of all pairs within it.
    """
    partners: dict[str, list[str]] = {}
    gain: dict[frozenset, float] = {}
    for a, b, g in pairs:
        partners.setdefault(a, []).append(b)
        partners.setdefault(b, []).append(a)
        gain[frozenset((a, b))] = g
    out, taken = [], set()
    for a, b, _ in pairs:
        if taken & {a, b}:
            continue
        pivot = max((a, b), key=lambda k: len(partners[k]))
        words = list(dict.fromkeys([pivot, *partners[pivot]]))[: max(size, 2)]
        if len(words) > 1:
            taken.update(words)
            out.append((words, sum(gain.get(frozenset((x, y)), 0.0) for i, x in enumerate(words) for y in words[i + 1 :])))
    return sorted(out, key=lambda g: -g[1])
