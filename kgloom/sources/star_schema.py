"""The driver's tables seen as a knowledge graph: vertices are strings of a prefix and a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.session import table


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


def concepts(spark: SparkSession, d: str) -> DataFrame:
    """(concept, term, pos, sense, source)."""
    t = lambda n: table(spark, d, n)
    c = lambda df, p, k, term, pos, sense=None: df.select(_key(p, k).alias("concept"), F.col(term).alias("term"), F.lit(pos).alias("pos"), (sense if sense is not None else F.lit("")).alias("sense"), F.lit(df_name(p)).alias("source"))
    return (
        c(t("region"), "r", "r_regionkey", "r_name", "GPE")
        .unionByName(c(t("nation"), "n", "n_nationkey", "n_name", "GPE"))
        .unionByName(c(t("supplier"), "s", "s_suppkey", "s_name", "Noun"))
        .unionByName(c(t("customer"), "c", "c_custkey", "c_name", "Noun"))
        .unionByName(c(t("part"), "p", "p_partkey", "p_name", "Noun", F.concat(F.lit("noun."), F.lower("p_type"))))
    )


def df_name(prefix: str) -> str:
    return {"r": "region", "n": "nation", "s": "supplier", "c": "customer", "p": "part"}[prefix]


def relations(spark: SparkSession, d: str) -> DataFrame:
    """(start, end, rel, weight double, source)."""
    t = lambda n: table(spark, d, n)
    e = lambda df, s, rel, o, w, src: df.select(s.alias("start"), o.alias("end"), F.lit(rel).alias("rel"), w.cast("double").alias("weight"), F.lit(src).alias("source"))
    one = F.lit(1.0)
    sold = t("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return (
        e(t("nation"), _key("n", "n_nationkey"), "PartOf", _key("r", "n_regionkey"), one, "nation")
        .unionByName(e(t("customer"), _key("c", "c_custkey"), "AtLocation", _key("n", "c_nationkey"), one, "customer"))
        .unionByName(e(t("supplier"), _key("s", "s_suppkey"), "AtLocation", _key("n", "s_nationkey"), one, "supplier"))
        .unionByName(e(sold, _key("s", "l_suppkey"), "product", _key("p", "l_partkey"), F.col("n"), "lineitem"))
    )


def part_urls(spark: SparkSession, d: str) -> DataFrame:
    """(concept, url): parts and the orders that hold them."""
    return table(spark, d, "lineitem").select(_key("p", "l_partkey").alias("concept"), _key("o", "l_orderkey").alias("url")).distinct()


def shipment_urls(spark: SparkSession, d: str) -> DataFrame:
    """(concept, url): parts and the shipments that hold them, a supplier's share of an order. Few parts share one, so clusters stay small."""
    return table(spark, d, "lineitem").select(_key("p", "l_partkey").alias("concept"), F.concat(_key("o", "l_orderkey"), F.lit("/"), F.col("l_suppkey").cast("string")).alias("url")).distinct()


def doc_urls(spark: SparkSession, d: str) -> DataFrame:
    """(concept, url): documents and the md5 of their text."""
    return table(spark, d, "documents").select(_key("d", "doc_id").alias("concept"), F.md5("text").alias("url"))


def page_urls(spark: SparkSession, d: str) -> DataFrame:
    """(concept, url): pages and the targets of their links."""
    return table(spark, d, "pages").select(_key("g", "page_id").alias("concept"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), 1)).alias("url")).distinct()


def page_triples(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, o): links of pages."""
    return page_urls(spark, d).select(F.col("concept").alias("s"), F.lit("linksTo").alias("p"), F.concat(F.lit("h:"), "url").alias("o"))


def triples(spark: SparkSession, d: str) -> DataFrame:
    """(s, p, o) of the relations, in angle brackets."""
    iri = lambda c: F.concat(F.lit("<http://kgloom.example/"), F.col(c), F.lit(">"))
    return relations(spark, d).select(iri("start").alias("s"), iri("rel").alias("p"), iri("end").alias("o"))


#: The same views as SQL.
SQL = {
    "concepts": """select 'r:' || r_regionkey as concept, r_name as term, 'GPE' as pos, '' as sense, 'region' as source from region
union all select 'n:' || n_nationkey, n_name, 'GPE', '', 'nation' from nation
union all select 's:' || s_suppkey, s_name, 'Noun', '', 'supplier' from supplier
union all select 'c:' || c_custkey, c_name, 'Noun', '', 'customer' from customer
union all select 'p:' || p_partkey, p_name, 'Noun', 'noun.' || lower(p_type), 'part' from part""",
    "relations": """select 'n:' || n_nationkey as "start", 'r:' || n_regionkey as "end", 'PartOf' as rel, 1.0::double as weight, 'nation' as source from nation
union all select 'c:' || c_custkey, 'n:' || c_nationkey, 'AtLocation', 1.0::double, 'customer' from customer
union all select 's:' || s_suppkey, 'n:' || s_nationkey, 'AtLocation', 1.0::double, 'supplier' from supplier
union all select 's:' || l_suppkey, 'p:' || l_partkey, 'product', count(*)::double, 'lineitem' from lineitem group by l_suppkey, l_partkey""",
    "part_urls": "select distinct 'p:' || l_partkey as concept, 'o:' || l_orderkey as url from lineitem",
    "shipment_urls": "select distinct 'p:' || l_partkey as concept, 'o:' || l_orderkey || '/' || l_suppkey as url from lineitem",
    "doc_urls": "select 'd:' || doc_id as concept, md5(text) as url from documents",
    "page_urls": """select distinct concept, url from (select 'g:' || page_id as concept, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as url from pages)""",
}
SQL["page_triples"] = f"select concept as s, 'linksTo' as p, 'h:' || url as o from ({SQL['page_urls']})"
SQL["triples"] = f"""select '<http://kgloom.example/' || "start" || '>' as s, '<http://kgloom.example/' || rel || '>' as p, '<http://kgloom.example/' || "end" || '>' as o from ({SQL['relations']})"""
