"""Triples as rows (s, p, o, kind, dtype, lang), reified predicates, text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.textnorm import safe_uri
from kgloom.session import small

#: The vocabularies' names, and relations that never join a concept with one of the same label.
RDF_TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
RDFS_LABEL = "http://www.w3.org/2000/01/rdf-schema#label"
XSD = "http://www.w3.org/2001/XMLSchema#"
STRUCTURAL = ("partOf", "isA", "instanceOf")
BASE = "http://kgloom.example/"
TRIPLE = ("s", "p", "o", "kind", "dtype", "lang")


def self_loops_dropped(edges: DataFrame, labels: DataFrame, relations: tuple[str, ...] = STRUCTURAL) -> DataFrame:
    """Edges but structural ones whose ends have the same label after strip and lower. A null label equals none.

    labels (concept, label): of several labels of a concept the greatest counts.
    """
    names = labels.groupBy("concept").agg(F.lower(F.trim(F.max("label"))).alias("label"))
    a, b = names.select(F.col("concept").alias("start"), F.col("label").alias("_a")), names.select(F.col("concept").alias("end"), F.col("label").alias("_b"))
    out = edges.join(a, "start", "left").join(b, "end", "left")
    same = F.coalesce(F.col("_a") == F.col("_b"), F.lit(False))
    return out.where(~(F.col("rel").isin(*relations) & same)).select(*edges.columns)


def reified(edges: DataFrame, signature: tuple[str, ...] = ("negated", "weight")) -> DataFrame:
    """(rel, signature.., predicate): predicates numbered within a relation by the order of their signatures.

    Signatures are distinct before they are numbered, and numbered by ranges, so that a relation with very many weights is
    not in one task.
    """
    from kgloom.operators.stats import cumulated

    dims = cumulated(edges.select("rel", *signature).distinct().withColumn("_one", F.lit(1)), ["rel", *signature], "_one")
    first = dims.groupBy("rel").agg(F.min("before").alias("_first"))
    number = (F.col("before") - F.col("_first") + 1).cast("string")
    return dims.join(first, "rel").select("rel", *signature, F.concat("rel", number).alias("predicate"))


def with_predicates(edges: DataFrame, predicates: DataFrame, signature: tuple[str, ...] = ("negated", "weight")) -> DataFrame:
    return edges.join(predicates, ["rel", *signature])


def merged_predicates(predicates: DataFrame, signature: tuple[str, ...] = ("negated", "weight")) -> DataFrame:
    """(predicate, kept): of predicates with one relation and signature the least name in string order."""
    low = predicates.groupBy("rel", *signature).agg(F.min("predicate").alias("kept"))
    return predicates.join(low, ["rel", *signature]).select("predicate", "kept")


def inferred_tags(types: DataFrame, flags: DataFrame, tags: DataFrame) -> DataFrame:
    """(subject, tag) by relational division: subjects of a class that have all properties a tag asks of it.

    types (subject, class), flags (subject, property) of true properties, tags (tag, class, required array). A tag that
    asks none takes every subject of the class.
    """
    t = small(tags.withColumn("need", F.size(F.array_distinct("required"))))
    who = types.join(t, "class")
    free = who.where("need = 0").select("subject", "tag")
    asked = who.where("need > 0").withColumn("property", F.explode(F.array_distinct("required")))
    have = asked.join(flags.distinct(), ["subject", "property"], "left_semi").groupBy("subject", "tag", "class", "need").agg(F.countDistinct("property").alias("n"))
    return free.unionByName(have.where("n = need").select("subject", "tag")).distinct()


def clique(members: DataFrame, group: list[str], item: str) -> DataFrame:
    """(group.., a, b) of members of a group with a < b. Quadratic in a group by its meaning."""
    a, b = members.select(*group, F.col(item).alias("a")).distinct(), members.select(*group, F.col(item).alias("b")).distinct()
    return a.join(b, group).where("a < b")


def star(members: DataFrame, group: list[str], item: str) -> DataFrame:
    """G11 for large groups: (group.., a, b) from the least member to each other; the same components, linear in a group."""
    low = members.groupBy(*group).agg(F.min(item).alias("a"))
    return members.select(*group, F.col(item).alias("b")).distinct().join(low, group).where("a != b").select(*group, "a", "b")


def literal(value) -> dict:
    """Lexical form and datatype of a Python value; bool is tested before int."""
    if isinstance(value, bool):
        return {"o": str(value).lower(), "dtype": XSD + "boolean"}
    if isinstance(value, int):
        return {"o": str(value), "dtype": XSD + "integer"}
    if isinstance(value, float):
        return {"o": repr(value), "dtype": XSD + "double"}
    return {"o": str(value), "dtype": XSD + "string"}


def _rows(df: DataFrame, s, p, o, kind: str, dtype=None) -> DataFrame:
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(s.alias("s"), text(p).alias("p"), o.alias("o"), F.lit(kind).alias("kind"), (text(dtype) if dtype is not None else F.lit(None).cast("string")).alias("dtype"), F.lit(None).cast("string").alias("lang"))


def export(concepts: DataFrame, edges: DataFrame, properties: DataFrame, predicates: DataFrame) -> DataFrame:
    """Triples of concepts (types, labels, hub links), edges by reified predicates, predicates and properties.

    concepts (concept, term, pos, sense); edges (start, end, rel, negated, weight); properties (concept, type, value).
    """
    named = concepts.withColumn("uri", safe_uri("term", "sense", BASE)).withColumn("hub", safe_uri("term", None, BASE))
    out = _rows(named.where("pos is not null"), F.col("uri"), RDF_TYPE, F.concat(F.lit(BASE), "pos"), "iri")
    out = out.unionByName(_rows(named, F.col("uri"), RDFS_LABEL, F.col("term"), "literal", XSD + "string"))
    senses = named.where("uri != hub")
    out = out.unionByName(_rows(senses, F.col("uri"), BASE + "withSense", F.col("hub"), "iri")).unionByName(_rows(senses, F.col("hub"), RDFS_LABEL, F.col("term"), "literal", XSD + "string"))
    uri = named.select("concept", "uri")
    ends = with_predicates(edges, predicates).join(uri.select(F.col("concept").alias("start"), F.col("uri").alias("su")), "start").join(uri.select(F.col("concept").alias("end"), F.col("uri").alias("eu")), "end").where("su != eu")
    out = out.unionByName(_rows(ends, F.col("su"), F.concat(F.lit(BASE), "predicate"), F.col("eu"), "iri"))
    pred = F.concat(F.lit(BASE), F.col("predicate"))
    out = out.unionByName(_rows(predicates, pred, RDF_TYPE, F.concat(F.lit(BASE), "rel"), "iri")).unionByName(_rows(predicates, pred, BASE + "is_negated", F.col("negated").cast("string"), "literal", XSD + "boolean")).unionByName(_rows(predicates, pred, BASE + "weight", F.col("weight").cast("double").cast("string"), "literal", XSD + "double"))
    truth = F.lower("value").isin("true", "false")
    props = properties.join(uri, "concept")
    out = out.unionByName(_rows(props, F.col("uri"), safe_uri("type", None, BASE), F.when(truth, F.lower("value")).otherwise(F.col("value")), "literal", F.when(truth, XSD + "boolean").otherwise(XSD + "string")))
    return out.distinct()


def ntriples(triples: DataFrame) -> DataFrame:
    """K5: a line (value) per triple."""
    esc = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        esc = F.replace(esc, F.lit(a), F.lit(b))
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    tail = F.when(F.col("lang").isNotNull(), F.concat(F.lit("@"), "lang")).when(F.col("dtype").isNotNull() & (F.col("dtype") != XSD + "string"), F.concat(F.lit("^^<"), "dtype", F.lit(">"))).otherwise("")
    o = F.when(F.col("kind") == "literal", F.concat(F.lit('"'), esc, F.lit('"'), tail)).otherwise(node(F.col("o")))
    return triples.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), o, F.lit(".")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """K6: a line per subject and predicate with its objects joined by commas."""
    parts = ntriples(triples).select(F.split("value", " ", 3).alias("t"))
    o = F.regexp_replace(F.get("t", F.lit(2)), r" \.$", "")
    return parts.select(F.get("t", F.lit(0)).alias("s"), F.get("t", F.lit(1)).alias("p"), o.alias("o")).groupBy("s", "p").agg(F.concat(F.col("s"), F.lit(" "), F.col("p"), F.lit(" "), F.array_join(F.array_sort(F.collect_set("o")), ", "), F.lit(" .")).alias("value")).select("value")


def parse_ntriples(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Triples of N-Triples lines (value). Comments and blank lines are skipped; other lines that do not parse are too,
    or raise if strict."""
    pattern = r'^\s*(<[^>]*>|_:\S+)\s+(<[^>]*>)\s+(<[^>]*>|_:\S+|"(?:[^"\\]|\\.)*"(?:@[A-Za-z0-9\-]+|\^\^<[^>]*>)?)\s*\.\s*$'
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|$)"))
    ok = F.col("value").rlike(pattern)
    rows = rows.where(ok) if not strict else rows.withColumn("value", F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a triple: "), "value"))))
    part = lambda i: F.regexp_extract("value", pattern, i)
    o = part(3)
    bare = lambda c: F.regexp_replace(c, r"^<|>$", "")
    text = F.regexp_extract(o, r'^"((?:[^"\\]|\\.)*)"', 1)
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\\\", "\\")):
        text = F.replace(text, F.lit(a), F.lit(b))
    kind = F.when(o.startswith('"'), "literal").when(o.startswith("_:"), "bnode").otherwise("iri")
    none = lambda c: F.when(c != "", c)
    return rows.select(bare(part(1)).alias("s"), bare(part(2)).alias("p"), F.when(kind == "literal", text).otherwise(bare(o)).alias("o"), kind.alias("kind"), none(F.regexp_extract(o, r"\^\^<([^>]*)>$", 1)).alias("dtype"), none(F.regexp_extract(o, r'"@([A-Za-z0-9\-]+)$', 1)).alias("lang"))


#: How lines are cut into triples, and starts of lines that are skipped. "loose": three tokens, closing marks dropped;
#: "closed": lines that end in a full stop, at the first two blanks; "spaced": any line at the first two blanks; "uris": the
#: first three names in angle brackets; "iris": lines of three names in angle brackets with single blanks between.
LINES = {
    "loose": (r"^\s*(\S+)\s+(\S+)\s+(.+?)\s*[.;,]*\s*$", ("#", "@prefix")),
    "closed": (r"^\s*([^ ]*) ([^ ]*) (.*?)\s*\.\s*$", ()),
    "spaced": (r"^([^ ]*) ([^ ]*) (.*?)[ .]*$", ()),
    "uris": (r"^.*?<([^>]+)>.*?<([^>]+)>.*?<([^>]+)>", ()),
    "iris": (r"^<(.*?)> <(.*?)> <([^>]*)", ()),
}


def cut_lines(lines: DataFrame, style: str = "loose") -> DataFrame:
    """(s, p, o) of lines (value) as one of LINES cuts them; blank lines, skipped starts and lines that do not match give none."""
    pattern, skipped = LINES[style]
    rows = lines.where(F.col("value").rlike(pattern))
    for start in skipped:
        rows = rows.where(~F.ltrim("value").startswith(start))
    return rows.select(*[F.regexp_extract("value", pattern, i + 1).alias(c) for i, c in enumerate("spo")])


def sorted_lines(lines: DataFrame, unique: bool = False) -> DataFrame:
    """T4: (n, value): lines numbered from 1 in the order of their bytes, each once if unique. Sorted by ranges; nothing is gathered."""
    from kgloom.operators.stats import cumulated

    by = lines.groupBy("value").agg((F.lit(1) if unique else F.count(F.lit(1))).cast("long").alias("_n"))
    return cumulated(by, ["value"], "_n").select((F.col("before") + 1).alias("n"), "value", "_n").select(F.explode(F.sequence(F.col("n"), F.col("n") + F.col("_n") - 1)).alias("n"), "value")


def lookup(triples: DataFrame, s: str | None = None, p: str | None = None, o: str | None = None) -> DataFrame:
    """Triples that match the given parts."""
    for c, v in (("s", s), ("p", p), ("o", o)):
        if v is not None:
            triples = triples.where(F.col(c) == v)
    return triples


def without_blank_nodes(triples: DataFrame) -> DataFrame:
    """Triples without blank nodes."""
    return triples.where(~F.col("s").startswith("_:") & (F.col("kind") != "bnode"))


def flatten_construct(name: str, body: dict, base: str = BASE) -> list[tuple[str, str, str, str]]:
    """(s, p, o, kind) rows of a logical construct or rewriting rule; a nested dict is a blank node named by its path."""
    out: list[tuple[str, str, str, str]] = []

    def walk(node: str, path: str, value: dict) -> None:
        for k, v in value.items():
            for i, x in enumerate(v if isinstance(v, list) else [v]):
                if isinstance(x, dict):
                    child = f"_:{path}.{k}.{i}".replace(" ", "_")
                    out.append((node, base + k, child, "bnode"))
                    walk(child, f"{path}.{k}.{i}", x)
                else:
                    out.append((node, base + k, literal(x)["o"], "literal"))

    walk(base + name.replace(" ", "_"), name, body)
    return out


def constructs(spark: SparkSession, bodies: dict[str, dict]) -> DataFrame:
    return spark.createDataFrame([r for k, v in sorted(bodies.items()) for r in flatten_construct(k, v)], "s string, p string, o string, kind string")
