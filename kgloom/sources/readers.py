"""Readers and writers of source files, as plain Spark sources with explicit schemas."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.textnorm import class_of_file, percent_quote, uri_parts
from kgloom.operators.rdf import parse_ntriples, turtle  # noqa: F401

EDGE = "uri string, rel string, start string, end string, data string"
PLACE = "id string, name string, ascii string, translations string, lat string, lon string, feature_class string, feature_code string"
RELATIONS = ("synonyms", "antonyms", "hypernyms", "hyponyms", "holonyms", "meronyms", "troponyms", "coordinate_terms", "related", "derived", "abbreviations")
ENTRY = "word string, lang_code string, pos string, categories array<string>, tags array<string>, senses array<struct<categories:array<string>>>, " + ", ".join(f"{r} array<struct<word:string,sense:string>>" for r in RELATIONS)


def commonsense_edges(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated assertions with decoded URIs; the surface form of an end is JSON's, else its URI's term."""
    raw = spark.read.schema(EDGE).option("sep", "\t").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    data = F.from_json("data", "weight double, surfaceStart string, surfaceEnd string")
    a, b = uri_parts("start"), uri_parts("end")
    rel = F.element_at(F.split("rel", "/"), -1)
    return raw.withColumn("_d", data).select(
        "uri", F.when(F.col("rel").contains("dbpedia/"), F.col("rel")).otherwise(rel).alias("rel"), F.col("end").alias("end_uri"),
        *[v.alias(f"start_{k}") for k, v in a.items()], *[v.alias(f"end_{k}") for k, v in b.items()],
        F.coalesce("_d.surfaceStart", a["term"]).alias("start_surface"), F.coalesce("_d.surfaceEnd", b["term"]).alias("end_surface"), F.coalesce("_d.weight", F.lit(1.0)).alias("weight"),
    )


def triples(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """An N-Triples file or folder."""
    return parse_ntriples(spark.read.text(path), strict)


def dictionary(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """S3: entries of a JSON array, or of JSON lines."""
    return spark.read.schema(ENTRY).option("multiLine", not lines).json(path)


def reduced_dictionary(spark: SparkSession, path: str, lang: str = "en") -> DataFrame:
    """JSON lines of one language with the declared fields only; lines that are no JSON are dropped."""
    return spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(path).where(F.col("lang_code") == lang)


def places(spark: SparkSession, path: str) -> DataFrame:
    """The first eight columns of a places file."""
    return spark.read.schema(PLACE).option("sep", "\t").option("quote", "").csv(path)


def place_tables(hierarchy: DataFrame, alternates: DataFrame) -> dict[str, DataFrame]:
    """Children of parents, the last place of an alternate id, and the last link of a place.

    hierarchy (parent, child), a parent of itself dropped; alternates (line, alt_id, place, kind, name), kind link for URLs.
    """
    last = lambda key, value: F.max_by(value, "line").alias(key)
    return {
        "hierarchy": hierarchy.where("parent != child").groupBy("parent").agg(F.array_sort(F.collect_set("child")).alias("children")),
        "alternates": alternates.groupBy("alt_id").agg(last("place", "place")),
        "links": alternates.where("kind = 'link'").groupBy("place").agg(last("url", "name")),
    }


def word_lists(spark: SparkSession, path: str, trim: bool = False) -> DataFrame:
    """(term, pos) of text files, a term a line; the class comes from the file's name."""
    rows = spark.read.text(path).select(F.trim("value").alias("term"), F.input_file_name().alias("file"))
    return rows.where("term != ''").select("term", class_of_file(F.url_decode("file"), trim).alias("pos"))


def keyed_words(spark: SparkSession, path: str, trim: bool = False) -> DataFrame:
    """(term, pos, property, value) of JSON objects by term; keys that start with two underscores are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,string>>").alias("m"), F.input_file_name().alias("file"))
    terms = rows.select(F.explode("m").alias("term", "props"), class_of_file(F.url_decode("file"), trim).alias("pos")).where(~F.col("term").startswith("__"))
    return terms.select("term", "pos", F.explode_outer("props").alias("property", "value"))


def edge_patterns(lines: DataFrame) -> DataFrame:
    """(start, start_pos, rel, end, end_pos) of lines (t1^(pos1))-[rel]->(t2^(pos2))."""
    pattern = r"^\((.*?)\^\((.*?)\)\)-\[(.*?)\]->\((.*?)\^\((.*?)\)\)"
    t = F.trim("value")
    return lines.where(t.rlike(pattern)).select(*[F.regexp_extract(t, pattern, i + 1).alias(c) for i, c in enumerate(("start", "start_pos", "rel", "end", "end_pos"))])


#: Prefixes and predicates of resource dumps.
RESOURCE, ENTITY = "http://dbpedia.org/resource/", "http://www.wikidata.org/entity/"
LABEL, TYPE = "http://www.w3.org/2000/01/rdf-schema#label", "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"


def _labels(lines: DataFrame, prefix: str, lang: str) -> DataFrame:
    pattern = rf'^\s*<(\Q{prefix}\E[^>]+)>\s+<\Q{LABEL}\E>\s+"((?:[^"\\]|\\.)*)"@\Q{lang}\E\s*\.\s*$'
    text = F.replace(F.replace(F.regexp_extract("value", pattern, 2), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return lines.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("uri"), text.alias("label"))


def resources(labels: DataFrame, types: DataFrame, lang: str, ignored: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Labels (uri, label) of resources in a language, and types (uri, type) of those that have one; lines are N-Triples (value)."""
    named = _labels(labels, RESOURCE, lang)
    pattern = rf"^\s*<(\Q{RESOURCE}\E[^>]+)>\s+<\Q{TYPE}\E>\s+<([^>]+)>\s*\.\s*$"
    rows = types.where(F.col("value").rlike(pattern)).select(F.regexp_extract("value", pattern, 1).alias("uri"), F.regexp_extract("value", pattern, 2).alias("type"))
    kinds = (rows.where(~F.col("type").isin(*ignored)) if ignored else rows).distinct().join(named.select("uri").distinct(), "uri", "left_semi")
    return {"labels": named, "types": kinds}


def entity_labels(lines: DataFrame, lang: str) -> DataFrame:
    """(uri, label) of numbered entities."""
    return _labels(lines, ENTITY + "Q", lang)


def property_labels(spark: SparkSession, path: str, allowed: DataFrame | None = None) -> DataFrame:
    """(uri, label) of a CSV of properties (id, label, description, datatype, counts); of the allowed ids (id) only."""
    p = spark.read.schema("id string, label string, description string, datatype string, counts string").csv(path)
    p = p if allowed is None else p.join(allowed.select(F.trim("id").alias("id")), "id", "left_semi")
    return p.select(F.concat(F.lit(ENTITY), "id").alias("uri"), "label")


def edges_to_ntriples(edges: DataFrame, base: str = "http://kgloom.example/") -> DataFrame:
    """Lines of assertions, by surface form; rows without both ends are skipped."""
    iri = lambda c: F.concat(F.lit(f"<{base}"), percent_quote(F.replace(F.col(c), F.lit(" "), F.lit("_"))), F.lit(">"))
    return edges.where("start_surface != '' and end_surface != ''").select(F.concat_ws(" ", iri("start_surface"), iri("rel"), iri("end_surface"), F.lit(".")).alias("value"))


def language_lines(lines: DataFrame, lang: str, predicates: list[str]) -> DataFrame:
    """Lines of the given predicates whose object is no text or one in the language."""
    ok = F.lit(False)
    for p in predicates:
        ok = ok | F.col("value").contains(p)
    return lines.where(ok & (~F.col("value").contains('"@') | F.col("value").rlike(rf'"@{lang}\s*\.?\s*$')))


def benchmark(spark: SparkSession, path: str, columns: list[str], rows: int | None = None) -> DataFrame:
    """Benchmark CSVs of a fixed header; ValueError where the number of rows is not the expected."""
    df = spark.read.option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).schema(", ".join(f"`{c}` string" for c in columns)).csv(path)
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows instead of {rows}")
    return df


def append_benchmark(df: DataFrame, path: str, header: str) -> None:
    """K7: appends CSV rows; where the header table names other columns, the folder moves to .legacy first. Any store that Spark reads."""
    spark, names = df.sparkSession, ",".join(df.columns)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(hadoop.Path(header)) and spark.read.text(header).first()["value"] != names:
        fs.delete(hadoop.Path(path + ".legacy"), True)
        fs.rename(hadoop.Path(path), hadoop.Path(path + ".legacy"))
    spark.createDataFrame([(names,)], "value string").coalesce(1).write.mode("overwrite").text(header)
    df.write.mode("append").option("header", True).csv(path)


def save(tables: dict[str, DataFrame], folder: str) -> None:
    """Tables as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    """Tables of a saved folder."""
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def yaml_rows(df: DataFrame) -> str:
    """A YAML list of a small report's rows (JSON is YAML)."""
    return "".join(f"- {json.dumps(r.asDict(recursive=True), sort_keys=True, default=str)}\n" for r in df.collect())


def latex_table(df: DataFrame, digits: int = 3) -> str:
    """A LaTeX tabular of a small report's rows; null is N/A and the largest number of a column is bold."""
    rows = [list(r) for r in df.collect()]
    best = [max((r[i] for r in rows if isinstance(r[i], float)), default=None) for i in range(len(df.columns))]
    cell = lambda v, b: "N/A" if v is None else (f"\\textbf{{{v:.{digits}f}}}" if v == b else f"{v:.{digits}f}") if isinstance(v, float) else str(v).replace("_", r"\_").replace("&", r"\&")
    body = "".join(" & ".join(cell(v, b) for v, b in zip(r, best)) + " \\\\\n" for r in rows)
    return f"\\begin{{tabular}}{{{'l' * len(df.columns)}}}\n" + " & ".join(c.replace("_", r"\_") for c in df.columns) + " \\\\\n\\hline\n" + body + "\\end{tabular}\n"
