"""Sources to knowledge tables. A loader is a function to a KG of four tables, keyed by term, class and sense.

concepts (term, pos, sense, source, seq), relations (start_*, rel, end_*, weight, source, seq), properties and urls.
assemble() unites them, first source first, gives keys, and drops what repeats.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions.textnorm import normalise_term, sense_token
from kgloom.operators import dedup
from kgloom.session import small, staged

ENDS = ("term", "pos", "sense")
C, R, P, U = "term string, pos string, sense string", "s_term string, s_pos string, s_sense string, rel string, e_term string, e_pos string, e_sense string, weight float", "term string, pos string, sense string, type string, value string", "term string, pos string, sense string, url string"


@dataclass
class KG:
    """One source's tables; None where it has none."""

    source: str
    concepts: DataFrame
    relations: DataFrame | None = None
    properties: DataFrame | None = None
    urls: DataFrame | None = None
    extra: dict = field(default_factory=dict)


def _edge(df: DataFrame, s: tuple, rel, e: tuple, weight=1.0) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(*[col(x).cast("string").alias(f"s_{n}") for x, n in zip(s, ENDS)], col(rel).alias("rel"), *[col(x).cast("string").alias(f"e_{n}") for x, n in zip(e, ENDS)], col(weight).cast("float").alias("weight"))


def _concept(df: DataFrame, term, pos, sense=None) -> DataFrame:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(col(term).alias("term"), col(pos).cast("string").alias("pos"), col(sense).cast("string").alias("sense"))


def _ends(relations: DataFrame) -> DataFrame:
    return relations.select(F.explode(F.array(*[F.struct(*[F.col(f"{x}_{n}").alias(n) for n in ENDS]) for x in "se"])).alias("c")).select("c.*")


def commonsense(edges: DataFrame, lang: str = "en") -> KG:
    """Assertions of one language. Rows of an external URL become urls of their start; a URL with # is dropped."""
    url = F.col("rel") == "ExternalURL"
    kept = edges.where(~F.col("rel").contains("dbpedia/") & (F.col("start_lang") == lang) & (url | (F.col("end_lang") == lang)) & ~(url & F.col("end_uri").contains("#")) & (F.col("start_surface") != ""))
    s = (F.col("start_surface"), F.col("start_pos"), sense_token("start_pos", "start_subsense"))
    e = (F.col("end_surface"), F.col("end_pos"), sense_token("end_pos", "end_subsense"))
    rel = _edge(kept.where(~url), s, F.col("rel"), e, F.col("weight"))
    links = kept.where(url).select(*[c.alias(n) for c, n in zip(s, ENDS)], F.col("end_uri").alias("url"))
    return KG("ConceptNet", _ends(rel).unionByName(links.select(*ENDS)), rel, None, links)


def lemma_patterns(classes: list[str], properties: list[str]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(name, pattern) of classes, split at changes of case, and of properties; each a prefix at a word's start."""
    words = lambda c: re.sub(r"([a-z](?=[A-Z])|[A-Z](?=[A-Z][a-z]))", r"\1 ", c).lower()
    return [(c, rf"(?i)\b\Q{words(c)}\E") for c in classes], [(p, rf"(?i)\b\Q{p}\E") for p in properties]


def matched(texts: Column, patterns: list[tuple[str, str]]) -> Column:
    """Z3: distinct names whose pattern some text has, in the patterns' order."""
    has = lambda p: F.exists(texts, lambda t: t.rlike(p))
    return F.array_compact(F.array(*[F.when(has(p), F.lit(n)) for n, p in patterns])) if patterns else F.array().cast("array<string>")


def participles(props: Column) -> Column:
    """Participle with present, or else with past, becomes one property."""
    has = lambda p: F.array_contains(props, p)
    joined = lambda t: F.array_union(F.filter(props, lambda x: ~x.isin(t, "participle")), F.array(F.lit(f"{t} participle")))
    return F.when(has("participle") & has("present"), joined("present")).when(has("participle") & has("past"), joined("past")).otherwise(props)


def target_pos(df: DataFrame, word_pos: DataFrame, target: str, source_pos: str, kind: str) -> DataFrame:
    """Df with a row for each class of the target (target_pos).

    related and derived take the target's own classes and drop unknown targets. Other relations keep the source's class
    where the target has it or is unknown, and else take the target's own. word_pos (word, classes array), A7.
    """
    w = word_pos.select(F.col("word").alias("_w"), "classes")
    own = F.col(kind).isin("related", "derived")
    same = F.array(F.col(source_pos))
    got = F.when(own, F.coalesce("classes", F.array().cast("array<string>"))).when(F.col("classes").isNull() | F.array_contains("classes", F.col(source_pos)), same).otherwise(F.col("classes"))
    return df.join(w, F.col(target) == F.col("_w"), "left").withColumn("target_pos", F.explode(got)).drop("_w", "classes")


def word_classes(entries: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """(word, classes) over all languages; the map is looked up as the label is written."""
    from kgloom.operators.mapping import map_pos

    e = entries.where("word is not null and pos is not null").select("word", "pos")
    e = map_pos(e, mapping) if mapping is not None else e
    return e.groupBy("word").agg(F.array_sort(F.collect_set("pos")).alias("classes"))


def dictionary(entries: DataFrame, relations: tuple[str, ...], lemmas: dict[str, dict] | None = None, mapping: DataFrame | None = None, lang: str = "en") -> KG:
    """Entries of one language; classes from categories and senses, properties from categories and tags, relation fields.

    lemmas: {class: {"classes": [...], "properties": [...]}}. A sense that says unrelated makes neqTo.
    """
    from kgloom.operators.mapping import map_pos

    words = word_classes(entries, mapping)
    rows = entries.where((F.col("lang_code") == lang) & (F.col("word") != ""))
    rows = map_pos(rows, mapping) if mapping is not None else rows
    empty = F.array().cast("array<string>")
    cats, tags = F.coalesce("categories", empty), F.coalesce("tags", empty)
    senses = F.flatten(F.transform(F.coalesce("senses", F.array().cast("array<struct<categories:array<string>>>")), lambda s: F.coalesce(s["categories"], empty)))
    classes, props = F.array("pos"), empty
    for name, spec in (lemmas or {}).items():
        c, p = lemma_patterns(spec.get("classes", []), spec.get("properties", []))
        here = F.col("pos") == name
        found = matched(F.concat(cats, senses), c)
        classes = F.when(here & (F.size(found) > 0), found).otherwise(classes)
        props = F.when(here, participles(matched(F.concat(cats, tags), p))).otherwise(props) if c else props
    rows = rows.withColumn("_classes", classes).withColumn("_props", props)
    typed = rows.withColumn("class", F.explode("_classes"))
    concepts = _concept(typed, F.col("word"), F.col("class"))
    properties = typed.select(F.col("word").alias("term"), F.col("class").alias("pos"), F.lit(None).cast("string").alias("sense"), F.explode("_props").alias("type"), F.lit("true").alias("value"))
    each = typed.select("word", "class", F.explode(F.array(*[F.struct(F.lit(r).alias("kind"), F.col(r).alias("items")) for r in relations])).alias("f")).select("word", "class", "f.kind", F.explode("f.items").alias("i"))
    each = each.select("word", "class", "kind", F.col("i.word").alias("target"), F.when(F.lower(F.coalesce("i.sense", F.lit(""))).contains("unrelated"), "neqTo").otherwise(F.col("kind")).alias("rel")).where("target != ''")
    each = target_pos(each, words, "target", "class", "kind")
    rel = _edge(each, (F.col("word"), F.col("class"), None), F.col("rel"), (F.col("target"), F.col("target_pos"), None))
    return KG("Wiktionary", concepts.unionByName(_ends(rel)), rel, properties, None)


def synsets(rows: DataFrame) -> DataFrame:
    """(synset, pos, lexical_domain, phrase_type, lemma, uri): a lemma's URI is the member's where their text agrees.

    rows (synset, lemma, member, pos, lexical_domain, phrase_type); a member's name is the last segment without its last two characters.
    """
    name = F.regexp_replace(F.substring_index("member", "/", -1), r"..$", "")
    same = F.lower("lemma") == F.lower(F.replace(F.try_url_decode(name), F.lit("_"), F.lit(" ")))
    return rows.groupBy("synset", "lemma").agg(F.min("pos").alias("pos"), F.coalesce(F.min("lexical_domain"), F.lit("")).alias("lexical_domain"), F.min("phrase_type").alias("phrase_type"), F.coalesce(F.max(F.when(same, F.col("member"))), F.col("synset")).alias("uri"))


def wordnet(members: DataFrame, relations: DataFrame, mapped: DataFrame) -> KG:
    """Synsets (see synsets()), typed relations (synset, rel, other) and known relation labels (label).

    A labelled synset's class is its domain's part of speech, and its lemmas relate to the domain; lemmas of a synset are eq.
    """
    labelled = ~F.col("lexical_domain").isin("", "unlabeled")
    pos = F.when(F.col("pos") == "phrase", F.coalesce("phrase_type", F.lit("Phrase"))).when(labelled, F.substring_index("lexical_domain", ".", 1)).otherwise(F.col("pos"))
    m = members.select("synset", "lemma", "uri", pos.alias("pos"), F.when(labelled, F.col("lexical_domain")).alias("sense"))
    one = (F.col("lemma"), F.col("pos"), F.col("sense"))
    domain = _edge(m.where("sense is not null"), one, "relatedTo", (F.substring_index("sense", ".", -1), F.col("pos"), None))
    a, b = m.select("synset", *[F.col(c).alias(f"a_{c}") for c in ("lemma", "pos", "sense")]), m.select("synset", *[F.col(c).alias(f"b_{c}") for c in ("lemma", "pos", "sense")])
    ends = lambda x: tuple(F.col(f"{x}_{c}") for c in ("lemma", "pos", "sense"))
    eq = _edge(a.join(b, "synset").where("a_lemma < b_lemma"), ends("a"), "eq", ends("b"))
    known = relations.join(small(mapped.select(F.lower("label").alias("_l"))), F.lower("rel") == F.col("_l"), "left_semi")
    fan = _edge(known.join(a, "synset").join(b.withColumnRenamed("synset", "other"), "other"), ends("a"), F.col("rel"), ends("b"))
    rel = domain.unionByName(eq).unionByName(fan)
    return KG("WordNet", _concept(m, F.col("lemma"), F.col("pos"), F.col("sense")).unionByName(_ends(rel)), rel, None, m.select(F.col("lemma").alias("term"), "pos", "sense", F.col("uri").alias("url")))


def phrase_parts(phrases: DataFrame, tags: DataFrame) -> DataFrame:
    """compositeFormWith edges from a phrase (term) to its words, with the classes of each word's tag.

    tags (word, classes array) stands for a tagger; a word without a tag has none and gives no edge.
    """
    parts = phrases.select("term", F.posexplode(F.split("term", r"\s+")).alias("i", "word")).where("word != ''")
    got = parts.join(tags, F.lower(parts["word"]) == F.lower(tags["word"])).select("term", parts["word"], F.explode("classes").alias("class"))
    return _edge(got, (F.col("term"), "Phrase", None), "compositeFormWith", (F.col("word"), F.col("class"), None))


def resolved_ids(ids: DataFrame, known: DataFrame, alternates: DataFrame) -> DataFrame:
    """(id, place): an id that is known, or the first known one along alternate ids.

    Links are doubled, so that the steps grow with the logarithm of the longest chain. Chains that end or come back give no
    row: once more steps are made than there are links, what is still open is a circle. Of several places of an alternate
    id, the least counts.
    """
    spark = ids.sparkSession
    known = known.select(F.col("id").alias("place")).distinct()
    links = alternates.where("alt_id is not null and place is not null").groupBy("alt_id").agg(F.min("place").alias("place"))
    # a known id leads nowhere, so that it is never passed
    links = staged(spark, links.join(known.select(F.col("place").alias("alt_id")), "alt_id", "left_anti"), "links")
    front, out, made, step, most = ids.select("id", F.col("id").alias("place")).distinct(), None, 0, 1, links.count()
    while True:
        hit = front.join(known, "place", "left_semi").select("id", "place")
        out = hit if out is None else out.unionByName(hit)
        if made > most:
            return out
        miss = front.join(known, "place", "left_anti")
        front = staged(spark, miss.join(links.select(F.col("alt_id").alias("place"), F.col("place").alias("_next")), "place").select("id", F.col("_next").alias("place")), "front")
        if front.isEmpty():
            return out
        made, step = made + step, 2 * step
        far = links.alias("a").join(links.alias("b"), F.col("a.place") == F.col("b.alt_id"), "left").select("a.alt_id", F.coalesce("b.place", "a.place").alias("place"))
        links = staged(spark, far, "links")


def geonames(places: DataFrame, hierarchy: DataFrame, alternates: DataFrame, links: DataFrame, features: DataFrame, ignored: DataFrame) -> KG:
    """Places keyed by id; feature instanceOf, alternates as properties, hierarchy partOf, links as urls.

    ignored (name) are compared after strip and lower. hierarchy (parent, child); features (code, label).
    """
    kept = places.join(small(ignored.select(F.lower(F.trim("name")).alias("_n"))), F.lower(F.trim("name")) == F.col("_n"), "left_anti")
    kept = kept.withColumn("pos", F.when(F.col("feature_class") == "A", "GPE").otherwise("LOC"))
    one = (F.col("name"), F.col("pos"), F.col("id"))
    f = kept.join(small(features), F.concat_ws(".", "feature_class", "feature_code") == F.col("code"))
    rel = _edge(f, one, "instanceOf", (F.col("label"), "Noun", None))
    pairs = hierarchy.where("parent != child")
    ids = resolved_ids(pairs.select(F.explode(F.array("parent", "child")).alias("id")), kept, alternates)
    named = ids.join(kept.select(F.col("id").alias("place"), "name", "pos"), "place")
    p, c = (named.select(F.col("id").alias(x), *[F.col(n).alias(f"{x}_{n}") for n in ("name", "pos", "place")]) for x in ("parent", "child"))
    end = lambda x: tuple(F.col(f"{x}_{n}") for n in ("name", "pos", "place"))
    rel = rel.unionByName(_edge(pairs.join(p, "parent").join(c, "child"), end("child"), "partOf", end("parent")))
    props = kept.select(F.col("name").alias("term"), "pos", F.col("id").alias("sense"), F.lit("alternativeOf").alias("type"), F.explode(F.split("translations", ",")).alias("value")).where("value != '' and value != term")
    urls = kept.join(links.select(F.col("place").alias("id"), "url"), "id").select(F.col("name").alias("term"), "pos", F.col("id").alias("sense"), "url")
    return KG("GeoNames", _concept(kept, *one).unionByName(_ends(rel)), rel, props, urls)


def curated(lists: DataFrame, patterns: DataFrame | None = None, extra: dict[str, list[str]] | None = None, stations: DataFrame | None = None, source: str = "Curated") -> KG:
    """Word lists (term, pos), edge patterns, several classes for a list's class, and stations that are metro stations."""
    more = F.create_map(*[x for k, v in (extra or {"": [""]}).items() for x in (F.lit(k), F.array(*[F.lit(c) for c in v]))])[F.col("pos")]
    concepts = lists.select("term", F.explode(F.coalesce(more, F.array("pos"))).alias("pos"), F.lit(None).cast("string").alias("sense"))
    rel = None
    if patterns is not None:
        rel = _edge(patterns, (F.col("start"), F.col("start_pos"), None), F.col("rel"), (F.col("end"), F.col("end_pos"), None))
    if stations is not None:
        isa = _edge(stations, (F.col("term"), "LOC", None), "isA", ("metro station", "Noun", None))
        rel = isa if rel is None else rel.unionByName(isa)
    return KG(source, concepts if rel is None else concepts.unionByName(_ends(rel)), rel, None, None)


def assemble(parts: list[KG], unique_source: bool = False, keep_urls: bool = True) -> dict[str, DataFrame]:
    """One set of tables, first source first; the key of a concept is the md5 of term, class and sense.

    Terms are normalised; keys depend on content alone, so they are the same in any order of arrival.
    """
    def key(prefix=""):
        t, p, s = (F.col(prefix + n) for n in ENDS)
        return F.md5(F.concat_ws("\u0001", normalise_term(t), F.coalesce(p, F.lit("")), F.coalesce(s, F.lit(""))))

    def union(name):
        dfs = [getattr(k, name).withColumn("source", F.lit(k.source)) if getattr(k, name) is not None else None for k in parts]
        out = None
        for i, d in enumerate(dfs):
            if d is not None:
                d = d.withColumn("src_rank", F.lit(i))
                out = d if out is None else out.unionByName(d)
        return out

    concepts = union("concepts").withColumn("concept", key()).withColumn("term", normalise_term("term")).withColumn("seq", F.col("concept"))
    out = {"concepts": dedup.concepts(concepts, unique_source).select("concept", "term", "pos", "sense", "source")}
    if (r := union("relations")) is not None:
        r = r.withColumn("start", key("s_")).withColumn("end", key("e_")).withColumn("seq", F.col("start"))
        out["relations"] = dedup.relations(r, unique_source).select("start", "end", "rel", "weight", "source")
    if (p := union("properties")) is not None:
        p = p.withColumn("concept", key()).withColumn("seq", F.col("concept"))
        out["properties"] = dedup.properties(p, unique_source).select("concept", "type", "value", "source")
    if keep_urls and (u := union("urls")) is not None:
        u = u.withColumn("concept", key()).withColumn("seq", F.col("concept"))
        out["urls"] = dedup.urls(u, unique_source).select("concept", "url", "source")
    return out


def build(spark: SparkSession, parts: list[KG], edge_mapping: DataFrame | None = None, should_cluster: bool = True) -> dict[str, DataFrame]:
    """The whole build: tables, clusters, lifted and expanded relations, and triples."""
    from kgloom.operators import cluster as cl
    from kgloom.operators import mapping, rdf

    kg = assemble(parts, keep_urls=should_cluster)
    rel = kg.get("relations")
    if should_cluster and rel is not None and "urls" in kg:
        kg["clusters"] = cl.cluster(spark, kg["concepts"], kg["urls"])
        kg["lifted"] = cl.lift(rel, kg["clusters"])
        rel = cl.expand(kg["lifted"], kg["clusters"])
    if rel is not None:
        rel = mapping.map_relations(rel, edge_mapping) if edge_mapping is not None else rel.withColumn("negated", F.lit(False))
        rel = rdf.self_loops_dropped(rel, kg["concepts"].select("concept", F.col("term").alias("label")))
        predicates = rdf.reified(rel)
        props = kg.get("properties", kg["concepts"].limit(0).select("concept", F.lit("").alias("type"), F.lit("").alias("value")))
        kg["triples"] = rdf.export(kg["concepts"], rel, props, predicates)
    return kg
