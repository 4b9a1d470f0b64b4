"""Queries of readers, loaders and exporters: source files are made from the driver's tables, read again, and held against SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.functions import textnorm
from kgloom.operators import analytics, audit, cluster, dedup, evaluate, explain, mapping, matching, rdf, retrieve, stats
from kgloom.plans.queries import QUERIES, S, query
from kgloom.session import cached, shared_dir, table
from kgloom.sources import loaders, readers, turtle
from kgloom.sources import star_schema as star


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/kgloom/{name}-{uuid.uuid4().hex}"


def _file(spark: SparkSession, lines: DataFrame, name: str, **options) -> str:
    """A folder of text files of the one string column of lines."""
    path = _folder(spark, name)
    lines.write.options(**options).text(path)
    return path


def _tab(*columns):
    return F.concat_ws("\t", *[F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).cast("string") for c in columns]).alias("value")


# S1, S11

@query("""select '/a/' || p_partkey as uri, case when p_size % 7 = 0 then '/r/dbpedia/genre' else 'IsA' end as rel, '/c/' || case when p_size % 5 = 0 then 'fr' else 'en' end || '/' || lower(p_type) as end_uri,
'en' as start_lang, replace(p_name, ' ', '_') as start_term, case when p_size % 2 = 0 then 'n' else 'c' end as start_pos, case when p_size % 2 = 0 then 'wn/' || lower(p_type) end as start_subsense,
case when p_size % 5 = 0 then 'fr' else 'en' end as end_lang, lower(p_type) as end_term, 'c' as end_pos, null::varchar as end_subsense, case when p_size % 3 = 0 then p_name else replace(p_name, ' ', '_') end as start_surface, lower(p_type) as end_surface, case when p_size % 3 = 0 then p_size::double else 1.0::double end as weight from part""")
def read_commonsense(spark, d):
    """Assertions of a tab-separated file."""
    return readers.commonsense_edges(spark, _commonsense_file(spark, d))


def _commonsense_file(spark, d):
    size = F.col("p_size")
    return _file(spark, table(spark, d, "part").select(_tab(
        F.concat(F.lit("/a/"), "p_partkey"), F.when(size % 7 == 0, "/r/dbpedia/genre").otherwise("/r/IsA"), F.concat(F.lit("/c/en/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.when(size % 2 == 0, F.concat(F.lit("/n/wn/"), F.lower("p_type"))).otherwise("")),
        F.concat(F.lit("/c/"), F.when(size % 5 == 0, "fr").otherwise("en"), F.lit("/"), F.lower("p_type")), F.when(size % 3 == 0, F.concat(F.lit('{"weight": '), size.cast("string"), F.lit(', "surfaceStart": "'), "p_name", F.lit('"}'))).otherwise("{}"),
    )), "assertions")


@query("""select '<http://kgloom.example/' || replace(p_name, ' ', '_') || '> <http://kgloom.example/' || case when p_size % 7 = 0 then '/r/dbpedia/genre' else 'IsA' end || '> <http://kgloom.example/' || lower(p_type) || '> .' as value from part""")
def assertions_to_lines(spark, d):
    """Assertions as N-Triples lines by surface form."""
    return readers.edges_to_ntriples(readers.commonsense_edges(spark, _commonsense_file(spark, d)))


# Z1, Z11-Z13, K1, K2, U7

_ASSEMBLED = """with a as (select p_name as term, case when p_size % 2 = 0 then 'n' else 'c' end as pos, case when p_size % 2 = 0 then 'n/wn/' || lower(p_type) end as sense, lower(p_type) as other, case when p_size % 3 = 0 then p_size::double else 1.0::double end as weight from part where p_size % 7 <> 0 and p_size % 5 <> 0),
c as (select distinct r_name as term, 'GPE' as pos, '' as sense, 'Curated' as source from region), n as (select distinct term, pos, coalesce(sense, '') as sense, 'ConceptNet' as source from (select replace(term, '_', ' ') as term, pos, sense from a union all select other, 'c', null from a)),
k as (select * from c union all select * from n where (term, pos, sense) not in (select (term, pos, sense) from c))"""


@query(f"""{_ASSEMBLED} select md5(term || chr(1) || pos || chr(1) || sense) as concept, term, pos, sense, source from k""")
def assembled_concepts(spark, d):
    """Concepts of two sources, keyed by content, the first source first."""
    return _assembled(spark, d)["concepts"]


@query(f"""{_ASSEMBLED} select distinct md5(replace(term, '_', ' ') || chr(1) || pos || chr(1) || coalesce(sense, '')) as "start", md5(other || chr(1) || 'c' || chr(1)) as "end", 'IsA' as rel, weight, 'ConceptNet' as source from a""")
def assembled_relations(spark, d):
    """Relations between the keys of content."""
    return _assembled(spark, d)["relations"].withColumn("weight", F.col("weight").cast("double"))


def _assembled(spark, d):
    lists = table(spark, d, "region").select(F.col("r_name").alias("term"), F.lit("GPE").alias("pos"))
    return loaders.assemble([loaders.curated(lists), loaders.commonsense(readers.commonsense_edges(spark, _commonsense_file(spark, d)))])


# S2, S10, S12, S13, Z24

_LINES = """with t as (select '<http://k.example/c' || c_custkey || '>' as s, case c_custkey % 4 when 0 then '<http://k.example/segment>' else '<http://k.example/in>' end as p, case c_custkey % 4 when 0 then '"' || c_mktsegment || '"@en' when 1 then '<http://k.example/n' || c_nationkey || '>' when 2 then '"' || c_nationkey || '"^^<http://www.w3.org/2001/XMLSchema#integer>' else '_:b' || c_nationkey end as o, c_custkey from customer)"""


def _triple_lines(spark, d):
    k = F.col("c_custkey") % 4
    o = F.when(k == 0, F.concat(F.lit('"'), "c_mktsegment", F.lit('"@en'))).when(k == 1, F.concat(F.lit("<http://k.example/n"), "c_nationkey", F.lit(">"))).when(k == 2, F.concat(F.lit('"'), "c_nationkey", F.lit('"^^<http://www.w3.org/2001/XMLSchema#integer>'))).otherwise(F.concat(F.lit("_:b"), "c_nationkey"))
    line = F.concat(F.lit("<http://k.example/c"), "c_custkey", F.lit("> <http://k.example/"), F.when(k == 0, "segment").otherwise("in"), F.lit("> "), o, F.lit(" ."))
    return table(spark, d, "customer").select(F.explode(F.array(line, F.when(F.col("c_custkey") % 10 == 0, "# note").otherwise(""))).alias("value"))


@query(f"""{_LINES} select substr(s, 2, length(s) - 2) as s, substr(p, 2, length(p) - 2) as p, case c_custkey % 4 when 0 then split_part(o, '"', 2) when 2 then split_part(o, '"', 2) when 1 then substr(o, 2, length(o) - 2) else o end as o, case c_custkey % 4 when 0 then 'literal' when 2 then 'literal' when 1 then 'iri' else 'bnode' end as kind, case when c_custkey % 4 = 2 then 'http://www.w3.org/2001/XMLSchema#integer' end as dtype, case when c_custkey % 4 = 0 then 'en' end as lang from t""")
def read_triples(spark, d):
    """N-Triples files, comments and blank lines skipped."""
    return readers.triples(spark, _file(spark, _triple_lines(spark, d), "triples"))


@query(f"""{_LINES} select substr(s, 2, length(s) - 2) as s, case c_custkey % 4 when 0 then 'literal' when 2 then 'literal' else 'iri' end as kind from t where c_custkey % 4 <> 3""")
def named_nodes(spark, d):
    """Triples without blank nodes."""
    return rdf.without_blank_nodes(readers.triples(spark, _file(spark, _triple_lines(spark, d), "triples"))).select("s", "kind")


@query(f"""{_LINES} select s || ' ' || p || ' ' || o || ' .' as value from t where c_custkey % 4 in (0, 1, 2, 3) and p = '<http://k.example/segment>'""")
def language_lines(spark, d):
    """Lines of some predicates with a text of the language or none."""
    return readers.language_lines(spark.read.text(_file(spark, _triple_lines(spark, d), "triples")), "en", ["<http://k.example/segment>"])


def _cut(style: str, sql: str):
    def cut(spark, d):
        return rdf.cut_lines(spark.read.text(_file(spark, _triple_lines(spark, d), "triples")), style)

    cut.__name__, cut.__doc__ = f"cut_lines_{style}", f"S12: lines cut in the way called {style}."
    query(sql)(cut)


_cut("loose", f"{_LINES} select s, p, o from t")
_cut("closed", f"{_LINES} select s, p, o from t")
_cut("spaced", f"{_LINES} select s, p, rtrim(o, ' .') as o from t")
_cut("uris", f"{_LINES} select substr(s, 2, length(s) - 2) as s, substr(p, 2, length(p) - 2) as p, case c_custkey % 4 when 1 then substr(o, 2, length(o) - 2) else 'http://www.w3.org/2001/XMLSchema#integer' end as o from t where c_custkey % 4 in (1, 2)")
_cut("iris", f"{_LINES} select substr(s, 2, length(s) - 2) as s, substr(p, 2, length(p) - 2) as p, substr(o, 2, length(o) - 2) as o from t where c_custkey % 4 = 1")


@query("""select 'http://k.example/n' || n_nationkey as s, unnest(['http://www.w3.org/1999/02/22-rdf-syntax-ns#type', 'http://k.example/label', 'http://k.example/label', 'http://k.example/region', 'http://k.example/key']) as p,
unnest(['http://k.example/Nation', n_name, lower(n_name), 'http://k.example/r' || n_regionkey, n_nationkey::varchar]) as o, unnest(['iri', 'literal', 'literal', 'iri', 'literal']) as kind, unnest([null, null, null, null, 'http://www.w3.org/2001/XMLSchema#integer']) as dtype, unnest([null, 'en', null, null, null]) as lang from nation""")
def read_turtle(spark, d):
    """Turtle files with prefixes, lists of predicates and of objects, comments and numbers."""
    n = table(spark, d, "nation")
    text = F.concat(F.lit("@prefix k: <http://k.example/> . # a nation\nk:n"), "n_nationkey", F.lit(' a k:Nation ;\n  k:label "'), "n_name", F.lit("\"@en , '"), F.lower("n_name"), F.lit("' ;\n  k:region k:r"), "n_regionkey", F.lit(" ; k:key "), "n_nationkey", F.lit(" .\n"))
    return turtle.turtle_triples(spark, _file(spark, n.select(text.alias("value")), "turtle"))


# S3, S4, Z2-Z4

def _entry():
    return F.struct(F.col("p_name").alias("word"), F.when(F.col("p_size") % 4 == 0, "fr").otherwise("en").alias("lang_code"), F.lower("p_type").alias("pos"), F.array(F.concat(F.lit("English "), F.lower("p_type"), F.lit(" things"))).alias("categories"), F.array(F.lit("present participle")).alias("tags"), F.array(F.struct(F.concat(F.lit("syn "), "p_brand").alias("word"), F.when(F.col("p_size") % 3 == 0, "unrelated").otherwise("").alias("sense"))).alias("synonyms"))


@query("""select p_name as word, case when p_size % 4 = 0 then 'fr' else 'en' end as lang_code, lower(p_type) as pos, 'English ' || lower(p_type) || ' things' as category, 'syn ' || p_brand as synonym from part""")
def read_dictionary(spark, d):
    """S3: entries of files that are one JSON array each."""
    arrays = table(spark, d, "part").groupBy("p_brand").agg(F.to_json(F.collect_list(_entry())).alias("value"))
    path = _folder(spark, "dictionary")
    arrays.write.partitionBy("p_brand").text(path)
    e = readers.dictionary(spark, path)
    return e.select("word", "lang_code", "pos", F.col("categories")[0].alias("category"), F.col("synonyms")[0]["word"].alias("synonym"))


@query("""select p_name as word, lower(p_type) as pos from part where p_size % 4 <> 0""")
def reduced_dictionary(spark, d):
    """JSON lines of one language; broken lines are dropped."""
    line = F.to_json(_entry())
    lines = table(spark, d, "part").select(F.explode(F.array(line, F.when(F.col("p_size") % 2 == 0, F.lit("{broken")).otherwise(""))).alias("value"))
    return readers.reduced_dictionary(spark, _file(spark, lines, "dictionary")).select("word", "pos")


_DICTIONARY = """with e as (select p_name as word, p_type as pos, p_brand, p_size from part where p_size % 4 <> 0), t as (select *, case when pos = 'PROMO' then 'PromoThing' else pos end as class from e)"""


def _dictionary(spark, d):
    e = table(spark, d, "part").select(F.col("p_name").alias("word"), F.when(F.col("p_size") % 4 == 0, "fr").otherwise("en").alias("lang_code"), F.col("p_type").alias("pos"), F.array(F.lit("English promo things")).alias("categories"), F.array(F.lit("present participle of it")).alias("tags"), F.lit(None).cast("array<struct<categories:array<string>>>").alias("senses"), F.array(F.struct(F.col("p_brand").alias("word"), F.when(F.col("p_size") % 3 == 0, "Unrelated sense").otherwise("").alias("sense"))).alias("synonyms"))
    return loaders.dictionary(e, ("synonyms",), {"PROMO": {"classes": ["PromoThing", "OtherThing"], "properties": ["present", "participle", "past"]}})


@query(f"""{_DICTIONARY} select word as s_term, class as s_pos, case when p_size % 3 = 0 then 'neqTo' else 'synonyms' end as rel, p_brand as e_term, class as e_pos from t""")
def dictionary_relations(spark, d):
    """Relation fields of dictionary entries, by the classes that their categories tell."""
    return _dictionary(spark, d).relations.select("s_term", "s_pos", "rel", "e_term", "e_pos")


@query(f"""{_DICTIONARY} select word as term, class as pos, 'present participle' as type, 'true' as value from t where pos = 'PROMO'""")
def dictionary_properties(spark, d):
    """Properties of entries; participle and present are one."""
    return _dictionary(spark, d).properties.select("term", "pos", "type", "value")


# S5, S6, Z8, P12, P16

_PLACES = """with p as (select s_suppkey as id, 'Place ' || (s_suppkey % 40) as name, case when s_suppkey % 3 = 0 then 'A' else 'P' end as cls, case when s_suppkey % 3 = 0 then 'ADM1' else 'PPL' end as code, s_suppkey from supplier), k as (select *, case when cls = 'A' then 'GPE' else 'LOC' end as pos from p where name <> 'Place 7')"""


def _places(spark, d):
    a = F.col("s_suppkey") % 3 == 0
    name = F.concat(F.lit("Place "), (F.col("s_suppkey") % 40).cast("string"))
    return readers.places(spark, _file(spark, table(spark, d, "supplier").select(_tab("s_suppkey", name, name, F.concat(F.lit("T"), "s_suppkey", F.lit(","), name), F.lit("0"), F.lit("0"), F.when(a, "A").otherwise("P"), F.when(a, "ADM1").otherwise("PPL"), F.lit("more"))), "places"))


@query(f"""{_PLACES} select id::varchar as id, name, 'T' || id || ',' || name as translations, cls as feature_class, code as feature_code from p""")
def read_places(spark, d):
    """The first eight columns of a places file."""
    return _places(spark, d).select("id", "name", "translations", "feature_class", "feature_code")


@query("""with h as (select s_suppkey // 3 as parent, s_suppkey as child from supplier), a as (select s_suppkey as line, s_suppkey % 7 as alt, s_suppkey as place, case when s_suppkey % 2 = 0 then 'link' else 'en' end as kind, 'n' || s_suppkey as name from supplier)
select 'hierarchy' as kind, parent::varchar as key, array_to_string(list_sort(list(child::varchar)), ',') as value from h where parent <> child group by parent union all select 'alternates', alt::varchar, arg_max(place, line)::varchar from a group by alt union all select 'links', place::varchar, arg_max(name, line) from a where kind = 'link' group by place""")
def place_tables(spark, d):
    """Children of parents, the last place of an alternate id, and links."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    h = s.select(F.floor(k / 3).cast("string").alias("parent"), k.cast("string").alias("child"))
    a = s.select(k.alias("line"), (k % 7).cast("string").alias("alt_id"), k.cast("string").alias("place"), F.when(k % 2 == 0, "link").otherwise("en").alias("kind"), F.concat(F.lit("n"), k).alias("name"))
    t = readers.place_tables(h, a)
    one = lambda name, key, value: t[name].select(F.lit(name).alias("kind"), F.col(key).alias("key"), value.alias("value"))
    return one("hierarchy", "parent", F.array_join("children", ",")).unionByName(one("alternates", "alt_id", F.col("place"))).unionByName(one("links", "place", F.col("url")))


@query(f"""{_PLACES}, known as (select id, name, pos from k), pair as (select id // 3 as parent, id as child from p where id // 3 <> id)
select name as s_term, pos as s_pos, id::varchar as s_sense, 'instanceOf' as rel, case when cls = 'A' then 'region' else 'city' end as e_term, 'Noun' as e_pos, null::varchar as e_sense from k
union all select c.name, c.pos, c.id::varchar, 'partOf', q.name, q.pos, q.id::varchar from pair join known c on c.id = child join known q on q.id = parent""")
def places_load(spark, d):
    """Places as concepts with their kind and what they are part of; ignored names are left out."""
    return _places_kg(spark, d).relations.drop("weight")


@query(f"""{_PLACES} select name as term, pos, id::varchar as sense, 'alternativeOf' as type, 'T' || id as value from k""")
def places_properties(spark, d):
    """Other names of places."""
    return _places_kg(spark, d).properties


def _places_kg(spark, d):
    p = _places(spark, d)
    k = F.col("s_suppkey")
    h = table(spark, d, "supplier").select(F.floor(k / 3).cast("string").alias("parent"), k.cast("string").alias("child"))
    f = lambda rows, s: spark.createDataFrame(rows, s)
    none = f([], "alt_id string, place string")
    return loaders.geonames(p, h, none, f([], "place string, url string"), f([("P.PPL", "city"), ("A.ADM1", "region")], "code string, label string"), f([(" place 7",)], "name string"))


# S7, S8, Z9, P14, P23

@query("""select distinct p_name as term, 'TradeName' as pos from part union all select distinct p_brand, 'TradeName' from part""")
def read_word_lists(spark, d):
    """Words of files, one a line, with the class that the file's name tells."""
    p = table(spark, d, "part")
    lines = p.select(F.explode(F.array("p_name", "p_brand")).alias("value")).distinct()
    return readers.word_lists(spark, _named(spark, lines.select(F.concat(F.lit(" "), "value").alias("value")), "trade_names.txt"), True)


def _named(spark, lines, name: str) -> str:
    """A text file of this name, written by one task; for word lists, whose name tells their class."""
    path = _folder(spark, "list")
    lines.coalesce(1).write.text(path + "/parts")
    fs = (hadoop := spark._jvm.org.apache.hadoop.fs).Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    part = next(str(f.getPath()) for f in fs.listStatus(hadoop.Path(path + "/parts")) if f.getPath().getName().startswith("part-"))
    fs.rename(hadoop.Path(part), hadoop.Path(f"{path}/{name}"))
    return f"{path}/{name}"


@query("""select n_name as term, 'Verb' as pos, 'region' as property, n_regionkey::varchar as value from nation""")
def read_keyed_words(spark, d):
    """Words with properties of JSON files; keys that start with two underscores are notes."""
    n = table(spark, d, "nation").agg(F.to_json(F.map_concat(F.map_from_entries(F.collect_list(F.struct("n_name", F.create_map(F.lit("region"), F.col("n_regionkey").cast("string"))))), F.create_map(F.lit("__note"), F.create_map(F.lit("a"), F.lit("b"))))).alias("value"))
    return readers.keyed_words(spark, _named(spark, n, "verbs.json"), True)


_CURATED = """with l as (select distinct r_name as term, unnest(['Noun', 'NN']) as pos from region), e as (select distinct replace(n_name, '_', ' ') as s, r_name as o from nation join region on n_regionkey = r_regionkey)"""


def _patterns(spark, d):
    e = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    line = F.concat(F.lit(" ("), "n_name", F.lit("^(GPE))-[partOf]->("), "r_name", F.lit("^(GPE))"))
    return readers.edge_patterns(spark.read.text(_file(spark, e.select(F.explode(F.array(line, F.lit("no edge"))).alias("value")), "patterns")))


@query("""select n_name as "start", 'GPE' as start_pos, 'partOf' as rel, r_name as "end", 'GPE' as end_pos from nation join region on n_regionkey = r_regionkey""")
def read_edge_patterns(spark, d):
    """Edges of lines in arrow form."""
    return _patterns(spark, d)


@query(f"""{_CURATED} select term, pos from l union select s, 'GPE' from e union select o, 'GPE' from e union select distinct s_name, 'LOC' from supplier union select 'metro station', 'Noun'""")
def curated_concepts(spark, d):
    """Word lists with several classes, edge patterns and stations."""
    lists = table(spark, d, "region").select(F.col("r_name").alias("term"), F.lit("Noun").alias("pos"))
    kg = loaders.curated(lists, _patterns(spark, d), {"Noun": ["Noun", "NN"]}, table(spark, d, "supplier").select(F.col("s_name").alias("term")))
    return loaders.assemble([kg])["concepts"].select("term", "pos")


# Z6, Z7, J18-J20, G11, G12

_SYN = """with r as (select distinct 's' || p_brand as synset, p_name as lemma, case when p_name like 'small%' then 'm/x-n' else 'm/' || replace(p_name, ' ', '_') || '-n' end as member, case when right(p_brand, 1) = '1' then 'phrase' else 'noun' end as pos, case when right(p_brand, 1) = '2' then 'unlabeled' else 'noun.artifact' end as lexical_domain from part),
m as (select synset, lemma, min(pos) as pos, min(lexical_domain) as lexical_domain, coalesce(max(case when lemma not like 'small%' then member end), synset) as uri from r group by 1, 2),
c as (select *, case when pos = 'phrase' then 'Phrase' when lexical_domain <> 'unlabeled' then 'noun' else pos end as cls, case when lexical_domain <> 'unlabeled' then lexical_domain end as sense from m)"""


def _synsets(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_name").distinct()
    last = F.substring("p_brand", -1, 1)
    return loaders.synsets(p.select(F.concat(F.lit("s"), "p_brand").alias("synset"), F.col("p_name").alias("lemma"), F.when(F.col("p_name").startswith("small"), "m/x-n").otherwise(F.concat(F.lit("m/"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("-n"))).alias("member"), F.when(last == "1", "phrase").otherwise("noun").alias("pos"), F.when(last == "2", "unlabeled").otherwise("noun.artifact").alias("lexical_domain"), F.lit(None).cast("string").alias("phrase_type")))


@query(f"{_SYN} select synset, lemma, pos, lexical_domain, uri from m")
def synset_members(spark, d):
    """Lemmas of synsets with the URI of the member that they name, or the synset's."""
    return _synsets(spark, d).select("synset", "lemma", "pos", "lexical_domain", "uri")


@query(f"""{_SYN}, k as (select 'sBrand#' || n_nationkey as a, 'sBrand#' || (n_nationkey + 1) as b from nation where n_nationkey % 2 = 0)
select lemma as s_term, cls as s_pos, sense as s_sense, 'relatedTo' as rel, 'artifact' as e_term, cls as e_pos, null::varchar as e_sense from c where sense is not null
union all select x.lemma, x.cls, x.sense, 'eq', y.lemma, y.cls, y.sense from c x join c y on x.synset = y.synset and x.lemma < y.lemma
union all select x.lemma, x.cls, x.sense, 'has_part', y.lemma, y.cls, y.sense from k join c x on x.synset = k.a join c y on y.synset = k.b""")
def wordnet_load(spark, d):
    """Lemmas related to their domain, to each other, and over typed relations of synsets."""
    n = table(spark, d, "nation")
    rel = n.select(F.concat(F.lit("sBrand#"), "n_nationkey").alias("synset"), F.when(F.col("n_nationkey") % 2 == 0, "has_part").otherwise("odd").alias("rel"), F.concat(F.lit("sBrand#"), (F.col("n_nationkey") + 1).cast("string")).alias("other"))
    return loaders.wordnet(_synsets(spark, d), rel, spark.createDataFrame([("Has_Part",)], "label string")).relations.drop("weight")


@query("""with w as (select distinct p_name as term, unnest(string_split(p_name, ' ')) as word from part), t as (select distinct lower(split_part(p_name, ' ', 1)) as word, unnest(['Adjective', 'JJ']) as cls from part)
select term as s_term, 'Phrase' as s_pos, 'compositeFormWith' as rel, w.word as e_term, cls as e_pos from w join t on lower(w.word) = t.word""")
def phrase_parts(spark, d):
    """A phrase and its words, with the classes that a table of tags gives them."""
    p = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct()
    tags = p.select(F.substring_index("term", " ", 1).alias("word"), F.array(F.lit("Adjective"), F.lit("JJ")).alias("classes")).distinct()
    return loaders.phrase_parts(p, tags).select("s_term", "s_pos", "rel", "e_term", "e_pos")


# S9, S15-S18, K4, K7, K8, K10, K6, T4

@query("""select r_name as label, count(*) as n from nation join region on n_regionkey = r_regionkey where n_nationkey % 3 <> 0 group by r_name""")
def resource_types(spark, d):
    """Labels and types of resources, types only of resources with a label in the language."""
    j = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    s = F.concat(F.lit("<http://dbpedia.org/resource/N"), "n_nationkey", F.lit(">"))
    label = F.concat(s, F.lit(' <http://www.w3.org/2000/01/rdf-schema#label> "'), "n_name", F.lit('"@'), F.when(F.col("n_nationkey") % 3 == 0, "fr").otherwise("en"), F.lit(" ."))
    kind = F.concat(s, F.lit(" <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <http://x.example/"), F.replace("r_name", F.lit(" "), F.lit("_")), F.lit("> ."))
    found = readers.resources(spark.read.text(_file(spark, j.select(F.explode(F.array(label, F.lit("# x"))).alias("value")), "labels")), spark.read.text(_file(spark, j.select(kind.alias("value")), "types")), "en")
    return found["types"].groupBy(F.replace(textnorm.local_name("type"), F.lit("_"), F.lit(" ")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("""select user_id::varchar as run, event_type as phase, count(*)::varchar as seconds from events group by 1, 2""")
def benchmark_rows(spark, d):
    """A benchmark table appended twice over, with a fixed header and number of rows."""
    b = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("user_id").cast("string").alias("run"), F.col("event_type").alias("phase"), F.col("n").cast("string").alias("seconds"))
    path = _folder(spark, "benchmark")
    for half in (0, 1):
        b.where(F.pmod(F.hash("run"), F.lit(2)) == half).write.mode("append").option("header", True).csv(path)
    return readers.benchmark(spark, path, ["run", "phase", "seconds"], b.count())


@query(f"""with u as (select n_name as term, 'nation' as source from nation union all select p_brand, 'part' from part union all select r_name, null from region) select term, source from u where source is null or source <> 'part'""")
def without_sources(spark, d):
    """Tables saved and loaded again, without the rows of a source."""
    part = lambda n, c, s: table(spark, d, n).select(F.col(c).alias("term"), F.lit(s).cast("string").alias("source"))
    folder = _folder(spark, "saved")
    readers.save({"terms": part("nation", "n_name", "nation").unionByName(part("part", "p_brand", "part")).unionByName(part("region", "r_name", None))}, folder)
    return dedup.without_sources(readers.load(spark, folder, ["terms"])["terms"], ["part"])


@query("""select l_shipmode_ as k, count(*) as n from (select l_returnflag || l_linestatus as l_shipmode_ from lineitem) group by 1""")
def read_through(spark, d):
    """A table made once and read from its cache the second time."""
    folder = _folder(spark, "cache")
    made = []

    def make():
        made.append(1)
        return table(spark, d, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("k")).agg(F.count(F.lit(1)).alias("n"))

    for _ in range(2):
        out = cached(spark, make, "counts, first version", folder)
    if len(made) != 1:
        raise RuntimeError("the cache was not read")
    return out


@query("""select row_number() over (order by p_name) as n, p_name as value from part""")
def sorted_lines(spark, d):
    """T4, K8: lines in byte order with their numbers."""
    return rdf.sorted_lines(table(spark, d, "part").select(F.col("p_name").alias("value")))


@query("""select row_number() over (order by p_name) as n, p_name as value from (select distinct p_name from part)""")
def sorted_unique_lines(spark, d):
    """T4, K8: the same, each line once."""
    return rdf.sorted_lines(table(spark, d, "part").select(F.col("p_name").alias("value")), True)


@query("""select '<http://k.example/r' || n_regionkey || '> <http://k.example/has> ' || array_to_string(list_sort(list('<http://k.example/n' || n_nationkey || '>')), ', ') || ' .' as value from nation group by n_regionkey""")
def turtle_lines(spark, d):
    """K6: a line per subject and predicate with its objects."""
    n = table(spark, d, "nation")
    none = F.lit(None).cast("string")
    return rdf.turtle(n.select(F.concat(F.lit("http://k.example/r"), "n_regionkey").alias("s"), F.lit("http://k.example/has").alias("p"), F.concat(F.lit("http://k.example/n"), "n_nationkey").alias("o"), F.lit("iri").alias("kind"), none.alias("dtype"), none.alias("lang")))


# A6, G5, G18, G19, G21, G24, J6, J16, J27, T2, Z19, Z39

@query(f"""select s, count(distinct o) as degree from ({S['page_triples']}) group by s order by degree desc, s limit 200""")
def hub_subjects(spark, d):
    """Subjects with most distinct objects."""
    return analytics.hubs(star.page_triples(spark, d), 200)


_HINT = """with c as (select 'n' || p_partkey as concept, p_name as term, 'Noun' as pos from part union all select 'v' || p_partkey, p_name, case when p_size % 2 = 0 then 'Verb' else 'Noun' end from part), e as (select 'n' || p_partkey as s, 'v' || p_partkey as o, lower(p_type) as rel from part),
h as (select distinct a.term, rel, a.pos as start_pos, b.pos as end_pos from e join c a on a.concept = s join c b on b.concept = o where a.term = b.term and a.pos <> b.pos)"""


def _hint_tables(spark, d):
    p = table(spark, d, "part")
    c = lambda k, pos: p.select(F.concat(F.lit(k), "p_partkey").alias("concept"), F.col("p_name").alias("term"), pos.alias("pos"))
    e = p.select(F.concat(F.lit("n"), "p_partkey").alias("start"), F.concat(F.lit("v"), "p_partkey").alias("end"), F.lower("p_type").alias("rel"))
    return e, c("n", F.lit("Noun")).unionByName(c("v", F.when(F.col("p_size") % 2 == 0, "Verb").otherwise("Noun")))


@query(f"{_HINT} select * from h")
def class_hints(spark, d):
    """Edges between two classes of one term."""
    return cluster.cross_class_hints(*_hint_tables(spark, d))


@query(f"""{_HINT}, k as (select term, pos, min(concept) as cluster from c group by 1, 2) select distinct x.cluster as start_cluster, y.cluster as end_cluster, rel from h join k x on x.term = h.term and x.pos = start_pos join k y on y.term = h.term and y.pos = end_pos""")
def lifted_hints(spark, d):
    """The same between clusters, here of a term's classes."""
    e, c = _hint_tables(spark, d)
    low = c.groupBy("term", "pos").agg(F.min("concept").alias("cluster"))
    return cluster.lifted_hints(cluster.cross_class_hints(e, c), c, c.join(low, ["term", "pos"]).select("concept", "cluster"))


@query("""with t as (select 's' || s_suppkey as s, 'p' || (s_nationkey % 5) as p, 'n' || s_nationkey as o from supplier union all select 'p' || n_regionkey, 'source_pos', n_name from nation union all select 'q' || n_regionkey, 'source_pos', n_name from nation) select distinct m.s as p, m.p as name, m.o as value from t m where m.p = 'source_pos' and m.s in (select p from t)""")
def predicate_metadata(spark, d):
    """What triples say of the predicates that are in use."""
    n = table(spark, d, "nation")
    t = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("s"), F.concat(F.lit("p"), (F.col("s_nationkey") % 5).cast("string")).alias("p"), F.concat(F.lit("n"), "s_nationkey").alias("o"))
    for k in "pq":
        t = t.unionByName(n.select(F.concat(F.lit(k), "n_regionkey").alias("s"), F.lit("source_pos").alias("p"), F.col("n_name").alias("o")))
    return cluster.predicate_metadata(t, ["source_pos", "target_pos"])


@query("""with x as (select o_orderstatus as k, o_orderpriority, avg(o_totalprice) as m, stddev_samp(o_totalprice) as s from orders group by 1, 2) select k, o_orderpriority as category, round(m, 4) as value, round(s, 4) as std from x""")
def merged_stats(spark, d):
    """Means and deviations, each a wide table, merged by row and category."""
    o = table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("k")).pivot("o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    m, s = o.agg(F.avg("o_totalprice")), o.agg(F.stddev_samp("o_totalprice"))
    return stats.merged_stats(m, s, "k").select("k", "category", F.round("value", 4).alias("value"), F.round("std", 4).alias("std"))


@query(f"""select s, p, o from (select distinct s, p, o from ({S['page_triples']}) where (contains(lower(s), 'g:1') and contains(lower(o), 'th')) or (contains(lower(s), 'th') and contains(lower(o), 'g:1'))) order by s, p, o limit 50""")
def bridge_examples(spark, d):
    """Examples of triples between two texts, wherever they stand in a name."""
    return retrieve.examples(retrieve.substring_bridges(star.page_triples(spark, d), "G:1", "th"), 50)


@query(f"""select count(*) as n from (select distinct s, p, o from ({S['page_triples']}) where (contains(lower(s), 'g:1') and contains(lower(o), 'th')) or (contains(lower(s), 'th') and contains(lower(o), 'g:1')))""")
def bridge_count(spark, d):
    """How many there are."""
    return retrieve.substring_bridges(star.page_triples(spark, d), "G:1", "th").agg(F.count(F.lit(1)).alias("n"))


@query("""select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 25""")
def top_customers(spark, d):
    """The rows of the highest score, ties by key."""
    return matching.top_k(table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", ["c_custkey"], 25)


@query(f"""select 'second' as side, 's:' || s_suppkey as "start", 'n:' || s_nationkey as "end" from supplier where s_suppkey % 10 = 3 union all select 'first', 'x', 'y'""")
def differing_builds(spark, d):
    """What two builds do not share."""
    b = table(spark, d, "supplier").select(F.concat(F.lit("s:"), "s_suppkey").alias("start"), F.concat(F.lit("n:"), "s_nationkey").alias("end"), "s_suppkey")
    a = b.where("s_suppkey % 10 != 3").drop("s_suppkey").unionByName(spark.createDataFrame([("x", "y")], "start string, end string"))
    return analytics.differing(a, b.drop("s_suppkey")).select("side", "start", "end")


@query(f"""select concept, term, pos from ({S['concepts']}) where lower(term) = 'red widget' and pos = 'Noun'""")
def concept_lookup(spark, d):
    """Concepts of a word in any case, of one class."""
    return explain.concept_ids(star.concepts(spark, d), "Red Widget", "Noun").select("concept", "term", "pos")


_CHAIN = """with u as (select 'k' || c_custkey as concept, 'w' || (c_custkey // 3) as url from customer union all select 'k' || c_custkey, 'x' || (c_custkey // 6) from customer where c_custkey % 3 = 0), cl as (select 'k' || c_custkey as concept, (select min('k' || x) from range(c_custkey // 6 * 6, c_custkey // 6 * 6 + 6) t(x) where x < (select count(*) from customer)) as cluster from customer)"""


def _chain(spark, d):
    k = F.col("c_custkey")
    c = table(spark, d, "customer")
    u = c.select(F.concat(F.lit("k"), k).alias("concept"), F.concat(F.lit("w"), F.floor(k / 3).cast("string")).alias("url")).unionByName(c.where(k % 3 == 0).select(F.concat(F.lit("k"), k).alias("concept"), F.concat(F.lit("x"), F.floor(k / 6).cast("string")).alias("url")))
    return u, c.select(F.concat(F.lit("k"), k).alias("concept"), F.floor(k / 6).alias("six"))


@query(f"""{_CHAIN}, m as (select distinct cluster, url, concept from u join cl using (concept)), low as (select cluster, url, min(concept) as a from m group by 1, 2) select cluster, url, a, concept as b from m join low using (cluster, url) where concept <> a""")
def shared_evidence(spark, d):
    """J5, G24 in linear form: from the least member that has a URL to the others."""
    u, c = _chain(spark, d)
    low = c.groupBy("six").agg(F.min("concept").alias("cluster"))
    return explain.evidence(c.join(low, "six").select("concept", "cluster"), u)


@query(f"""{_CHAIN}, e as (select distinct x.concept as a, y.concept as b from u x join u y on x.url = y.url and x.concept <> y.concept), s as (select cluster, min(concept) as r from cl group by cluster having count(*) >= 4),
one as (select cluster, r, b from s join e on a = r), two as (select distinct o.cluster, o.r, e.b from one o join e on e.a = o.b where e.b <> o.r and (o.r, e.b) not in (select (r, b) from one)), three as (select distinct o.cluster, o.r, e.b from two o join e on e.a = o.b where e.b <> o.r and (o.r, e.b) not in (select (r, b) from one) and (o.r, e.b) not in (select (r, b) from two))
select cluster, b as concept, 2 as hops from two union all select cluster, b, 3 from three""")
def transitive_members(spark, d):
    """Members of larger clusters that share no URL with the representative, and how far they are from it."""
    u, c = _chain(spark, d)
    low = c.groupBy("six").agg(F.min("concept").alias("cluster"))
    clusters = c.join(low, "six").select("concept", "cluster")
    e = explain.evidence(clusters, u)
    full = explain.formation(clusters, u).select("a", "b", F.col("url").alias("via"))
    reps = clusters.groupBy("cluster").agg(F.min("concept").alias("node"), F.count(F.lit(1)).alias("n")).where("n >= 4").join(e.select("cluster").distinct(), "cluster").select("node")
    return explain.transitive(clusters, retrieve.distances(spark, full, reps), 4).select("cluster", "concept", "hops")


@query()
def grouped_pairs(spark, d):
    """Groups of keywords grown from the best mined pairs (a report of the 60 best)."""
    top = matching.top_k(QUERIES["pair_mining"](spark, d), "n", ["a", "b"], 60)
    found = matching.grouped([(r["a"], r["b"], float(r["n"])) for r in top.collect()])
    return spark.createDataFrame([(i, ", ".join(words), total) for i, (words, total) in enumerate(found)], "number int, keywords string, total double")


# U8, Z21, Z22, Z37, Z38, Z42, Z43, Z44, P4, P16, P24, P27

_MAPS = [{"PartOf": {"rel": "partOf"}, "AtLocation": {"rel": "locatedIn"}, "product": {"rel": "madeBy", "swap": True}, "Near": {"rel": "nearTo", "relNegated": True}, "isA": {"rel": "isA"}}]


@query("""select label, class from (values ('gpe', 'Place'), ('noun', 'Thing'), ('verb', 'Nowhere')) m(label, class) where class not in ('Place', 'Thing', 'Root')""")
def dangling_targets(spark, d):
    """Mapping targets that are no class."""
    classes = mapping.class_table(spark, {"Root": {"classes": {"Place": {}, "Thing": {}}}})
    return mapping.dangling(mapping.pos_map(spark, [{"GPE": "Place", "Noun": "Thing", "Verb": "Nowhere"}]), "class", classes)


@query("""select mapped, array_to_string(list(label order by label), ',') as labels from (values ('partof', 'partOf'), ('atlocation', 'locatedIn'), ('product', 'madeBy'), ('near', 'nearTo'), ('isa', 'isA')) m(label, mapped) group by mapped""")
def reversed_mapping(spark, d):
    """Labels of each target."""
    r = mapping.reversed_map(mapping.edge_map(spark, _MAPS))
    return r.select("mapped", F.array_join(F.transform("originals", lambda x: x["label"]), ",").alias("labels"))


@query("""select label, mapped, 0.9::double as p from (values ('partof', 'partOf'), ('atlocation', 'locatedIn'), ('isa', 'isA')) m(label, mapped)""")
def mapping_probabilities(spark, d):
    """Mappings that are neither negated nor swapped."""
    return mapping.probability_table(mapping.edge_map(spark, _MAPS)).withColumn("p", F.col("p").cast("double"))


@query(f"""with r as (select source, rel from ({S['relations']})), m(source, rel, mapped) as (values ('nation', 'PartOf', 'partOf'), ('customer', 'AtLocation', 'locatedIn'), ('lineitem', 'product', 'madeBy')) select r.source, r.rel, count(*) as n, bool_and(mapped is not null) as ok from r left join m on r.source = m.source and r.rel = m.rel group by 1, 2""")
def mapped_edges(spark, d):
    """Relations whose source declares a mapping."""
    m = spark.createDataFrame([("nation", "PartOf", "partOf"), ("customer", "AtLocation", "locatedIn"), ("lineitem", "product", "madeBy")], "source string, rel string, mapped string")
    r = star.relations(spark, d).withColumn("expected", F.lit(None).cast("string"))
    return audit.check_edges(r, m).groupBy("source", "rel").agg(F.count(F.lit(1)).alias("n"), F.bool_and("ok").alias("ok"))


@query("""with l as (select p_partkey as i, case when p_size % 2 = 0 then 'partial' end as label from part where p_size % 4 <> 1) select p_partkey as i, p_name, coalesce(l.label, 'correct') as label from part left join l on i = p_partkey""")
def overlaid_labels(spark, d):
    """Labels laid over rows by their number."""
    p = table(spark, d, "part")
    rows = p.select(F.col("p_partkey").alias("i"), "p_name", F.lit("old").alias("label"))
    return audit.overlaid(rows, p.where("p_size % 4 != 1").select(F.col("p_partkey").alias("i"), F.when(F.col("p_size") % 2 == 0, "partial").alias("label")), "i", "correct")


_GOLD = """with g as (select distinct p_name as source, lower(p_type) || ' ' || split_part(p_name, ' ', 2) as target from part), s as (select 'http://kgloom.example/source#kb.' || regexp_replace(source, '[^A-Za-z0-9]', '_', 'g') as iri, lower(source) as label from g group by all),
c as (select 'http://kgloom.example/canonical#' || regexp_replace(target, '[^A-Za-z0-9]', '_', 'g') as iri, min(target) as label from g group by 1)"""


def _vocabularies(spark, d):
    p = table(spark, d, "part").select(F.col("p_name").alias("source"), F.concat_ws(" ", F.lower("p_type"), F.element_at(F.split("p_name", " "), 2)).alias("target")).distinct()
    return matching.vocabularies(p.select("source", "target", F.lit("kb").alias("kb"), F.lit("pos").alias("kind"), F.lit(False).alias("swap"), F.lit(False).alias("neg")))


@query(f"""{_GOLD} select iri, label, 'the ' || label || ' relation' as gloss from c union all select iri, label, null from s""")
def match_vocabularies(spark, d):
    """The classes to align, with their labels and glosses."""
    v = _vocabularies(spark, d)
    return v["canonical"].select("iri", "label", "gloss").unionByName(v["source"].select("iri", "label", F.lit(None).cast("string").alias("gloss")))


@query(f"""{_GOLD}, st as (select iri, unnest(list_distinct(string_split(label, ' '))) as t, len(list_distinct(string_split(label, ' '))) as n from s), ct as (select iri, unnest(list_distinct(string_split(label, ' '))) as t, len(list_distinct(string_split(label, ' '))) as n from c),
x as (select st.iri as source, ct.iri as target, count(*) / (st.n + ct.n - count(*)) as score from st join ct using (t) group by st.iri, ct.iri, st.n, ct.n), w as (select *, row_number() over (partition by source order by score desc, target) as rank from x) select source, rank, target, round(score, 9) as score from w where rank <= 3""")
def best_matches(spark, d):
    """The three best targets of each source by shared tokens."""
    v = _vocabularies(spark, d)
    found = matching.token_candidates(v["source"], v["canonical"]).withColumnRenamed("jaccard", "score")
    return matching.best(found, 3).withColumn("rank", F.col("rank").cast("long")).withColumn("score", F.round("score", 9))


@query()
def lexical_matches(spark, d):
    """The best target of each source by tokens or matching blocks, against the reference."""
    v = _vocabularies(spark, d)
    return matching.judged(matching.best(matching.lexical(v["source"], v["canonical"])), v["reference"])


@query("""select p_partkey, case when p_size % 2 = 0 and lower(split_part(p_name, ' ', 1)) = 'small' then 'little' else lower(split_part(p_name, ' ', 1)) end as lemma from part""")
def lemmatised_terms(spark, d):
    """Lemmas by word and part of speech."""
    p = table(spark, d, "part").select("p_partkey", F.initcap(F.substring_index("p_name", " ", 1)).alias("term"), F.when(F.col("p_size") % 2 == 0, "Adjective").otherwise("Noun").alias("pos"))
    return textnorm.lemmatised(p, spark.createDataFrame([("small", "a", "little"), ("red", "v", "redden")], "word string, letter string, lemma string")).select("p_partkey", "lemma")


@query("""select event_id, regexp_replace(event_type || '-' || value::varchar, '[^A-Za-z0-9]', '_', 'g') as fragment, lower(event_type) || ' kind' as words from events""")
def name_fragments(spark, d):
    """Names as fragments and as words."""
    return table(spark, d, "events").select("event_id", textnorm.fragment(F.concat_ws("-", "event_type", F.col("value").cast("string"))).alias("fragment"), textnorm.camel_words(F.concat("event_type", F.lit("Kind"))).alias("words"))


@query("""select n_nationkey, replace('NATION_' || n_nationkey, '_', ' ') as term from nation""")
def category_terms(spark, d):
    """Terms of resources."""
    return table(spark, d, "nation").select("n_nationkey", textnorm.category_term(F.concat(F.lit("Category:"), "n_name")).alias("term"))


@query("""select page_id, not (regexp_matches(url, '\\\\\\\\u[0-9A-Fa-f]{4}|%[89A-Fa-f][0-9A-Fa-f]') or page_id % 3 = 0) as ok from pages""")
def triple_gates(spark, d):
    """Triples that pass the quality gates."""
    p = table(spark, d, "pages")
    s = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("http://x/place--"), "page_id")).otherwise("http://x/place")
    return p.select("page_id", textnorm.good_triple(s, F.lit("p"), "url").alias("ok"))


# Z25, Z28, Z30, Z32, Z36

@query("""with w as (select doc_id, source, row_number() over (partition by source order by doc_id) as n, n_chars from documents) select source, doc_id, coalesce(case when doc_id % 2 = 0 then n_chars end, -1)::bigint as value from w where n = 1""")
def first_results(spark, d):
    """The first row of each key; what is missing gets its default."""
    x = table(spark, d, "documents").select("source", "doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("n_chars")).alias("value"))
    return evaluate.first_rows(x, "source", "doc_id", {"value": -1})


@query("""with x as (select lang, source, (n_chars % 10)::double as a, (n_chars % 13)::double as b from documents) select lang, round(avg(a), 9) as a, round(avg(b), 9) as b from x group by lang""")
def averaged_items(spark, d):
    """Means of items over models."""
    x = table(spark, d, "documents").select("lang", (F.col("n_chars") % 10).cast("double").alias("a"), (F.col("n_chars") % 13).cast("double").alias("b"))
    return evaluate.averaged(x, "lang", "a", "b").select("lang", F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))


def _regions(spark, d):
    return table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("s"), F.lit("partOf").alias("p"), F.col("r_name").alias("o"))


@query("""select n_name as s, 'partOf' as p, r_name as o from nation join region on n_regionkey = r_regionkey where r_name = 'ASIA' and n_nationkey % 2 = 0""")
def case_additions(spark, d):
    """What the enriched graph adds to a case's subgraph."""
    t = _regions(spark, d)
    base = t.where(F.substring_index("s", "_", -1).cast("int") % 2 == 1)
    return evaluate.case(t, base, ["asia", "nation_7"])["added"]


@query("""with r as (select n_name as s, 'partOf' as p, r_name as o, case when lower(r_name) = 'asia' then 4.0 else 1.0 end as score from nation join region on n_regionkey = r_regionkey), b as (select unnest([2, 4, 8]) as budget), w as (select *, row_number() over (order by score desc, s, p, o) as n from r) select budget, s, o, score::double as score from b, w where n <= budget""")
def context_sweep(spark, d):
    """Contexts of several budgets."""
    t = _regions(spark, d)
    out = None
    for budget, c in evaluate.sweep(t, t.limit(0), ["asia"], [2, 4, 8]).items():
        c = c.select(F.lit(budget).alias("budget"), "s", "o", "score")
        out = c if out is None else out.unionByName(c)
    return out
