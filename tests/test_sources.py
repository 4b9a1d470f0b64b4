"""Readers and loaders over small files."""

import json

import pytest
from pyspark.sql import functions as F

from kgloom.operators import rdf
from kgloom.sources import loaders, readers
from kgloom.streaming.ingest import ingest_relations


@pytest.fixture()
def edges(spark, tmp_path):
    rows = [
        ("/r/IsA", "/c/en/dog/n/wn/animal", "/c/en/animal", '{"weight": 2.0, "surfaceStart": "dog"}'),
        ("/r/IsA", "/c/fr/chien", "/c/en/animal", "{}"),
        ("/r/dbpedia/genre", "/c/en/a", "/c/en/b", "{}"),
        ("/r/ExternalURL", "/c/en/dog/n/wn/animal", "http://x.example/dog", "{}"),
        ("/r/ExternalURL", "/c/en/dog", "http://x.example/dog#1", "{}"),
    ]
    path = tmp_path / "e.tsv"
    path.write_text("".join(f"/a\t{r}\t{s}\t{e}\t{d}\n" for r, s, e, d in rows))
    return readers.commonsense_edges(spark, str(path))


def test_commonsense(spark, edges):
    kg = loaders.commonsense(edges)
    assert [tuple(r) for r in kg.relations.collect()] == [("dog", "n", "n/wn/animal", "IsA", "animal", "c", None, 2.0)]
    assert [r["url"] for r in kg.urls.collect()] == ["http://x.example/dog"]


def test_dictionary(spark, tmp_path):
    path = tmp_path / "d.json"
    path.write_text(json.dumps([
        {"word": "run", "lang_code": "en", "pos": "verb", "categories": ["English motion verbs"], "tags": ["present participle"], "senses": [], "synonyms": [{"word": "jog"}, {"word": "walk", "sense": "unrelated use"}]},
        {"word": "jog", "lang_code": "en", "pos": "noun"},
        {"word": "courir", "lang_code": "fr", "pos": "verb", "synonyms": [{"word": "x"}]},
    ]))
    e = readers.dictionary(spark, str(path))
    kg = loaders.dictionary(e, readers.RELATIONS, {"verb": {"classes": ["MotionVerb"], "properties": ["present", "participle"]}})
    got = {(r["s_term"], r["s_pos"], r["rel"], r["e_term"], r["e_pos"]) for r in kg.relations.collect()}
    # the category says "motion verbs", so the class is found by its prefix
    assert got == {("run", "MotionVerb", "synonyms", "jog", "noun"), ("run", "MotionVerb", "neqTo", "walk", "MotionVerb")}
    assert {(r["term"], r["type"]) for r in kg.properties.collect()} == {("run", "present participle")}


def test_reduced_dictionary_drops_bad_lines(spark, tmp_path):
    path = tmp_path / "d.jsonl"
    path.write_text('{"word": "a", "lang_code": "en"}\n{broken\n{"word": "b", "lang_code": "fr"}\n')
    assert [r["word"] for r in readers.reduced_dictionary(spark, str(path)).collect()] == ["a"]


def test_wordnet(spark):
    rows = spark.createDataFrame([("s1", "car", "m/car-n", "noun", "noun.artifact", None), ("s1", "auto", "m/other-n", "noun", "noun.artifact", None), ("s2", "wheel", "m/wheel-n", "noun", "unlabeled", None)], "synset string, lemma string, member string, pos string, lexical_domain string, phrase_type string")
    m = loaders.synsets(rows)
    assert {(r["lemma"], r["uri"]) for r in m.collect()} == {("car", "m/car-n"), ("auto", "s1"), ("wheel", "m/wheel-n")}
    kg = loaders.wordnet(m, spark.createDataFrame([("s1", "has_part", "s2"), ("s1", "odd", "s2")], "synset string, rel string, other string"), spark.createDataFrame([("Has_Part",)], "label string"))
    got = {(r["s_term"], r["rel"], r["e_term"]) for r in kg.relations.collect()}
    assert got == {("car", "relatedTo", "artifact"), ("auto", "relatedTo", "artifact"), ("auto", "eq", "car"), ("car", "has_part", "wheel"), ("auto", "has_part", "wheel")}


def test_places(spark, tmp_path):
    path = tmp_path / "p.tsv"
    path.write_text("1\tParis\t\tParis,Paname\t0\t0\tP\tPPL\n2\tFrance\t\t\t0\t0\tA\tPCLI\n3\t Null Island \t\t\t0\t0\tP\tPPL\n")
    f = lambda rows, s: spark.createDataFrame(rows, s)
    kg = loaders.geonames(readers.places(spark, str(path)), f([("9", "1"), ("2", "2"), ("2", "77")], "parent string, child string"), f([("9", "8"), ("8", "2"), ("77", "77")], "alt_id string, place string"), f([("1", "http://w/Paris")], "place string, url string"), f([("P.PPL", "city")], "code string, label string"), f([("null island",)], "name string"))
    assert {(r["s_term"], r["rel"], r["e_term"]) for r in kg.relations.collect()} == {("Paris", "instanceOf", "city"), ("Paris", "partOf", "France")}
    assert [(r["term"], r["value"]) for r in kg.properties.collect()] == [("Paris", "Paname")]
    h = readers.place_tables(f([("1", "1"), ("1", "2")], "parent string, child string"), f([(1, "a", "1", "link", "u"), (2, "a", "2", "link", "v")], "line int, alt_id string, place string, kind string, name string"))
    assert h["hierarchy"].first()["children"] == ["2"] and h["alternates"].first()["place"] == "2"


def test_curated_and_build(spark, tmp_path):
    (tmp_path / "nouns.txt").write_text("dog\n\ncat\n")
    (tmp_path / "verbs.json").write_text(json.dumps({"run": {"fast": True}, "__note": {}}))
    lists = readers.word_lists(spark, str(tmp_path / "nouns.txt"), True)
    assert {tuple(r) for r in lists.collect()} == {("dog", "Noun"), ("cat", "Noun")}
    assert [tuple(r) for r in readers.keyed_words(spark, str(tmp_path / "verbs.json"), True).collect()] == [("run", "Verb", "fast", "true")]
    p = readers.edge_patterns(spark.createDataFrame([("(dog^(Noun))-[isA]->(animal^(Noun))",), ("junk",)], "value string"))
    kg = loaders.curated(lists, p, {"Noun": ["Noun", "NN"]}, spark.createDataFrame([("Central",)], "term string"))
    out = loaders.build(spark, [kg])
    assert {(r["term"], r["pos"]) for r in out["concepts"].collect()} == {("dog", "Noun"), ("dog", "NN"), ("cat", "Noun"), ("cat", "NN"), ("animal", "Noun"), ("Central", "LOC"), ("metro station", "Noun")}
    assert rdf.lookup(out["triples"], p=rdf.BASE + "isA1").count() == 2


def test_triples_of_lines(spark):
    lines = ['<a> <p> "x\\"y"@en .', "# note", "", '<a> <p> "1"^^<http://t> .', "_:b <p> <c> .", "broken"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    t = rdf.parse_ntriples(df)
    assert [tuple(r) for r in t.collect()] == [("a", "p", 'x"y', "literal", None, "en"), ("a", "p", "1", "literal", "http://t", None), ("_:b", "p", "c", "iri", None, None)]
    assert rdf.without_blank_nodes(t).count() == 2 and rdf.turtle(t).count() == 2
    with pytest.raises(Exception, match="not a triple"):
        rdf.parse_ntriples(df, True).collect()
    assert readers.language_lines(df, "en", ["<p>"]).count() == 3


def test_constructs(spark):
    rows = rdf.constructs(spark, {"rule one": {"premise": {"kind": "verb", "args": ["a", 2]}, "ok": True}})
    assert rows.where("kind = 'bnode'").count() == 1 and rows.where("o = 'true'").count() == 1


def test_phrase_parts(spark):
    tags = spark.createDataFrame([("hot", ["Adjective"]), ("dog", ["Noun", "NN"])], "word string, classes array<string>")
    assert loaders.phrase_parts(spark.createDataFrame([("hot dog",)], "term string"), tags).count() == 3


def test_benchmarks(spark, tmp_path):
    df = spark.createDataFrame([("1", "2")], "a string, b string")
    readers.append_benchmark(df, str(tmp_path / "b"), str(tmp_path / "h"))
    readers.append_benchmark(df, str(tmp_path / "b"), str(tmp_path / "h"))
    assert readers.benchmark(spark, str(tmp_path / "b"), ["a", "b"], 2).count() == 2
    with pytest.raises(ValueError):
        readers.benchmark(spark, str(tmp_path / "b"), ["a", "b"], 3)
    readers.append_benchmark(df.withColumnRenamed("b", "c"), str(tmp_path / "b"), str(tmp_path / "h"))
    assert (tmp_path / "b.legacy").exists()
    assert "tabular" in readers.latex_table(df) and readers.yaml_rows(df).startswith("- {")


def test_ingest_keeps_first(spark, tmp_path):
    schema = "start string, end string, rel string, weight double, source string"
    src = tmp_path / "in"
    for i, rows in enumerate([[("a", "b", "isA", 1.0, "x"), ("a", "a", "isA", 1.0, "x")], [("a", "b", "isA", 1.0, "y"), ("c", "d", "eq", 1.0, "y")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(src))
        q = ingest_relations(spark.readStream.schema(schema).parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "check"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {(r["start"], r["source"]) for r in out.select("start", "source").collect()} == {("a", "x"), ("c", "y")}
    assert out.where(F.col("rel") == "isA").count() == 1
