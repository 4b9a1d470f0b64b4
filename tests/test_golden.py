"""Golden cases of column functions and operators."""

import pytest
from pyspark.sql import functions as F

from kgloom.functions import similarity, textnorm
from kgloom.operators import analytics, audit, cluster, dedup, explain, mapping, rdf, retrieve, stats
from kgloom.operators.components import connected_components
from kgloom.sources import loaders


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("uri, want", [
    ("/c/en/magenta/n/wn/act", ("magenta", "n", "wn/act")),
    ("/c/en/magenta/a/wn", ("magenta", "a", "wn")),
    ("/c/en/magenta/n/wp/paris_rer", ("magenta", "n", "wp/paris rer")),
    ("/c/en/magenta", ("magenta", "c", None)),
    ("/c/en/dog/n", ("dog", "n", None)),
])
def test_uri(spark, uri, want):
    r = spark.createDataFrame([(uri,)], "u string").select(*[c.alias(k) for k, c in textnorm.uri_parts("u").items()]).first()
    assert (r["term"], r["pos"], r["subsense"]) == want


@pytest.mark.parametrize("sense, want", [("noun.location", "noun.location"), ("n/wn/act", "noun.act"), ("v/wn/motion", "verb.motion"), ("a/wn", None), ("n/wp/paris rer", None), (None, None), ("", None)])
def test_supersense(spark, sense, want):
    assert one(spark, sense, textnorm.supersense("x")) == want


def test_terms(spark):
    f = lambda v: one(spark, v, textnorm.normalise_term("x"))
    assert [f(" "), f('_a"b_'), f("_"), f("running_dog"), f(" x\t")] == [" ", "ab", " ", "running dog", "x"]
    assert one(spark, "Running", textnorm.normalise_data("x", "canonicalise")) == "running"
    assert one(spark, "adverb", textnorm.lemma_pos("x")) == "v"
    with pytest.raises(ValueError):
        textnorm.normalise_data("x", "other")


@pytest.mark.parametrize("sense, want", [("a/wn", "magenta--a-wn"), ("n/wn/act", "magenta--n-wn-act"), (None, "magenta"), ("", "magenta")])
def test_sense_uris(spark, sense, want):
    r = spark.createDataFrame([("magenta", sense)], "t string, s string").select(textnorm.safe_uri("t", "s", "").alias("u")).first()
    assert r["u"] == want


def test_quoting_follows_percent_encoding(spark):
    from urllib.parse import quote, unquote

    for t in ("a b/c~d*e(f)", "Zürich é", "100% + x", "日本"):
        assert one(spark, t, textnorm.percent_quote("x")) == quote(t)
    for t in ("a+b%20c", "100% x", "%C3%BC"):
        assert one(spark, t, textnorm.percent_unquote("x")) == unquote(t)


def test_small_text_rules(spark):
    assert one(spark, "http://x/a/b#c", textnorm.local_name("x")) == "c"
    assert one(spark, "/x/question_words.txt", textnorm.class_of_file("x", True)) == "QuestionWord"
    assert one(spark, "/x/wh_nouns.txt", textnorm.class_of_file("x")) == "WHNouns"
    assert one(spark, "isTypeOf", textnorm.camel_words("x")) == "is type of"
    assert one(spark, "Category:Big_Cats", textnorm.category_term("x")) == "Big Cats"
    assert one(spark, "BigCat", textnorm.category_term("x")) == "Big Cat"
    assert one(spark, "dog%20house12", textnorm.clean_term("x")) == "dog house"
    assert one(spark, "a_b", textnorm.verbalise("x", F.lit("hasThing"), F.lit("c"))) == "a b has thing c"
    assert [one(spark, v, textnorm.meaningful("x")) for v in ("ab", "123", "deadbeef", "a___", "dog", None)] == [False, False, False, False, True, False]


def test_canonical_triples(spark):
    def f(s, p, o, indexed=None):
        r = spark.createDataFrame([(s, p, o)], "s string, p string, o string").select(*[c.alias(k) for k, c in textnorm.canonical_triple("s", "p", "o", indexed).items()]).first()
        return tuple(r)

    xsd = "http://www.w3.org/2001/XMLSchema#"
    assert f("_:b7", "<u/isA12>", '"-1.0"^^<' + xsd + "double>") == ("_:bnode", "<u/isA>", '"-1"^^<' + xsd + "double>")
    assert f("<u/isA3>", "<p>", '"x"^^<' + xsd + "string>", ["isA"]) == ("<u/isA>", "<p>", '"x"')
    assert f("<z>", "<u/eq4>", "<a>") == ("<a>", "<u/eq>", "<z>")
    assert f("<z>", "<p>", '"x"^^<' + xsd + "double>")[2] == '"x"^^<' + xsd + "double>"


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (200, 200)]
    r = dict(tuple(x) for x in connected_components(spark, spark.createDataFrame(chain, "a long, b long")).collect())
    assert r == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert connected_components(spark, spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        connected_components(spark, spark.createDataFrame(chain, "a long, b long"), max_rounds=1)


def test_coherence_keeps_null_apart(spark):
    c = spark.createDataFrame([("1", "n/wn/act"), ("2", None), ("3", "n/wn/person"), ("4", "n/wn/act"), ("5", None), ("6", None)], "concept string, sense string")
    u = spark.createDataFrame([(k, "x") for k in "123"] + [(k, "y") for k in "45"], "concept string, url string")
    f = lambda flag: {r["concept"]: r["cluster"] for r in cluster.cluster(spark, c, u, flag).collect()}
    assert f(False) == {k: k for k in "123456"}
    assert f(True) == {"1": "1", "2": "2", "3": "3", "4": "4", "5": "4", "6": "6"}


def test_navigability(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "e")], "s string, o string")
    n = spark.createDataFrame([(x,) for x in "abcdefg"], "node string")
    r = analytics.navigability(spark, e, n).first()
    assert (r["components"], r["isolated"]) == (4, 2)
    assert r["largest"] == pytest.approx(3 / 7) and r["reachability"] == pytest.approx(15 / 49)


def test_self_loops(spark):
    e = spark.createDataFrame([("1", "2", "partOf"), ("1", "3", "isA"), ("1", "2", "relatedTo"), ("4", "5", "isA")], "start string, end string, rel string")
    labels = spark.createDataFrame([("1", "Paris "), ("2", "paris"), ("3", "city"), ("4", None), ("5", None)], "concept string, label string")
    assert sorted(tuple(r) for r in rdf.self_loops_dropped(e, labels).collect()) == [("1", "2", "relatedTo"), ("1", "3", "isA"), ("4", "5", "isA")]


@pytest.mark.parametrize("classes, source, kind, want", [
    (["Adjective"], "Noun", "synonyms", ["Adjective"]),
    (["Noun", "Verb"], "Verb", "synonyms", ["Verb"]),
    (None, "Noun", "synonyms", ["Noun"]),
    (["Noun"], "Adjective", "derived", ["Noun"]),
    (None, "Adjective", "derived", []),
])
def test_target_pos(spark, classes, source, kind, want):
    w = spark.createDataFrame([("t", classes)] if classes else [], "word string, classes array<string>")
    d = spark.createDataFrame([("t", source, kind)], "target string, p string, k string")
    assert sorted(r["target_pos"] for r in loaders.target_pos(d, w, "target", "p", "k").collect()) == want


@pytest.mark.parametrize("props, want", [(["participle", "present"], {"present participle"}), (["participle", "past"], {"past participle"}), (["participle"], {"participle"}), (["participle", "present", "past"], {"present participle", "past"})])
def test_participles(spark, props, want):
    assert set(one(spark, props, loaders.participles(F.col("x")), "array<string>")) == want


def test_mappings(spark):
    m = mapping.pos_map(spark, [{"Adj": "Adjective", "noun": "Noun"}, {"NOUN": "Thing"}])
    d = spark.createDataFrame([("Adj",), ("noun",), (None,)], "pos string")
    assert [r["pos"] for r in mapping.map_pos(d, m).collect()] == ["Adj", "Thing", None]
    tree = {"Concept": {"classes": {"Noun": {"classes": {"Place": {"sameAs": "LOC"}}}}}}
    t = mapping.class_table(spark, tree)
    assert [r["label"] for r in mapping.dangling(spark.createDataFrame([("a", "Noun"), ("b", "Nowhere")], "label string, class string"), "class", t).collect()] == ["b"]
    assert {(r["class"], r["ancestor"], r["depth"]) for r in mapping.ancestors(spark, t).collect()} == {("Noun", "Concept", 1), ("Place", "Noun", 1), ("Place", "Concept", 2)}
    assert mapping.all_keys({"a": {"b": 1}, "c": 2}) == ["a", "b", "c"]
    e = mapping.edge_map(spark, [{"A": {"rel": "x"}, "B": {"rel": "x", "swap": True}}])
    assert [(o["label"], o["swap"]) for o in mapping.reversed_map(e).first()["originals"]] == [("a", False), ("b", True)]
    assert mapping.probability_table(e).count() == 1
    q = spark.createDataFrame([(1, "hypernym"), (1, "isA"), (2, "b"), (2, "a")], "clique int, name string")
    assert {r["clique"]: r["leader"] for r in mapping.clique_leader(q).collect()} == {1: "isA", 2: "a"}


def test_first_wins_and_sources(spark):
    d = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 1, "z"), (None, 2, "w")], "k string, n int, v string")
    assert sorted(r["v"] for r in dedup.first_wins(d, ["k"], ["n"]).collect()) == ["y", "z"]
    s = spark.createDataFrame([("a",), (None,), ("b",)], "source string")
    assert dedup.without_sources(s, ["a"]).count() == 2


def test_statistics(spark):
    d = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (3.0, 1.0), (1.0, 5.0)], "a double, b double").withColumn("k", F.lit(1))
    r = stats.paired_effect(d, ["k"], "a", "b").first()
    assert (r["n_eff"], r["w_pos"], r["w_neg"]) == (3, 4.0, 2.0) and r["r_rb"] == pytest.approx(1 / 3)
    assert stats.wilcoxon_p(0, 0) is None and stats.wilcoxon_p(10, 55) == pytest.approx(0.00506, abs=1e-4)
    x = list(range(1, 20))
    assert stats.curve_fits(x, [3 * v * v + 1 for v in x])[0][0] == "quadratic"
    assert audit.quotas(10, {"a": 0.55, "b": 0.25, "c": 0.2}) == {"a": 6, "b": 2, "c": 2}
    same = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (2, 1, 4.0), (2, 2, 4.0)], "i int, r int, v double")
    assert stats.krippendorff(same, "i", "r", "v").first()["alpha"] == pytest.approx(1.0)


def test_tags_by_division(spark):
    types = spark.createDataFrame([("x", "Noun"), ("y", "Noun")], "subject string, class string")
    flags = spark.createDataFrame([("x", "plural"), ("x", "proper"), ("y", "plural")], "subject string, property string")
    tags = spark.createDataFrame([("NN", "Noun", []), ("NNPS", "Noun", ["plural", "proper"])], "tag string, class string, required array<string>")
    assert {tuple(r) for r in rdf.inferred_tags(types, flags, tags).collect()} == {("x", "NN"), ("y", "NN"), ("x", "NNPS")}


def test_contexts_and_paths(spark):
    t = spark.createDataFrame([("dog", "isA", "animal"), ("cat", "isA", "animal"), ("dog house", "relatedTo", "dog"), ("fish", "relatedTo", "sea")], "s string, p string, o string")
    c = retrieve.context(t, retrieve.bridges(t, ["dog", "animal"]).select("s", "p", "o"), ["dog", "animal"], 5, 3).collect()
    assert [(r["section"], r["s"]) for r in c] == [("bridge", "dog"), ("general", "cat"), ("general", "dog house")]
    e = t.select(F.col("s").alias("a"), F.col("o").alias("b"), F.col("p").alias("via"))
    found = retrieve.distances(spark, e, spark.createDataFrame([("cat",)], "node string"))
    assert {r["node"]: r["hops"] for r in found.collect()} == {"cat": 0, "animal": 1, "dog": 2, "dog house": 3}
    assert retrieve.subgraph(t, []).count() == 0
    k = spark.createDataFrame([("u", "cat"), ("v", "dog house")], "keyword string, node string")
    assert retrieve.pair_distances(found, k).first()["hops"] == 3
    lines = spark.createDataFrame([(1, "Dog1", "IsA2", "x"), (2, "dog", "isA", "X"), (3, "a", "label", "b")], "seq int, s string, p string, o string")
    assert [tuple(r) for r in retrieve.clean_context(lines).collect()] == [(1, "Dog", "isA", "x")]


def test_similarity(spark):
    d = spark.createDataFrame([("abcd", "bcde")], "a string, b string")
    assert d.select(similarity.sequence_ratio("a", "b")).first()[0] == pytest.approx(0.75)
    v = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0])], "a array<float>, b array<float>")
    assert v.select(similarity.cosine("a", "b")).first()[0] is None


def test_explain(spark):
    c = spark.createDataFrame([("1", "Cat", "Noun"), ("2", "cat", "Verb"), ("3", "dog", "Noun")], "concept string, term string, pos string")
    assert explain.concept_ids(c, "CAT", "Noun").count() == 1
    m = spark.createDataFrame([("1", "1"), ("2", "1"), ("3", "3")], "concept string, cluster string")
    r = spark.createDataFrame([("1", "3", "isA", 1.0, "x")], "start string, end string, rel string, weight double, source string")
    rows = explain.cluster_relations_between(cluster.lift(r, m), c, m, "dog", "cat").collect()
    assert [tuple(x) for x in rows] == [("backward", "Cat, cat", "isA", "dog")]
    assert audit.check_enriched(cluster.lift(r, m), r, m).first()["ok"]
