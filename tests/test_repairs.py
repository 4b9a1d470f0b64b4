"""Operators rebuilt for scale, and those added with them, against plain versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgloom.operators import audit, cluster, evaluate, explain, matching, rdf, stats
from kgloom.session import cached, shared_dir
from kgloom.sources import loaders, readers, turtle


def test_quantiles_are_exact(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), float(rng.randint(0, 20)) if rng.random() < 0.9 else None) for _ in range(500)] + [("d", 7.0)]
    got = {r["k"]: (r["q1"], r["q3"]) for r in stats.quantiles(spark.createDataFrame(rows, "k string, v double").repartition(5), ["k"], "v", {"q1": 0.25, "q3": 0.75}).collect()}
    for k in "abcd":
        x = [v for g, v in rows if g == k and v is not None]
        assert got[k] == pytest.approx((np.quantile(x, 0.25), np.quantile(x, 0.75)))


def test_fraction_of_ids(spark):
    from hashlib import md5

    ids = [i % 37 for i in range(50)]
    df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(4)
    want = sorted(ids, key=lambda i: (md5(f"{i}|s".encode()).hexdigest(), i))
    for fraction in (0.0, 0.25, 0.5, 1.0):
        got = Counter(r["id"] for r in audit.fraction_sample(df, "id", fraction, "s").collect())
        assert got == Counter(want[: int(50 * fraction)])


def test_numbers_of_predicates(spark):
    rows = [(r, n, w) for r in ("isA", "eq") for n in (True, False) for w in (3.0, 1.0, 2.0)] * 2
    got = {(r["rel"], r["negated"], r["weight"]): r["predicate"] for r in rdf.reified(spark.createDataFrame(rows, "rel string, negated boolean, weight double")).collect()}
    for rel in ("isA", "eq"):
        for i, key in enumerate(sorted({(n, w) for r, n, w in rows if r == rel})):
            assert got[rel, *key] == f"{rel}{i + 1}"


def test_constrained_endpoints_of_null_keys(spark):
    rows = [(1, "a", "N", "V"), (2, "a", "V", "V"), (3, "b", "N", "V"), (4, None, "N", "N"), (5, None, "V", "N"), (6, "c", None, None)]
    got = cluster.constrained_endpoints(spark.createDataFrame(rows, "id int, k string, pos string, want string"), "pos", "want", ["k"]).collect()
    assert {r["id"] for r in got} == {2, 3, 4, 6}


def test_long_chains_and_circles_of_ids(spark):
    links = [(f"c{i}", f"c{i + 1}") for i in range(100)] + [("x", "y"), ("y", "x"), ("e", "nowhere"), ("k1", "c0")]
    f = lambda rows, s: spark.createDataFrame(rows, s)
    got = loaders.resolved_ids(f([("c0",), ("c99",), ("x",), ("e",), ("c100",), ("k1",)], "id string"), f([("c100",), ("k1",)], "id string"), f(links, "alt_id string, place string"))
    assert {tuple(r) for r in got.collect()} == {("c0", "c100"), ("c99", "c100"), ("c100", "c100"), ("k1", "k1")}


def test_evidence_joins_what_formation_joins(spark):
    rng = random.Random(3)
    urls = spark.createDataFrame([(f"c{rng.randrange(12)}", f"u{rng.randrange(6)}") for _ in range(60)], "concept string, url string")
    clusters = spark.createDataFrame([(f"c{i}", f"k{i % 3}") for i in range(12)], "concept string, cluster string")
    sets = lambda df: {frozenset(v) for v in groups(df).values()}

    def groups(df):
        out = defaultdict(set)
        for r in df.collect():
            out[r["cluster"], r["url"]] |= {r["a"], r["b"]}
        return out

    assert sets(explain.evidence(clusters, urls)) == sets(explain.formation(clusters, urls))


def test_scores_of_any_length(spark):
    rows = [("Score: 7/10",), ("Score: 007",), ("none",), (None,), ("Score: 5000000000",), ("Score: " + "9" * 30,)]
    got = [r["s"] for r in spark.createDataFrame(rows, "a string").select(evaluate.judge_score("a").alias("s")).collect()]
    assert got == [7, 7, None, None, 5_000_000_000, (1 << 63) - 1]


def test_turtle():
    text = """@prefix : <http://x/> . PREFIX w: <http://w/>
    @base <http://b/c/> .
    :a a :T ; w:p 1, 2.5 , -3e2, true ; ; :q "x\\"y\\u00e9"@en-GB, '''long
    ' one''' .  # note
    <d> :r [ :s "v"^^w:t ; :u _:n ] , ( :i "j" ) , () .
    [ :s :t ] .
    """
    got = {(s if not s.startswith("_:") else "_", p, o if not o.startswith("_:") else "_", k, d, lang) for s, p, o, k, d, lang in turtle.Reader(text).triples()}
    x, rdf_, xsd = "http://x/", turtle.RDF, turtle.XSD
    assert got == {
        (x + "a", rdf_ + "type", x + "T", "iri", None, None), (x + "a", "http://w/p", "1", "literal", xsd + "integer", None), (x + "a", "http://w/p", "2.5", "literal", xsd + "decimal", None), (x + "a", "http://w/p", "-3e2", "literal", xsd + "double", None), (x + "a", "http://w/p", "true", "literal", xsd + "boolean", None),
        (x + "a", x + "q", 'x"yé', "literal", None, "en-GB"), (x + "a", x + "q", "long\n    ' one", "literal", None, None), ("http://b/c/d", x + "r", "_", "bnode", None, None), ("http://b/c/d", x + "r", rdf_ + "nil", "iri", None, None), ("_", x + "s", "v", "literal", "http://w/t", None), ("_", x + "u", "_", "bnode", None, None),
        ("_", rdf_ + "first", x + "i", "iri", None, None), ("_", rdf_ + "first", "j", "literal", None, None), ("_", rdf_ + "rest", "_", "bnode", None, None), ("_", rdf_ + "rest", rdf_ + "nil", "iri", None, None), ("_", x + "s", x + "t", "iri", None, None),
    }
    for bad in (":a :b :c", "<a> <b> .", "<a> <b> <c>", "<a> <b> ~ ."):
        with pytest.raises(ValueError):
            turtle.Reader(bad).triples()


def test_groups_of_pairs():
    pairs = [("a", "b", 5.0), ("b", "c", 4.0), ("d", "e", 3.0), ("c", "d", 2.0), ("b", "f", 1.0)]
    assert matching.grouped(pairs) == [(["b", "a", "c"], 9.0), (["d", "e", "c"], 5.0)]
    assert matching.grouped([]) == []


def test_entities_and_properties(spark, tmp_path):
    lines = ['<http://www.wikidata.org/entity/Q5> <http://www.w3.org/2000/01/rdf-schema#label> "a \\"b\\""@en .', '<http://www.wikidata.org/entity/P5> <http://www.w3.org/2000/01/rdf-schema#label> "x"@en .', "junk"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [tuple(r) for r in readers.entity_labels(df, "en").collect()] == [("http://www.wikidata.org/entity/Q5", 'a "b"')]
    (tmp_path / "p.csv").write_text("P1,name,d,t,3\nP2,other,d,t,4\n")
    allowed = spark.createDataFrame([("P2 ",)], "id string")
    assert [tuple(r) for r in readers.property_labels(spark, str(tmp_path / "p.csv"), allowed).collect()] == [("http://www.wikidata.org/entity/P2", "other")]


def test_cache_and_shared_folder(spark, tmp_path, monkeypatch):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for key in ("a", "a", "b"):
        assert cached(spark, make, key, str(tmp_path)).count() == 3
    assert len(made) == 2

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    with pytest.raises(RuntimeError):
        shared_dir(type("Session", (), {"conf": Conf()})())


def test_hints_of_classes(spark):
    e = spark.createDataFrame([("1", "2", "isA"), ("1", "3", "isA"), ("2", "4", "eq")], "start string, end string, rel string")
    c = spark.createDataFrame([("1", "run", "Verb"), ("2", "run", "Noun"), ("3", "walk", "Verb"), ("4", "run", "Noun")], "concept string, term string, pos string")
    hints = cluster.cross_class_hints(e, c)
    assert [tuple(r) for r in hints.collect()] == [("run", "isA", "Verb", "Noun")]
    k = c.select("concept", F.concat(F.lit("k"), "concept").alias("cluster"))
    assert {tuple(r) for r in cluster.lifted_hints(hints, c, k).collect()} == {("k1", "k2", "isA"), ("k1", "k4", "isA")}
