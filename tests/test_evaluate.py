"""Evaluation helpers, configuration and the command line."""

import json

import pytest

from kgloom import __main__ as cli
from kgloom import config
from kgloom.operators import cluster, evaluate


def test_case_bundle(spark):
    base = spark.createDataFrame([("dog", "isA", "animal")], "s string, p string, o string")
    more = base.unionByName(spark.createDataFrame([("dog", "relatedTo", "cat"), ("sea", "isA", "water")], "s string, p string, o string"))
    out = evaluate.case(more, base, ["dog", "cat"])
    assert [tuple(r) for r in out["added"].collect()] == [("dog", "relatedTo", "cat")]
    assert out["metrics_enriched"].first()["hit_rate"] == 100.0 and out["metrics_baseline"].first()["hit_rate"] == 50.0
    assert out["bridges_baseline"].count() == 0 and out["context_enriched"].first()["section"] == "bridge"
    assert evaluate.sweep(more, out["bridges_enriched"], ["dog"], [1, 2])[1].count() == 1
    assert evaluate.prioritised(more, "dog", "cat").where("rank = 1").first()["o"] == "cat"


def test_compared_over_all(spark):
    d = spark.createDataFrame([("x", 1.0, 2.0), ("y", 1.0, 1.0)], "i string, a double, b double")
    r = evaluate.compared(d, [], "a", "b").first()
    assert r["improvement"] == pytest.approx(50.0) and r["n_eff"] == 1
    _, bad = evaluate.arms(spark.createDataFrame([("p", "i", 1.0, 2.0), ("q", "i", 1.1, 2.0)], "arm string, item string, b double, v double"), "arm", "item", "b", "v")
    assert bad.count() == 1
    f = evaluate.first_rows(spark.createDataFrame([("k", 2, 5.0), ("k", 1, None)], "k string, n int, v double"), "k", "n", {"v": 0.5})
    assert f.first()["v"] == 0.5


def test_scalability(spark):
    c = spark.createDataFrame([(str(i), "") for i in range(10)], "concept string, sense string")
    u = spark.createDataFrame([(str(i), str(i // 2)) for i in range(10)], "concept string, url string")
    r = evaluate.scalability(spark, c, u, [0.5, 1.0], 1, cluster.cluster).collect()
    assert [x["concepts"] for x in r] == [5, 10]


def test_config(tmp_path):
    assert config.merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": 2}, "d": {"e": 1}}
    assert config.run_id(2, 25, 3) == 53 and config.file_identity(str(tmp_path / "no")) == ""
    p = config.Phases()
    with p.phase("a"), p.phase("b"):
        pass
    assert set(p.seconds) == {"a", "b"} and len(p.rows("r")) == 2
    (tmp_path / "c.yaml").write_text("a: {b: 1}")
    assert config.read(str(tmp_path / "c.yaml")) == {"a": {"b": 1}} and config.file_identity(str(tmp_path / "c.yaml"))


def test_build_from_config(spark, tmp_path):
    (tmp_path / "e.tsv").write_text("/a\t/r/Hypernym\t/c/en/dog/n\t/c/en/animal/n\t{}\n/a\t/r/ExternalURL\t/c/en/dog/n\thttp://x/dog\t{}\n")
    (tmp_path / "nouns.txt").write_text("dog\n")
    (tmp_path / "map.json").write_text(json.dumps({"hypernym": {"rel": "isA"}}))
    c = {"sources": ["curated", "commonsense"], "files": {"commonsense": str(tmp_path / "e.tsv"), "curated": str(tmp_path / "nouns.txt")}, "edge_mappings": [str(tmp_path / "map.json")]}
    out = cli.build(spark, c)
    assert out["triples"].where("p like '%/isA1'").count() == 1 and out["clusters"].count() == out["concepts"].count()
    with pytest.raises(ValueError):
        cli.build(spark, c | {"sources": ["other"]})
    assert cli.main([]) == 2
