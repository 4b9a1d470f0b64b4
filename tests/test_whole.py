"""Queries that read whole tables, against plain Python over the same tables, besides their SQL."""

import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from kgloom.operators import retrieve
from kgloom.plans.registry import QUERIES


def read(folder, name, *columns):
    return pq.read_table(f"{folder}/{name}.parquet", columns=list(columns)).to_pylist()


def test_parts_share_all_orders(spark, small):
    above = {}

    def root(x):
        while above.setdefault(x, x) != x:
            above[x] = x = above[above[x]]
        return x

    for r in read(small, "lineitem", "l_orderkey", "l_partkey"):
        a, b = root(f"c:p:{r['l_partkey']}"), root(f"u:o:{r['l_orderkey']}")
        above[max(a, b)] = min(a, b)
    assert {(r["node"], r["component"]) for r in QUERIES["cc_parts"](spark, small).collect()} == {(x, root(x)) for x in list(above)}
    kind = {f"p:{r['p_partkey']}": r["p_type"].lower() for r in read(small, "part", "p_partkey", "p_type")}
    groups = {}
    for p, k in kind.items():
        groups.setdefault((root(f"c:{p}"), k), []).append(p)
    want = {(p, min(g)) for g in groups.values() for p in g}
    got = {(r["concept"], r["cluster"]) for r in QUERIES["cluster_coherent"](spark, small).collect()}
    assert {x for x in got if x[0].startswith("p:")} == want


def test_keywords_of_whole_texts(spark, small):
    texts = [(f"d{r['doc_id']}", "mentions", r["text"]) for r in read(small, "documents", "doc_id", "text")] + [(f"b{r['item_id']}", "isA", r["text"]) for r in read(small, "benchmark", "item_id", "text")]
    triples = {(s, p, re.sub(r"[ \t\n\x0b\f\r]+", "_", t)) for s, p, t in texts if t is not None}
    found = [{t for t in triples if re.search(f"(^|[^a-zA-Z0-9]){k}([^a-zA-Z0-9]|$)", t[2], re.I)} for k in ("the", "of", "and")]
    assert {tuple(r) for r in QUERIES["subgraph_kw"](spark, small).select("s", "p", "o").collect()} == set().union(*found)
    r = QUERIES["keyword_metrics"](spark, small).first()
    assert (r["hit_rate"], r["relation_diversity"], r["subgraph_volume"]) == (round(sum(map(bool, found)) * 100 / 3, 9), 2, len(triples))


def test_cosine_search_of_every_hundredth_row(spark, small):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in read(small, "embeddings", "vec_id", "embedding")}
    unit = {k: v / np.linalg.norm(v) for k, v in rows.items()}
    want = {q: np.mean(sorted((v @ unit[q] for k, v in unit.items() if k != q), reverse=True)[:10]) for q in rows if q % 100 == 0}
    assert {r["q"]: r["mean"] for r in QUERIES["topk_cosine"](spark, small).collect()} == pytest.approx(want, abs=1e-8)


def test_cosine_search_in_blocks(spark):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, (90, 3)).astype(float))] + [(90, [0.0, 0.0, 0.0]), (91, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    got = sorted(tuple(r) for r in retrieve.nearest(spark, df, df.where("id % 10 = 0"), "id", "v", 4, block=7).collect())
    pairs = [(q, i, None if a is None or b is None or not any(a) or not any(b) else np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))) for q, a in rows if q % 10 == 0 for i, b in rows if i != q]
    for q in range(0, 91, 10):
        best = sorted((x[2] for x in pairs if x[0] == q and x[2] is not None), reverse=True)[:4]
        mine = sorted((x[2] for x in got if x[0] == q and x[2] is not None), reverse=True)[:4]
        assert mine == pytest.approx(best) and any(x[0] == q for x in got)


def test_lexical_matches_of_all_names(spark, small):
    from difflib import SequenceMatcher

    pairs = {(r["p_name"], f"{r['p_type'].lower()} {r['p_name'].split(' ')[1]}") for r in read(small, "part", "p_name", "p_type")}
    iri = lambda kind, t: f"http://kgloom.example/{kind}#" + re.sub("[^A-Za-z0-9]", "_", t)
    targets = {t for _, t in pairs}

    def score(a, b):
        x, y = set(a.split(" ")), set(b.split(" "))
        return max(len(x & y) / len(x | y), SequenceMatcher(None, a, b).ratio()) if x & y else -1.0

    best = {}
    for s in {s for s, _ in pairs}:
        best[iri("source", "kb.").replace("kb_", "kb.") + iri("", s).split("#")[1]] = min((-score(s, t), iri("canonical", t)) for t in targets)
    rows = QUERIES["lexical_matches"](spark, small).collect()
    assert len(rows) == len(pairs)
    for r in rows:
        assert r["predicted"] == best[r["source_iri"]][1] and r["correct"] == (r["predicted"] == r["canonical_iri"])


def test_all_orders_are_rated(spark, small):
    x = np.array([[k % 5 + k * r % 3 for r in (1, 2, 3)] for k in (r["o_orderkey"] for r in read(small, "orders", "o_orderkey"))], float)
    observed = np.mean([np.mean([(a[i] - a[j]) ** 2 for i in range(3) for j in range(3) if i != j]) for a in x])
    all_ = x.ravel()
    expected = 2 * all_.size * all_.var() / (all_.size - 1)
    assert QUERIES["kripp_alpha"](spark, small).first()["alpha"] == pytest.approx(1 - observed / expected, abs=1e-8)


def test_overlap_covers_all_orders(spark, small):
    sides = [Counter(), Counter()]
    for r in read(small, "orders", "o_orderkey", "o_orderstatus", "o_orderpriority"):
        sides[r["o_orderkey"] % 2][r["o_orderstatus"], r["o_orderpriority"]] += 1
    n, common = Counter(), Counter()
    for (k, v), m in sides[0].items():
        n[k] += m
        common[k] += min(m, sides[1][k, v])
    assert {r["k"]: (r["n"], r["common"], r["recall"]) for r in QUERIES["overlap_recall"](spark, small).collect()} == {k: (n[k], common[k], pytest.approx(common[k] / n[k], abs=1e-8)) for k in n}
