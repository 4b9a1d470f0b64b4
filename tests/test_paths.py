"""Shortest paths of any length and from any start; path_len against its SQL on pages unlike the given ones."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from parity import TABLES, difference
from pyspark.sql import functions as F

from kgloom.operators import retrieve
from kgloom.plans.registry import ORACLES, QUERIES

#: Page i links to i and i + 1, so that page i is 2 * i hops from page 0.
CHAIN = [(i, f'<a href="/{i}"><a href="/{i + 1}">') for i in range(40)]
PAGES = {
    "long_chain": CHAIN,
    "no_page_0": [(i + 1, html) for i, html in CHAIN[:3]],
    "page_0_again": CHAIN[:3] * 2,
    "page_0_without_links": [(0, "no link"), (1, '<a href="/1">')],
    "null_page": [*CHAIN[:5], (None, '<a href="/1"><a href="/4"><a href="/9">'), (3, None)],
}


@pytest.mark.parametrize("case", PAGES)
def test_path_len_agrees_on_odd_pages(spark, small, tmp_path, case):
    for t in TABLES:
        if t != "pages":
            os.symlink(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    ids, html = zip(*PAGES[case])
    pq.write_table(pa.table({"page_id": pa.array(ids, pa.int64()), "url": [f"http://x/{i}" for i in ids], "html": pa.array(html, pa.string())}), tmp_path / "pages.parquet")
    assert difference(spark, str(tmp_path), QUERIES["path_len"], ORACLES["path_len"]) is None


def test_distances_of_any_length(spark, monkeypatch):
    monkeypatch.setattr(retrieve, "UNITED", 10)  # 36 hops go through three unions
    e = spark.range(36).select(F.col("id").cast("string").alias("a"), (F.col("id") + 1).cast("string").alias("b"), F.lit("v").alias("via"))
    start = spark.createDataFrame([("0",), ("0",)], "node string")
    got = retrieve.distances(spark, e, start).collect()
    assert sorted((int(r["node"]), r["hops"], len(r["path"]), len(r["vias"])) for r in got) == [(i, i, i + 1, i) for i in range(37)]
    assert sorted((r["node"], r["hops"]) for r in retrieve.distances(spark, e, start, 2).collect()) == [("0", 0), ("1", 1), ("2", 2)]
