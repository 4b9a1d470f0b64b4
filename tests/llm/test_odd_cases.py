"""Clashing names, empty tables, very long texts, ties and repeated rows, for each operator and each stage."""

import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kgloom.llm import ann, bpe, common, jaccard, langid, media, packing, ppm, quality, secrets, warc

JSON = public_tokenizers.path("byte_bpe_50k.json")
CLASH = ["n", "_n", "score", "_score", "quality_score", "lang_pred", "lang_score", "lang_", "clean", "_clean", "maybe", "_maybe", "id", "_id", "drop", "held_out", "component_id", "label", "sig", "key", "predicted", "N"]
MANY = 2_000_000
LONG = [(1, " " * MANY), (2, "\n" * MANY), (3, ".,;:!?" * (MANY // 6)), (4, "word " * (MANY // 5)), (5, "x" * MANY), (6, "é" * (MANY // 2)), (7, None)]


def clashing(spark):
    rows = [(i, f"the text number {i} of the others here" if i % 4 else None, "en", "s", 30 + i) for i in range(12)] + [(11, "again", "en", "s", 5)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("*", *[F.concat(F.lit(c + "-"), "doc_id").alias(c) for c in CLASH if c != "N"]).repartition(3)


def kept(before, after):
    """Whether the columns of `after` are those of `before`, with the values they had."""
    assert after.columns == before.columns
    same = [c for c in before.columns if c not in ("text", "n_chars")]
    return after.select(same).exceptAll(before.select(same)).isEmpty()


@pytest.mark.parametrize("stage", range(4))
def test_stages_keep_columns_that_clash(spark, small, stage):
    import corpus_pipeline as c

    docs = clashing(spark)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    out = c.STAGES[stage][1](spark, docs, small)
    assert kept(docs, out)
    if stage == 1:
        m = quality.train(docs, labels)
        found = quality.scored(docs, m)
        assert found.columns == [*docs.columns, "_quality_score"] and kept(docs, found.select(docs.columns))
        assert found.select("_quality_score").first()[0] <= 1
    if stage == 0:
        found = langid.identified(docs, langid.train(docs))
        assert found.columns[-2:] == ["_lang_pred", "_lang_score"] and kept(docs, found.select(docs.columns))


def test_kept_columns_that_clash(spark):
    docs = clashing(spark)
    keep = ["doc_id", "score", "_score", "n", "label"]
    got = quality.score_rows(docs, None, keep)
    assert got.columns == [*keep, "__score"] and got.where("`__score` = 0.5 and score = concat('score-', doc_id)").count() == 13
    got = langid.identify(docs, None, ["doc_id", "lang_pred", "score", "text"])
    assert got.columns == ["doc_id", "lang_pred", "score", "text", "_lang_pred", "_score"] and got.where("`_lang_pred` = 'und' and score = concat('score-', doc_id)").count() == 13
    assert common.unused("N", ["n", "_n", "x"]) == "__N"


def test_operators_do_not_read_other_columns(spark):
    docs, plain = clashing(spark), clashing(spark).select("doc_id", "text")
    for f in (lambda d: jaccard.near_duplicates(spark, d), secrets.scan, media.text_media, lambda d: bpe.round_trip_digests(d, JSON), lambda d: packing.pack(d, JSON).drop("sequence_id", "offset")):
        assert f(docs).exceptAll(f(plain)).isEmpty()
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"), *CLASH[:4])
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(spark, pages))).count() == 13
    v = spark.range(40).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1).cast("float")).alias("embedding"), F.lit(1).alias("id"), F.lit(2).alias("list"), F.lit(3).alias("v"))
    assert ann.search(spark, v).count() == 2 * 20


def test_empty_tables(spark, tmp_path):
    d, e = clashing(spark).limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    m = quality.train(d, e)
    assert m is None and quality.score_rows(d, m, ["doc_id"]).count() == 0 and quality.scored(d, m).count() == 0
    t = langid.train(d)
    assert t is None and langid.identify(d, t, ["doc_id"]).count() == 0 and langid.identified(d, t).count() == 0
    assert secrets.scan(d).count() == 0 and secrets.redact_column(d).count() == 0
    assert media.text_media(d).count() == 0
    k = d.select(F.lit(1).cast("long").alias("key"), "doc_id", F.lit(True).alias("held_out"), "text")
    assert ppm.score(spark, k, k).count() == 0
    # whole queries over empty tables
    d.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    e.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    from kgloom.llm import registry

    for name, f in registry.queries().items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_very_long_texts(spark):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(*r, "en") for r in LONG], "doc_id long, text string, lang string").repartition(3)
    t = Tokenizer.from_file(JSON)
    tokens = {i: t.encode(x or "", add_special_tokens=False).ids for i, x in LONG}
    got = {r["doc_id"]: r for r in bpe.round_trip_digests(docs, JSON).collect()}
    packed = packing.pack(docs, JSON).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in packed} == {i: len(x) + 1 for i, x in tokens.items()}
    for i, x in LONG:
        assert got[i]["n_tokens"] == len(tokens[i]) and got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, tokens[i])).encode()).hexdigest()
        assert got[i]["decoded_sha256"] == hashlib.sha256((x or "").encode()).hexdigest()
    assert {r["doc_id"]: r["n_bytes"] for r in media.text_media(docs).collect()} == {i: len((x or "").encode()) for i, x in LONG}
    assert secrets.scan(docs).where("spans != ''").count() == 0 and secrets.redact_column(docs).where("length(text) = 2000000").count() == 4
    near = {r["doc_id"]: r["n_shingles"] for r in jaccard.near_duplicates(spark, docs).collect()}
    assert (near[1], near[2], near[4], near[5], near[7]) == (0, 0, 1, 1, 0)
    lang = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, langid.train(docs), ["doc_id"]).collect()}
    assert lang == {i: "en" if i in (4, 5, 6) else "und" for i, _ in LONG}
    scores = quality.score_rows(docs, quality.train(docs, spark.createDataFrame([(4, 1), (5, 0)], "doc_id long, quality int")), ["doc_id"]).collect()
    assert len(scores) == len(LONG) and all(0 <= r["score"] <= 1 for r in scores)
    k = docs.select(F.col("doc_id").alias("key"), "doc_id", F.lit(False).alias("held_out"), "text")
    found = {r["doc_id"]: r for r in ppm.score(spark, k, k).collect()}
    assert found[4]["n_tokens"] == MANY // 5 + 1 and all(np.isfinite(r["score"]) for r in found.values())
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    back = {r["page_id"]: r["payload_bytes"] for r in warc.read_archives(warc.normalise_archives(warc.write_archives(spark, pages))).collect()}
    assert back == {i: len((x or "").encode()) for i, x in LONG}


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "WEIGHTS", 1 << 20)
    many = 70
    rows = [(i, chr(0x4E00 + i % many) * 3 + " " + chr(0x4E00 + i % many), f"l{i % many:03}") for i in range(6 * many)] + [(10_000, "none", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    m = langid.train(docs, per_lang=50, most=100)
    assert len(m["langs"]) == many and m["bits"] == 13 and m["w"].size <= 1 << 20
    got = langid.identify(docs.where("lang is not null"), m, ["doc_id", "lang"]).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.9
    with pytest.raises(ValueError):
        langid.bits_for(1 << 22)


def test_repeated_labels_and_rows_teach_once(spark):
    docs = clashing(spark).select("doc_id", "text", "lang", "n_chars").where("text is not null").dropDuplicates(["doc_id"])
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    a, b = quality.train(docs, labels), quality.train(docs.unionByName(docs), labels.unionByName(labels))
    assert (a["w"] == b["w"]).all() and (a["v"] == b["v"]).all() and a["prior"] == b["prior"]
    x, y = langid.train(docs), langid.train(docs)
    assert (x["w"] == y["w"]).all() and x["t"] == y["t"]


def test_ties_of_languages_go_to_the_first(spark):
    docs = spark.createDataFrame([(i, "same", "ab"[i % 2]) for i in range(8)], "doc_id long, text string, lang string")
    m = langid.train(docs)
    m["w"][:] = 0
    assert langid.predict(m, "same") == ("a", 0.5)
