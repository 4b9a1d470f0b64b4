"""Each operator against brute force, a round trip, or held-out accuracy, and its defined results in odd cases."""

import hashlib
import json
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from kgloom.llm import ann, bpe, common, jaccard, langid, media, packing, ppm, quality, secrets, warc

JSON = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "x"), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "no id"), (7, "long " * 30_000), (8, "é 中 \x00 😀 <|endoftext|>")]


def odd(spark):
    """Odd documents, with columns that clash with names of the operators' own."""
    rows = [(i, t, "en", "s", None if t is None else len(t), 0, "key", 1.0) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n long, key string, score double").repartition(3)


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0))


# common

def test_cache_is_bounded_and_right():
    c = common.BoundedCache(lambda k: k * 2, 10, 5)
    assert all(c[str(i)] == str(i) * 2 for i in [*range(100), *range(50), 3, 3])
    assert len(c) <= 10 and len(c.old) <= 10 and c["toolong"] == "toolongtoolong" and "toolong" not in c


def test_words_know_ascii_only():
    assert common.words_of("A B\x0bÉ\x1cC d") == ["a b".encode(), "É\x1cc".encode(), b"d"]


# 10

def test_bpe_is_the_library(spark, small):
    from tokenizers import Tokenizer

    t, b = Tokenizer.from_file(JSON), bpe.ByteBPE(JSON, 500)
    rng = random.Random(10)
    texts = [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").select("text").collect()] + [x or "" for _, x in ODD]
    texts += ["".join(rng.choice("a bZ9'sé\n\t\x85\xa0 ⅷ²中😀\x1c.#$<|endoftext|>") for _ in range(rng.randint(0, 60))) for _ in range(500)] + ["a" * 3000, "ab" * 300, " " * 999 + "x"]
    for text, e in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert b.encode(text) == e.ids
        assert b.decode(e.ids) == t.decode(e.ids, skip_special_tokens=False) == text
    ids = [rng.randrange(50257) for _ in range(200)]
    assert b.decode(ids) == t.decode(ids, skip_special_tokens=False)


def test_bpe_long_words_merge_alike():
    b = bpe.ByteBPE(JSON)
    for w in ("strengthlessness" * 5, "aaaaaaaaaaaaaaaa" * 5, "abcabcabcxyz" * 7):
        assert b.merge(w) == b.merge_long([b.of_byte[x] for x in w.encode()])


def test_bpe_columns_and_digests(spark):
    docs = odd(spark)
    r = bpe.decode_column(bpe.encode_column(docs, "text", JSON), "ids", JSON)
    assert r.where(F.coalesce("text", F.lit("")) != F.col("decoded")).count() == 0 and r.count() == len(ODD)
    rows = by_id(bpe.round_trip_digests(docs, JSON))
    assert len(rows) == len(ODD) and rows[0][:3] == (1, 0, hashlib.sha256(b"").hexdigest())
    assert bpe.round_trip_digests(docs.limit(0), JSON).count() == 0


# 8

@pytest.mark.parametrize("shape", [(1, 1, 3), (5, 7, 3), (3, 64, 3)])
def test_media_codecs_round_trip(shape):
    p = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.to_ppm(p)) == p).all() and (media.decode(media.to_bmp(p)) == p).all()
    assert (media.decode(media.to_ppm(p[:, :, 0])) == p[:, :, 0]).all()


def test_media_other_kinds():
    assert media.decode(b"P2 # c\n2 1\n# x\n300\n7 300").tolist() == [[7, 300]]
    assert media.decode(b"P1\n3 1\n1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    for bad in (b"", b"P6\n2 2\n255\nxx", b"BM", b"P6\n2", b"P2\n2 2\n9\n1"):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_media_resize_is_area_average():
    p = np.random.default_rng(2).integers(0, 256, (12, 20), dtype=np.uint8)
    fine = np.kron(p.astype(float), np.ones((7, 9)))  # 84 x 180: whole cells of 12 x 20 over 7 x 9
    want = fine.reshape(7, 12, 9, 20).mean(axis=(1, 3))
    assert np.allclose(media.area_resize(p, 7, 9), want)
    tall = np.random.default_rng(3).integers(0, 256, (media.BAND * 2 + 100, 4), dtype=np.uint8)
    assert np.allclose(media.area_resize(tall, 4, 2), tall.reshape(4, -1, 2, 2).mean(axis=(1, 3)))


def test_media_tiles(spark):
    import io

    p = np.arange(70 * 65, dtype=np.uint8).reshape(70, 65)
    tiles = [np.load(io.BytesIO(t)) for t in media.npy_tiles(p)]
    assert [t.shape for t in tiles] == [(64, 64), (64, 1), (6, 64), (6, 1)] and (tiles[0] == p[:64, :64]).all()
    df = spark.createDataFrame([(1, bytearray(media.to_ppm(p))), (2, None), (3, bytearray(b"junk"))], "id long, m binary")
    rows = media.tile_table(df, "m", "id").collect()
    assert [(r["id"], r["tile"]) for r in rows] == [(1, 0)]


def test_media_of_texts(spark):
    rows = by_id(media.text_media(odd(spark)))
    assert len(rows) == len(ODD)
    for (i, t), r in zip(sorted(ODD, key=lambda x: (x[0] is None, x[0] or 0)), rows):
        raw = (t or "").encode()
        pay = raw + b" " * (192 - len(raw) % 192 if len(raw) % 192 or not raw else 0)
        assert r[:5] == (i, len(raw), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-16:]))
    assert rows[0][1:] == rows[1][1:]


# 5

def brute_spans(text):
    out = []
    for k, (kind, pattern, group, least) in enumerate(secrets.RULES):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, re.ASCII) if m.end(group) - m.start(group) >= least]
    return sorted(out)


def test_secrets_find_what_regexes_find():
    rng = random.Random(5)
    parts = ["password: abcdefgh", "PassWD='x1234567'", "token=short", "api_key = \"AAAAAAAAAA\"", "APIKEY:12345678", "AKIA" + "B" * 12, "AKIA123", "0123456789abcdef" * 2, "f" * 31, "ghp_" + "a" * 36, "xoxb-1234567890", "eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9, "-----BEGIN RSA PRIVATE KEY-----", "AIza" + "d" * 35, "sk_live_" + "1" * 16, "é中", " ", "\n", "secret:", "toKen:Kaaaaaaa", "deadbeef"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(800)] + ["", "x" * 5000]
    assert secrets.Scanner().block(texts) == [brute_spans(t) for t in texts]


def test_secret_queries():
    assert secrets.trigram_query("[0-9a-f]+") is True
    assert secrets.trigrams(secrets.trigram_query("AKIA[A-Z]+")) == {"aki", "kia"}
    assert secrets.trigram_query("(ab|abc)x?") is True or secrets.evaluate(secrets.trigram_query("(ab|abc)x?"), defaultdict(set), range(3))
    q = secrets.trigram_query("(abcd|xyz)+z")
    assert secrets.evaluate(q, {"abc": {0}, "bcd": {0, 1}, "xyz": {2}}, range(3)) == {0, 2}


def test_secret_rows(spark):
    docs = spark.createDataFrame([(1, "a password=abcdefgh1 b", 22, "k"), (2, None, None, "k"), (3, "", 0, "k"), (None, "AKIA" + "Z" * 16, 20, "k")], "doc_id long, text string, n_chars long, spans string")
    rows = {r["doc_id"]: r for r in secrets.scan(docs).collect()}
    assert rows[1]["spans"] == "assign:2:20" and rows[1]["base_sha256"] == hashlib.sha256(b"assign:2:20").hexdigest()
    assert rows[2]["n_assign"] == 0 and rows[None]["n_access"] == 1
    clean = {r["doc_id"]: (r["text"], r["n_chars"]) for r in secrets.redact_column(docs).collect()}
    assert clean == {1: ("a [assign] b", 12), 2: (None, None), 3: ("", 0), None: ("[access]", 8)}


# 4

def test_packing_holds_each_id_once(spark):
    from tokenizers import Tokenizer

    docs = odd(spark)
    t = Tokenizer.from_file(JSON)
    rows = packing.pack(docs, JSON, 64).collect()
    per, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        per[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    texts = dict(ODD)
    for i, found in per.items():
        ids = [*t.encode(texts[i] or "", add_special_tokens=False).ids, 0]
        copies = sum(1 for k, _ in ODD if k == i)
        covered = Counter(p for r in found for p in range(r["start"], r["start"] + r["length"]))
        assert set(covered) == set(range(len(ids))) and set(covered.values()) == {copies}
        for r in found:
            assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    for pieces in seqs.values():
        pieces.sort(key=lambda r: r["offset"])
        ends = np.cumsum([0, *[r["length"] for r in pieces]])
        assert [r["offset"] for r in pieces] == ends[:-1].tolist() and ends[-1] <= 64
    short = [s for s in seqs.values() if sum(r["length"] for r in s) < 64]
    assert len(short) <= docs.rdd.getNumPartitions()
    assert packing.pack(docs.limit(0), JSON).count() == 0


def test_packing_of_long_white_space():
    from tokenizers import Tokenizer

    t, encode = Tokenizer.from_file(JSON), packing.encoder(JSON)
    many = 1_000_000
    for text in ("\n" * many, "a" + " " * many + "b", "x \n" + "\n" * many + "é  y", " " * many + "<|endoftext|>" + "\t" * 150_000 + "\xa0z", "a" + " " * 99_999 + "b" + " " * 100_001 + "'s", "\u3000 " * 60_000 + "中"):
        assert np.frombuffer(encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_packing_takes_the_least_sum_of_squares():
    rng = random.Random(4)
    p = packing.SumOfSquares(16)
    for i in range(400):
        k, before = rng.randint(1, 15), p.levels.copy()
        costs = {}
        for h in range(0, 17 - k):
            if h == 0 or before[h]:
                after = before.copy()
                after[h] -= h > 0
                after[h + k] += 1
                costs[h] = int((after[1:16] ** 2).sum())
        p.add(i, bytes(4 * k))
        assert int((p.levels[1:16] ** 2).sum()) == min(costs.values())


# 7

def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", h) for i, h in enumerate([None, "", "a" * 99, "a" * 99, "b" * 100, "b" * 100, "é" * 60, "c\r\n\r\nWARC/1.1" * 40])] + [(5, "http://y", "b" * 100), (None, "", "b" * 100), (9, None, "d" * 200_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    archives = warc.write_archives(spark, pages)
    for a in archives.collect():
        assert len(zlib.decompressobj(31).decompress(a["data"])) > 0
    found = warc.read_archives(warc.normalise_archives(archives)).collect()
    assert len(found) == len(rows)
    got = sorted((r["page_id"] if r["page_id"] is not None else -1, r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"]) for r in found)
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        copy = raw == b"b" * 100 and i in (5,)
        want.append((i if i is not None else -1, "revisit" if copy else "response", 4 if copy else None, len(raw), hashlib.sha256(raw).hexdigest()))
    assert got == sorted(want)
    assert warc.read_archives(warc.normalise_archives(warc.write_archives(spark, pages.limit(0)))).count() == 0


def test_warc_members_stand_alone():
    recs = [warc.record(i, "http://x", b"p" * i, hashlib.sha256(b"p" * i).hexdigest()) for i in range(5)]
    data, index = warc.normalise(warc.monolith(recs))
    assert [zlib.decompress(data[a : a + n], 31) for a, n in index] == recs
    assert warc.normalise(data) == (data, index)
    with pytest.raises(ValueError):
        warc.normalise(warc.monolith(recs)[:-9])
    with pytest.raises(ValueError):
        list(warc.records_of(iter([recs[0][:-3]])))


# 9 and 1

def test_language_held_out(spark, small):
    r = langid.op9_langid(spark, small).join(spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "lang"), "doc_id")
    held = r.where("held_out").collect()
    assert len(held) > 20 and sum(x["lang"] == x["lang_pred"] for x in held) / len(held) > 0.95
    assert all(0 <= x["score"] <= 1 for x in held)


def test_language_odd_cases(spark):
    docs = odd(spark)
    r = {x["doc_id"]: x for x in langid.identify(docs, langid.train(docs), ["doc_id", "n"]).collect()}
    assert r[1]["lang_pred"] == r[2]["lang_pred"] == r[3]["lang_pred"] == "und" and r[4]["lang_pred"] == "en"
    assert langid.train(docs.where("lang = 'xx'")) is None and langid.predict(None, "text") == ("und", 0.0)
    assert langid.identified(docs, None).count() == len(ODD)


def test_quality_held_out(spark, small):
    folder = small.replace("0.001", "0.01")
    r = quality.op1_quality(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [x["score"] for x in r if x["quality"] == 1], [x["score"] for x in r if x["quality"] == 0]
    assert np.mean([[a > b for b in bad] for a in good]) > 0.97
    assert np.mean([(x["predicted"] == 1) == (x["quality"] == 1) for x in r]) > 0.9


def test_quality_linear_time_form_is_the_pair_sum():
    fm = quality.FactorisationMachine()
    at, x = np.array([3, 9, 40_00, 17]), np.array([0.5, -1.0, 2.0, 0.25])
    pairs = sum(fm.v[at[i]] @ fm.v[at[j]] * x[i] * x[j] for i in range(4) for j in range(i + 1, 4))
    assert fm.raw(at, x) == pytest.approx(pairs + fm.w[at] @ x)


def test_quality_odd_cases(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (7, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    m = quality.train(docs, labels)
    rows = quality.score_rows(docs.drop("score"), m, ["doc_id", "n"])
    assert rows.count() == len(ODD) and all(0 <= r["score"] <= 1 for r in rows.collect())
    assert quality.train(docs, labels.limit(0)) is None and quality.score(None, np.array([1]), np.array([1.0])) == 0.5
    assert quality.scored(docs.drop("n_chars"), None).count() == len(ODD)


# 2

def naive_ppm(texts, order):
    counts = defaultdict(Counter)
    for t in texts:
        s = ppm.stream(common.words_of(t))
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[s[i - k : i]][s[i]] += 1
    return counts


def naive_log(counts, order, text):
    s, total = ppm.stream(common.words_of(text)), 0.0
    for i in range(order, len(s)):
        gone, p = set(), None
        for k in range(order, -1, -1):
            c = counts.get(s[i - k : i])
            if not c:
                continue
            left = {x: n for x, n in c.items() if x not in gone}
            n, q = sum(left.values()), len(left)
            if n and s[i] in left:
                total += np.log10((2 * left[s[i]] - 1) / (2 * n))
                p = True
                break
            if n:
                total += np.log10(q / (2 * n))
            gone |= set(c)
        if p is None:
            total -= np.log10(ppm.ALPHABET - len(gone))
    return total


def test_ppm_is_the_plain_method(spark):
    rng = random.Random(2)
    words = ["the", "then", "there", "Theory", "a", "an", "é", "中", "x9"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 12))) for _ in range(80)] + [None, "", "\t", "zzz unseen", "w" * 60 + " the"]
    docs = spark.createDataFrame([(i, i, i % 3 == 2, t) for i, t in enumerate(texts)], "key long, doc_id long, held_out boolean, text string").repartition(4)
    learned = [t for i, t in enumerate(texts) if i % 3 != 2]
    model = naive_ppm(learned, ppm.ORDER)
    c = Counter(w for t in learned for w in common.words_of(t))
    c[b"\n"] = len(learned)
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in ppm.score(spark, docs, docs.where("not held_out")).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = [*common.words_of(t), b"\n"]
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert got[i]["base_score"] == pytest.approx(sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w))
        assert got[i]["score"] == pytest.approx(naive_log(model, ppm.ORDER, t), abs=1e-3)


def test_ppm_counts_of_rare_grams(spark, monkeypatch):
    monkeypatch.setattr(ppm.train, "__defaults__", (20, 3))
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 12))) for _ in range(120)] + ["ab ab ab " * 30, None, "中文 abc"]
    docs = spark.createDataFrame([(i, i, i % 3 == 2, t) for i, t in enumerate(texts)], "key long, doc_id long, held_out boolean, text string").repartition(4)
    model = naive_ppm([t for i, t in enumerate(texts) if i % 3 != 2], ppm.ORDER)
    for r in ppm.score(spark, docs, docs.where("not held_out")).collect():
        assert r["score"] == pytest.approx(naive_log(model, ppm.ORDER, texts[r["doc_id"]]), abs=1e-3)


def test_ppm_sums_to_one():
    buffer = b"".join(ppm.stream(common.words_of(t)) for t in ("the cat", "the hat then", "a"))
    keys, n = np.unique(ppm.grams_of(buffer)[0], return_counts=True)
    m = ppm.Model(keys, n)
    for ctx in (b"\t\t\t\t\t", b"e the", b"zzzzz", b"the h"):
        every = np.array([int.from_bytes(ctx, "big") << 8 | s for s in range(256) if s not in (9, 11, 12, 13)], np.int64)
        assert (10 ** m.log10(every)).sum() == pytest.approx(1, abs=1e-6)


def test_ppm_without_training(spark):
    docs = spark.createDataFrame([(1, 1, True, "ab")], "key long, doc_id long, held_out boolean, text string")
    r = ppm.score(spark, docs, docs.where("not held_out")).first()
    assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (2, 0, 0) and r["score"] == pytest.approx(-4 * np.log10(252))


# 3

def brute_components(rows, k, num, den):
    sets = []
    for _, t in rows:
        w = common.words_of(t)
        n = min(k, len(w))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if n else frozenset())
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] == rows[j][0] or sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("k, num, den, block", [(3, 90, 100, 40), (5, 80, 100, 1024), (2, 50, 100, 30)])
def test_jaccard_components(spark, monkeypatch, k, num, den, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = random.Random(k)
    words = [f"w{i}" for i in range(200)]
    base = [rng.choice(words) for _ in range(80)]
    rows = []
    for i in range(240):
        w = list(base) if i % 2 else [rng.choice(words) for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "a b", "A\tb", "a", rows[3][1], rows[3][1].upper()])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(1)).repartition(5)
    got = sorted(tuple(r) for r in jaccard.near_duplicates(spark, docs, k, num, den).collect())
    assert got == brute_components(rows, k, num, den)


def test_jaccard_odd_cases(spark):
    docs = odd(spark)
    r = jaccard.near_duplicates(spark, docs).collect()
    assert len(r) == len(ODD)
    comp = {x["doc_id"]: x["component_id"] for x in r}
    assert comp[6] == 5 and comp[2] == 2 and comp[None] is None
    kept = sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in jaccard.one_of_each(spark, docs).collect())
    assert kept == [(False, i) for i in (1, 2, 3, 4, 5, 7, 8)] + [(True, 0)]
    assert jaccard.near_duplicates(spark, docs.limit(0)).count() == 0


# 6

def test_ann_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    v = rng.normal(size=(3000, 16))
    v /= np.linalg.norm(v, axis=1)[:, None]
    v[500:1500] = v[500]
    rows = [(i, [float(x) for x in v[i].astype(np.float32)], 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(6)
    found = ann.search(spark, df).collect()
    x = v.astype(np.float32).astype(float)
    hits = 0
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append(r)
    assert set(got) == set(range(0, 3000, 20))
    for q, rs in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(3000), -s))[:20]
        hits += len({r["vec_id"] for r in rs} & set(want.tolist()))
        assert [r["rank"] for r in rs] == list(range(1, 21)) and all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in rs)
        order = [(-r["score"], r["vec_id"]) for r in rs]
        assert order == sorted(order)
        if 500 <= q < 1500:
            assert [r["vec_id"] for r in rs] == want.tolist()
    assert hits / (20 * 150) >= 0.9


def test_ann_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [1.0]), (20, [1.0, 0.0]), (None, [1.0, 1.0]), (40, [float("inf"), 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in ann.search(spark, df).collect())
    assert got == [(0, 1, 20, 1.0), (0, 2, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 1, 0.5)]
    assert ann.search(spark, df.limit(0)).count() == 0


# the pipeline

def test_pipeline(spark, small, tmp_path):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    for name, stage in c.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns, name
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert not any(brute_spans(r["text"]) for r in docs.select("text").collect())
    found = c.run(spark, small).collect()
    assert {r["doc_id"] for r in found} == ids
    lead = brute_components([(r["doc_id"], r["text"]) for r in spark.read.parquet(str(tmp_path / "quality")).collect()], 5, 80, 100)
    assert {d for d, _, comp in lead if d == comp} == ids


@pytest.mark.parametrize("stage", range(5))
def test_pipeline_odd_cases(spark, small, stage):
    import corpus_pipeline as c

    docs = odd(spark).select("doc_id", "text", "lang", "source", "n_chars")
    out = c.STAGES[stage][1](spark, docs, small)
    assert out.count() > 0
    assert c.STAGES[stage][1](spark, docs.limit(0), small).count() == 0
    if stage < 4:
        assert out.columns == docs.columns


@pytest.mark.parametrize("name", ["op3_jaccard", "op7_warc"])
def test_sql(spark, small, name):
    from parity import difference

    from kgloom.llm import registry

    assert difference(spark, small, registry.queries()[name], registry.oracle_sql()[name]) is None


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    json.dumps(sorted(names))
