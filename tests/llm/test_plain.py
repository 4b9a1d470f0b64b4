"""Queries of the models against plain versions of the same methods, and measures of packing and search."""

import math
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
import zlib

from kgloom.llm import ann, langid, media, packing, quality

JSON = public_tokenizers.path("byte_bpe_50k.json")


def documents(folder, **kw):
    return pq.read_table(f"{folder}/documents.parquet", **kw).to_pylist()


def tables(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


# 9

def plain_grams(text):
    letters = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    if not letters.strip(" "):
        return Counter()
    words, out = [w for w in letters.split(" ") if w], Counter()
    # runs of other characters are one space; a text that starts with one has two
    s = " " + (" " if letters[0] == " " else "") + " ".join(words) + (" " if letters[-1] == " " else "") + " "
    for n in (1, 2, 3):
        for i in range(len(s) - n + 1):
            h = ord(s[i]) * 0x9E3779B1 & 0xFFFFFFFF
            for c in s[i + 1 : i + n]:
                h = ((h ^ h >> 15) * 0x85EBCA6B + ord(c) * 0xC2B2AE35) & 0xFFFFFFFF
            out[((h ^ h >> 13) * 0x27D4EB2F & 0xFFFFFFFF) >> 17] += 1
    return out


def plain_langid(rows):
    """rows: (doc_id, text, lang). The model as dicts: {(bucket, lang): weight}, idf and temperature."""
    grams = [(i, lang, plain_grams(t)) for i, t, lang in rows]
    df = Counter(g for _, _, c in grams for g in c)
    n = sum(1 for _, _, c in grams if c)
    idf = lambda g: math.log((1 + n) / (1 + df[g])) + 1

    def vector(c):
        x = {g: (1 + math.log(k)) * idf(g) for g, k in c.items()}
        size = math.sqrt(sum(v * v for v in x.values()))
        return {g: v / size for g, v in x.items()}

    data = [(vector(c), lang) for _, lang, c in sorted((g for g in grams if g[2]), key=lambda r: r[0])]
    langs = sorted({lang for _, lang in data})
    order = np.random.default_rng(9).permutation(len(data))
    kept = [i for k, i in enumerate(order) if k < len(order) // 5 and data[i][1] in {data[j][1] for j in order[k + 1 :]}]
    learned = [i for i in order if i not in kept]
    z, s = defaultdict(float), defaultdict(float)
    w = lambda k: 0.0 if abs(z[k]) <= 0.02 else -(z[k] - math.copysign(0.02, z[k])) / ((1.0 + math.sqrt(s[k])) / 0.5 + 0.2)

    def soft(x, t=1.0, weight=w):
        e = [math.exp(sum(v * weight((g, lang)) for g, v in x.items()) / t) for lang in langs]
        return {lang: a / sum(e) for lang, a in zip(langs, e)}

    for _ in range(3):
        for i in learned:
            x, lang = data[i]
            p = soft(x)
            for other in langs:
                d = p[other] - (other == lang)
                for g, v in x.items():
                    k, grad = (g, other), v * d
                    old = w(k)
                    z[k] += grad - (math.sqrt(s[k] + grad * grad) - math.sqrt(s[k])) / 0.5 * old
                    s[k] += grad * grad
    final = {k: w(k) for k in list(z)}
    at = lambda k: final.get(k, 0.0)
    t = min(np.geomspace(0.1, 10, 41), key=lambda t: -sum(math.log(max(soft(data[i][0], t, at)[data[i][1]], 1e-12)) for i in kept))
    return lambda text: soft(vector(c), t, at) if (c := plain_grams(text)) else None


def test_language_query_is_the_plain_method(spark, small, tmp_path):
    docs = [(r["doc_id"], r["text"][:150], r["lang"], None) for r in documents(small)[:70]] + [(900, None, "en", 1), (901, " 12 ", "de", 2), (902, "x", None, 3), (903, "", "fr", 0)]
    folder = tables(spark, tmp_path, docs, [])
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    predict = plain_langid([(i, t, lang) for i, t, lang, _ in docs if not held(i) and t is not None and lang is not None])
    got = {r["doc_id"]: r for r in langid.op9_langid(spark, folder).collect()}
    assert set(got) == {i for i, *_ in docs}
    for i, t, _, _ in docs:
        assert got[i]["held_out"] == held(i)
        p = predict(t)
        if p is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
        else:
            assert got[i]["lang_pred"] == max(sorted(p), key=p.get) and got[i]["score"] == pytest.approx(max(p.values()), abs=1e-4)


# 1

def plain_features(text, n_chars):
    text = text or ""
    raw, words, lines = text.encode(), text.split(), text.split("\n")
    count = Counter(w.lower() for w in words)
    n, k = max(len(raw), 1), max(len(words), 1)
    of = lambda ok: sum(1 for b in raw if ok(b))
    upper, lower = of(lambda b: 65 <= b <= 90), of(lambda b: 97 <= b <= 122)
    punct = ".,;:'\"()-?"
    blank = of(lambda b: b == 32 or 9 <= b <= 13)
    values = [1.0, math.log1p(len(text) if n_chars is None else max(n_chars, 0)) / 10, upper / n, of(lambda b: 48 <= b <= 57) / n, of(lambda b: 33 <= b < 127 and not chr(b).isalnum() and chr(b) not in punct) / n, of(lambda b: chr(b) in punct) / n, of(lambda b: b in (9, 32)) / n, of(lambda b: b == 10) / k, of(lambda b: b > 127) / n, (n - blank) / k / 10, len(count) / k, math.log1p(n / len(lines)) / 8, 1 - len(set(lines)) / len(lines), of(lambda b: b == 124) / k, upper / max(lower + upper, 1), of(lambda b: chr(b) in "!*$%&#") / k, 1 / (1 + k / 8), max(count.values(), default=0) / k]
    x = defaultdict(float)
    for w, c in count.items():
        x[xxhash.xxh32_intdigest(w.encode()) % quality.WORDS] += 1 + math.log(c)
    size = math.sqrt(sum(v * v for v in x.values()))
    return {g: v / size for g, v in x.items()} | {quality.WORDS + i: v for i, v in enumerate(values)}


def plain_machine(rows, counts):
    """rows: (features, label) in the order of ids. A second-order machine whose pairs are summed one by one."""
    v0 = np.random.default_rng(1).normal(0, 0.05, (quality.SIZE, quality.RANK))
    w, gw, v, gv = defaultdict(float), defaultdict(lambda: 1e-6), {}, defaultdict(lambda: [1e-6] * quality.RANK)
    factor = lambda g: v.setdefault(g, v0[g].tolist())

    def raw(x):
        g = list(x)
        pairs = sum(x[a] * x[b] * sum(p * q for p, q in zip(factor(a), factor(b))) for i, a in enumerate(g) for b in g[i + 1 :])
        return sum(w[a] * x[a] for a in g) + pairs

    order = np.random.default_rng(1)
    order.normal(0, 0.05, 0)
    rng = np.random.default_rng(1)
    for e in range(6):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            d = 1 / (1 + math.exp(-max(-30, min(30, raw(x))))) - y
            total = [sum(factor(g)[f] * k for g, k in x.items()) for f in range(quality.RANK)]
            rate = 0.1 / (1 + e)
            step = {g: (d * k + 1e-4 * w[g], [d * k * (total[f] - factor(g)[f] * k) + 1e-4 * factor(g)[f] for f in range(quality.RANK)]) for g, k in x.items()}
            for g, (dw, dv) in step.items():
                gw[g] += dw * dw
                w[g] -= rate * dw / math.sqrt(gw[g])
                for f in range(quality.RANK):
                    gv[g][f] += dv[f] ** 2
                    v[g][f] -= rate * dv[f] / math.sqrt(gv[g][f])
    ones = sum(y for _, y in rows)
    prior = math.log(counts[1] / counts[0]) - math.log(ones / (len(rows) - ones))
    return lambda x: 1 / (1 + math.exp(-max(-30, min(30, raw(x) + prior))))


def test_quality_query_is_the_plain_method(spark, small, tmp_path):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{small}/labels.parquet").to_pylist()}
    docs = [(r["doc_id"], r["text"][:120], "en", None if r["doc_id"] % 3 else r["n_chars"]) for r in documents(small) if r["doc_id"] in labels][:36] + [(900, None, "en", None), (901, "", "en", -5), (902, "a|b\na|b\n!! É 1", "en", 7)]
    rows = [(i, q, 0) for i, q in labels.items() if i in {d[0] for d in docs}] + [(901, 0, 0), (902, 1, 0), (905, 1, 0), (None, 1, 0), (900, None, 0), (3, 7, 0)]
    folder = tables(spark, tmp_path, docs, rows)
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    known = {i: q for i, q, _ in rows if i is not None and q in (0, 1) and not held(i)}
    x = {i: plain_features(t, n) for i, t, _, n in docs}
    score = plain_machine([(x[i], known[i]) for i in sorted(x) if i in known], Counter(known.values()))
    got = {r["doc_id"]: r for r in quality.op1_quality(spark, folder).collect()}
    assert set(got) == set(x)
    for i in x:
        assert got[i]["score"] == pytest.approx(score(x[i]), abs=2e-4) and got[i]["predicted"] == (got[i]["score"] >= 0.7) and got[i]["held_out"] == held(i)


# 8

def test_media_features_are_area_means(spark, small):
    rows = {r["doc_id"]: r for r in media.op8_media(spark, small).collect()}
    docs = [r for r in documents(small) if len(r["text"].encode()) < 6000][:25]
    kinds = set()
    for r in docs:
        raw = r["text"].encode()
        raw += b" " * (-len(raw) % 192 if raw else 192)
        grey = np.frombuffer(raw, np.uint8).reshape(-1, 64, 3).mean(axis=2)
        # every pixel cut into as many strips as the grid has rows, or cells: exact means by whole strips
        h = len(grey)
        fine = np.round(np.kron(grey, np.ones((64, 1))).reshape(64, h, 64).mean(axis=1))
        cells = np.kron(fine, np.ones((1, 9))).reshape(8, 8, 9, 64).mean(axis=(1, 3))
        bits = np.round(cells, 6)
        got = rows[r["doc_id"]]
        assert got["feature"] == np.packbits(bits[:, 1:] > bits[:, :-1]).tobytes().hex() and got["tiles"] == 1
        assert got["media_kind"] == ("bmp" if zlib.crc32(raw) & 1 else "ppm")
        kinds.add(got["media_kind"])
    assert kinds == {"bmp", "ppm"}


# 4

def test_packing_leaves_placed_pieces_where_they_are(small):
    encode = packing.encoder(JSON)
    folder = small.replace("0.001", "0.1")
    ids = [encode(r["text"] or "") + bytes(4) for r in documents(folder, columns=["text"])]
    placed = moved = padding = total = 0
    for part in range(8):
        p, length, rows = packing.SumOfSquares(1024), Counter(), []
        for x in ids[part * len(ids) // 8 : (part + 1) * len(ids) // 8]:
            rows += p.add(part, x)
        for r in rows + p.finish():
            length[r[5]] += r[2]
        placed, moved, total = placed + p.placed, moved + p.moved, total + sum(length.values())
        short = [n for n in length.values() if n < 1024]
        assert len(short) <= 1
        padding += sum(1024 - n for n in short)
    assert total == sum(len(x) // 4 for x in ids) and padding < 0.001 * total
    assert 1 - moved / placed >= 0.8


# 6

@pytest.mark.parametrize("folder", ["0.001", "0.1"])
def test_search_of_embeddings(spark, small, folder):
    folder = small.replace("0.001", folder)
    rows = [(r["vec_id"], r["embedding"]) for r in pq.read_table(f"{folder}/embeddings.parquet").to_pylist() if r["embedding"]]
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float32).astype(float)
    got = defaultdict(set)
    for r in ann.op6_ann(spark, folder).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = queries = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -s))[:20]].tolist()))
        queries += 1
    index = ann.Index(x.astype(np.float32), len(x), 20)
    print(f"{len(x)} vectors: {index.probes} of {len(index.centroids)} lists probed, recall {hits / queries / 20:.3f}")
    assert len(index.centroids) > 1 and hits / queries / 20 >= 0.9


def test_lists_grow_as_the_root_and_two_levels_cover():
    assert [ann.lists_for(n) for n in (1, 500, 50_000, 1_000_000, 100_000_000)] == [1, 4, 64, 256, 2048]
    rng = np.random.default_rng(8)
    x = (rng.normal(size=(400, 8)).repeat(20, axis=0) + rng.normal(size=(8000, 8)) * 0.02).astype(np.float32)
    c = ann.coarse(x, 400)
    assert 300 <= len(c) <= 500 and np.sqrt(((x - c[ann.nearest(x, c)]) ** 2).sum(axis=1)).mean() < 0.6
