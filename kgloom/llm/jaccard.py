"""Operator 3: n-gram Jaccard join by grouped prefixes.

1. A sketch of shingle frequencies (a count per hash bucket over all documents) fixes one global order, rare first.
   Any order gives the same links; this one keeps common shingles out of the prefixes.
2. Documents with equal sets are one class, and its smallest doc_id stands for it. Classes with identical prefix and
   size are one group, and its smallest class leads it.
3. A group posts each shingle of its prefix once. In a block of postings of one shingle, pairs of groups are filtered
   by length, by position and, where both are single classes, by signatures (bucket counts of the set, which bound an
   intersection from above). Classes of one group meet in blocks of their own.
4. What is left is verified on whole sets, in two rounds. The first takes all pairs of a block where they are few, and
   else a spanning forest of them, best first; a hot shingle's postings are dealt twice into blocks of bounded size, so
   that blocks overlap. This gives components. The second round takes every pair that the first left out and whose ends are
   still in different components, and expands groups to their members there. So no link is lost, while copies of one
   another are never expanded into all pairs.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import BoundedCache, chunked_counts, give_back, map_rows, short_batches, summed_counts, unused, words_of
from kgloom.operators.components import connected_components
from kgloom.session import discard, small, staged, table

SKETCH = 1 << 20
SIGNATURE = 128
#: Postings of one shingle in a block, about; twice that where two parts of a hot one meet in the second round.
BLOCK = 512
#: Pairs a posting up to which a block hands on all its pairs in the first round. What it leaves out is the second round's.
EASY = 4
#: Bits of the filter that keeps documents without candidates from being shuffled; its size is fixed.
FILTER = 1 << 22


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def shingle_set(words: list[bytes], k: int, hashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle; none for no words."""
    n = min(k, len(words))
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    h = np.full(len(w) - n + 1, 0x9E3779B97F4A7C15 * n % (1 << 64), np.uint64)
    for i in range(n):
        h = (h ^ w[i : len(w) - n + 1 + i]) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return np.unique(h)


def prefix_length(n: int, num: int, den: int) -> int:
    """Shingles of a set of n of which a set that reaches num/den must share one."""
    return n - -(-num * n // den) + 1


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(44)).astype(np.int64)


def _sketch(docs: DataFrame, k: int) -> np.ndarray:
    """Documents by shingle bucket over all documents: partial counts by task, added up chunk by chunk."""

    def count(batches):
        import pyarrow as pa

        total, hashes = np.zeros(SKETCH, np.int32), BoundedCache(word_hash)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                sets = [_buckets(shingle_set(words_of(t.as_py()), k, hashes)) for t in batch.column("text")[at : at + 512]]
                np.add.at(total, np.concatenate(sets), 1)
        used, chunks = chunked_counts(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(chunks, pa.binary())], names=["chunk", "counts"])
        del hashes, total, chunks
        give_back()

    parts = short_batches(docs.select("text")).mapInArrow(count, "chunk int, counts binary")
    return np.minimum(summed_counts(parts, SKETCH), np.iinfo(np.uint32).max).astype(np.uint32)


def _features(docs: DataFrame, k: int, num: int, den: int, sketch) -> DataFrame:
    """doc_id, n, set_id (128-bit hash of the set; null if empty), grp (of size and prefix), prefix, sig."""

    def make():
        order, hashes = sketch.value, BoundedCache(word_hash)

        def work(x: dict) -> dict:
            out: dict[str, list] = {"doc_id": x["doc_id"], "n": [], "set_id": [], "grp": [], "prefix": [], "sig": []}
            for t in x["text"]:
                s = shingle_set(words_of(t), k, hashes)
                n = len(s)
                out["n"].append(n)
                out["set_id"].append(xxhash.xxh3_128_hexdigest(s.tobytes()) if n else None)
                p = s[np.lexsort((s, order[_buckets(s)]))[: prefix_length(n, num, den)]].astype(np.int64) if n else np.zeros(0, np.int64)
                out["grp"].append(xxhash.xxh3_64_intdigest(p.tobytes(), n) - (1 << 63))
                out["prefix"].append(p)
                sig = np.bincount((s & np.uint64(SIGNATURE - 1)).astype(np.int64), minlength=SIGNATURE)
                out["sig"].append(sig.astype(np.uint8).tobytes() if n and sig.max() < 1 << 8 else b"")
            return out

        return work

    return map_rows(docs.select("doc_id", "text"), make, "doc_id long, n long, set_id string, grp long, prefix array<long>, sig binary")


def possible(n1, n2, most, num: int, den: int):
    """Whether sets of these sizes with at most this intersection can reach num/den."""
    return den * most >= num * (n1 + n2 - most)


def forest(rows: int, i: np.ndarray, j: np.ndarray, like: np.ndarray) -> np.ndarray:
    """Numbers of the links (i, j) of a spanning forest of `rows` nodes; each tree takes its likeliest link out, again and again."""
    root, kept = np.arange(rows), []
    live = np.argsort(-like, kind="stable")
    while len(live := live[root[i[live]] != root[j[live]]]):
        ends = np.concatenate([root[i[live]], root[j[live]]])
        best = np.full(rows, len(live))
        np.minimum.at(best, ends, np.tile(np.arange(len(live)), 2))
        for x in np.unique(best[best < len(live)]).tolist():
            a, b = i[live[x]], j[live[x]]
            while root[a] != a:
                a = root[a]
            while root[b] != b:
                b = root[b]
            if a != b:
                root[max(a, b)] = min(a, b)
                kept.append(int(live[x]))
        while (root[root] != root).any():
            root = root[root]
    return np.array(kept, np.int64)


def block_pairs(t: dict[str, np.ndarray], num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, likeness, run) of the possible links within runs of postings, by row numbers.

    t: run, n, pos, node, label, mixed, side, diagonal, whole, sig, sorted by run and n. Rows of one label are not
    linked unless one of them is mixed, nor are two rows of one side off the diagonal, as they meet on it.
    """
    rows = len(t["n"])
    run, n, pos = t["run"], t["n"], t["pos"]
    end = np.searchsorted(run, run, side="right")
    at, found = np.arange(rows), []
    for d in range(1, rows):
        at = at[at + d < end[at]]
        # sizes rise within a run: a row whose partner is too long has none farther on
        at = at[den * n[at] >= num * n[at + d]]
        if not len(at):
            break
        i, j = at, at + d
        ok = possible(n[i], n[j], np.minimum(n[i] - pos[i], n[j] - pos[j]), num, den) & (t["node"][i] != t["node"][j])
        ok &= (t["label"][i] != t["label"][j]) | t["mixed"][i] | t["mixed"][j]
        ok &= t["diagonal"][i] | (t["side"][i] != t["side"][j])
        i, j = i[ok], j[ok]
        for x in range(0, len(i), 20_000):
            p, q = i[x : x + 20_000], j[x : x + 20_000]
            most = np.minimum(t["sig"][p], t["sig"][q]).sum(axis=1, dtype=np.int64)
            most = np.where(t["whole"][p] & t["whole"][q], most, np.minimum(n[p], n[q]))
            good = possible(n[p], n[q], most, num, den)
            if good.any():
                p, q, most = p[good], q[good], most[good]
                found.append((p.astype(np.int32), q.astype(np.int32), (most / (n[p] + n[q] - most)).astype(np.float32)))
    i, j, like = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
    return i, j, like, run[i]


#: Rows of _pairs(): a pair of classes or of groups by their leads (open: of which one has several members), or a token left open.
PAIR = "a long, b long, open boolean, again long"


def _pairs(dealt: DataFrame, num: int, den: int, first: bool) -> DataFrame:
    """PAIR rows of dealt postings: token, cell, side, diagonal, node, n, pos, multi, label, mixed, sig."""
    columns = ["token", "cell", "side", "diagonal", "node", "n", "pos", "multi", "label", "mixed", "sig"]

    def run(batches):
        import pyarrow as pa

        schema, rest = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("open", pa.bool_()), ("again", pa.int64())]), None

        def out(tab: pa.Table):
            rows = tab.num_rows
            if not rows:
                return
            t = {c: tab.column(c).to_numpy(zero_copy_only=False) for c in columns[:-1]}
            raw = tab.column("sig").to_pylist()
            t["whole"] = np.array([len(x) > 0 for x in raw])
            t["sig"] = np.frombuffer(b"".join(x or bytes(SIGNATURE) for x in raw), np.uint8).reshape(-1, SIGNATURE)
            t["run"] = np.cumsum(np.append(False, (t["token"][1:] != t["token"][:-1]) | (t["cell"][1:] != t["cell"][:-1])))
            i, j, like, of = block_pairs(t, num, den)
            again = np.zeros(0, np.int64)
            if first and len(i):
                size, links = np.bincount(t["run"]), np.bincount(of, minlength=t["run"][-1] + 1)
                hard = links > EASY * size
                again = np.unique(t["token"][hard[t["run"]]])
                x = np.flatnonzero(hard[of])
                keep = np.append(np.flatnonzero(~hard[of]), x[forest(rows, i[x], j[x], like[x])] if len(x) else x)
                i, j = i[keep], j[keep]
            a, b, both = t["node"][i], t["node"][j], t["multi"][i] | t["multi"][j]
            none = lambda k: pa.nulls(k, pa.int64())
            for x in range(0, len(a), 50_000):
                p, q = a[x : x + 50_000], b[x : x + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)), pa.array(np.maximum(p, q)), pa.array(both[x : x + 50_000]), none(len(p))], schema=schema)
            if len(again):
                yield pa.RecordBatch.from_arrays([none(len(again)), none(len(again)), pa.nulls(len(again), pa.bool_()), pa.array(again)], schema=schema)

        for batch in batches:
            now = pa.Table.from_batches([batch])
            rest = now if rest is None else pa.concat_tables([rest, now])
            if rest.num_rows < 2 * BLOCK:
                continue
            token, cell = rest.column("token").to_numpy(), rest.column("cell").to_numpy()
            cut = np.flatnonzero((token != token[-1]) | (cell != cell[-1]))
            cut = int(cut[-1]) + 1 if len(cut) else 0
            if cut:
                yield from out(rest.slice(0, cut))
                rest = rest.slice(cut)
        if rest is not None:
            yield from out(rest)
        del rest
        give_back()

    return dealt.select(*columns).repartition("token", "cell").sortWithinPartitions("token", "cell", "n", "node").mapInArrow(run, PAIR).distinct()


def _overlapping(postings: DataFrame) -> DataFrame:
    """Postings (token, m, node, ..) dealt for the first round: a hot token's into blocks, each posting into two of them."""
    parts = F.ceil(F.col("m") / BLOCK).cast("int")
    side = lambda *salt: F.pmod(F.xxhash64("node", "token", *salt), parts).cast("long")
    return postings.withColumns({"cell": F.explode(F.array_distinct(F.array(side(), side(F.lit(1))))), "side": F.lit(0), "diagonal": F.lit(True)})


def _grid(postings: DataFrame) -> DataFrame:
    """Postings dealt for the second round: any two of a token meet in one cell of a grid of its parts."""
    dealt = postings.withColumn("parts", F.ceil(F.col("m") / BLOCK).cast("int"))
    dealt = dealt.withColumn("side", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return dealt.withColumn("cell", F.least("side", "other").cast("long") * F.col("parts") + F.greatest("side", "other")).withColumn("diagonal", F.col("side") == F.col("other"))


def _allowed(pairs: DataFrame, reps: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of classes whose sizes and signatures allow a link."""

    def allow(batches):
        import pyarrow as pa

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                n1, n2 = part.column("n1").to_numpy(), part.column("n2").to_numpy()
                raw = [part.column(c).to_pylist() for c in ("s1", "s2")]
                whole = np.array([len(x) > 0 and len(y) > 0 for x, y in zip(*raw)], bool)
                x, y = (np.frombuffer(b"".join(v or bytes(SIGNATURE) for v in r), np.uint8).reshape(-1, SIGNATURE) for r in raw)
                most = np.where(whole, np.minimum(x, y).sum(axis=1, dtype=np.int64), np.minimum(n1, n2))
                keep.append(possible(n1, n2, most, num, den))
            mask = pa.array(np.concatenate(keep) if keep else np.zeros(0, bool))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], schema=schema)

    side = lambda x, i: reps.select(F.col("node").alias(x), F.col("n").alias(f"n{i}"), F.col("sig").alias(f"s{i}"))
    return pairs.join(side("a", 1), "a").join(side("b", 2), "b").mapInArrow(allow, "a long, b long")


def _verified(spark: SparkSession, docs: DataFrame, pairs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach num/den. Sets are made again for documents that have a pair, and only those."""
    sent = _filter(spark, pairs.select(F.explode(F.array("a", "b")).alias("id")), "id")

    def make():
        packed, hashes = sent.value, BoundedCache(word_hash)

        def work(x: dict) -> dict:
            kept = [i for i, b in enumerate(x["bit"]) if x["doc_id"][i] is not None and int(packed[b >> 5]) >> (b & 31) & 1]
            return {"id": [x["doc_id"][i] for i in kept], "s": [shingle_set(words_of(x["text"][i]), k, hashes).astype(np.int64) for i in kept]}

        return work

    rows = docs.select("doc_id", "text", _bit("doc_id").alias("bit"))
    sets = staged(spark, map_rows(rows, make, "id long, s array<long>"), "jaccard-sets")
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("s1")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("s2")), "b")
    both = both.select("a", "b", (F.size("s1") + F.size("s2")).alias("n"), F.size(F.array_intersect("s1", "s2")).alias("common"))
    links = staged(spark, both.where(F.lit(den) * F.col("common") >= F.lit(num) * (F.col("n") - F.col("common"))).select("a", "b").distinct(), "jaccard-links")
    discard(sets)
    return links


def near_duplicates(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row: component_id is the smallest doc_id reachable by links.

    Two documents link when den * |A and B| >= num * |A or B| for their sets of k-word shingles. Empty and null texts
    have no shingle and link with nothing. A null doc_id has a null component. Rows that repeat a doc_id, whatever
    their texts, are one document. An empty table gives no rows. Other columns of docs are not read, so none can clash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = spark.sparkContext.broadcast(_sketch(docs, k))
    first = staged(spark, _features(docs, k, num, den, sketch), "jaccard-first")
    # equal sets have equal features; a hot set is one row a task before the shuffle
    classes = first.where("n > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"), F.first(F.struct("n", "grp", "prefix", "sig")).alias("f"))
    reps = staged(spark, classes.select("set_id", "node", "f.*"), "jaccard-reps")
    multi = staged(spark, reps.groupBy("grp", "n").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("members")).where("members > 1"), "jaccard-groups")
    led = small(multi)
    members = reps.join(led, ["grp", "n"]).select("node", "lead", "members")

    # a group posts once a shingle; only single classes have signatures that bound all of a group
    groups = reps.join(led, ["grp", "n"], "left").where("lead is null or node = lead").select("node", "n", F.col("lead").isNotNull().alias("multi"), "prefix")
    posted = groups.select("node", "n", "multi", F.posexplode("prefix").alias("pos", "token"))
    shared = staged(spark, posted.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "jaccard-shared")
    postings = posted.join(shared, "token").select("token", "m", "node", "n", "pos", "multi")
    inside = reps.join(led, ["grp", "n"]).select(F.col("grp").alias("token"), F.col("members").alias("m"), "node", "n", F.lit(0).alias("pos"), F.lit(False).alias("multi"))
    postings = staged(spark, postings.unionByName(inside).join(reps.select("node", "sig"), "node").withColumn("sig", F.when(F.col("multi"), F.lit(b"")).otherwise(F.col("sig"))), "jaccard-postings")

    found = staged(spark, _pairs(_overlapping(postings.withColumns({"label": F.col("node"), "mixed": F.lit(False)})), num, den, True), "jaccard-found")
    tried = staged(spark, found.where("again is null").select("a", "b").distinct(), "jaccard-tried")
    links = _verified(spark, docs, tried, k, num, den)
    labels = staged(spark, connected_components(spark, links), "jaccard-labels")

    # the second round: what a block left out, and the members of groups
    label = labels.select("node", F.col("component").alias("label"))
    again = found.where("again is not null").select(F.col("again").alias("token")).unionByName(shared.where(F.col("m") > BLOCK).select("token")).unionByName(multi.where(F.col("members") > BLOCK).select(F.col("grp").alias("token"))).distinct()
    left = postings.join(small(again), "token", "left_semi").join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    spread = members.join(label, "node", "left").groupBy("lead").agg(F.min(F.coalesce("label", "node")).alias("lo"), F.max(F.coalesce("label", "node")).alias("hi")).where("lo != hi").select(F.col("lead").alias("node"), F.lit(True).alias("apart"))
    left = staged(spark, left.join(spread, "node", "left").withColumn("mixed", F.col("multi") & F.col("apart").isNotNull()).drop("apart"), "jaccard-left")
    several = left.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("mixed").alias("some")).where("lo != hi or some").select("token")
    more = _pairs(_grid(left.join(several, "token", "left_semi")), num, den, False)
    pairs = staged(spark, more.unionByName(found.where("again is null")).where("open or again is null").select("a", "b", "open").distinct(), "jaccard-pairs")
    who = lambda x: members.select(F.col("lead").alias(x), F.col("node").alias(f"{x}_"))
    each = pairs.where("open").select("a", "b").distinct().join(who("a"), "a", "left").join(who("b"), "b", "left").select(F.coalesce("a_", "a").alias("x"), F.coalesce("b_", "b").alias("y"))
    each = each.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    of = lambda x: label.select(F.col("node").alias(x), F.col("label").alias(f"{x}_"))
    each = each.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_", "a") != F.coalesce("b_", "b")).select("a", "b")
    others = _allowed(each, reps, num, den).unionByName(pairs.where("not open").select("a", "b")).distinct().join(tried, ["a", "b"], "left_anti")
    others = staged(spark, others, "jaccard-others")
    if not others.isEmpty():
        more = _verified(spark, docs, others, k, num, den)
        discard(labels)
        labels = staged(spark, connected_components(spark, links.unionByName(more)), "jaccard-labels")
        discard(more)
    component = reps.select("set_id", "node").join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    component = staged(spark, component, "jaccard-components")
    discard(reps, multi, shared, postings, found, tried, links, labels, left, pairs, others)
    full = first.where("n > 0 and doc_id is not null").select("doc_id", "n", "set_id").join(component, "set_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(first.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def _filter(spark: SparkSession, ids: DataFrame, column: str):
    """A broadcast of FILTER bits that are set for the ids' hashes: of fixed size, and never unset for an id.

    Executors unite the bits in words of 32; the driver gets at most FILTER / 32 words, as Arrow columns.
    """
    bit = _bit(column)
    words = ids.select(F.floor(bit / 32).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit % 32).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER // 32, np.uint32)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(out)


def _bit(column: str):
    return F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(FILTER)).cast("int")


def one_of_each(spark: SparkSession, docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without the documents whose component has a smaller doc_id; of rows that repeat a doc_id one stays.

    Rows with a null doc_id link with nothing and all stay; so do null and empty texts. An empty table gives no rows. Only
    rows that a filter of fixed size takes for dropped or repeated ones are shuffled to be looked up; all others stay where
    they are. Columns of any name stay as they are.
    """
    from pyspark.sql.pandas.functions import pandas_udf

    found = near_duplicates(spark, docs, k, num, den).where("doc_id is not null").groupBy("doc_id", "component_id").agg(F.count(F.lit(1)).alias("copies"))
    id_, drop, may = (unused(c, docs.columns) for c in ("id", "drop", "maybe"))
    found = found.where("doc_id != component_id or copies > 1").select(F.col("doc_id").alias(id_), (F.col("doc_id") != F.col("component_id")).alias(drop))
    found = staged(spark, found, "jaccard-dropped")
    sent = _filter(spark, found, id_)

    @pandas_udf("boolean")
    def maybe(bit):
        b = bit.to_numpy()
        return bit.__class__((sent.value[b >> 5] >> (b & 31).astype(np.uint32) & 1).astype(bool))

    marked = docs.withColumn(may, F.when(F.col("doc_id").isNull(), False).otherwise(maybe(F.coalesce(_bit("doc_id"), F.lit(0)))))
    asked = marked.where(F.col(may)).drop(may).join(found, F.col("doc_id").cast("long") == F.col(id_), "left")
    free = asked.where(F.col(drop).isNull()).select(*docs.columns)
    again = asked.where(~F.col(drop)).select(*docs.columns).dropDuplicates(["doc_id"])
    return marked.where(~F.col(may)).select(*docs.columns).unionByName(free).unionByName(again)


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of documents, at three words and 0.9; odd cases are those of near_duplicates()."""
    return near_duplicates(spark, table(spark, sf_dir, "documents"), 3, 90, 100)


SQL = r"""
with recursive w as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (select a.doc_id as x, b.doc_id as y, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select x, y from c join n p on p.doc_id = x join n q on q.doc_id = y where 100 * k >= 90 * (p.n + q.n - k)),
l as (select x as a, y as b from e union select y, x from e),
reach(node, other) as (select a, a from l union select r.node, l.b from reach r join l on r.other = l.a),
cc as (select node, min(other) as low from reach group by node)
select d.doc_id, coalesce(n, 0) as n_shingles, coalesce(low, d.doc_id) as component_id from documents d left join n using (doc_id) left join cc on cc.node = d.doc_id
"""
