"""Operator 10: byte-level BPE encoding and decoding over a contiguous rank array.

A text is cut at the added tokens, then into words by the byte-level pattern. A word is a row of byte parts with
the rank of each adjacent pair in one contiguous array. The array is scanned for its least rank, that boundary
is deleted, and the ranks of the two neighbours are refreshed, until no pair has a rank. Words longer than
SHORT parts use a heap of the same ranks, as a scan for each merge would take quadratic time; the merges are
the same, since both take the least rank and, among equals, the leftmost.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from itertools import chain, pairwise

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import BoundedCache, map_rows
from kgloom.session import table

SHORT = 96
NONE = 1 << 60
ID = (1 << 20) - 1
#: How byte-level vocabularies cut text into words, and Unicode's white space.
SPACE = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: The same for texts of ASCII only, where the classes are short.
ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"


def byte_chars() -> dict[str, int]:
    """The vocabulary's character for each byte: printable Latin-1 stands for itself, others follow from 256."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBPE:
    """Encoder and decoder of a tokenizers JSON file (byte-level BPE, no normaliser, no prefix space)."""

    def __init__(self, path: str, cache: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        chars = byte_chars()
        vocab = spec["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = [b""] * (max([*vocab.values(), *self.added.values()]) + 1)
        for token, i in vocab.items():
            self.bytes_of[i] = token.encode() if token in self.added else bytes(chars[c] for c in token)
        for token, i in self.added.items():
            self.bytes_of[i] = token.encode()
        self.of_byte = [0] * 256
        for c, b in chars.items():
            self.of_byte[b] = vocab[c]
        #: By a pair of ids in one integer, its rank and the id it becomes in one integer; ranks start at 1.
        self.merges: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a] << 20 | vocab[b]] = (rank + 1) << 20 | vocab[a + b]
        import re

        self.words, self.ascii = regex.compile(PATTERN).findall, re.compile(ASCII).findall
        self.cut = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None
        self.ids_of = BoundedCache(self.merge, cache)

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word."""
        parts = [self.of_byte[b] for b in word.encode("utf-8", "surrogatepass")]
        if len(parts) > SHORT:
            return self.merge_long(parts)
        get = self.merges.get
        ranks = [get(a << 20 | b, NONE) for a, b in pairwise(parts)]
        while ranks and (least := min(ranks)) != NONE:
            i = ranks.index(least)
            parts[i] = new = least & ID
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = get(new << 20 | parts[i + 1], NONE)
            if i:
                ranks[i - 1] = get(parts[i - 1] << 20 | new, NONE)
        return tuple(parts)

    def merge_long(self, parts: list[int]) -> tuple[int, ...]:
        n, get = len(parts), self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(m, i, parts[i], parts[i + 1]) for i in range(n - 1) if (m := get(parts[i] << 20 | parts[i + 1]))]
        heapq.heapify(heap)
        while heap:
            m, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] == a else n
            if j >= n or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = m & ID, -1, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x in (before[i], i):
                if x >= 0 and (y := after[x]) < n and (m := get(parts[x] << 20 | parts[y])):
                    heapq.heappush(heap, (m, x, parts[x], parts[y]))
        return tuple(p for p in parts if p >= 0)

    def split(self, text: str) -> list[str]:
        return self.ascii(text) if text.isascii() else self.words(text)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; added tokens in the text are their own ids."""
        if self.cut is None or not any(t in text for t in self.added):
            return list(chain.from_iterable(map(self.ids_of.__getitem__, self.split(text))))
        out: list[int] = []
        for piece in self.cut.split(text):
            if piece in self.added:
                out.append(self.added[piece])
            elif piece:
                out += chain.from_iterable(map(self.ids_of.__getitem__, self.split(piece)))
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of ids, added tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_held: dict[str, ByteBPE] = {}


def tokenizer(path: str) -> ByteBPE:
    """One per Python worker and file."""
    if path not in _held:
        _held.clear()
        _held[path] = ByteBPE(path)
    return _held[path]


def encode_column(df: DataFrame, text: str, path: str, out: str = "ids") -> DataFrame:
    """Adds array<int> out with the ids of column text (null text: no ids). Other columns pass through."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("array<int>")
    def ids(s):
        import pandas as pd

        bpe = tokenizer(path)
        return pd.Series([bpe.encode(t or "") for t in s])

    return df.withColumn(out, ids(F.col(text)))


def decode_column(df: DataFrame, ids: str, path: str, out: str = "decoded") -> DataFrame:
    """Adds string out, the text of column ids (null: empty)."""
    from pyspark.sql.pandas.functions import pandas_udf

    @pandas_udf("string")
    def text(s):
        import pandas as pd

        bpe = tokenizer(path)
        return pd.Series([bpe.decode(list(x) if x is not None else []) for x in s])

    return df.withColumn(out, text(F.col(ids)))


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: one map over the scan, no shuffle.

    A null text counts as empty (0 tokens); a null doc_id stays null; repeated rows give repeated results.
    """

    def make():
        bpe = tokenizer(path)
        decimal = [str(i) for i in range(len(bpe.bytes_of))]

        def work(x: dict) -> dict:
            out: dict[str, list] = {"doc_id": x["doc_id"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for t in x["text"]:
                ids = bpe.encode(t or "")
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            return out

        return work

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row of documents; odd cases are those of round_trip_digests()."""
    import public_tokenizers

    return round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
