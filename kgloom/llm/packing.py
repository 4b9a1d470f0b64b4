"""Operator 4: sum-of-squares online packing of token ids into fixed windows.

Every input partition packs its own windows: no shuffle, no row moves, and a lost task repeats the same packing.
A document is cut into full windows and one rest. The rest goes to the fill level whose choice gives the least
sum of squared counts of partially filled windows; the counts are one array by level. When a partition ends, the
fullest windows are topped up with pieces cut off the emptiest ones, so that most placed pieces stay where they were
placed; at most one window a partition is not full.
"""

from __future__ import annotations

import zlib
from collections import defaultdict, deque

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import short_batches
from kgloom.session import table

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Windows of one partition at most; a sequence's id is the partition's number times this, plus its number there.
STRIDE = 1 << 32
#: White space of so many characters in a row goes to the merges without the encoder's pattern, whose engine fails on more.
RUN = 100_000


class SumOfSquares:
    """Packs pieces online; add() and finish() return pieces of windows that are closed.

    A piece is [doc_id, start, bytes of ids, doc_tokens]; the window's pieces lie in the order of arrival.
    """

    def __init__(self, size: int, first: int = 0):
        self.size, self.next = size, first
        self.levels = np.zeros(size + 1, np.int64)
        self.open: dict[int, deque] = defaultdict(deque)
        #: Ids of rests that were placed in all, and of those that were moved at the end.
        self.placed = self.moved = 0

    def row(self, window: int, pieces: list) -> list[tuple]:
        out, offset = [], 0
        for doc, start, ids, n in pieces:
            k = len(ids) // 4
            out.append((doc, start, k, zlib.crc32(ids), n, window, offset))
            offset += k
        return out

    def close(self, pieces: list) -> list[tuple]:
        self.next += 1
        return self.row(self.next - 1, pieces)

    def add(self, doc, ids: bytes) -> list[tuple]:
        """ids: little-endian 32-bit ids of one document, its end included."""
        n, wide, out = len(ids) // 4, 4 * self.size, []
        full = n // self.size
        for i in range(full):
            out += self.close([[doc, i * self.size, ids[i * wide : (i + 1) * wide], n]])
        if n % self.size:
            out += self.place([doc, full * self.size, ids[full * wide :], n])
        return out

    def place(self, piece: list) -> list[tuple]:
        k, size, count = len(piece[2]) // 4, self.size, self.levels
        self.placed += k
        # change of the sum of squares: one window less at level h, one more at level h + k; level 0 and full ones don't count
        after = 2 * count[k : size + 1] + 1
        after[size - k] = 0
        before = 2 * count[: size + 1 - k] - 1
        before[0] = 0
        change = after - before
        usable = count[: size + 1 - k] > 0
        usable[0] = True
        # among equals the fullest level
        h = int(np.where(usable, change, np.iinfo(np.int64).max)[::-1].argmin())
        h = size - k - h
        pieces = self.open[h].popleft() if h else []
        if h:
            count[h] -= 1
        pieces.append(piece)
        if h + k == size:
            return self.close(pieces)
        self.open[h + k].append(pieces)
        count[h + k] += 1
        return []

    def finish(self) -> list[tuple]:
        """Closes what is open: the fullest window is filled from the emptiest, again and again; the last may stay short."""
        out: list[tuple] = []
        held = deque(pieces for level in sorted(self.open, reverse=True) for pieces in self.open[level])
        self.open.clear()
        self.levels[:] = 0
        while held:
            pieces = held.popleft()
            level = sum(len(ids) // 4 for _, _, ids, _ in pieces)
            while level < self.size and held:
                taken = self.cut(held[-1], self.size - level)
                self.moved += len(taken[2]) // 4
                level += len(taken[2]) // 4
                pieces.append(taken)
                if not held[-1]:
                    held.pop()
            out += self.close(pieces)
        return out

    @staticmethod
    def cut(pieces: list, k: int) -> list:
        """Takes the last piece off a window, or its first k ids where it has more."""
        doc, start, ids, n = pieces.pop()
        if len(ids) > 4 * k:
            pieces.append([doc, start + k, ids[4 * k :], n])
        return [doc, start, ids[: 4 * k], n]


def encoder(path: str):
    """Text to little-endian 32-bit ids as bytes, by tiktoken's merges with the JSON file's own ranks and added tokens."""
    import json
    import re

    import public_tokenizers
    import tiktoken

    from kgloom.llm.bpe import SPACE, byte_chars

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    chars, added = byte_chars(), {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(chars[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in added}
    coder = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    cut = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    run = re.compile(f"[{SPACE}]{{{RUN},}}")

    def ordinary(text: str) -> list[int]:
        if len(text) < RUN:
            return coder.encode_ordinary(text)
        # by the pattern, a run before other text is a word but for its last character
        out, at = [], 0
        for m in run.finditer(text):
            end = m.end() - (m.end() < len(text))
            out += coder.encode_ordinary(text[at : m.start()]) + coder._encode_single_piece(text[m.start() : end])
            at = end
        return out + coder.encode_ordinary(text[at:])

    def encode(text: str) -> bytes:
        if cut is None or not cut.search(text):
            return np.array(ordinary(text), "<u4").tobytes()
        parts = [[added[p]] if p in added else ordinary(p) for p in cut.split(text) if p]
        return np.array([i for p in parts for i in p], "<u4").tobytes()

    return encode


_encoders: dict = {}


def pack(docs: DataFrame, path: str, size: int = 1024, end: int = 0) -> DataFrame:
    """One row per piece of every document (PIECE); null and empty texts are the end id alone.

    Long documents are cut at full windows, of any length and of white space too. Repeated rows are packed as often as they
    occur; a null doc_id stays null; an empty table gives no rows. Among fill levels that are equally good the fullest is
    taken. Columns but doc_id and text are not read, so none can clash.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(PIECE))
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        if path not in _encoders:
            _encoders[path] = encoder(path)
        encode = _encoders[path]
        packer = SumOfSquares(size, TaskContext.get().partitionId() * STRIDE)
        rows: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256).to_pydict()
                for doc, text in zip(part["doc_id"], part["text"]):
                    rows += packer.add(doc, encode(text or "") + last)
                if len(rows) > 4096:
                    yield out()
                    rows = []
        rows += packer.finish()
        if rows:
            yield out()

    return short_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, PIECE)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1024 ids; odd cases are those of pack()."""
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
