"""Shared pieces of the operators: columns, Arrow maps over whole rows, bounded word caches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows handled at once inside an Arrow batch, so that memory follows this and not the batch.
SLICE = 256


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the column as text, modulo n; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def held_out(n: int, column: str = "doc_id") -> Column:
    """Whether a row is kept from learning: remainder 2. Rows with a null id are not held out."""
    return F.coalesce(crc_mod(column, n) == 2, F.lit(False))


#: Rows of an Arrow batch of whole texts; Spark's default of 10,000 takes tens of MB in the JVM and again in Python.
BATCH = 1000


def short_batches(df: DataFrame) -> DataFrame:
    """df, with the session's Arrow batches at most BATCH rows long; a shorter setting stays."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH:
        conf.set(key, str(BATCH))
    return df


def give_back() -> None:
    """Returns memory that a finished task has freed; workers are used again and would keep it."""
    import ctypes
    import gc

    gc.collect()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # a C library without it
        pass


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], dict]], schema: str, slice_: int = SLICE) -> DataFrame:
    """mapInArrow over slices of columns: make() runs once a task, its result maps {column: list} to {column: list}."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, slice_):
                out = work(batch.slice(at, slice_).to_pydict())
                if out is not None:
                    yield pa.RecordBatch.from_pydict(out, schema=arrow)
        del work
        give_back()

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return short_batches(df).mapInArrow(run, schema)


def unused(name: str, columns) -> str:
    """The name, or with as many underscores before it as it takes until no column has it (cases are not told apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ddl(df: DataFrame, columns) -> str:
    """The columns of df with their types, as a schema's text."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


#: Counts of one row of chunked_counts().
CHUNK = 1 << 12


def chunked_counts(total: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """(numbers, bytes) of the chunks of a task's array of counts that are not all zero."""
    chunks = total.astype(np.int64).reshape(-1, CHUNK)
    used = np.flatnonzero(chunks.any(axis=1))
    return used.astype(np.int32), [chunks[i].tobytes() for i in used]


def summed_counts(parts: DataFrame, size: int) -> np.ndarray:
    """The sum of all tasks' chunks (chunk int, counts binary), added up by executors; the driver gets one array of `size`."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, c in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(c, np.int64)
                total[i] = total[i] + part if i in total else part
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["chunk", "counts"])

    out = np.zeros((-(-size // CHUNK), CHUNK), np.int64)
    for r in parts.repartition(32, "chunk").mapInArrow(add, "chunk int, counts binary").collect():
        out[r["chunk"]] = np.frombuffer(r["counts"], np.int64)
    return out.reshape(-1)[:size]


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased and nothing else (bytes.lower and split know only ASCII)."""
    return (text or "").encode("utf-8", "replace").lower().split()


class BoundedCache(dict):
    """A dict that fills itself by a function; two generations bound it.

    When `most` keys are held they become the old generation, and the one before is let go: a key in use moves
    on to the new generation. So at most 2 * most keys are held; keys of over `longest` are computed each time.
    """

    def __init__(self, make: Callable, most: int = 150_000, longest: int = 64):
        super().__init__()
        self.make, self.most, self.longest, self.old = make, most, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value
