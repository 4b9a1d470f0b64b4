"""Operator 7: WARC archives, written as one gzip stream and normalised to a member per record.

A task writes its pages into archives that are each one monolithic gzip stream. The normaliser inflates such a
stream once, cuts it into records as it goes, writes every record as a gzip member of its own and lists offset and
length of each in a sidecar index. Reading takes members by that index. Archives are binary values of bounded size
in tables of the shared folder, since executors reach no other file store than Spark's.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgloom.llm.common import map_rows
from kgloom.session import staged, table

#: Payload bytes of an archive, about; a longer record is an archive by itself.
ARCHIVE = 4 << 20
#: Payloads below this length are never revisits.
SMALL = 100
LEVEL = 1
URN = "urn:page:"
#: The profile of a revisit with the same payload, and the date of records that have none.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"


def record(page_id, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response, or a revisit where refers_to is given: then the block holds the HTTP head only."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    safe = "".join(c for c in url if c > " ") or "about:blank"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{URN}{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha256:{digest}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <{URN}{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def monolith(records: list[bytes], level: int = LEVEL) -> bytes:
    """One gzip member over all records."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join([z.compress(r) for r in records]) + z.flush()


def _inflated(data: bytes, step: int = 1 << 20) -> Iterator[bytes]:
    """Bytes of one or more gzip members, in pieces."""
    while data:
        z = zlib.decompressobj(31)
        rest = data
        while rest and not z.eof:
            yield z.decompress(rest, step)
            rest = z.unconsumed_tail
        if not z.eof:
            yield z.flush()
            if not z.eof:
                raise ValueError("gzip stream is cut off")
        data = z.unused_data


def headers(raw: bytes) -> dict[str, str]:
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def records_of(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records (head, block and the two line ends) of inflated pieces; holds one record at a time."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                at = held.find(b"\r\n\r\n")
                if at < 0:
                    break
                need = at + 4 + int(headers(bytes(held[:at]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError("WARC record is cut off")


def normalise(data: bytes, level: int = LEVEL) -> tuple[bytes, list[tuple[int, int]]]:
    """(archive with a member per record, sidecar index of (offset, length)); the input is inflated once."""
    out, index, at = [], [], 0
    for r in records_of(_inflated(data)):
        z = zlib.compressobj(level, zlib.DEFLATED, 31)
        member = z.compress(r) + z.flush()
        out.append(member)
        index.append((at, len(member)))
        at += len(member)
    return b"".join(out), index


def parse(record_: bytes) -> dict:
    """Fields of a record. The payload of a revisit is None, its length that of the HTTP head."""
    at = record_.index(b"\r\n\r\n")
    h = headers(record_[:at])
    block = record_[at + 4 : at + 4 + int(h["content-length"])]
    cut = block.index(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in block[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    number = lambda x: None if x in (None, f"<{URN}None>") else int(x[len(URN) + 1 : -1])
    kind = h["warc-type"]
    payload = block[cut + 4 :] if kind == "response" else None
    digest = h["warc-payload-digest"].partition(":")[2]
    if payload is not None and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("payload differs from its digest")
    return {"page_id": number(h["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(h.get("warc-refers-to")), "payload": payload}


def write_archives(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """(first long, data binary): monolithic archives of pages (page_id, url, html).

    Of equal payloads of at least SMALL bytes, that of the smallest page_id is a response, the others are revisits of
    it; rows that repeat this page_id are responses too. Null html is empty; a null page_id is always a response.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url") if "url" in pages.columns else F.lit("").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digests = staged(spark, pages.where(F.octet_length("html") >= SMALL).select("page_id", F.sha2("html", 256).alias("digest")), "warc-digests")
    copied = staged(spark, digests.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null"), "warc-copied")
    revisits = digests.join(copied, "digest").where("page_id != refers_to").select(F.col("page_id").alias("id"), "digest", "refers_to").distinct()
    told = pages.withColumn("_digest", F.sha2("html", 256)).join(revisits, (F.col("page_id") == F.col("id")) & (F.col("_digest") == F.col("digest")), "left").select("page_id", "url", "html", F.col("_digest").alias("digest"), "refers_to")

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("first", pa.int64()), ("data", pa.binary())])
        z, parts, size, first = None, [], 0, None

        def out():
            return pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([b"".join([*parts, z.flush()])], pa.binary())], schema=schema)

        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "digest", "refers_to")]
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (c[i].as_py() for c in columns)
                payload = html.encode("utf-8", "replace")
                if z is not None and size + len(payload) > ARCHIVE:
                    yield out()
                    z, parts, size = None, [], 0
                if z is None:
                    z, first = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), page_id
                parts.append(z.compress(record(page_id, url, payload, digest, refers_to)))
                size += len(payload)
        if z is not None:
            yield out()

    return told.mapInArrow(run, "first long, data binary")


def normalise_archives(archives: DataFrame) -> DataFrame:
    """(first, data, index array<struct<offset, length>>): each archive with a member per record and its sidecar index."""

    def make():
        def work(x: dict) -> dict:
            both = [normalise(d) for d in x["data"]]
            return {"first": x["first"], "data": [d for d, _ in both], "index": [[{"offset": a, "length": n} for a, n in i] for _, i in both]}

        return work

    return map_rows(archives, make, "first long, data binary, index array<struct<offset:long,length:long>>", slice_=4)


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record, each member taken by its index entry and inflated by itself."""
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    def make():
        def work(x: dict) -> dict:
            found = [parse(zlib.decompress(d[e["offset"] : e["offset"] + e["length"]], 31)) for d, index in zip(x["data"], x["index"]) for e in index]
            return {c: [r[c] for r in found] for c in columns}

        return work

    return map_rows(archives, make, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long", slice_=4)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every row of pages, read back from the normalised
    archives; odd cases are those of write_archives()."""
    archives = staged(spark, write_archives(spark, table(spark, sf_dir, "pages")), "warc-monolithic")
    return read_archives(staged(spark, normalise_archives(archives), "warc-normalised"))


SQL = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
f as (select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by 1)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from p left join f using (payload_digest)
"""
