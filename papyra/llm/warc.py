"""WARC archives as a chunked record table.

A record's bytes are stored as rows (archive, record, chunk, data, ...): chunk 0 starts with the WARC header, and payloads
above CHUNK bytes continue in further rows. Spark cuts the payload into chunk rows before Python sees it, so writer and
reader hold a chunk of a record at a time and carry a running digest from one to the next; only the input row itself, in
Spark, holds a page whole. Every row carries the SHA-1 of its own payload bytes and the running SHA-1 of the payload so far;
the last row's is the record's. The rows of a record, concatenated in order, are a WARC/1.1 record; an archive is its
records, concatenated. Records have numbers of their own, so pages may repeat an identifier or have none.

Equal payloads (by SHA-1, base32) of at least `floor` bytes are stored once, with the largest identifier; the others are
revisit records that refer to it. Which these are is settled on digests alone, before any payload moves; only revisited
digests are joined with the pages.

Defined results: null payloads are empty; empty payloads are payloads like any other; repeated rows give repeated records,
of any size; a page without identifier is a revisit of an equal one that has an identifier, and is kept with an empty id; no
pages give no records.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import table, written

CHUNK = 1 << 20
FLOOR = 0
SCHEMA = "archive int, record long, record_id long, chunk int, chunks int, data binary, payload_from int, payload_sha1 binary, running_sha1 binary"
_ARROW = pa.schema([("archive", pa.int32()), ("record", pa.int64()), ("record_id", pa.int64()), ("chunk", pa.int32()), ("chunks", pa.int32()), ("data", pa.binary()), ("payload_from", pa.int32()), ("payload_sha1", pa.binary()), ("running_sha1", pa.binary())])
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def b32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def header(kind: str, key: int | None, url: str | None, sha1: bytes, length: int, size: int, refers: int | None) -> bytes:
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:papyra:page:{'' if key is None else key}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{b32(sha1)}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response",
    ]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:papyra:page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*lines, f"Content-Length: {length}"]) + "\r\n\r\n").encode()


def responses(pages: DataFrame, key: str, payload: str, floor: int = FLOOR) -> DataFrame:
    """(sha, response): digests of payloads that several pages share, and the largest of their identifiers. Narrow rows only."""
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    return pages.filter(F.octet_length(raw) >= floor).select(F.unhex(F.sha1(raw)).alias("sha"), F.col(key).alias("k")).groupBy("sha").agg(F.max("k").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", floor: int = FLOOR, chunk: int = CHUNK) -> DataFrame:
    """The archives' rows. The shared digests are written first, so that their measured size picks the join's strategy."""
    shared = written(responses(pages, key, payload, floor), "responses")
    raw = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    own = pages.select(F.col(key).alias("k"), F.col(url).alias("u"), raw.alias("p"), F.unhex(F.sha1(raw)).alias("sha")).join(shared, "sha", "left")
    refers = F.when((F.octet_length("p") >= floor) & ~F.col("response").eqNullSafe(F.col("k")), F.col("response"))
    sized = own.select("k", "u", "p", "sha", F.octet_length("p").alias("size"), refers.alias("refers"), F.spark_partition_id().alias("archive"), F.monotonically_increasing_id().alias("record"))
    # a revisit has no payload; an empty one is a chunk too
    parts = F.when(F.col("refers").isNotNull(), F.lit(1)).otherwise(F.greatest(F.lit(1), F.ceil(F.col("size") / F.lit(chunk)).cast("int")))
    cut = sized.withColumn("chunks", parts).select("*", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"))
    piece = F.when(F.col("refers").isNull(), F.substring("p", F.col("chunk") * chunk + 1, F.lit(chunk))).otherwise(F.lit(b""))
    rows = cut.select("archive", "record", "k", "u", "sha", "size", "refers", "chunk", "chunks", piece.alias("piece"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        running = hashlib.sha1()
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for i in range(batch.num_rows):
                archive, record, k, u, sha, whole, refers, c, of = (batch.column(n)[i].as_py() for n in ("archive", "record", "k", "u", "sha", "size", "refers", "chunk", "chunks"))
                data = batch.column("piece")[i].as_py()
                own = hashlib.sha1(data).digest()
                head = b""
                if c == 0:
                    running = hashlib.sha1()
                    kind, length = ("response", whole) if refers is None else ("revisit", 0)
                    head = header(kind, k, u, sha, len(_HTTP) + length, whole, refers) + _HTTP
                running.update(data)
                out.append((archive, record, k, c, of, head + data + (b"\r\n\r\n" if c == of - 1 else b""), len(head), own, running.digest()))
                size += len(out[-1][5])
                if size > 4 << 20:
                    yield _batch(out)
                    out, size = [], 0
            if out:
                yield _batch(out)

    return rows.mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _ARROW.types, strict=True)], schema=_ARROW)


def parse_header(data: bytes) -> tuple[dict[str, str], int]:
    """Fields of a record's header by lower-case name, and where its block starts."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("no WARC record")
    return {k.lower(): v for k, v in (x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)}, end + 4


class _Reader:
    """Takes a record's rows in order; at its last gives the record's row."""

    def __init__(self):
        self.fields: dict[str, str] | None = None

    def take(self, chunk: int, chunks: int, data: memoryview) -> tuple | None:
        if chunk == 0:
            # the header holds the whole url, so it may be of any length
            whole = bytes(data)
            self.fields, start = parse_header(whole)
            self.length = int(self.fields["content-length"])
            http = whole.index(b"\r\n\r\n", start) + 4
            self.left, self.sha, self.size = self.length - (http - start), hashlib.sha1(), 0
            data = data[http:]
        piece = data[: self.left]
        self.sha.update(piece)
        self.size += len(piece)
        self.left -= len(piece)
        if chunk < chunks - 1:
            return None
        f = self.fields
        if self.left or bytes(data[len(piece) :]) != b"\r\n\r\n":
            raise ValueError(f"record {f['warc-record-id']} is cut off")
        digest, kind = f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"]
        if kind == "response" and b32(self.sha.digest()) != digest:
            raise ValueError(f"record {f['warc-record-id']} has another digest")
        key, refers = (f.get(n, "").strip("<>").rpartition(":")[2] for n in ("warc-record-id", "warc-refers-to"))
        return int(key) if key else None, int(f["x-payload-length"]) if kind == "revisit" else self.size, digest, kind, int(refers) if refers else None, f["warc-target-uri"]


def read(chunks: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) from the archives' bytes, digests verified.

    Records of one row are read where they lie; those of several are brought together by record and read in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader()
        for batch in batches:
            at, of, data = (batch.column(n) for n in ("chunk", "chunks", "data"))
            rows = [r for i in range(batch.num_rows) if (r := reader.take(at[i].as_py(), of[i].as_py(), memoryview(data[i].as_buffer())))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    used = chunks.select("archive", "record", "chunk", "chunks", "data")
    whole = used.filter("chunks = 1").mapInArrow(run, schema)
    split = used.filter("chunks > 1").repartition("archive", "record").sortWithinPartitions("archive", "record", "chunk")
    return whole.unionByName(split.mapInArrow(run, schema))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(written(write(table(spark, sf_dir, "pages")), "archives")).drop("url")


_BASE32 = "array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[i // 4 * 5 + 1:i // 4 * 5 + 5])::BIGINT >> (5 * (3 - i % 4))::INT) & 31) + 1]), '')"
ORACLE = f"""
WITH raw AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
named AS (SELECT page_id, strlen(p)::BIGINT AS payload_bytes, sha1(p) AS h, max(page_id) OVER (PARTITION BY p) AS most FROM raw)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM most OR most IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM most THEN most END AS refers_to
FROM named
"""
