"""Media columns in Matroska: 8-bit mono PCM in a file of EBML elements, and its packet table.

`mux` writes EBML header, segment, info, track, clusters of laced blocks and cues. `packets` parses any file of that shape
(variable-length sizes, unknown sizes of segment and clusters, simple blocks and block groups, the four kinds of lacing)
into rows of track, timestamp, flags and byte range, from which `payload` reads the samples back.

Defined results: a null or empty text is a payload of 64 zero bytes; equal texts give equal files, so repeated rows repeat
their results and there are no ties; an empty table gives no rows, other columns are ignored; one file is made and
read within one task in pieces of clusters, a text being the largest unit held.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyra.llm.common import table

RATE = 8000
FRAME = 512
LACED = 8
CLUSTER = 16 * FRAME * LACED
UNIT = 64
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER_ID, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, CUE_POINT, CUE_TIME, CUE_AT, CUE_TRACK, CUE_POSITION = 0xE7, 0xA3, 0xA0, 0xA1, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1


@dataclass(frozen=True)
class Packet:
    track: int
    timestamp_ms: float
    keyframe: bool
    lacing: int
    cluster: int
    start: int
    end: int


def vint(n: int) -> bytes:
    """An EBML size in as few bytes as hold it; all ones is kept for unknown sizes."""
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _block(offset_ms: int, frames: list[bytes]) -> bytes:
    """A simple block of track 1: fixed-size lacing for equal frames, EBML lacing for others, none for one."""
    head = b"\x81" + offset_ms.to_bytes(2, "big", signed=True)
    if len(frames) == 1:
        return element(SIMPLE_BLOCK, head + b"\x80" + frames[0])
    if len({len(f) for f in frames}) == 1:
        return element(SIMPLE_BLOCK, head + b"\x84" + bytes([len(frames) - 1]) + b"".join(frames))
    sizes, laced = [len(f) for f in frames], b""
    for before, now in zip(sizes, sizes[1:-1]):
        d, n = now - before, 1
        while abs(d) >= (1 << 7 * n - 1):
            n += 1
        laced += ((d + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big")
    return element(SIMPLE_BLOCK, head + b"\x86" + bytes([len(frames) - 1]) + vint(sizes[0]) + laced + b"".join(frames))


_HEADER = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACKS = element(TRACKS, element(TRACK, uint(0xD7, 1) + uint(0x73C5, 1) + uint(0x83, 2) + uint(0x9C, 1) + element(0x86, b"A_PCM/INT/LIT") + element(0xE1, element(0xB5, np.float32(RATE).astype(">f4").tobytes()) + uint(0x9F, 1) + uint(0x6264, 8))))
_INFO = element(INFO, uint(0x2AD7B1, 1_000_000) + element(0x4D80, b"papyra") + element(0x5741, b"papyra"))


def mux(samples: bytes) -> bytes:
    parts, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    for c in range(0, len(samples), CLUSTER):
        start_ms = c * 1000 // RATE
        body = [uint(TIMESTAMP, start_ms)]
        for b in range(c, min(c + CLUSTER, len(samples)), FRAME * LACED):
            end = min(b + FRAME * LACED, c + CLUSTER, len(samples))
            body.append(_block(b * 1000 // RATE - start_ms, [samples[f : min(f + FRAME, end)] for f in range(b, end, FRAME)]))
        cluster = element(CLUSTER_ID, b"".join(body))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start_ms) + element(CUE_AT, uint(CUE_TRACK, 1) + uint(CUE_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEADER + element(SEGMENT, b"".join(parts))


def _number(data: bytes, at: int) -> tuple[int, int]:
    length = 9 - data[at].bit_length()
    if length > 4:
        raise ValueError(f"no element at {at}")
    return int.from_bytes(data[at : at + length], "big"), at + length


def _size(data: bytes, at: int) -> tuple[int, int]:
    """(value, next position); -1 for unknown."""
    length = 9 - data[at].bit_length()
    if length > 8:
        raise ValueError(f"no size at {at}")
    n = int.from_bytes(data[at : at + length], "big") & (1 << 7 * length) - 1
    return (-1 if n == (1 << 7 * length) - 1 else n), at + length


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(number, start of body, end of body). A body of unknown size reaches to the end; its reader stops at a sibling."""
    while at < end:
        number, at = _number(data, at)
        n, at = _size(data, at)
        stop = end if n < 0 else at + n
        if stop > end:
            raise ValueError(f"element {number:x} is cut off")
        yield number, at, stop
        at = stop


def _frames(data: bytes, at: int, end: int) -> tuple[int, int, int, list[tuple[int, int]]]:
    track, at = _size(data, at)
    offset = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    at += 3
    lacing = flags >> 1 & 3
    if lacing == 0:
        return track, offset, flags, [(at, end)]
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3:
        size, at = _size(data, at)
        sizes = [size]
        for _ in range(n - 2):
            length = 9 - data[at].bit_length()
            d, at = _size(data, at)
            size += d - ((1 << 7 * length - 1) - 1)
            sizes.append(size)
        sizes = sizes[: n - 1]
    else:
        sizes = [(end - at) // n] * (n - 1)
    out = []
    for s in sizes:
        out.append((at, at + s))
        at += s
    out.append((at, end))
    return track, offset, flags, out


def parse(data: bytes) -> tuple[list[Packet], list[tuple[int, int, int]]]:
    """Packets in file order, and cues as (time, track, position of the cluster in the segment)."""
    packets: list[Packet] = []
    cues: list[tuple[int, int, int]] = []
    scale = 1_000_000
    for number, s, e in elements(data, 0, len(data)):
        if number != SEGMENT:
            continue
        queue = [(s, e)]
        while queue:
            s1, e1 = queue.pop()
            for number1, a, b in elements(data, s1, e1):
                if number1 == INFO:
                    scale = next((int.from_bytes(data[x:y], "big") for k, x, y in elements(data, a, b) if k == 0x2AD7B1), scale)
                elif number1 == CLUSTER_ID:
                    time, ms = 0, scale / 1e6
                    for k, x, y in elements(data, a, b):
                        if k in (CLUSTER_ID, CUES, TRACKS, INFO):  # the sibling after a cluster of unknown size
                            queue.append((x - _head(data, x, k), e1))
                            break
                        if k == TIMESTAMP:
                            time = int.from_bytes(data[x:y], "big")
                        for bx, by, key in [(x, y, None)] if k == SIMPLE_BLOCK else [(p, q, False) for kk, p, q in elements(data, x, y) if kk == BLOCK] if k == BLOCK_GROUP else []:
                            track, offset, flags, frames = _frames(data, bx, by)
                            packets += [Packet(track, (time + offset) * ms, bool(flags & 128) if key is None else key, flags >> 1 & 3, time, p, q) for p, q in frames]
                elif number1 == CUES:
                    for _, x, y in elements(data, a, b):
                        point = {k: (p, q) for k, p, q in elements(data, x, y)}
                        at = {k: int.from_bytes(data[p:q], "big") for k, p, q in elements(data, *point[CUE_AT])}
                        cues.append((int.from_bytes(data[slice(*point[CUE_TIME])], "big"), at[CUE_TRACK], at[CUE_POSITION]))
    return packets, cues


def _head(data: bytes, body: int, number: int) -> int:
    """Bytes of number and size before a body."""
    n = (number.bit_length() + 7) // 8
    for length in range(1, 9):
        if data[body - length].bit_length() == 9 - length and data[body - length - n : body - length] == number.to_bytes(n, "big"):
            return n + length
    raise ValueError("no head before the body")


def payload(data: bytes, packets: list[Packet], track: int = 1) -> bytes:
    return b"".join(data[p.start : p.end] for p in packets if p.track == track)


def packet_table(media: DataFrame, key: str, data: str) -> DataFrame:
    """One row per packet: key, packet number, track, timestamp, flags, lacing, cluster and byte range [start, end)."""
    kind = media.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, p.track, p.timestamp_ms, p.keyframe, p.lacing, p.cluster, p.start, p.end) for k, d in zip(batch.column(key).to_pylist(), batch.column(data).to_pylist(), strict=True) if d for i, p in enumerate(parse(d)[0])]
            columns = list(zip(*rows, strict=True)) or [()] * 9
            kinds = [batch.column(key).type, pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[key, "packet", "track", "timestamp_ms", "keyframe", "lacing", "cluster_ms", "start", "end"])

    return media.select(key, data).mapInArrow(run, f"`{key}` {kind}, packet long, track long, timestamp_ms double, keyframe boolean, lacing int, cluster_ms long, start long, `end` long")


def feature(samples: bytes, packets: int) -> str:
    """Mean, root mean square about 128 and crossings of 128, in fixed notation, with the number of packets."""
    x = np.frombuffer(samples, np.uint8).astype(np.float64) - 128
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    return f"mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings};packets={packets}"


def media_rows(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                media = mux(raw + bytes(-len(raw) % UNIT if raw else UNIT))
                packets, cues = parse(media)
                back = payload(media, packets)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, len(packets)), len(cues)))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*names, "n_cues"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_cues long")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_rows(table(spark, sf_dir, "documents"))
