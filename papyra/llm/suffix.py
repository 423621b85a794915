"""Removal of passages that a document of smaller identifier has, by hash-compared suffix sorting.

A byte goes if a SPAN-byte string that covers it also starts in a document of smaller key. Sorting all suffixes of all
documents together would move the corpus several times over, so the suffixes are first told apart by anchors: of each
SPAN-byte string, the KGRAM-byte part of smallest hash. Equal strings have equal anchors, so only strings under an anchor that
two documents share can repeat.

Exact copies are settled first, on digests: all but the smallest key lose their whole text and take no further part.

1. Anchors: each task sends an anchor's hash and one document of at most two contents (contents of one task answer for each
   other, and are told apart by 64-bit digests), packed into binary blocks. What comes back, by document, are the hashes that
   several contents share.
2. Candidates: the strings under shared anchors form runs of neighbouring strings. Each task sends each distinct run once,
   with its smallest document; equal runs are told by their bytes. The runs of a hot anchor, one that many documents share (by
   a sample that sets routes only), are cut again by further, shorter anchors, so that they spread over many parts.
3. Suffix sort: per part, string starts of distinct runs are merge-sorted as suffixes, from buckets of their first 16 bytes.
   Prefix polynomial hashes and binary search find how far two suffixes agree, so a comparison takes log2(SPAN) steps.
   Neighbours in the order that agree on SPAN bytes, verified byte by byte, are one string: a collision removes nothing. Before
   the sort, starts whose slot in a table of hashed strings is theirs alone are left out, as nothing can equal them. Each
   string's smallest document goes back to the tasks' runs.
4. Removal: documents meet their removed ranges.

A group of copies sends one run for each task, not one for each copy, whatever its size. The number of parts follows from the
bytes of text.

Defined results: texts shorter than SPAN and null texts keep all; a null key is neither source nor target; rows that repeat
a key are the same document and do not remove from each other, and each has its own text's result; overlaps within one document do not count; no documents give
no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import blocks, caches, discard, expand, release, table, tidy, written

SPAN = 50
KGRAM = 20
#: Bytes of text whose anchors are found together, and whose runs are told apart together.
BUFFER = 1 << 19
GROUP = 1 << 23
#: Bytes of text for each part of the sort.
PART = 6 << 20
#: An anchor is hot above HOT documents, or one in SPREAD where that is more, judged by SAMPLED documents of the least hot one.
HOT = 2048
SPREAD = 10_000
SAMPLED = 32
#: Further anchors of hot runs: short, so that they soon lie in what differs between documents.
ROUTE = 4
SALTS = (0x5851F42D4C957F2D, 0x14057B7EF767814F)
BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_power: dict[str, np.ndarray] = {}
caches.append(_power)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_power.get("up", ())) < n + 1:
        _power["up"] = np.cumprod(np.append(np.uint64(1), np.full(n, BASE, np.uint64)))
        _power["down"] = np.cumprod(np.append(np.uint64(1), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)))
    return _power["up"], _power["down"]


def prefix_hashes(raw: np.ndarray) -> np.ndarray:
    return np.append(np.uint64(0), np.cumsum(_VALUES[raw] * powers(len(raw))[0][: len(raw)]))


def spans_hash(prefix: np.ndarray, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
    return (prefix[start + length] - prefix[start]) * powers(len(prefix))[1][start]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def anchors(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, span: int = SPAN, kgram: int = KGRAM, salt: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts [start, end) in raw: the runs of neighbouring strings of one anchor, as (anchor hash, first start, number).
    Each salt has anchors of its own."""
    width = span - kgram + 1
    none = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(raw) < span:
        return none
    at = np.arange(len(raw) - kgram + 1)
    h = mixed(spans_hash(prefix_hashes(raw), at, kgram) ^ np.uint64(salt))
    low = np.uint64((1 << 26) - 1)
    least = (h & ~low) | at.astype(np.uint64)  # the smallest hash, then the leftmost
    reach = 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    least = (least & low).astype(np.int64)
    edge = np.zeros(len(raw) + 1, np.int8)
    long = ends - starts >= span
    np.add.at(edge, starts[long], 1)
    np.add.at(edge, ends[long] - span + 1, -1)
    valid = np.cumsum(edge[: len(least)], dtype=np.int8) > 0
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | ~valid[:-1]
    first = np.flatnonzero(change & valid)
    if not len(first):
        return none
    over = np.append(np.flatnonzero(change | ~valid), len(least))
    stop = over[np.searchsorted(over, first, "right")]
    return h[least[first]], first, stop - first


# -- suffix sort


def agree(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """How many bytes the suffixes at a and b have in common, at most limit, by binary search over prefix hashes."""
    lo, hi = np.zeros(len(a), np.int64), limit.astype(np.int64).copy()
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi + 1) // 2
        same = spans_hash(prefix, a, mid) == spans_hash(prefix, b, mid)
        lo, hi = np.where(open_ & same, mid, lo), np.where(open_ & ~same, mid - 1, hi)


def before(raw: np.ndarray, prefix: np.ndarray, a: np.ndarray, b: np.ndarray, limit: int, or_equal: np.ndarray) -> np.ndarray:
    """Is the suffix at a, cut to limit bytes, before the one at b (or equal to it, where or_equal)?"""
    left, right = np.minimum(limit, len(raw) - a), np.minimum(limit, len(raw) - b)
    n = agree(prefix, a, b, np.minimum(left, right))
    inside = n < np.minimum(left, right)
    x, y = raw[np.minimum(a + n, len(raw) - 1)], raw[np.minimum(b + n, len(raw) - 1)]
    return np.where(inside, x < y, np.where(or_equal, left <= right, left < right))


def suffix_sort(raw: np.ndarray, starts: np.ndarray, segment: np.ndarray, limit: int) -> np.ndarray:
    """The order of starts by segment, then by suffix cut to limit bytes: a merge sort of all segments at once.

    segment is sorted. At each level every element finds its rank in the run beside its own by binary search, so each
    takes log2(run) hash comparisons of log2(limit) steps. Segments that are one run already are left alone.
    """
    prefix = prefix_hashes(raw)
    order = np.arange(len(starts))
    heads = np.flatnonzero(np.append(True, segment[1:] != segment[:-1])) if len(starts) else order
    sizes = np.diff(np.append(heads, len(starts)))
    width = 1
    while len(sizes) and width < sizes.max():
        big = sizes > width
        at = expand(heads[big], sizes[big])
        head, size = np.repeat(heads[big], sizes[big]), np.repeat(sizes[big], sizes[big])
        inside = at - head
        run = inside // width
        is_left = run % 2 == 0
        sibling = np.where(is_left, run + 1, run - 1) * width
        lo = np.minimum(sibling, size)
        base = lo.copy()
        hi = np.minimum(sibling + width, size)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                break
            mid = (lo[open_] + hi[open_]) // 2
            other = starts[order[head[open_] + mid]]
            # a left element goes before equal ones of the right run, a right element after those of the left
            less = before(raw, prefix, other, starts[order[at[open_]]], limit, ~is_left[open_])
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        pair = run // 2 * 2 * width
        moved = order.copy()
        moved[head + pair + (inside - run * width) + (lo - base)] = order[at]
        order, width = moved, 2 * width
    return order


def _may_repeat(h: np.ndarray) -> np.ndarray:
    """False where no other of these hashes has the same slot of a table of eight slots or more for each."""
    bits = max(10, (8 * len(h)).bit_length())
    slot = (mixed(h) >> np.uint64(64 - bits)).astype(np.int64)
    last = np.zeros(1 << bits, np.int32)
    number = np.arange(len(h), dtype=np.int32)
    last[slot] = number
    met = np.zeros(1 << bits, bool)
    met[slot[last[slot] != number]] = True
    return met[slot]


def _head(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 16 bytes from at on, as two numbers in the order of the bytes."""
    out = []
    for a in (0, 8):
        n = np.zeros(len(at), np.uint64)
        for b in range(a, a + 8):
            n = n << np.uint64(8) | raw[at + b]
        out.append(n)
    return out[0], out[1]


def smallest_sources(data: list[bytes], least: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """data: distinct runs; least: each one's smallest document. For every string of every run, the smallest document
    that has it: flat, with the number of strings of each run."""
    raw = np.frombuffer(b"".join(data), np.uint8)
    lengths = np.fromiter(map(len, data), np.int64, len(data))
    count = lengths - span + 1
    at = expand(np.cumsum(lengths) - lengths, count)
    own = np.repeat(least, count)
    rows = np.flatnonzero(_may_repeat(spans_hash(prefix_hashes(raw), at, span)))
    if len(rows):
        high, low = _head(raw, at[rows])
        rows = rows[np.lexsort((low, high))]
        high, low = _head(raw, at[rows])
        segment = np.cumsum(np.append(True, (high[1:] != high[:-1]) | (low[1:] != low[:-1])))
        rows = rows[suffix_sort(raw, at[rows], segment, span)]
        new = np.ones(len(rows), bool)
        for a in range(0, len(rows) - 1, 1 << 17):  # neighbours in suffix order, byte by byte
            x, y = at[rows[a : a + (1 << 17)][: len(rows) - 1 - a]], at[rows[a + 1 : a + 1 + (1 << 17)]]
            equal = np.ones(len(x), bool)
            for b in range(span):
                equal &= raw[x + b] == raw[y + b]
            new[a + 1 : a + 1 + len(x)] = ~equal
        first = np.flatnonzero(new)
        own[rows] = np.repeat(np.minimum.reduceat(own[rows], first), np.diff(np.append(first, len(rows))))
    return own, count


# -- stages


def _pack6(keys: np.ndarray) -> bytes:
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack6(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def _planes(x: np.ndarray) -> bytes:
    """Differences of whole numbers, byte plane by byte plane: these compress well."""
    return np.diff(x, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view("<i8").ravel())


def _texts(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """A string column's bytes and offsets (nulls are empty)."""
    c = batch.column(name)
    c = pc.fill_null(c, "").cast(pa.large_string())
    offsets = np.frombuffer(c.buffers()[1], np.int64)[c.offset : c.offset + len(c) + 1]
    body = c.buffers()[2]
    raw = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]] if len(offsets) else raw[:0], offsets - offsets[0] if len(offsets) else np.zeros(1, np.int64)


def _runs(raw: np.ndarray, offsets: np.ndarray, span: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, start in its text, number of strings) of every row, by buffers; a long text's buffers overlap by span - 1.

    Runs that a buffer's edge cuts are shorter there than elsewhere, but each string is in exactly one run and under its own
    anchor."""
    pieces = [(r, a, min(a + BUFFER + span - 1, e)) for r, (s, e) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)) for a in range(s, max(s + 1, e - span + 1), BUFFER)]
    for x, y in blocks([p[2] - p[1] for p in pieces], BUFFER):
        part = pieces[x:y]
        row, a, b = (np.array(c, np.int64) for c in zip(*part, strict=True))
        n = b - a
        at = np.cumsum(n) - n
        body = np.concatenate([raw[s:e] for _, s, e in part])
        key, first, count = anchors(body, at, at + n, span)
        of = np.searchsorted(at + n, first, "right")
        yield key, row[of], first - at[of] + (a - offsets[row])[of], count


def _shared_anchors(docs: DataFrame, parts: int, span: int) -> DataFrame:
    """(key, anchors): by document, hashes (six bytes each) of anchors that a document of another content has too."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in (b.slice(i, 1 << 15) for b in batches for i in range(0, b.num_rows, 1 << 15)):
            raw, offsets = _texts(batch, "text")
            of = batch.column("key").to_numpy()
            for x, y in blocks(np.diff(offsets).tolist(), GROUP):
                found = [(k & ~np.uint64(0xFFFF)) | r.astype(np.uint64) for k, r, _, _ in _runs(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], span)]
                pair = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]))
                if not len(pair):
                    continue
                keys, row = pair >> np.uint64(16), (pair & np.uint64(0xFFFF)).astype(np.int64)
                who = of[x:y][row]
                content = np.array([xxhash.xxh3_64_intdigest(raw[s:e].data) for s, e in zip(offsets[x:y].tolist(), offsets[x + 1 : y + 1].tolist(), strict=True)], np.uint64)[row]
                order = np.lexsort((who, content, keys))
                keys, who, content = keys[order], who[order], content[order]
                head = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                size = np.diff(np.append(head, len(keys)))
                tail = head + size - 1
                # contents that meet here are known to be shared: straight to their documents; two contents of them go on
                mixed_ = content[head] != content[tail]
                rows: list[tuple] = []
                several = np.flatnonzero(np.repeat(mixed_, size))
                by = several[np.argsort(who[several], kind="stable")]
                for s, e in _groups(who[by]):
                    rows.append((-1 - int(who[by[s]]) % parts, who[by[s] : by[s] + 1].tobytes(), None, None, _pack6(keys[by[s:e]])))
                sent_ = np.append(head, tail[mixed_])
                part = (keys[sent_] % np.uint64(parts)).astype(np.int64)
                sent_ = sent_[np.lexsort((content[sent_], who[sent_], part))]
                part = (keys[sent_] % np.uint64(parts)).astype(np.int64)
                for s, e in _groups(part):
                    some = sent_[s:e]
                    first, stop = np.array(_groups(who[some])).T
                    rows.append((int(part[s]), _planes(who[some[first]]), content[some[first]].tobytes(), (stop - first).astype("<u4").tobytes(), _pack6(keys[some])))
                kinds = [pa.int64(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "docs", "contents", "counts", "anchors"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            k, d, c = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(k, kind="stable")
            k, d, c = k[order], d[order], c[order]
            head = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
            several = np.repeat(np.minimum.reduceat(c, head) < np.maximum.reduceat(c, head), np.diff(np.append(head, len(k))))
            k, d = k[several], d[several]
            if not len(k):
                return
            order = np.argsort(d, kind="stable")
            k, d = k[order], d[order]
            cut = _groups(d)
            packed = _pack6(k)
            yield pa.RecordBatch.from_arrays([pa.array(d[[s for s, _ in cut]]), pa.array([packed[6 * s : 6 * e] for s, e in cut], pa.binary())], names=["key", "anchors"])

        for batch in batches:
            direct: list[tuple[int, bytes]] = []
            for part, docs_, contents, counts, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    direct.append((int(np.frombuffer(docs_, np.int64)[0]), packed))
                    continue
                if part != now:
                    yield from out()
                    held, now = [], part
                n = np.frombuffer(counts, "<u4")
                held.append((_unpack6(packed), np.repeat(_unplanes(docs_), n), np.repeat(np.frombuffer(contents, np.uint64), n)))
            if direct:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in direct], pa.int64()), pa.array([x for _, x in direct], pa.binary())], names=["key", "anchors"])
        yield from out()

    sent = docs.mapInArrow(send, "part long, docs binary, contents binary, counts binary, anchors binary")
    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(meet, "key long, anchors binary")


def _groups(sorted_: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of equal values."""
    if not len(sorted_):
        return []
    cut = np.flatnonzero(np.append(True, sorted_[1:] != sorted_[:-1])).tolist()
    return list(zip(cut, [*cut[1:], len(sorted_)], strict=True))


def _hot(by_doc: DataFrame, docs: int) -> np.ndarray:
    """Anchors (six bytes) that many documents share, by a sample; at most SPREAD times the anchors of a document on average."""
    least = max(HOT, docs // SPREAD)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [np.unique(_unpack6(b"".join(v))).view(np.int64) for v in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *each]))], names=["k"])

    some = by_doc.filter(F.pmod(F.xxhash64("key"), F.lit(least)) < SAMPLED).select("shared")
    found = some.mapInArrow(unpack, "k long").groupBy("k").count().filter(F.col("count") >= SAMPLED).select("k").toArrow()
    return np.sort(found.column("k").to_numpy().astype(np.uint64))


def _inside(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x if len(sorted_) else np.zeros(len(x), bool)


def _spread(text: np.ndarray, k: np.ndarray, start: np.ndarray, count: np.ndarray, hot: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(route, start, count): the runs of hot anchors cut by further anchors, the others as they are."""
    some = _inside(hot, k)
    if not some.any():
        return k, start, count
    route, s, c = k[some], start[some], count[some]
    for salt in SALTS:
        n = c + span - 1
        at = np.cumsum(n) - n
        more, first, c = anchors(text[expand(s, n)], at, at + n, span, ROUTE, salt)
        of = np.searchsorted(at + n, first, "right")
        route, s = route[of] ^ (more >> np.uint64(16)), first - at[of] + s[of]
    return np.append(k[~some], route), np.append(start[~some], s), np.append(count[~some], c)


def _candidates(docs: DataFrame, by_doc: DataFrame, hot: Broadcast, parts: int, span: int) -> DataFrame:
    """Rows of two kinds, told by part. part >= 0: a task's distinct runs of this part of the routes. part < 0: a document's runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        many = hot.value
        group = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = _texts(batch, "text")
            of, tags, shared_by = batch.column("key").to_numpy(), batch.column("tag").to_numpy(), batch.column("shared")
            for x, y in blocks(np.diff(offsets).tolist(), GROUP):
                group += 1
                number: dict[bytes, int] = {}
                least: list[int] = []
                part: list[int] = []
                rows: list[tuple] = []
                body = raw[offsets[x] : offsets[y]].tobytes()
                wanted = {r - x: np.unique(_unpack6(b"".join(v))) for r in range(x, y) if (v := shared_by[r].as_py())}
                here: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}
                for key, row, start, count in _runs(raw[offsets[x] : offsets[y]], offsets[x : y + 1] - offsets[x], span):
                    cut = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, int)
                    for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(row)], strict=True) if len(row) else ():
                        if (w := wanted.get(int(row[s]))) is not None:
                            k = key[s:e] >> np.uint64(16)
                            ok = w[np.minimum(np.searchsorted(w, k), len(w) - 1)] == k
                            here.setdefault(int(row[s]), []).append((k[ok], start[s:e][ok], count[s:e][ok]))
                for row, found in sorted(here.items(), key=lambda f: of[x + f[0]]):
                    base, d = int(offsets[x + row] - offsets[x]), int(of[x + row])
                    k, start, count = (np.concatenate(c) for c in zip(*found, strict=True))
                    k, start, count = _spread(raw[offsets[x + row] : offsets[x + row + 1]], k, start, count, many, span)
                    ids = []
                    for a, n, p in zip((start + base).tolist(), count.tolist(), (k % np.uint64(parts)).tolist(), strict=True):
                        i = number.setdefault(body[a : a + n + span - 1], len(number))
                        if i == len(least):
                            least.append(d)
                            part.append(p)
                        ids.append(i)
                    rows.append((-1, group, d, int(tags[x + row]), np.array(ids, "<i4").tobytes(), start.astype("<i4").tobytes(), count.astype("<i4").tobytes(), None))
                if not number:
                    continue
                data, of_part, low = list(number), np.array(part), np.array(least, "<i8")
                order = np.argsort(of_part, kind="stable")
                cut = np.flatnonzero(np.append(True, of_part[order][1:] != of_part[order][:-1]))
                for s, e in zip(cut.tolist(), [*cut[1:].tolist(), len(order)], strict=True):
                    some = order[s:e]
                    mine = [data[i] for i in some.tolist()]
                    rows.append((int(of_part[some[0]]), group, None, None, some.astype("<i4").tobytes(), low[some].tobytes(), np.array([len(m) for m in mine], "<i4").tobytes(), b"".join(mine)))
                kinds = [*[pa.int64()] * 4, *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "grp", "key", "tag", "ids", "starts", "lengths", "data"])

    own = docs.join(by_doc, "key").filter("whole is null or not array_contains(whole, tag)").drop("whole")
    return own.mapInArrow(run, "part long, grp long, key long, tag long, ids binary, starts binary, lengths binary, data binary")


def _sources(runs: DataFrame, span: int) -> DataFrame:
    """(grp, ids, counts, least): for the runs of a task that some smaller document has in part, each string's smallest document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: list[tuple] = []
        now = None

        def out() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            number: dict[bytes, int] = {}
            which, group, ids, low = [], [], [], []
            for g, i, s, n, d in held:
                i, s, n = np.frombuffer(i, "<i4"), np.frombuffer(s, "<i8"), np.frombuffer(n, "<i4")
                ends = np.cumsum(n).tolist()
                which += [number.setdefault(d[e - m : e], len(number)) for e, m in zip(ends, n.tolist(), strict=True)]
                group.append(np.full(len(i), g))
                ids.append(i)
                low.append(s)
            of, g, i, mine = np.array(which), np.concatenate(group), np.concatenate(ids), np.concatenate(low)
            least = np.full(len(number), np.iinfo(np.int64).max)
            np.minimum.at(least, of, mine)
            flat, count = smallest_sources(list(number), least, span)
            at = np.cumsum(count) - count
            answered = np.flatnonzero(np.minimum.reduceat(flat, at)[of] < mine)
            cut = np.flatnonzero(np.append(True, g[answered][1:] != g[answered][:-1])) if len(answered) else []
            for s, e in zip(cut, [*cut[1:], len(answered)], strict=True) if len(answered) else ():
                some = answered[s:e]
                values = flat[expand(at[of[some]], count[of[some]])]
                yield pa.RecordBatch.from_arrays([pa.array([int(g[some[0]])], pa.int64()), pa.array([i[some].astype("<i4").tobytes()]), pa.array([count[of[some]].astype("<i4").tobytes()]), pa.array([values.astype("<i8").tobytes()])], names=["grp", "ids", "counts", "least"])

        for batch in batches:
            for part, *rest in zip(*(batch.column(n).to_pylist() for n in ("part", "grp", "ids", "starts", "lengths", "data")), strict=True):
                if part != now:
                    yield from out()
                    held, now = [], part
                held.append(tuple(rest))
        yield from out()

    rows = runs.filter("part >= 0").select("part", "grp", "ids", "starts", "lengths", "data")
    return rows.repartition("part").sortWithinPartitions("part").mapInArrow(run, "grp long, ids binary, counts binary, least binary")


def _ranges(runs: DataFrame, sources: DataFrame, span: int) -> DataFrame:
    """(key, tag, removed): by document, the removed byte ranges as pairs of longs."""

    def run(mine: pa.Table, answers: pa.Table) -> pa.Table:
        ids = [np.frombuffer(x, "<i4") for x in mine.column("ids").to_pylist()]
        count = [np.frombuffer(x, "<i4").astype(np.int64) for x in mine.column("lengths").to_pylist()]
        who = mine.column("key").to_numpy()
        size = 1 + max(int(x.max()) for x in ids)
        number = np.zeros(size, np.int64)
        for i, n in zip(ids, count, strict=True):
            number[i] = n
        at = np.cumsum(number) - number
        least = np.full(size, np.iinfo(np.int64).max)
        for i, d in zip(ids, who, strict=True):
            np.minimum.at(least, i, d)
        flat = np.repeat(least, number)
        for i, n, v in zip(*(answers.column(c).to_pylist() for c in ("ids", "counts", "least")), strict=True):
            i, n = np.frombuffer(i, "<i4"), np.frombuffer(n, "<i4").astype(np.int64)
            flat[expand(at[i], n)] = np.frombuffer(v, "<i8")
        keys, tags, removed = [], [], []
        for d, tag, i, n, s in zip(who.tolist(), mine.column("tag").to_pylist(), ids, count, mine.column("starts").to_pylist(), strict=True):
            start = np.sort(expand(np.frombuffer(s, "<i4").astype(np.int64), n)[flat[expand(at[i], n)] < d])
            if len(start):
                new = np.flatnonzero(np.append(True, start[1:] > start[:-1] + span))
                keys.append(d)
                tags.append(tag)
                removed.append(np.stack([start[new], np.append(start[new[1:] - 1], start[-1]) + span], 1).astype("<i8").tobytes())
        return pa.table([pa.array(keys, pa.int64()), pa.array(tags, pa.int64()), pa.array(removed, pa.binary())], names=["key", "tag", "removed"])

    mine = runs.filter("part < 0").select("grp", "key", "tag", "ids", "starts", "lengths")
    return mine.groupBy("grp").cogroup(sources.groupBy("grp")).applyInArrow(run, "key long, tag long, removed binary")


def removed_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(key, tag, removed): documents with removed bytes, by key and xxhash64 of the text, and their ranges [start, end) as packed longs."""
    spark = docs.sparkSession
    rows = docs.filter(F.col(key).isNotNull() & (F.octet_length(text) >= span)).select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"), F.xxhash64(text).alias("tag"))
    number, total = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART))
    copies = written(_copies(rows), "copies")
    by_doc = written(_shared_anchors(rows, parts, span).groupBy("key").agg(F.collect_list("anchors").alias("shared")).join(copies.groupBy("key").agg(F.collect_set("tag").alias("whole")), "key", "left"), "anchors")
    release(spark)
    hot = spark.sparkContext.broadcast(_hot(by_doc, number))
    runs = written(_candidates(rows, by_doc, hot, parts, span), "runs")
    discard(by_doc)
    release(spark)
    whole = copies.select("key", "tag", F.concat(_long(F.lit(0)), _long("n")).alias("removed"))
    found = written(_ranges(runs, _sources(runs, span), span).unionByName(whole).dropDuplicates(["key", "tag"]), "removed")
    discard(copies, runs)
    release(spark)
    return found


def _copies(rows: DataFrame) -> DataFrame:
    """(key, tag, n): texts of n bytes that a smaller key has too, by SHA-256. Only digests move.

    The groups are written before they meet the rows, so that Spark can split the rows of a digest that many share.
    """
    own = rows.select("key", "tag", F.octet_length("text").cast("long").alias("n"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    least = written(own.groupBy("sha").agg(F.min("key").alias("least"), F.max("key").alias("most")).filter("least < most").select("sha", "least"), "groups")
    return own.join(least, "sha").filter("key > least").select("key", "tag", "n").distinct()


def _long(n) -> Column:
    """A long's bytes, least first."""
    n = F.col(n) if isinstance(n, str) else n
    return F.unhex(F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(n.cast("long"), 8 * i).bitwiseAND(255)), 2, "0") for i in range(8)]))


def _kept(raw: memoryview, packed: bytes | None) -> tuple[list[memoryview], int, int]:
    """The remaining pieces, the bytes removed and the number of maximal runs."""
    if not packed:
        return [raw], 0, 0
    pieces, at, gone = [], 0, 0
    ranges = np.frombuffer(packed, "<i8").reshape(-1, 2).tolist()
    for s, e in ranges:
        pieces.append(raw[at:s])
        gone += e - s
        at = e
    return [*pieces, raw[at:]], gone, len(ranges)


def digests(docs: DataFrame, span: int = SPAN) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            rows = []
            for t, packed in zip(batch.column("text"), batch.column("removed").to_pylist(), strict=True):
                raw = memoryview((t.as_py() or "").encode())
                pieces, gone, n = _kept(raw, packed)
                h = hashlib.sha256()
                for p in pieces:
                    h.update(p)
                rows.append((len(raw), gone, n, h.hexdigest()))
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    found = removed_ranges(docs, span=span).withColumnRenamed("key", "doc_id")
    return docs.select("doc_id", "text", F.xxhash64("text").alias("tag")).join(found, ["doc_id", "tag"], "left").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """docs, all columns, without the removed bytes (characters that lose bytes go whole); texts left empty go, and n_chars follows the text if it is there."""
    at, columns = docs.columns.index(text), docs.columns
    counted = columns.index("n_chars") if "n_chars" in columns else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            texts, keep = batch.column(at).to_pylist(), []
            removed = batch.column(len(columns)).to_pylist()
            for i, packed in enumerate(removed):
                if packed:
                    texts[i] = b"".join(_kept(memoryview(texts[i].encode()), packed)[0]).decode(errors="ignore")
                keep.append(not packed or bool(texts[i].strip()))
            out = list(batch.columns[: len(columns)])
            out[at] = pa.array(texts, pa.string())
            if counted >= 0:
                out[counted] = pa.array([None if t is None else len(t) for t in texts], batch.column(counted).type)
            yield pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep, pa.bool_()))

    found = removed_ranges(docs, key, text, span).select(F.col("key").alias("__key"), F.col("tag").alias("__tag"), F.col("removed").alias("__removed"))
    joined = docs.join(found, (docs[key] == F.col("__key")) & (F.xxhash64(docs[text]) == F.col("__tag")), "left").select(*[docs[c] for c in columns], "__removed")
    return joined.mapInArrow(run, docs.schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
