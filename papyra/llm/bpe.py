"""Byte-level BPE over length-bucketed numpy matrices.

Texts are cut by the tokenizer's pattern with array operations on code points, equal pieces of a block are encoded once,
and the pieces of one length form one matrix. Every round finds each row's leftmost pair of minimum rank through a hashed
pair table, merges it, and drops the rows that have no pair left.

Defined results: a null or empty text has no tokens (hash of the empty string twice); long texts are encoded in pieces
cut where a token always ends, so the encoder's work space does not grow with the text (the text itself is held whole); repeated rows give repeated results; other columns
of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from papyra.llm.common import blocks, caches, expand, table, tidy

OTHER, LETTER, NUMBER, SPACE, END = range(5)
NONE = np.int32(2**31 - 1)
BLOCK_CHARS = 1 << 20
MATRIX_WIDTH = 128
CACHE = 1 << 19
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def _classes() -> np.ndarray:
    kind = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kind.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
    out[_WHITE] = SPACE
    return np.append(out, np.uint8(END))


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
        self.classes = _classes()
        size = max(self.ranks.values()) + 1
        self.byte_rank = np.zeros(256, np.int32)
        for b in range(256):
            self.byte_rank[b] = self.ranks[bytes([b])]
        pieces = [b""] * size
        for k, v in self.ranks.items():
            pieces[v] = k
        self.pieces = pieces
        self.piece_len = np.array([len(p) for p in pieces], np.int64)
        self.piece_at = np.concatenate([[0], np.cumsum(self.piece_len)[:-1]])
        self.piece_bytes = np.frombuffer(b"".join(pieces), np.uint8)
        self._build_pairs()
        rng = np.random.default_rng(7)
        self.byte_value = rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
        self.powers = np.zeros(0, np.uint64)
        self._forget()

    def _forget(self) -> None:
        """The short pieces that earlier blocks held, by hash: sorted keys, counts, offsets and flat ids. At most CACHE pieces."""
        self.seen, self.seen_n, self.seen_at, self.seen_ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _remember(self, keys: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        if len(self.seen) + len(keys) > CACHE:
            self._forget()
        order = np.argsort(all_keys := np.append(self.seen, keys), kind="stable")
        at = np.append(self.seen_at, len(self.seen_ids) + np.cumsum(counts) - counts)
        self.seen, self.seen_n, self.seen_at, self.seen_ids = all_keys[order], np.append(self.seen_n, counts)[order], at[order], np.append(self.seen_ids, ids)

    # -- hashed pair lookup

    def _build_pairs(self) -> None:
        keys, values = [], []
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        self.bits = max(4, (len(keys) * 4).bit_length())
        size = 1 << self.bits
        self.slots, self.merged = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        left_k, left_v = np.array(keys, np.int64), np.array(values, np.int32)
        at = self._slot(left_k)
        while len(left_k):
            free = self.slots[at] == -1
            at_free, first = np.unique(at[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.slots[at_free], self.merged[at_free] = left_k[take], left_v[take]
            keep = np.ones(len(left_k), bool)
            keep[take] = False
            left_k, left_v, at = left_k[keep], left_v[keep], (at[keep] + 1) & (size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that merging each (a, b) gives, or NONE."""
        keys = (a.astype(np.int64) << 32) | b
        at = self._slot(keys)
        found = self.slots[at]
        out = np.where(found == keys, self.merged[at], NONE)
        open_ = np.flatnonzero((found != keys) & (found != -1))
        while len(open_):
            at_open = (at[open_] + 1) & (len(self.slots) - 1)
            at[open_] = at_open
            found = self.slots[at_open]
            hit = found == keys[open_]
            out[open_[hit]] = self.merged[at_open[hit]]
            open_ = open_[~hit & (found != -1)]
        return out

    # -- merging

    def merge_rows(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids: one row of byte ranks for each piece, all of one length. Returns the flat ids and the count of each row."""
        n, width = ids.shape
        final, counts = ids.copy(), np.full(n, width, np.int64)
        rows = np.arange(n)
        ranks = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(n, width - 1)
        while len(rows) and width > 1:
            at = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), at]
            done = best == NONE
            if done.any():
                final[rows[done], :width], counts[rows[done]] = ids[done], width
                keep = ~done
                rows, ids, ranks, at, best = rows[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not len(rows):
                    break
            r, cols = np.arange(len(rows)), np.arange(width - 1)
            ids = np.take_along_axis(ids, cols + (cols > at[:, None]), 1)
            ids[r, at] = best
            width -= 1
            cols = np.arange(width - 1)
            if width > 1:
                ranks = np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
                left, right = at > 0, at < width - 1
                ranks[r[left], at[left] - 1] = self.pair_ranks(ids[r[left], at[left] - 1], best[left])
                ranks[r[right], at[right]] = self.pair_ranks(best[right], ids[r[right], at[right] + 1])
        final[rows, :width], counts[rows] = ids[:, :width], width
        return final[np.arange(final.shape[1]) < counts[:, None]], counts

    def merge_long(self, piece: bytes) -> list[int]:
        """One long piece: the same merges in the same order, with a heap and links instead of a wide matrix."""
        ids = [int(self.byte_rank[b]) for b in piece]
        n = len(ids)
        nxt, prev = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = bytearray(b"\1" * n)
        rank = lambda a, b: self.ranks.get(self.pieces[a] + self.pieces[b])
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i], alive[j], nxt[i] = r, 0, nxt[j]
            if nxt[j] < n:
                prev[nxt[j]] = i
            for left, right in ((prev[i], i), (i, nxt[i])):
                if left >= 0 and right < n and (k := rank(ids[left], ids[right])) is not None:
                    heapq.heappush(heap, (k, left, ids[left], ids[right]))
        return [x for x, y in zip(ids, alive, strict=True) if y]

    # -- cutting

    def token_starts(self, code: np.ndarray) -> np.ndarray:
        """code: code points of texts, each followed by an end mark. True where a piece starts."""
        c = self.classes[code]
        start = np.empty(len(c), bool)
        start[0], start[1:] = True, c[1:] != c[:-1]
        last = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & (c[1:] != END))
        start[last] = True
        start[last[code[last] == 32] + 1] = False
        quote = np.flatnonzero((code[:-1] == 39) & start[:-1] & (c[1:] == LETTER))
        if len(quote):
            padded = np.append(code, [0, 0])
            one, two = padded[quote + 1], padded[quote + 2]
            short = np.isin(one, [ord(x) for x in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            length = np.where(short, 1, np.where(long, 2, 0))
            quote, length = quote[length > 0], length[length > 0]
            start[quote + 1] = False
            start[quote + 1 + length] = True
        start[c == END] = False
        return start

    def _power(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.powers) < n:
            base = 0x9E3779B97F4A7C15
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)))
            self.inverse = np.cumprod(np.append(np.uint64(1), np.full(n, pow(base, -1, 1 << 64), np.uint64)))
        return self.powers, self.inverse

    def encode_block(self, texts: list[str], exact: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts one after the other, and each text's count.

        Equal pieces are found by hash. Every piece's ids are decoded and compared with its bytes; if hashes ever collide, the
        block is encoded again with pieces told apart by their bytes (exact)."""
        code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        code = np.insert(code, np.cumsum(lengths), np.uint32(sys.maxunicode + 1))
        starts = np.flatnonzero(self.token_starts(code))
        if not len(starts):
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
        width[code > sys.maxunicode] = 0
        at = np.append(0, np.cumsum(width))
        data = "".join(texts).encode()
        raw = np.frombuffer(data, np.uint8)
        begin, end = at[starts], np.append(at[starts[1:]], len(data))
        powers, inverse = self._power(len(data))
        prefix = np.append(np.uint64(0), np.cumsum(self.byte_value[raw] * powers[: len(data)]))
        key = (prefix[end] - prefix[begin]) * inverse[begin]
        wide: dict[bytes, int] = {}
        for i in np.flatnonzero((end - begin > 64) | exact):  # long pieces are told apart by their bytes
            key[i] = wide.setdefault(data[begin[i] : end[i]], len(wide))
        key, first, which = np.unique(key, return_index=True, return_inverse=True)
        short = (end[first] - begin[first] <= 64) & (not exact)
        at_seen = np.searchsorted(self.seen, key)
        old = short & (at_seen < len(self.seen))
        old[old] = self.seen[at_seen[old]] == key[old]
        ids, new_counts = self._encode_pieces(data, raw, begin[first[~old]], end[first[~old]])
        new_of = np.cumsum(new_counts) - new_counts
        counts, of = np.empty(len(key), np.int64), np.empty(len(key), np.int64)
        counts[~old], of[~old] = new_counts, new_of + len(self.seen_ids)
        counts[old], of[old] = self.seen_n[at_seen[old]], self.seen_at[at_seen[old]]
        per_token = counts[which]
        flat = np.append(self.seen_ids, ids)[expand(of[which], per_token)]
        taken = np.append(0, np.cumsum(self.piece_len[flat]))[np.append(0, np.cumsum(per_token))]
        if not exact and not (np.array_equal(taken[1:], end) and self.decode(flat) == data):
            return self.encode_block(texts, True)
        keep = short[~old]
        self._remember(key[~old][keep], new_counts[keep], ids[expand(new_of[keep], new_counts[keep])])
        bounds = np.searchsorted(starts, np.append(0, np.cumsum(lengths + 1)))
        totals = np.append(0, np.cumsum(per_token))
        return flat, np.diff(totals[bounds])

    def _encode_pieces(self, data: bytes, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        get = self.ranks.get
        whole = np.fromiter((get(data[s:e], -1) for s, e in zip(begin.tolist(), end.tolist(), strict=True)), np.int64, len(begin))
        counts = np.ones(len(begin), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        open_ = np.flatnonzero(whole < 0)
        length = (end - begin)[open_]
        for n in np.unique(length):
            rows = open_[length == n]
            if n > MATRIX_WIDTH:
                for r in rows:
                    got = np.array(self.merge_long(data[begin[r] : end[r]]), np.int64)
                    counts[r] = len(got)
                    parts.append((np.array([r]), got))
                continue
            for cut in range(0, len(rows), 1 << 15):
                some = rows[cut : cut + (1 << 15)]
                flat, c = self.merge_rows(self.byte_rank[raw[begin[some][:, None] + np.arange(n)]])
                counts[some] = c
                parts.append((some, flat))
        of = np.concatenate([[0], np.cumsum(counts)[:-1]])
        ids = np.empty(int(counts.sum()), np.int64)
        known = whole >= 0
        ids[of[known]] = whole[known]
        for rows, flat in parts:
            ids[expand(of[rows], counts[rows])] = flat
        return ids, counts

    def decode(self, ids: np.ndarray) -> bytes:
        return self.piece_bytes[expand(self.piece_at[ids], self.piece_len[ids])].tobytes()


def cut_text(text: str) -> Iterator[str]:
    """Pieces of about BLOCK_CHARS; cuts stand before white space that follows other text, where a token always ends."""
    start = 0
    while len(text) - start > 2 * BLOCK_CHARS:
        at = start + BLOCK_CHARS
        while at < len(text) and not (ord(text[at]) in _WHITE_SET and ord(text[at - 1]) not in _WHITE_SET):
            at += 1
        yield text[start:at]
        start = at
    yield text[start:]


_WHITE_SET = frozenset(_WHITE)
_codecs: dict[str, Codec] = {}
caches.append(_codecs)


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encode_texts(texts: list[str | None], path: str) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(row, arrays of ids) for each text, in order."""
    c = codec(path)
    cut = [(i, p) for i, t in enumerate(texts) for p in cut_text(t or "")]
    held: list[np.ndarray] = []
    for a, b in blocks([len(p) + 1 for _, p in cut], BLOCK_CHARS):
        flat, counts = c.encode_block([p for _, p in cut[a:b]])
        ends = np.cumsum(counts)
        for k, (e, n) in enumerate(zip(ends.tolist(), counts.tolist(), strict=True), a):
            held.append(flat[e - n : e])
            if k + 1 == len(cut) or cut[k + 1][0] != cut[k][0]:
                yield cut[k][0], held
                held = []


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds ids, the tokens of each text, and with decoded, the text decoded again (undecodable bytes: replacement marks)."""
    from pyspark.sql import types as T

    schema = T.StructType([f for f in docs.schema if f.name not in (ids, decoded)])
    names = list(schema.names)
    schema = schema.add(ids, T.ArrayType(T.IntegerType()))
    if decoded:
        schema = schema.add(decoded, T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            got = [np.concatenate(x) for _, x in encode_texts(batch.column(text).to_pylist(), path)]
            columns = [batch.column(n) for n in names] + [pa.array([x.astype(np.int32) for x in got], pa.list_(pa.int32()))]
            if decoded:
                columns.append(pa.array([codec(path).decode(x).decode(errors="replace") for x in got], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: see the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        c = codec(path)
        for batch in batches:
            n, of_ids, of_text = [], [], []
            for _, arrays in encode_texts(batch.column("text").to_pylist(), path):
                h, d, total = hashlib.sha256(), hashlib.sha256(), 0
                for x in arrays:
                    h.update(x.astype("<u4").tobytes())
                    d.update(c.decode(x))
                    total += len(x)
                n.append(total)
                of_ids.append(h.hexdigest())
                of_text.append(d.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary())
