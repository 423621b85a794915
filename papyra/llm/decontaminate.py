"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

Words are the ASCII-lower-cased runs of letters, digits and non-ASCII characters. The automaton of all items' word numbers
is streamed over each document; the state and the longest matching length tell at every word which windows end there. Only
runs of words that occur in some item are streamed: any other word resets the automaton.

Items are a stated query set, and every document is run against all of it. Its size is measured first. Up to ITEM_BYTES it is
broadcast whole, its automata built in blocks of BLOCK_WORDS words and then kept as flat arrays, once in each worker process;
a larger set is dealt into parts of about that size, one pass over the documents each, with what was found so far written in
between. So neither the driver nor a worker ever holds more than a part, however long the benchmark is.

Defined results: null or empty texts have no words and no hits; items without words have no windows; repeated items all
count; an item without id has windows, whose words are hit, but is not listed or counted among the items; rows that repeat a
document are judged one by one; without documents there are no rows, without items no hits.
"""

from __future__ import annotations

import hashlib
import string
import uuid
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from papyra.llm.common import caches, table, tidy, written

WINDOW = 10
BLOCK_WORDS = 200_000
#: Of items in one pass: what is collected and broadcast at once.
ITEM_BYTES = 16 << 20
#: A document whose hit words exceed this share is dropped whole by `clean`; below it the hit words' spans are cut out.
MAX_COVERAGE = 0.5
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


class Automaton:
    """Suffix automaton of several word sequences, in flat arrays: transitions as sorted (state, word) keys with their targets;
    for states that hold a window, the items in which it occurs."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.names = [item for item, _ in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = array("i", [-1]), array("i", [0])
        last: list[tuple[int, int, int]] = []
        starts: dict[int, list[int]] = {}
        for number, (_, sequence) in enumerate(items):
            state = 0
            for i, w in enumerate(sequence, 1):
                state = self._extend(state, self.vocab.setdefault(w, len(self.vocab)))
                if i >= window:
                    starts.setdefault(state, []).append(number)
            if sequence and len(sequence) < window:
                last.append((state, number, len(sequence)))
        self._hold(starts)
        # whole items shorter than a window: the state in which they end, and for each state its nearest suffix of that kind
        self.short: dict[int, dict[int, set[int]]] = {}
        for state, number, n in last:
            self.short.setdefault(state, {}).setdefault(n, set()).add(number)
        self.up = array("i", [-1]) * len(self.link)
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__) if last else ():
            p = self.link[s]
            self.up[s] = p if p in self.short else self.up[p] if p >= 0 else -1
        self.shortest = min([window, *(n for _, _, n in last)])
        self._freeze()

    def _hold(self, starts: dict[int, list[int]]) -> None:
        """held[at[s]:at[s + 1]]: the items under s, for the states whose strings of a window's length occur there."""
        of: dict[int, set[int]] = {s: set(x) for s, x in starts.items()}
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if s in of and self.length[p := self.link[s]] >= self.window:
                of.setdefault(p, set()).update(of.pop(s))
        self.at, self.held = array("i", [0]), array("i")
        for s in range(len(self.link)):
            self.held.extend(sorted(of.get(s, ())))
            self.at.append(len(self.held))

    def _freeze(self) -> None:
        """Dictionaries of transitions become two arrays; a key is the state above the word's 32 bits."""
        n = np.fromiter(map(len, self.next), np.int64, len(self.next))
        keys = np.fromiter((w for d in self.next for w in d), np.int64, int(n.sum())) | np.repeat(np.arange(len(n)) << 32, n)
        to = np.fromiter((t for d in self.next for t in d.values()), np.int32, len(keys))
        order = np.argsort(keys)
        self.keys, self.to = array("q", keys[order].tobytes()), array("i", to[order].tobytes())
        del self.next

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            q = self.next[last][w]
            return q if self.length[last] + 1 == self.length[q] else self._clone(last, w, q)
        cur = self._state(self.length[last] + 1, {})
        p = last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[cur] = q if self.length[p] + 1 == self.length[q] else self._clone(p, w, q)
        else:
            self.link[cur] = 0
        return cur

    def _state(self, length: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _clone(self, p: int, w: int, q: int) -> int:
        c = self._state(self.length[p] + 1, dict(self.next[q]))
        self.link[c], self.link[q] = self.link[q], c
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = c
            p = self.link[p]
        return c

    def scan(self, tokens: list[bytes], spans: list[tuple[int, int]], found: set) -> None:
        """Adds the spans [start, end) of the windows that occur in tokens, and the items that hold them."""
        if len(tokens) < self.shortest or not self.vocab:
            return
        get = self.vocab.get
        ids = np.fromiter((get(t, -1) for t in tokens), np.int64, len(tokens))
        known = np.concatenate([[False], ids >= 0, [False]])
        edges = np.flatnonzero(known[1:] != known[:-1])
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start >= self.shortest:
                self._stream(ids[start:end].tolist(), start, spans, found)

    def _stream(self, ids: list[int], base: int, spans: list[tuple[int, int]], found: set) -> None:
        state = matched = 0
        keys, to, link, length, w, end = self.keys, self.to, self.link, self.length, self.window, len(self.keys)
        for i, x in enumerate(ids, base + 1):
            while True:
                key = state << 32 | x
                j = bisect_left(keys, key)
                if j < end and keys[j] == key:
                    state = to[j]
                    matched += 1
                    break
                if not state:
                    break
                state = link[state]
                matched = length[state]
            if matched >= w:
                while length[link[state]] >= w:  # the matched string is now its suffix of at least a window
                    state = link[state]
                    matched = length[state]
                spans.append((i - w, i))
                found.update(self.names[n] for n in self.held[self.at[state] : self.at[state + 1]])
            if self.short:
                s = state if state in self.short else self.up[state]
                while s > 0:
                    for n, of in self.short[s].items():
                        if n <= matched:
                            spans.append((i - n, i))
                            found.update(self.names[k] for k in of)
                    s = self.up[s]


class Scanner:
    """The automata of all blocks of items."""

    def __init__(self, rows: list[tuple[object, str | None]], window: int = WINDOW):
        self.automata, block, size = [], [], 0
        for item, text in rows:
            w = words(text)
            if block and size + len(w) > BLOCK_WORDS:
                self.automata.append(Automaton(block, window))
                block, size = [], 0
            block.append((item, w))
            size += len(w)
        self.automata.append(Automaton(block, window))

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Maximal hit runs of words, and the items found."""
        spans: list[tuple[int, int]] = []
        found: set = set()
        for a in self.automata:
            a.scan(tokens, spans, found)
        found.discard(None)
        return merged(spans), found


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


_held: dict[tuple[str, int], Scanner] = {}
caches.append(_held)


def _scanner(token: str, shared: Broadcast, window: int) -> Scanner:
    """The scanner of a set of items, built once in a process; only the latest is kept."""
    if (token, window) not in _held:
        _held.clear()
        _held[token, window] = Scanner(shared.value, window)
    return _held[token, window]


_FOUND = (("__spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("__items", pa.list_(pa.string())))


def _scan(docs: DataFrame, items: DataFrame, text: str, window: int, item_bytes: int, finish, schema) -> DataFrame:
    """finish(batch, words of each text, hit runs, items as strings) over docs' batches, after as many passes as the items need."""
    rows = items.select("item_id", "text")
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)).first()[0] or 0
    parts = max(1, -(-total // item_bytes))
    width, at = len(docs.columns), docs.columns.index(text)

    def looked(batch: pa.RecordBatch, scanner: Scanner) -> tuple[list[int], list, list[set]]:
        counts, spans, found = [], [], []
        before = [c.to_pylist() for c in batch.columns[width:]] or [[()] * batch.num_rows] * 2
        for t, old, seen in zip(batch.column(at).to_pylist(), *before, strict=True):
            tokens = words(t)
            more, of = scanner.scan(tokens)
            counts.append(len(tokens))
            spans.append(merged([(x["start"], x["end"]) for x in old] + more) if old else more)
            found.append({*map(str, of), *seen})
        return counts, spans, found

    def one_pass(mine: DataFrame, last: bool):
        token, shared = uuid.uuid4().hex, mine.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tidy()
            scanner = _scanner(token, shared, window)
            for batch in batches:
                counts, spans, found = looked(batch, scanner)
                own = pa.RecordBatch.from_arrays(batch.columns[:width], names=batch.schema.names[:width])
                if last:
                    yield finish(own, counts, spans, found)
                else:
                    rest = [pa.array(c, k) for c, (_, k) in zip(([[{"start": s, "end": e} for s, e in x] for x in spans], [sorted(x) for x in found]), _FOUND, strict=True)]
                    yield pa.RecordBatch.from_arrays([*own.columns, *rest], names=[*own.schema.names, *(n for n, _ in _FOUND)])

        return run

    scanned = docs
    between = T.StructType([*docs.schema.fields, T.StructField("__spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("__items", T.ArrayType(T.StringType()))])
    for part in range(parts):
        mine = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        last = part == parts - 1
        scanned = scanned.mapInArrow(one_pass(mine, last), schema if last else between)
        scanned = scanned if last else written(scanned, "scanned")
    return scanned


def report(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans (word ranges [start, end) that were hit)."""

    def finish(batch: pa.RecordBatch, counts: list[int], spans: list, found: list[set]) -> pa.RecordBatch:
        hit = [sum(e - s for s, e in x) for x in spans]
        said = [hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in found]
        columns = (counts, hit, list(map(len, found)), said, [n > 0 for n in hit], [[{"start": s, "end": e} for s, e in x] for x in spans])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), _FOUND[0][1])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return _scan(docs.select("doc_id", "text"), items, "text", window, item_bytes, finish, schema)


def remove_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the bytes from the first to the last character of each span of words."""
    raw = text.encode()
    plain = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate([[0], plain.view(np.int8), [0]])))
    starts, ends = edges[::2], edges[1::2]
    out, at = [], 0
    for s, e in spans:
        out.append(raw[at : starts[s]])
        at = ends[e - 1]
    return (b"".join(out) + raw[at:]).decode()


def clean(docs: DataFrame, items: DataFrame, text: str = "text", window: int = WINDOW, max_coverage: float = MAX_COVERAGE, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """docs, all columns, without the hit spans; documents of which more than max_coverage is hit are dropped."""
    at = docs.columns.index(text)

    def finish(batch: pa.RecordBatch, counts: list[int], spans: list, found: list[set]) -> pa.RecordBatch:
        texts, keep = batch.column(at).to_pylist(), []
        for i, (n, x) in enumerate(zip(counts, spans, strict=True)):
            keep.append(sum(e - s for s, e in x) <= max_coverage * n)
            if x and keep[-1]:
                texts[i] = remove_words(texts[i], x)
        columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return _scan(docs, items, text, window, item_bytes, finish, docs.schema)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH tokens AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
cut AS (SELECT item_id, w, least(len(w), {WINDOW}) AS n, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS gram FROM cut),
placed AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM tokens),
spots AS (SELECT r, i, word, {", ".join(f"lead(word, {j}) OVER o AS w{j}" for j in range(1, WINDOW))} FROM placed WINDOW o AS (PARTITION BY r ORDER BY i)),
grams AS ({" UNION ALL ".join(f"SELECT r, i, {n} AS n, word{''.join(f" || ' ' || w{j}" for j in range(1, n))} AS gram FROM spots" for n in range(1, WINDOW + 1))}),
hits AS (SELECT r, item_id, i, n FROM grams JOIN windows USING (n, gram)),
words_hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
found AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM tokens LEFT JOIN words_hit USING (r) LEFT JOIN found USING (r)
"""
