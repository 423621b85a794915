"""Near copies by exact resemblance: texts whose sets of word shingles have a Jaccard similarity of at least 0.8.

Rows meet as distinct sets, so copies cost one row. The caller's candidates (pairs that fingerprints link) are verified first,
by the exact similarity of the whole sets; they settle most near copies, but a fingerprint misses some pairs by chance. The
rest follows from prefix filtering, which misses none: two sets that are so alike share one of the first n - ceil(0.8 n) + 1
members of each, in any order that all sets use. The order puts members that are common in a sample last, which keeps the
groups small and changes no result. Only sets of different classes that meet under such a member are compared: first by
parity maps (map bit h mod B is the parity of the members there, so two maps differ in no more bits than the sets in
members, and pairs that differ in too many cannot be alike), a small one of 512 bits in the join and one as large as the set
after it, then exactly. Whole sets are made again from the texts, for
compared pairs only.

Of a large group, about PIVOTS members at first meet the others: those whose hash is small for the group's size, so none
need be ranked and no task holds a group. Sets that are linked by then need not meet again; the pivots become GROWTH times as
many in each round, until all have met or share a class.

Defined results: words are split at ASCII white space and lower-cased in ASCII; texts of fewer than five words are one
shingle; null, empty and blank texts are copies of one another; classes are transitive and named by their smallest key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import blocks, discard, release, tidy, written
from papyra.llm.graph import components

SHINGLE = 5
#: The similarity is at least ALIKE / OF.
ALIKE, OF = 4, 5
#: The order is learnt from about so many texts; at most COMMON members are put last.
SAMPLE_ROWS = 4000
COMMON = 50_000
#: In groups of at most PIVOTS sets all meet at once; in larger ones about so many meet the others at first.
PIVOTS = 64
GROWTH = 64
#: Longs of the small parity map that goes with each member of a group.
SKETCH = 8
#: Characters of text whose sets a worker holds at once; a longer text stands alone.
BLOCK = 1 << 20


_SKETCH = [f"s{i}" for i in range(SKETCH)]


def members(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles."""
    w = (text or "").encode().lower().split()
    if not w:
        return np.zeros(0, np.int64)
    k, digest = min(shingle, len(w)), xxhash.xxh64_intdigest
    parts = []
    for a in range(0, len(w) - k + 1, 1 << 16):
        part = w[a : a + (1 << 16) + k - 1]
        parts.append(np.unique(np.fromiter((digest(b" ".join(x), 42) for x in zip(*(part[j:] for j in range(k)), strict=False)), np.uint64)))
    return np.unique(np.concatenate(parts).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first members of a set, of which any set that is alike has one among its first. common is sorted; rank orders it."""
    n = len(own)
    size = n - -(-ALIKE * n // OF) + 1 if n else 0
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    last = common[at] == own
    return np.concatenate([own[~last], own[last][np.argsort(rank[at[last]], kind="stable")]])[:size]


def parity(own: np.ndarray) -> bytes:
    """The parity of the members at each of B numbers, B the power of two from 2n on, 64 at least."""
    size = 1 << max(6, (2 * len(own) - 1).bit_length())
    counts = np.bincount(own & (size - 1), minlength=size)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def unlike(a: bytes, b: bytes) -> int:
    """How many members at least are in only one of the sets of these parity maps."""
    x, y = (np.frombuffer(m, np.uint8) for m in ((a, b) if len(a) <= len(b) else (b, a)))
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def sketch(own: np.ndarray) -> np.ndarray:
    """A parity map of 64 * SKETCH bits for a set of any size, as longs."""
    counts = np.bincount(own & (64 * SKETCH - 1), minlength=64 * SKETCH)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").view("<i8")


def _node(own: np.ndarray) -> int:
    """The set's number, as a signed long."""
    n = xxhash.xxh64_intdigest(own.tobytes(), 7)
    return n - (1 << 64) if n >> 63 else n


def _blocks(batch: pa.RecordBatch, of: int) -> Iterator[pa.RecordBatch]:
    """batch in slices of about BLOCK bytes of column of."""
    for a, b in blocks([n or 0 for n in pc.binary_length(batch.column(of)).to_pylist()], BLOCK):
        yield batch.slice(a, b - a)


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(np.concatenate(arrays) if arrays else np.zeros(0, np.int64), pa.int64()))


def fingerprint(own: np.ndarray) -> int:
    """The bits that more than half of the members have, as a signed long."""
    bits = np.zeros(64, np.int64)
    for a in range(0, len(own), 1 << 14):
        bits += np.unpackbits(own[a : a + (1 << 14)].astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(own), bitorder="little").view("<i8")[0])


def shingled(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, node, n, first, map, fp, sketch): the set's number, size, prefix, parity map, fingerprint and small parity map."""
    rate = min(1.0, SAMPLE_ROWS / max(1, docs.count()))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in (part for whole in batches for part in _blocks(whole, 0)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *(members(t) for t in batch.column(0).to_pylist())]))], names=["m"])

    some = docs.filter(F.pmod(F.xxhash64(key, text), F.lit(1_000_000)) < int(rate * 1_000_000)).select(text)
    seen = some.mapInArrow(sample, "m long").groupBy("m").count().filter("count > 2").orderBy(F.desc("count"), "m").limit(COMMON).toArrow()
    common, often = (seen.column(c).to_numpy().astype(np.int64) for c in ("m", "count"))
    order = np.argsort(common)
    shared = docs.sparkSession.sparkContext.broadcast((common[order], often[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        last, rank = shared.value
        for batch in (part for whole in batches for part in _blocks(whole, 1)):
            sets = [members(t) for t in batch.column(1).to_pylist()]
            columns = [batch.column(0), pa.array(list(map(_node, sets)), pa.int64()), pa.array([len(s) for s in sets], pa.int64()), _lists([prefix(s, last, rank) for s in sets]), pa.array([parity(s) for s in sets], pa.binary()), pa.array(list(map(fingerprint, sets)), pa.int64())]
            columns += [pa.array(c, pa.int64()) for c in np.stack([sketch(s) for s in sets]).T] if sets else [pa.array([], pa.int64())] * SKETCH
            yield pa.RecordBatch.from_arrays(columns, names=["key", "node", "n", "first", "map", "fp", *_SKETCH])

    return docs.select(key, text).mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, node long, n long, first array<long>, map binary, fp long, {', '.join(f"{c} long" for c in _SKETCH)}")


def screened(pairs: DataFrame, maps: DataFrame) -> DataFrame:
    """The pairs (a, b) whose parity maps (node, n, map) let them be alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in (part for whole in batches for part in _blocks(whole, 3)):
            n, one, two = (batch.column(c).to_pylist() for c in ("n", "ma", "mb"))
            keep = [(ALIKE + OF) * unlike(x, y) <= (OF - ALIKE) * k for k, x, y in zip(n, one, two, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    one, two = (maps.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("map").alias(f"m{s}")) for s in "ab")
    # a map is longer than Spark takes a binary value to be
    return pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", (F.col("na") + F.col("nb")).alias("n"), "ma", "mb").mapInArrow(run, "a long, b long")


def alike(pairs: DataFrame, names: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs (a, b) whose sets are alike, by the texts of docs (key, text) under the names (node, name); and the written table of sets that they are read from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in (part for whole in batches for part in _blocks(whole, 1)):
            sets = [members(t) for t in batch.column(1).to_pylist()]
            same = pa.array([_node(s) == k for s, k in zip(sets, batch.column(0).to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(sets)], names=["node", "members"]).filter(same)

    wanted = written(names.join(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().hint("merge"), "node", "left_semi").select("node", F.col("name").alias("key")), "wanted")
    made = docs.join(wanted, "key").select("node", "text").mapInArrow(run, "node long, members array<long>")
    used = written(made.dropDuplicates(["node"]), "compared")
    discard(wanted)
    one, two = (used.select(F.col("node").alias(s), F.col("members").alias(f"m{s}")) for s in "ab")
    met = pairs.join(one, "a").join(two, "b").select("a", "b", (F.size("ma") + F.size("mb")).alias("n"), F.size(F.array_intersect("ma", "mb")).alias("both"))
    return met.filter((ALIKE + OF) * F.col("both") >= ALIKE * F.col("n")).select("a", "b"), used


def _merged(of: DataFrame, links: DataFrame) -> DataFrame:
    """of (node, component) after links (a, b) between nodes. Only the classes that links join are worked on."""
    one, two = (of.select(F.col("node").alias(s), F.col("component").alias(f"c{s}")) for s in "ab")
    joined = written(links.join(one, "a").join(two, "b").filter("ca <> cb").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct(), "joined")
    if not joined.limit(1).count():
        return of
    names = joined.select(F.explode(F.array("a", "b")).alias("fp")).distinct().select("fp", F.col("fp").alias("name"))
    to = components(joined, names).select(F.col("fp").alias("component"), F.col("component").alias("to"))
    merged = written(of.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "classes")
    discard(joined)
    return merged


def classes(docs: DataFrame, candidates: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, component): the smallest key reachable over texts that are alike. candidates: pairs (a, b) of nodes to try first, of (node, fp)."""
    own = written(shingled(docs, key, text), "shingles")
    sets = written(own.groupBy("node").agg(F.min("key").alias("name"), *[F.first(c).alias(c) for c in ("n", "first", "map", "fp", *_SKETCH)]), "sets")
    nodes = written(own.select("key", "node"), "nodes")
    discard(own)
    texts = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def linked(of: DataFrame, pairs: DataFrame) -> DataFrame:
        pairs = written(screened(pairs, sets), "pairs")
        if pairs.limit(1).count():
            links, used = alike(pairs, sets, texts)
            before, of = of, _merged(of, links)
            discard(used, *([before] if of is not before else []))
        discard(pairs)
        release(docs.sparkSession)
        return of

    of = linked(sets.select("node", F.col("name").alias("component")), candidates(sets.select("node", "fp")))
    keyed = sets.select("node", "n", *_SKETCH, F.explode("first").alias("k"))
    # Spark sizes exploded rows by their tables, too low by the length of the arrays: these joins are told not to broadcast
    sizes = sets.select(F.explode("first").alias("k")).groupBy("k").agg(F.count("*").alias("size")).filter("size > 1")
    met = written(keyed.join(sizes.hint("merge"), "k").select("k", "node", "n", "size", *_SKETCH), "groups")
    place = F.pmod(F.xxhash64("node"), F.lit(1 << 30)) / F.lit(1 << 30) * F.col("size")
    tried, upto = 0, PIVOTS
    while True:
        placed = met.filter(F.col("size") > tried).join(of, "node")
        several = placed.groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("k")
        live = written(placed.join(several, "k"), "live")
        if not live.limit(1).count():
            break
        pivots = live.filter((place >= tried) & (place < upto)).select("k", F.col("node").alias("p"), F.col("n").alias("pn"), F.col("component").alias("pc"), *[F.col(c).alias(f"p{c}") for c in _SKETCH])
        apart = sum((F.bit_count(F.col(c).bitwiseXOR(F.col(f"p{c}"))) for c in _SKETCH), F.lit(0))
        close = (OF * F.least("n", "pn") >= ALIKE * F.greatest("n", "pn")) & ((ALIKE + OF) * apart <= (OF - ALIKE) * (F.col("n") + F.col("pn")))
        meet = pivots.join(live.hint("merge"), "k").filter((F.col("component") != F.col("pc")) & close)
        of = linked(of, meet.select(F.least("node", "p").alias("a"), F.greatest("node", "p").alias("b")).distinct())
        discard(live)
        tried, upto = upto, upto * GROWTH
    named = written(nodes.join(of, "node").select(F.col("key").alias(key), "component"), "named")
    discard(nodes, sets, met, live, of)
    return named


def representatives(docs: DataFrame, candidates: Callable[[DataFrame], DataFrame], key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without those whose class has a smaller key; rows that repeat a key stay or go together, rows without one stay."""
    dropped = classes(docs.filter(F.col(key).isNotNull()), candidates, key, text).filter(F.col("component") < F.col(key)).select(key).distinct()
    return docs.join(dropped, key, "left_anti").select(docs.columns)
