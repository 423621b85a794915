"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has bit b where more than half of its word shingles' hashes have it. The 64 bits are cut into SEGMENTS
on a ring. If two fingerprints differ in at most DISTANCE bits, then from some segment on every chain of l consecutive
segments differs in at most l * DISTANCE / SEGMENTS bits (the pigeonring principle). A chain of five segments of seven may
then differ in at most 0, 1, 1, 2, 2 bits, so at least three of its segments are equal, in one of five patterns for each
start: these 35 patterns are the join keys, and the chain condition prunes what meets under a key before the full Hamming
check. Keys hold 27 or 28 bits, so unrelated fingerprints rarely meet.

Rows meet as distinct fingerprints, not as documents, so exact copies cost one row. Pairs are never emitted: within a key,
a breadth-first search links each member to the tree it falls in, and at most members - 1 edges leave. Above HOT members a
key's fingerprints are cut into blocks and each pair of blocks is searched by a task of its own. Components follow
in one worker for up to graph.LOCAL edges; above that, rounds on tables contract the edges first.

Defined results: null, empty and blank texts have the fingerprint zero, linked like any other; texts of fewer than four
words are one shingle; ties in the bit vote leave the bit unset; a component is named by its smallest doc_id
(null where no member has one); rows that repeat a doc_id are judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import resemblance
from papyra.llm.common import table, tidy, written
from papyra.llm.graph import components

SHINGLE = 4
DISTANCE = 4
SEGMENTS = 7
HOT = 4096
_EDGES = [64 * i // SEGMENTS for i in range(SEGMENTS + 1)]
MASKS = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(_EDGES, _EDGES[1:], strict=False)]
#: The segments that stay equal in a chain of five with budgets 0, 1, 1, 2, 2.
PATTERNS = sorted({tuple(sorted((s + k) % SEGMENTS for k in kept)) for s in range(SEGMENTS) for kept in ((0, 1, 2), (0, 1, 3), (0, 1, 4), (0, 2, 3), (0, 2, 4))})


def fingerprints_of(texts: list[str | None], shingle: int = SHINGLE) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    hashes: list[int] = []
    owner: list[int] = []
    count: list[int] = []

    def flush() -> None:
        if hashes:
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.cumsum([0, *count[:-1]])
            votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            np.add.at(total, owner, votes)
            hashes.clear()
            owner.clear()
            count.clear()

    total = np.zeros((len(texts), 64), np.int64)
    n = np.zeros(len(texts), np.int64)
    digest = xxhash.xxh64_intdigest
    for i, text in enumerate(texts):
        w = (text or "").encode().lower().split()
        if not w:
            continue
        k = min(shingle, len(w))
        for a in range(0, len(w) - k + 1, 1 << 16):
            part = w[a : a + (1 << 16) + k - 1]
            got = [digest(b" ".join(x), 42) for x in zip(*(part[j:] for j in range(k)), strict=False)]
            hashes += got
            owner.append(i)
            count.append(len(got))
            n[i] += len(got)
            if len(hashes) > 1 << 17:
                flush()
    flush()
    on = 2 * total > n[:, None]
    out[:] = np.packbits(on, axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp): fp is the fingerprint as a signed long."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            fp = fingerprints_of(batch.column(text).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(fp.view(np.int64))], names=[key, "fp"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, fp long")


def chain_holds(x: np.ndarray) -> np.ndarray:
    """x: XORs of fingerprints. True where some chain of all segments keeps within its budgets at every length."""
    d = np.stack([np.bitwise_count(x & np.uint64(m)).astype(np.int64) for m in MASKS])
    ok = np.zeros(x.shape, bool)
    for s in range(SEGMENTS):
        cumulative, held = np.zeros(x.shape, np.int64), np.ones(x.shape, bool)
        for length in range(1, SEGMENTS + 1):
            cumulative += d[(s + length - 1) % SEGMENTS]
            held &= cumulative * SEGMENTS <= length * DISTANCE
            if not held.any():
                break
        ok |= held
    return ok


def near(one: np.uint64, many: np.ndarray) -> np.ndarray:
    x = many ^ one
    ok = chain_holds(x)
    ok[ok] = np.bitwise_count(x[ok]) <= DISTANCE
    return ok


def forest(fps: np.ndarray, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of fingerprints within DISTANCE. sides: link only across unlike sides."""
    edges: list[tuple[int, int]] = []
    left = np.ones(len(fps), bool)
    for root in range(len(fps)):
        if not left[root]:
            continue
        left[root] = False
        stack = [root]
        while stack and left.any():
            i = stack.pop()
            others = np.flatnonzero(left if sides is None else left & (sides != sides[i]))
            hit = others[near(fps[i], fps[others])] if len(others) else others
            left[hit] = False
            stack += hit.tolist()
            edges += [(i, j) for j in hit.tolist()]
    return edges


def _keys(fp: Column) -> Column:
    """The pattern's number above the bits that it keeps, hashed into one long."""
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(_signed(sum(MASKS[s] for s in p))))) for i, p in enumerate(PATTERNS)])


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def edges(distinct: DataFrame) -> DataFrame:
    """distinct: table of distinct fp. Edges (a, b) that connect exactly what links within DISTANCE connect."""
    keyed = distinct.select("fp", F.explode(_keys(F.col("fp"))).alias("k"))
    sizes = keyed.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1")
    # a key that only one fingerprint has meets nothing; a hot key is cut into blocks that meet two and two.
    # Spark sizes the keys like the fingerprints, 35 times too low, and would broadcast them: the join is told not to
    met = keyed.join(sizes.hint("merge"), "k")
    cut = F.ceil(F.col("n") / F.lit(HOT)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), cut).cast("int")
    others = F.transform(F.sequence(F.lit(0), cut - 1), lambda j: F.struct(F.least(j, own).alias("x"), F.greatest(j, own).alias("y")))
    placed = met.select("k", "fp", own.alias("side"), F.explode(F.when(cut > 1, others).otherwise(F.array(F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"))))).alias("at"))
    grouped = placed.repartition("k", "at").sortWithinPartitions("k", "at").select("k", "at.x", "at.y", "side", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: list[pa.RecordBatch] = []

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            edge = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(1)) + 1
            for s, e in zip([0, *edge.tolist()], [*edge.tolist(), len(rows)], strict=True):
                fps = rows[s:e, 4].view(np.uint64)
                if e - s == 2:
                    found = [(0, 1)] if np.bitwise_count(fps[0] ^ fps[1]) <= DISTANCE else []
                else:
                    found = forest(np.ascontiguousarray(fps), rows[s:e, 3] if rows[s, 1] != rows[s, 2] else None)
                a += [rows[s + i, 4] for i, _ in found]
                b += [rows[s + j, 4] for _, j in found]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        rest = np.zeros((0, 5), np.int64)
        for batch in batches:
            rows = np.concatenate([rest, np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], 1)])
            if not len(rows):
                continue
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(1))
            cut_at = int(last[-1]) + 1 if len(last) else 0
            if cut_at:
                yield from out(rows[:cut_at])
            rest = rows[cut_at:]
        del held
        if len(rest):
            yield from out(rest)

    return grouped.mapInArrow(run, "a long, b long").filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp, component): the smallest key reachable over links of DISTANCE or fewer bits."""
    own = written(fingerprints(docs, key, text), "fingerprints")
    names = written(own.groupBy("fp").agg(F.min(key).alias("name")), "distinct")
    of = components(edges(names.select("fp")), names)
    return own.join(of, "fp").select(key, "fp", "component")


def candidates(sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of sets (node, fp) that connect what fingerprints within DISTANCE link."""
    heads = written(sets.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    same = sets.join(heads, "fp").filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    one, two = (heads.select(F.col("fp").alias(s), F.col("head").alias(f"h{s}")) for s in "ab")
    far = edges(heads.select("fp")).join(one, "a").join(two, "b").select(F.col("ha").alias("a"), F.col("hb").alias("b"))
    return same.unionByName(far)


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near copies, the one of the smallest key.

    Near copies have a Jaccard similarity of 0.8 or more on five-word shingles. Pigeonring over the fingerprints of these
    shingles proposes pairs; each is verified by exact similarity, and the pairs that no fingerprint shows are completed
    exactly (see resemblance)."""
    return resemblance.representatives(docs, candidates, key, text)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = classes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
