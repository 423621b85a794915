"""Connected components on tables.

Edges are contracted in rounds until at most LOCAL are left, which one worker then joins up: each node hooks onto its first
neighbour in the order of a hash, if that comes before it, hooks jump once, and edges go on between what they lead to. As the
order is a random one, hooks form short chains and a round leaves about half of the nodes at most. So the number of jobs, each
of which costs the driver plans, generated classes and broadcasts, does not follow the diameter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.llm.common import discard, release, tidy, written

#: Edges that one worker joins up, about 100 bytes of memory each.
LOCAL = 1 << 20


def roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node that each of n nodes reaches over edges a, b."""
    label = np.arange(n)
    while True:
        a, b = label[a], label[b]
        a, b = np.minimum(a, b)[a != b], np.maximum(a, b)[a != b]
        if not len(a):
            return label
        np.minimum.at(label, b, a)
        while (label[label] != label).any():
            label = label[label]


def _contracted(edges: DataFrame, of: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """One round: the edges that are left, and of (fp, c) after it."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("h"), F.col("b").alias("v"))).alias("to"))
    own = F.struct(F.xxhash64("a").alias("h"), F.col("a").alias("v"))
    hooks = written(first.select("a", F.least("to", own)["v"].alias("p")), "hooks")
    to = written(hooks.join(hooks.select(F.col("a").alias("p"), F.col("p").alias("q")), "p").select("a", "q"), "jumped")
    one, two = (to.select(F.col("a").alias(s), F.col("q").alias(f"q{s}")) for s in "ab")
    left = written(edges.join(one, "a").join(two, "b").filter("qa <> qb").select(F.least("qa", "qb").alias("a"), F.greatest("qa", "qb").alias("b")).distinct(), "links")
    now = to.select(F.col("a").alias("c"), "q")
    after = now.select(F.col("c").alias("fp"), F.col("q").alias("c")) if of is None else of.join(now, "c", "left").select("fp", F.coalesce("q", "c").alias("c"))
    after = written(after, "contracted")
    discard(hooks, to, edges, *([] if of is None else [of]))
    release(edges.sparkSession)
    return left, after


def components(links: DataFrame, names: DataFrame) -> DataFrame:
    """names (fp, name): the smallest name that each fp reaches through links (a, b), as (fp, component)."""
    kind = links.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held = [batch for batch in batches if batch.num_rows]
        if held:
            edges = pa.Table.from_batches(held)
            nodes = pa.chunked_array([*edges["a"].chunks, *edges["b"].chunks]).combine_chunks().dictionary_encode()
            at = nodes.indices.to_numpy()
            to = roots(at[: len(edges)], at[len(edges) :], len(nodes.dictionary))
            yield pa.RecordBatch.from_arrays([nodes.dictionary, nodes.dictionary.take(pa.array(to))], names=["fp", "c"])

    edges, of = written(links.select("a", "b"), "links"), None
    release(links.sparkSession)
    while edges.count() > LOCAL:
        edges, of = _contracted(edges, of)
    joined = edges.coalesce(1).mapInArrow(run, f"fp {kind}, c {kind}")
    if of is not None:
        joined = of.join(joined.select(F.col("fp").alias("c"), F.col("c").alias("to")), "c", "left").select("fp", F.coalesce("to", "c").alias("c"))
    # nodes meet by node, not by name: a name may be null or stand for several nodes
    named = written(joined.join(names, "fp").select("fp", "c", "name"), "roots")
    least = named.groupBy("c").agg(F.min("name").alias("least"))
    state = written(named.join(least, "c").select("fp", F.col("least").alias("component")), "labels")
    discard(edges, named, *([] if of is None else [of]))
    return names.join(state, "fp", "left").select("fp", F.coalesce("component", "name").alias("component"))
