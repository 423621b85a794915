"""Groups in Python without a call for each: sorted rows go by in batches of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of text that are worked on at once; a longer text stands alone.
BLOCK = 1 << 20


def together(df: DataFrame, *keys: str) -> DataFrame:
    """df with the rows of each group one after another, keys first."""
    return df.select(*keys, *[c for c in df.columns if c not in keys]).repartition(*keys).sortWithinPartitions(*keys)


def edges(table: pa.Table | pa.RecordBatch, keys: int) -> np.ndarray:
    """Where another group begins than in the row before, by the first columns (numbers); nulls are equal."""
    differs = np.zeros(max(0, table.num_rows - 1), bool)
    for c in table.columns[:keys]:
        for v in (x.to_numpy(zero_copy_only=False) for x in (pc.fill_null(c, 0), pc.is_null(c))):
            differs |= v[1:] != v[:-1]
    return np.flatnonzero(differs) + 1


def whole(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of together(), and where each group begins, with the end."""

    def of(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, np.concatenate([[0], edges(table, keys), [table.num_rows]])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        at = edges(batch, keys)
        if len(at):
            yield of([*held, batch.slice(0, at[-1])])
            held = [batch.slice(at[-1])]
        elif held and len(edges(pa.Table.from_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)]), keys)):
            yield of(held)
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield of(held)


def blocks(batch: pa.RecordBatch, of: str) -> Iterator[pa.RecordBatch]:
    """batch in slices of about BLOCK bytes of a column."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(of)), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(sizes, sizes[a] + BLOCK, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
