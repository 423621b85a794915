"""Documents as pages, lines, words and characters on a fixed grid.

A page has LINES_PER_PAGE lines of a letter-size sheet; a character cell is CELL wide and HEIGHT high; the first line of a
document is set larger. All of these are narrow transformations of the text column: nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyra.operators.groups import blocks

LINES_PER_PAGE, CELL, HEIGHT, LEADING = 40, 6, 12, 14
WIDTH, PAGE_HEIGHT, LEFT, TOP = 612, 792, 72, 720
BODY_FONT, TITLE_FONT = 12, 18


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, page_index, line_index, text, x, y, width, height, font_size)."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_index", "text"))
    return rows.select(
        "doc_id",
        (F.col("line_index") / LINES_PER_PAGE).cast("int").alias("page_index"),
        "line_index",
        "text",
        F.lit(LEFT).alias("x"),
        (TOP - LEADING * (F.col("line_index") % LINES_PER_PAGE)).alias("y"),
        (CELL * F.length("text")).alias("width"),
        F.lit(HEIGHT).alias("height"),
        F.when(F.col("line_index") == 0, TITLE_FONT).otherwise(BODY_FONT).alias("font_size"),
    )


WORD = {"page_index": "int", "line_index": "int", "word_index": "int", "text": "string", "x": "int", "y": "int", "width": "int", "height": "int", "font_size": "int"}


def words_of(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, dict[str, np.ndarray | pa.Array]]:
    """The number of each word's text, and columns of WORD. Bytes are looked at all at once, not text by text."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    off = (at - at[0]).astype(np.int64)
    solid = ~((raw == 32) | (raw == 10) | (raw == 9) | (raw == 13))
    # a word's first byte follows a blank or a text's edge, its last byte precedes one
    cut = np.zeros(len(raw) + 1, bool)
    cut[off] = True
    start = np.flatnonzero(solid & (cut[:-1] | ~np.concatenate([[False], solid[:-1]])))
    end = np.flatnonzero(solid & (cut[1:] | ~np.concatenate([solid[1:], [False]]))) + 1
    text = np.searchsorted(off, start, "right") - 1
    breaks = np.flatnonzero(raw == 10)
    passed = np.searchsorted(breaks, start)
    line = passed - np.searchsorted(breaks, off[:-1])[text]
    begin = np.maximum(off[text], np.concatenate([[0], breaks + 1])[passed])
    point = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])  # code points before each byte
    x, n = point[start] - point[begin], point[end] - point[start]
    first = np.flatnonzero(np.concatenate([[True], begin[1:] != begin[:-1]])) if len(start) else np.zeros(0, np.int64)
    word = np.arange(len(start)) - np.repeat(first, np.diff(np.append(first, len(start))))
    held = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)), pa.py_buffer(raw[solid]))
    full = lambda v: np.full(len(start), v)
    return text, {
        "page_index": line // LINES_PER_PAGE, "line_index": line, "word_index": word, "text": held, "x": LEFT + CELL * x, "y": TOP - LEADING * (line % LINES_PER_PAGE),
        "width": CELL * n, "height": full(HEIGHT), "font_size": np.where(line == 0, TITLE_FONT, BODY_FONT),
    }


def words(docs: DataFrame, *columns: str) -> DataFrame:
    """(doc_id and columns of WORD, all by default): runs without white space."""
    columns = columns or tuple(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for b in batches for part in blocks(b, "text")):
            of, found = words_of(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of)), *[v if isinstance(v := found[c], pa.Array) else pa.array(v.astype(np.int32)) for c in columns]], names=["doc_id", *columns])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} {WORD[c]}" for c in columns))


def chars(docs: DataFrame) -> DataFrame:
    """(…, char_index in the line, char, unicode, x, y)."""
    return lines(docs).filter(F.length("text") > 0).select("doc_id", "page_index", "line_index", "y", "font_size", F.posexplode(F.split("text", "")).alias("char_index", "char")).filter("char <> ''").withColumn("unicode", F.ascii("char")).withColumn("x", LEFT + CELL * F.col("char_index"))


def pages(docs: DataFrame) -> DataFrame:
    """(doc_id, page_index, text, n_lines) without a shuffle: slices of the lines of each row."""
    split = docs.select("doc_id", F.split("text", "\n", -1).alias("all"))
    return split.select("doc_id", "all", F.explode(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / LINES_PER_PAGE).cast("int"))).alias("page_index")).select("doc_id", "page_index", F.slice("all", F.col("page_index") * LINES_PER_PAGE + 1, LINES_PER_PAGE).alias("part")).select("doc_id", "page_index", F.array_join("part", "\n").alias("text"), F.size("part").alias("n_lines"))


def cluster_lines(chars: DataFrame) -> DataFrame:
    """Characters (doc_id, page_index, char_index, y, height, …) with the line that each is in: a new one starts where y moves
    by more than half the line's first height. One page is one group; its size is a page's."""
    import numpy as np
    import pandas as pd
    from pyspark.sql import types as T

    schema = T.StructType([*chars.schema.fields, T.StructField("line_index", T.IntegerType())])

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("char_index", kind="stable")
        out, line, limit, before = np.zeros(len(page), np.int32), -1, 0.0, 0.0
        for i, (y, height) in enumerate(zip(page["y"], page["height"], strict=True)):
            if line < 0 or abs(y - before) > limit:
                line, limit = line + 1, 0.5 * height
            out[i], before = line, y
        return page.assign(line_index=out)

    return chars.groupBy("doc_id", "page_index").applyInPandas(run, schema)
