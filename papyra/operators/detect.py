"""Detection over layout tables: blank pages, gutters, headings, contents, tables, reading order, tags."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.operators import layout
from papyra.operators.groups import blocks, together, whole


def blank_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("blank", F.coalesce(F.length("text") <= 0, F.lit(True)))


def gutters(chars: DataFrame, width: int = layout.WIDTH, threshold: float = 20.0) -> DataFrame:
    """(doc_id, page_index, start, end): stretches before a character without a character's centre, at least as wide as the
    threshold, whose middle is further than it from the page's edges. So a wide left margin counts, the right one does not.

    Bins are half as many as points. Only occupied bins are kept, so gaps are differences of neighbours, not a join with all
    bins.
    """
    bins = int(width / 2)
    size = width / bins
    own = chars.filter("unicode > 32").select("doc_id", "page_index", F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor((F.col("x") + layout.CELL / 2) / size).cast("int"))).alias("bin")).distinct()
    before = F.lag("bin", 1, -1).over(W.partitionBy("doc_id", "page_index").orderBy("bin"))
    gaps = own.withColumn("before", before).select("doc_id", "page_index", ((F.col("before") + 1) * size).alias("start"), (F.col("bin") * size).alias("end"))
    middle = (F.col("start") + F.col("end")) / 2
    return gaps.filter((F.col("end") - F.col("start") >= threshold) & (middle > threshold) & (middle < width - threshold))


def headings(lines: DataFrame, min_size: float = 14.0) -> DataFrame:
    return lines.filter((F.col("font_size") >= min_size) & (F.length(F.trim("text")) > 1)).select("doc_id", "page_index", "line_index", F.trim("text").alias("title"), "font_size")


def contents(headings: DataFrame, per_document: int = 42) -> DataFrame:
    """Lines of a table of contents: titles of at most 60 characters, dot leaders up to 70, page numbers past the contents page."""
    w = W.partitionBy("doc_id").orderBy("page_index", "line_index")
    short = F.when(F.length("title") > 60, F.concat(F.substring("title", 1, 57), F.lit("..."))).otherwise(F.col("title"))
    listed = headings.withColumn("entry", F.row_number().over(w)).filter(F.col("entry") <= per_document).withColumns({"short": short, "number": (F.col("page_index") + 2).cast("string")})
    return listed.select("doc_id", "entry", F.concat("short", F.lit(" "), F.expr("repeat('.', greatest(1, 70 - length(short) - length(number)))"), F.lit(" "), "number").alias("line"))


def tags(words: DataFrame) -> DataFrame:
    """(doc_id, line_index, tag): H1, H2, H3 by the line's font against its page's upper median word font; else P.

    Words are counted by line and font before they move. The median is the first font, from the smallest on, with which more
    than half of the page's words are counted."""
    counted = words.filter("doc_id is not null and page_index is not null").groupBy("doc_id", "page_index", "line_index", "font_size").agg(F.count("font_size").alias("n"))
    page = W.partitionBy("doc_id", "page_index")
    so_far, every = F.sum("n").over(page.orderBy("font_size")), F.sum("n").over(page)
    sized = counted.withColumn("median", F.when(so_far > F.floor(every / 2), F.col("font_size"))).withColumn("median", F.min("median").over(page))
    by_line = sized.groupBy("doc_id", "page_index", "line_index").agg(F.max("font_size").alias("size"), F.first("median").alias("median"))
    ratio = F.col("size") / F.col("median")
    return by_line.select("doc_id", "line_index", F.when(ratio >= 2.0, "H1").when(ratio >= 1.6, "H2").when(ratio >= 1.3, "H3").otherwise("P").alias("tag"))


#: What crop_bounds reads of words.
BOX = ("page_index", "x", "y", "width", "height")


def crop_bounds(words: DataFrame) -> DataFrame:
    return words.groupBy("doc_id", "page_index").agg(F.min("x").alias("left"), F.min("y").alias("bottom"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("top"))


def uniform_crop(bounds: DataFrame, margin: float = 0.0) -> DataFrame:
    kept = bounds.filter((F.col("right") > F.col("left")) & (F.col("top") > F.col("bottom")))
    return kept.groupBy("doc_id").agg(F.greatest(F.min("left") - margin, F.lit(0.0)).alias("left"), F.greatest(F.min("bottom") - margin, F.lit(0.0)).alias("bottom"), (F.max("right") + margin).alias("right"), (F.max("top") + margin).alias("top"))


CELLS = "doc_id long, page_index int, row int, cells array<string>"


def _table(words: list[tuple], width: float, height: float) -> list[list[str]]:
    """Rows of cells of a page's words (y, x, width, text); width is their mean, height their upper median."""
    tolerance, gap = 0.4 * height, 2.5 * width
    rows: list[list[tuple]] = []
    before = None
    for w in sorted(words, key=lambda w: -w[0]):
        if before is None or before - w[0] > tolerance:
            rows.append([])
        rows[-1].append(w)
        before = w[0]
    places = sorted(w[1] for w in words)
    starts = places[:1]
    for last, x in zip(places, places[1:], strict=False):
        if x - last > gap and x - starts[-1] > 0.5 * gap:
            starts.append(x)
    ends = [*starts[1:], float("inf")]
    out: list[list[str]] = []
    if len(rows) >= 2 and len(starts) >= 2:
        for r in rows:
            cells = [""] * len(starts)
            for _, x, wide, text in r:
                centre = x + wide / 2
                c = next((i for i, (s, e) in enumerate(zip(starts, ends, strict=True)) if s <= centre < e), None)
                if c is None:
                    c = min(range(len(starts)), key=lambda i: abs((starts[i] + ends[i]) / 2 - centre))
                cells[c] = f"{cells[c]} {text}".strip()
            if sum(map(bool, cells)) >= 2:
                out.append(cells)
    return out if len(out) >= 2 else []


def _promising(y: np.ndarray, x: np.ndarray, width: np.ndarray, gap: float, tolerance: float) -> bool:
    """Whether two rows of a page may have words in two columns. True where in doubt: _table() decides."""
    places = np.sort(x)
    starts = [places[0]]
    for i in np.flatnonzero(places[1:] - places[:-1] > gap).tolist():
        if places[i + 1] - starts[-1] > 0.5 * gap:
            starts.append(places[i + 1])
    column = np.searchsorted(starts, x + width / 2, "right") - 1
    down = np.argsort(-y, kind="stable")
    row = np.zeros(len(y), np.int64)
    row[1:] = np.cumsum(y[down][:-1] - y[down][1:] > tolerance)
    cells = np.unique(row * (len(starts) + 1) + column[down])
    return bool((column < 0).any()) or int((np.bincount(cells // (len(starts) + 1)) >= 2).sum()) >= 2


def _tables(doc: pa.Array, page: pa.Array, group: np.ndarray, y: np.ndarray, x: np.ndarray, width: np.ndarray, height: np.ndarray, text: pa.Array) -> pa.RecordBatch:
    """Tables of the words of groups 0, 1, …, which are pages (doc, page). Pages that can't hold one are passed over by what all pages show at once."""
    rows: list[tuple] = []
    some = np.flatnonzero(np.bincount(group, minlength=len(doc)) >= 4)
    ends = np.searchsorted(group, np.stack([some, some + 1], 1)) if len(some) else np.zeros((0, 2), np.int64)
    for g, (a, b) in zip(some.tolist(), ends.tolist(), strict=True):
        ys, xs, ws = y[a:b], x[a:b], width[a:b]
        high, gap = np.partition(height[a:b], (b - a) // 2)[(b - a) // 2].item(), 2.5 * ws.mean()
        # a gap between columns is no wider than the page's words lie apart, nor one between rows
        if not (xs.max() - xs.min() > gap and ys.max() - ys.min() > 0.4 * high and _promising(ys, xs, ws, gap, 0.4 * high)):
            continue
        found = _table(list(zip(ys.tolist(), xs.tolist(), ws.tolist(), text.slice(a, b - a).to_pylist(), strict=True)), ws.mean(), high)
        rows += [(doc[g].as_py(), page[g].as_py(), i, cells) for i, cells in enumerate(found)]
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.string())), strict=True)], names=["doc_id", "page_index", "row", "cells"])


def tables(words: DataFrame) -> DataFrame:
    """(doc_id, page_index, row, cells): at most one table a page, from words in rows and columns. A page is one group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole(batches, 2):
            group = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            first = table.take(pa.array(begin[:-1]))
            yield _tables(first.column(0), first.column(1), group, *(table.column(c).to_numpy() for c in ("y", "x", "width", "height")), table.column("text"))

    return together(words.select("doc_id", "page_index", "y", "x", "width", "height", "text"), "doc_id", "page_index").mapInArrow(run, CELLS)


def page_tables(pages: DataFrame) -> DataFrame:
    """tables() of the words of pages (doc_id, page_index, text), which move as texts: a word with its place takes many times the bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole((part for batch in batches for part in blocks(batch, "text")), 2):
            of, w = layout.words_of(table.column("text"))
            first = table.take(pa.array(begin[:-1]))
            yield _tables(first.column(0), first.column(1), np.searchsorted(begin[:-1], of, "right") - 1, *(w[c] for c in ("y", "x", "width", "height")), w["text"])

    return together(pages.select("doc_id", "page_index", "text"), "doc_id", "page_index").mapInArrow(run, CELLS)


KINDS = ["HEADER", "BODY", "SIDEBAR", "CAPTION", "FOOTNOTE"]


def _blocks(lines: list[tuple], width: float, height: float) -> list[tuple[str, str]]:
    """(kind, text) of a page's lines (text, x, y, width, height), in reading order."""
    blocks: list[dict] = []
    for text, x, y, wide, high in sorted(lines, key=lambda r: -r[2]):
        if not text.strip():
            continue
        right = x + wide
        b = blocks[-1] if blocks else None
        if b and b["last"] - y < 2 * high and (abs(b["x"] - x) < 30 or abs(b["right"] - right) < 30):
            b |= {"x": min(b["x"], x), "y": min(b["y"], y), "last": y, "top": max(b["top"], y + high), "right": max(b["right"], right)}
            b["text"].append(text)
        else:
            blocks.append({"x": x, "y": y, "last": y, "top": y + high, "right": right, "text": [text]})
    for b in blocks:
        wide = b["right"] - b["x"]
        across, up = (b["x"] + b["right"]) / 2, (b["y"] + b["top"]) / 2
        narrow_side = wide < 0.3 * width and not 0.2 * width <= across <= 0.8 * width
        b["kind"] = "HEADER" if up > 0.9 * height else "FOOTNOTE" if up < 0.1 * height else "SIDEBAR" if narrow_side else "CAPTION" if len(b["text"]) <= 2 and wide < 0.5 * width else "BODY"
    blocks.sort(key=lambda b: (KINDS.index(b["kind"]), -b["y"], b["x"]))
    return [(b["kind"], "\n".join(b["text"]).strip()) for b in blocks]


def reading_order(lines: DataFrame, width: float = layout.WIDTH, height: float = layout.PAGE_HEIGHT) -> DataFrame:
    """(doc_id, page_index, ord, kind, text): blocks of lines by kind, then from top to bottom and left to right."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole(batches, 2):
            doc, page, *rest = (c.to_pylist() for c in table.columns)
            each = list(zip(*rest, strict=True))
            rows = [(doc[a], page[a], i, kind, text) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True) for i, (kind, text) in enumerate(_blocks(each[a:b], width, height))]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string()), strict=True)], names=["doc_id", "page_index", "ord", "kind", "text"])

    return together(lines.select("doc_id", "page_index", "text", "x", "y", "width", "height"), "doc_id", "page_index").mapInArrow(run, "doc_id long, page_index int, ord int, kind string, text string")
