"""Differences of two versions of documents, page by page."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "doc_id long, page_index int, ord int, kind string, before string, after string"


def page_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, page_index, kind): PAGE_ADDED, PAGE_REMOVED or CHANGED, of pages (doc_id, page_index, text)."""
    a, b = old.select("doc_id", "page_index", F.col("text").alias("old")), new.select("doc_id", "page_index", F.col("text").alias("new"))
    both = a.join(b, ["doc_id", "page_index"], "full_outer")
    kind = F.when(F.col("new").isNull(), "PAGE_REMOVED").when(F.col("old").isNull(), "PAGE_ADDED").when(F.col("old") != F.col("new"), "CHANGED")
    return both.select("doc_id", "page_index", kind.alias("kind"), "old", "new").filter("kind is not null")


def line_script(a: list[str], b: list[str]) -> list[tuple[str, str, str]]:
    """Edits from a longest common subsequence of lines; ties prefer insertions; a deletion and the insertion that is the
    next edit, even past common lines, are one modification. The side that an edit lacks is an empty text."""
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i, j] = table[i - 1, j - 1] + 1 if x == y else max(table[i - 1, j], table[i, j - 1])
    i, j, back = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
        elif j and (not i or table[i, j - 1] >= table[i - 1, j]):
            j -= 1
            back.append(("INSERTION", "", b[j]))
        else:
            i -= 1
            back.append(("DELETION", a[i], ""))
    out: list[tuple[str, str, str]] = []
    joinable = False
    for step in reversed(back):
        if step[0] == "INSERTION" and joinable:
            out[-1] = ("MODIFICATION", out[-1][1], step[2])
            joinable = False
        else:
            out.append(step)
            joinable = step[0] == "DELETION"
    return out


def line_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edits of changed pages. Equal pages never reach Python."""
    changed = page_changes(old, new).filter("kind = 'CHANGED'")

    def run(batches):
        for batch in batches:
            rows = [(d, p, n, *step) for d, p, x, y in batch[["doc_id", "page_index", "old", "new"]].itertuples(index=False, name=None) for n, step in enumerate(line_script(x.split("\n"), y.split("\n")))]
            yield pd.DataFrame(rows, columns=["doc_id", "page_index", "ord", "kind", "before", "after"])

    return changed.mapInPandas(run, SCHEMA)


def pixel_changes(old: DataFrame, new: DataFrame, tolerance: int = 30) -> DataFrame:
    """(image, n_changed, left, top, right, bottom) of pixels (image, x, y, r, g, b) of which a channel differs by more."""
    b = new.select("image", "x", "y", *[F.col(c).alias(f"{c}2") for c in "rgb"])
    differs = F.greatest(*[F.abs(F.col(c) - F.col(f"{c}2")) for c in "rgb"]) > tolerance
    return old.join(b, ["image", "x", "y"]).filter(differs).groupBy("image").agg(F.count("*").alias("n_changed"), F.min("x").alias("left"), F.min("y").alias("top"), F.max("x").alias("right"), F.max("y").alias("bottom"))
