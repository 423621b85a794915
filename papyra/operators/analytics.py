"""Statistics of documents, and duplicates of documents and pages."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.scalars import hamming, let

WORDS_A_MINUTE = 250


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \n\t\r]+"), F.lit(0))).cast("long")


def stats(docs: DataFrame) -> DataFrame:
    """One row a document, from its own row: nothing is shuffled."""
    return docs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        word_count(F.col("text")).alias("n_words"),
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
    ).withColumn("minutes", F.col("n_words") / WORDS_A_MINUTE)


def audit(pages: DataFrame) -> DataFrame:
    """(doc_id, n_pages, n_text, n_blank, n_scanned) from pages (doc_id, text)."""
    text = F.length("text") > 0
    out = pages.groupBy("doc_id").agg(F.count("*").alias("n_pages"), F.count_if(text).alias("n_text"), F.count_if(F.col("text") == "").alias("n_blank"))
    return out.withColumn("n_scanned", F.col("n_pages") - F.col("n_text") - F.col("n_blank"))


def fonts(words: DataFrame) -> DataFrame:
    """(doc_id, font_size, n_chars, rank): by characters, the larger size first among equals."""
    from pyspark.sql import Window as W

    used = words.groupBy("doc_id", "font_size").agg(F.sum(F.length("text")).alias("n_chars"))
    return used.withColumn("rank", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n_chars"), "font_size")))


def duplicates(docs: DataFrame) -> DataFrame:
    """(text_hash, first_doc, n): texts that occur more than once. Digests move, texts do not."""
    return docs.groupBy(F.sha2("text", 256).alias("text_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")).filter("n > 1")


def average_hash(values: Column) -> Column:
    """64 values as a long: bit i is set where value i is at least the mean."""
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(values)
    indexed = let(mean, lambda m: F.transform(values, lambda x, i: F.when(x.cast("double") >= m, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return F.aggregate(indexed, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))


def hash_pairs(hashes: DataFrame, distance: int = 5) -> DataFrame:
    """(a, b, distance) of (id, hash) within a Hamming distance. distance + 1 bands: one of them has to be equal, so the join
    is on bands, not on all pairs."""
    bands = distance + 1
    edge = [64 * i // bands for i in range(bands + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    banded = hashes.select("id", "hash", F.posexplode(F.array(*[F.col("hash").bitwiseAND(F.lit(m)) for m in signed])).alias("band", "part"))
    other = banded.select(F.col("id").alias("b"), F.col("hash").alias("hash_b"), "band", "part")
    d = hamming(F.col("hash"), F.col("hash_b"))
    return banded.join(other, ["band", "part"]).filter((F.col("id") < F.col("b")) & (d <= distance)).select(F.col("id").alias("a"), "b", d.cast("int").alias("distance")).distinct()


class _Leaders:
    """Leaders in order, found by hash: within `distance` bits of 64, at least two of distance + 2 segments are equal, so
    leaders are kept under each pair of segments, in runs that double in length: few are merged again as more come."""

    #: Rows that are looked up at once, and pairs that are compared at once.
    ROWS, PAIRS = 1024, 1 << 20

    def __init__(self, distance: int):
        self.distance, self.hashes = distance, np.zeros(0, np.uint64)
        edge = [64 * i // (distance + 2) for i in range(distance + 3)]
        masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edge, edge[1:], strict=False)]
        self.masks = [np.uint64(a | b) for a, b in combinations(masks, 2)]
        self.runs: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in self.masks]

    def first(self, some: np.ndarray) -> np.ndarray:
        """The place of the first leader within the distance of each hash; their number where there is none."""
        none = len(self.hashes)
        out = np.full(len(some), none)
        for mask, runs in zip(self.masks, self.runs, strict=True):
            for keys, places in runs:
                lo, hi = (np.searchsorted(keys, some & mask, side) for side in ("left", "right"))
                met = np.flatnonzero(hi > lo)
                lo, n = lo[met], (hi - lo)[met]
                while len(met):  # of each that is left, as many as fit
                    share = np.minimum(n, max(1, self.PAIRS // len(met)))
                    who = np.repeat(met, share)
                    to = places[np.repeat(lo - np.concatenate([[0], np.cumsum(share)[:-1]]), share) + np.arange(share.sum())]
                    near = np.bitwise_count(self.hashes[to] ^ some[who]) <= self.distance
                    np.minimum.at(out, who[near], to[near])
                    lo, n = lo + share, n - share
                    lo, n, met = lo[n > 0], n[n > 0], met[n > 0]
        return out

    def add(self, some: np.ndarray) -> None:
        places = np.arange(len(self.hashes), len(self.hashes) + len(some))
        self.hashes = np.concatenate([self.hashes, some])
        for mask, runs in zip(self.masks, self.runs, strict=True):
            keys, own = some & mask, places
            while runs and len(runs[-1][0]) <= 2 * len(keys):
                before = runs.pop()
                keys, own = np.concatenate([before[0], keys]), np.concatenate([before[1], own])
            order = np.argsort(keys, kind="stable")
            runs.append((keys[order], own[order]))


def leaders(hashes: np.ndarray, distance: int) -> np.ndarray:
    """For each hash, in order, the place of the first leader within the distance: of its own where it leads."""
    found = _Leaders(distance)
    place = np.zeros(0, np.int64)  # of each leader among hashes
    out = np.arange(len(hashes))
    for a in range(0, len(hashes), found.ROWS):
        part = hashes[a : a + found.ROWS]
        at = found.first(part)
        old = at < len(place)
        out[a : a + len(part)][old] = place[at[old]]
        left = np.flatnonzero(~old)
        close = np.bitwise_count(part[left][:, None] ^ part[left][None, :]) <= distance
        new: list[int] = []
        free = np.ones(len(left), bool)
        for i in range(len(left)):  # each that is still free leads, and takes those near it that are
            if free[i]:
                took = close[i] & free
                out[a + left[took]] = a + left[i]
                free &= ~took
                new.append(int(left[i]))
        found.add(part[new])
        place = np.concatenate([place, a + np.array(new, np.int64)])
    return out


def leader_clusters(hashes: DataFrame, distance: int = 5) -> DataFrame:
    """(group, id, hash) with leader and distance: within a group (a document's pages), in the order of id, each joins the first leader
    within the distance, or leads. A group is one task; leaders are looked up, so that its time does not follow their square."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id", kind="stable")
        ids, own = group["id"].to_numpy(), group["hash"].to_numpy().astype(np.int64).view(np.uint64)
        distinct, first, of = np.unique(own, return_index=True, return_inverse=True)
        order = np.argsort(first)  # equal hashes join the same leader; each stands where it comes first
        to = first[order][leaders(distinct[order], distance)]
        leader = np.empty(len(distinct), np.int64)
        leader[order] = to
        leader = leader[of]
        apart = np.bitwise_count(own ^ own[leader]).astype(np.int32)
        return pd.DataFrame({"group": group["group"].to_numpy(), "id": ids, "leader": ids[leader], "distance": apart})

    return hashes.groupBy("group").applyInPandas(run, "group long, id long, leader long, distance int")


def image_dpi(images: DataFrame, limit: float = 300.0) -> DataFrame:
    """Images (px_width, px_height, pt_width, pt_height) with their resolution, and whether it is over the limit."""
    x, y = F.col("px_width") / (F.col("pt_width") / 72), F.col("px_height") / (F.col("pt_height") / 72)
    return images.withColumns({"dpi_x": x, "dpi_y": y}).withColumn("over", F.greatest("dpi_x", "dpi_y") > limit)


def annotation_stats(annotations: DataFrame) -> DataFrame:
    """(type, n, pages, area, mean_area) of annotations (doc_id, page_index, type, width, height)."""
    area = F.col("width") * F.col("height")
    return annotations.groupBy("type").agg(F.count("*").alias("n"), F.countDistinct("doc_id", "page_index").alias("pages"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area"), F.coalesce(F.avg(area), F.lit(0.0)).alias("mean_area"))


def font_audit(fonts: DataFrame) -> DataFrame:
    """(name, embedded, pages) of (name, page_index, embedded): the first page's attributes hold; subset prefixes go."""
    bare = fonts.withColumn("name", F.regexp_replace("name", r"^[A-Z]{6}\+", ""))
    return bare.groupBy("name").agg(F.min_by("embedded", "page_index").alias("embedded"), F.array_sort(F.collect_set("page_index")).alias("pages"))


def saved(before: Column, after: Column) -> Column:
    return F.greatest(before - after, F.lit(0))
