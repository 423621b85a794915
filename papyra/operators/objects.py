"""Annotations, forms, bookmarks, layers and labels as tables, and annotations as XFDF."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyra.functions.scalars import truthy, xml_escape
from papyra.operators.groups import together, whole

HIDDEN, PRINT, READ_ONLY, REQUIRED, EDITABLE = 2, 4, 1, 2, 1 << 17


def printable(flags: Column) -> Column:
    return flags.bitwiseAND(PRINT) != 0


def hidden(flags: Column) -> Column:
    return flags.bitwiseAND(HIDDEN) != 0


def flatten_except(annotations: DataFrame, kept: list[str]) -> DataFrame:
    """Annotations that stay live; the others become page content."""
    return annotations.withColumn("flat", ~F.col("type").isin(kept))


def named(codes: DataFrame, dimension: DataFrame, code: str = "code", unknown: str = "UNKNOWN") -> DataFrame:
    """codes with name from a dimension (code, name); UNKNOWN where it has none. The dimension is a fixed enumeration."""
    return codes.join(F.broadcast(dimension.select(F.col("code").alias(code), "name")), code, "left").withColumn("name", F.coalesce("name", F.lit(unknown)))


def at_point(links: DataFrame, x: float, y: float) -> DataFrame:
    return links.filter((F.col("x") <= x) & (x <= F.col("x") + F.col("width")) & (F.col("y") <= y) & (y <= F.col("y") + F.col("height")))


def layer(contents: Column) -> Column:
    return F.nullif(F.regexp_extract(contents, r"^\[OCG:([^\]]*)\]", 1), F.lit(""))


def show_layer(annotations: DataFrame, name: str, visible: bool) -> DataFrame:
    flags = F.col("flags")
    put = flags.bitwiseAND(~HIDDEN) if visible else flags.bitwiseOR(HIDDEN)
    return annotations.withColumn("flags", F.when(layer(F.col("contents")) == name, put).otherwise(flags))


def _tree(nodes: list, parents: list, depth: int) -> list[tuple[int, list, int]]:
    """(depth, path, n_below) of the nodes that a root leads to, level by level; a node that is there twice has all below it twice."""
    under: dict = {}
    for node, parent in zip(nodes, parents, strict=True):
        under.setdefault(parent, []).append(node)
    level = [[n] for n in under.get(None, [])]
    every: list[tuple[int, list]] = []
    for d in range(depth + 1):
        every += [(d, path) for path in level]
        level = [[*path, n] for path in level if path[-1] is not None for n in under.get(path[-1], [])]
    below = Counter(n for _, path in every for n in path)
    return [(d, path, below[path[-1]] - 1) for d, path in every if path[-1] is not None]


def bookmark_tree(bookmarks: DataFrame, depth: int = 100) -> DataFrame:
    """(doc_id, node_id, depth, path, n_below) of (doc_id, node_id, parent_id, title): down to a depth. A document's bookmarks are one group, and move once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, begin in whole(batches, 1):
            doc, node, parent = (c.to_pylist() for c in table.columns)
            rows = [(doc[a], path[-1], d, path, n) for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True) for d, path, n in _tree(node[a:b], parent[a:b], depth)]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.int64()), strict=True)], names=["doc_id", "node_id", "depth", "path", "n_below"])

    return together(bookmarks.filter("doc_id is not null").select("doc_id", "node_id", "parent_id"), "doc_id").mapInArrow(run, "doc_id long, node_id long, depth int, path array<long>, n_below long")


def fill_form(fields: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields (doc_id, name, type, flags, value, options) with the values (doc_id, name, value) put in, and the values that were not.

    Read-only fields stay; check boxes take a truth value; choices take an option by its label in any case, or any text if
    editable.
    """
    put = values.select("doc_id", "name", F.col("value").alias("__new"))
    joined = fields.join(put, ["doc_id", "name"], "left")
    options = F.coalesce("options", F.array().cast("array<string>"))
    option = F.try_element_at(F.filter(options, lambda o: F.lower(o) == F.lower("__new")), F.lit(1))
    choice = F.col("type").isin("COMBO", "LIST", "RADIO")
    editable = F.col("flags").bitwiseAND(EDITABLE) != 0
    checked = F.when(truthy(F.col("__new")), "Yes").otherwise("Off")
    chosen = F.when(choice, F.coalesce(option, F.when(editable, F.col("__new")))).when(F.col("type") == "CHECKBOX", checked).otherwise(F.col("__new"))
    ok = F.col("__new").isNotNull() & (F.col("flags").bitwiseAND(READ_ONLY) == 0)
    filled = joined.withColumn("filled", ok & chosen.isNotNull()).withColumn("value", F.when(F.col("filled"), chosen).otherwise(F.col("value"))).drop("__new")
    skipped = values.join(filled.filter("filled").select("doc_id", "name"), ["doc_id", "name"], "left_anti")
    return filled, skipped


def page_labels(pages: DataFrame, labels: DataFrame) -> DataFrame:
    return pages.join(labels.select("doc_id", "page_index", "label"), ["doc_id", "page_index"], "left").withColumn("label", F.coalesce("label", F.lit("")))


def strip_metadata(metadata: Column, keys: list[str] | None = None) -> Column:
    """A map without these keys; without any at all for no keys."""
    return F.map_filter(metadata, lambda k, _: ~k.isin(keys) if keys else F.lit(False))


def xfdf(annotations: DataFrame) -> DataFrame:
    """(doc_id, xfdf): a document's annotations (page_index, type, x, y, width, height, contents) as XML."""
    rect = F.concat_ws(",", "x", "y", F.col("x") + F.col("width"), F.col("y") + F.col("height"))
    one = F.format_string('<%s page="%d" rect="%s"><contents>%s</contents></%s>', F.lower("type"), F.col("page_index"), rect, xml_escape(F.coalesce("contents", F.lit(""))), F.lower("type"))
    ordered = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_index", "annotation", one.alias("xml")))), lambda a: a.xml), "")
    return annotations.groupBy("doc_id").agg(F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><xfdf xmlns="http://ns.adobe.com/xfdf/"><annots>'), ordered, F.lit("</annots></xfdf>")).alias("xfdf"))


def from_xfdf(documents: DataFrame) -> DataFrame:
    """(doc_id, annotation, type, page_index, contents) of documents (doc_id, xfdf)."""
    bare = F.regexp_replace("xfdf", r' xmlns="[^"]*"', "")
    each = F.regexp_extract_all(bare, F.lit(r'(?s)<(?!annots|xfdf|contents)[a-z]+ page="[^"]*"[^>]*>.*?</contents></[a-z]+>'), F.lit(0))
    rows = documents.select("doc_id", F.posexplode(each).alias("annotation", "xml"))
    return rows.select("doc_id", "annotation", F.regexp_extract("xml", "^<([a-z]+)", 1).alias("type"), F.regexp_extract("xml", 'page="(\\d+)"', 1).cast("int").alias("page_index"), F.xpath_string("xml", F.lit("//contents")).alias("contents"))
