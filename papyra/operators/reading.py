"""Reading pages by place, keyword and heading, and what follows from it: highlights, bookmarks, tags and inserted pages.

Lines are those of layout.lines and characters those of layout.chars. All of it is narrow but for the sums by page or by
document that are named so, and the joins on the page.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyra.functions.patterns import escaped
from papyra.functions.scalars import match_spans, xml_escape
from papyra.operators.layout import CELL, HEIGHT, LEFT

PAGE = ["doc_id", "page_index"]

# The standard fonts, and the codes of page objects.
STANDARD_FONTS = [
    "Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique",
    "Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique",
    "Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic",
    "Symbol", "ZapfDingbats",
]
OBJECTS = {"text": 1, "path": 2, "image": 3, "shading": 4, "form": 5}


def bounded_text(lines: DataFrame, left: float, bottom: float, right: float, top: float) -> DataFrame:
    """(doc_id, page_index, text): characters whose cells lie inside the rectangle, lines in order; pages without any are left out."""
    first = max(0, -int((LEFT - left) // CELL)) if left > LEFT else 0
    count = max(0, int((right - LEFT) // CELL) - first)
    inside = lines.filter((F.col("y") >= bottom) & (F.col("y") + F.col("height") <= top)).withColumn("part", F.substring("text", first + 1, count)).filter("part <> ''")
    parts = F.sort_array(F.collect_list(F.struct("line_index", "part")))  # a page has at most LINES_PER_PAGE lines
    return inside.groupBy(PAGE).agg(F.array_join(F.transform(parts, lambda p: p["part"]), "\n").alias("text"))


def centred(chars: DataFrame, rects: DataFrame) -> DataFrame:
    """chars whose centre is in a rectangle (doc_id, page_index, left, bottom, right, top) of their page, borders included."""
    x, y = F.col("x") + CELL / 2, F.col("y") + HEIGHT / 2
    return chars.join(rects, PAGE).filter(x.between(F.col("left"), F.col("right")) & y.between(F.col("bottom"), F.col("top"))).select(chars.columns).distinct()


def outside(lines: DataFrame, rects: DataFrame) -> DataFrame:
    """lines that overlap no rectangle (doc_id, page_index, left, bottom, right, top) of their page; touching is not overlapping."""
    r = rects.select(F.col("doc_id").alias("rd"), F.col("page_index").alias("rp"), "left", "bottom", "right", "top")
    overlap = (F.col("x") < F.col("right")) & (F.col("x") + F.col("width") > F.col("left")) & (F.col("y") < F.col("top")) & (F.col("y") + F.col("height") > F.col("bottom"))
    return lines.join(r, (F.col("doc_id") == F.col("rd")) & (F.col("page_index") == F.col("rp")) & overlap, "left_anti")


def keyword_pages(pages: DataFrame, keyword: str) -> DataFrame:
    """Pages whose text has the keyword, in any case."""
    return pages.filter(F.lower("text").contains(keyword.lower()))


def highlights(lines: DataFrame, query: str, case_sensitive: bool = False, whole_word: bool = False) -> DataFrame:
    """(doc_id, page_index, line_index, x, y, width, height): one rectangle for each match within a line."""
    pattern = escaped(query if case_sensitive else query.lower())
    text = F.col("text") if case_sensitive else F.lower("text")
    spans = match_spans(text, rf"\b{pattern}\b" if whole_word else pattern)
    found = lines.select(*PAGE, "line_index", "y", "height", F.explode(spans).alias("s"))
    return found.select(*PAGE, "line_index", (LEFT + CELL * F.col("s.start")).alias("x"), "y", (CELL * (F.col("s.end") - F.col("s.start"))).alias("width"), "height")


def heading_bookmarks(lines: DataFrame, least: float = 14.0, longest: int = 200) -> DataFrame:
    """(doc_id, page_index, line_index, title): runs of text set in at least this size.

    A run ends where the size changes by half a point or a smaller character follows, and with the page. Blank runs and
    runs of more than so many characters are no headings."""
    w = Window.partitionBy(PAGE).orderBy("line_index")
    before = F.lag("font_size").over(w)
    marked = lines.filter(F.length("text") > 0).withColumn("starts", (before.isNull() | (before < least) | (F.abs(before - F.col("font_size")) >= 0.5)).cast("int"))
    runs = marked.withColumn("run", F.sum("starts").over(w)).filter(F.col("font_size") >= least)
    parts = F.sort_array(F.collect_list(F.struct("line_index", "text")))
    joined = runs.groupBy(*PAGE, "run").agg(F.min("line_index").alias("line_index"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("title"))
    stripped = joined.withColumn("title", F.regexp_replace("title", r"^[\t-\r ]+|[\t-\r ]+$", ""))
    return stripped.filter(F.length("title").between(1, longest)).select(*PAGE, "line_index", "title")


def find_bookmark(bookmarks: DataFrame, titles: DataFrame) -> DataFrame:
    """Of each wanted (doc_id, title), the first bookmark (doc_id, place, title, …) of exactly that title, if there is one."""
    rest = [c for c in bookmarks.columns if c not in ("doc_id", "title")]
    first = bookmarks.join(titles.select("doc_id", "title").distinct(), ["doc_id", "title"]).groupBy("doc_id", "title").agg(F.min_by(F.struct(*rest), "place").alias("b"))
    return first.select("doc_id", "title", "b.*")


def set_bookmarks(bookmarks: DataFrame, counts: DataFrame) -> DataFrame:
    """A flat list of bookmarks (doc_id, place, title, page_index) with pages held to 0 … n_pages - 1 of counts (doc_id, n_pages)."""
    return bookmarks.join(counts, "doc_id").withColumn("page_index", F.greatest(F.lit(0), F.least("page_index", F.col("n_pages") - 1)).cast("int")).select(bookmarks.columns)


def heading_tag(level: Column) -> Column:
    return F.concat(F.lit("H"), F.greatest(F.lit(1), F.least(F.lit(6), level)).cast("string"))


def tag_xml(type_: Column, page: Column, x: Column, y: Column, width: Column, height: Column, text: Column) -> Column:
    """One element of a structure tree; without text it is empty."""
    sides = [F.lit(f' {k}="') if i % 2 == 0 else v for k, v in (("x", x), ("y", y), ("w", width), ("h", height)) for i in (0, 1)]
    sides = [part for i in range(0, len(sides), 2) for part in (sides[i], sides[i + 1].cast("double").cast("string"), F.lit('"'))]
    body = F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "/>").otherwise(F.concat(F.lit(">"), xml_escape(F.coalesce(text, F.lit(""))), F.lit("</"), xml_escape(type_), F.lit(">")))
    return F.concat(F.lit("<"), xml_escape(type_), F.lit(' page="'), page.cast("string"), F.lit('"'), *sides, body)


def normalise(docs: DataFrame, column: str = "text", form: str = "NFC") -> DataFrame:
    """docs with a column in a Unicode normal form. Rows are not moved."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield pa.RecordBatch.from_arrays([pa.array([t if t is None else unicodedata.normalize(form, t) for t in c.to_pylist()], c.type) if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def standard_font(name: Column) -> Column:
    """Whether the name contains that of a standard font, in any case."""
    return F.exists(F.array(*[F.lit(f.lower()) for f in STANDARD_FONTS]), lambda f: F.contains(F.lower(name), f))


def object_summary(objects: DataFrame) -> DataFrame:
    """Page objects by page: how many of each kind in OBJECTS; other codes are not counted."""
    return objects.groupBy(PAGE).agg(*[F.count_if(F.col("type") == code).alias(kind) for kind, code in OBJECTS.items()])


def image_filters(objects: DataFrame) -> DataFrame:
    """(doc_id, filter, n, n_bytes) of images by the first of their filters, `none` without one."""
    first = F.coalesce(F.get("filters", F.lit(0)), F.lit("none"))
    return objects.filter(F.col("type") == OBJECTS["image"]).groupBy("doc_id", first.alias("filter")).agg(F.count("*").alias("n"), F.sum("n_bytes").alias("n_bytes"))


def form_fields(annotations: DataFrame) -> DataFrame:
    """The widgets among annotations, with what their flags say."""
    return annotations.filter("type = 'WIDGET'").withColumns({"read_only": F.col("flags").bitwiseAND(1) != 0, "required": F.col("flags").bitwiseAND(2) != 0})


def insert_overlays(pages: DataFrame, overlays: DataFrame) -> DataFrame:
    """(doc_id, out_index, overlay, page_index): each overlay page follows the page of its number; overlays beyond the last page are left out."""
    i, n = F.col("page_index"), F.col("n_over")
    many = overlays.groupBy("doc_id").agg(F.count("*").alias("n_over"))
    own = pages.join(many, "doc_id", "left").select("doc_id", (i + F.least(i, F.coalesce(n, F.lit(0)))).cast("int").alias("out_index"), F.lit(False).alias("overlay"), "page_index")
    over = overlays.join(pages, PAGE, "left_semi").select("doc_id", (2 * i + 1).cast("int").alias("out_index"), F.lit(True).alias("overlay"), "page_index")
    return own.unionByName(over)


def annotations_json(annotations: DataFrame) -> DataFrame:
    """(doc_id, json): the annotations of a document as one JSON array, by page and number."""
    fields = F.struct("page_index", "annotation", "type", "contents", "x", "y", "width", "height")
    return annotations.groupBy("doc_id").agg(F.to_json(F.sort_array(F.collect_list(fields))).alias("json"))


def annotations_from_json(rows: DataFrame, counts: DataFrame) -> DataFrame:
    """Annotations of (doc_id, json); those on pages beyond counts (doc_id, n_pages) are skipped, and text that is no array gives none."""
    schema = "array<struct<page_index int, annotation int, type string, contents string, x double, y double, width double, height double>>"
    return rows.select("doc_id", F.inline(F.from_json("json", schema))).join(counts, "doc_id").filter("page_index >= 0 and page_index < n_pages").drop("n_pages")


def add_attachments(attachments: DataFrame, added: DataFrame) -> DataFrame:
    """attachments (doc_id, place, name, size) with added (doc_id, name, size) behind them, in order of name."""
    have = attachments.groupBy("doc_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("doc_id").orderBy("name", "size")
    behind = added.withColumn("k", F.row_number().over(w) - 1).join(have, "doc_id", "left").select("doc_id", (F.coalesce("n", F.lit(0)) + F.col("k")).cast("int").alias("place"), "name", "size")
    return attachments.select("doc_id", "place", "name", "size").unionByName(behind)


def delete_attachments(attachments: DataFrame, gone: DataFrame) -> DataFrame:
    """attachments without the places of gone (doc_id, place); the later ones move up."""
    left = attachments.join(gone, ["doc_id", "place"], "left_anti")
    return left.withColumn("place", (F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1).cast("int"))


def find_destinations(documents: DataFrame, destinations: DataFrame, name: str) -> DataFrame:
    """(doc_id, page_index): the page of each document's destination (doc_id, name, page_index) of that name, -1 without one."""
    found = destinations.filter(F.col("name") == name).groupBy("doc_id").agg(F.min("page_index").alias("page_index"))
    return documents.select("doc_id").join(found, "doc_id", "left").withColumn("page_index", F.coalesce("page_index", F.lit(-1)))
