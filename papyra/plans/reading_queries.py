"""Queries of reading by place, keyword and heading, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from papyra.operators import layout, reading
from papyra.plans.catalogue import LINES, NPAGES, PAGES, WORDS, _spans, docs, page_numbers, register
from papyra.plans.object_queries import ANNOTATIONS, annotations

#: Words as page objects: kinds and filters follow from their lengths.
OBJECTS = WORDS + ", objects AS (SELECT doc_id, page_index, length(text) % 7 AS type, length(text)::BIGINT AS n_bytes, CASE WHEN length(text) > 3 THEN ['FlateDecode'] ELSE [] END AS filters FROM words)"
#: An area for every second page.
AREAS = "areas AS (SELECT doc_id, page_index, 90.0 AS l, 500.0 AS b, 150.0 AS r, 640.0 AS t FROM pages_ WHERE page_index % 2 = 0)"
TITLES = LINES + r", titles AS (SELECT doc_id, page_index, line_index, regexp_replace(text, '^[\t-\r ]+|[\t-\r ]+$', '', 'g') AS title FROM lines WHERE line_index = 0)"


def objects(spark, sf_dir):
    n = F.length("text")
    return layout.words(docs(spark, sf_dir), "page_index", "text").select("doc_id", "page_index", (n % 7).alias("type"), n.cast("long").alias("n_bytes"), F.when(n > 3, F.array(F.lit("FlateDecode"))).otherwise(F.array().cast("array<string>")).alias("filters"))


def areas(spark, sf_dir):
    sides = {"left": 90.0, "bottom": 500.0, "right": 150.0, "top": 640.0}
    return page_numbers(spark, sf_dir).filter("page_index % 2 = 0").withColumns({k: F.lit(v) for k, v in sides.items()})


def lines_of(spark, sf_dir):
    return layout.lines(docs(spark, sf_dir))


@register("bounded_text", f"WITH {LINES} SELECT doc_id, page_index, string_agg(substr(text, 5, 30), chr(10) ORDER BY line_index) AS text FROM lines WHERE y >= 400 AND y + 12 <= 700 AND length(text) > 4 GROUP BY ALL")
def bounded_text(spark, sf_dir):
    return reading.bounded_text(lines_of(spark, sf_dir), 93.0, 400.0, 277.0, 700.0)


@register(
    "redact_centres",
    f"WITH {PAGES}, {AREAS}, c AS (SELECT doc_id, page_index, y + 6 AS cy, 72 + 6 * (unnest(range(1, length(text) + 1)) - 1) + 3 AS cx FROM lines) SELECT doc_id, page_index, count(*) AS n FROM c JOIN areas USING (doc_id, page_index) WHERE cx BETWEEN l AND r AND cy BETWEEN b AND t GROUP BY ALL",
)
def redact_centres(spark, sf_dir):
    return reading.centred(layout.chars(docs(spark, sf_dir)), areas(spark, sf_dir)).groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))


@register("lines_outside", f"WITH {PAGES}, {AREAS} SELECT doc_id, page_index, line_index FROM lines x WHERE NOT EXISTS (SELECT 1 FROM areas a WHERE a.doc_id = x.doc_id AND a.page_index = x.page_index AND 72 < r AND 72 + 6 * length(text) > l AND y < t AND y + 12 > b)")
def lines_outside(spark, sf_dir):
    return reading.outside(lines_of(spark, sf_dir), areas(spark, sf_dir)).select("doc_id", "page_index", "line_index")


@register("keyword_pages", f"WITH {PAGES} SELECT doc_id, page_index FROM pages_ WHERE contains(lower(text), 'the')")
def keyword_pages(spark, sf_dir):
    return reading.keyword_pages(layout.pages(docs(spark, sf_dir)), "The").select("doc_id", "page_index")


@register("search_highlights", f"WITH {LINES}, low AS (SELECT * REPLACE (lower(text) AS text) FROM lines) SELECT doc_id, page_index, count(*) AS n, sum(72 + 6 * s)::BIGINT AS x_sum, sum(6 * length(m))::BIGINT AS width_sum FROM ({_spans('low', 'doc_id, page_index', 'a')}) GROUP BY ALL")
def search_highlights(spark, sf_dir):
    return reading.highlights(lines_of(spark, sf_dir), "A").groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.sum("x").alias("x_sum"), F.sum("width").alias("width_sum"))


@register("heading_bookmarks", f"WITH {TITLES} SELECT doc_id, page_index, line_index, title FROM titles WHERE length(title) BETWEEN 1 AND 200")
def heading_bookmarks(spark, sf_dir):
    return reading.heading_bookmarks(lines_of(spark, sf_dir))


@register("bookmark_find", f"WITH {LINES}, b AS (SELECT doc_id, line_index AS place, split_part(text, ' ', 1) AS title FROM lines), w AS (SELECT DISTINCT doc_id, title FROM b WHERE place >= 3) SELECT doc_id, title, min(place)::INT AS place FROM b JOIN w USING (doc_id, title) GROUP BY ALL")
def bookmark_find(spark, sf_dir):
    b = lines_of(spark, sf_dir).select("doc_id", F.col("line_index").alias("place"), F.split_part("text", F.lit(" "), F.lit(1)).alias("title"))
    return reading.find_bookmark(b, b.filter("place >= 3"))


@register("bookmarks_set", f"WITH {NPAGES} SELECT doc_id, page_index::INT AS place, 't' || page_index AS title, least(page_index + 1, n - 1)::INT AS page_index FROM np")
def bookmarks_set(spark, sf_dir):
    p = page_numbers(spark, sf_dir)
    b = p.select("doc_id", F.col("page_index").alias("place"), F.concat(F.lit("t"), F.col("page_index").cast("string")).alias("title"), (F.col("page_index") + 1).alias("page_index"))
    return reading.set_bookmarks(b, p.groupBy("doc_id").agg(F.count("*").alias("n_pages")))


_ESCAPED = "replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')"


@register("structure_xml", f"""WITH {LINES} SELECT doc_id, line_index, '<H' || greatest(1, least(6, line_index)) || ' page="' || page_index || '" x="72.0" y="' || y || '.0" w="' || 6 * length(text) || '.0" h="12.0"' || CASE WHEN text = '' THEN '/>' ELSE '>' || {_ESCAPED} || '</H' || greatest(1, least(6, line_index)) || '>' END AS xml FROM lines""")
def structure_xml(spark, sf_dir):
    x = lines_of(spark, sf_dir)
    return x.select("doc_id", "line_index", reading.tag_xml(reading.heading_tag(F.col("line_index")), *map(F.col, ("page_index", "x", "y", "width", "height", "text"))).alias("xml"))


@register("unicode_nfc", "SELECT doc_id, md5(nfc_normalize(replace(text, 'e', 'e' || chr(769)))) AS text_md5 FROM documents")
def unicode_nfc(spark, sf_dir):
    apart = docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit("e"), F.lit("e\u0301")).alias("text"))
    return reading.normalise(apart).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@register("standard_fonts", "SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 2) THEN true ELSE false END AS standard FROM documents")
def standard_fonts(spark, sf_dir):
    name = F.element_at(F.array(*map(F.lit, ("ABCDEF+Arial", "XY+TIMES-ROMAN", "MySymbolFont", "Times New Roman"))), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", reading.standard_font(name).alias("standard"))


@register("object_summary", f"WITH {OBJECTS} SELECT doc_id, page_index, {', '.join(f'count(*) FILTER (type = {i}) AS {k}' for k, i in reading.OBJECTS.items())} FROM objects GROUP BY ALL")
def object_summary(spark, sf_dir):
    return reading.object_summary(objects(spark, sf_dir))


@register("image_filters", f"WITH {OBJECTS} SELECT doc_id, coalesce(filters[1], 'none') AS filter, count(*) AS n, sum(n_bytes)::BIGINT AS n_bytes FROM objects WHERE type = 3 GROUP BY ALL")
def image_filters(spark, sf_dir):
    return reading.image_filters(objects(spark, sf_dir))


@register("form_fields", f"WITH {ANNOTATIONS} SELECT doc_id, page_index, flags & 1 <> 0 AS read_only, flags & 2 <> 0 AS required FROM ann WHERE type = 'WIDGET'")
def form_fields(spark, sf_dir):
    return reading.form_fields(annotations(spark, sf_dir)).select("doc_id", "page_index", "read_only", "required")


@register("overlay_pages", f"WITH {NPAGES} SELECT doc_id, (page_index + least(page_index, n // 2))::INT AS out_index, false AS overlay, page_index FROM np UNION ALL SELECT doc_id, (2 * page_index + 1)::INT, true, page_index FROM np WHERE page_index < n // 2")
def overlay_pages(spark, sf_dir):
    p = page_numbers(spark, sf_dir)
    half = p.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.explode(F.sequence(F.lit(0), (F.col("n") / 2).cast("int"))).alias("page_index"), "n").filter("page_index < n div 2").drop("n")
    return reading.insert_overlays(p, half)


@register("annotation_json", f"WITH {ANNOTATIONS}, n AS (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY doc_id) SELECT doc_id, (page_index + 1)::INT AS page_index, type, contents, x, height FROM ann JOIN n USING (doc_id) WHERE page_index + 1 < n")
def annotation_json(spark, sf_dir):
    """Every annotation, exported a page further on and imported again: those of last pages fall off."""
    moved = annotations(spark, sf_dir).withColumn("page_index", F.col("page_index") + 1)
    counts = page_numbers(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    return reading.annotations_from_json(reading.annotations_json(moved), counts).select("doc_id", "page_index", "type", "contents", "x", "height")


@register(
    "attachments_edit",
    f"""WITH {LINES}, a AS (SELECT doc_id, line_index AS place, split_part(text, ' ', 1) AS name FROM lines WHERE line_index <> 1
    UNION ALL SELECT doc_id, max(line_index) + 1, 'notes.txt' FROM lines GROUP BY doc_id)
    SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1)::INT AS place, name FROM a""",
)
def attachments_edit(spark, sf_dir):
    """Lines as attachments, named by their first words: one is added to each document, the second is deleted."""
    have = lines_of(spark, sf_dir).select("doc_id", F.col("line_index").alias("place"), F.split_part("text", F.lit(" "), F.lit(1)).alias("name"), F.length("text").alias("size"))
    ids = have.filter("place = 0").select("doc_id")
    more = reading.add_attachments(have, ids.withColumns({"name": F.lit("notes.txt"), "size": F.lit(1)}))
    return reading.delete_attachments(more, have.filter("place = 1").select("doc_id", "place")).select("doc_id", "place", "name")


@register("destinations_find", f"WITH {PAGES} SELECT doc_id, CASE WHEN max(page_index) >= 1 THEN 1 ELSE -1 END::INT AS page_index FROM pages_ GROUP BY doc_id")
def destinations_find(spark, sf_dir):
    p = page_numbers(spark, sf_dir)
    named = p.withColumn("name", F.concat(F.lit("p"), F.col("page_index").cast("string")))
    return reading.find_destinations(p.filter("page_index = 0"), named, "p1")
