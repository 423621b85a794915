"""Queries of annotations, forms, bookmarks, geometry and exchange formats.

The given tables hold none of these, so they are laid out here from documents' pages by fixed arithmetic: real rows for
every operator, which SQL can lay out in the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import scalars
from papyra.operators import analytics, compose, detect, layout, objects, redact, web
from papyra.plans.catalogue import NPAGES, PAGES, SHEETS, docs, page_numbers, register, sheets
from papyra.sources import files

TYPES = ["TEXT", "LINK", "HIGHLIGHT", "WIDGET"]


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, p = F.col("doc_id"), F.col("page_index")
    return page_numbers(spark, sf_dir).select(
        "doc_id", "page_index", F.lit(0).alias("annotation"), F.element_at(F.array(*map(F.lit, TYPES)), (d % 4 + 1).cast("int")).alias("type"), ((d + p) % 8).cast("int").alias("flags"),
        (d % 100).cast("double").alias("x"), (p * 10).cast("double").alias("y"), (d % 7 + 1).cast("double").alias("width"), (d % 5 + 1).cast("double").alias("height"),
        F.when(d % 3 == 0, F.concat(F.lit("[OCG:L"), (d % 2).cast("string"), F.lit("] a<b"))).otherwise(F.lit("note & more")).alias("contents"),
    )


ANNOTATIONS = PAGES + """, ann AS (SELECT doc_id, page_index, ['TEXT', 'LINK', 'HIGHLIGHT', 'WIDGET'][(doc_id % 4 + 1)::INT] AS type, ((doc_id + page_index) % 8)::INT AS flags,
  (doc_id % 100)::DOUBLE AS x, (page_index * 10)::DOUBLE AS y, (doc_id % 7 + 1)::DOUBLE AS width, (doc_id % 5 + 1)::DOUBLE AS height,
  CASE WHEN doc_id % 3 = 0 THEN '[OCG:L' || (doc_id % 2) || '] a<b' ELSE 'note & more' END AS contents FROM pages_)"""
LAYER = "CASE WHEN starts_with(contents, '[OCG:') THEN regexp_extract(contents, '^\\[OCG:([^\\]]*)\\]', 1) END"


@register("annotation_stats", f"WITH {ANNOTATIONS} SELECT type, count(*) AS n, count(DISTINCT doc_id || '/' || page_index) AS pages, sum(width * height) AS area, round(avg(width * height), 6) AS mean_area FROM ann GROUP BY type")
def annotation_stats(spark, sf_dir):
    return analytics.annotation_stats(annotations(spark, sf_dir)).withColumn("mean_area", F.round("mean_area", 6))


@register("annotation_flags", f"WITH {ANNOTATIONS} SELECT doc_id, page_index, flags & 4 <> 0 AS printable, flags & 2 <> 0 AS hidden FROM ann")
def annotation_flags(spark, sf_dir):
    return annotations(spark, sf_dir).select("doc_id", "page_index", objects.printable(F.col("flags")).alias("printable"), objects.hidden(F.col("flags")).alias("hidden"))


@register("selective_flatten", f"WITH {ANNOTATIONS} SELECT doc_id, page_index, type, type NOT IN ('LINK', 'WIDGET') AS flat FROM ann")
def selective_flatten(spark, sf_dir):
    return objects.flatten_except(annotations(spark, sf_dir), ["LINK", "WIDGET"]).select("doc_id", "page_index", "type", "flat")


@register("layers", f"WITH {ANNOTATIONS}, l AS (SELECT doc_id, {LAYER} AS layer FROM ann) SELECT doc_id, layer, count(*) AS n FROM l WHERE layer IS NOT NULL GROUP BY ALL")
def layers(spark, sf_dir):
    return annotations(spark, sf_dir).select("doc_id", objects.layer(F.col("contents")).alias("layer")).filter("layer is not null").groupBy("doc_id", "layer").agg(F.count("*").alias("n"))


@register("layer_hidden", f"WITH {ANNOTATIONS} SELECT doc_id, page_index, CASE WHEN {LAYER} = 'L1' THEN flags | 2 ELSE flags END AS flags FROM ann")
def layer_hidden(spark, sf_dir):
    return objects.show_layer(annotations(spark, sf_dir), "L1", False).select("doc_id", "page_index", "flags")


@register("links_at_point", f"WITH {ANNOTATIONS} SELECT doc_id, page_index FROM ann WHERE type = 'LINK' AND x <= 5 AND 5 <= x + width AND y <= 3 AND 3 <= y + height")
def links_at_point(spark, sf_dir):
    return objects.at_point(annotations(spark, sf_dir).filter("type = 'LINK'"), 5.0, 3.0).select("doc_id", "page_index")


@register("annotation_names", f"WITH {ANNOTATIONS} SELECT doc_id, page_index, CASE flags WHEN 1 THEN 'TEXT' WHEN 2 THEN 'LINK' ELSE 'UNKNOWN' END AS name FROM ann")
def annotation_names(spark, sf_dir):
    names = spark.createDataFrame([(1, "TEXT"), (2, "LINK")], "code int, name string")
    return objects.named(annotations(spark, sf_dir), names, "flags").select("doc_id", "page_index", "name")


@register("xfdf_round_trip", f"WITH {ANNOTATIONS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY page_index) - 1)::INT AS annotation, lower(type) AS type, page_index, contents FROM ann")
def xfdf_round_trip(spark, sf_dir):
    return objects.from_xfdf(objects.xfdf(annotations(spark, sf_dir)))


@register("region_redaction", f"WITH {ANNOTATIONS}, o AS (SELECT *, greatest(0, least(x + width, 50.0) - greatest(x, 0.0)) * greatest(0, least(y + height, 4.0) - greatest(y, 0.0)) AS shared FROM ann) SELECT doc_id, page_index, shared > 0.7 * width * height AS removed FROM o")
def region_redaction(spark, sf_dir):
    box = {"x": F.col("x"), "y": F.col("y"), "w": F.col("width"), "h": F.col("height")}
    region = {k: F.lit(v) for k, v in (("x", 0.0), ("y", 0.0), ("w", 50.0), ("h", 4.0))}
    return annotations(spark, sf_dir).select("doc_id", "page_index", redact.region_hit(box, region).alias("removed"))


@register("sanitise_audit", f"WITH {ANNOTATIONS} SELECT doc_id, type AS kind, count(*) AS n FROM ann WHERE type IN ('WIDGET', 'TEXT') GROUP BY ALL")
def sanitise_audit(spark, sf_dir):
    return redact.sanitise(annotations(spark, sf_dir).withColumnRenamed("type", "kind"), ["WIDGET", "TEXT"])[1]


def fields(spark, sf_dir):
    d = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", F.lit("f").alias("name"), F.element_at(F.array(*map(F.lit, ["TEXT", "CHECKBOX", "COMBO"])), (d % 3 + 1).cast("int")).alias("type"), F.when(d % 5 == 0, 1).otherwise(0).alias("flags"), F.lit("old").alias("value"), F.array(F.lit("Yes"), F.lit("No")).alias("options"))


_FIELDS = "f AS (SELECT doc_id, ['TEXT', 'CHECKBOX', 'COMBO'][(doc_id % 3 + 1)::INT] AS type, doc_id % 5 = 0 AS locked, CASE WHEN doc_id % 2 = 0 THEN 'yes' ELSE 'other' END AS new FROM documents), g AS (SELECT *, CASE type WHEN 'TEXT' THEN new WHEN 'CHECKBOX' THEN CASE WHEN new = 'yes' THEN 'Yes' ELSE 'Off' END ELSE CASE WHEN new = 'yes' THEN 'Yes' END END AS put FROM f)"


def values(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.lit("f").alias("name"), F.when(F.col("doc_id") % 2 == 0, "yes").otherwise("other").alias("value"))


@register("form_filled", f"WITH {_FIELDS} SELECT doc_id, type, CASE WHEN NOT locked AND put IS NOT NULL THEN put ELSE 'old' END AS value, NOT locked AND put IS NOT NULL AS filled FROM g")
def form_filled(spark, sf_dir):
    return objects.fill_form(fields(spark, sf_dir), values(spark, sf_dir))[0].select("doc_id", "type", "value", "filled")


@register("form_skipped", f"WITH {_FIELDS} SELECT doc_id, new AS value FROM g WHERE locked OR put IS NULL")
def form_skipped(spark, sf_dir):
    return objects.fill_form(fields(spark, sf_dir), values(spark, sf_dir))[1].select("doc_id", "value")


@register("bookmark_tree", f"WITH {PAGES}, np AS (SELECT doc_id, count(*) AS n FROM pages_ GROUP BY doc_id) SELECT doc_id, page_index::BIGINT AS node_id, page_index::INT AS depth, n - 1 - page_index AS n_below FROM pages_ JOIN np USING (doc_id)")
def bookmark_tree(spark, sf_dir):
    p = page_numbers(spark, sf_dir)
    nodes = p.select("doc_id", F.col("page_index").cast("long").alias("node_id"), F.when(F.col("page_index") > 0, F.col("page_index") - 1).cast("long").alias("parent_id"))
    return objects.bookmark_tree(nodes).select("doc_id", "node_id", "depth", "n_below")


@register("page_labels", f"WITH {PAGES} SELECT doc_id, page_index, CASE WHEN page_index % 2 = 1 THEN 'p' || page_index ELSE '' END AS label FROM pages_")
def page_labels(spark, sf_dir):
    p = page_numbers(spark, sf_dir)
    return objects.page_labels(p, p.filter("page_index % 2 = 1").withColumn("label", F.concat(F.lit("p"), F.col("page_index").cast("string"))))


@register("metadata_stripped", "SELECT doc_id, ['Producer'] AS keys FROM documents")
def metadata_stripped(spark, sf_dir):
    m = F.create_map(*[F.lit(x) for k in ("Author", "Title", "Producer") for x in (k, "v")])
    return docs(spark, sf_dir).select("doc_id", F.map_keys(objects.strip_metadata(m, ["Author", "Title"])).alias("keys"))


@register("image_dpi", f"WITH {SHEETS} SELECT doc_id, page_index, round(width * 72 / 144, 4) AS dpi_x, round(height * 72 / 144, 4) AS dpi_y, greatest(width, height) * 72 / 144 > 300 AS over FROM sheets")
def image_dpi(spark, sf_dir):
    images = sheets(spark, sf_dir).select("doc_id", "page_index", F.col("width").alias("px_width"), F.col("height").alias("px_height"), F.lit(144.0).alias("pt_width"), F.lit(144.0).alias("pt_height"))
    return analytics.image_dpi(images).select("doc_id", "page_index", F.round("dpi_x", 4).alias("dpi_x"), F.round("dpi_y", 4).alias("dpi_y"), "over")


@register("font_audit", f"WITH {PAGES}, f AS (SELECT 'Font' || (doc_id % 5) AS name, page_index FROM pages_) SELECT name, list_sort(list(DISTINCT page_index))::INT[] AS pages FROM f GROUP BY name")
def font_audit(spark, sf_dir):
    used = page_numbers(spark, sf_dir).select(F.concat(F.when(F.col("doc_id") % 2 == 0, "ABCDEF+").otherwise(""), F.lit("Font"), (F.col("doc_id") % 5).cast("string")).alias("name"), "page_index", F.lit(True).alias("embedded"))
    return analytics.font_audit(used).select("name", "pages")


@register("compression_saved", "SELECT doc_id, greatest(n_chars - doc_id, 0)::BIGINT AS saved FROM documents")
def compression_saved(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", analytics.saved(F.col("n_chars"), F.col("doc_id")).cast("long").alias("saved"))


@register("response_status", "SELECT page_id, CASE WHEN NOT (starts_with(url, 'http://') OR starts_with(url, 'https://')) THEN 'INVALID_URL' WHEN page_id % 6 = 0 THEN 'ERROR' WHEN page_id % 6 = 1 THEN 'TIMEOUT' WHEN page_id % 6 = 2 THEN 'VALID' WHEN page_id % 6 = 3 THEN 'REDIRECT' ELSE 'BROKEN' END AS status FROM pages")
def response_status(spark, sf_dir):
    code = F.element_at(F.array(*[F.lit(c) for c in (None, -1, 200, 301, 404, 500)]), (F.col("page_id") % 6 + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", web.status(F.col("url"), code).alias("status"))


@register("split_at_bookmarks", f"WITH {PAGES} SELECT doc_id, page_index, ((page_index + 1) // 2)::INT AS part FROM pages_")
def split_at_bookmarks(spark, sf_dir):
    p = page_numbers(spark, sf_dir)
    return compose.split_at(p, p.filter("page_index % 2 = 1"))


@register("extract_pages", f"WITH {PAGES} SELECT doc_id, page_index FROM pages_ WHERE page_index IN (0, 2)")
def extract_pages(spark, sf_dir):
    return compose.extract(page_numbers(spark, sf_dir), [2, 0, 2])


@register("extract_range", f"WITH {PAGES} SELECT doc_id, page_index FROM pages_ WHERE page_index BETWEEN 1 AND 2")
def extract_range(spark, sf_dir):
    return compose.extract_range(page_numbers(spark, sf_dir), 1, 2)


@register("swap_pages", f"WITH {NPAGES} SELECT doc_id, page_index, CASE WHEN n < 2 THEN page_index WHEN page_index = 0 THEN 1 WHEN page_index = 1 THEN 0 ELSE page_index END::INT AS new_index FROM np")
def swap_pages(spark, sf_dir):
    return compose.swap(page_numbers(spark, sf_dir), 0, 1)


@register("mirrored", f"WITH {SHEETS} SELECT doc_id, page_index, [-1.0, 0, 0, 1, width, 0]::DOUBLE[] AS matrix FROM sheets")
def mirrored(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", "page_index", compose.mirror(F.col("width"), F.col("height")).alias("matrix"))


@register("unrotated", f"WITH {SHEETS} SELECT doc_id, page_index, CASE doc_id % 4 WHEN 1 THEN [0, -1, 1, 0, 0, width] WHEN 2 THEN [-1, 0, 0, -1, width, height] WHEN 3 THEN [0, 1, -1, 0, height, 0] END::DOUBLE[] AS matrix FROM sheets")
def unrotated(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", "page_index", compose.unrotate(F.col("doc_id") % 4, F.col("width"), F.col("height")).alias("matrix"))


@register("page_sizes", f"WITH {PAGES} SELECT doc_id, page_index, 612 AS width, 792 AS height FROM pages_")
def page_sizes(spark, sf_dir):
    return page_numbers(spark, sf_dir).select("doc_id", "page_index", F.lit(layout.WIDTH).alias("width"), F.lit(layout.PAGE_HEIGHT).alias("height"))


@register("html_web_links", "SELECT page_id AS doc_id, 0::BIGINT AS start, length(url)::BIGINT AS \"end\", url AS text FROM pages WHERE regexp_matches(url, '^https?://[^\\s<>\"]+$')")
def html_web_links(spark, sf_dir):
    return web.web_links(spark.read.parquet(f"{sf_dir}/pages.parquet").select(F.col("page_id").alias("doc_id"), F.col("url").alias("text")))


@register("truth_values", "SELECT doc_id, doc_id % 4 IN (0, 1) AS truth FROM documents")
def truth_values(spark, sf_dir):
    given = F.element_at(F.array(F.lit(" YES "), F.lit("on"), F.lit("off"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int"))
    return docs(spark, sf_dir).select("doc_id", scalars.truthy(given).alias("truth"))


@register("ligatures", "SELECT doc_id, md5(replace(text, 'fi', 'fi')) AS text_md5 FROM documents")
def ligatures(spark, sf_dir):
    joined = F.replace("text", F.lit("fi"), F.lit("ﬁ"))
    return docs(spark, sf_dir).select("doc_id", F.md5(scalars.decompose_ligatures(joined).cast("binary")).alias("text_md5"))


@register("tables_csv")
def tables_csv(spark, sf_dir):
    return files.csv_text(detect.page_tables(layout.pages(docs(spark, sf_dir))))


@register("tables_json")
def tables_json(spark, sf_dir):
    return files.json_text(detect.page_tables(layout.pages(docs(spark, sf_dir))))


@register("stats_report")
def stats_report(spark, sf_dir):
    return files.report(analytics.stats(docs(spark, sf_dir)))
