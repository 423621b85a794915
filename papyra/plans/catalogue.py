"""Every registered query of the document operators, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.functions import scalars
from papyra.functions.patterns import PATTERNS
from papyra.operators import analytics, compare, compose, detect, layout, redact, web
from papyra.sources import files
from papyra.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

LINES = """lines AS (SELECT doc_id, lang, (i - 1)::INT AS line_index, t[i] AS text, ((i - 1) // 40)::INT AS page_index, 720 - 14 * ((i - 1) % 40) AS y
  FROM (SELECT doc_id, lang, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS t FROM documents)))"""
PAGES = LINES + ", pages_ AS (SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY line_index) AS text, count(*) AS n_lines FROM lines GROUP BY ALL)"


def _spans(table: str, keys: str, pattern: str, text: str = "text") -> str:
    """SELECT of keys, k (from 1), m (match) and s (start) of all matches."""
    p = pattern.replace("'", "''")
    return f"""SELECT {keys}, k, m[k] AS m, (list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0))::BIGINT AS s
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT *, regexp_extract_all({text}, '{p}') AS m, regexp_split_to_array({text}, '{p}') AS g FROM {table}))"""


WORDS = LINES + f", words AS (SELECT doc_id, line_index, page_index, y, (k - 1)::INT AS word_index, m AS text, (72 + 6 * s)::INT AS x FROM ({_spans('lines', 'doc_id, line_index, page_index, y', '[^ ' + chr(92) + 'n' + chr(92) + 't' + chr(92) + 'r]+')}))"
MATCHES = "matches AS (" + " UNION ALL ".join(f"SELECT doc_id, lang, '{k}' AS category, s AS start, s + length(m) AS end_, m AS text FROM ({_spans('documents', 'doc_id, lang', p)})" for k, p in PATTERNS.items()) + ")"
_DIGITS = "list_transform(regexp_extract_all(reverse(regexp_replace(text, '[ -]', '', 'g')), '[0-9]'), lambda c, i: CASE WHEN i % 2 = 0 THEN (c::INT * 2) // 10 + (c::INT * 2) % 10 ELSE c::INT END)"
KEPT = f"{MATCHES}, kept AS (SELECT * FROM matches WHERE category <> 'credit_card' OR (length(regexp_replace(text, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND list_sum({_DIGITS}) % 10 = 0))"
NPAGES = PAGES + ", np AS (SELECT doc_id, page_index, count(*) OVER (PARTITION BY doc_id) AS n FROM pages_)"


def register(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return query

    return put


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.documents(spark, f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pages(docs(spark, sf_dir)).select("doc_id", "page_index")


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with sizes that vary with the document, for geometry."""
    return page_numbers(spark, sf_dir).withColumns({"width": (F.lit(400.0) + F.col("doc_id") % 900), "height": (F.lit(500.0) + (F.col("doc_id") * 7) % 1300)})


SHEETS = PAGES + ", sheets AS (SELECT doc_id, page_index, 400.0::DOUBLE + doc_id % 900 AS width, 500.0::DOUBLE + (doc_id * 7) % 1300 AS height FROM pages_)"


# -- layout


@register("text_lines", f"WITH {LINES} SELECT doc_id, page_index, line_index, text, y::INT AS y, (6 * length(text))::INT AS width FROM lines")
def text_lines(spark, sf_dir):
    return layout.lines(docs(spark, sf_dir)).select("doc_id", "page_index", "line_index", "text", "y", "width")


@register("text_words", f"WITH {WORDS} SELECT doc_id, page_index, line_index, word_index, text, x, y::INT AS y FROM words")
def text_words(spark, sf_dir):
    return layout.words(docs(spark, sf_dir), "page_index", "line_index", "word_index", "text", "x", "y")


@register("char_histogram", "SELECT c AS char, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c NOT IN ('', chr(10)) GROUP BY c")
def char_histogram(spark, sf_dir):
    return layout.chars(docs(spark, sf_dir)).groupBy("char").agg(F.count("*").alias("n"))


@register("page_text", f"WITH {PAGES} SELECT doc_id, page_index, md5(text) AS text_md5, n_lines::INT AS n_lines FROM pages_")
def page_text(spark, sf_dir):
    return layout.pages(docs(spark, sf_dir)).select("doc_id", "page_index", F.md5(F.col("text").cast("binary")).alias("text_md5"), "n_lines")


@register("blank_pages", f"WITH {PAGES} SELECT doc_id, page_index, length(text) = 0 AS blank FROM pages_")
def blank_pages(spark, sf_dir):
    return detect.blank_pages(layout.pages(docs(spark, sf_dir))).select("doc_id", "page_index", "blank")


@register("crop_bounds", f"WITH {WORDS} SELECT doc_id, page_index, min(x) AS \"left\", min(y)::INT AS bottom, max(x + 6 * length(text))::INT AS \"right\", max(y + 12)::INT AS top FROM words GROUP BY ALL")
def crop_bounds(spark, sf_dir):
    return detect.crop_bounds(layout.words(docs(spark, sf_dir), *detect.BOX))


@register("crop_uniform", f"WITH {WORDS}, b AS (SELECT doc_id, min(x) AS l, min(y) AS b, max(x + 6 * length(text)) AS r, max(y + 12) AS t FROM words GROUP BY ALL) SELECT doc_id, greatest(l - 10, 0)::DOUBLE AS \"left\", greatest(b - 10, 0)::DOUBLE AS bottom, (r + 10)::DOUBLE AS \"right\", (t + 10)::DOUBLE AS top FROM b")
def crop_uniform(spark, sf_dir):
    out = detect.uniform_crop(detect.crop_bounds(layout.words(docs(spark, sf_dir), *detect.BOX)), 10.0)
    return out.select("doc_id", *[F.col(c).cast("double").alias(c) for c in ("left", "bottom", "right", "top")])


@register(
    "column_gutters",
    f"""WITH {WORDS}, bins AS (SELECT DISTINCT doc_id, page_index, greatest(0, least(305, floor((x + 6 * (j - 1) + 3) / 2.0)::INT)) AS bin FROM (SELECT *, unnest(range(1, length(text) + 1)) AS j FROM words)),
    gaps AS (SELECT *, lag(bin, 1, -1) OVER (PARTITION BY doc_id, page_index ORDER BY bin) + 1 AS first FROM bins)
    SELECT doc_id, page_index, first * 2.0::DOUBLE AS start, bin * 2.0::DOUBLE AS "end" FROM gaps WHERE (bin - first) * 2 >= 20 AND first + bin > 20 AND first + bin < 592""",
)
def column_gutters(spark, sf_dir):
    return detect.gutters(layout.chars(docs(spark, sf_dir)))


@register("toc_headings", f"WITH {LINES} SELECT doc_id, page_index, trim(text, ' ') AS title FROM lines WHERE line_index = 0 AND length(trim(text, ' ')) > 1")
def toc_headings(spark, sf_dir):
    return detect.headings(layout.lines(docs(spark, sf_dir))).select("doc_id", "page_index", "title")


@register("toc_layout", f"WITH {LINES}, h AS (SELECT doc_id, trim(text, ' ') AS t FROM lines WHERE line_index = 0 AND length(trim(text, ' ')) > 1), s AS (SELECT doc_id, CASE WHEN length(t) > 60 THEN t[1:57] || '...' ELSE t END AS t FROM h) SELECT doc_id, t || ' ' || repeat('.', greatest(1, 70 - length(t) - 1)) || ' 2' AS line FROM s")
def toc_layout(spark, sf_dir):
    return detect.contents(detect.headings(layout.lines(docs(spark, sf_dir)))).select("doc_id", "line")


@register("structure_tags", f"WITH {WORDS}, f AS (SELECT *, CASE WHEN line_index = 0 THEN 18 ELSE 12 END AS size FROM words), m AS (SELECT doc_id, page_index, list_sort(list(size))[(count(*) // 2 + 1)::INT] AS med FROM f GROUP BY ALL), l AS (SELECT DISTINCT doc_id, page_index, line_index, size FROM f) SELECT doc_id, line_index, CASE WHEN size / med >= 2 THEN 'H1' WHEN size / med >= 1.6 THEN 'H2' WHEN size / med >= 1.3 THEN 'H3' ELSE 'P' END AS tag FROM l JOIN m USING (doc_id, page_index)")
def structure_tags(spark, sf_dir):
    return detect.tags(layout.words(docs(spark, sf_dir), "page_index", "line_index", "font_size"))


@register("page_tables")
def page_tables(spark, sf_dir):
    return detect.page_tables(layout.pages(docs(spark, sf_dir)))


@register("reading_order")
def reading_order(spark, sf_dir):
    return detect.reading_order(layout.lines(docs(spark, sf_dir)))


# -- statistics


_WORDS_RE = "[^ " + chr(92) + "n" + chr(92) + "t" + chr(92) + "r]+"


@register("document_stats", f"SELECT doc_id, length(text)::BIGINT AS n_chars, len(regexp_extract_all(text, '{_WORDS_RE}'))::BIGINT AS n_words, len(string_split(text, chr(10)))::BIGINT AS n_lines, len(regexp_extract_all(text, '{_WORDS_RE}')) / 250.0::DOUBLE AS minutes FROM documents")
def document_stats(spark, sf_dir):
    return analytics.stats(docs(spark, sf_dir))


@register("document_audit", f"WITH {PAGES} SELECT doc_id, count(*) AS n_pages, count(*) FILTER (length(text) > 0) AS n_text, count(*) FILTER (text = '') AS n_blank, count(*) - count(*) FILTER (length(text) > 0) - count(*) FILTER (text = '') AS n_scanned FROM pages_ GROUP BY doc_id")
def document_audit(spark, sf_dir):
    return analytics.audit(layout.pages(docs(spark, sf_dir)))


@register("font_usage", f"WITH {WORDS} SELECT doc_id, font_size, n_chars, row_number() OVER (PARTITION BY doc_id ORDER BY n_chars DESC, font_size)::INT AS rank FROM (SELECT doc_id, CASE WHEN line_index = 0 THEN 18 ELSE 12 END::INT AS font_size, sum(length(text))::BIGINT AS n_chars FROM words GROUP BY ALL)")
def font_usage(spark, sf_dir):
    return analytics.fonts(layout.words(docs(spark, sf_dir), "text", "font_size"))


@register("exact_duplicates", "SELECT sha256(text) AS text_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    return analytics.duplicates(docs(spark, sf_dir))


def page_hashes(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), analytics.average_hash(F.col("embedding")).alias("hash"))


_HASH = "h AS (SELECT vec_id AS id, list_transform(embedding, lambda x: (x::DOUBLE >= list_sum(list_transform(embedding, lambda y: y::DOUBLE)) / 64)::INT) AS bits FROM embeddings)"


@register("page_hash_bits", f"WITH {_HASH} SELECT id, list_sum(bits)::INT AS n_bits FROM h")
def page_hash_bits(spark, sf_dir):
    return page_hashes(spark, sf_dir).select("id", F.bit_count("hash").alias("n_bits"))


@register("hash_pairs", f"WITH {_HASH}, d AS (SELECT x.id AS a, y.id AS b, list_sum(list_transform(list_zip(x.bits, y.bits), lambda p: (p[1] <> p[2])::INT))::INT AS distance FROM h x JOIN h y ON x.id < y.id) SELECT * FROM d WHERE distance <= 5")
def hash_pairs(spark, sf_dir):
    return analytics.hash_pairs(page_hashes(spark, sf_dir))


@register("hash_clusters")
def hash_clusters(spark, sf_dir):
    return analytics.leader_clusters(table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("group"), F.col("vec_id").alias("id"), analytics.average_hash(F.col("embedding")).alias("hash")))


@register("human_sizes", "SELECT doc_id, CASE WHEN b < 1024 THEN b::VARCHAR || ' B' WHEN b < 1048576 THEN format('{:.1f} KB', round(b / 1024, 1)) ELSE format('{:.1f} MB', round(b / 1048576, 1)) END AS size FROM (SELECT doc_id, strlen(text) AS b FROM documents)")
def human_sizes(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", scalars.human_size(F.octet_length("text")).alias("size"))


@register("gray_levels", "SELECT doc_id, floor((doc_id % 256) * 0.2126 + (doc_id * 3 % 256) * 0.7152 + (doc_id * 7 % 256) * 0.0722 + 0.5)::BIGINT AS gray FROM documents")
def gray_levels(spark, sf_dir):
    d = F.col("doc_id")
    return docs(spark, sf_dir).select("doc_id", scalars.half_up(scalars.gray(d % 256, d * 3 % 256, d * 7 % 256)).alias("gray"))


# -- search, personal data, redaction


@register("pii_matches", f"WITH {KEPT} SELECT doc_id, category, start, end_ AS \"end\", text FROM kept")
def pii_matches(spark, sf_dir):
    return redact.matches(docs(spark, sf_dir))


@register("pii_counts", f"WITH {KEPT} SELECT category, lang, count(*) AS n, count(DISTINCT doc_id) AS docs FROM kept GROUP BY ALL")
def pii_counts(spark, sf_dir):
    return redact.matches(docs(spark, sf_dir), None, "lang").groupBy("category", "lang").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


@register("pii_rollup", f"WITH {KEPT} SELECT coalesce(category, 'all') AS category, coalesce(lang, 'all') AS lang, count(*) AS n FROM kept GROUP BY ROLLUP (category, lang)")
def pii_rollup(spark, sf_dir):
    rolled = redact.matches(docs(spark, sf_dir), None, "lang").rollup("category", "lang").agg(F.count("*").alias("n"))
    return rolled.select(F.coalesce("category", F.lit("all")).alias("category"), F.coalesce("lang", F.lit("all")).alias("lang"), "n")


@register("pii_ordered", f"WITH {KEPT} SELECT doc_id, category, start, row_number() OVER (PARTITION BY doc_id ORDER BY start, end_ DESC, category)::INT AS ord FROM kept")
def pii_ordered(spark, sf_dir):
    return redact.ordered(redact.matches(docs(spark, sf_dir))).select("doc_id", "category", "start", "ord")


@register("search_literal", f"SELECT doc_id, s AS start, length(m)::BIGINT AS length FROM ({_spans('documents', 'doc_id', 'the', 'lower(text)')})")
def search_literal(spark, sf_dir):
    return redact.search(docs(spark, sf_dir), "The")


@register("search_whole_word", f"SELECT doc_id, s AS start, length(m)::BIGINT AS length FROM ({_spans('documents', 'doc_id', chr(92) + 'band' + chr(92) + 'b', 'lower(text)')})")
def search_whole_word(spark, sf_dir):
    return redact.search(docs(spark, sf_dir), "and", whole_word=True)


@register("redact_words", r"SELECT doc_id, len(regexp_extract_all(text, '(?i)\b(?:license|the)\b'))::BIGINT AS n_redacted, md5(regexp_replace(regexp_replace(text, '(?i)\blicense\b', '#######', 'g'), '(?i)\bthe\b', '###', 'g')) AS text_md5 FROM documents")
def redact_words(spark, sf_dir):
    out = redact.redact(docs(spark, sf_dir), redact.word_pattern(["the", "license"], whole_word=True), "#")
    return out.select("doc_id", "n_redacted", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_REDACTED = rf"""
WITH found AS (SELECT doc_id, text, regexp_extract_all(text, '{PATTERNS["email"]}') || regexp_extract_all(text, '{PATTERNS["phone"]}') || regexp_extract_all(text, '{PATTERNS["ipv4"]}') AS p,
                      len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda x: x = 'the')) AS e FROM documents),
asked AS (SELECT *, list_distinct(['license'] || p || CASE WHEN e > 0 THEN ['the'] ELSE [] END) AS words FROM found),
longest AS (SELECT *, list_transform(list_sort(list_transform(words, lambda x: lpad((100000 - length(x))::VARCHAR, 6, '0') || x)), lambda y: regexp_replace(substr(y, 7), '([\\.\[\]{{}}()*+?^$|])', '\\\1', 'g')) AS parts FROM asked),
cut AS (SELECT *, '(?i)(?:' || array_to_string(parts, '|') || ')' AS pattern FROM longest),
split AS (SELECT *, regexp_extract_all(text, pattern) AS m, regexp_split_to_array(text, pattern) AS g FROM cut)
SELECT doc_id, array_to_string(list_transform(range(1, len(g) + 1), lambda i: g[i] || coalesce(repeat('#', length(m[i])), '')), '') AS text,
       len(m)::BIGINT AS n_words, len(p)::BIGINT AS n_patterns, e::BIGINT AS n_entities, (len(m) + len(p) + e)::BIGINT AS n_redactions
FROM split
"""


@register("redact_pipeline", _REDACTED)
def redact_pipeline(spark, sf_dir):
    options = redact.Options(words=("license",), categories=("email", "phone", "ipv4"), dictionary={"the": "ARTICLE"}, mask="#")
    return redact.run(docs(spark, sf_dir), options).drop("lang", "source", "n_chars")


@register("redact_commit", f"SELECT doc_id, len(m)::BIGINT AS n_committed, md5(regexp_replace(text, '[0-9]', '#', 'g')) AS text_md5 FROM (SELECT *, regexp_extract_all(text, '[0-9]+') AS m FROM documents)")
def redact_commit(spark, sf_dir):
    d = docs(spark, sf_dir)
    return redact.commit(d, redact.mark(d, "[0-9]+"), "#").select("doc_id", "n_committed", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_DICTIONARY = {"MIT License": "LICENCE", "Apache License": "LICENCE", "License": "WORD"}
_NER = "ner AS (SELECT doc_id, s AS start, s + length(m) AS end_, m FROM (" + _spans("documents", "doc_id", "(?:apache license|mit license|license)", "lower(text)") + "))"


@register("ner_matches", f"WITH {_NER} SELECT n.doc_id, start, end_ AS \"end\", CASE m WHEN 'license' THEN 'License' WHEN 'mit license' THEN 'MIT License' ELSE 'Apache License' END AS keyword FROM ner n JOIN documents d USING (doc_id) WHERE NOT regexp_matches(substr(lower(text), (start)::INT, 1), '[a-z0-9]') AND NOT regexp_matches(substr(lower(text), (end_ + 1)::INT, 1), '[a-z0-9]')")
def ner_matches(spark, sf_dir):
    return redact.entities(docs(spark, sf_dir), _DICTIONARY).select("doc_id", "start", "end", "keyword")


@register("coreferences")
def coreferences(spark, sf_dir):
    d = docs(spark, sf_dir)
    found = redact.entities(d, _DICTIONARY)
    return redact.coreferences(redact.sentences(d.join(found.select("doc_id").distinct(), "doc_id", "left_semi")), found)


# -- composition


@register("split_every", f"WITH {PAGES} SELECT doc_id, page_index, (page_index // 2)::INT AS part, page_index % 2 AS page_in_part FROM pages_")
def split_every(spark, sf_dir):
    return compose.split_every(page_numbers(spark, sf_dir), 2)


@register("merge_documents", f"WITH {PAGES} SELECT doc_id, page_index, row_number() OVER (ORDER BY doc_id, page_index) - 1 AS new_index FROM pages_")
def merge_documents(spark, sf_dir):
    return compose.merge(page_numbers(spark, sf_dir))


@register("reverse_pages", f"WITH {NPAGES} SELECT doc_id, page_index, n - 1 - page_index AS new_index FROM np")
def reverse_pages(spark, sf_dir):
    return compose.reverse(page_numbers(spark, sf_dir))


@register("move_range", f"WITH {NPAGES} SELECT doc_id, page_index, (CASE WHEN n <= 1 THEN page_index WHEN page_index <= 1 THEN least(1, n - 2) + page_index WHEN page_index - 2 >= least(1, n - 2) THEN page_index ELSE page_index - 2 END)::BIGINT AS new_index FROM np")
def move_range(spark, sf_dir):
    return compose.move_range(page_numbers(spark, sf_dir), 0, 1, 1).withColumn("new_index", F.col("new_index").cast("long"))


@register("interleave_reversed", f"WITH {NPAGES}, u AS (SELECT doc_id, page_index, 0 AS source, page_index AS i FROM np UNION ALL SELECT doc_id, page_index, 1, n - 1 - page_index FROM np) SELECT doc_id, page_index, source, (row_number() OVER (PARTITION BY doc_id ORDER BY i, source) - 1)::INT AS ord FROM u")
def interleave_reversed(spark, sf_dir):
    p = page_numbers(spark, sf_dir)
    return compose.interleave(p, p, reverse_second=True)


@register("booklet_order", f"WITH {NPAGES}, d AS (SELECT doc_id, max(n) AS n, (ceil(max(n) / 4.0) * 4)::BIGINT AS p FROM np GROUP BY doc_id), s AS (SELECT *, unnest(range(0, p // 4)) AS sheet FROM d), x AS (SELECT doc_id, n, sheet, 'front' AS side, 0 AS slot, p - 1 - 2 * sheet AS page FROM s UNION ALL SELECT doc_id, n, sheet, 'front', 1, 2 * sheet FROM s UNION ALL SELECT doc_id, n, sheet, 'back', 0, 2 * sheet + 1 FROM s UNION ALL SELECT doc_id, n, sheet, 'back', 1, p - 2 - 2 * sheet FROM s) SELECT doc_id, sheet, side, slot, CASE WHEN page < n THEN page END AS page_index FROM x")
def booklet_order(spark, sf_dir):
    return compose.booklet(page_numbers(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_pages")))


@register("nup_grid", f"WITH {PAGES} SELECT doc_id, page_index, (page_index // 4)::INT AS sheet, (page_index % 4 // 2)::INT AS \"row\", page_index % 2 AS col FROM pages_")
def nup_grid(spark, sf_dir):
    return compose.n_up(page_numbers(spark, sf_dir), 2, 2)


@register("posterize_tiles", f"""WITH {SHEETS}, g AS (SELECT *, greatest(ceil(width / 595), 1)::INT AS c, greatest(ceil(height / 842), 1)::INT AS r FROM sheets), t AS (SELECT *, (width + (c - 1) * 18) / c AS w, (height + (r - 1) * 18) / r AS h, unnest(range(0, c)) AS col FROM g), u AS (SELECT *, unnest(range(0, r)) AS "row" FROM t)
SELECT doc_id, page_index, "row"::INT AS "row", col::INT AS col, round(greatest(col * (w - 18), 0), 4) AS "left", round(height - "row" * (h - 18), 4) AS top, round(least(col * (w - 18) + w, width), 4) AS "right", round(greatest(height - "row" * (h - 18) - h, 0), 4) AS bottom FROM u""")
def posterize_tiles(spark, sf_dir):
    out = compose.posterize(sheets(spark, sf_dir))
    return out.select("doc_id", "page_index", "row", "col", *[F.round(c, 4).alias(c) for c in ("left", "top", "right", "bottom")])


@register("scale_to_fit", f"WITH {SHEETS}, s AS (SELECT *, least(595 / width, 842 / height) AS k FROM sheets) SELECT doc_id, page_index, round(k, 6) AS scale_x, round((595 - width * k) / 2, 6) AS offset_x, round((842 - height * k) / 2, 6) AS offset_y FROM s")
def scale_to_fit(spark, sf_dir):
    f = compose.fit(F.col("width"), F.col("height"), compose.PAPERS["A4"], "FIT_PAGE")
    return sheets(spark, sf_dir).select("doc_id", "page_index", *[F.round(f[c], 6).alias(c) for c in ("scale_x", "offset_x", "offset_y")])


@register("two_up_split", f"WITH {SHEETS} SELECT doc_id, page_index, 0 AS half, 0.0::DOUBLE AS \"left\", width / 2 AS \"right\", page_index * 2 AS new_index FROM sheets UNION ALL SELECT doc_id, page_index, 1, width / 2, width, page_index * 2 + 1 FROM sheets")
def two_up_split(spark, sf_dir):
    return compose.two_up_split(sheets(spark, sf_dir)).drop("width", "height")


@register("binding_margins", f"WITH {SHEETS} SELECT doc_id, page_index, width + 20 AS width, height, 20.0::DOUBLE AS shift_x, 0.0::DOUBLE AS shift_y FROM sheets")
def binding_margins(spark, sf_dir):
    return sheets(spark, sf_dir).select("doc_id", "page_index", *[c.alias(k) for k, c in compose.margins(20, 0, 0, 0).items()])


@register("bates_numbers", f"WITH {PAGES}, m AS (SELECT doc_id, page_index, row_number() OVER (ORDER BY doc_id, page_index) AS i FROM pages_) SELECT doc_id, page_index, 'DOC-' || CASE WHEN length(i::VARCHAR) >= 6 THEN i::VARCHAR ELSE lpad(i::VARCHAR, 6, '0') END AS bates FROM m")
def bates_numbers(spark, sf_dir):
    merged = compose.merge(page_numbers(spark, sf_dir))
    return merged.select("doc_id", "page_index", compose.bates("DOC-", 1, 6, F.col("new_index")).alias("bates"))


@register("header_template", f"WITH {NPAGES} SELECT doc_id, page_index, 'Page ' || (page_index + 1) || ' of ' || n || ' on 2024-01-31' AS header FROM np")
def header_template(spark, sf_dir):
    p = compose.with_count(page_numbers(spark, sf_dir))
    return p.select("doc_id", "page_index", compose.stamped("Page {page} of {pages} on {date}", F.col("page_index"), F.col("n_pages"), "2024-01-31").alias("header"))


@register("watermark_positions", f"WITH {SHEETS}, w AS (SELECT *, 5 * 24 * 0.5 AS t FROM sheets) SELECT doc_id, page_index, v || '_' || h AS position, CASE h WHEN 'LEFT' THEN 36.0 WHEN 'CENTER' THEN (width - t) / 2 ELSE width - t - 36 END::DOUBLE AS x, CASE v WHEN 'TOP' THEN height - 60 WHEN 'MIDDLE' THEN (height - 24) / 2 ELSE 36.0 END::DOUBLE AS y FROM w, (VALUES ('TOP'), ('MIDDLE'), ('BOTTOM')) a(v), (VALUES ('LEFT'), ('CENTER'), ('RIGHT')) b(h)")
def watermark_positions(spark, sf_dir):
    s = sheets(spark, sf_dir)
    places = [compose.anchor(p, F.col("width"), F.col("height"), F.lit("DRAFT"), 24.0) for p in compose.POSITIONS]
    rows = F.array(*[F.struct(F.lit(p).alias("position"), a["x"].cast("double").alias("x"), a["y"].cast("double").alias("y")) for p, a in zip(compose.POSITIONS, places, strict=True)])
    return s.select("doc_id", "page_index", F.inline(rows))


@register("long_images", f"WITH {SHEETS} SELECT doc_id, max(width)::BIGINT AS width, (sum(height) + 10 * (count(*) - 1))::BIGINT AS height, max(width)::BIGINT * (sum(height) + 10 * (count(*) - 1))::BIGINT <= 200000000 AS fits FROM sheets GROUP BY doc_id")
def long_images(spark, sf_dir):
    return compose.long_image(sheets(spark, sf_dir), 10)


# -- differences: each document against its normalised self


def _versions(spark, sf_dir):
    d = docs(spark, sf_dir)
    newer = d.filter("doc_id % 10 <> 3").withColumn("text", F.when(F.col("doc_id") % 10 == 4, F.regexp_replace("text", "the ", "")).otherwise(F.col("text")))
    return layout.pages(d), layout.pages(newer)


@register("page_changes", "WITH v AS (SELECT doc_id, string_split(text, chr(10)) AS a, CASE WHEN doc_id % 10 = 3 THEN NULL WHEN doc_id % 10 = 4 THEN string_split(regexp_replace(text, 'the ', '', 'g'), chr(10)) ELSE string_split(text, chr(10)) END AS b FROM documents), p AS (SELECT doc_id, unnest(range(0, (len(a) - 1) // 40 + 1)) AS i, a, b FROM v) SELECT doc_id, i::INT AS page_index, CASE WHEN b IS NULL THEN 'PAGE_REMOVED' ELSE 'CHANGED' END AS kind FROM p WHERE b IS NULL OR a[i * 40 + 1:i * 40 + 40] <> b[i * 40 + 1:i * 40 + 40]")
def page_changes(spark, sf_dir):
    return compare.page_changes(*_versions(spark, sf_dir)).select("doc_id", "page_index", "kind")


@register("line_changes")
def line_changes(spark, sf_dir):
    return compare.line_changes(*_versions(spark, sf_dir))


# -- HTML


@register("html_links", """SELECT page_id, (k - 1)::INT AS link, m[k] AS href FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1) AS m FROM pages))""")
def html_links(spark, sf_dir):
    return web.links(table(spark, sf_dir, "pages"))


@register("html_link_status", """SELECT CASE WHEN starts_with(h, 'http://') OR starts_with(h, 'https://') THEN 'VALID' ELSE 'INVALID_URL' END AS status, count(*) AS n FROM (SELECT unnest(list_append(regexp_extract_all(html, '<a\\s[^>]*href="([^"]*)"', 1), url)) AS h FROM pages) GROUP BY 1""")
def html_link_status(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    every = web.links(p).select(F.col("href").alias("url")).unionByName(p.select("url"))
    return web.link_report(every.select(web.status(F.col("url"), F.lit(200)).alias("status")))


@register("html_scripts", """SELECT page_id, len(m)::BIGINT AS n_scripts, coalesce(list_sum(list_transform(m, lambda x: length(x))), 0)::BIGINT AS n_chars FROM (SELECT page_id, regexp_extract_all(html, '(?s)<script[^>]*>(.*?)</script>', 1) AS m FROM pages)""")
def html_scripts(spark, sf_dir):
    return web.scripts(table(spark, sf_dir, "pages"))


@register("html_headings", """SELECT page_id, (k - 1)::INT AS ord, m[k][3:3]::INT AS level, regexp_replace(m[k], '<[^>]*>', '', 'g') AS title FROM (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM (SELECT page_id, regexp_extract_all(html, '(?s)<h[1-6][^>]*>.*?</h[1-6]>') AS m FROM pages))""")
def html_headings(spark, sf_dir):
    return web.headings(table(spark, sf_dir, "pages"))


# -- extensions


@register("event_windows", "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    out = ingest.windows(table(spark, sf_dir, "events"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


@register("event_sessions", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def event_sessions(spark, sf_dir):
    return ingest.sessions(table(spark, sf_dir, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
