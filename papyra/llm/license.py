"""License scans by diagonal voting. DataFrame functions only.

Every text's rolling word k-grams are hashed and joined with the templates' k-grams (a fixed, small table). A hit votes for
its diagonal, the document position less the template position; votes are summed for each (document, template, diagonal)
before they move, neighbouring diagonals (insertions or deletions of up to GAP words) are merged, and a span counts as
verified where the k-grams themselves, not only their hashes, agree for at least COVERAGE of the template's k-grams.

Base labels are places of whole phrases. Defined results: null and empty texts have no words, no labels and score 0; the
score is the best verified coverage, or 1 where a base phrase stands; every row is judged alone, whatever its doc_id; an
empty table gives no rows.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.llm.common import table, written

K = 4
GAP = 3
COVERAGE = 0.5
PHRASES = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: (template, label, text): public licence notices.
TEMPLATES = [
    ("mit-short", "mit", "released under the mit license"),
    ("mit-grant", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-short", "apache", "licensed under the apache license version 2 0"),
    ("apache-notice", "apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-short", "gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd-notice", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by-nc", "cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc-by-sa", "licensed under cc by sa 4 0"),
]


def words(text: Column) -> Column:
    """A-Z is lowered. lower() differs from that only within words and outside ASCII, but for two letters that it makes ASCII."""
    kept = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\ufffd")), F.lit("\u0130"), F.lit("\ufffd"))
    return F.regexp_extract_all(F.lower(kept), F.lit(WORD), F.lit(0))


def _places(w: Column, phrase: str, label: str) -> Column:
    """Where the phrase's words stand, as (start, label)."""
    parts = phrase.split()

    def fits(i: Column) -> Column:
        ok = F.get(w, i) == parts[0]
        for j, p in enumerate(parts[1:], 1):
            ok = ok & (F.get(w, i + j) == p)
        return ok

    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size(w) - len(parts), F.lit(0))), lambda i: F.coalesce(fits(i), F.lit(False)))
    return F.transform(at, lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label")))


def template_grams(spark: SparkSession) -> DataFrame:
    rows = [(name, label, i, *w[i : i + K], len(w) - K + 1) for name, label, text in TEMPLATES for w in [text.split()] for i in range(len(w) - K + 1)]
    grams = spark.createDataFrame(rows, f"template string, label string, t int, {', '.join(f'w{j} string' for j in range(K))}, grams int")
    return grams.select("template", "label", "t", "grams", F.xxhash64(*[f"w{j}" for j in range(K)]).alias("h"), F.concat_ws(" ", *[f"w{j}" for j in range(K)]).alias("known"))


def tokens(docs: DataFrame) -> DataFrame:
    """(row, doc_id, n_words, at, grams), written: base phrases' places, and the rolling k-grams whose hash some template has.

    Every text is cut into words once. Testing a hash against the templates' few here, and not after a join of all k-grams,
    leaves the same rows for the join.
    """
    known = [F.xxhash64(*map(F.lit, w[i : i + K])) for _, _, text in TEMPLATES for w in [text.split()] for i in range(len(w) - K + 1)]
    gram = lambda i: [F.get(F.col("w"), i + j) for j in range(K)]
    here = F.filter(F.sequence(F.lit(0), F.greatest(F.size("w") - K, F.lit(0))), lambda i: F.xxhash64(*gram(i)).isin(*known))
    grams = F.transform(here, lambda i: F.struct(i.alias("p"), F.xxhash64(*gram(i)).alias("h"), F.concat_ws(" ", *gram(i)).alias("gram")))
    none = F.array().cast("array<struct<start:bigint,label:string>>")
    at = F.when(F.array_contains("w", "license"), F.concat(*[_places(F.col("w"), p, label) for p, label in PHRASES])).otherwise(none)
    cut = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), words(F.col("text")).alias("w"))
    return written(cut.select("row", "doc_id", F.size("w").cast("long").alias("n_words"), at.alias("at"), grams.alias("grams")), "license-words")


def spans(cut: DataFrame) -> DataFrame:
    """(row, template, label, first, last, coverage): verified spans in words, of tokens()."""
    rolled = cut.select("row", F.inline("grams"))
    hits = rolled.join(F.broadcast(template_grams(cut.sparkSession)), "h").filter(F.col("gram") == F.col("known"))
    votes = hits.groupBy("row", "template", "label", "grams", (F.col("p") - F.col("t")).alias("d")).agg(F.min("p").alias("a"), F.max("p").alias("b"), F.collect_set("t").alias("ts"))
    order = W.partitionBy("row", "template").orderBy("d")
    fresh = F.coalesce((F.col("d") - F.lag("d").over(order) > GAP).cast("int"), F.lit(1))
    island = votes.withColumn("new", fresh).withColumn("island", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    merged = island.groupBy("row", "template", "label", "grams", "island").agg(F.min("a").alias("first"), (F.max("b") + K - 1).alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("seen"))
    return merged.select("row", "template", "label", "first", "last", (F.col("seen") / F.col("grams")).alias("coverage")).filter(F.col("coverage") >= COVERAGE)


def scan(docs: DataFrame) -> DataFrame:
    cut = tokens(docs)
    found = spans(cut).groupBy("row").agg(F.collect_set("label").alias("voted"), F.max("coverage").alias("best"))
    joined = cut.drop("grams").join(found, "row", "left")
    base = F.array_sort(F.array_distinct(F.col("at").getField("label")))
    everything = F.array_sort(F.array_union(base, F.coalesce("voted", F.array().cast("array<string>"))))
    score = F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        "doc_id",
        "n_words",
        F.size("at").cast("long").alias("n_base"),
        F.array_min(F.col("at").getField("start")).alias("first_word"),
        F.array_max(F.col("at").getField("start")).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(everything, ",").alias("labels"),
        F.round(score, 6).alias("score"),
    )


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _oracle() -> str:
    grams = ", ".join(f"('{name}', '{label}', {i}, '{' '.join(w[i : i + K])}', {len(w) - K + 1})" for name, label, text in TEMPLATES for w in [text.split()] for i in range(len(w) - K + 1))
    places = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS start, '{label}' AS label FROM spots WHERE " + " AND ".join(f"w[i + {j}] = '{p}'" for j, p in enumerate(phrase.split())) for phrase, label in PHRASES)
    return f"""
WITH tokens AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS w FROM documents),
spots AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM tokens),
places AS ({places}),
base AS (SELECT doc_id, count(*) AS n, min(start) AS f, max(start) AS l, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id),
templates(template, label, t, gram, grams) AS (VALUES {grams}),
votes AS (SELECT a.doc_id, template, label, grams, i - 1 - t AS d, list(t) AS ts FROM spots a JOIN templates ON gram = {" || ' ' || ".join(f"w[i + {j}]" for j in range(K))} GROUP BY ALL),
fresh AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) <= {GAP} THEN 0 ELSE 1 END AS new FROM votes),
islands AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, template ORDER BY d) AS island FROM fresh),
spans AS (SELECT doc_id, label, len(list_distinct(flatten(list(ts)))) / grams::DOUBLE AS coverage FROM islands GROUP BY doc_id, template, label, grams, island),
voted AS (SELECT doc_id, list(DISTINCT label) AS labels, max(coverage) AS best FROM spans WHERE coverage >= {COVERAGE} GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, f::BIGINT AS first_word, l::BIGINT AS last_word,
       array_to_string(coalesce(b.labels, []::VARCHAR[]), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []::VARCHAR[]), coalesce(v.labels, []::VARCHAR[])))), ',') AS labels,
       round(CASE WHEN n > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE, 6) AS score
FROM tokens LEFT JOIN base b USING (doc_id) LEFT JOIN voted v USING (doc_id)
"""


ORACLE = _oracle()
