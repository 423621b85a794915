"""Links, scripts and headings of HTML pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def links(pages: DataFrame) -> DataFrame:
    """(page_id, link, href)."""
    return pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(r'<a\s[^>]*href="([^"]*)"'), F.lit(1))).alias("link", "href"))


def web_links(text: DataFrame) -> DataFrame:
    """(doc_id, start, end, text) of absolute links in plain text."""
    from papyra.functions.scalars import match_spans

    return text.select("doc_id", F.explode(match_spans(F.col("text"), r"https?://[^\s<>\"]+")).alias("m")).select("doc_id", "m.*")


def valid(url: Column) -> Column:
    """Parsable with scheme http or https."""
    return F.coalesce(F.try_parse_url(url, F.lit("PROTOCOL")).isin("http", "https"), F.lit(False))


def status(url: Column, code: Column) -> Column:
    """What a response code says of a link; negative codes stand for time-outs and null for errors."""
    return F.when(~valid(url), "INVALID_URL").when(code.isNull(), "ERROR").when(code < 0, "TIMEOUT").when(code.between(200, 299), "VALID").when(code.between(300, 399), "REDIRECT").otherwise("BROKEN")


def link_report(links: DataFrame) -> DataFrame:
    """Counts by status of links (status)."""
    return links.groupBy("status").agg(F.count("*").alias("n"))


def scripts(pages: DataFrame) -> DataFrame:
    """(page_id, n_scripts, n_chars) of inline scripts."""
    body = F.regexp_extract_all("html", F.lit(r"(?s)<script[^>]*>(.*?)</script>"), F.lit(1))
    return pages.select("page_id", F.size(body).cast("long").alias("n_scripts"), F.aggregate(body, F.lit(0).cast("long"), lambda a, s: a + F.length(s)).alias("n_chars"))


def headings(pages: DataFrame) -> DataFrame:
    """(page_id, ord, level, title)."""
    found = F.regexp_extract_all("html", F.lit(r"(?s)<h([1-6])[^>]*>.*?</h[1-6]>"), F.lit(0))
    return pages.select("page_id", F.posexplode(found).alias("ord", "h")).select("page_id", "ord", F.substring("h", 3, 1).cast("int").alias("level"), F.regexp_replace("h", "<[^>]*>", "").alias("title"))
