"""Operators whose state SQL doesn't express, and vectors for scalars, on small tables worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from papyra.functions import patterns, scalars
from papyra.operators import analytics, compare, compose, detect, reading, redact
from papyra.streaming import ingest


@pytest.mark.parametrize("number, ok", [("4111111111111111", True), ("5500000000000004", True), ("340000000000009", True), ("6011000000000004", True), ("4111-1111-1111-1111", True), ("4111 1111 1111 1111", True), ("4111111111111112", False), ("1234567890123456", False), ("1234567890123457", False), ("42", False), ("4111.1111.1111.1111", False), (None, False)])
def test_luhn(spark, number, ok):
    assert spark.createDataFrame([(number,)], "n string").select(scalars.luhn(F.col("n"))).first()[0] is ok


@pytest.mark.parametrize("a, b, meet", [((0, 0, 5, 5), (5, 0, 5, 5), False), ((0, 0, 5, 5), (4.9, 0, 5, 5), True), ((0, 0, 5, 5), (2, 2, 0, 0), True)])
def test_rectangles(spark, a, b, meet):
    box = lambda r: dict(zip("xywh", map(F.lit, r), strict=True))
    assert spark.range(1).select(scalars.intersects(box(a), box(b))).first()[0] is meet


def test_match_spans_are_those_of_the_text(spark):
    text = "é 12 ab 3456 " * 700 + "\n7"
    rows = spark.createDataFrame([(text,), ("",), (None,), ("none",)], "t string").select("t", scalars.match_spans(F.col("t"), "[0-9]+").alias("m")).collect()
    assert len(rows[0].m) == 1401 and all(text[m.start : m.end] == m.text for m in rows[0].m)
    assert rows[1].m == rows[3].m == [] and rows[2].m is None


@pytest.mark.parametrize("category, yes, no", [("ssn", "123-45-6789", "123-45-678"), ("iban", "GB82WEST12345698765432", "G882"), ("passport", "AB1234567", "ABC1234567"), ("ipv6", "2001:db8:0:0:0:0:0:1", "2001:db8"), ("uk_nino", "AB123456C", "DQ123456C"), ("credit_card", "4111 1111 1111 1111", "4111 1111 1111 1112"), ("email", "a.b@c.org", "a.b@c"), ("date", "March 3, 2024", "Smarch 3")])
def test_categories(spark, category, yes, no):
    docs = spark.createDataFrame([(1, f"x {yes} y"), (2, f"x {no} y"), (3, None), (4, "")], "doc_id long, text string")
    found = redact.matches(docs, patterns.select(category)).collect()
    assert [(r.doc_id, r.start, r.text) for r in found] == [(1, 2, yes)]


def test_unknown_category():
    with pytest.raises(ValueError):
        patterns.select("shoe_size")
    with pytest.raises(ValueError):
        redact.Options(words=(" ", ""))


def test_line_script():
    assert compare.line_script(["a", "b"], ["a", "b"]) == []
    assert compare.line_script(["a", "b"], ["a", "c"]) == [("MODIFICATION", "b", "c")]
    assert compare.line_script(["a"], ["a", "b"]) == [("INSERTION", "", "b")]
    assert compare.line_script(["x", "a"], ["a", "y"]) == [("MODIFICATION", "x", "y")]  # the next edit, past the common line
    assert [s[0] for s in compare.line_script(["p", "q", "r"], [])] == ["DELETION"] * 3


def test_leader_clusters(spark):
    rows = [(1, 1, 0), (1, 2, 0b11111), (1, 3, 0b1111111111), (1, 4, 0b111111), (2, 9, 0)]
    got = {r.id: (r.leader, r.distance) for r in analytics.leader_clusters(spark.createDataFrame(rows, "group long, id long, hash long")).collect()}
    assert got == {1: (1, 0), 2: (1, 5), 3: (3, 0), 4: (3, 4), 9: (9, 0)}


def test_the_first_leader_wins_over_a_nearer_one(spark):
    rows = [(1, 1, 0), (1, 2, 0b11111111), (1, 3, 0b11111)]
    got = {r.id: r.leader for r in analytics.leader_clusters(spark.createDataFrame(rows, "group long, id long, hash long")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


WORD = "doc_id long, page_index int, text string, x double, y double, width double, height double"


def test_tables(spark):
    grid = [(1, 0, f"r{r}c{c}", 100.0 * c, 700.0 - 20 * r, 20.0, 10.0) for r in range(2) for c in range(3)]
    one_row = [(2, 0, f"w{c}", 100.0 * c, 700.0, 20.0, 10.0) for c in range(6)]
    one_column = [(3, 0, f"w{r}", 0.0, 700.0 - 20 * r, 20.0, 10.0) for r in range(6)]
    dense = [(4, 0, f"w{r}{c}", 30.0 * c, 700.0 - 20 * r, 20.0, 10.0) for r in range(2) for c in range(6)]  # no gap from edge to edge
    got = sorted(tuple(r) for r in detect.tables(spark.createDataFrame(grid + one_row + one_column + dense, WORD)).collect())
    assert got == [(1, 0, 0, ["r0c0", "r0c1", "r0c2"]), (1, 0, 1, ["r1c0", "r1c1", "r1c2"])]


def test_reading_order(spark):
    lines = [(1, 0, "foot", 72.0, 30.0, 400.0, 12.0), (1, 0, "body one", 72.0, 600.0, 400.0, 12.0), (1, 0, "body two", 72.0, 586.0, 380.0, 12.0), (1, 0, "body three", 72.0, 572.0, 400.0, 12.0), (1, 0, "head", 72.0, 760.0, 300.0, 12.0), (1, 0, "side", 550.0, 400.0, 50.0, 12.0), (1, 0, "caption", 200.0, 300.0, 200.0, 12.0), (1, 0, "", 72.0, 586.0, 0.0, 12.0)]
    got = [(r.kind, r.text) for r in detect.reading_order(spark.createDataFrame(lines, WORD)).orderBy("ord").collect()]
    assert got == [("HEADER", "head"), ("BODY", "body one\nbody two\nbody three"), ("SIDEBAR", "side"), ("CAPTION", "caption"), ("FOOTNOTE", "foot")]


def test_gutters(spark):
    chars = [(1, 0, 65, float(x)) for x in [*range(0, 200, 2), *range(300, 606, 2)]] + [(2, 0, 65, float(x)) for x in [*range(0, 200, 2), *range(212, 606, 2)]]
    got = [tuple(r) for r in detect.gutters(spark.createDataFrame(chars, "doc_id long, page_index int, unicode int, x double")).collect()]
    assert got == [(1, 0, 202.0, 302.0)]


def test_coreferences(spark):
    docs = spark.createDataFrame([(1, "Acme came. Then left. No one. The end. Nothing.")], "doc_id long, text string")
    found = redact.entities(docs, {"Acme": "ORG"})
    said = redact.sentences(docs)
    assert [(r.sentence, r.detail) for r in redact.coreferences(said, found, 1).collect()] == [(1, "he")]  # a substring of Then
    assert sorted(r.sentence for r in redact.coreferences(said, found, 3).collect()) == [1, 3]
    assert redact.coreferences(said, found, 0).count() == 0


def test_redaction_leaves_nothing_to_match(spark):
    docs = spark.createDataFrame([(1, "mail a.b@c.org or 10.0.0.1, keep this"), (2, None), (3, "")], "doc_id long, text string")
    out = {r.doc_id: r for r in redact.run(docs, redact.Options(words=("mail",), categories=("email", "ipv4"), mask="#")).collect()}
    # what patterns and entities find is counted as found and, with the words, as covered
    assert out[1].text == "#### ######### or ########, keep this" and (out[1].n_words, out[1].n_patterns, out[1].n_redactions) == (3, 2, 5)
    assert out[3].text == "" and len(out[1].text) == len("mail a.b@c.org or 10.0.0.1, keep this")


def test_redaction_of_cards_and_entities(spark):
    docs = spark.createDataFrame([(1, "4111 1111 1111 1112"), (2, "4111 1111 1111 1111"), (3, "an Acme_Acme2 and (acme)")], "doc_id long, text string")
    out = {r.doc_id: r for r in redact.run(docs, redact.Options(categories=("credit_card",), dictionary={"Acme": "ORG"}, mask="#")).collect()}
    assert (out[1].text, out[1].n_redactions) == ("4111 1111 1111 1112", 0)  # the check digit is wrong
    assert out[2].text == "#" * 19 and out[2].n_patterns == 1
    assert out[3].n_entities == 2 and out[3].text == "an ####_####2 and (####)"  # found words are covered wherever they stand


def test_page_orders_are_permutations(spark):
    pages = spark.createDataFrame([(d, p) for d, n in ((1, 5), (2, 1), (3, 2)) for p in range(n)], "doc_id long, page_index int")
    for out in (compose.reverse(pages), compose.swap(pages, 0, 3), compose.move_range(pages, 1, 2, 9), compose.move_range(pages, 3, 4, 0)):
        by: dict[int, list] = {}
        for r in out.collect():
            by.setdefault(r.doc_id, []).append(r.new_index)
        assert {d: sorted(x) for d, x in by.items()} == {1: [0, 1, 2, 3, 4], 2: [0], 3: [0, 1]}
    merged = sorted((r.doc_id, r.page_index, r.new_index) for r in compose.merge(pages).collect())
    assert [m[2] for m in merged] == list(range(8))
    with pytest.raises(ValueError):
        compose.reorder(pages, [0, 0])


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:00", "ab"[i % 2], float(i)) for i in range(60)]
    events = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.windows(ingest.new_documents(spark, f"{tmp_path}/in", events.schema, 1), "6 hours", delay="2 days")
    stream.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination(120)
    said = lambda df: sorted(map(tuple, df.collect()))
    assert said(spark.table("windows")) == said(ingest.windows(events, "6 hours"))


def test_headings_are_runs_of_one_size(spark):
    long = "x" * 201
    rows = [(0, 18.0, " Big "), (1, 18.3, "title"), (2, 16.0, "Sub"), (3, 12.0, "body"), (4, 16.0, "Next"), (5, 12.0, ""), (6, 16.0, "on"), (7, 12.0, "b"), (8, 14.0, " \t"), (9, 12.0, "b"), (10, 14.0, long)]
    lines = spark.createDataFrame([(1, 0, i, size, text) for i, size, text in rows], "doc_id long, page_index int, line_index int, font_size double, text string")
    got = sorted((r.line_index, r.title) for r in reading.heading_bookmarks(lines).collect())
    assert got == [(0, "Big title"), (2, "Sub"), (4, "Nexton")]


def test_lines_touching_an_area_are_outside(spark):
    lines = spark.createDataFrame([(1, 0, i, 72, y, 60, 12, "t") for i, y in enumerate((700, 688, 676))], "doc_id long, page_index int, line_index int, x int, y int, width int, height int, text string")
    area = "doc_id long, page_index int, left double, bottom double, right double, top double"
    assert [r.line_index for r in reading.outside(lines, spark.createDataFrame([(1, 0, 80.0, 688.0, 90.0, 700.0)], area)).orderBy("line_index").collect()] == [0, 2]
    assert reading.outside(lines, spark.createDataFrame([(1, 1, 0.0, 0.0, 900.0, 900.0)], area)).count() == 3
    assert reading.outside(lines, spark.createDataFrame([], area)).count() == 3


def test_tags_normal_forms_overlays_and_bookmarks(spark):
    one = spark.range(1)
    tag = reading.tag_xml(reading.heading_tag(F.lit(9)), F.lit(0), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit("a<'b'"))
    assert one.select(tag).first()[0] == '<H6 page="0" x="1.0" y="2.0" w="3.0" h="4.0">a&lt;&apos;b&apos;</H6>'
    bare = reading.tag_xml(F.lit("P"), F.lit(0), F.lit(1), F.lit(2), F.lit(3), F.lit(4), F.lit(None).cast("string"))
    assert one.select(bare).first()[0] == '<P page="0" x="1.0" y="2.0" w="3.0" h="4.0"/>'
    texts = spark.createDataFrame([(1, "e\u0301"), (2, None), (3, "")], "doc_id long, text string")
    assert [r.text for r in reading.normalise(texts).orderBy("doc_id").collect()] == ["\u00e9", None, ""]
    pages = spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "doc_id long, page_index int")
    over = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "doc_id long, page_index int")
    got = sorted(tuple(r) for r in reading.insert_overlays(pages, over).collect())
    assert got == [(1, 0, False, 0), (1, 1, True, 0), (1, 2, False, 1), (2, 0, False, 0), (2, 1, True, 0)]
    marks = spark.createDataFrame([(1, 0, "a", 7), (1, 1, "b", -3)], "doc_id long, place int, title string, page_index int")
    counts = spark.createDataFrame([(1, 4)], "doc_id long, n_pages long")
    assert sorted((r.title, r.page_index) for r in reading.set_bookmarks(marks, counts).collect()) == [("a", 3), ("b", 0)]
    assert one.select(reading.standard_font(F.lit("ABC+courier-bold")), reading.standard_font(F.lit("Arial"))).first()[:] == (True, False)
