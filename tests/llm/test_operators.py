"""The ten operators' queries on the given tables and on planted cases, against plain versions or SQL."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from papyra.llm import queries

from ..conftest import DATA, rows_of
from . import brute

LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
HARD = [None, "", " \n\t ", "a", "ünïcödé ñandú 日本語 " * 9, "don't we'll I'D they've 12345   spaces\n\n  end ", "x" * 49, "x" * 50, "x" * 400, "ab" * 3000, "\u212a kelvin \u0130stanbul ſ"]


def hard_docs(seed: int = 3) -> list[tuple]:
    """(doc_id, text): nulls, empty, very long, ties, copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("alpha beta gamma delta licence the of to and mit apache general public license".split())
    texts = [*HARD, LONG, LONG, LONG[1000:], *HARD]
    base = " ".join(word() + str(rng.randrange(300)) for _ in range(400))
    texts += [base] * 12
    for _ in range(12):
        w = base.split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    for _ in range(60):
        w = [word() + str(rng.randrange(200)) for _ in range(rng.randrange(1, 200))]
        if rng.random() < 0.4:
            w.insert(rng.randrange(len(w) + 1), PASSAGE)
        if rng.random() < 0.2:
            w.insert(rng.randrange(len(w) + 1), "This work is released under the MIT License.")
        texts.append(" ".join(w))
    keys = rng.sample(range(10_000), len(texts))
    return list(zip(keys, texts, strict=True))


@pytest.fixture(scope="session")
def hard_dir(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("hard"))
    docs = [(k, t, ["en", "de", None][k % 3], "web", None if t is None else len(t)) for k, t in hard_docs()]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{folder}/documents.parquet")
    items = [(1, PASSAGE), (2, "short item"), (3, None), (4, ""), (5, PASSAGE), (6, " ".join(LONG.split()[50:64])), (None, "no id"), (None, "gamma17"), (None, " ".join(LONG.split()[90:104])), (7, "This work is released")]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(f"{folder}/benchmark.parquet")
    html = ["<html>same</html>", "<html>same</html>", None, "", "<p>é</p>" * 500_000, "<p>é</p>" * 500_000, "<html>one</html>"]
    urls = ["http://Example.COM/en/7?x", "https://a.example.net/de/8/y#z", None, "no scheme", "x://sub.org/es/", "http://sub.org/fr/", "http://fine.io"]
    spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(spark, tmp_path_factory, hard_dir):
    folder = str(tmp_path_factory.mktemp("empty"))
    for t in ("documents", "benchmark", "pages"):
        spark.read.parquet(f"{hard_dir}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
    return folder


def pairs(spark, folder, table="documents", *columns):
    return [tuple(r) for r in spark.read.parquet(f"{folder}/{table}.parquet").select(*columns or ("doc_id", "text")).collect()]


def result(spark, name, folder) -> dict:
    rows = queries.QUERIES[name](spark, folder).collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.fixture(params=["given", "hard"])
def folder(request, hard_dir):
    return hard_dir if request.param == "hard" else DATA


def test_suffix_dedup(spark, folder):
    got = result(spark, "op1_suffix_dedup", folder)
    said = brute.op1(pairs(spark, folder))
    assert {k: v[:4] for k, v in got.items()} == said


def test_suffix_dedup_long_and_hot(spark, tmp_path, monkeypatch):
    """A text of several buffers, and every shared anchor taken for hot; repeated and null keys."""
    from papyra.llm import suffix

    monkeypatch.setattr(suffix, "HOT", 2)
    monkeypatch.setattr(suffix, "SAMPLED", 2)
    rng = random.Random(8)
    long = " ".join(f"v{rng.randrange(90_000)}" for _ in range(110_000))
    assert len(long) > suffix.BUFFER * 1.2
    docs = [(3, long), (9, long[len(long) // 2 - 400 :] + " tail"), (5, "head " + long[suffix.BUFFER - 200 : suffix.BUFFER + 300])]
    docs += [(20 + i, f"own {i} " + PASSAGE + f" {i * 77} end") for i in range(40)]
    other = "another text of nine " + PASSAGE
    said = brute.op1([*docs, (10, other)])  # no document has 10: it stands for the other text of 9
    docs += [(None, PASSAGE), (30, docs[13][1]), (9, other)]
    assert docs[13][0] == 30
    spark.createDataFrame(docs, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["op1_suffix_dedup"](spark, str(tmp_path)).collect()
    assert len(rows) == len(docs)
    assert [tuple(r)[1:5] for r in rows if r[0] is None] == [(len(PASSAGE), 0, 0, brute.sha(PASSAGE.encode()))]
    assert sorted(tuple(r)[1:5] for r in rows if r[0] == 9) == sorted([said.pop(9), said.pop(10)])
    assert {r[0]: tuple(r)[1:5] for r in rows if r[0] not in (None, 9)} == said


def test_suffix_sort_decides(monkeypatch):
    """Which strings are equal follows from their order: without the sort the result is another."""
    import numpy as np

    from papyra.llm import suffix

    rng = random.Random(2)
    data = ["".join(rng.choice("ab") for _ in range(20)) + "common start of many lines " + rng.choice(["one end of the line here", "quite another end of it"]) * 2 for _ in range(60)]
    data = [d.encode() for d in dict.fromkeys(data)]
    least = np.array(rng.sample(range(1000), len(data)))
    first: dict = {}
    for d, k in zip(data, least.tolist(), strict=True):
        for i in range(len(d) - 49):
            first[d[i : i + 50]] = min(k, first.get(d[i : i + 50], k))
    said = [first[d[i : i + 50]] for d in data for i in range(len(d) - 49)]
    assert suffix.smallest_sources(data, least)[0].tolist() == said
    monkeypatch.setattr(suffix, "suffix_sort", lambda raw, starts, segment, limit: np.arange(len(starts)))
    assert suffix.smallest_sources(data, least)[0].tolist() != said


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_with_sql(spark, folder, name):
    from ..conftest import duck_over

    con = duck_over(folder) if folder == DATA else duck_over("/nowhere")
    if folder != DATA:
        for t in ("documents", "benchmark", "pages"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    got = queries.QUERIES[name](spark, folder).toArrow()
    said = con.execute(queries.ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(said.column_names)
    assert rows_of(got, columns) == rows_of(said, columns)


def test_byte_bpe(spark, folder):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = result(spark, "op3_byte_bpe", folder)
    rows = pairs(spark, folder)
    assert len(got) == len(rows)
    for k, t in rows:
        ids = enc.encode_ordinary(t or "")
        assert got[k] == (len(ids), brute.sha(b"".join(i.to_bytes(4, "little") for i in ids)), brute.sha((t or "").encode())), repr(t)[:80]


def test_byte_bpe_collisions():
    """Pieces whose hashes collide are told apart by their bytes."""
    import numpy as np
    import public_tokenizers

    from papyra.llm.bpe import Codec

    good, bad = (Codec(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")) for _ in range(2))
    bad.byte_value = np.zeros_like(bad.byte_value)
    texts = [t for t in HARD if t] + ["many unlike words of one length here", "more of them"]
    for _ in range(2):
        (a, n), (b, m) = good.encode_block(texts), bad.encode_block(texts)
        assert a.tolist() == b.tolist() and n.tolist() == m.tolist()


def test_shards(spark, folder):
    got = result(spark, "op4_shards", folder)
    rows = pairs(spark, folder)
    assert set(got) == {k for k, _ in rows}
    by_text: dict = {}
    load = [0] * 40
    slots: dict[int, list[int]] = {}
    for k, t in rows:
        raw = (t or "").encode()
        size, crc, law, shard, slot, grown = got[k]
        assert (size, crc, law, grown) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)
        assert by_text.setdefault(t or "", shard) == shard
        load[shard] += size
        slots.setdefault(shard, []).append(slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    # no smaller capacity would do, by greedy filling of the groups in the order of their digests
    groups: dict[bytes, int] = {}
    for _, t in rows:
        raw = (t or "").encode()
        d = hashlib.sha256(raw).digest()
        groups[d] = groups.get(d, 0) + len(raw) + 16
    ordered = [groups[d] for d in sorted(groups)]
    lo, hi = max(ordered), sum(ordered)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if brute.greedy(ordered, mid) <= 40 else (mid + 1, hi)
    assert max(load) == lo


def test_license_scan_templates(spark):
    from papyra.llm import license

    rows = [(1, "Permission is hereby granted, free of charge, to any person obtaining, a copy of this very software and associated documentation files"), (2, "permission to go"), (3, None), (4, "")]
    out = {r.doc_id: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1].labels == "mit" and 0.5 <= out[1].score < 1 and out[1].base_labels == ""
    assert [out[i].labels for i in (2, 3, 4)] == ["", "", ""]


def test_simhash(spark, folder):
    got = result(spark, "op6_simhash", folder)
    assert got == brute.op6(pairs(spark, folder))


def test_matroska(spark, folder):
    got = result(spark, "op7_matroska", folder)
    by_text: dict = {}
    for k, t in pairs(spark, folder):
        assert got[k][:4] == brute.op7(t)
        assert by_text.setdefault(t or "", got[k]) == got[k]


def test_language_id(spark):
    got = result(spark, "op8_language_id", "/root/testdata/sf0.01")
    rows = pairs(spark, "/root/testdata/sf0.01", "documents", "doc_id", "text", "lang")
    assert set(got) == {r[0] for r in rows}
    right = tested = 0
    for k, t, lang in rows:
        held, said, score = got[k]
        assert held == (zlib.crc32(str(k).encode()) % 3 == 1)
        assert 0 <= score <= 1
        assert (said == "und") == (t is None or not any(map(str.isalpha, t)))
        if held and lang:
            right, tested = right + (said == lang), tested + 1
    assert right / tested >= 0.97


def test_language_id_hard(spark, hard_dir):
    got = result(spark, "op8_language_id", hard_dir)
    for k, t in pairs(spark, hard_dir):
        assert (got[k][1] == "und") == (t is None or not any(map(str.isalpha, t)))


def test_decontamination(spark, folder):
    got = result(spark, "op9_decontaminate", folder)
    items = pairs(spark, folder, "benchmark", "item_id", "text")
    assert got == brute.op9(pairs(spark, folder), items)


def test_decontamination_in_passes(spark, hard_dir):
    """A benchmark that is dealt into parts gives what it gives whole."""
    from papyra.llm import decontaminate

    docs, items = (spark.read.parquet(f"{hard_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    assert items.count() > 4
    for f in (decontaminate.report, decontaminate.clean):
        whole, parts = (f(docs, items, item_bytes=n).toArrow() for n in (1 << 20, 300))
        assert rows_of(whole, whole.column_names) == rows_of(parts, whole.column_names)
    assert sum(decontaminate.report(docs, items, item_bytes=300).toArrow().column("n_hit").to_pylist()) > 0


def test_warc(spark, folder):
    got = result(spark, "op10_warc", folder)
    assert got == brute.op10(pairs(spark, folder, "pages", "page_id", "html"))


def test_warc_long_urls(spark, tmp_path):
    """Headers beyond 64 KiB, of responses in one row and in several, and of a revisit."""
    from papyra.llm import warc

    pages = [(1, "data:text/html," + "a" * 100_000, "<html>one</html>"), (2, "http://x.org/?q=" + "é" * 100_000, "<p>é</p>" * 500_000), (3, "http://y.org/?q=" + "b" * 70_000, "same"), (4, "http://y.org/", "same")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert result(spark, "op10_warc", str(tmp_path)) == brute.op10([(k, h) for k, _, h in pages])
    urls = {r.page_id: r.url for r in warc.read(warc.write(spark.read.parquet(f"{tmp_path}/pages.parquet"))).collect()}
    assert urls == {k: u for k, u, _ in pages}


def test_warc_repeated_rows(spark, tmp_path):
    """Rows of one identifier, and of none, several chunks each, in one partition."""
    big = "<p>é</p>" * 500_000
    rows = [(1, "http://x.org/", big), (1, "http://x.org/", big), (None, "http://y.org/", big + "y"), (None, "http://z.org/", big + "z"), (None, None, None), (2, "http://x.org/", "small"), (2, "http://x.org/", "small"), (None, None, "small")]
    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(r) for r in queries.QUERIES["op10_warc"](spark, str(tmp_path)).collect()]
    said = [(k, len(raw := (h or "").encode()), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response", None) for k, _, h in rows]
    said[-1] = (*said[-1][:3], "revisit", 2)
    assert sorted(got, key=repr) == sorted(said, key=repr)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert queries.QUERIES[name](spark, empty_dir).count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_more_columns_change_nothing(spark, hard_dir, tmp_path_factory, name):
    """Extra columns, some with the operators' own names, and every value null in a row."""
    folder = str(tmp_path_factory.mktemp("more"))
    for t, own in (("documents", ["key", "shared", "removed", "fp", "ids", "score", "h", "n", "gid", "lang_pred", "component"]), ("pages", ["host", "rule", "sha", "k", "response", "archive"]), ("benchmark", ["window"])):
        more = spark.read.parquet(f"{hard_dir}/{t}.parquet")
        more.select("*", *[F.lit("x").alias(c) for c in own]).write.parquet(f"{folder}/{t}.parquet")
    a, b = (queries.QUERIES[name](spark, f).toArrow() for f in (hard_dir, folder))
    columns = sorted(a.column_names)
    assert rows_of(a, columns) == rows_of(b, columns)
    nulls = str(tmp_path_factory.mktemp("nulls"))
    for t in ("documents", "pages", "benchmark"):
        df = spark.read.parquet(f"{hard_dir}/{t}.parquet")
        df.unionByName(spark.createDataFrame([tuple(None for _ in df.columns)] * 2, df.schema)).write.parquet(f"{nulls}/{t}.parquet")
    rows = queries.QUERIES[name](spark, nulls)
    assert rows.count() == a.num_rows + 2
