"""Each stage of the pipeline against a plain version over what its predecessor kept."""

from __future__ import annotations

import base64
import random

import pytest

import corpus_pipeline
from papyra.llm import decontaminate

from ..conftest import DATA
from . import brute
from .test_operators import empty_dir, hard_dir  # noqa: F401


@pytest.fixture(params=["given", "hard"])
def run(spark, request, hard_dir, tmp_path_factory):  # noqa: F811
    sf_dir = hard_dir if request.param == "hard" else DATA
    out = str(tmp_path_factory.mktemp("stages"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf_dir).write.parquet(f"{out}/{name}")
        tables.append(spark.read.parquet(f"{out}/{name}"))
    return spark, sf_dir, tables


def rows(df):
    return {r.doc_id: r for r in df.collect()}


def test_stages(run):
    import public_tokenizers
    import tiktoken

    spark, sf_dir, tables = run
    said, unique, cut, clean = map(rows, tables[1:5])
    for t in tables[1:5]:
        assert t.columns == tables[0].columns
    given = rows(tables[0])
    assert all(said[k].text == given[k].text for k in said)
    assert all(said.get(k) is None for k, r in given.items() if not any(map(str.isalpha, r.text or "")))

    assert set(unique) == alike_brute([(k, r.text) for k, r in said.items()])

    left = brute.kept([(k, r.text) for k, r in unique.items()])
    for k, raw in left.items():
        text = raw.decode(errors="ignore")
        if raw == unique[k].text.encode():
            assert cut[k] == unique[k]
        elif text.strip():
            assert cut[k].text == text and cut[k].n_chars == len(text)
        else:
            assert k not in cut
    assert set(cut) <= set(unique)

    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    scanner = decontaminate.Scanner(items)
    hits = brute.op9([(k, r.text) for k, r in cut.items()], items)
    for k, (n, hit, *_) in hits.items():
        if not hit:
            assert clean[k] == cut[k]
        elif hit > decontaminate.MAX_COVERAGE * n:
            assert k not in clean
        else:
            w = decontaminate.words(cut[k].text)
            spans, _ = scanner.scan(w)
            assert sum(e - s for s, e in spans) == hit
            assert clean[k].text == decontaminate.remove_words(cut[k].text, spans) and clean[k].n_chars == len(clean[k].text)
            rest = [x for i, x in enumerate(w) if not any(s <= i < e for s, e in spans)]
            assert b"".join(decontaminate.words(clean[k].text)) == b"".join(rest)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    tokens = rows(tables[5])
    assert set(tokens) == set(clean)
    for k, r in tokens.items():
        assert r.ids == enc.encode_ordinary(clean[k].text) and r.text == clean[k].text


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "lang", "source", "ids", "text"]
    assert out.count() > 0


def test_empty(spark, empty_dir):  # noqa: F811
    assert corpus_pipeline.run(spark, empty_dir).count() == 0


def test_language_keys(spark):
    """Null and repeated doc_ids: as many rows as have a language, each with its own text."""
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    good = [r for r in docs if len(r[1] or "") > 500][:5]
    again = docs[0][0]
    more = [(None, *good[0][1:]), (None, *good[1][1:]), (None, "12 34", None, "web", 5), (again, *good[2][1:]), (again, *good[2][1:]), (again, "?!", None, "web", 2), (again, None, None, "web", None)]
    df = spark.createDataFrame(docs + more, "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.language(spark, df, DATA).collect()]
    assert sorted(got, key=repr) == sorted(((k, t) for k, t, *_ in docs + more if t and any(map(str.isalpha, t))), key=repr)


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}


def alike_brute(docs):
    """The smallest doc_id of each group linked by a Jaccard similarity of 0.8 or more."""
    sets = {k: shingles(t) for k, t in docs}
    least = {k: k for k in sets}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    return {k for k in sets if root(k) == k}


@pytest.mark.parametrize("case", ["given", "edited"])
def test_near_copies(spark, case):
    """Against brute force: the given table, and copies with edits on both sides of the threshold, a group of 90 and a common line."""
    if case == "given":
        docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    else:
        rng = random.Random(5)
        texts = ["", None, " ", "one two", "One  two", "a b c d e", "a b c d e f"]
        for size, copies in [(n, 1) for n in (20, 60, 100, 300) for _ in range(15)] + [(200, 90)]:
            base = [f"w{rng.randrange(5000)}" for _ in range(size)]
            texts.append(" ".join(base))
            for _ in range(copies):
                w = list(base)
                for _ in range(rng.randrange(1, 2 + size // 30)):
                    w[rng.randrange(size)] = f"e{rng.randrange(5000)}"
                texts.append(" ".join(w))
        line = "this very common line stands in many of the texts here"
        texts += [f"{line} " + " ".join(f"w{rng.randrange(5000)}" for _ in range(rng.randrange(1, 30))) for _ in range(80)]
        docs = list(zip(rng.sample(range(9999), len(texts)), texts, strict=True))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, DATA).collect()]
    assert len(got) == len(set(got))
    assert set(got) == alike_brute(docs)
