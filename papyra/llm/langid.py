"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree per language, with escape probabilities (method C: a context seen T times with D
different successors escapes with D / (T + D)), is fitted on a bounded sample and then frozen. A text's score under a
language is its exact code length. For scoring, the trees are laid out as two arrays: a map from the last three byte
classes to the longest context that any tree holds, and that context's code length of every byte under every language, so
one text needs two array look-ups a byte.

Defined results: null, empty and letterless texts are `und` with score 0; ties go to the language that sorts first; with
no labelled rows every text is `und`; long texts are scored in pieces that carry their context; rows that
repeat a key are judged one by one; every language that a label names is learnt, and the model grows with their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import blocks, table, tidy

#: About so many labelled rows of each language are learnt from; MAX_CONTEXTS bounds the frozen trees.
SAMPLE_ROWS = 1500
MAX_CONTEXTS = 16384
#: The sample is drawn by hashed keys, in steps of one in RATE.
RATE = 1 << 40
MIN_COUNT = 2
ORDER = 3
BLOCK = 1 << 19


@dataclass
class Model:
    languages: list[str]
    classes: np.ndarray  # 256: class of each byte, 0 for those not learnt
    context: np.ndarray  # M^3: number of the longest context that the last three classes end in
    cost: np.ndarray  # contexts * M by language: bits

    def bits(self, data: list[bytes]) -> np.ndarray:
        """Code length of each text under each language."""
        out = np.zeros((len(data), len(self.languages)))
        m = int(self.classes.max()) + 1
        pieces = [(i, d[max(0, a - ORDER) : a], d[a : a + BLOCK]) for i, d in enumerate(data) for a in range(0, len(d), BLOCK)]
        for x, y in blocks([len(p[2]) for p in pieces], BLOCK):
            part = pieces[x:y]
            raw = np.frombuffer(b"".join((b"\0" * ORDER + before)[-ORDER:] + d for _, before, d in part), np.uint8)
            c = self.classes[raw].astype(np.int64)
            at = self.context[(c[:-3] * m + c[1:-2]) * m + c[2:-1]] * m + c[3:]
            ends = np.cumsum([len(d) + ORDER for _, _, d in part])
            keep = np.ones(len(raw), bool)
            starts = np.append(0, ends[:-1])
            for k in range(ORDER):
                keep[starts + k] = False
            bits = self.cost[at[keep[ORDER:]]]
            sums = np.add.reduceat(bits, starts - ORDER * np.arange(len(part)), axis=0, dtype=np.float64)
            np.add.at(out, [p[0] for p in part], sums)
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the four-byte strings of each language; texts begin after three zero bytes."""
    tidy()
    for batch in batches:
        by: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(text.encode())
        for lang, texts in by.items():
            found: dict[int, int] = {}
            for a, b in blocks([len(t) for t in texts], 1 << 22):
                codes = []
                for t in texts[a:b]:
                    r = np.frombuffer(b"\0" * ORDER + t, np.uint8).astype(np.int64)
                    codes.append(r[:-3] << 24 | r[1:-2] << 16 | r[2:-1] << 8 | r[3:])
                u, n = np.unique(np.concatenate(codes), return_counts=True)
                for k, v in zip(u.tolist(), n.tolist(), strict=True):
                    found[k] = found.get(k, 0) + v
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], names=["lang", "code", "n"])


def fit(rows: DataFrame, key: str = "doc_id", sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from rows (key, text, lang). The sample of each language is the rows whose hashed key lies below a rate."""
    rows = rows.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select(F.col(key).alias("key"), "text", "lang")
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    rate = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, int(min(1.0, sample_rows / n) * RATE))])
    sample = rows.filter(F.pmod(F.xxhash64("key"), F.lit(RATE)) < F.element_at(rate, F.col("lang")))
    counts = sample.select("lang", "text").mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(counts.column("lang").to_pylist(), dtype=object)
    code, n = counts.column("code").to_numpy(), counts.column("n").to_numpy()
    return build(sorted(set(langs)), langs, code, n) if len(code) else None


def build(languages: list[str], langs: np.ndarray, code: np.ndarray, n: np.ndarray) -> Model:
    used = np.unique(np.concatenate([code & 255, code >> 8 & 255, code >> 16 & 255, code >> 24 & 255]))
    classes = np.zeros(256, np.int32)
    classes[used] = np.arange(1, len(used) + 1)
    m = len(used) + 1
    # contexts of each order that occur often enough in any language; the most frequent MAX_CONTEXTS stay
    kept: list[np.ndarray] = []
    for k in range(1, ORDER + 1):
        ctx, inverse = np.unique(code >> 8 & (1 << 8 * k) - 1, return_inverse=True)
        total = np.bincount(inverse, n).astype(np.int64)
        ctx, total = ctx[total >= MIN_COUNT], total[total >= MIN_COUNT]
        kept.append(np.sort(ctx[np.argsort(-total, kind="stable")[: MAX_CONTEXTS if k == ORDER else len(ctx)]]))
    cost = np.full((1 + sum(map(len, kept)), m, len(languages)), 8.0, np.float32)
    context = np.zeros((m, m, m), np.int32)
    for j, lang in enumerate(languages):
        mine = langs == lang
        own, weight = code[mine], n[mine]
        base, parents = 1, {0: 0}
        for k in range(ORDER + 1):
            contexts = kept[k - 1] if k else np.zeros(1, np.int64)
            ids = np.arange(base, base + len(contexts)) if k else np.zeros(1, np.int64)
            if k > 1:
                low = contexts & (1 << 8 * (k - 1)) - 1
                parent = np.array([parents[x] for x in low.tolist()], np.int64)
                cost[ids, :, j] = cost[parent, :, j]
            elif k == 1:
                cost[ids, :, j] = cost[0, :, j]
            full, inverse = np.unique(own & (1 << 8 * (k + 1)) - 1, return_inverse=True)
            count = np.bincount(inverse, weight)
            of = np.searchsorted(contexts, full >> 8)
            ok = of < len(contexts)
            ok[ok] = contexts[of[ok]] == full[ok] >> 8
            full, count, of = full[ok], count[ok], of[ok]
            total, kinds = np.bincount(of, count, len(contexts)), np.bincount(of, minlength=len(contexts))
            there = total > 0
            cost[ids[there], :, j] += (np.log2(total + kinds, where=there, out=np.zeros(len(total))) - np.log2(kinds, where=there, out=np.zeros(len(total))))[there, None]
            cost[ids[of], classes[full & 255], j] = np.log2(total[of] + kinds[of]) - np.log2(count)
            if k:
                if j == 0:
                    a, b, c = (classes[contexts >> s & 255] for s in (16, 8, 0))
                    if k == 1:
                        context[:, :, c] = ids
                    elif k == 2:
                        context[:, b, c] = ids
                    else:
                        context[a, b, c] = ids
                parents = dict(zip(contexts.tolist(), ids.tolist(), strict=True))
                base += len(contexts)
    return Model(languages, classes, context.ravel(), cost.reshape(-1, len(languages)))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def _scored(docs: DataFrame, model: Model | None, text: str, finish, schema) -> DataFrame:
    """finish(batch, languages, scores) over docs' batches."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        m = shared.value
        for batch in batches:
            texts = batch.column(at).to_pylist()
            said, score = ["und"] * len(texts), [0.0] * len(texts)
            rows = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            if rows:
                bits = m.bits([texts[i].encode() for i in rows])
                best = bits.argmin(1)
                share = 1 / np.exp2(np.minimum(0, bits[np.arange(len(rows)), best][:, None] - bits)).sum(1)
                for i, b, s in zip(rows, best.tolist(), share.tolist(), strict=True):
                    said[i], score[i] = m.languages[b], round(s, 6)
            yield finish(batch, said, score)

    return docs.mapInArrow(run, schema)


def predict(docs: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, lang_pred, score): score is the language's share of the likelihoods 2^-bits, so 0.5 and above for two languages."""

    def finish(batch: pa.RecordBatch, said: list[str], score: list[float]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(said, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return _scored(docs.select(key, text), model, text, finish, f"`{key}` {kind}, lang_pred string, score double")


def clean(docs: DataFrame, model: Model | None, min_score: float, text: str = "text", lang: str = "lang") -> DataFrame:
    """docs, all columns, lang being the language found, without rows that are `und` or below min_score; each row is judged by itself, whatever its key."""
    at = docs.columns.index(lang)

    def finish(batch: pa.RecordBatch, said: list[str], score: list[float]) -> pa.RecordBatch:
        keep = [x != "und" and s >= min_score for x, s in zip(said, score, strict=True)]
        columns = [pa.array(said, pa.string()) if i == at else c for i, c in enumerate(batch.columns)]
        return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep, pa.bool_()))

    return _scored(docs, model, text, finish, docs.schema)


def held_out(key: str = "doc_id") -> Column:
    return F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(~held_out()).select("doc_id", "text", "lang"))
    return predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
