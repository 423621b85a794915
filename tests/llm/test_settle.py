"""What stages leave in the memory of executors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyra.llm import bpe, common, decontaminate, suffix


def collections(spark):
    """Full collections of the JVM so far: those of its old generation."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans()
    return sum(b.getCollectionCount() for b in beans if "Old" in b.getName() or "MarkSweep" in b.getName())


def test_settle(spark):
    before = collections(spark)
    common.settle(spark)
    assert collections(spark) > before


def test_workers_forget(spark):
    """A worker's own caches go, not copies of the driver's; local[8] has eight workers or more."""

    def held(batches):
        import pyarrow as pa

        from papyra.llm import bpe, common

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([len(bpe._codecs)]), pa.array([sum(c is bpe._codecs for c in common.caches)])], names=["n", "known"])

    docs = spark.range(0, 64, 1, 8).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    bpe.encode(docs, bpe.vocabulary()).write.format("noop").mode("overwrite").save()
    count = lambda: spark.range(0, 8, 1, 8).mapInArrow(held, "n long, known long").collect()
    assert all(r.known == 1 for r in count())
    for _ in range(20):
        common.settle(spark)
        if not any(r.n for r in count()):
            return
    pytest.fail("some worker still holds its codec")


def test_caches():
    for cache in (bpe._codecs, decontaminate._held, suffix._power):
        assert any(c is cache for c in common.caches)
    suffix.powers(10)
    assert list(common._forget(iter(()))) == [] and not suffix._power


@pytest.mark.parametrize("one_machine", [True, False])
def test_release(spark, monkeypatch, one_machine):
    """Executors elsewhere are settled too."""
    seen = []
    monkeypatch.setattr(common, "settle", seen.append)
    monkeypatch.setattr(common, "_one_machine", lambda _: one_machine)
    common.release(spark)
    assert seen == ([] if one_machine else [spark])


def test_stages_begin_released(monkeypatch):
    seen = []
    monkeypatch.setattr(corpus_pipeline, "release", seen.append)
    for name, stage in corpus_pipeline.STAGES:
        assert stage.__name__ == name
        with pytest.raises(AttributeError):
            stage("session", None, "")
        assert seen == ["session"]
        seen.clear()
