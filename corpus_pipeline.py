"""A training corpus from documents: five stages, each a table that the next one reads.

Language ID drops what has no language, SimHash near-dedup keeps one document of each group of texts with a Jaccard
similarity of 0.8 or more on five-word shingles, suffix-array dedup cuts repeated passages, decontamination cuts benchmark
passages, and byte-level BPE tokenises what is left.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm import bpe, decontaminate, langid, simhash, suffix
from papyra.llm.common import release, table, written
from papyra.session import ship

#: A document whose best language has less than this share of the likelihood has no one language.
MIN_SCORE = 0.5
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is undetermined; lang becomes the language found. Rows that repeat a doc_id or have none are judged one by one."""
    ship(spark)
    return langid.clean(docs, langid.fit(docs.filter(~langid.held_out())), MIN_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest doc_id, of each group linked by a Jaccard similarity of 0.8 or more on five-word shingles stays."""
    return simhash.representatives(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 bytes and more that a document of smaller doc_id has; documents of which nothing is left go."""
    return suffix.clean(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts the passages of the benchmark, and drops documents that are mostly benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark")).withColumn("n_chars", F.length("text").cast("long"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, and the text decoded from them."""
    return bpe.encode(docs.select("doc_id", "text", "lang", "source"), bpe.vocabulary(), decoded="text")


def _released(stage):
    """The stage, begun without what the stages before it left in memory."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [(stage.__name__, _released(stage)) for stage in (language, near_duplicates, repeats, benchmark, tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
