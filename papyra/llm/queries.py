"""The queries of this package, by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from papyra.llm import bpe, decontaminate, langid, license, matroska, shard, simhash, suffix, urlfilter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix.op1_suffix_dedup,
    "op2_url_filter": urlfilter.op2_url_filter,
    "op3_byte_bpe": bpe.op3_byte_bpe,
    "op4_shards": shard.op4_shards,
    "op5_license_scan": license.op5_license_scan,
    "op6_simhash": simhash.op6_simhash,
    "op7_matroska": matroska.op7_matroska,
    "op8_language_id": langid.op8_language_id,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_warc": warc.op10_warc,
}
ORACLES: dict[str, str] = {"op2_url_filter": urlfilter.ORACLE, "op5_license_scan": license.ORACLE, "op9_decontaminate": decontaminate.ORACLE, "op10_warc": warc.ORACLE}
