"""URL filters: path rules, and a Bloom filter cascade for a list of hosts. DataFrame functions only.

The cascade holds exact membership of the listed keys within the universe of all keys of the corpus: level 0 encodes the
listed keys, level 1 the unlisted keys that level 0 takes for listed, level 2 the listed keys that level 1 takes for those,
and so on until no false positive is left. A key is probed from level 0 on until a level denies it; the level's parity
tells whether it is listed. Probing reads bit arrays through scalar subqueries, so urls are neither joined nor shuffled.

The bit arrays are about ten bits for each listed key and less for the levels below. They are written to the shared folder,
and their size is known before they are used: above MAX_WORDS the verdicts of keys are joined instead (same results).

Defined results: null urls and urls without `://` have empty host and path; rules of equal length go by host, then path; an
empty list or universe denies every key.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.llm.common import table, written

BITS = 10
PROBES = 6
MAX_WORDS = 1 << 21
CHUNK = 1024


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lowered(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def host(url: Column) -> Column:
    return lowered(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def _longest(rules: list[Rule], host: Column, path: Column, value) -> Column:
    out = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.name), r.host, r.path)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        out = F.when(fits, F.lit(value(r))).otherwise(out)
    return out


# -- cascade


def _places(key: Column, level: int, words: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(j)), F.lit(64 * words)) for j in range(PROBES)]


def _bits(keys: DataFrame, level: int, words: int) -> DataFrame:
    """One row: the level's bits as an array of longs."""
    spark = keys.sparkSession
    set_ = keys.select(F.explode(F.array(*_places(F.col("key"), level, words))).alias("p")).select((F.col("p") / 64).cast("long").alias("word"), F.expr("shiftleft(1L, cast(p % 64 as int))").alias("bits"))
    every = spark.range(words).select(F.col("id").alias("word"), F.lit(0).cast("long").alias("bits"))
    word = set_.unionByName(every).groupBy("word").agg(F.bit_or("bits").alias("bits"))
    chunk = word.groupBy((F.col("word") / CHUNK).cast("long").alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("bits"))
    return chunk.agg(F.flatten(F.array_sort(F.collect_list(F.struct("chunk", "bits"))).getField("bits")).alias("bits"))


def _has(filter_: DataFrame, key: Column, level: int, words: int) -> Column:
    bits = filter_.scalar()
    out = None
    for p in _places(key, level, words):
        hit = F.getbit(F.element_at(bits, (p / 64).cast("int") + 1), (p % 64).cast("int")) == 1
        out = hit if out is None else out & hit
    return out


class Cascade:
    """Exact membership of the listed keys. universe: distinct (key, listed) of all keys that are ever asked for."""

    def __init__(self, universe: DataFrame, max_words: int = MAX_WORDS):
        self.levels: list[tuple[DataFrame, int]] = []
        self.universe, self.joined = universe, False
        counted = universe.agg(F.count_if("listed").alias("n")).first().n
        inside, outside = universe.filter("listed").select("key"), universe.filter("not listed").select("key")
        while counted:
            words = max(1, -(-counted * BITS // 64))
            if words > max_words:
                self.levels, self.joined = [], True
                return
            level = len(self.levels)
            self.levels.append((written(_bits(inside, level, words), "bits"), words))
            wrong = written(outside.filter(_has(self.levels[-1][0], F.col("key"), level, words)), "wrong")
            inside, outside, counted = wrong, inside, wrong.count()

    def mark(self, rows: DataFrame, key: Column, name: str) -> DataFrame:
        """rows with a boolean column: is the key listed?"""
        if self.joined:
            listed = self.universe.filter("listed").select(F.col("key").alias("__key"), F.lit(True).alias("__listed"))
            return rows.join(listed, key == F.col("__key"), "left").withColumn(name, F.coalesce("__listed", F.lit(False))).drop("__key", "__listed")
        out = F.lit(len(self.levels) % 2 == 1)
        for level in reversed(range(len(self.levels))):
            filter_, words = self.levels[level]
            out = F.when(~_has(filter_, key, level, words), F.lit(level % 2 == 1)).otherwise(out)
        return rows.withColumn(name, out)


def judge(pages: DataFrame, listed: DataFrame | None = None, rules: list[Rule] = RULES, url: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict. Where no rule fits, listed hosts are blocked.

    listed: hosts (column key); without it, the hosts of which some url is blocked by rule.
    """
    parts = pages.withColumns({"host": host(F.col(url)), "path": path(F.col(url))})
    ruled = parts.withColumn("rule", _longest(rules, F.col("host"), F.col("path"), lambda r: r.name)).withColumn("__by_rule", _longest(rules, F.col("host"), F.col("path"), lambda r: r.action))
    keys = ruled.select(F.col("host").alias("key"), (F.coalesce(F.col("__by_rule") == "block", F.lit(False)) if listed is None else F.lit(False)).alias("listed"))
    if listed is not None:
        keys = keys.unionByName(listed.select("key", F.lit(True).alias("listed")))
    cascade = Cascade(written(keys.groupBy("key").agg(F.bool_or("listed").alias("listed")), "hosts"))
    marked = cascade.mark(ruled, F.col("host"), "__listed")
    return marked.withColumn("verdict", F.coalesce("__by_rule", F.when(F.col("__listed"), "block").otherwise("allow"))).drop("__by_rule", "__listed")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _case(field: str) -> str:
    whens = [f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name if field == 'rule' else r.action}'" for r in sorted(RULES, key=lambda r: (len(r.name), r.host, r.path), reverse=True)]
    return f"CASE {' '.join(whens)} END"


ORACLE = f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '{_URL}', 1), ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         coalesce(regexp_extract(url, '{_URL}', 2), '') AS path FROM pages),
ruled AS (SELECT *, {_case('rule')} AS rule, {_case('action')} AS by_rule FROM parts),
listed AS (SELECT DISTINCT host FROM ruled WHERE by_rule = 'block')
SELECT page_id, host, path, rule,
       coalesce(by_rule, CASE WHEN host IN (SELECT host FROM listed) THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""
