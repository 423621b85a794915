"""Minimax contiguous partition: documents into shards of near equal bytes. DataFrame functions only.

Groups of equal texts are atomic and lie in the order of their SHA-256. The smallest shard capacity for which greedy
filling needs no more than the given shards is found by binary search, and the order is cut there.

Sizes' running totals are a distributed table (per bucket of the order, after the buckets' totals). The search needs only
"the last total up to t" for a few t. The driver answers that from a summary: the range of totals is cut into at most
CELLS cells with their least and greatest total, and cells that a capacity's cuts fall into are cut again, by one job for
all cuts. So the driver holds a few thousand numbers, however many groups there are, and the capacity is exact.

Within a shard, slots follow the order, then doc_id mod SALT, then doc_id; ranks are counted per (group, salt), so a group
that holds a third of all rows is spread over SALT tasks.

Defined results: null and empty texts are one group of size 16 a row and CRC 0; an empty table gives no rows; repeated rows
take a slot each; with fewer groups than shards the last shards stay empty.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from papyra.llm.common import table, written

SHARDS = 40
OVERHEAD = 16
BUCKETS = 4096
CELLS = 4096
SPLIT = 64
SALT = 64


class Totals:
    """The running totals' summary. A cell is (start, end, least, greatest), for totals in (start, end]."""

    def __init__(self, totals: DataFrame, end: int):
        self.totals = totals
        self.cells: dict[int, tuple[int, int, int]] = {}
        self._add([(0, end)], CELLS)

    def _add(self, ranges: list[tuple[int, int]], parts: int) -> None:
        """Puts cells in the place of ranges: one job for all."""
        of, wide = F.lit(None).cast("long"), {}
        for s, e in ranges:
            wide[s] = max(1, -(-(e - s) // parts))
            of = F.when((F.col("total") > s) & (F.col("total") <= e), F.lit(s) + F.expr(f"(total - 1 - {s}) div {wide[s]}") * wide[s]).otherwise(of)
        low, high = min(s for s, _ in ranges), max(e for _, e in ranges)
        rows = self.totals.filter((F.col("total") > low) & (F.col("total") <= high)).groupBy(of.alias("s")).agg(F.min("total").alias("a"), F.max("total").alias("b")).filter("s is not null").collect()
        ends = sorted(ranges)
        for s, _ in ranges:
            self.cells.pop(s, None)
        for r in rows:
            s, e = ends[bisect_right(ends, (r.s, 1 << 62)) - 1]
            self.cells[r.s] = (min(r.s + wide[s], e), r.a, r.b)
        self.starts = sorted(self.cells)

    def last(self, t: int) -> tuple[int, int, int | None]:
        """Bounds of the last total up to t, and the cell to cut for better ones."""
        i = bisect_right(self.starts, t - 1) - 1
        if i < 0:
            return 0, 0, None
        end, least, greatest = self.cells[self.starts[i]]
        if t >= greatest:
            return greatest, greatest, None
        if t < least:
            before = self.cells[self.starts[i - 1]][2] if i else 0
            return before, before, None
        return (least, least, None) if least == t else (least, t, self.starts[i])

    def fill(self, capacity: int, shards: int, end: int) -> tuple[bool | None, list[int], set[int]]:
        """Does greedy filling reach the end? With the cuts (lower bounds), and cells to cut if that is open."""
        low = high = 0
        cuts, unsure = [], set()
        for _ in range(shards):
            cuts.append(low)
            a, b = self.last(low + capacity), self.last(high + capacity)
            low, high = a[0], b[1]
            unsure |= {x for x in (a[2], b[2]) if x is not None}
        return (True if low >= end else False if high < end else None), cuts, unsure

    def cut(self, cells: set[int]) -> None:
        self._add([(s, self.cells[s][0]) for s in sorted(cells)], SPLIT)


def capacity(totals: Totals, largest: int, end: int, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and where its shards start."""
    low, high = max(largest, -(-end // shards)), max(largest, -(-end // shards)) + largest
    while low < high:
        middle = (low + high) // 2
        fits, _, unsure = totals.fill(middle, shards, end)
        if fits is None:
            totals.cut(unsure)
        elif fits:
            high = middle
        else:
            low = middle + 1
    while True:
        _, cuts, unsure = totals.fill(low, shards, end)
        if not unsure:
            return low, cuts
        totals.cut(unsure)


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", shards: int = SHARDS, overhead: int = OVERHEAD) -> DataFrame:
    """(key, size, text_crc32, shard, slot, shard_bytes_limit) for every row of docs."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    narrow = written(docs.select(F.col(key).alias("key"), (F.octet_length(raw) + overhead).cast("long").alias("size"), F.crc32(raw).alias("crc"), F.unhex(F.sha2(raw, 256)).alias("gid")), "sizes")
    groups = narrow.groupBy("gid").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).withColumn("bucket", (F.conv(F.hex(F.substring("gid", 1, 2)), 16, 10).cast("int") / (65536 // BUCKETS)).cast("int"))
    groups = written(groups.repartitionByRange("bucket"), "groups")
    earlier = W.orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # over BUCKETS rows at most
    offsets = groups.groupBy("bucket").agg(F.sum("n").alias("rows"), F.sum("bytes").alias("all")).select("bucket", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows0"), F.coalesce(F.sum("all").over(earlier), F.lit(0)).alias("bytes0"))
    so_far = W.partitionBy("bucket").orderBy("gid").rowsBetween(W.unboundedPreceding, 0)
    placed = groups.join(F.broadcast(offsets), "bucket").select("gid", "n", "bytes", (F.col("bytes0") + F.sum("bytes").over(so_far)).alias("total"), (F.col("rows0") + F.sum("n").over(so_far) - F.col("n")).alias("rank"))
    placed = written(placed, "totals")
    ends = placed.agg(F.max("total").alias("end"), F.max("bytes").alias("largest")).first()
    limit, cuts = capacity(Totals(placed, ends.end), ends.largest, ends.end, shards) if ends.end else (0, [0])
    inner = [F.lit(c).cast("long") for c in cuts[1:] if c < (ends.end or 0)] or [F.lit((1 << 63) - 1).cast("long")]
    of = F.size(F.filter(F.array(*inner), lambda c: c <= F.col("total") - F.col("bytes")))
    sharded = placed.select("gid", "n", "rank", of.cast("int").alias("shard"))
    first = sharded.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    sharded = sharded.join(F.broadcast(first), "shard").select("gid", "n", "shard", (F.col("rank") - F.col("first")).alias("slot0"))

    rows = narrow.join(sharded, "gid").withColumn("salt", F.pmod(F.coalesce(F.col("key"), F.lit(0)), F.lit(SALT)))
    several = rows.filter("n > 1")
    before = W.partitionBy("gid").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)  # over SALT rows at most
    salts = several.groupBy("gid", "salt").agg(F.count("*").alias("m")).select("gid", "salt", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("salt0"))
    within = F.row_number().over(W.partitionBy("gid", "salt").orderBy("key")) - 1
    ranked = several.withColumn("in", within).join(salts, ["gid", "salt"]).withColumn("slot", F.col("slot0") + F.col("salt0") + F.col("in"))
    out = ["key", "size", "crc", "shard", "slot"]
    both = rows.filter("n = 1").withColumn("slot", F.col("slot0")).select(out).unionByName(ranked.select(out))
    return both.select(F.col("key").alias(key), "size", F.col("crc").alias("text_crc32"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(limit).cast("long").alias("capacity"))


def op4_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = assign(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
