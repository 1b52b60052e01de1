"""Shards of near equal bytes that never split a group of equal texts.

Groups of equal texts stand in the order of their SHA-256, which no size depends on. The least capacity with which that
many contiguous shards hold all of them is found by bisection, each guess tried greedily, and the first shard is cut
there; the rest is solved anew for the shards left, so that what one cut leaves over is shared by all that follow. A
group above the average of what is left would force its size on every shard; it is taken out first, as a shard of its own.

Groups aren't gathered. Sums by prefix of the digest go to the driver; they tell between which ends each capacity and
each cut lies, and only prefixes that may still hold a cut are summed by a longer prefix. Their number depends on the
number of shards and not on the rows.

Null text counts as empty, without bytes; empty and null are one group. Repeated rows are placed each for itself, in one
shard as their texts are equal; rows with a null id come first in their group. Texts are read whole. With fewer groups
than shards the last shards are empty; no rows give no rows. Other columns of the input are left out, whatever their names.
"""
from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.llm import _common as C

#: Hexadecimal digits of the first prefix and of each longer one: at most 4096 sums, then 256 for each prefix that may hold a cut.
FIRST, MORE = 3, 2
#: Groups in such prefixes, all together, from which on they are asked for one by one; 64 digits at most.
FEW = 1 << 16

#: (prefix, bytes, groups)
Cell = tuple[str, int, int]


def least(test: Callable[[int], bool], low: int, high: int) -> int:
    """The least number from low to high that passes; high if none below it does."""
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if test(middle) else (middle + 1, high)
    return low


class _Line:
    """Cells end to end. Within one of several groups an end may lie anywhere or nowhere."""

    def __init__(self, cells: list[Cell]):
        self.cells, self.ends = cells, [0, *accumulate(c[1] for c in cells)]

    def last(self, at: int, hopeful: bool) -> int:
        """The last end that is at most `at`: the greatest that can be, or the least."""
        k = bisect_right(self.ends, at) - 1
        return at if hopeful and k < len(self.cells) and self.cells[k][2] > 1 else self.ends[k]

    def holds(self, start: int, shards: int, capacity: int, hopeful: bool) -> bool:
        for _ in range(shards):
            start = self.last(start + capacity, hopeful)
        return start >= self.ends[-1]

    def cuts(self, shards: int) -> list[tuple[int, int]]:
        """Between which ends each shard's end lies; equal where it is known."""
        low, high, found, total = 0, 0, [], self.ends[-1]
        for left in range(shards, 0, -1):
            need = least(lambda c: self.holds(high, left, c, True), -(-(total - high) // left), total - high)
            most = least(lambda c: self.holds(low, left, c, False), -(-(total - low) // left), total - low)
            low, high = self.last(low + need, False), min(self.last(high + most, True), total)
            found.append((low, high))
        return found

    def open(self, cuts: list[tuple[int, int]]) -> set[int]:
        """Cells of several groups in which one of the cuts may lie."""
        found: set[int] = set()
        for low, high in cuts:
            k = bisect_right(self.ends, low) - 1
            while k < len(self.cells) and self.ends[k] < high:
                if self.cells[k][2] > 1 and (low, high) != (self.ends[k], self.ends[k]):
                    found.add(k)
                k += 1
        return found


def _sums(groups: DataFrame, digits: int, within: list[str] | None = None) -> list[Cell]:
    """Sums of groups (digest, bytes) by so many hexadecimal digits, of those in the given prefixes alone if there are any."""
    key = F.lower(F.hex("digest"))
    if within is not None:
        groups = groups.filter(F.substring(key, 1, len(within[0])).isin(within))
    summed = groups.groupBy(F.substring(key, 1, digits).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
    return sorted((r.prefix, r.bytes, r.n) for r in summed.collect())


def boundaries(groups: DataFrame, shards: int) -> list[str | None]:
    """The prefix with which each shard but the first begins, None where nothing is left; groups: digest binary, bytes long."""
    cells, digits = _sums(groups, FIRST), FIRST
    while cells:
        line = _Line(cells)
        cuts = line.cuts(shards)
        todo = line.open(cuts)
        if not todo:
            return [cells[k][0] if (k := bisect_right(line.ends, low) - 1) < len(cells) else None for low, _ in cuts[:-1]]
        by_length: dict[int, list[int]] = {}
        for k in todo:
            by_length.setdefault(len(cells[k][0]), []).append(k)
        few = sum(cells[k][2] for k in todo) <= FEW
        longer: list[Cell] = []
        for length, which in by_length.items():
            longer += _sums(groups, 64 if few else min(64, length + MORE), [cells[k][0] for k in which])
        cells = sorted([c for k, c in enumerate(cells) if k not in todo] + longer)
    return [None] * (shards - 1)


def giants(groups: DataFrame, shards: int) -> list[tuple[str, int]]:
    """(digest, bytes) of the groups above the average of what larger ones leave over, in order of size; fewer than `shards`."""
    total = groups.agg(F.sum("bytes")).head()[0] or 0
    found: list[tuple[str, int]] = []
    for r in groups.orderBy(F.desc("bytes"), "digest").limit(shards - 1).select(F.lower(F.hex("digest")).alias("digest"), "bytes").collect():
        if r.bytes * (shards - len(found)) <= total:
            break
        found.append((r.digest, r.bytes))
        total -= r.bytes
    return found


def shard(docs: DataFrame, shards: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of all rows; slot counts from 0 within the shard, by digest and id.

    size: bytes of the text and one more. Rows of a hot group are dealt by digest, id and place, so that no task gets them all.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = text.cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(raw, 256)).alias("digest"), F.monotonically_increasing_id().alias("row"))
    rows = C.store(rows, "sized")
    groups = C.store(rows.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    alone = giants(groups, shards)
    digests = [F.unhex(F.lit(d)) for d, _ in alone]
    rest = groups.filter(~F.col("digest").isin(digests)) if alone else groups
    starts = [F.unhex(F.lit(p + "0" * (len(p) % 2))) for p in boundaries(rest, shards - len(alone)) if p is not None]
    place = F.lit(len(alone))
    for start in starts:
        place = place + (F.col("digest") >= start).cast("int")
    for k, digest in enumerate(digests):
        place = F.when(F.col("digest") == digest, F.lit(k)).otherwise(place)
    order = ("shard", "digest", "id", "row")
    placed = rows.withColumn("shard", place).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = C.store(placed.select("id", "size", "text_crc32", "shard", F.monotonically_increasing_id().alias("at")), "placed")
    C.drop(rows, groups)
    # `at` counts within a task: of each task's rows of a shard the first, and how many of that shard stand in tasks before
    part = F.shiftright("at", 33).alias("part")
    runs = placed.groupBy("shard", part).agg(F.min("at").alias("first"), F.count("*").alias("n"))
    runs = runs.select("shard", "part", (F.expr("sum(n) over (partition by shard order by part) - n") - F.col("first")).alias("base"))
    numbered = placed.withColumn("part", part).join(F.broadcast(runs), ["shard", "part"])  # a row for each task and shard
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("at") + F.col("base")).alias("slot"))


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in eight shards of near equal bytes."""
    found = shard(C.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
