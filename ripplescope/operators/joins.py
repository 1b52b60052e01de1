"""Joins that Spark has no operator for: the last event before a row, the narrowest span around it, keys hot on either side."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplescope.plans.storage import settled

#: Rows of one key that one task may get from one side before the key is split.
HOT_ROWS = 20_000
#: The same where pairs are the work, and the most tasks that such blocks of pairs are dealt to.
BLOCK, MOST_TASKS = 6_000, 1 << 12
#: Lines that are put in order together; what a stretch leaves open is carried into those after it.
STRETCH = 1 << 14
#: The words between a span's ends are cut into aligned blocks of 1, 2, 4, ... and at most 2 ** LEVELS words.
LEVELS = 20


def spread_join(left: DataFrame, right: DataFrame, on: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Inner equi-join of one column whose hot keys are split, whichever side they are hot on.

    A key's rows on one side are dealt into parts of about `hot_rows` rows, those of the other side repeated for each
    part; so no task joins more than a part with a part. Without a hot key it is a plain join.
    """
    hot = _hot(left, right, on, hot_rows)
    if hot.isEmpty():
        return left.join(right, on)
    return _dealt(left, hot, on, "__l", "__r").join(_dealt(right, hot, on, "__r", "__l"), [on, "__l_part", "__r_part"]).drop("__l_part", "__r_part")


def _hot(left: DataFrame, right: DataFrame, on: str, hot_rows: int) -> DataFrame:
    """(on, __l, __r): into how many parts each side of a key is dealt that is hot on either."""
    counted = [side.groupBy(on).agg(F.count("*").alias("n")).filter(F.col("n") > hot_rows).select(on, F.ceil(F.col("n") / hot_rows).cast("int").alias(parts)) for side, parts in ((left, "__l"), (right, "__r"))]
    return settled(counted[0].join(counted[1], on, "full_outer").fillna(1, ["__l", "__r"]))


def _dealt(side: DataFrame, hot: DataFrame, on: str, own: str, other: str) -> DataFrame:
    known = side.join(hot, on, "left").fillna(1, ["__l", "__r"])
    part = F.pmod(F.xxhash64(*[F.col(c) for c in side.columns]), F.col(own)).cast("int")
    every = F.sequence(F.lit(0), F.col(other) - 1)
    return known.select(*side.columns, part.alias(f"{own}_part"), F.explode(every).alias(f"{other}_part"))


def product_join(left: DataFrame, right: DataFrame, on: str, block: int = BLOCK) -> DataFrame:
    """The same join for keys of which many rows meet many, so that the pairs are the work.

    Both sides of a key are dealt into parts of about `block` rows. A part of `right` is one row with an array, which each row of
    its part of `left` meets once and unfolds; so pairs cost no lookup, and no task holds more of a key than two parts.
    """
    left, right = left.filter(F.col(on).isNotNull()), right.filter(F.col(on).isNotNull())
    hot = _hot(left, right, on, block)
    blocks = hot.agg(F.sum(F.col("__l").cast("long") * F.col("__r"))).head()[0] or 0
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(blocks, MOST_TASKS))
    keys = [on, "__l_part", "__r_part"]
    at = lambda side, own, other: _dealt(side, hot, on, own, other).repartition(tasks, *keys)
    packed = at(right, "__r", "__l").groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in right.columns if c != on])).alias("__met"))
    return at(left, "__l", "__r").join(packed, keys).select(*left.columns, F.inline("__met"))


def _words(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, __word, __bits): the distinct places of `rows`, 64 of them in a row as the bits of a long."""
    place = F.col(at).cast("long")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place.bitwiseAND(F.lit(63))).cast("int"))
    return rows.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, F.shiftright(place, 6).alias("__word")).agg(F.bit_or(bit).alias("__bits"))


def _placed(pieces: DataFrame, key: str, at: str, kind: T.DataType, value: Column) -> DataFrame:
    """(key, at, value): the places in __bits from offset low to offset high of each piece (key, __word, __bits, p)."""
    each = pieces.select(key, "__word", "__bits", value, F.explode(F.sequence("p.low", "p.high")).alias("__o")).filter(F.getbit("__bits", F.col("__o")) == 1)
    return each.drop("__bits").select(key, (F.shiftleft("__word", 6) + F.col("__o")).cast(kind).alias(at), *[c for c in each.columns if c not in (key, "__word", "__bits", "__o")])


def last_before(rows: DataFrame, events: DataFrame, key: str, at: str, value: str, stretch: int = STRETCH) -> DataFrame:
    """(key, at, value): for each distinct place of `rows` (key, at) the value of the last of `events` (key, at, value) at or before it.

    Of events at one place the least value counts. Places and events come together in words of 64 places, each a row; the last
    event of each word is carried to the next ones of its stretch, that of each stretch to the next stretches. So places are
    shuffled as bits, a key with very many places is many tasks, and each place is looked at once.
    Places without an event before them, and null keys and places, are left out.
    """
    kinds = {c: rows.schema[c].dataType for c in (at,)} | {value: events.schema[value].dataType}
    word = F.shiftright(F.col(at).cast("long"), 6)
    events = events.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(key, at).agg(F.min(value).alias(value))
    event = F.struct(F.col(at).cast("long").bitwiseAND(F.lit(63)).cast("int").alias("o"), F.col(value).alias("v"))
    held = events.groupBy(key, word.alias("__word")).agg(F.array_sort(F.collect_list(event)).alias("__events"))
    none = F.array().cast(held.schema["__events"].dataType)
    both = _words(rows, key, at).join(held, [key, "__word"], "full_outer").withColumn("__events", F.coalesce("__events", none))
    both = both.withColumn("__part", F.floor(F.col("__word") / max(1, stretch >> 6)))
    last = F.try_element_at("__events", F.lit(-1))
    before = lambda *keys: Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    near = both.withColumn("__near", F.last(last, ignorenulls=True).over(before(key, "__part").orderBy("__word")))
    ends = events.groupBy(key, F.floor(word / max(1, stretch >> 6)).alias("__part")).agg(F.max_by(event, at).alias("__v"))
    open_at = ends.unionByName(both.select(key, "__part").distinct().withColumn("__v", F.lit(None).cast(ends.schema["__v"].dataType)))
    open_at = open_at.groupBy(key, "__part").agg(F.first("__v", ignorenulls=True).alias("__v"))
    carried = open_at.select(key, "__part", F.last("__v", ignorenulls=True).over(before(key).orderBy("__part")).alias("__carried"))
    met = near.filter("__bits is not null").join(carried, [key, "__part"]).withColumn("__open", F.coalesce("__near", "__carried"))
    # each event holds up to the next one, what is carried up to the first
    events_of, first = F.col("__events"), F.coalesce(F.try_element_at("__events", F.lit(1))["o"], F.lit(64))
    part = lambda e, low, end: F.struct(e.alias("e"), low.alias("low"), (end - 1).alias("high"))
    own = F.transform(events_of, lambda e, i: part(e, e["o"], F.coalesce(F.try_element_at(events_of, i + 2)["o"], F.lit(64))))
    opened = F.when(F.col("__open").isNotNull() & (first > 0), F.array(part(F.col("__open"), F.lit(0), first))).otherwise(F.array().cast("array<struct<e:struct<o:int,v:%s>,low:int,high:int>>" % kinds[value].simpleString()))
    pieces = met.select(key, "__word", "__bits", F.explode(F.concat(opened, own)).alias("p"))
    return _placed(pieces, key, at, kinds[at], F.col("p.e.v").alias(value))


def _blocks(start: Column, end: Column) -> Column:
    """The fewest aligned blocks (level, block) that make up the words from start to end; the widest as often as needed."""
    kind = "array<struct<level:int,block:int>>"
    first = F.struct(start.cast("int").alias("low"), (end + 1).cast("int").alias("high"), F.array().cast(kind).alias("out"))

    def one(level: Column, block: Column, when: Column) -> Column:
        return F.when(when, F.array(F.struct(level.cast("int").alias("level"), block.cast("int").alias("block")))).otherwise(F.array().cast(kind))

    def step(a: Column, level: Column) -> Column:
        some = a["low"] < a["high"]
        odd_low, odd_high = some & (a["low"] % 2 != 0), some & (a["high"] % 2 != 0)
        low, high = a["low"] + odd_low.cast("int"), a["high"] - odd_high.cast("int")
        out = F.concat(a["out"], one(level, a["low"], odd_low), one(level, a["high"] - 1, odd_high & (a["low"] < a["high"] - odd_low.cast("int"))))
        return F.struct(F.shiftright(low, 1).alias("low"), F.shiftright(high, 1).alias("high"), out.alias("out"))

    def rest(a: Column) -> Column:
        wide = F.when(a["low"] < a["high"], F.sequence(a["low"], a["high"] - 1)).otherwise(F.array().cast("array<int>"))
        return F.concat(a["out"], F.transform(wide, lambda b: F.struct(F.lit(LEVELS).alias("level"), b.alias("block"))))

    return F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS - 1)), first, step, rest)


def narrowest_around(rows: DataFrame, spans: DataFrame, key: str, at: str, start: str, end: str, value: str) -> DataFrame:
    """(key, at, value): for each distinct place of `rows` (key, at) the value of the narrowest of `spans` around it, ends included.

    Of equally narrow ones the first counts, then the least value. Places come in words of 64, each a row. A span is cut into its
    pieces of the words in which it begins and ends, and aligned blocks of the words between. Of each piece and block only the
    narrowest span is kept, as all of its places lie within. A word meets its pieces (2,080 at most) as one row, and its own block
    of each width in use; from the narrowest on each takes the places that are left. So places are shuffled as bits, and the work
    grows with places and spans, however they nest or cross. Places in no span are left out, spans that end before they start hold none.
    """
    kind = rows.schema[at].dataType
    low, high = F.col("low"), F.col("high")
    rank = F.struct((high - low).alias("width"), low.alias("start"), F.col(value).alias("value"))
    spans = spans.select(key, F.col(start).cast("long").alias("low"), F.col(end).cast("long").alias("high"), value).filter("low <= high")
    first, last = F.shiftright("low", 6), F.shiftright("high", 6)
    begin, stop = (low.bitwiseAND(F.lit(63))).cast("int"), (high.bitwiseAND(F.lit(63))).cast("int")
    piece = lambda level, block, a, b: F.struct(level.cast("int").alias("level"), block.cast("long").alias("block"), a.cast("int").alias("low"), b.cast("int").alias("high"))
    zero, full = F.lit(0), F.lit(63)
    between = F.transform(_blocks(first + 1, last - 1), lambda b: piece(b["level"] + 1, b["block"], zero, full))
    made = F.when(first == last, F.array(piece(zero, first, begin, stop))).when(
        first + 1 == last, F.array(piece(zero, first, begin, full), piece(zero, last, zero, stop))
    ).otherwise(F.concat(F.array(piece(zero, first, begin, full), piece(zero, last, zero, stop)), between))
    best = settled(spans.select(key, rank.alias("rank"), F.explode(made).alias("b")).select(key, "b.*", "rank").groupBy(key, "level", "block", "low", "high").agg(F.min("rank").alias("rank")))
    words = _words(rows, key, at)
    near, wide = best.filter("level = 0"), best.filter("level > 0")
    levels = sorted(r[0] for r in wide.select("level").distinct().collect())  # LEVELS + 1 at most
    held = near.select(key, F.col("block").alias("__word"), F.struct("rank", "low", "high").alias("p"))
    if levels:
        own = F.array(*[F.struct(F.lit(k).alias("level"), F.shiftright("__word", k - 1).alias("block")) for k in levels])
        offered = words.select(key, "__word", F.explode(own).alias("b")).select(key, "__word", "b.level", "b.block")
        over = offered.join(wide, [key, "level", "block"]).groupBy(key, "__word").agg(F.min("rank").alias("rank"))
        held = held.unionByName(over.select(key, "__word", F.struct("rank", zero.alias("low"), full.alias("high")).alias("p")))
    words = words.join(held.groupBy(key, "__word").agg(F.array_sort(F.collect_list("p")).alias("__held")), [key, "__word"])
    # all ones from offset low to offset high
    mask = lambda p: F.call_function("shiftleft", F.call_function("shiftrightunsigned", F.lit(-1).cast("long"), F.lit(63) - p["high"] + p["low"]), p["low"])
    taken = F.struct(F.col("__bits").alias("left"), F.array().cast(f"array<struct<rank:{best.schema['rank'].dataType.simpleString()},low:int,high:int,bits:bigint>>").alias("out"))

    def take(a: Column, p: Column) -> Column:
        mine = a["left"].bitwiseAND(mask(p))
        won = F.struct(p["rank"].alias("rank"), p["low"].alias("low"), p["high"].alias("high"), mine.alias("bits"))
        return F.struct((a["left"].bitwiseXOR(mine)).alias("left"), F.when(mine != 0, F.array_append(a["out"], won)).otherwise(a["out"]).alias("out"))

    won = words.select(key, "__word", F.explode(F.aggregate("__held", taken, take, lambda a: a["out"])).alias("p"))
    return _placed(won.select(key, "__word", F.col("p.bits").alias("__bits"), "p"), key, at, kind, F.col("p.rank.value").alias(value))
