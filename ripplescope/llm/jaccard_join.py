"""Exact n-gram Jaccard join of whole texts, heavy and light by size.

Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased; a document's set holds its distinct
shingles of `words` words, or its whole sequence if that is shorter. Two sets link when 100 * intersection >=
`percent` * union. Texts become sets of 64-bit hashes; equal sets are one node from then on, so copies cost no
pairs.

Light sets (size up to a boundary) list, for each size a partner may have, all subsets of the size that the
intersection must reach; sharing a subset is a candidate. Heavy sets scan inverted lists: shingles are ordered
by how often they occur, rarest first, as a sketch of 2^20 counters over all documents tells (any order is
exact, this one keeps common passages out), and only the positions can hold the first common shingle of a
pair count: n - need(n, m) + 1 of each. Sizes from which a heavy set may reach stay in the lists as well. The
boundary is the size at which subsets to list plus list entries to scan are fewest.

Candidates are taken in two rounds. First each list's entries are paired with three members, two of those that
stand first in it (so have few shingles of their own) and one by hash; verified links are contracted to
components. Then all pairs of a list that are in different components and may still link are verified. So a
list of n near copies costs about n pairs, and no link between components is lost. Pairs whose listed shingles
rule a link out go first, in the second round where they meet, by 256 bits for each set that tell how many of one's
listed shingles the other lacks at least; the whole sets of the others are intersected.

component_id is the smallest id reachable by links. Null or word-free text has the empty set (n_shingles 0)
and links with nothing; its component is its own id. Repeated rows are equal texts. A null id counts with its
equal sets, is never the smallest, and links with no other set if none of them has an id. No rows give no rows;
other columns of the input are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplescope.llm import _common as C
from ripplescope.llm._graph import components
from ripplescope.llm._words import mix, word_hashes

SKETCH_BITS, SMALL, BROADCAST_IDS, LIST = 20, 40, 500_000, 256
_K = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    hashes, counts = word_hashes(texts)
    at = np.concatenate(([0], np.cumsum(counts)))
    size = max(0, len(hashes) - words + 1)
    rolled = np.full(size, np.uint64(words))
    for k in range(words):
        rolled = (rolled ^ hashes[k : k + size]) * _K
        rolled ^= rolled >> np.uint64(29)
    rolled = mix(rolled)
    out = []
    for a, b in zip(at[:-1], at[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a : b - words + 1]))
        elif b > a:
            whole = np.full(1, np.uint64(b - a))
            for h in hashes[a:b]:
                whole = (whole ^ h) * _K
                whole ^= whole >> np.uint64(29)
            out.append(mix(whole))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _sets(batch: pa.RecordBatch, column: int, words: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sets) of runs of rows."""
    for at, texts in C.text_groups(batch.column(column)):
        yield at, shingle_sets(texts, words)


def _node(s: np.ndarray) -> int | None:
    """The name of a set: a hash of its shingles, null for the empty one."""
    return int(mix(np.array([s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s))], np.uint64)).view(np.int64).sum()) if len(s) else None


def sketch(texts: DataFrame, words: int) -> np.ndarray:
    """How many shingles of all documents fall on each counter; 4 MB, whatever the input."""
    blocks = 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for _, sets in _sets(batch, 0, words):
                place, n = np.unique((np.concatenate(sets) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), return_counts=True)
                total[place] += n
        yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([np.minimum(p, 0xFFFFFFFF).astype("<u4").tobytes() for p in np.split(total, blocks)], pa.binary())], names=["block", "part"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((1 << SKETCH_BITS) // blocks, np.int64)
        for part in table["part"]:
            total += np.frombuffer(part.as_py(), "<u4")
        return pa.table({"block": table["block"][:1], "part": pa.array([np.minimum(total, 0xFFFFFFFF).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros((blocks, (1 << SKETCH_BITS) // blocks), np.uint32)
    for row in texts.mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(add, "block int, part binary").collect():
        out[row["block"]] = np.frombuffer(row["part"], "<u4")
    return out.ravel()


def _least_partner(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def need(n: int, m: int, percent: int) -> int:
    """The least intersection of sets of sizes n and m that link."""
    return -(-percent * (n + m) // (100 + percent))


def _need(n: Column, m: Column, percent: int) -> Column:
    return F.ceil(percent * (n + m) / F.lit(100 + percent))


def _described(docs: DataFrame, counters: np.ndarray, words: int, percent: int) -> DataFrame:
    """(id, n, node, order, whole, load): the set's size and signature, its rarest shingles in order, all of a small set's."""
    shared = docs.sparkSession.sparkContext.broadcast(counters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = shared.value
        mean = float(counters.mean())
        kinds = (pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64())
        for batch in batches:
            for at, sets in _sets(batch, 1, words):
                size, node, first, whole, load = [], [], [], [], []
                for s in sets:
                    n = len(s)
                    size.append(n)
                    node.append(_node(s))
                    weight = counters[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                    chosen = np.lexsort((s, weight))[: n - _least_partner(n, percent) + 1] if n else np.zeros(0, np.int64)
                    first.append(s[chosen].view(np.int64))
                    whole.append(s.view(np.int64) if 0 < n <= SMALL else None)
                    load.append(float(np.maximum(weight[chosen] - mean, 1).sum()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(sets)), *(pa.array(v, t) for v, t in zip((size, node, first, whole, load), kinds))], names=names)

    names = ["__id", "n", "node", "order", "whole", "load"]
    longs = T.ArrayType(T.LongType())
    kinds = T.StructType([docs.schema[0], *(T.StructField(n, t) for n, t in zip(names[1:], (T.IntegerType(), T.LongType(), longs, longs, T.DoubleType())))])
    return docs.mapInArrow(run, kinds)


def _subset_sizes(n: int, most: int, percent: int) -> list[tuple[int, int]]:
    """(partner's size, intersection needed) for each partner of at most `most`, other than an equal set."""
    partners = range(_least_partner(n, percent), min(most, n * 100 // percent) + 1)
    return [(m, o) for m in partners if (o := need(n, m, percent)) <= min(n, m) and not o == n == m]


def boundary(counts: dict[int, tuple[int, float]], percent: int) -> int:
    """The largest light size, from the number of sets and the list entries to scan of each size up to SMALL."""
    def cost(x: int) -> float:
        light = sum(k * sum(comb(n, o) for _, o in _subset_sizes(n, x, percent)) for n, (k, _) in counts.items() if n <= x)
        return light + sum(load for n, (_, load) in counts.items() if n > x)

    return min(range(SMALL + 1), key=cost)


def _subsets(nodes: DataFrame, most: int, percent: int) -> DataFrame:
    """(token, node, n): all subsets of the needed sizes of light sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, node, size = [], [], []
            for i, whole in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                n = len(whole)
                s = mix(np.array(whole, np.int64).view(np.uint64))
                for m, o in _subset_sizes(n, most, percent):
                    rows = np.fromiter((x for c in combinations(range(n), o) for x in c), np.int64).reshape(-1, o)
                    key = mix(s[rows].sum(axis=1, dtype=np.uint64) + np.uint64(min(n, m) << 16 | max(n, m)))
                    token += key.view(np.int64).tolist()
                    node += [i] * len(key)
                    size += [n] * len(key)
            yield pa.RecordBatch.from_arrays([pa.array(token, pa.int64()), pa.array(node, pa.int64()), pa.array(size, pa.int32())], names=["token", "node", "n"])

    return nodes.select("node", "whole").mapInArrow(run, "token long, node long, n int")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Whether two entries of a list can be the first common shingle of sets that link."""
    n, m, i, j = F.col(f"{x}.n"), F.col(f"{y}.n"), F.col(f"{x}.pos"), F.col(f"{y}.pos")
    least = _need(n, m, percent)
    listed = (i <= n - least) & (j <= m - least) & (1 + F.least(i, j) + F.least(n - i, m - j) - 1 >= least)
    return (least <= F.least(n, m)) & ((i < 0) | listed)


def _bits(order: str = "order") -> list[Column]:
    """A set's listed shingles as 256 bits, in four columns, and their number."""
    words = [F.expr(f"aggregate({order}, 0L, (a, x) -> if((shiftright(x, 62) & 3) = {k}, a | shiftleft(1L, cast(x & 63 as int)), a))").alias(f"bits{k}") for k in range(4)]
    return [*words, F.size(order).alias("listed")]


def _has_room(x: str, y: str, percent: int) -> Column:
    """Whether two sets can link by their _bits(): what one lists and the other lacks the bit of isn't common to their lists."""
    def common(a: str, b: str) -> Column:
        lacking = [F.bit_count(F.col(f"{a}.bits{k}").bitwiseAND(F.bitwise_not(F.col(f"{b}.bits{k}")))) for k in range(4)]
        return F.col(f"{a}.listed") - (lacking[0] + lacking[1] + lacking[2] + lacking[3])

    rest = F.greatest(*[F.col(f"{a}.n") - F.col(f"{a}.listed") for a in (x, y)])
    return F.least(common(x, y), common(y, x)) + rest >= _need(F.col(f"{x}.n"), F.col(f"{y}.n"), percent)


def _crossed(rest: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y) of entries of a list that are in different components and may link.

    Only sizes of neighbouring bands can link; a list of over LIST entries is dealt over several tasks.
    """
    band = F.floor(F.log("n") / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n").cast("long")
    sized = rest.withColumn("band", band)
    parts = sized.groupBy("token", "band").agg(F.ceil(F.count("*") / F.lit(LIST)).cast("int").alias("parts"))
    near = parts.select("token", "parts", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1)))).alias("band"))
    parts = near.groupBy("token", "band").agg(F.max("parts").alias("parts"))  # of the lists that a band's entries meet
    dealt = sized.join(parts, ["token", "band"])
    x = dealt.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")).alias("x")
    met = sized.withColumn("band", F.explode(F.array(*(F.col("band") + k for k in (-1, 0, 1))))).join(parts, ["token", "band"])
    y = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.part") == F.col("y.part"))
    return x.join(y, same & (F.col("x.root") < F.col("y.root")) & _may_link("x", "y", percent) & _has_room("x", "y", percent))


def _near(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Those of `pairs` whose listed shingles leave room for a link.

    Say x's list ends first in the order of shingles. What x and y share is in both lists or in x's unlisted
    rest, so it is at most the lists' intersection and that rest; whichever ends first, the longer rest will do.
    """
    listed = nodes.select("node", "n", "order")
    x, y = (listed.select(F.col("node").alias(k), F.col("n").alias(f"n{k}"), F.col("order").alias(f"o{k}")) for k in "ab")
    room = F.size(F.array_intersect("oa", "ob")) + F.greatest(F.col("na") - F.size("oa"), F.col("nb") - F.size("ob"))
    return pairs.join(x, "a").join(y, "b").filter(room >= _need(F.col("na"), F.col("nb"), percent)).select("a", "b")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """A stored table of those (a, b) of `pairs` whose whole sets link."""
    wanted = C.store(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct().join(nodes.select("node", F.col("id").alias("__id")), "node"), "wanted")
    ids = wanted.select("__id").distinct()
    number = isinstance(ids.schema[0].dataType, T.NumericType)
    if number and ids.count() <= BROADCAST_IDS:  # of 8 bytes each; ids of other kinds have no such bound
        ids = F.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _sets(batch, 0, words):
                yield pa.RecordBatch.from_arrays([pa.array(map(_node, sets), pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], names=["node", "shingles"])

    sets = docs.join(ids, "__id").select("__text").mapInArrow(run, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles"))
    sets = C.store(sets, "sets", "uncompressed")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    linked = C.store(both.filter(100 * common >= percent * (F.size("x") + F.size("y") - common)).select("a", "b"), "verified")
    C.drop(wanted, sets)
    return linked


def jaccard_join(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for each row of `docs`."""
    source = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    described = C.store(_described(source, sketch(source.select("__text"), words), words, percent), "described", "uncompressed")
    nodes = described.filter("node is not null").groupBy("node").agg(F.min("__id").alias("id"), F.first("n").alias("n"), F.first("order").alias("order"), F.first("whole").alias("whole"), F.first("load").alias("load"))
    nodes = C.store(nodes, "nodes", "uncompressed")
    members = C.store(described.select("__id", "n", "node"), "members")
    C.drop(described)

    small = nodes.filter(F.col("n") <= SMALL).groupBy("n").agg(F.count("*").alias("k"), F.sum("load").alias("load")).collect()
    light = boundary({r["n"]: (r["k"], r["load"]) for r in small}, percent)
    heavy = nodes.filter(F.col("n") >= _least_partner(light + 1, percent)).select(F.posexplode("order").alias("pos", "token"), "node", "n")
    entries = heavy.select("token", "node", "n", "pos")
    if light:
        entries = entries.unionByName(_subsets(nodes.filter(F.col("n") <= light), light, percent).withColumn("pos", F.lit(-1)))

    central = [F.col("pos"), F.col("pos"), F.lit(0)]  # what has few shingles of its own before this one is like many
    picked = [F.min(F.struct(first.alias("first"), F.xxhash64("node", F.lit(k)).alias("h"), "node", "n", "pos")).alias(f"p{k}") for k, first in enumerate(central)]
    shared = entries.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token")
    live = C.store(entries.join(shared, "token"), "lists")
    lists = live.groupBy("token").agg(*picked)
    chosen = live.join(lists, "token").select("token", F.struct("node", "n", "pos").alias("x"), F.explode(F.array("p0", "p1", "p2")).alias("y")).filter("x.node <> y.node").filter(_may_link("x", "y", percent))
    pairs = C.store(chosen.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct(), "pairs")
    near = C.store(_near(pairs, nodes, percent), "near_pairs")
    links = _verified(near, nodes, source, words, percent)
    first = components(links)
    C.drop(near, links)

    rest = live.join(first, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rest.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("token")
    rest = C.store(rest.join(mixed, "token", "left_semi").join(nodes.select("node", *_bits()), "node"), "rest")
    crossed = _crossed(rest, percent)
    crossed = crossed.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    crossed = C.store(_near(crossed, nodes, percent), "more_pairs")
    C.drop(live, pairs, rest)
    more = _verified(crossed, nodes, source, words, percent)
    found = components(first.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    C.drop(crossed, more, first)

    rooted = C.store(found.join(nodes.select("node", "id"), "node"), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component_id"))
    named = rooted.join(least, "root").select("node", "component_id")
    known = C.store(nodes.select("node", "id").join(named, "node", "left").select("node", F.coalesce("component_id", "id").alias("component_id")), "known")
    C.drop(found, rooted, nodes)
    linked = members.filter("node is not null").join(known, "node").select("__id", "n", "component_id")
    empty = members.filter("node is null").select("__id", "n", F.col("__id").alias("component_id"))
    return linked.unionByName(empty).select(F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(C.table(spark, sf_dir, "documents"), words=3, percent=90)
