"""The file graph: edges (src, dst), src importing dst; nodes (path).

Everything is keyed, so that one plan serves many change sets. Reach within a bound is unrolled to that many joins;
each level keeps one row for a key and node before it joins again, so it grows with nodes, not with paths. What several
change sets share (a file's dependents) is worked out once for the file.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplescope.operators.joins import HOT_ROWS, spread_join
from ripplescope.plans.storage import settled

#: Longs of a label of reach, 64 files' bits each; and the rounds after which labels are given up.
LABEL_WORDS, LABEL_ROUNDS = 4, 64


def dependents(edges: DataFrame) -> DataFrame:
    """(path, dependents): who imports each file, sorted."""
    return edges.groupBy(F.col("dst").alias("path")).agg(F.array_sort(F.collect_set("src")).alias("dependents"))


def dependencies(edges: DataFrame) -> DataFrame:
    """(path, dependencies): what each file imports, sorted."""
    return edges.groupBy(F.col("src").alias("path")).agg(F.array_sort(F.collect_set("dst")).alias("dependencies"))


def centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, centrality): in-degree, 0 for files that nothing imports."""
    counted = edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("centrality"))
    return nodes.select("path").join(counted, "path", "left").fillna(0, ["centrality"])


def top_central(edges: DataFrame, n: int = 10) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("path")).agg(F.count("*").alias("centrality")).orderBy(F.desc("centrality"), "path").limit(n)


def reach(seeds: DataFrame, nodes: DataFrame, edges: DataFrame, hops: int) -> DataFrame:
    """(seed, path, distance) of what lies within `hops` forward of each seed that is a node, itself included."""
    level = seeds.select("seed").distinct().join(nodes.select(F.col("path").alias("seed")), "seed", "left_semi").select("seed", F.col("seed").alias("path"))
    found = level.withColumn("distance", F.lit(0))
    for d in range(1, hops + 1):
        level = level.join(edges.select(F.col("src").alias("path"), F.col("dst").alias("next")), "path").select("seed", F.col("next").alias("path")).distinct()
        found = found.unionByName(level.withColumn("distance", F.lit(d)))
    return found.groupBy("seed", "path").agg(F.min("distance").alias("distance"))


def distance(pairs: DataFrame, nodes: DataFrame, edges: DataFrame, bound: int | None = None) -> DataFrame:
    """`pairs` (src, dst) with their distance: 0 to itself, node or not; -1 out of reach, beyond a `bound`, or where src is no node."""
    if bound is None:
        return _distance_any(pairs, nodes, edges)
    near = reach(pairs.select(F.col("src").alias("seed")), nodes, edges, bound).select(F.col("seed").alias("src"), F.col("path").alias("dst"), "distance")
    return _with_distance(pairs, near)


def _with_distance(pairs: DataFrame, near: DataFrame) -> DataFrame:
    known = pairs.join(near, ["src", "dst"], "left")
    return known.withColumn("distance", F.when(F.col("src") == F.col("dst"), 0).otherwise(F.coalesce("distance", F.lit(-1))))


def _distance_any(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """`pairs` with their distance, without a bound.

    Labels of both ends rule out most pairs that have no way, before any frontier grows: all pairs meet them once and are kept
    once, only those left are followed.
    """
    labels = _reach_labels(edges)
    if labels is None:
        marked = asked = settled(pairs.withColumn("__near", F.lit(True)))
    else:
        marked = settled(_held_by(pairs, labels.filter("__side = 0"), "src", "dst").withColumn("__near", F.col("__held") & F.coalesce(F.col("src") != F.col("dst"), F.lit(False))).drop("__held"))
        asked = _held_by(marked.filter("__near"), labels.filter("__side = 1"), "dst", "src").filter("__held")
    near = _with_distance(marked.filter("__near").drop("__near"), _settle_pairs(asked.select("src", "dst"), nodes, edges))
    far = marked.filter("not __near").drop("__near").withColumn("distance", F.when(F.col("src") == F.col("dst"), 0).otherwise(-1))
    return near.unionByName(far)


def _place(node: Column) -> Column:
    return F.pmod(node, F.lit(64 * LABEL_WORDS)).cast("int")


def _reach_labels(edges: DataFrame) -> DataFrame | None:
    """(__side, __node, __b0, ...): for each file's hash the bits of all files it reaches (side 0) and of all that reach it (side 1).

    A bit that is missing rules a way out, one that is there doesn't prove it: files share bits, and those of one hash are
    one node. A label is handed on only as far as it has new bits, and has a fixed width, so a round costs no more than the edges.
    None if that has not come to its end in LABEL_ROUNDS; labels without all bits would rule out pairs that have a way.
    """
    bits = [f"__b{i}" for i in range(LABEL_WORDS)]
    ends = settled(edges.select(F.xxhash64("src").alias("a"), F.xxhash64("dst").alias("b")))
    arcs = [ends.select(F.lit(side).alias("__side"), F.col(x).alias("__node"), F.col(y).alias("__next")) for side, x, y in ((0, "b", "a"), (1, "a", "b"))]
    steps = arcs[0].unionByName(arcs[1])
    place = _place(F.col("__node"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), place % 64)
    own = [F.when(F.shiftright(place, 6) == i, one).otherwise(F.lit(0).cast("long")).alias(b) for i, b in enumerate(bits)]
    joined = lambda rows, node: rows.groupBy("__side", F.col(node).alias("__node")).agg(*[F.bit_or(b).alias(b) for b in bits])
    level = settled(joined(steps.select("__side", "__next", *own), "__next"))
    found = level
    for _ in range(LABEL_ROUNDS):
        known = joined(found, "__node")
        grown = joined(level.join(steps, ["__side", "__node"]).drop("__node"), "__next").alias("g").join(known.alias("k"), ["__side", "__node"])
        fresh = [F.col(f"g.{b}").bitwiseAND(F.bitwise_not(F.col(f"k.{b}"))).alias(b) for b in bits]
        level = settled(grown.select("__side", "__node", *fresh).filter(" or ".join(f"{b} <> 0" for b in bits)))
        if level.isEmpty():
            return settled(known)
        found = found.unionByName(level)
    return None


def _held_by(pairs: DataFrame, labels: DataFrame, of: str, other: str) -> DataFrame:
    """`pairs` with __held: whether the label of the file in column `of` has the bit of that in `other`."""
    met = pairs.withColumn("__node", F.xxhash64(of)).join(labels.drop("__side"), "__node", "left")
    place = _place(F.xxhash64(other))
    word = F.element_at(F.array(*[f"__b{i}" for i in range(LABEL_WORDS)]), F.shiftright(place, 6) + 1)
    return met.select(*pairs.columns, F.coalesce(F.getbit(word, place % 64) == 1, F.lit(False)).alias("__held"))


def _settle_pairs(pairs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst, distance) of the pairs that have a way, without a bound.

    Frontiers grow from both ends, the smaller side first, one for each distinct src and dst. A pair is settled when its two
    frontiers meet, at the sum of their levels; ends whose pairs are all settled grow no further, and neither do ends that
    have come to their end. So the work is that of the pairs asked for, to half of their distance from either side.
    """
    ends = ("src", "dst")
    asked = settled(pairs.filter("src <> dst").select(*ends).distinct().join(nodes.select(F.col("path").alias("src")), "src", "left_semi"))
    steps = [settled(edges.select(F.col(a).alias("path"), F.col(b).alias("next"))) for a, b in (ends, ends[::-1])]
    hubs = [not x.groupBy("path").count().filter(F.col("count") > HOT_ROWS).isEmpty() for x in steps]
    levels = [settled(asked.select(F.col(e).alias("end"), F.col(e).alias("path")).distinct()) for e in ends]
    seen, depth, sizes = list(levels), 0, [x.count() for x in levels]
    found = asked.limit(0).withColumn("distance", F.lit(0))
    while all(sizes):
        side = 0 if sizes[0] <= sizes[1] else 1
        open_ends = asked.select(F.col(ends[side]).alias("end")).distinct()
        level = levels[side].join(open_ends, "end", "left_semi")
        grown = spread_join(level, steps[side], "path") if hubs[side] else level.join(steps[side], "path")
        levels[side] = settled(grown.select("end", F.col("next").alias("path")).distinct().join(seen[side], ["end", "path"], "left_anti"))
        seen[side], sizes[side], depth = seen[side].unionByName(levels[side]), levels[side].count(), depth + 1
        forward, backward = (levels[k].select(F.col("end").alias(ends[k]), "path") for k in (0, 1))
        met = settled(asked.join(forward, "src").join(backward, ["dst", "path"]).select(*ends).distinct().withColumn("distance", F.lit(depth)))
        found = found.unionByName(met)
        growing = levels[side].select(F.col("end").alias(ends[side])).distinct()
        asked = settled(asked.join(met, list(ends), "left_anti").join(growing, ends[side], "left_semi"))
        if asked.isEmpty():
            break
    return found


def distance_score(d: Column) -> Column:
    return F.when(d == 1, 0.8).when(d == 2, 0.4).when(d == 3, 0.1).otherwise(0.0)


def balls(files: DataFrame, edges: DataFrame, depth: int) -> DataFrame:
    """(seed, path, distance, via1, via2) of what depends on each of `files` (seed) within at most three hops, itself left out.

    via1 and via2 are the inner files of the least of the shortest ways; a level is kept as a table with one row for a seed
    and file, and files with very many dependents are split.
    """
    step = settled(edges.select(F.col("dst").alias("path"), F.col("src").alias("next")))
    none = F.lit(None).cast("string")
    level = files.select("seed", F.col("seed").alias("path"), none.alias("via1"), none.alias("via2"))
    found: DataFrame | None = None
    for d in range(1, depth + 1):
        via1 = {1: none, 2: F.col("path")}.get(d, F.col("via1"))
        via2 = F.col("path") if d == 3 else none
        grown = spread_join(level, step, "path").select("seed", F.col("next").alias("path"), F.struct(via1.alias("via1"), via2.alias("via2")).alias("via")).filter("path <> seed")
        grown = grown.groupBy("seed", "path").agg(F.min("via").alias("via")).select("seed", "path", "via.*")
        if found is not None:
            grown = grown.join(found, ["seed", "path"], "left_anti")
        level = settled(grown)
        row = level.withColumn("distance", F.lit(d))
        found = row if found is None else found.unionByName(row)
    return found


def downstream(changes: DataFrame, nodes: DataFrame, edges: DataFrame, max_depth: int = 3, scopes: DataFrame | None = None) -> DataFrame:
    """(change_set_id, file_path, distance, via_files, risk_contribution): who may feel each change set.

    Follows dependents of every changed file, through other changed files but without naming them, and keeps
    for each file the nearest change, of several the first in order, and of its shortest paths the least. Files that `scopes`
    name are left out, if given.

    What is said of a file and one of its dependents is a row of a numbered table; change sets are held against it by number,
    and only what is kept takes its paths from it. A changed file is at no distance from itself and so stands before all ways to it.
    """
    if not 1 <= max_depth <= 3:
        raise ValueError("beyond three hops all files score 0, and the nearest is no longer the first found")
    start = changes.select("change_set_id", "ordinal", F.col("file_path").alias("seed"))
    seeds = settled(start.select("seed").distinct())
    counted = centrality(nodes, edges)
    most = counted.agg(F.greatest(F.coalesce(F.max("centrality"), F.lit(1)), F.lit(1)).alias("most"))  # one row
    none = F.lit(None).cast("string")
    near = balls(seeds, edges, max_depth).unionByName(seeds.select("seed", F.col("seed").alias("path"), none.alias("via1"), none.alias("via2"), F.lit(0).alias("distance")))
    files = settled(near.select("path").distinct().withColumn("to", F.monotonically_increasing_id()))
    risk = distance_score(F.col("distance")) * (F.lit(0.5) + F.lit(0.5) * (F.coalesce("centrality", F.lit(0)).cast("double") / F.col("most")))
    near = near.join(files, "path").join(counted, "path", "left").crossJoin(F.broadcast(most)).withColumn("risk_contribution", risk).drop("centrality", "most")
    # in the order of seeds, which decides between changes of one place
    near = settled(near.orderBy("seed").withColumn("way", F.monotonically_increasing_id()))
    felt = spread_join(start, near.select("seed", "way", "to", F.col("distance").cast("tinyint").alias("distance")), "seed").drop("seed")
    if scopes is not None:
        named = scopes.select("change_set_id", F.explode("target_files").alias("path")).join(files, "path")
        felt = felt.unionByName(named.select("change_set_id", F.lit(None).cast(felt.schema["ordinal"].dataType).alias("ordinal"), F.lit(0).cast("tinyint").alias("distance"), F.lit(None).cast("long").alias("way"), "to"))
    first = Window.partitionBy("change_set_id", "to").orderBy("distance", "ordinal", "way")
    best = settled(felt.withColumn("k", F.row_number().over(first)).filter("k = 1 and distance > 0").select("change_set_id", "way"))
    # the list of files is made where its change set is, so that no path is shuffled twice
    found = best.join(near.drop("to"), "way").drop("way").repartition("change_set_id")
    via = F.array_compact(F.array("seed", "via1", "via2", "path"))
    return found.select("change_set_id", F.col("path").alias("file_path"), "distance", via.alias("via_files"), "risk_contribution")


def out_of_scope(impacts: DataFrame, scopes: DataFrame) -> DataFrame:
    """`impacts` without the files that the scope names."""
    named = scopes.select("change_set_id", F.explode("target_files").alias("file_path"))
    return impacts.join(named, ["change_set_id", "file_path"], "left_anti")
