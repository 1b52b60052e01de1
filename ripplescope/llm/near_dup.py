"""Near-duplicate vectors by a robust-pruned flat graph.

Only vectors of the same (not null) label are compared. Equal vectors of a label are one node from the start,
so copies cost nothing. Centroids are fitted for each label on at most SAMPLE vectors in all; where these are
too few for shards of about SHARD nodes, each cell is fitted again on at most SAMPLE of its own vectors. Every
node joins the shards of its `overlap` nearest centroids. A shard of over BLOCK nodes is cut into blocks by
hash, so that no task holds more than two blocks.

Build: each block's nodes enter its graph in batches. A greedy search of the graph so far, from its medoids,
gives a node's candidates, with a few random ones; robust pruning (a candidate goes if a kept neighbour is ALPHA
times as near to it) leaves at most DEGREE neighbours, whose own lists take the node in and are pruned again; a second round does the
same for all nodes over the whole graph. Union: the lists that a node has in its several shards become one. Search:
over the united lists, from the block's medoids (and a node of any part that they don't reach), with a beam of `beam` nodes; when it has come to rest, every
node found in range is expanded too, until nothing new in range turns up. Each block is searched with the nodes of
each block of its shard. Pairs found in range in single precision are verified in double precision, on the
vectors as they are given; links are those with cosine >= `threshold`.

Pairs found in several shards are counted once. Recall is audited: by brute force against all nodes
of their labels, links of nodes picked by hash are told, of ever more nodes until AUDIT_LINKS links are among
them (or AUDIT[-1] nodes are looked at). If less than TARGET of these pairs was found, the search is repeated with
more overlap and a wider beam, and at last the exact way is taken: all blocks of a label against each other.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as those without a
label: n_links 0, their own component, kept. Vectors of different lengths don't link. Repeated rows count as
other vectors. A null id is never the smallest and isn't kept. No rows give no rows; other columns of the
input are ignored.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplescope.llm import _common as C
from ripplescope.llm._graph import components

SAMPLE, SHARD, BLOCK = 16384, 400, 4096
#: Bytes of vectors that the driver gets at once, to fit centroids or to audit; fewer of them where they are long.
SAMPLE_BYTES = 64 << 20
DEGREE, ALPHA, BUILD_BEAM, RANDOM, BATCH, ENTRIES = 32, 1.0, 32, 8, 512, 8
SETTINGS = ((2, 32), (4, 96), (8, 256))
AUDIT, AUDIT_LINKS, TARGET = (512, 4096, 16384), 200, 0.95
#: Rows of a cell that one task assigns to the cell's own centroids.
CELL_ROWS = 50_000


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def _vectors(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def kmeans(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k centroids, of length 1 each, of vectors of length 1."""
    rng = np.random.default_rng(len(x))
    centers = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        near = (x @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
        centers = np.where(size > 0, sums / np.maximum(size, 1e-12), centers)
    return centers


def fit_centroids(sample: list[tuple[str, np.ndarray]], scale: float) -> dict[str, np.ndarray]:
    """Centroids of each group of the sample, of which the whole input has `scale` times as many."""
    groups: dict[str, list[np.ndarray]] = {}
    for key, v in sample:
        groups.setdefault(key, []).append(v)
    return {key: kmeans(_unit(np.array(rows)), min(-(-int(len(rows) * scale) // SHARD), max(1, len(rows) // 8))) for key, rows in groups.items()}


def _prune(cand: np.ndarray, sims: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Robust pruning of many nodes at once: their candidates (-1 for none) in descending similarity; cosine distances.

    Places left over go to the nearest of those that were pruned.
    """
    m = cand.shape[1]
    v = x[cand]
    among = ALPHA * (np.float32(1) - v @ v.transpose(0, 2, 1))
    far = 1 - sims
    there = cand >= 0
    alive, kept = there.copy(), np.zeros(cand.shape, bool)
    for i in range(m):
        take = np.flatnonzero(alive[:, i])
        kept[take, i] = True
        alive[take] &= among[take, i] > far[take]
    place = np.arange(m)
    first = np.argsort(np.where(kept, place, np.where(there, m + place, 2 * m + place)), axis=1)[:, :DEGREE]
    out = np.full((len(cand), DEGREE), -1, np.int32)
    out[:, : first.shape[1]] = np.take_along_axis(cand, first, 1)
    return out


def _linked_back(graph: np.ndarray, nodes: np.ndarray, x: np.ndarray) -> None:
    """Take `nodes` into the lists of their neighbours, which are pruned again."""
    a, b = np.repeat(nodes, DEGREE), graph[nodes].ravel()
    a, b = a[b >= 0], b[b >= 0]
    if not len(b):
        return
    ends = np.unique(b)
    old = graph[ends]
    held = old >= 0
    owner, other = np.concatenate([b, np.repeat(ends, DEGREE)[held.ravel()]]), np.concatenate([a, old[held]])
    once = np.unique(owner.astype(np.int64) * len(x) + other)
    owner, other = once // len(x), once % len(x)
    sims = np.einsum("ij,ij->i", x[owner], x[other])
    most = 2 * DEGREE  # of more than these, the ones held already and the nearest
    fresh = ~(old[np.searchsorted(ends, owner)] == other[:, None]).any(axis=1)
    order = np.lexsort((-sims, fresh, owner))
    rank = np.arange(len(owner)) - np.searchsorted(owner, ends)[np.searchsorted(ends, owner[order])]
    order = order[rank < most]
    order = order[np.lexsort((-sims[order], owner[order]))]
    owner, other, sims = owner[order], other[order], sims[order]
    row = np.searchsorted(ends, owner)
    rank = np.arange(len(owner)) - np.searchsorted(owner, ends)[row]
    near = rank < most
    cand, s = np.full((len(ends), most), -1, np.int64), np.full((len(ends), most), -3.0, np.float32)
    cand[row[near], rank[near]], s[row[near], rank[near]] = other[near], sims[near]
    for at in range(0, len(ends), BATCH):
        graph[ends[at : at + BATCH]] = _prune(cand[at : at + BATCH], s[at : at + BATCH], x)


def medoids(x: np.ndarray) -> np.ndarray:
    """The nodes nearest to the middle of all and to those of some parts."""
    k = min(ENTRIES, len(x))
    return np.unique(np.concatenate([[(x @ x.mean(axis=0)).argmax()], (kmeans(x, k, 3) @ x.T).argmax(axis=1)]))


def entries_of(x: np.ndarray, graph: np.ndarray) -> np.ndarray:
    """The medoids and, of what no path leads to from them, one node of each part, so that all nodes can be reached."""
    entries, reached = medoids(x), np.zeros(len(x) + 1, bool)
    reached[-1] = True  # -1 stands for no neighbour
    new = entries
    while True:
        while len(new):
            reached[new] = True
            near = np.unique(graph[new])
            new = near[~reached[near]]
        left = np.flatnonzero(~reached)
        if not len(left):
            return entries
        new = left[(x[left] @ x[left].mean(axis=0)).argmax()][None]
        entries = np.append(entries, new)


def _beam(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, note=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy search: the best nodes of each query with their similarities, and (query, node) seen; note(query, node, similarity) is told of each once."""
    n, q = len(x), len(queries)
    seen = np.zeros((q, n + 1), bool)
    seen[:, n] = True
    width = max(beam, len(entries))
    ids, sims, opened = np.full((q, width), n, np.int64), np.full((q, width), -3.0, np.float32), np.ones((q, width), bool)
    ids[:, : len(entries)] = entries
    sims[:, : len(entries)] = queries @ x[entries].T
    opened[:, : len(entries)] = False
    seen[:, entries] = True
    if note:
        note(np.repeat(np.arange(q), len(entries)), np.tile(entries, q), sims[:, : len(entries)].ravel())
    active = np.arange(q)
    while len(active):
        best = np.where(opened[active], -4.0, sims[active]).argmax(axis=1)
        going = ~opened[active, best]
        active, best = active[going], best[going]
        if not len(active):
            break
        opened[active, best] = True
        near = graph[ids[active, best]].astype(np.int64)
        near[near < 0] = n
        r, c = np.nonzero(~seen[active[:, None], near])
        once = np.unique(active[r] * (n + 1) + near[r, c])
        qs, ns = once // (n + 1), once % (n + 1)
        seen[qs, ns] = True
        s = np.einsum("ij,ij->i", queries[qs], x[ns])
        if note:
            note(qs, ns, s)
        fresh = np.full((len(active), near.shape[1]), n, np.int64)
        fresh_s = np.full(fresh.shape, -3.0, np.float32)
        row = np.searchsorted(active, qs)
        col = np.arange(len(qs)) - np.searchsorted(qs, active)[row]
        fresh[row, col], fresh_s[row, col] = ns, s
        all_ids, all_s = np.concatenate([ids[active], fresh], axis=1), np.concatenate([sims[active], fresh_s], axis=1)
        all_open = np.concatenate([opened[active], fresh == n], axis=1)
        top = np.argpartition(-all_s, width - 1, axis=1)[:, :width]
        ids[active] = np.take_along_axis(all_ids, top, 1)
        sims[active] = np.take_along_axis(all_s, top, 1)
        opened[active] = np.take_along_axis(all_open, top, 1)
    return ids, sims, seen


def build_graph(x: np.ndarray) -> np.ndarray:
    """(n, DEGREE) neighbours, -1 where there are fewer, of vectors of length 1."""
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int32)
    rng = np.random.default_rng(n)
    order = rng.permutation(n)

    def enter(batch: np.ndarray, cand: np.ndarray, sims: np.ndarray) -> None:
        cand = np.where((cand == batch[:, None]) | (cand >= n), -1, cand)
        sims = np.where(cand < 0, np.float32(-3), sims)
        by = np.argsort(-sims, axis=1, kind="stable")
        graph[batch] = _prune(np.take_along_axis(cand, by, 1), np.take_along_axis(sims, by, 1), x)
        _linked_back(graph, batch, x)

    first = order[: 2 * DEGREE]
    enter(first, np.tile(first, (len(first), 1)), x[first] @ x[first].T)
    at = len(first)
    entries = first[medoids(x[first])]
    while at < n:
        batch = order[at : at + min(at, BATCH)]
        ids, sims, _ = _beam(x, graph, x[batch], entries, BUILD_BEAM)
        far = order[rng.integers(0, at, (len(batch), RANDOM))]
        enter(batch, *_with(ids, sims, far, batch, x))
        at += len(batch)
    entries = entries_of(x, graph)
    for at in range(0, n, BATCH):
        batch = order[at : at + BATCH]
        ids, sims, _ = _beam(x, graph, x[batch], entries, BUILD_BEAM)
        enter(batch, *_with(ids, sims, graph[batch], batch, x))
    return graph


def _with(ids: np.ndarray, sims: np.ndarray, more: np.ndarray, nodes: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates of `nodes` and `more` of them, -1 where they are among the first."""
    more = np.where((more[:, :, None] == ids[:, None, :]).any(axis=2), -1, more)
    return np.concatenate([ids, more], axis=1), np.concatenate([sims, np.einsum("bd,bid->bi", x[nodes], x[more])], axis=1)


def range_search(x: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, low: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs with a similarity of `low` or more that greedy search from the entries and expansion find."""
    n = len(x)
    hit_q, hit_n = [], []

    def note(qs: np.ndarray, ns: np.ndarray, s: np.ndarray) -> None:
        good = s >= low
        hit_q.append(qs[good])
        hit_n.append(ns[good])

    seen = _beam(x, graph, queries, entries, beam, note)[2]
    qs, ns = np.concatenate(hit_q), np.concatenate(hit_n)
    while len(qs):  # expand what is in range, each once
        new_q, new_n = [], []
        for at in range(0, len(qs), 1 << 14):
            q, near = qs[at : at + (1 << 14)], graph[ns[at : at + (1 << 14)]].astype(np.int64)
            near[near < 0] = n
            r, c = np.nonzero(~seen[q[:, None], near])
            once = np.unique(q[r] * (n + 1) + near[r, c])
            a, b = once // (n + 1), once % (n + 1)
            seen[a, b] = True
            note(a, b, np.einsum("ij,ij->i", queries[a], x[b]))
            new_q.append(hit_q[-1])
            new_n.append(hit_n[-1])
        qs, ns = np.concatenate(new_q), np.concatenate(new_n)
    return np.concatenate(hit_q), np.concatenate(hit_n)


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    a, b = a.astype(np.float64), b.astype(np.float64)
    return np.einsum("ij,ij->i", a, b) / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def _roots(n: int, pairs: np.ndarray) -> np.ndarray:
    parent = np.arange(n)

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a, b in pairs.tolist():
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return np.array([find(i) for i in range(n)])


def _block_lists(table: pa.Table) -> pa.Table:
    """(node, near): the neighbours of each node in the graph of one block."""
    node = table["node"].to_numpy()
    order = np.argsort(node, kind="stable")
    node = node[order]
    graph = build_graph(_unit(_vectors(table["embedding"])[order]))
    held = graph >= 0
    edges = np.concatenate(([0], np.cumsum(held.sum(axis=1)))).astype(np.int32)
    return pa.table({"node": node, "near": pa.ListArray.from_arrays(pa.array(edges), pa.array(node[graph[held]], pa.int64()))})


def _local(near: pa.Array, node: np.ndarray) -> np.ndarray:
    """Lists of node names as places among the sorted `node`, -1 for those elsewhere and where a list is shorter."""
    if isinstance(near, pa.ChunkedArray):
        near = near.combine_chunks()
    size = near.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = near.flatten().to_numpy(zero_copy_only=False)
    place = np.minimum(np.searchsorted(node, flat), len(node) - 1)
    graph = np.full((len(size), max(1, int(size.max(initial=0)))), -1, np.int32)
    row = np.repeat(np.arange(len(size)), size)
    graph[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = np.where(node[place] == flat, place, -1)
    return graph


def _unit_links(table: pa.Table, threshold: float, beam: int | None) -> pa.Table:
    """Of one unit of work: its links (a, b, copies of a, copies of b) and for each node in one a node it hangs together with (no copies).

    Without a beam all pairs are compared.
    """
    node, role = table["node"].to_numpy(), table["role"].to_numpy()
    order = np.lexsort((node, role))
    table, node, role = table.take(pa.array(order)), node[order], role[order]
    count, raw = table["c"].to_numpy(), _vectors(table["embedding"])
    x = _unit(raw)
    index = np.flatnonzero(role <= 1)  # 0: both, 1: index only, 2: query only
    queries = np.flatnonzero(role != 1)
    pairs = np.zeros((0, 2), np.int64)
    if len(index) > 0 and len(queries) > 0:
        graph = _local(table["near"].combine_chunks().take(pa.array(index)), node[index]) if beam else None
        entries = entries_of(x[index], graph) if beam else None
        found = [pairs]
        for at in range(0, len(queries), BATCH):
            part = queries[at : at + BATCH]
            q, m = range_search(x[index], graph, entries, x[part], threshold - 1e-4, beam) if beam else np.nonzero(x[part] @ x[index].T >= threshold - 1e-4)
            a, b = part[q], index[m]
            keep = a != b
            a, b = a[keep], b[keep]
            keep = _exact(raw[a], raw[b]) >= threshold
            found.append(np.column_stack([np.minimum(a[keep], b[keep]), np.maximum(a[keep], b[keep])]))
        pairs = np.unique(np.concatenate(found), axis=0)
    root, hung = _roots(len(node), pairs), np.unique(pairs)
    first, second = pairs.T
    column = lambda own, of: pa.array(np.concatenate([own, of]))
    copies = [pa.array(np.concatenate([count[x], np.zeros(len(hung), np.int64)]), mask=np.repeat([False, True], [len(pairs), len(hung)])) for x in (first, second)]
    return pa.table([column(node[first], node[hung]), column(node[second], node[root[hung]]), *copies], names=["a", "b", "of_a", "of_b"])


_FOUND = "a long, b long, of_a long, of_b long"


def _counted(found: DataFrame) -> DataFrame:
    """A stored table (node, links, distinct): links of each node by copies and by nodes, each pair once wherever it was found."""
    pairs = found.filter("of_a is not null").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max(F.when(F.col("a") < F.col("b"), F.col("of_a")).otherwise(F.col("of_b"))).alias("of_a"), F.max(F.when(F.col("a") < F.col("b"), F.col("of_b")).otherwise(F.col("of_a"))).alias("of_b"))
    both = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("of_b").alias("n")), F.struct(F.col("b").alias("node"), F.col("of_a").alias("n")))).alias("x")).select("x.*")
    return C.store(both.groupBy("node").agg(F.sum("n").alias("links"), F.count("*").alias("distinct")), "counted")


def _assigned(nodes: DataFrame, centroids: dict[str, np.ndarray], overlap: int) -> DataFrame:
    """`nodes` with the places of their nearest centroids (0 where a key has only one) as array<long> shards."""
    shared = nodes.sparkSession.sparkContext.broadcast(centroids)  # of at most SAMPLE / 8 vectors

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(1).to_pylist()
            lists: list[list[int]] = [[0] for _ in keys]
            where: dict[str, list[int]] = {}
            for i, key in enumerate(keys):
                where.setdefault(key, []).append(i)
            for key, rows in where.items():
                centers = shared.value.get(key)
                if centers is not None and len(centers) > 1:
                    sims = _unit(_vectors(batch.column(2).take(pa.array(rows)))) @ centers.T
                    top = np.argsort(-sims, axis=1, kind="stable")[:, :overlap]
                    for i, t in zip(rows, top.tolist()):
                        lists[i] = sorted(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lists, pa.list_(pa.int64()))], names=[*batch.schema.names, "shards"])

    return nodes.mapInArrow(assign, T.StructType([*nodes.schema.fields, T.StructField("shards", T.ArrayType(T.LongType()))]))


def _refined(assigned: DataFrame, overlap: int) -> DataFrame:
    """`assigned` with cells of over two SHARDs cut by centroids of their own: a shard is then cell * 2^24 + place.

    Each cell is fitted on at most SAMPLE of its nodes; its nodes go to their nearest centroids in tasks of CELL_ROWS rows.
    """
    cells = assigned.select("node", "key", "embedding", F.explode("shards").alias("cell"))
    sizes = cells.groupBy("key", "cell").agg(F.count("*").alias("n"))
    large = C.store(sizes.filter(F.col("n") > 2 * SHARD).withColumn("parts", F.ceil(F.col("n") / CELL_ROWS).cast("int")), "cells")
    picked = cells.join(large, ["key", "cell"]).filter(F.pmod(F.xxhash64("node", F.lit(3)), F.col("n")) < SAMPLE // 2)

    def fit(table: pa.Table) -> pa.Table:
        x = _unit(_vectors(table["embedding"])[:SAMPLE])
        centers = kmeans(x, min(-(-table["n"][0].as_py() // SHARD), max(1, len(x) // 8)))
        return pa.table({"key": table["key"][:1], "cell": table["cell"][:1], "parts": table["parts"][:1], "centers": pa.array([centers.astype("<f4").tobytes()], pa.binary())})

    fitted = picked.groupBy("key", "cell").applyInArrow(fit, "key string, cell long, parts int, centers binary")
    fitted = fitted.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = cells.join(large.select("key", "cell", "parts"), ["key", "cell"]).withColumn("part", F.pmod(F.xxhash64("node", F.lit(5)), "parts").cast("int"))

    def place(rows: pa.Table, centers: pa.Table) -> pa.Table:
        sims = _unit(_vectors(rows["embedding"])) @ np.frombuffer(centers["centers"][0].as_py(), "<f4").reshape(-1, len(rows["embedding"][0])).T
        top = np.argsort(-sims, axis=1, kind="stable")[:, :overlap].astype(np.int64) + (int(rows["cell"][0].as_py()) << 24)
        return pa.table({"node": rows["node"].combine_chunks(), "shards": pa.array(top.tolist(), pa.list_(pa.int64()))})

    deeper = dealt.groupBy("key", "cell", "part").cogroup(fitted.groupBy("key", "cell", "part")).applyInArrow(place, "node long, shards array<long>")
    whole = cells.join(large.select("key", "cell"), ["key", "cell"], "left_anti").select("node", F.array(F.col("cell") * (1 << 24)).alias("shards"))
    shards = deeper.unionByName(whole).groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("shards")))).alias("shards"))
    return assigned.drop("shards").join(shards, "node")


def _units(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of shards, with the number of blocks of each shard, as units of two blocks each."""
    rows = rows.join(blocks, ["key", "k"]).withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j")
    role = F.when(F.col("i") == F.col("j"), 0).when(F.col("i") < F.col("j"), 1).otherwise(2).alias("role")
    return rows.select("*", other).select(F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), role, *(c for c in rows.columns if c not in ("blocks", "i")))


def _search(nodes: DataFrame, centroids: dict[str, np.ndarray], deep: bool, threshold: float, overlap: int, beam: int) -> DataFrame:
    """A stored table as _unit_links() gives it, of all units."""
    assigned = C.store(_assigned(nodes.select("node", "key", "embedding", "c"), centroids, overlap), "shards")
    if deep:
        coarse, assigned = assigned, C.store(_refined(assigned, overlap), "shards")
        C.drop(coarse)
    rows = assigned.select("*", F.explode("shards").alias("k"))
    blocks = C.store(rows.groupBy("key", "k").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "sizes")
    cut = rows.select("node", "key", "k", "embedding").join(blocks, ["key", "k"]).withColumn("i", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    lists = cut.groupBy("key", "k", "i").applyInArrow(_block_lists, "node long, near array<long>")
    united = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    united = C.store(united, "united")
    units = _units(rows.select("node", "key", "k", "embedding", "c").join(united, "node"), blocks)
    found = C.store(units.groupBy("key", "k", "lo", "hi").applyInArrow(lambda t: _unit_links(t, threshold, beam), _FOUND), "found")
    C.drop(assigned, blocks, united)
    return found


def _brute_force(nodes: DataFrame, threshold: float) -> DataFrame:
    """The same by the exact way: all blocks of a key against each other."""
    rows = nodes.select("node", "key", "embedding", "c", F.lit(0).cast("long").alias("k"))
    blocks = C.store(rows.groupBy("key", "k").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks")), "sizes")
    return C.store(_units(rows, blocks).groupBy("key", "k", "lo", "hi").applyInArrow(lambda t: _unit_links(t, threshold, None), _FOUND), "found")


def _true_links(nodes: DataFrame, threshold: float, asked_nodes: int) -> dict[int, int]:
    """The number of nodes that each of some nodes, picked by hash, links with, by brute force."""
    picked = nodes.orderBy("h2", "h1").limit(asked_nodes).select("node", "key", "embedding").toArrow().combine_chunks()
    key, by = np.array(picked["key"].to_pylist(), object), {}
    for k in set(key.tolist()):
        part = picked.take(pa.array(np.flatnonzero(key == k)))
        by[k] = part["node"].to_numpy(), _vectors(part["embedding"]).astype(np.float64)
    asked = nodes.sparkSession.sparkContext.broadcast(by)  # at most SAMPLE_BYTES of vectors

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, total = np.array(batch.column(1).to_pylist(), object), {}
            node = batch.column(0).to_numpy()
            for key, (names, v) in asked.value.items():
                rows = np.flatnonzero(keys == key)
                for at in range(0, len(rows), 1024):
                    part = rows[at : at + 1024]
                    x = _vectors(batch.column(2).take(pa.array(part))).astype(np.float64)
                    sims = (v @ x.T) / np.sqrt(np.outer((v * v).sum(axis=1), (x * x).sum(axis=1)))
                    n = ((sims >= threshold) & (node[part][None, :] != names[:, None])).sum(axis=1)
                    for name, m in zip(names[n > 0].tolist(), n[n > 0].tolist()):
                        total[name] = total.get(name, 0) + m
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["node", "n"])

    counted = nodes.select("node", "key", "embedding").mapInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))
    return {r["node"]: r["n"] for r in counted.collect()}  # at most `asked_nodes` rows


def near_duplicates(vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component_id, kept) for each row of `vectors`."""
    given = vectors.schema[vector_col].dataType
    single = isinstance(given, T.ArrayType) and isinstance(given.elementType, T.FloatType)
    vector = F.col(vector_col).cast("array<float>" if single else "array<double>")
    rows = vectors.select(F.col(id_col).alias("__id"), vector.alias("embedding"), F.col(label_col).cast("string").alias("label"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    able = F.coalesce(sound & F.col("label").isNotNull(), F.lit(False))
    key = F.concat_ws(":", F.size("embedding").cast("string"), "label")
    names = [F.when(able, F.xxhash64(*salt, "label", "embedding")).alias(f"h{k}") for k, salt in ((1, []), (2, [F.lit("second")]))]
    rows = C.store(rows.select("*", *names, F.when(able, key).alias("key")), "vectors")
    nodes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("__id").alias("id"), F.count("*").alias("c"), F.first("key").alias("key"), F.first("embedding").alias("embedding"))
    nodes = C.store(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    total, longest = nodes.agg(F.count("*"), F.coalesce(F.max(F.size("embedding")), F.lit(1))).head()
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * longest)))
    sample = nodes.orderBy("h1", "h2").limit(most).select("key", "embedding").toArrow().combine_chunks()
    vectors = sample["embedding"].combine_chunks() if len(sample) else []
    centroids = fit_centroids([(k, v.values.to_numpy().astype(np.float32)) for k, v in zip(sample["key"].to_pylist(), vectors)], total / max(1, len(sample)))
    deep = total > 2 * SHARD * max(1, len(sample) // 8)
    there: dict[int, int] = {}
    for size in AUDIT:
        there = _true_links(nodes, threshold, min(size, most))
        if sum(there.values()) >= AUDIT_LINKS or size >= min(total, most):
            break
    asked = nodes.sparkSession.createDataFrame(list(there.items()), "node long, n long")
    for overlap, beam in (*SETTINGS, (0, 0)):
        found = _search(nodes, centroids, deep, threshold, overlap, beam) if beam else _brute_force(nodes, threshold)
        counted = _counted(found)
        got = counted.join(F.broadcast(asked), "node").agg(F.coalesce(F.sum("distinct"), F.lit(0))).head()[0]  # at most AUDIT[-1] rows
        if got >= TARGET * sum(there.values()):
            break
        if beam:
            C.drop(found, counted)
    hang = components(found.filter("of_a is null").select("a", "b"))
    rooted = C.store(hang.join(nodes.select("node", "id"), "node"), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("id").alias("component_id")), "root").select("node", "component_id")
    known = nodes.select("node", "h1", "h2", "id", "c").join(counted, "node", "left").join(named, "node", "left")
    known = C.store(known.select("h1", "h2", (F.col("c") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component_id", "id").alias("component_id")), "known")
    C.drop(found, counted, nodes, hang, rooted)
    linked = rows.filter("h1 is not null").select("__id", "h1", "h2").join(known, ["h1", "h2"]).select("__id", "n_links", "component_id")
    alone = rows.filter("h1 is null").select("__id", F.lit(0).cast("long").alias("n_links"), F.col("__id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("__id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("__id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(C.table(spark, sf_dir, "embeddings"))
