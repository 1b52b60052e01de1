"""Shards and the audit of filters against plain versions, and on empty, null, tied and repeated rows."""
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest

from ripplescope.llm import filter_audit, sharding


def _groups(rows):
    found = defaultdict(int)
    for _, text in rows:
        found[hashlib.sha256((text or "").encode()).hexdigest()] += len((text or "").encode()) + 1
    return found


def _plain(groups, shards):
    """digest -> shard, each least capacity found by trying all numbers of the sums between ends."""
    place, left = {}, dict(groups)
    for d, b in sorted(groups.items(), key=lambda x: (-x[1], x[0]))[: shards - 1]:
        if b * (shards - len(place)) <= sum(left.values()):
            break
        place[d] = len(place)
        del left[d]
    todo, shard = sorted(left), len(place)

    def greedy(items, capacity):
        runs, held = [[]], 0
        for d in items:
            if left[d] > capacity:
                return None
            if held + left[d] > capacity:
                runs.append([])
                held = 0
            runs[-1].append(d)
            held += left[d]
        return runs

    while todo:
        sums = {sum(left[d] for d in todo[i:j]) for i in range(len(todo)) for j in range(i + 1, len(todo) + 1)}
        runs = next(r for c in sorted(sums) if (r := greedy(todo, c)) and len(r) <= shards - shard)
        place |= {d: shard for d in runs[0]}
        todo, shard = todo[len(runs[0]) :], shard + 1
    return place


def _check(spark, rows, shards):
    docs = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in rows], "doc_id long, text string, shard int, digest string, row string").repartition(3)
    found = sharding.shard(docs, shards).collect()
    place = _plain(_groups(rows), shards)
    texts = {(i, t): t or "" for i, t in rows}
    assert len(found) == len(rows)
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), place[hashlib.sha256((t or "").encode()).hexdigest()]) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32, r.shard) for r in found) == want
    for s in range(shards):
        mine = sorted((r.slot, r.text_crc32, r.doc_id) for r in found if r.shard == s)
        assert [x[0] for x in mine] == list(range(len(mine)))
    assert len(texts) <= len(rows)


ODD = [(1, ""), (2, None), (None, "a"), (None, None), (3, "b" * 4000), (4, "é字"), (4, "é字"), (5, "a"), (9007199254740993, "a"), (6, "c\x00d")]


@pytest.mark.parametrize("shards", [1, 2, 8])
def test_odd_rows_are_placed(spark, shards):
    _check(spark, ODD, shards)


def test_no_rows_and_few_groups(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.shard(docs).count() == 0
    _check(spark, [(i, "one") for i in range(20)], 8)


@pytest.mark.parametrize("few", [0, 30])
def test_shards_by_ever_longer_prefixes(spark, monkeypatch, few):
    monkeypatch.setattr(sharding, "FIRST", 1)
    monkeypatch.setattr(sharding, "MORE", 1)
    monkeypatch.setattr(sharding, "FEW", few)
    rng = random.Random(few)
    rows = [(i, "x" * rng.randint(0, 300) + str(rng.randint(0, 60))) for i in range(150)] + [(900 + i, "copy" * 40) for i in range(70)]
    _check(spark, rows, 8)


def test_prefix_sums_agree_with_whole_sums():
    """Cuts from sums of any coarseness enclose the exact ones."""
    rng = random.Random(3)
    exact = [(f"{i:04x}", rng.choice([1, 5, 40, 700]), 1) for i in range(500)]
    for width in (2, 7, 60):
        coarse = [(exact[i][0], sum(c[1] for c in exact[i : i + width]), len(exact[i : i + width])) for i in range(0, 500, width)]
        for shards in (2, 5, 8):
            for (low, high), (cut, same) in zip(sharding._Line(coarse).cuts(shards), sharding._Line(exact).cuts(shards)):
                assert cut == same and low <= cut <= high


def _fails(text, doc_id, least):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    bits = [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), bool(re.search(r"[#$%&*|]", text)), doc_id is not None and doc_id > least[text]]
    return {x for x, b in zip("ABCDE", bits) if b}


def test_filters_in_all_orders(spark):
    rng = random.Random(5)
    texts = ["", None, "one two", "A " * 300, " ".join(f"w{i}" for i in range(250)), " ".join(f"w{i}" for i in range(250)) + " #", "W" + " ".join(f"W{i}" for i in range(220)), "é " * 199 + "\x1c\x85 x|y", "*\x0b"]
    rows = [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in range(120)] + [(None, texts[4], "en"), (None, None, None), (3, "one two", "en"), (3, "one two", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 130, 2)] + [(4, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, p, True, 7) for i, t, p in rows], "doc_id long, text string, lang string, good boolean, n int").repartition(4)
    found = filter_audit.audit(filter_audit.failures(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, x in labels if x == 1 and i is not None}
    told = [(p or "", _fails(t or "", i, least), i in good, i in toxic) for i, t, p in rows]
    want, removed = Counter(), Counter()
    for part in {p for p, *_ in told}:
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                key = part, "".join(order), k + 1
                for name in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"):
                    want[(*key, name)] = 0
                for p, fails, g, bad in told:
                    if p == part:
                        before, fail = bool(fails & set(order[:k])), x in fails
                        for name, yes in (("kept", not before and not fail), ("removed", not before and fail), ("redundant", before and fail), ("unique_fails", fails == {x}), ("good_lost", not before and fail and g), ("toxic_lost", not before and fail and bad)):
                            want[(*key, name)] += yes
                        removed[part, x] += not before and fail
    got = {(r.part, r.filter_order, r.step, n): r[n] for r in found for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")}
    assert got == dict(want) and len(found) == 600 * len({p for p, *_ in told})
    assert all(r.shapley == removed[r.part, r.filter_order[r.step - 1]] for r in found)
    assert filter_audit.audit(filter_audit.failures(docs.filter("false"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).count() == 0
