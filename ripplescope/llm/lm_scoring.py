"""N-gram language-model scores from a log-frequency Bloom filter.

Training tokens are the words of the training rows and one end after each. The texts are stored in chunks of
a few MB. Each chunk sends its distinct tokens and pairs of neighbours, with how often its training rows hold
them, to the hash range that each belongs to. There the chunks' counts are summed, and the answers go back to the
chunks that asked, so that nothing has to fit one process at any size of the input. Counts of tokens are exact
but for equal 64-bit hashes. Those of pairs come from the range's own segment of the Bloom filter: a pair is in it
once for each level up to 1 + floor(STEPS * log2(count)), pairs seen once too, and the segment has at least
BITS_EACH bits for each entry. No pair is left out, whatever their number.

The base probability p(w) of a token is (c(w) + 1) / (N + V + 1). The model's, after its neighbour h, is
(c(h, w) + m * p(w)) / (c(h) + m), where c(h, w) is found by asking the filter for level 1, 2, ... until the first no,
and taken as the mean of its level's counts. m is the one of WEIGHTS under which the training rows are likeliest if each is
left out of the counts when it is scored; all training rows have a say in it.

Null or empty text is the end alone. A null id counts as training. Repeated rows are trained on and scored
each for itself; without training rows N and V are 0 and both scores are the tokens' number * log10(1); no
rows give no rows; other columns of the input are ignored.

The filter isn't broadcast: what it must hold grows with the corpus (see the README), and a broadcast may not. The
probes of a chunk go to the segments instead, and the answers come back.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplescope.llm import _common as C
from ripplescope.llm._words import mix, word_hashes

#: Tokens of the input for each hash range, about; a range's exact counts are summed in one process.
EXACT = 1 << 20
CHUNK = 8 << 20
BITS_EACH, PROBES, STEPS = 10, 7, 4
WEIGHTS = (1.0, 4.0, 16.0, 64.0, 256.0, 1024.0)
_START, _END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)


def _sequences(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Start, words and end of each text in one array, and where each text begins in it (and the last ends)."""
    hashes, counts = word_hashes(texts)
    at = np.concatenate(([0], np.cumsum(counts + 2)))
    flat = np.empty(at[-1], np.uint64)
    inner = np.ones(at[-1], bool)
    flat[at[:-1]], flat[at[1:] - 1] = _START, _END
    inner[at[:-1]] = inner[at[1:] - 1] = False
    flat[inner] = hashes
    return flat, at


def _pairs(flat: np.ndarray) -> np.ndarray:
    """Keys of (token before, token) for each position but the first; those at a start are of no use."""
    return mix(flat[:-1] * np.uint64(0xD6E8FEB86659FD93) + flat[1:])


def chunked(source: DataFrame) -> DataFrame:
    """(id, held_out, __text) with a `chunk` for rows that follow each other, about CHUNK bytes of text in each."""
    kinds = T.StructType([*(T.StructField(f.name, f.dataType) for f in source.schema), T.StructField("chunk", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            names = []
            for length in pc.binary_length(batch.column(2)).fill_null(0).to_pylist():
                if size and size + length > CHUNK:
                    chunk, size = chunk + 1, 0
                names.append(chunk)
                size += length
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.int64())], names=kinds.names)

    return source.mapInArrow(run, kinds)


def _keys(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens, the pairs that end with them, and the number of tokens of each row."""
    tokens, pairs, sizes = [], [], []
    for _, texts in C.text_groups(table["__text"].combine_chunks()):
        flat, at = _sequences(texts)
        token = np.ones(len(flat), bool)
        token[at[:-1]] = False
        tokens.append(flat[token])
        pairs.append(_pairs(flat)[token[1:]])
        sizes.append(np.diff(at) - 1)
    return np.concatenate(tokens), np.concatenate(pairs), np.concatenate(sizes)


def _ranges(size: int) -> int:
    """Bits of the hash that name a range, for so many bytes of text of about six to a token."""
    return min(24, max(9, (size // (6 * EXACT)).bit_length()))  # 2^24 ranges are 100 TB of text


def _packed(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """A binary value for the items between each two edges."""
    return pa.Array.from_buffers(pa.binary(), len(edges) - 1, [None, pa.py_buffer((edges * values.itemsize).astype(np.int32)), pa.py_buffer(values)])


_ASKED = "chunk long, range int, tokens binary, tokens_n binary, pairs binary, pairs_n binary"
_ANSWERED = "chunk long, range int, tokens binary, pairs binary, n long, v long, ends long"


def asked(chunks: DataFrame, bits: int) -> DataFrame:
    """For each chunk and range the sorted keys of tokens (64 bits) and pairs (the 32 bits after the range's) in it with
    their counts in training rows."""
    shift, low = np.uint64(64 - bits), np.uint64(32 - bits)

    def run(table: pa.Table) -> pa.Table:
        tokens, pairs, sizes = _keys(table)
        learned = np.repeat(table["held_out"].to_numpy() == 0, sizes)
        kinds = [np.unique(keys, return_inverse=True) for keys in (tokens, pairs)]
        present = np.union1d(kinds[0][0] >> shift, kinds[1][0] >> shift)
        columns = []
        for k, (unique, where) in enumerate(kinds):
            count = np.bincount(where, learned, len(unique)).astype("<u4")
            edges = np.append(np.searchsorted(unique >> shift, present), len(unique))
            short = (unique >> low).astype("<u4") if k else unique
            columns += [_packed(short, edges), _packed(count, edges)]
        made = [pa.repeat(table["chunk"][0], len(present)), pa.array(present.astype(np.int32)), *columns]
        return pa.Table.from_arrays(made, names=["chunk", "range", "tokens", "tokens_n", "pairs", "pairs_n"])

    return chunks.groupBy("chunk").applyInArrow(run, _ASKED)


def _levels(count: np.ndarray) -> np.ndarray:
    return 1 + np.floor(STEPS * np.log2(count) + 1e-9).astype(np.int64)


def _middle_of(level: int) -> float:
    """The mean of the whole numbers of a level, so small counts are exact."""
    least = math.ceil(2 ** ((level - 1) / STEPS) - 1e-9)
    return (least + max(least, math.ceil(2 ** (level / STEPS) - 1e-9) - 1)) / 2 if level else 0.0


_MIDDLE = np.array([_middle_of(k) for k in range(64 * STEPS)])


def _middle(level: np.ndarray) -> np.ndarray:
    return _MIDDLE[level]


def _bits(key: np.ndarray, level: int, segment: int) -> np.ndarray:
    """(n, PROBES) bit positions in a segment."""
    salt = np.uint64(level * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)
    a = mix(key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ salt)
    step = (a >> np.uint64(32)) | np.uint64(1)
    return ((a[:, None] + np.arange(PROBES, dtype=np.uint64) * step[:, None]) & np.uint64(segment - 1)).astype(np.int64)


class Filter:
    """Answers for how often, about, n-grams were seen."""

    def __init__(self, data: bytes, bits: int, cutoff: int):
        self.data = np.frombuffer(data, np.uint8)
        self.bits, self.cutoff = bits, cutoff
        self.segment = len(data) * 8 >> bits

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """0 for what the filter doesn't hold, else the highest level up to which all are there."""
        unique, where = np.unique(keys, return_inverse=True)
        base = (unique >> np.uint64(64 - self.bits)).astype(np.int64) * self.segment
        short = (unique >> np.uint64(32 - self.bits)) & np.uint64(0xFFFFFFFF)
        level = np.zeros(len(unique), np.int64)
        left = np.arange(len(unique))
        while len(left):
            bit = _bits(short[left], int(level[left[0]]) + 1, self.segment) + base[left, None]
            there = ((self.data[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).all(axis=1)
            left = left[there]
            level[left] += 1
        return level[where]

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """0 for what the filter doesn't hold, else the middle of its level."""
        return self.cutoff * _middle(self.levels(keys))


def build_segment(keys: np.ndarray, count: np.ndarray) -> Filter:
    """A filter of one segment for keys (their upper 32 bits) that were seen `count` times."""
    keys, level = keys[count > 0], _levels(count[count > 0])
    size = max(64, 1 << (int(level.sum()) * BITS_EACH).bit_length())
    there = np.zeros(size, bool)
    short = keys >> np.uint64(32)
    for k in range(1, int(level.max(initial=0)) + 1):
        there[_bits(short[level >= k], k, size)] = True
    return Filter(np.packbits(there, bitorder="little").tobytes(), 0, 1)


def answered(keys: DataFrame, bits: int) -> DataFrame:
    """(chunk, range, tokens, pairs): counts and levels over all chunks in the order of the keys; and for each range one row
    of chunk -1 with its training tokens, distinct ones and ends."""

    def merge(table: pa.Table) -> pa.Table:
        packed, sums = [], []
        for name, kind in (("tokens", "<u8"), ("pairs", "<u4")):
            parts = table[name].to_pylist()
            unique, where = np.unique(np.frombuffer(b"".join(parts), kind), return_inverse=True)
            n = np.frombuffer(b"".join(table[f"{name}_n"].to_pylist()), "<u4")
            found = np.bincount(where, n, len(unique)).astype(np.int64)
            if name == "tokens":
                sums = [int(found.sum()), int((found > 0).sum()), int(found[unique == _END].sum())]
            else:
                keys = unique.astype(np.uint64) << np.uint64(32)
                found = build_segment(keys, found).levels(keys).astype(np.uint8)
            packed.append(_packed(found[where], np.cumsum([0, *map(len, parts)]) // np.dtype(kind).itemsize))
        n = len(table)
        made = [table["chunk"].combine_chunks(), table["range"].combine_chunks(), *packed, *(pa.nulls(n, pa.int64()) for _ in sums)]
        last = [pa.array([-1]), table["range"].combine_chunks()[:1], *(pa.nulls(1, pa.binary()) for _ in packed), *(pa.array([x]) for x in sums)]
        names = ["chunk", "range", "tokens", "pairs", "n", "v", "ends"]
        return pa.concat_tables([pa.Table.from_arrays(x, names=names) for x in (made, last)])

    return keys.groupBy("range").applyInArrow(merge, _ANSWERED)


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score); rows with `held_out` aren't learned from."""
    source = docs.select(id_col, F.coalesce(held_out, F.lit(False)).alias("held_out"), docs[text_col].cast("string").alias("__text"))
    bits = _ranges(source.agg(F.coalesce(F.sum(F.octet_length("__text")), F.lit(0))).head()[0])
    chunks = C.store(chunked(source), "chunks")
    answers = C.store(answered(asked(chunks, bits), bits), "answered")
    totals = answers.filter("chunk < 0").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "v", "ends"))).head()
    train_tokens, train_rows = totals["n"], totals["ends"]
    space = train_tokens + totals["v"] + 1

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        tokens, pairs, sizes = _keys(rows)
        order = np.argsort(found["range"].to_numpy())

        def of(name: str, kind: str | type, keys: np.ndarray) -> np.ndarray:
            parts = found[name].to_pylist()
            return np.frombuffer(b"".join(parts[k] for k in order), kind)[np.unique(keys, return_inverse=True)[1]]

        alone, pair = of("tokens", "<i8", tokens), _middle(of("pairs", np.uint8, pairs))
        first = np.cumsum(sizes) - sizes
        before = np.concatenate(([0], alone[:-1]))
        before[first] = train_rows
        pair, base = np.minimum(pair, before), (alone + 1) / space
        learned = np.repeat(rows["held_out"].to_numpy() == 0, sizes)
        row = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)[learned]
        previous = np.concatenate((tokens[:1], tokens[:-1]))
        previous[first] = _START

        def others(count: np.ndarray, keys: np.ndarray) -> np.ndarray:
            """The counts without those of the row itself."""
            _, where, own = np.unique(mix(keys[learned] + row * np.uint64(0xA24BAED4963EE407)), return_inverse=True, return_counts=True)
            return np.maximum(count[learned] - own[where], 0)

        once = others(pair, pairs), others(before, previous), (others(alone, tokens) + 1) / space
        add = lambda v: np.add.reduceat(v, first)
        columns = [sizes.astype(np.int64), add((alone > 0).astype(np.int64)), add(np.log10(base))]
        every = [add(np.log10((pair + m * base) / (before + m))) for m in WEIGHTS]
        left_out = np.zeros((len(WEIGHTS), len(sizes)))  # of the chunk's training tokens, told with its first row
        left_out[:, 0] = [np.log10((once[0] + m * once[2]) / (once[1] + m)).sum() for m in WEIGHTS]
        return pa.Table.from_arrays([rows[id_col], rows["held_out"], *map(pa.array, columns), *map(pa.array, every), *map(pa.array, left_out)], names=kinds.names)

    doubles = ["base_score", *(f"s{k}" for k in range(len(WEIGHTS))), *(f"l{k}" for k in range(len(WEIGHTS)))]
    kinds = T.StructType([*source.schema.fields[:2], *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known")), *(T.StructField(n, T.DoubleType()) for n in doubles)])
    counts = answers.filter("chunk >= 0").select("chunk", "range", "tokens", "pairs")
    scored = C.store(chunks.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(run, kinds), "scored")
    C.drop(chunks, answers)
    likely = scored.agg(*(F.coalesce(F.sum(f"l{k}"), F.lit(0.0)) for k in range(len(WEIGHTS)))).head()
    best = max(range(len(WEIGHTS)), key=lambda k: likely[k])
    return scored.select(id_col, "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", F.col(f"s{best}").alias("score"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(C.table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
