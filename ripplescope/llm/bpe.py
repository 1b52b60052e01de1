"""Byte-level BPE encoding and decoding with DuckDB inside Arrow functions.

Encoding: with the pattern that CUT names, texts are cut where a single space stands between two characters that
are not white space (it always starts a new match there) and equal parts are split by it once; with any other
pattern each text is split whole. Each match that a worker has not met yet goes into DuckDB as token-position rows,
one per byte. A recursive query joins neighbours to the merge table (every pair of tokens whose bytes make a token)
and contracts the leftmost pair of lowest rank of each word until no word has one left. It keeps the rows of all of
its steps, about half the square of a word's length, so words are grouped by the sum of these. A match that is a
token itself is that token. Matches of over LONG bytes, for which one contraction a step would cost the square of the
length, keep their pairs in a heap with the same order of contraction.

Decoding: at most SLICE token-position rows at once join the vocabulary; an ordered aggregation puts the bytes
of each document together, or of the part of a long one.

Null text counts as empty: no ids, no bytes. An id outside the vocabulary raises an error. Repeated rows give
repeated results; no rows give no rows; other columns of the input are ignored by encode and kept by decode.
"""
from __future__ import annotations

import base64
import heapq
import re
import string
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplescope.llm import _common as C

LONG, SLICE = 255, 1 << 18
#: Bytes of text encoded at once (each costs some queries), and entries of a memo.
GROUP_BYTES, MEMO_ENTRIES = 4 << 20, 3 * C.MEMO_ENTRIES
#: Rows of all steps that one recursive query may come to, and bytes of its words.
STEP_ROWS, WORD_BYTES = 6_000_000, 1 << 19
#: A word's share of a group by its length: of the bytes or of the steps' rows, whichever it fills more of.
_SHARE = [max(n, n * n * WORD_BYTES // (2 * STEP_ROWS)) for n in range(LONG + 1)]
# The pattern of which it is known where its matches begin.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_RUN = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")
_CONTRACT = """
WITH RECURSIVE t(step, w, pos, id, next_pos, next_id, m) AS (
  SELECT 0::USMALLINT, s.w, s.pos, s.id, s.next_pos, s.next_id, merges.m FROM start_rows s LEFT JOIN merges ON l = s.id AND r = s.next_id
  UNION ALL
  SELECT u.step, u.w, u.pos, u.id, u.next_pos, u.next_id, CASE WHEN touched THEN merges.m ELSE u.m END
  FROM (SELECT (step + 1)::USMALLINT AS step, t.w, pos, CASE WHEN pos = here THEN made ELSE id END AS id,
               CASE WHEN pos = here THEN far_pos ELSE next_pos END AS next_pos,
               CASE WHEN pos = here THEN far_id WHEN next_pos = here THEN made ELSE next_id END AS next_id, m, pos = here OR next_pos = here AS touched
        FROM t JOIN (SELECT best.w, (best.place % 256)::INT AS here, (best.place // 256)::INT AS made, gone, g.next_pos AS far_pos, g.next_id AS far_id
                     FROM (SELECT w, min(m * 256 + pos) AS place, arg_min(next_pos, m * 256 + pos) AS gone FROM t WHERE m IS NOT NULL GROUP BY w) best
                     JOIN t g ON g.w = best.w AND g.pos = best.gone) c ON c.w = t.w
        WHERE pos <> gone) u LEFT JOIN merges ON l = u.id AND r = u.next_id)
SELECT w, list(id ORDER BY pos) AS ids FROM t JOIN (SELECT w, max(step) AS step FROM t GROUP BY w) z USING (w, step) GROUP BY w ORDER BY w
"""
_DECODE = "SELECT doc, list(bytes ORDER BY pos) AS parts FROM token_rows JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class _Coder:
    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        compiled = regex.compile(pattern)
        self.split = (lambda text: [m[0] for m in compiled.finditer(text)]) if compiled.groups else compiled.findall
        self.cuts = pattern == CUT
        self.ranks = read_ranks(path)
        self.byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        pairs = [(a, b, m) for t, m in self.ranks.items() for i in range(1, len(t)) if (a := self.ranks.get(t[:i])) is not None and (b := self.ranks.get(t[i:])) is not None]
        made = np.array(pairs, np.int32).reshape(-1, 3)
        merges = pa.table({"l": made[:, 0], "r": made[:, 1], "m": made[:, 2]})
        vocabulary = pa.table({"id": pa.array(list(self.bytes_of), pa.int32()), "bytes": pa.array(list(self.bytes_of.values()), pa.binary())})
        for name, table in (("merges", merges), ("vocabulary", vocabulary)):
            self.con.register("given", table)
            self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self.con.unregister("given")
        self.matches: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}

    def _contract(self, words: list[bytes]) -> list[bytes]:
        size = np.array([len(w) for w in words])
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        ends = np.cumsum(size)
        pos = (np.arange(len(ids)) - np.repeat(ends - size, size)).astype(np.int32)
        after = np.append(ids[1:], np.int32(-1))
        after[ends - 1] = -1
        rows = pa.table({"w": np.repeat(np.arange(len(words), dtype=np.int32), size), "pos": pos, "id": ids, "next_pos": pos + 1, "next_id": after})
        self.con.register("start_rows", rows)
        ids = self.con.sql(_CONTRACT).to_arrow_table()["ids"].combine_chunks()
        self.con.unregister("start_rows")
        values, at = ids.values.to_numpy().astype("<u4"), ids.offsets.to_numpy()
        return [values[at[i] : at[i + 1]].tobytes() for i in range(len(words))]

    def _heap(self, word: bytes) -> bytes:
        """The same contractions for one long word."""
        n, ranks = len(word), self.ranks
        end, nxt, prev, alive = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        queue = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
        heapq.heapify(queue)
        while queue:
            _, i, stop = heapq.heappop(queue)
            if not alive[i] or nxt[i] >= n or end[nxt[i]] != stop:
                continue
            j = nxt[i]
            alive[j], end[i], nxt[i] = False, end[j], nxt[j]
            if nxt[i] < n:
                prev[nxt[i]] = i
            for a in (prev[i], i):
                if a >= 0 and nxt[a] < n and (r := ranks.get(word[a : end[nxt[a]]])) is not None:
                    heapq.heappush(queue, (r, a, end[nxt[a]]))
        return np.array([ranks[word[i : end[i]]] for i in range(n) if alive[i]], "<u4").tobytes()

    def _learn_matches(self, new: set[str]) -> dict[str, bytes]:
        C.trim(self.matches, new, 2 * MEMO_ENTRIES)
        extra: dict[str, bytes] = {}
        short: list[tuple[str, bytes]] = []
        for match in new.difference(self.matches):
            raw = match.encode()
            memo = self.matches if len(raw) <= 2 * C.MEMO_CHARS else extra
            if raw in self.ranks:
                memo[match] = self.ranks[raw].to_bytes(4, "little")
            elif len(raw) > LONG:
                memo[match] = self._heap(raw)
            else:
                short.append((match, raw))
        for batch in C.grouped_by_bytes(((x, _SHARE[len(x[1])]) for x in short), WORD_BYTES):
            for (match, raw), ids in zip(batch, self._contract([raw for _, raw in batch])):
                (self.matches if len(raw) <= 2 * C.MEMO_CHARS else extra)[match] = ids
        return extra

    def _matches(self, lead: str, part: str) -> list[str]:
        letters = part.rstrip(string.punctuation)
        if letters.isalpha():  # letters, then punctuation: no need to ask the pattern
            return [lead + letters, part[len(letters) :]] if len(letters) < len(part) else [lead + part]
        return self.split(lead + part)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        if not self.cuts:
            return self._encode_whole(texts)
        split = [_SAFE.split(t) if _RUN.search(t) else t.split(" ") for t in texts]
        once: list[tuple[dict[str, bytes], str]] = []  # parts too long to be remembered
        for memo, parts, lead in ((self.first, {p[0] for p in split}, ""), (self.rest, set(chain.from_iterable(split)), " ")):
            C.trim(memo, parts, MEMO_ENTRIES)
            new = parts.difference(memo)
            whole = {p: lead + p for p in new if p.isalpha()}  # one match
            found = {p: self._matches(lead, p) for p in new.difference(whole)}
            extra = self._learn_matches({*whole.values(), *chain.from_iterable(found.values())})
            ids_of = self.matches.get
            for part, match in whole.items():
                memo[part] = ids_of(match) or extra[match]
            for part, matches in found.items():
                memo[part] = b"".join([ids_of(m) or extra[m] for m in matches])
            once += [(memo, p) for p in new if len(p) > C.MEMO_CHARS]
        ids_of = self.rest.__getitem__
        out = [(self.first[p[0]] if t else b"") + b"".join(map(ids_of, p[1:])) for t, p in zip(texts, split)]
        for memo, part in once:
            del memo[part]
        return out

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        """encode() without knowing where the pattern's matches begin; text between matches has no ids."""
        split = [self.split(t) for t in texts]
        extra = self._learn_matches({m for matches in split for m in matches if m})
        return [b"".join([extra[m] if m in extra else self.matches[m] for m in matches if m]) for matches in split]

    def decode(self, flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """Bytes of documents of `sizes` ids each, whose ids are `flat`; DuckDB gets at most SLICE token rows at once."""
        if len(flat) and not (flat.min() >= 0 and set(np.unique(flat).tolist()) <= self.bytes_of.keys()):
            raise ValueError("an id is not in the vocabulary")
        owner = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        out: list[list[bytes]] = [[] for _ in sizes]
        for at in range(0, len(flat), SLICE):
            part = slice(at, at + SLICE)
            self.con.register("token_rows", pa.table({"doc": owner[part], "pos": np.arange(len(flat[part]), dtype=np.int32), "id": flat[part]}))
            found = self.con.sql(_DECODE).to_arrow_table().combine_chunks()
            parts, docs = found["parts"].combine_chunks(), found["doc"].to_pylist()
            # the bytes of consecutive parts lie one after the other
            _, at_part, held = parts.values.buffers()
            wide = np.int64 if pa.types.is_large_binary(parts.values.type) else np.int32
            ends = np.frombuffer(at_part, wide)[parts.values.offset :][parts.offsets.to_numpy()].tolist()
            held = memoryview(held)
            for k, doc in enumerate(docs):
                out[doc].append(bytes(held[ends[k] : ends[k + 1]]))
            self.con.unregister("token_rows")
        return [b"".join(parts) for parts in out]


_CODERS: dict[tuple[str, str], _Coder] = {}


def _coder(path: str, pattern: str) -> _Coder:
    if (path, pattern) not in _CODERS:
        _CODERS[path, pattern] = _Coder(path, pattern)
    return _CODERS[path, pattern]


def _encoded(batches: Iterator[pa.RecordBatch], coder: _Coder) -> Iterator[pa.RecordBatch]:
    """The first column of (id, text) batches with the ids of the text, in batches of bounded size."""
    for batch in batches:
        for at, texts in C.text_groups(batch.column(1), GROUP_BYTES):
            coded = coder.encode(texts)
            ends = np.cumsum([0] + [len(c) // 4 for c in coded], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), ids], names=[batch.schema.names[0], "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], coder: _Coder, ids_col: str) -> Iterator[pa.RecordBatch]:
    """The batches with the bytes of their ids as one more column."""
    for batch in batches:
        k = batch.schema.get_field_index(ids_col)
        sizes = batch.column(k).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        at = 0
        for group in C.grouped_by_bytes(((n, int(n)) for n in sizes), 1 << 20):
            part = batch.slice(at, len(group))
            flat = part.column(k).flatten().to_numpy(zero_copy_only=False)
            raw = coder.decode(flat.astype(np.int32), np.array(group, np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], names=[*batch.schema.names, "decoded"])
            at += len(group)


_IDS, _BYTES = T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.BinaryType())


def encode(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) for each row of `docs`, in its partitioning."""
    source = docs.select(id_col, docs[text_col].cast("string").alias("__text"))
    return source.mapInArrow(lambda batches: _encoded(batches, _coder(ranks_file, pattern)), T.StructType([source.schema[0], _IDS]))


def decode(coded: DataFrame, ranks_file: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """All columns of `coded` and, as `decoded`, the bytes of its ids."""
    return coded.mapInArrow(lambda batches: _decoded(batches, _coder(ranks_file, pattern), ids_col), T.StructType([*coded.schema.fields, _BYTES]))


def round_trip(docs: DataFrame, ranks_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids, decoded): encode, then decode of what it gave, in one Python worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(ranks_file, pattern)
        return _decoded(_encoded(batches, coder), coder, "ids")

    source = docs.select(id_col, docs[text_col].cast("string").alias("__text"))
    return source.mapInArrow(run, T.StructType([source.schema[0], _IDS, _BYTES]))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    how = P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN
    coded = round_trip(C.table(spark, sf_dir, "documents"), *how)
    digits = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
