"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document's ids (with the end id) are cut every `capacity` ids. The pieces are dealt by a hash into groups
of about `group_tokens` ids, as many groups as the input needs. A group opens as many sequences as its ids
need at least; its pieces go in descending length to the sequence with the lowest estimated cost (linear * n
+ quadratic * n^2, summed over the pieces, as attention within a piece costs) among those with room. A piece
that fits nowhere is cut where the roomiest sequence ends, if that lies in the piece's last `tail` ids (these
travel with the piece, so that checksums of both parts are at hand); the crumbs fill what room is left. Only
when that fails does a group open one more sequence. So a group leaves about one sequence partly empty.

Null or empty text is the end id alone; repeated rows are packed each for itself; equal lengths go by row
order; no rows give no rows; other columns of the input are ignored. Rows with a null id are packed likewise.
"""
from __future__ import annotations

import json
import os
import re
import string
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplescope.llm import _common as C

# What the ways of _Ids are made for, as the tokenizer's file says it.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLIT = {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
#: Entries of a memo: most words of a text are met again.
MEMO_ENTRIES = 3 * C.MEMO_ENTRIES
_ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space for Python, not for the tokenizer


def _byte_chars() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


_BYTE_CHARS = _byte_chars()


class _Ids:
    """Ids of white-space separated words as little-endian 32-bit bytes, remembered while the worker lives.

    A word of letters with closing punctuation is two pieces for the pre-tokenizer, which are looked up apart,
    so that "The" and "the," are encoded once. Letters below U+0180 (but U+0130) are in normal form and have one
    lower case, so the tokenizer's model gets their byte characters at once. Where the tokenizer has another normalizer,
    pre-tokenizer or added tokens, texts are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        how = json.loads(self.tokenizer.to_str())
        loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["content"] != t["content"].strip() or " " in t["content"] for t in how["added_tokens"])
        #: Whether texts may be cut at white space and words at closing punctuation.
        self.cuts = not loose and how["normalizer"] == _NORMALIZER and how["pre_tokenizer"] == {"type": "Sequence", "pretokenizers": [_SPLIT, _LEVEL]} and how["post_processor"] is None
        self.words: dict[str, bytes] = {}
        self.cores: dict[str, bytes] = {}

    def _coded(self, part: str, letters: bool) -> bytes:
        """Ids of a part; lower-case Latin letters need only the model, all else takes the whole way."""
        ids = self.cores.get(part)
        if ids is None:
            if letters:
                tokens = self.tokenizer.model.tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(_BYTE_CHARS))
                ids = array("I", [t.id for t in tokens]).tobytes()
            else:
                ids = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
            if len(part) <= C.MEMO_CHARS:
                self.cores[part] = ids
        return ids

    def _word(self, word: str) -> bytes:
        core = word.rstrip(string.punctuation)
        if core.isalpha() and (core.isascii() or max(core) < "\u0180" and "\u0130" not in core):
            ids = self._coded(core.lower(), True)
            if len(core) < len(word):
                ids += self._coded(word[len(core) :], False)
        else:
            ids = self._coded(word, False)
        if len(word) <= C.MEMO_CHARS:
            self.words[word] = ids
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        if not self.cuts:
            return [array("I", self.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts]
        if len(self.words) > MEMO_ENTRIES:
            C.trim(self.words, set(chain.from_iterable(map(str.split, texts))), MEMO_ENTRIES)
        if len(self.cores) > MEMO_ENTRIES:
            self.cores.clear()
        known, out = self.words.get, []
        for text in texts:
            parts = [text] if _ODD_SPACE.search(text) else text.split()
            ids = list(map(known, parts))
            if None in ids:
                ids = [self._word(p) if i is None else i for i, p in zip(ids, parts)]
            out.append(b"".join(ids))
        return out


_IDS: dict[str, _Ids] = {}


def _ids(path: str) -> _Ids:
    if path not in _IDS:
        _IDS[path] = _Ids(path)
    return _IDS[path]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = 4096, end_id: int = 2, tail: int = 128, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, doc_tokens, __row, head_crc, tail_ids): each document cut every `capacity` ids."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _ids(tokenizer_file)
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            keep: list[int] = []
            rows: list[tuple[int, int, int, int, int]] = []
            tails: list[bytes] = []
            for at, texts in C.text_groups(batch.column(1)):
                for i, ids in enumerate(coder.encode(texts), at):
                    ids += end
                    n = len(ids) // 4
                    for start in range(0, n, capacity):
                        part = ids[4 * start : 4 * (start + capacity)]
                        size = len(part) // 4
                        carried = 0 if size == capacity else min(size, tail)
                        head = 4 * (size - carried)
                        keep.append(i)
                        rows.append((start, size, n, row, zlib.crc32(part[:head])))
                        tails.append(part[head:])
                        row += 1
            columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *columns, pa.array(tails, pa.binary())], names=names)

    names = [id_col, "start", "length", "doc_tokens", "__row", "head_crc", "tail_ids"]
    source = docs.select(id_col, docs[text_col].cast("string").alias("__text"))
    return source.mapInArrow(run, T.StructType([source.schema[0], *(T.StructField(n, T.LongType()) for n in names[1:-1]), T.StructField("tail_ids", T.BinaryType())]))


def assign(lengths: np.ndarray, carried: np.ndarray, capacity: int, linear: float = 1.0, quadratic: float = 1 / 4096) -> list[tuple[int, int, int, int, int]]:
    """(piece, first id, ids, sequence, offset) of the parts of each of `lengths`, which descend.

    The last `carried` ids of a piece may be cut anywhere.
    """
    full = int(np.searchsorted(-lengths, -capacity, side="right"))
    parts = [(i, 0, capacity, i, 0) for i in range(full)]
    bins = -(-int(lengths[full:].sum()) // capacity)
    room = np.full(bins + len(lengths) - full, capacity, np.int64)
    cost = np.zeros(len(room))
    crumbs: list[tuple[int, int, int]] = []

    def put(i: int, first: int, size: int, k: int) -> None:
        parts.append((i, first, size, full + k, capacity - int(room[k])))
        room[k] -= size
        cost[k] += linear * size + quadratic * size * size

    for i in range(full, len(lengths)):
        size = int(lengths[i])
        fits = np.where(room[:bins] >= size, cost[:bins], np.inf)
        k = int(fits.argmin())
        if fits[k] < np.inf:
            put(i, 0, size, k)
            continue
        k = int(room[:bins].argmax())
        held = int(room[k])
        if held and size - held <= carried[i]:
            put(i, 0, held, k)
            crumbs.append((i, held, size - held))
        else:
            bins += 1
            put(i, 0, size, bins - 1)
    for i, first, size in crumbs:
        while size:
            k = int(room[:bins].argmax())
            if not room[k]:
                k, bins = bins, bins + 1
            took = min(size, int(room[k]))
            put(i, first, took, k)
            first, size = first + took, size - took
    return parts


def pack(cut: DataFrame, capacity: int = 4096, group_tokens: int = 1 << 21, id_col: str = "doc_id") -> DataFrame:
    """Sequences and offsets for the rows of pieces(); `cut` should be stored, it is read twice."""
    total = cut.agg(F.sum("length")).head()[0] or 0
    groups = max(1, -(-total // group_tokens))

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("__row", "ascending")]).combine_chunks()
        column = lambda name: group.column(name).to_numpy()  # noqa: E731 - none of these is ever null
        length, tails, head = column("length"), group.column("tail_ids").to_pylist(), column("head_crc").tolist()
        carried = np.array([len(t) // 4 for t in tails], np.int64)
        parts = np.array(assign(length, carried, capacity), np.int64).reshape(-1, 5)
        crc = []
        for i, first, size, _, _ in parts.tolist():
            fixed = int(length[i] - carried[i])
            crc.append(zlib.crc32(tails[i][: 4 * (size - fixed)], head[i]) if not first else zlib.crc32(tails[i][4 * (first - fixed) : 4 * (first - fixed + size)]))
        piece = parts[:, 0]
        sequence = (int(column("__group")[0]) << 24) + parts[:, 3]
        ids = group.column(id_col).combine_chunks().take(pa.array(piece))  # an id stays what it is, beside null ones too
        numbers = (column("start")[piece] + parts[:, 1], parts[:, 2], np.array(crc, np.int64), column("doc_tokens")[piece], sequence, parts[:, 4])
        return pa.table([ids, *map(pa.array, numbers)], names=out)

    out = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    kinds = T.StructType([cut.schema[id_col], *(T.StructField(n, T.LongType()) for n in out[1:])])
    dealt = cut.withColumn("__group", F.pmod(F.xxhash64("__row"), F.lit(groups)))
    return dealt.groupBy("__group").applyInArrow(run, kinds)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    cut = pieces(C.table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
    return pack(C.store(cut, "pieces"))
