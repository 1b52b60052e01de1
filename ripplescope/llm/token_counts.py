"""Token counts of whole texts by a byte-level `tokenizers` vocabulary.

Texts are cut only at a single space between two characters that are not white space. A byte-level
pre-tokenizer always starts a new piece there (the space goes with the word that follows), so the counts of
the parts add up to the count of the whole. Equal parts in a batch are encoded once, in batches of about
equal bytes, and only lengths leave the function. With any other normalizer, pre-tokenizer or added tokens
that reach over a space, texts are encoded whole.

Null text counts as empty (0 bytes, 0 tokens); repeated rows give repeated results; no rows give no rows;
other columns of the input are ignored.
"""
from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ripplescope.llm import _common as C

#: Bytes of text counted at once, and entries of a memo: most words of a text are met again.
GROUP_BYTES, MEMO_ENTRIES = 4 << 20, 3 * C.MEMO_ENTRIES
_RUN = re.compile(r"\s\s")
_SAFE = re.compile(r"(?<=\S) (?=\S)")


class _Counter:
    """Lengths of encoded parts, remembered for as long as the worker lives."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        how = json.loads(self.tokenizer.to_str())
        level = how["pre_tokenizer"] or {}
        apart = (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, True)
        loose = any(t["lstrip"] or t["rstrip"] or t["single_word"] or " " in t["content"] for t in how["added_tokens"])
        #: Whether texts may be cut at single spaces.
        self.cuts = apart and not loose and how["normalizer"] is None and how["post_processor"] is None
        self.first: dict[str, int] = {}
        self.rest: dict[str, int] = {}

    def _learn(self, memo: dict[str, int], parts: set[str], lead: str) -> dict[str, int]:
        """Counts for all of `parts`; those too long to remember are returned apart."""
        C.trim(memo, parts, MEMO_ENTRIES)
        new = sorted(parts.difference(memo), key=len)
        extra: dict[str, int] = {}
        for batch in C.grouped_by_bytes(((p, len(p.encode()) + 16) for p in new), 1 << 20):
            coded = self.tokenizer.encode_batch_fast([lead + p for p in batch], add_special_tokens=False)
            for part, enc in zip(batch, coded):
                (memo if len(part) <= C.MEMO_CHARS else extra)[part] = len(enc)
        return extra

    def counts(self, texts: list[str]) -> list[int]:
        if not self.cuts:
            return [len(self.tokenizer.encode(t, add_special_tokens=False)) for t in texts]
        split = [_SAFE.split(t) if _RUN.search(t) else t.split(" ") for t in texts]
        heads = {parts[0] for parts in split}
        extra_first = self._learn(self.first, heads, "")
        tails = set(chain.from_iterable(split))
        extra_rest = self._learn(self.rest, tails, " ")
        first = self.first if not extra_first else {**{h: self.first[h] for h in heads if h in self.first}, **extra_first}
        rest = self.rest if not extra_rest else {**{p: self.rest[p] for p in tails if p in self.rest}, **extra_rest}
        return [first[parts[0]] + sum(map(rest.__getitem__, parts[1:])) if t else 0 for t, parts in zip(texts, split)]


_COUNTERS: dict[str, _Counter] = {}


def _counter(path: str) -> _Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = _Counter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for each row of `docs`, in its partitioning, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_file)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            size = pc.cast(pc.binary_length(text), pa.int64())
            counts: list[int] = []
            for _, texts in C.text_groups(text, GROUP_BYTES):
                counts += counter.counts(texts)
            tokens = pa.array(counts, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), size, tokens, pc.greater(tokens, limit)], names=names)

    names = [id_col, "n_bytes", "n_tokens", "over_limit"]
    source = docs.select(id_col, docs[text_col].cast("string").alias("__text"))
    schema = T.StructType([source.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("over_limit", T.BooleanType())])
    return source.mapInArrow(run, schema)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return token_counts(C.table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"))
