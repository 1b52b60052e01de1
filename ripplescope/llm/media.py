"""Media columns: content-defined chunks of payloads, stored once by digest and put together again.

A payload is the UTF-8 text with bytes 0 appended up to a positive multiple of 64. A gear hash rolls over
its last 32 bytes; a chunk ends where the hash has `bits` zero bits at the top, at least `least` and at most
`most` bytes from its start. Each chunk is kept once, by its SHA-256, as a zstd frame in a Parquet table of
the shared folder; a manifest holds each row's ordered chunk list. Reading goes the other way: frames are
decompressed and held against their digests, then each different chunk list is put together once (a list of
one chunk needs no gathering) and its features go to all rows that carry it.

The stored form of a payload is its container: for each chunk in order the 32 bytes of its digest and the
frame. Equal texts have equal chunk lists and so equal results. Null text counts as empty (64 bytes 0);
repeated rows give repeated results; no rows give no rows; other columns of the input are ignored.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ripplescope.llm import _common as C

LEAST, MOST, BITS, LEVEL = 4096, 65536, 13, 6
_GEAR = np.frombuffer(b"".join(hashlib.sha256(bytes([i])).digest()[:4] for i in range(256)), "<u4")
_FEATURES = T.StructType([T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())])


def payload_of(text: bytes) -> bytes:
    return text + bytes(64 - len(text) % 64 if not text or len(text) % 64 else 0)


def cuts(payload: bytes, least: int = LEAST, most: int = MOST, bits: int = BITS) -> list[int]:
    """Ends of the chunks of a payload."""
    n = len(payload)
    if n <= least:
        return [n]
    h = _GEAR[np.frombuffer(payload, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # h[i] = sum of gear[byte i-j] << j over the last 32 bytes
        h[k:] += h[:-k] << np.uint32(k)
    at = np.flatnonzero(h >> np.uint32(32 - bits) == 0) + 1
    ends, start, k = [], 0, 0
    while n - start > least:
        k = int(np.searchsorted(at, start + least))
        end = min(int(at[k]) if k < len(at) else n, start + most, n)
        ends.append(end)
        start = end
    if start < n:
        ends.append(n)
    return ends


def _chunks(text: bytes) -> list[bytes]:
    payload = payload_of(text)
    start, out = 0, []
    for end in cuts(payload):
        out.append(payload[start:end])
        start = end
    return out


def manifest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, list_id, digests): the ordered chunk list of each row; list_id is the digest of the list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, names, lists = [], [], []
            for text in batch.column(1).fill_null("").cast(pa.binary()):
                raw = text.as_py()
                digests = [hashlib.sha256(c).digest() for c in _chunks(raw)]
                sizes.append(len(raw))
                names.append(hashlib.sha256(b"".join(digests)).digest())
                lists.append(digests)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(lists, pa.list_(pa.binary()))], names=[id_col, "n_bytes", "list_id", "digests"])

    source = docs.select(id_col, docs[text_col].cast("string").alias("__text"))
    kinds = T.StructType([source.schema[0], T.StructField("n_bytes", T.LongType()), T.StructField("list_id", T.BinaryType()), T.StructField("digests", T.ArrayType(T.BinaryType()))])
    return source.mapInArrow(run, kinds)


def frames(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(digest, frame, alone, part): each digest once, and whether it makes up a payload or is one of several chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            made: dict[bytes, list] = {}
            for text in batch.column(0).fill_null("").cast(pa.binary()):
                chunks = _chunks(text.as_py())
                for chunk in chunks:
                    digest = hashlib.sha256(chunk).digest()
                    if digest not in made:
                        made[digest] = [pack.compress(chunk), False, False]
                    made[digest][1 if len(chunks) == 1 else 2] = True
            columns = [pa.array([v[k] for v in made.values()], t) for k, t in enumerate((pa.binary(), pa.bool_(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array(list(made), pa.binary()), *columns], names=["digest", "frame", "alone", "part"])

    source = docs.select(docs[text_col].cast("string").alias("__text"))
    made = source.mapInArrow(run, "digest binary, frame binary, alone boolean, part boolean")
    return made.groupBy("digest").agg(F.first("frame").alias("frame"), F.bool_or("alone").alias("alone"), F.bool_or("part").alias("part"))


def _verified(digest: bytes, frame: bytes, unpack) -> bytes:
    chunk = unpack.decompress(frame)
    if hashlib.sha256(chunk).digest() != digest:
        raise ValueError(f"chunk {digest.hex()} was not read back as it was stored")
    return chunk


def _features(parts: list[tuple[bytes, bytes]], unpack) -> tuple[int, str, int, int, str, str]:
    """Of a payload whose (digest, frame) are `parts`."""
    payload = b"".join(_verified(d, f, unpack) for d, f in parts)
    media = b"".join(d + f for d, f in parts)
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    feature = f"chunks={len(parts)};mean={counts @ np.arange(256) / len(payload):.4f};entropy={-(share * np.log2(share)).sum():.4f};values={len(share)}"
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature


def read_back(lists: DataFrame, kept: DataFrame) -> DataFrame:
    """(list_id, features) of each different chunk list of `lists`, from the stored chunks `kept`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            parts = batch.column(1).to_pylist()
            rows = [_features([(x["digest"], x["frame"]) for x in sorted(p, key=lambda x: x["pos"])], unpack) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], pa.string() if isinstance(f.dataType, T.StringType) else pa.int64()) for i, f in enumerate(_FEATURES))], names=["key", *_FEATURES.names])

    kinds = T.StructType([T.StructField("key", T.BinaryType()), *_FEATURES])
    alone = kept.filter("alone").select("digest", F.array(F.struct(F.lit(0).alias("pos"), "digest", "frame")).alias("parts")).mapInArrow(run, kinds)
    distinct = lists.filter(F.size("digests") > 1).groupBy("list_id").agg(F.first("digests").alias("digests"))
    needed = distinct.select("list_id", F.posexplode("digests").alias("pos", "digest"))
    gathered = needed.join(kept.filter("part").select("digest", "frame"), "digest").groupBy("list_id").agg(F.collect_list(F.struct("pos", "digest", "frame")).alias("parts"))
    return alone.unionByName(gathered.mapInArrow(run, kinds))


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the payload of each row, reads it back, and returns the id with sizes, digests and features."""
    lists = C.store(manifest(docs, id_col, text_col), "manifest")
    kept = C.store(frames(docs, text_col), "chunks", "uncompressed")
    keyed = lists.select(id_col, "n_bytes", F.when(F.size("digests") == 1, F.col("digests")[0]).otherwise(F.col("list_id")).alias("key"))
    return keyed.join(read_back(lists, kept), "key").select(id_col, "n_bytes", *_FEATURES.names)


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media(C.table(spark, sf_dir, "documents"))
