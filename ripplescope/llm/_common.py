"""Helpers shared by the text operators: shared storage, table access and byte-balanced batching."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Entries that a worker keeps in a per-process memo before it starts afresh; about 30 MB.
MEMO_ENTRIES = 150_000
#: Longest piece of text that is worth remembering.
MEMO_CHARS = 48
#: Bytes (UTF-8) of text handled at once inside an Arrow function.
GROUP_BYTES = 1 << 20


def free(df: DataFrame, name: str) -> str:
    """`name`, made longer until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ripplescope-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_STORED = "__stored_at"


def store(df: DataFrame, what: str, codec: str = "zstd") -> DataFrame:
    """Cut lineage: write df to the shared folder as Parquet and read it again."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", codec).parquet(path)
    stored = spark.read.schema(schema).parquet(path)
    setattr(stored, _STORED, path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)  # if drop() isn't called before
    return stored


def drop(*stored: DataFrame) -> None:
    """Delete tables of store() that nothing reads any more."""
    for df in stored:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(getattr(df, _STORED))
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def trim(memo: dict, wanted: Iterable, most: int) -> None:
    """Empties a memo of over `most` entries but for those wanted now, so that what is met again and again stays."""
    if len(memo) > most:
        kept = {k: memo[k] for k in wanted if k in memo}
        memo.clear()
        memo.update(kept)


def text_groups(column: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) for runs of rows of about `most` bytes, a larger text alone; null is empty. Only a run becomes Python objects."""
    column = pc.fill_null(column, "")
    ends = np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64))
    at, n = 0, len(column)
    while at < n:
        held = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, held + most, side="right")))
        yield at, column.slice(at, stop - at).to_pylist()
        at = stop


def grouped_by_bytes(items: Iterable[tuple[object, int]], most: int) -> Iterator[list]:
    """Lists of consecutive items whose sizes add up to about `most`; an item larger than that is alone."""
    held: list = []
    total = 0
    for item, size in items:
        if held and total + size > most:
            yield held
            held, total = [], 0
        held.append(item)
        total += size
    if held:
        yield held
