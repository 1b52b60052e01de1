"""Cutting lineage where a plan would otherwise repeat its inputs many times."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; one of our own where that is unset, which only a local master may do."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ripplescope-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


#: While a table is written: what was shuffled for it goes as soon as it stands.
_WRITE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: The same for a table dealt by a key: what lies by it is joined by it and others where it lies.
_DEALT = _WRITE | {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


@contextmanager
def _set(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def settled(df: DataFrame, by: str | None = None, lies: bool = False) -> DataFrame:
    """df as a Parquet table of the shared folder, which goes when the session's JVM ends.

    A table dealt `by` a column lies in a bucket for each shuffle partition: later joins and groups by that column read it
    where it lies and don't shuffle it again. `lies`: df is partitioned by that column already.
    """
    spark, schema = df.sparkSession, df.schema
    place = f"{shared_dir(spark)}/settled-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    if by is None:
        with _set(spark, _WRITE):
            df.write.option("compression", "zstd").parquet(place)
        return spark.read.schema(schema).parquet(place)
    name = f"settled_{uuid.uuid4().hex}"
    with _set(spark, _DEALT):
        rows = df if lies else df.repartition(by)
        rows.write.format("parquet").option("compression", "zstd").option("path", place).bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), by).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its files stay
    return found
