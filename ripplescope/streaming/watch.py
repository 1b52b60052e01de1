"""Diffs as they arrive: the batch analysis of each new set of change sets."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ripplescope.sources import diffs


def watch(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], once: bool = False) -> StreamingQuery:
    """Calls `handle` with the parsed changes of each batch of new *.diff and *.patch files in `folder`."""
    texts = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.{diff,patch}").load(folder)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:diff|patch)$", 1)
    named = texts.select(name.alias("change_set_id"), F.col("value").alias("diff_text"))
    writer = named.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, epoch: handle(diffs.parse(batch), epoch))
    return (writer.trigger(availableNow=True) if once else writer).start()
