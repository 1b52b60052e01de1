"""Keeps an index of the words of a growing table of texts, so that names can be looked up in it.

    python -m jobs.reference_index --documents DIR --out DIR --checkpoint DIR [--config FILE]

New Parquet files of the table are taken as a stream that ends when all are read; its checkpoint remembers them. Each batch
writes the words of its own rows to folders of its own, batch=N/bucket=B, by replacing just these: a batch that is run again
after a failure gives the same folders. Words are dealt to buckets by their hash, so a lookup reads a few of them.

A text that comes again in a later batch replaces what the index had of it; current() reads it so. Rows of one key in one
batch count together, rows with a null key among them. A text without words has one row with a null word, so that it also
replaces. Columns other than key and text aren't read.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import _common as C
from ripplescope.sources import references

#: Tasks that may write one bucket of a batch.
PARTS = 16

SQL = r"""WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+') AS w FROM documents),
each AS (SELECT doc_id, unnest(w) AS token, generate_subscripts(w, 1) - 1 AS place FROM words)
SELECT doc_id, token, count(*) AS n, min(place)::INT AS first FROM each GROUP BY doc_id, token
UNION ALL SELECT doc_id, NULL, 0, NULL FROM words GROUP BY doc_id HAVING max(len(w)) = 0"""


def entries(docs: DataFrame, key: str, text: str, buckets: int) -> DataFrame:
    """The index of some rows, with the bucket of each word; a row with a null word for each key without any."""
    found = references.index(docs, key, text)
    none = docs.groupBy(key).agg(F.max(F.coalesce(F.col(text).rlike(references.WORD), F.lit(False))).alias("any")).filter("not any")
    void = none.select(key, F.lit(None).cast("string").alias("token"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("int").alias("first"))
    return found.unionByName(void).withColumn("bucket", F.pmod(F.crc32(F.coalesce("token", F.lit("")).cast("binary")), F.lit(buckets)).cast("int"))


def run(spark: SparkSession, documents: str, out: str, checkpoint: str, config: dict[str, object]) -> None:
    """Adds what is new in the table at `documents` to the index at `out`; with nothing new, nothing is written."""
    key, text, buckets = str(config["key"]), str(config["text"]), int(config["buckets"])
    schema = spark.read.parquet(documents).select(key, text).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", int(config["max_files_per_batch"])).parquet(C.only(documents))

    def add(batch: DataFrame, number: int) -> None:
        made = entries(batch, key, text, buckets).withColumn("batch", F.lit(number))
        # a bucket lies in few tasks, by its words, and a task writes few buckets; no range, as its sample would work all out once more
        made.repartition("bucket", F.pmod(F.xxhash64("token"), F.lit(PARTS))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "bucket").parquet(out)
        written = spark.read.schema(made.schema).parquet(out).filter(F.col("batch") == number)
        C.log.info("batch %d: %d texts read from %s, %d entries written to %s", number, batch.count(), documents, written.count(), out)

    query = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(add).trigger(availableNow=True).start()
    query.awaitTermination()
    if not any(p["numInputRows"] for p in query.recentProgress):
        C.log.info("nothing new in %s", documents)


def current(spark: SparkSession, out: str, key: str = "doc_id") -> DataFrame:
    """(key, token, n, first, bucket) of the newest batch of each text.

    The last batch is the newest of all its texts, so only earlier ones are held against what came after them.
    """
    found = spark.read.parquet(out)
    last = found.agg(F.max("batch")).first()[0]
    earlier = found.filter(F.col("batch") < last)
    newest = found.groupBy(key).agg(F.max("batch").alias("batch"))
    kept = earlier.join(newest, earlier[key].eqNullSafe(newest[key]) & (earlier["batch"] == newest["batch"]), "left_semi")
    if earlier.isEmpty():
        return found.drop("batch")
    return found.filter(F.col("batch") == last).unionByName(kept).drop("batch")


def job2_reference_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents after two runs, of which the second finds nothing new."""
    folder, config = C.new_folder(spark, "job2"), C.config(spark, C.default("reference_index"))
    for _ in range(2):
        run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint", config)
    return current(spark, f"{folder}/out").select("doc_id", "token", "n", "first")


def main() -> None:
    args = C.arguments(__doc__, documents="table of texts", out="folder of the index", checkpoint="folder of the stream's checkpoint").parse_args()
    spark = C.session("reference_index")
    try:
        run(spark, args.documents, args.out, args.checkpoint, C.config(spark, args.config or C.default("reference_index")))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
