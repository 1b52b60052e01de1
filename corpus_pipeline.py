"""From documents to packed training sequences.

STAGES are applied in order; each takes (spark, docs, sf_dir) and returns a DataFrame that is written and read
again as the next one's docs. All but the last return the columns that they were given.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.llm import _common as C
from ripplescope.llm import jaccard_join, packing, pii, toxicity

#: Documents with this toxicity score or more are rejected.
REJECT = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below REJECT, by a model of the labelled ones among them; all where these are too few for one.

    Null and empty texts have the score of a text without a sign of toxicity and stay; rows with a null id are scored like
    others; each of repeated rows is judged alike; whole texts count, however long. No rows give no rows.
    """
    model = toxicity.train(docs, C.table(spark, sf_dir, "labels"))
    if isinstance(model, float):
        return docs
    own = C.free(docs, "__score")
    scored = toxicity.score(docs, model, keep=tuple(c for c in docs.columns if c != "doc_id"), out_col=own)
    return scored.filter(F.col(own) < REJECT).select(docs.columns)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each group that shares four fifths of its five-word shingles.

    Rows are told apart, not ids: of repeated rows one stays, rows with a null id stay only if their group has no other,
    and of an id with two texts each is judged for itself. Ties go to the first row stored. Rows with null or word-free
    text are in no group and stay. Whole texts count, however long. No rows give no rows.
    """
    row = C.free(docs, "__row")
    rows = C.store(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = jaccard_join.jaccard_join(rows, words=5, percent=80, id_col=row)
    groups = C.store(groups.select(row, "component_id").join(rows.select(row, "doc_id"), row), "groups")
    first = groups.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", row)).alias("first"))
    gone = C.store(groups.join(first.select(f"first.{row}"), row, "left_anti").select(row), "gone")  # by row: no key is hot
    C.drop(groups)
    if gone.count() <= jaccard_join.BROADCAST_IDS:
        gone = F.broadcast(gone)
    return rows.join(gone, row, "left_anti").select(docs.columns)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with [KIND] in place of personal data, and with n_chars, if there is one, of the new text.

    Null texts stay null, empty ones empty; of overlapping spans the first counts; each of repeated rows is treated alike;
    whole texts are searched, however long. No rows give no rows.
    """
    spans = C.free(docs, "__spans")
    told = pii.redact(pii.find(docs, out_col=spans), spans_col=spans)
    if "n_chars" in docs.columns:
        told = told.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return told.select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their places in sequences of at most 4096 tokens.

    Null and empty texts are their end id alone; long ones become several pieces; repeated rows are packed each for
    itself; equal lengths go by row. No rows give no rows.
    """
    import public_tokenizers as P

    return packing.pack(C.store(packing.pieces(docs, P.path("word_bpe_49k.json")), "pieces"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_group),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]
#: Trained models and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = C.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = C.store(stage(spark, docs, sf_dir), name)
        C.drop(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
