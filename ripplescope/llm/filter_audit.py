"""How filters interact: what each would remove at any place of any order.

A document is told by the set of filters that it fails. Documents with equal sets are counted first; each count then goes
to the edges of the lattice of applied filters, an edge being a set already applied and the filter that comes next (80 for
five filters), and an order of the filters is a path of such edges. So no order is run: its steps are joined to the edges.

Null text counts as empty, which fails nothing but a floor on words; a null part is the empty one. A row with a null id is
no copy of another, nor another one of it; of rows of one text those with the least id are the original, repeated ones too.
Labels of an id in several rows count if any does. Texts are read whole. No rows give no rows.
Other columns of the input are left out, whatever their names.
"""
from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.llm import _common as C

LETTERS = "ABCDE"


def text_failures(text: Column) -> Column:
    """Bits 0 to 3: few words, few distinct words, many capitals, a sign of markup."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def told(w: Column) -> Column:
        n = F.size(w)
        few, poor = n < 200, F.size(F.array_distinct(w)).cast("long") * 100 < n.cast("long") * 50
        capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
        loud, marked = capitals.cast("long") * 100 > F.length(text).cast("long") * 3, text.rlike("[#$%&*|]")
        bits = [F.when(c, F.lit(1 << k)).otherwise(F.lit(0)) for k, c in enumerate((few, poor, loud, marked))]
        return bits[0] + bits[1] + bits[2] + bits[3]

    return F.transform(F.array(words), told)[0]  # the words are split once


def failures(docs: DataFrame, labels: DataFrame, part_col: str = "lang") -> DataFrame:
    """(part, fails, n, good, toxic): documents by part and set of failed filters; copies of a smaller id's text fail bit 4 too.

    Rows of a text meet only after rows of one text, part and labels are summed, so a text with very many copies is no hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    told = docs.select("doc_id", F.coalesce(F.col(part_col), F.lit("")).alias("part"), text_failures(text).alias("fails"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"))
    told = C.store(told, "told")
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    known = told.filter("doc_id is not null").join(marks, "doc_id", "left")
    known = known.select("doc_id", "part", "fails", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    kind = ("digest", "part", "fails", "good", "toxic")
    rows = known.groupBy("doc_id", *kind).agg(F.count("*").alias("n"))
    summed = rows.groupBy(*kind).agg(F.min(F.struct("doc_id", "n")).alias("first"), F.sum("n").alias("n"))
    summed = summed.withColumn("least", F.expr("min(first.doc_id) over (partition by digest)"))
    own = F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(F.lit(0))
    split = summed.select("part", "good", "toxic", F.explode(F.array(F.struct("fails", own.alias("n")), F.struct((F.col("fails") + 16).alias("fails"), (F.col("n") - own).alias("n")))).alias("x")).select("part", "good", "toxic", "x.*")
    nameless = told.filter("doc_id is null").groupBy("part", "fails").agg(F.count("*").alias("n")).select("part", F.lit(False).alias("good"), F.lit(False).alias("toxic"), "fails", "n")
    of = lambda c: F.coalesce(F.sum(F.when(F.col(c), F.col("n"))), F.lit(0))
    return split.unionByName(nameless).groupBy("part", "fails").agg(F.sum("n").alias("n"), of("good").alias("good"), of("toxic").alias("toxic"))


def edges(counts: DataFrame, filters: int) -> DataFrame:
    """(part, applied, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost) of each edge of the lattice."""
    places = [(sum(1 << k for k in before), k) for k in range(filters) for r in range(filters) for before in combinations([x for x in range(filters) if x != k], r)]
    lattice = F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(k).alias("filter"), F.lit(1 << k).alias("bit")) for a, k in places])
    gone, fails = F.col("fails").bitwiseAND(F.col("applied")) != 0, F.col("fails").bitwiseAND(F.col("bit")) != 0
    total = lambda when, of="n": F.sum(F.when(when, F.col(of)).otherwise(F.lit(0)))
    return counts.select("*", F.explode(lattice).alias("e")).select("part", "fails", "n", "good", "toxic", "e.*").groupBy("part", "applied", "filter").agg(
        total(~gone & ~fails).alias("kept"), total(~gone & fails).alias("removed"), total(gone & fails).alias("redundant"), total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(~gone & fails, "good").alias("good_lost"), total(~gone & fails, "toxic").alias("toxic_lost"),
    )


def audit(counts: DataFrame, letters: str = LETTERS) -> DataFrame:
    """One row for each part, order of the filters and step; counts as failures() gives them, bit k being the k-th letter's filter.

    shapley is a filter's removed over all orders, at whatever step it stands. The number of steps grows with the factorial
    of the filters, not with the documents.
    """
    steps = [("".join(o), k + 1, sum(1 << letters.index(x) for x in o[:k]), letters.index(o[k])) for o in permutations(letters) for k in range(len(letters))]
    paths = counts.sparkSession.createDataFrame(steps, "filter_order string, step int, applied int, filter int")
    found = edges(counts, len(letters)).join(F.broadcast(paths), ["applied", "filter"])  # five filters have 600 steps
    columns = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")
    return found.select("part", "filter_order", "step", *columns, F.expr("sum(removed) over (partition by part, filter)").alias("shapley"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders over the documents of each language."""
    return audit(failures(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "labels")))
