"""Five factors of regression risk for each change set, their weighted sum, its class and exit code."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplescope.functions import paths

# Weights in the order in which they are added up, and the ceiling of changed lines.
WEIGHTS = (("scope_overflow", 0.30), ("complexity", 0.20), ("centrality", 0.20), ("test_coverage", 0.15), ("deletion", 0.15))
CEILING = 500


def looks_like_test(path: Column) -> Column:
    return paths.name(path).rlike(r"^test_|_test\.py$")


def test_candidates(path: Column) -> Column:
    """Where a file's test may lie."""
    base = F.regexp_replace(paths.name(path), r"\.[^.]*$", "")
    folder = paths.parent(path)
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    inner = F.array(path, at(folder, "/test_", base, ".py"), at("tests/test_", base, ".py"), at("test/", base, "_test.py"))
    outer = F.array(path, at("test_", base, ".py"), at("tests/test_", base, ".py"))
    return F.when(folder == ".", outer).otherwise(inner)


def scope_overflow(changes: DataFrame, scopes: DataFrame, phantoms: DataFrame) -> DataFrame:
    """(change_set_id, scope_overflow): the share of changed lines that lie in phantoms, side effects among them."""
    total = changes.groupBy("change_set_id").agg(F.sum(F.col("added_lines") + F.col("removed_lines")).alias("total"))
    outside = phantoms.groupBy("change_set_id").agg(F.sum(F.col("added_lines") + F.col("removed_lines")).alias("outside"))
    rows = total.join(outside, "change_set_id", "left").join(scopes.select("change_set_id", "confidence"), "change_set_id")
    share = F.least(F.lit(1.0), F.coalesce("outside", F.lit(0)) / F.col("total"))
    return rows.select("change_set_id", F.when((F.col("confidence") < 0.3) | (F.col("total") == 0), 0.0).otherwise(share).alias("scope_overflow"))


def line_factors(changes: DataFrame) -> DataFrame:
    """(change_set_id, complexity, deletion)."""
    added, removed = F.sum("added_lines"), F.sum("removed_lines")
    total = added + removed
    return changes.groupBy("change_set_id").agg(F.least(F.lit(1.0), total / F.lit(CEILING)).alias("complexity"), F.when(total == 0, 0.0).otherwise(F.try_divide(removed, total)).alias("deletion"))


def centrality_factor(changes: DataFrame, edges: DataFrame) -> DataFrame:
    """(change_set_id, centrality): the changed files' mean in-degree against the largest among them; `changes` may have it as centrality."""
    if "centrality" in changes.columns:
        return _mean_share(changes.select("change_set_id", F.col("centrality").alias("c")))
    counted = edges.groupBy(F.col("dst").alias("file_path")).agg(F.count("*").alias("c"))
    return _mean_share(changes.select("change_set_id", "file_path").join(counted, "file_path", "left").fillna(0, ["c"]))


def _mean_share(rows: DataFrame) -> DataFrame:
    share = F.try_divide(F.sum("c"), F.max("c") * F.count("*"))
    return rows.groupBy("change_set_id").agg(F.coalesce(share, F.lit(0.0)).alias("centrality"))


def test_coverage(changes: DataFrame) -> DataFrame:
    """(change_set_id, test_coverage): the share of changed files without a test among the changes."""
    path = F.col("file_path")
    is_test = F.coalesce(looks_like_test(path), F.lit(False))
    tests = changes.filter(is_test).select("change_set_id", path.alias("candidate")).distinct()
    # a test stands for itself; other files are looked for only where there are tests
    others = changes.filter(~is_test).select("change_set_id", "ordinal", "file_path").join(tests.select("change_set_id").distinct(), "change_set_id", "left_semi")
    wanted = others.select("change_set_id", "ordinal", F.explode(F.array_distinct(F.slice(test_candidates(path), 2, 3))).alias("candidate"))
    tested = wanted.join(tests, ["change_set_id", "candidate"]).select("change_set_id", "ordinal").distinct().groupBy("change_set_id").agg(F.count("*").alias("more"))
    counted = changes.groupBy("change_set_id").agg(F.count_if(is_test).alias("own"), F.count("*").alias("all"))
    return counted.join(tested, "change_set_id", "left").select("change_set_id", (F.lit(1.0) - (F.col("own") + F.coalesce("more", F.lit(0))) / F.col("all")).alias("test_coverage"))


def classify(score: Column, confidence: Column, safe: float = 0.3, danger: float = 0.6) -> Column:
    return F.when((confidence < 0.4) & (score >= danger), "review").when(score < safe, "safe").when(score < danger, "review").otherwise("danger")


def exit_code(level: Column, confidence: Column, fail_on: str | None) -> Column:
    fails = {"safe": F.lit(True), "review": level.isin("review", "danger"), "danger": level == "danger"}.get(fail_on or "", F.lit(False))
    return F.when(confidence < 0.4, 0).when(fails, 1).otherwise(0)


def risk(changes: DataFrame, scopes: DataFrame, phantoms: DataFrame, edges: DataFrame, fail_on: str | None = None, safe: float = 0.3, danger: float = 0.6) -> DataFrame:
    """(change_set_id, five factors, risk_score, risk_level, exit_code)."""
    rows = scope_overflow(changes, scopes, phantoms).join(line_factors(changes), "change_set_id").join(centrality_factor(changes, edges), "change_set_id").join(test_coverage(changes), "change_set_id")
    score = F.lit(0.0)
    for name, weight in WEIGHTS:
        score = score + F.lit(weight) * F.col(name)
    rows = rows.withColumn("risk_score", score).join(scopes.select("change_set_id", "confidence"), "change_set_id")
    rows = rows.withColumn("risk_level", classify(F.col("risk_score"), F.col("confidence"), safe, danger))
    return rows.withColumn("exit_code", exit_code(F.col("risk_level"), F.col("confidence"), fail_on)).drop("confidence")
