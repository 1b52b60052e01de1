"""Quality of commit messages against the changes that they describe."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplescope.functions import paths
from ripplescope.operators.scope import STRIP

# Messages that say nothing, and the form of a conventional one.
VAGUE = "fix update wip changes stuff misc cleanup tidy things done asdf temp test minor tweak refactor adjust change modify".split()
CONVENTIONAL = r"(?i)^(feat|fix|docs|style|refactor|perf|test|build|ci|chore|revert)(?:\([^)]+\))?:\s+.+"
SHORT = 10


def words_of_changes(changes: DataFrame) -> DataFrame:
    """(change_set_id, word): what a message may mention: stems, path parts of over two characters, functions."""
    path = F.col("file_path")
    trimmed = F.transform(paths.parts(path), lambda p: F.rtrim(F.rtrim(F.rtrim(F.lower(p), F.lit(".py")), F.lit(".js")), F.lit(".ts")))
    words = F.concat(F.array(F.lower(paths.stem(path))), F.filter(trimmed, lambda p: F.length(p) > 2), F.transform("functions_modified", F.lower))
    return changes.select("change_set_id", F.explode(words).alias("word")).distinct()


def suggestions(changes: DataFrame) -> DataFrame:
    """(change_set_id, suggestion, failed): a message made from the changes.

    It can't be made (failed) where a path ends before the first part in which the paths differ.
    """
    path = F.col("file_path")
    rows = changes.groupBy("change_set_id").agg(
        F.collect_set("change_type").alias("kinds"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", paths.stem(path).alias("stem")))), lambda x: x["stem"]).alias("stems"),
        F.min(paths.parts(path)).alias("lo"),
        F.max(paths.parts(path)).alias("hi"),
        F.min(F.size(paths.parts(path))).alias("short"),
        F.max(F.size(paths.parts(path))).alias("long"),
        F.count("*").alias("n"),
    )
    # the least and the greatest path share just what all share
    depth = F.size(F.filter(F.sequence(F.lit(0), F.least(F.size("lo"), F.size("hi"))), lambda i: (i > 0) & (F.slice("lo", 1, i) == F.slice("hi", 1, i))))
    rows = rows.withColumn("depth", depth)
    one = F.col("n") == 1
    scope = F.when(one, F.col("stems")[0]).when(F.col("depth") > 0, F.element_at("lo", F.greatest(F.col("depth"), F.lit(1)))).otherwise("")
    kind = F.when(F.col("kinds") == F.array(F.lit("added")), "feat").when(F.col("kinds") == F.array(F.lit("deleted")), "refactor").otherwise("fix")
    what = F.when(F.col("n") <= 3, F.array_join("stems", ", ")).otherwise(F.concat(F.col("n").cast("string"), F.lit(" files in "), F.when(scope == "", "project").otherwise(scope)))
    text = F.concat(kind, F.when(scope == "", "").otherwise(F.concat(F.lit("("), scope, F.lit(")"))), F.lit(": update "), what)
    failed = ~one & (F.col("depth") >= F.col("short")) & (F.col("short") < F.col("long"))
    return rows.select("change_set_id", F.when(~failed, text).alias("suggestion"), failed.alias("failed"))


def rounded(score: Column) -> Column:
    return F.bround(score, 2)


def quality(messages: DataFrame, changes: DataFrame) -> DataFrame:
    """(change_set_id, message, score, issues, is_vague, suggested_improvement) for `messages` (change_set_id, message).

    Where a suggestion is due but can't be made, all but the key and the message are null. score is rounded to two
    digits; whether a suggestion is due is told from the score before that.
    """
    message = F.coalesce(F.col("message"), F.lit(""))
    first = F.regexp_replace(F.split(F.regexp_replace(message, STRIP, ""), "\n")[0], STRIP, "")
    said = messages.select("change_set_id", message.alias("message"), first.alias("first")).repartition("change_set_id")
    mentioned = said.select("change_set_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("first"), F.lit("[a-z_]+"), F.lit(0)))).alias("word"))
    mentioned = mentioned.join(words_of_changes(changes), ["change_set_id", "word"], "left_semi").select("change_set_id").distinct().withColumn("hit", F.lit(True))
    rows = said.join(suggestions(changes), "change_set_id", "left").join(mentioned, "change_set_id", "left")
    any_change = F.col("failed").isNotNull()
    vague = F.lower("first").isin(VAGUE)
    short = F.length("first") < SHORT
    stray = any_change & F.col("hit").isNull()
    conventional = F.col("first").rlike(CONVENTIONAL)
    score = F.lit(1.0) - F.when(vague, 0.3).otherwise(0.0) - F.when(short, 0.2).otherwise(0.0) - F.when(stray, 0.2).otherwise(0.0)
    score = F.when(conventional, F.least(F.lit(1.0), score + 0.1)).otherwise(score - 0.1)
    score = F.when(F.col("first") == "", 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    issues = F.when(F.col("first") == "", F.array(F.lit("Empty commit message"))).otherwise(
        F.array_compact(
            F.array(
                F.when(vague, F.concat(F.lit("Vague commit message: '"), F.col("first"), F.lit("'"))),
                F.when(short, F.concat(F.lit("Commit message too short ("), F.length("first").cast("string"), F.lit(f" chars, minimum {SHORT})"))),
                F.when(stray, "Message does not reference changed files or modules"),
                F.when(~conventional, "Does not follow conventional commit format (type(scope): description)"),
            )
        )
    )
    rows = rows.select("change_set_id", "message", score.alias("score"), issues.alias("issues"), (vague | (F.col("first") == "")).alias("is_vague"), "suggestion", "failed", any_change.alias("any"))
    due = F.col("any") & (F.col("score") < 0.5)
    void = due & F.col("failed")
    keep = lambda c: F.when(~F.coalesce(void, F.lit(False)), c)
    return rows.select("change_set_id", "message", keep(rounded(F.col("score"))).alias("score"), keep(F.col("issues")).alias("issues"), keep(F.col("is_vague")).alias("is_vague"), F.when(due, F.col("suggestion")).alias("suggested_improvement"))
