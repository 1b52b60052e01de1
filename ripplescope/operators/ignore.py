"""Ignore patterns of many projects at once: a table of patterns against a table of paths, without trying each with each.

A pattern is found by a literal that any path it matches must begin with, end with or hold: the longer of its literal
beginning and end, or else its longest literal in between; a pattern that is all literal, by the whole of it. Only where these
meet is the pattern itself tried. A project's equal patterns are one, that of the least ordinal. Patterns without any literal
('*', '[ab]?') meet every path of their project; they are few or the project ignores everything.
"""
from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplescope.functions import globs, literals
from ripplescope.plans.storage import settled

#: Patterns that a task may hold at once.
FEW = 50_000
# What stands for other characters in a pattern, and a set of characters in it.
_SPECIAL, _SET = r"[*?\[\]]", r"\[!?+\]?+[^\]]*+\]"


def _described(patterns: DataFrame) -> DataFrame:
    """(project, ordinal, pattern, regex, kind, literal): kind is e, p, s, g or a for a literal that is all, at the start, at the end, inside or none."""
    def translate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(map(globs.user_regex, batch.column(2).to_pylist()), pa.string())], names=[*batch.schema.names, "regex"])

    rows = patterns.filter("pattern is not null").groupBy("project", "pattern").agg(F.min("ordinal").alias("ordinal")).select("project", "ordinal", "pattern")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    rows = rows.mapInArrow(translate, f"{kinds}, regex string")
    folder = F.col("pattern").endswith("/")
    head = F.when(folder, F.regexp_replace("pattern", "/+$", "")).otherwise(F.regexp_extract("pattern", rf"^(?:(?!{_SPECIAL}).)*", 0))
    tail = F.when(folder, F.lit("")).otherwise(F.regexp_extract("pattern", rf"(?:(?!{_SPECIAL}).)*$", 0))
    runs = F.transform(F.split(F.regexp_replace("pattern", _SET, "*"), _SPECIAL), lambda x: F.struct(F.length(x).alias("n"), x.alias("text")))
    inner = F.when(folder, F.lit("")).otherwise(F.array_max(runs)["text"])
    rows = rows.withColumns({"head": head, "tail": tail, "inner": inner})
    kind = F.when(~folder & (F.col("pattern") != "") & (F.col("head") == F.col("pattern")), "e").when((F.col("head") != "") & (F.length("head") >= F.length("tail")), "p").when(F.col("tail") != "", "s").when(F.col("inner") != "", "g").otherwise("a")
    rows = rows.withColumn("kind", kind)
    literal = F.when(F.col("kind").isin("e", "p"), F.col("head")).when(F.col("kind") == "s", F.reverse("tail")).when(F.col("kind") == "g", F.col("inner")).otherwise("")
    return rows.select("project", "ordinal", "pattern", "regex", "kind", literal.alias("literal"))


def first_matches(paths: DataFrame, patterns: DataFrame) -> DataFrame:
    """(project, path, ordinal, pattern): for each of `paths` (project, path) the first of its project's patterns that matches it, if one does.

    patterns: project, ordinal, pattern, with the meaning of globs.user_ignored(). Of equal ordinals the least pattern counts;
    repeated paths have one row; null projects, paths and patterns match nothing.
    """
    whole = F.col("kind") == "e"
    described = _described(patterns)
    described = described.withColumn("key", F.when(whole, F.col("literal")).when(F.col("kind").isin("p", "s"), literals.key(F.col("literal"), literals.ENDS)).otherwise(literals.key(F.col("literal"))))
    described = settled(described)  # its Python is run once
    wanted = paths.select("project", "path").distinct()
    path = F.col("path")
    used = {k: literals.lengths(described.filter(F.col("kind") == k), "literal", literals.LADDER if k == "g" else literals.ENDS) for k in "psg"}
    tagged = lambda kind, keys: F.transform(keys, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("key")))
    ends = F.concat(tagged("a", F.array(F.lit(""))), tagged("e", F.array(path)), tagged("p", literals.starts(path, used["p"])), tagged("s", literals.starts(F.reverse(path), used["s"])))
    # a file of patterns is far smaller than they are in memory, so they are merged by their keys and not broadcast for its size
    offered = [(wanted.select("project", "path", F.explode(ends).alias("k")), described.filter("kind <> 'g'").hint("merge"))]
    if used["g"]:  # a text offers many such keys, but equal patterns are one and mostly few; only where a project has any
        inner = settled(described.filter("kind = 'g'"))
        inside = wanted.join(inner.select("project").distinct(), "project", "left_semi").repartition("project", "path")
        offered.append((inside.select("project", "path", F.explode(tagged("g", literals.pieces(path, used["g"]))).alias("k")), inner if inner.count() <= FEW else inner.hint("merge")))
    # whether the path has the whole literal is told before the expression is made
    kind, literal = F.col("kind"), F.col("literal")
    has = F.when(kind == "p", F.startswith("path", literal)).when(kind == "s", F.endswith(path, F.reverse(literal))).otherwise(F.contains("path", literal))
    met = [texts.select("project", "path", "k.*").join(held, ["project", "kind", "key"]).filter(whole | (has & F.regexp_like("path", F.col("regex")))).select("project", "path", "ordinal", "pattern") for texts, held in offered]
    met = met[0] if len(met) == 1 else met[0].unionByName(met[1])
    return met.groupBy("project", "path").agg(F.min(F.struct("ordinal", "pattern")).alias("m")).select("project", "path", "m.ordinal", "m.pattern")
