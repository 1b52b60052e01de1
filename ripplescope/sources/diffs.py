"""Unified diffs as rows: one for each changed file, with its hunks, by Column expressions alone."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.functions import languages
from ripplescope.operators.scope import STRIP

# The form of a hunk's header.
_HUNK = r"(?md)^@@\s+-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s+@@(.*)$"
# Words before a name in a hunk's header.
_KEYWORDS = ("def", "class", "fn", "func", "function", "public", "private", "static")


def _strip(x: Column) -> Column:
    return F.regexp_replace(x, STRIP, "")


def _last_path(head: Column, mark: str, side: str) -> Column:
    """The last path after `mark` among the header lines, without a/ or b/; null if there is none or only /dev/null."""
    named = F.transform(F.filter(head, lambda line: line.startswith(f"{mark} ")), lambda line: _strip(F.substring(line, 5, 1 << 30)))
    path = F.try_element_at(F.filter(named, lambda p: p != "/dev/null"), F.lit(-1))
    return F.when(path.startswith(f"{side}/"), F.substring(path, 3, 1 << 30)).otherwise(path)


def _function(header: Column) -> Column:
    tokens = F.split(header, r"\s+")
    token = F.when(tokens[0].isin(*_KEYWORDS), F.try_element_at(tokens, F.lit(2))).otherwise(tokens[0])
    name = _strip(F.substring_index(F.substring_index(token, "(", 1), ":", 1))
    return F.when(name != "", name)


# Forms of changed lines that import something.
_IMPORT, _FROM, _REQUIRE = r"^import\s+(\S+)", r"^from\s+(\S+)\s+import\s+(.+)", r"""^const\s+\w+\s*=\s*require\s*\(\s*['"](.+?)['"]\s*\)"""


def _import(line: Column) -> Column:
    """What a changed line imports: the form of Python is tried first, so it also reads 'import x from'."""
    taken = lambda pattern, group=1: F.regexp_extract(line, pattern, group)
    return (
        F.when(line.rlike(_IMPORT), taken(_IMPORT))
        .when(line.rlike(_FROM), F.concat(taken(_FROM), F.lit("."), _strip(taken(_FROM, 2))))
        .when(line.rlike(_REQUIRE), taken(_REQUIRE))
    )


def parse(diffs: DataFrame) -> DataFrame:
    """Changed files of `diffs` (change_set_id, diff_text); ordinal is the file's place in its diff."""
    sections = diffs.select("change_set_id", F.posexplode(F.split("diff_text", r"(?md)^diff --git ")).alias("ordinal", "section")).filter(_strip(F.col("section")) != "")
    lines = F.split("section", "\n")
    head = F.slice(lines, 1, 10)
    header = r"^a/(.*) b/(.*)"
    rows = sections.select("*", _last_path(head, "---", "a").alias("old"), _last_path(head, "+++", "b").alias("new"), lines[0].alias("first"), head.alias("head"), lines.alias("lines"))
    bare = F.col("old").isNull() & F.col("new").isNull() & F.col("first").rlike(header)
    rows = rows.withColumn("bare", bare)
    rows = rows.withColumns({"old": F.when(F.col("bare"), F.regexp_extract("first", header, 1)).otherwise(F.col("old")), "new": F.when(F.col("bare"), F.regexp_extract("first", header, 2)).otherwise(F.col("new"))})
    rows = rows.filter("old is not null or new is not null")
    says = lambda text: F.exists("head", lambda line: line.startswith(text))
    kind = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "added").when(says("rename from ") | (F.col("old") != F.col("new")), "renamed").otherwise("modified")
    count = lambda x: F.when(x == "", 1).otherwise(x.cast("int"))
    pieces = F.split("section", _HUNK, -1)
    # one pass over the section for the header lines; their parts are taken from those short lines
    zipped = F.arrays_zip(F.regexp_extract_all("section", F.lit(_HUNK), F.lit(0)).alias("line"), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))).alias("content"))

    def hunk(h: Column) -> Column:
        part = lambda k: F.regexp_extract(h["line"], _HUNK, k)
        return F.struct(
            part(1).cast("int").alias("old_start"), count(part(2)).alias("old_count"), part(3).cast("int").alias("new_start"), count(part(4)).alias("new_count"),
            h["content"].alias("content"), F.when(_strip(part(5)) != "", _strip(part(5))).alias("function_header"),
        )

    hunks = F.transform(zipped, hunk)
    rows = rows.select("change_set_id", "ordinal", F.coalesce("new", "old").alias("file_path"), kind.alias("change_type"), hunks.alias("hunks"), says("new file mode").alias("is_new_file"), says("deleted file mode").alias("is_deleted"), "lines")
    rows = rows.withColumn("body", F.array_join(F.transform("hunks", lambda h: h["content"]), "\n"))
    added, removed = F.lit(r"(?md)^\+(?!\+\+)"), F.lit(r"(?md)^-(?!--)")
    renamed = F.try_element_at(F.filter("lines", lambda x: x.startswith("rename from ")), F.lit(1))
    spoken = lambda mark: F.regexp_extract_all("body", F.concat(mark, F.lit(".*(?:import|require).*")), F.lit(0))
    said = F.concat(spoken(added), spoken(removed))  # cheaper than the forms
    imports = F.transform(said, lambda x: _import(_strip(F.substring(x, 2, 1 << 30))))
    return rows.select(
        "change_set_id", "ordinal", "file_path", "change_type", "hunks",
        F.regexp_count("body", added).cast("long").alias("added_lines"), F.regexp_count("body", removed).cast("long").alias("removed_lines"),
        F.array_distinct(F.filter(F.transform("hunks", lambda h: _function(h["function_header"])), lambda x: x.isNotNull())).alias("functions_modified"),
        F.array_distinct(F.filter(imports, lambda x: x.isNotNull())).alias("imports_modified"),
        languages.of_change(F.col("file_path")).alias("language"), "is_new_file", "is_deleted",
        F.when(F.col("change_type") == "renamed", F.substring(renamed, 13, 1 << 30)).alias("old_path"),
    )


def messages(spark: SparkSession, path: str) -> DataFrame:
    """(change_set_id, head_message, pending_message) from a folder's files <change set>.head.txt and <change set>.pending.txt."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{head,pending}.txt")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:head|pending)\.txt$", 1)
    kind = F.regexp_extract(F.input_file_name(), r"\.(head|pending)\.txt$", 1)
    rows = files.select(name.alias("change_set_id"), kind.alias("kind"), _strip(F.col("value")).alias("text"))
    of = lambda k: F.coalesce(F.max(F.when(F.col("kind") == k, F.col("text"))), F.lit(""))
    return rows.groupBy("change_set_id").agg(of("head").alias("head_message"), of("pending").alias("pending_message"))


def place(root: str, last_commit: bool = False, ref: str | None = None) -> str:
    """Where exported diffs of a kind lie: <root>/last-commit, <root>/refs/<ref> or, as the index, <root>/staged."""
    return f"{root.rstrip('/')}/" + ("last-commit" if last_commit else f"refs/{ref}" if ref is not None else "staged")


def read(spark: SparkSession, path: str) -> DataFrame:
    """Diff files (*.diff, *.patch) of a folder; the file's name without its ending is the change set."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.{diff,patch}")
    name = F.regexp_extract(F.input_file_name(), r"([^/]+)\.(?:diff|patch)$", 1)
    return files.select(name.alias("change_set_id"), F.col("value").alias("diff_text"))
