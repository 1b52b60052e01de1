"""What a change set is meant to touch, from text or from its own changes."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplescope.functions import literals, paths
from ripplescope.plans.storage import settled

# Words that say nothing about a scope.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as this that these "
    "those it its and or but if then else when where how what which who not no all any some each every both few more most other into than too very just about up out "
    "also only so"
).split()
# Extensions of source files here, and the patterns of files and functions in text.
EXTENSIONS = ("py", "js", "jsx", "ts", "tsx", "go", "rs", "java", "rb", "c", "cpp", "h", "hpp")
FILES = r"(?U)(?:[\w./-]+/[\w./-]+\.(?:{0})|[\w.-]+\.(?:{0}))".format("|".join(EXTENSIONS))
FUNCTIONS = r"(?U)\b([a-zA-Z_]\w*)\s*\(\)"
STRIP = r"(?U)^\s+|\s+$"


def keywords(text: Column) -> Column:
    """Lower-cased words of over one character that are no stop words, in order."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))


def parse(texts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """`texts` (change_set_id, text, confidence, source) with description and targets.

    With `files` (path), a keyword also stands for the files of that stem and for the source files of any
    directory of that name.
    """
    text = F.col("text")
    rows = texts.select(
        "change_set_id",
        F.regexp_replace(text, STRIP, "").alias("description"),
        F.array_distinct(F.regexp_extract_all(text, F.lit(FILES), F.lit(0))).alias("target_files"),
        F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(FUNCTIONS), F.lit(1)))).alias("target_functions"),
        F.array_sort(F.array_distinct(keywords(text))).alias("target_concepts"),
        "confidence",
        "source",
    )
    if files is not None:
        mapped = keyword_files(rows.select("change_set_id", F.explode("target_concepts").alias("keyword")), files)
        mapped = mapped.groupBy("change_set_id").agg(F.collect_set("path").alias("more"))
        rows = rows.join(mapped, "change_set_id", "left").withColumn("target_files", F.array_union("target_files", F.coalesce("more", F.array().cast("array<string>")))).drop("more")
    return rows.withColumn("target_files", F.array_sort("target_files"))


def keyword_files(words: DataFrame, files: DataFrame) -> DataFrame:
    """(change_set_id, path) of files that the words (change_set_id, keyword) stand for."""
    path = F.col("path")
    source = paths.suffix(path).isin([f".{e}" for e in EXTENSIONS])
    folders = F.when(source, F.transform(paths.parent_parts(path), F.lower)).otherwise(F.array().cast("array<string>"))
    named = files.select("path", F.explode(F.array_distinct(F.concat(folders, F.array(F.lower(paths.stem(path)))))).alias("keyword"))
    return words.join(named, "keyword").select("change_set_id", "path").distinct()


def resolve(inputs: DataFrame) -> DataFrame:
    """(change_set_id, text, confidence, source): of prompt, cli_scope and head_message the first that isn't blank."""
    filled = lambda name: F.regexp_replace(F.coalesce(F.col(name), F.lit("")), STRIP, "") != ""
    sources = (("prompt", 1.0, "prompt_file"), ("cli_scope", 0.8, "cli"), ("head_message", 0.6, "commit_message"))
    chosen = F.lit(None).cast("struct<text:string,confidence:double,source:string>")
    for column, confidence, source in reversed(sources):
        chosen = F.when(filled(column), F.struct(F.col(column).alias("text"), F.lit(confidence).alias("confidence"), F.lit(source).alias("source"))).otherwise(chosen)
    return inputs.select("change_set_id", chosen.alias("c")).filter("c is not null").select("change_set_id", "c.*")


def dominant_directory(changes: DataFrame) -> DataFrame:
    """(change_set_id, directory): where most changes lie, the first of several; '.' is the root."""
    counted = changes.groupBy("change_set_id", paths.parent(F.col("file_path")).alias("directory")).agg(F.count("*").alias("n"), F.min("ordinal").alias("first"))
    return counted.groupBy("change_set_id").agg(F.max_by("directory", F.struct("n", -F.col("first"))).alias("directory"))


def infer(changes: DataFrame) -> DataFrame:
    """A scope of confidence 0.3 for each change set, from its own changes."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    stems = F.transform(paths.parts(F.col("file_path")), lambda p: F.regexp_replace(p, r"^(.+)\.[^.]+$", "$1"))
    words = F.transform(F.filter(stems, lambda s: (s != "") & ~F.array_contains(stop, s)), F.lower)
    gathered = changes.groupBy("change_set_id").agg(
        F.array_sort(F.collect_set("file_path")).alias("target_files"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("functions_modified")))).alias("target_functions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(words)))).alias("target_concepts"),
    )
    said = F.concat(F.lit("Changes concentrated in "), F.col("directory"))
    return gathered.join(dominant_directory(changes), "change_set_id").select("change_set_id", said.alias("description"), "target_files", "target_functions", "target_concepts", F.lit(0.3).alias("confidence"), F.lit("inferred").alias("source"))


def nothing(sets: DataFrame) -> DataFrame:
    """The scope of change sets (change_set_id) that have neither text nor changes."""
    none = F.array().cast("array<string>")
    return sets.select("change_set_id", F.lit("No changes to analyse").alias("description"), *(none.alias(f"target_{x}") for x in ("files", "functions", "concepts")), F.lit(0.3).alias("confidence"), F.lit("inferred").alias("source"))


def enrich(scopes: DataFrame, areas: DataFrame) -> DataFrame:
    """`scopes` with the files of areas (area, kind, path) whose name is a concept or part of the description, in any case.

    An area meets a description by the first characters of its name, and only where it does is the whole name looked for. Files
    are put together once for each set of areas that some scope means, so what is shuffled grows with scopes, not with their files.
    """
    known = settled(areas.filter("area is not null").select(F.lower("area").alias("area"), "path").distinct())
    names = settled(known.select("area").distinct().withColumn("key", literals.key(F.col("area"))))  # where it is small Spark sees so
    said = scopes.select("change_set_id", F.lower("description").alias("said"))
    offered = said.select("change_set_id", "said", F.explode(literals.pieces(F.col("said"), literals.lengths(names, "area"))).alias("key"))
    held = offered.join(names, "key").filter(F.contains("said", F.col("area"))).select("change_set_id", "area")
    named = scopes.select("change_set_id", F.explode("target_concepts").alias("area")).join(names, "area").select("change_set_id", "area")
    meant = settled(held.unionByName(named).groupBy("change_set_id").agg(F.array_sort(F.collect_set("area")).alias("areas")))
    each = meant.select("areas").distinct().select("areas", F.explode("areas").alias("area")).join(known, "area")
    more = settled(each.groupBy("areas").agg(F.array_sort(F.collect_set("path")).alias("more")))
    joined = scopes.join(meant, "change_set_id", "left").join(more, "areas", "left")
    files = F.sort_array(F.array_union(F.coalesce("more", F.array().cast("array<string>")), "target_files"))
    return joined.withColumn("target_files", files).drop("areas", "more")
