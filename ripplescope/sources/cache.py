"""The file graph kept beside the project, and brought up to date by what changed.

A cache is a folder with a version file and, in a folder of their own that it names, Parquet tables: the edges, the times of
the files from which they were made, and each import with the file that it was found to mean. A new state is written to a new
folder and the version file is replaced last; so a reader sees one state or the other, and a run that fails leaves the old one
or, if it fails in that very moment, none. Without a version file, with another version or with tables that can't be read
there is no cache. The state before the newest stays for those who still read it.
"""
from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.plans.storage import settled
from ripplescope.sources import project

VERSION = 2
_TABLES = {"edges": {"src", "dst"}, "mtimes": {"path", "mtime"}, "imports": {"path", "language", "name", "dst"}}


def place(root: str) -> str:
    return f"{root.rstrip('/')}/{project.CACHE}"


def mtimes(files: DataFrame) -> DataFrame:
    """(path, mtime) of files (path, modified)."""
    return files.select("path", F.col("modified").cast("double").alias("mtime"))


def _said(spark: SparkSession, folder: str) -> list[str]:
    """The names of the newest state and the one before it; empty without a cache of this version."""
    try:
        said = [r[0].split() for r in spark.read.text(f"{folder}/version").limit(2).collect()]
    except AnalysisException:
        return []
    return said[0][1:] if len(said) == 1 and said[0][:1] == [str(VERSION)] else []


def save(spark: SparkSession, folder: str, edges: DataFrame, times: DataFrame, imports: DataFrame | None = None) -> None:
    """Writes a new state and makes it the newest; without imports it can't be brought up to date, only built anew."""
    name, before = f"state-{uuid.uuid4().hex}", _said(spark, folder)
    for table, rows in (("edges", edges), ("mtimes", times), ("imports", imports)):
        if rows is not None:
            rows.select(*sorted(_TABLES[table])).write.parquet(f"{folder}/{name}/{table}")
    said = " ".join([str(VERSION), name, *before[:1]])
    spark.range(1).select(F.lit(said).alias("value")).coalesce(1).write.mode("overwrite").text(f"{folder}/version")
    for old in before[1:]:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{old}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    said = _said(spark, folder)
    try:
        found = spark.read.parquet(f"{folder}/{said[0]}/{name}") if said else None
    except AnalysisException:
        return None
    return found if found is not None and {*found.columns} == _TABLES[name] else None


def load(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """(edges, times), or None without a readable cache of this version."""
    edges, times = _table(spark, folder, "edges"), _table(spark, folder, "mtimes")
    return None if edges is None or times is None else (edges.select("src", "dst"), times.select("path", "mtime"))


def refreshed(imports: DataFrame, states: DataFrame, files: DataFrame) -> DataFrame:
    """`imports` (path, language, name, dst) as they are after the changes `states` (path, state) that led to `files` (path, source).

    Only files that were added or modified are parsed. Looked for anew are their imports and those of other files that may mean
    a file which was added or removed; all others stay as they were.
    """
    touched = states.select("path")
    fresh = project.imports(files.select("path", "source").join(states.filter("state <> 'removed'").select("path"), "path", "left_semi"))
    old = imports.join(touched, "path", "left_anti")
    moved = states.filter("state <> 'modified'").select(F.col("path").alias("dst"))
    key = ["path", "language", "name"]
    unsure = settled(project.candidates(old).join(moved, "dst", "left_semi").select(*key).distinct())
    again = project.resolve(fresh.select(*key).unionByName(unsure), files)
    return old.join(unsure, key, "left_anti").select(*key, "dst").unionByName(again.select(*key, "dst"))


def edges(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """The file graph of a project whose sources are `files` (path, source, modified): from its cache, brought up to date, or built and kept."""
    folder, now = place(root), mtimes(files)
    kept = load(spark, folder)
    states = settled(project.stale(kept[1], now)) if kept is not None else None
    if states is not None and states.isEmpty():
        return kept[0]
    known = _table(spark, folder, "imports") if states is not None else None
    if known is None:
        made = project.resolve(project.imports(files.select("path", "source")), files)
    else:
        made = refreshed(known, states, files)
    made = settled(made)
    save(spark, folder, project.edges_of(made), now, made)
    found = load(spark, folder)
    return found[0] if found is not None else project.edges_of(made)
