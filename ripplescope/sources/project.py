"""Source files of a project as rows, what they import, and the file graph that follows.

files: path, source (and modified where it matters). Only Python sources are parsed outside the JVM.
"""
from __future__ import annotations

import ast
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplescope.functions import languages, paths
from ripplescope.operators import joins
from ripplescope.plans.storage import settled

# Directories that hold no sources of the project.
SKIPPED = ("__pycache__", ".git", "node_modules", ".tox", ".eggs", "venv", ".venv", "site-packages")
#: Where a project's file graph may be kept.
CACHE = ".ripplescope-cache"
# Forms of an import by language; of several in a line the first form that is found counts.
_QUOTED = r"""['"]([^'"]+)['"]"""
IMPORTS = {
    "go": [r'^import\s+(?:"([^"]+)")', r'^import\s+\w+\s+"([^"]+)"', r'^\s*"([^"]+)"\s*$'],
    "rust": [r"use\s+([\w:]+)", r"extern\s+crate\s+(\w+)"],
    "java": [r"import\s+static\s+([\w.]+)", r"import\s+([\w.]+)\s*;"],
    "ruby": [r'require_relative\s+"([^"]+)"', r"require_relative\s+'([^']+)'", r'require\s+"([^"]+)"', r"require\s+'([^']+)'", r"include\s+([\w:]+)"],
    "c": [r'#include\s*"([^"]+)"', r"#include\s*<([^>]+)>"],
    "javascript": [r"import\s+.*?\s+from\s+" + _QUOTED, r"export\s+.*?\s+from\s+" + _QUOTED, r"import\s+" + _QUOTED, r"(?:const|let|var)\s+\w+\s*=\s*require\s*\(\s*" + _QUOTED + r"\s*\)"],
    "python": [r"from\s+([\w.]+)\s+import", r"import\s+([\w.]+)"],
    "other": [r"from\s+([\w.]+)\s+import", r"import\s+([\w.]+)", r"""require\s*\(\s*["']([^"']+)["']\s*\)""", r"use\s+([\w:]+)", r"""#include\s*["<]([^">]+)[">]"""],
}
# Forms of a function's start, tried in order on each line.
FUNCTIONS = [
    r"func\s+\(\s*\w+\s+\*?\w+\s*\)\s+(\w+)\s*\(", r"func\s+(\w+)\s*\(", r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[\w]+)\s*=>",
    r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(", r"(?:pub\s+)?(?:async\s+)?fn\s+(\w+)\s*[\(<]", r"def\s+([\w.?!]+)", r"(?:(?:public|private|protected|static)\s+)+[\w<>\[\]]+\s+(\w+)\s*\(",
]
# The same by language, for those who ask for it.
FUNCTIONS_OF = {
    "go": FUNCTIONS[:2], "rust": [r"pub\s+(?:async\s+)?fn\s+(\w+)\s*[\(<]", r"(?:async\s+)?fn\s+(\w+)\s*[\(<]"], "java": [r"(?:public|private|protected|static)\s+[\w<>\[\]]+\s+(\w+)\s*\("], "ruby": [r"def\s+([\w.?!]+)"],
    "javascript": [r"function\s+(\w+)\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?\(", r"(?:const|let|var)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|[\w]+)\s*=>"],
    "python": [r"(?:async\s+)?def\s+(\w+)\s*\("],
}
_LINES = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
_STRIP = r"(?U)^\s+|\s+$"


def _opened(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder (local, hdfs, s3, ...) and the folder's path there."""
    plain = re.sub(r"^file:/+", "/", root).rstrip("/")
    return fs.FileSystem.from_uri(plain) if "://" in plain else (fs.LocalFileSystem(), os.path.abspath(plain))


def listing(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified) of all files below a folder, whatever their kind, without those in skipped directories.

    Directories are listed where tasks run, level by level; the driver gets no names. Spark's own readers would leave out empty
    files and those that begin with '_', such as __init__.py.
    """

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                found = system.get_file_info(fs.FileSelector(f"{base}/{folder}" if folder else base))
                kept = [x for x in found if x.type == fs.FileType.File or x.type == fs.FileType.Directory and x.base_name not in (*SKIPPED, CACHE)]
                names, times = [x.path[len(base) :].lstrip("/") for x in kept], pa.array([x.mtime for x in kept], pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), times, pa.array([x.type == fs.FileType.Directory for x in kept], pa.bool_())], names=["path", "modified", "folder"])

    level, found = spark.createDataFrame([("",)], "path string"), None
    while True:
        rows = settled(level.repartition("path").mapInArrow(listed, "path string, modified timestamp, folder boolean"))
        files = rows.filter("not folder").select("path", "modified")
        found = files if found is None else found.unionByName(files)
        level = rows.filter("folder").select("path")
        if level.isEmpty():
            return found


def read(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, modified) of the source files below a folder; their texts are read where they are used."""

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _opened(root)

        def text(path: str) -> str:
            with system.open_input_stream(f"{base}/{path}") as f:
                return f.read().decode("utf-8", "replace")

        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(text, part.column(0).to_pylist()), pa.string()), part.column(1)], names=["path", "source", "modified"])

    wanted = listing(spark, root).filter(paths.suffix(F.col("path")).isin(*languages.GRAPHED))
    return wanted.mapInArrow(texts, "path string, source string, modified timestamp")


def _call_name(node: ast.expr) -> str | None:
    if isinstance(node, ast.Name):
        return node.id
    if isinstance(node, ast.Attribute):
        base = _call_name(node.value)
        return f"{base}.{node.attr}" if base else node.attr
    return None


def python_facts(source: str) -> tuple[list[str], list[tuple[str, int, int]], list[tuple[str, int, int]], list[str]]:
    """(imports, functions, classes, calls) of a Python source; all empty if it can't be parsed."""
    imports: list[str] = []
    functions: list[tuple[str, int, int]] = []
    classes: list[tuple[str, int, int]] = []
    calls: list[str] = []
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return imports, functions, classes, calls
    todo: list[ast.AST] = [tree]
    while todo:  # in order of the source, without recursion
        node = todo.pop()
        if isinstance(node, ast.Import):
            imports += [alias.name for alias in node.names]
        elif isinstance(node, ast.ImportFrom):
            if node.level:
                stem = "." * node.level + (node.module or "")
                imports += [f"{stem}.{alias.name}" if node.module else f"{stem}{alias.name}" for alias in node.names]
            elif node.module:
                imports.append(node.module)
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            functions.append((node.name, node.lineno, node.end_lineno or node.lineno))
        elif isinstance(node, ast.ClassDef):
            classes.append((node.name, node.lineno, node.end_lineno or node.lineno))
        elif isinstance(node, ast.Call) and (name := _call_name(node.func)):
            calls.append(name)
        todo.extend(reversed(list(ast.iter_child_nodes(node))))
    return imports, functions, classes, calls


_SPANS = "array<struct<name:string,start_line:int,end_line:int>>"


def python_sources(files: DataFrame) -> DataFrame:
    """(path, imports, functions, classes, calls) of each row of `files` (path, source), read as Python."""
    span = pa.list_(pa.struct([("name", pa.string()), ("start_line", pa.int32()), ("end_line", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            facts = [python_facts(s or "") for s in batch.column(1).to_pylist()]
            spans = lambda k: pa.array([[dict(zip(("name", "start_line", "end_line"), x)) for x in f[k]] for f in facts], span)
            texts = lambda k: pa.array([f[k] for f in facts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), texts(0), spans(1), spans(2), texts(3)], names=["path", "imports", "functions", "classes", "calls"])

    return files.select("path", "source").mapInArrow(run, f"path string, imports array<string>, functions {_SPANS}, classes {_SPANS}, calls array<string>")


def innermost(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, line, name): the smallest span (path, name, start_line, end_line) around each line (path, line); others are left out."""
    return joins.narrowest_around(lines, spans, "path", "line", "start_line", "end_line", "name")


def touched(lines: DataFrame, spans: DataFrame) -> DataFrame:
    """(path, functions): of each path the names of innermost() for its changed lines (path, line), each once, by first line."""
    named = innermost(lines, spans).groupBy("path", "name").agg(F.min("line").alias("line"))
    return named.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias("functions"))


def preceding(lines: DataFrame, starts: DataFrame) -> DataFrame:
    """(path, line, name): the function (path, name, start_line) that starts last at or before each line."""
    return joins.last_before(lines, starts.withColumnRenamed("start_line", "line"), "path", "line", "name")


def _first_of(line: Column, patterns: list[str], start: bool = False) -> Column:
    found = [F.regexp_extract(line, f"(?U){'^(?:' if start else ''}{p}{')' if start else ''}", 1) for p in patterns]
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in found])


def _go_blocks(lines: Column) -> Column:
    """Quoted paths in import ( ... ) blocks."""
    start = F.struct(F.lit(False).alias("inside"), F.array().cast("array<string>").alias("out"))

    def step(a: Column, line: Column) -> Column:
        opens, path = line == "import (", F.regexp_extract(line, r'^\s*"([^"]+)"', 1)
        inside = F.when(opens, True).when(line == ")", False).otherwise(a["inside"])
        return F.struct(inside.alias("inside"), F.when(a["inside"] & ~opens & (line != ")") & (path != ""), F.concat(a["out"], F.array(path))).otherwise(a["out"]).alias("out"))

    return F.aggregate(lines, start, step, lambda a: a["out"])


def regex_imports(source: Column, language: Column) -> Column:
    """What a source imports by the forms of its language, each once, in order."""
    lines = F.transform(F.split(source, _LINES), lambda x: F.regexp_replace(x, _STRIP, ""))
    code = F.filter(lines, lambda x: (x != "") & (language.isin("c", "cpp") | ~(x.startswith("//") | x.startswith("#"))))
    by = {"go": "go", "rust": "rust", "java": "java", "ruby": "ruby", "c": "c", "cpp": "c", "javascript": "javascript", "typescript": "javascript", "python": "python"}
    found = _each(code, IMPORTS["other"])
    for name, forms in by.items():
        found = F.when(language == name, _each(code, IMPORTS[forms])).otherwise(found)
    blocks = F.when(language == "go", _go_blocks(lines)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(blocks, F.filter(found, lambda x: x.isNotNull())))


def _each(lines: Column, forms: list[str]) -> Column:
    return F.transform(lines, lambda x: _first_of(x, forms))


def regex_functions(files: DataFrame, by_language: bool = False) -> DataFrame:
    """(path, name, start_line, end_line) of functions by form; a function ends on the line on which it starts.

    The forms are those of any language, or of the file's own one where it has some.
    """
    rows = files.select("path", F.posexplode(F.split("source", _LINES)).alias("pos", "text"))
    line, language = F.regexp_replace("text", _STRIP, ""), languages.of_source(F.col("path"))
    name = _first_of(line, FUNCTIONS, start=True)
    for known, forms in FUNCTIONS_OF.items() if by_language else ():
        name = F.when(language.isin("javascript", "typescript") if known == "javascript" else language == known, _first_of(line, forms, start=True)).otherwise(name)
    return rows.select("path", name.alias("name"), (F.col("pos") + 1).alias("start_line"), (F.col("pos") + 1).alias("end_line")).filter("name is not null")


def references(files: DataFrame, name: str) -> DataFrame:
    """Files in which `name` stands as a word, by path."""
    quoted = name.replace("\\E", "\\E\\\\E\\Q")
    return files.filter(F.col("source").rlike(rf"(?U)\b\Q{quoted}\E\b")).select("path").orderBy("path")


def imports(files: DataFrame) -> DataFrame:
    """(path, language, name): what each file imports; Python by its syntax tree, all others by form."""
    tagged = files.select("path", "source", languages.of_source(F.col("path")).alias("language"))
    python = python_sources(tagged.filter("language = 'python'")).select("path", F.lit("python").alias("language"), F.explode(F.array_distinct("imports")).alias("name"))
    others = tagged.filter("language <> 'python'").select("path", "language", F.explode(regex_imports(F.col("source"), F.col("language"))).alias("name"))
    return python.unionByName(others)


def _joined(folder: Column, relative: Column) -> Column:
    """folder/relative with '.' and '..' taken out; null if that leaves the project."""
    split = F.split(F.concat_ws("/", folder, relative), "/")
    start = F.array().cast("array<string>")

    def step(a: Column, p: Column) -> Column:
        up = F.when(F.size(a) > 0, F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))))
        return F.when((p == "") | (p == "."), a).when(p == "..", up).otherwise(F.concat(a, F.array(p)))

    return F.array_join(F.aggregate(split, start, step), "/")


def candidates(names: DataFrame) -> DataFrame:
    """(path, language, name, rank, dst): the files that each import (path, language, name) may mean, the first of them in the project counts."""
    module = F.replace(F.col("name"), F.lit("."), F.lit("/"))
    at = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    python = F.array(at("src/", module, ".py"), at(module, ".py"), at("src/", module, "/__init__.py"), at(module, "/__init__.py"))
    folder = F.array_join(paths.parent_parts(F.col("path")), "/")
    target = F.when(F.col("name").startswith("/"), F.lit(None)).otherwise(_joined(folder, F.col("name")))
    plain = F.regexp_replace(target, r"(?<=[^/])\.[^./]+$", "")
    others = F.array(target, *[F.concat(plain, F.lit(e)) for e in (".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs")], *[F.concat(target, F.lit(f"/index{e}")) for e in (".js", ".jsx", ".ts", ".tsx")])
    found = F.when(F.col("language") == "python", F.when(~F.col("name").startswith("."), python)).when(F.col("name").startswith("."), others)
    return names.select("path", "language", "name", F.posexplode(found).alias("rank", "dst"))


def resolve(names: DataFrame, files: DataFrame) -> DataFrame:
    """(path, language, name, dst) of imports (path, language, name); dst is null where no file of the project is meant."""
    tried = candidates(names).join(files.select(F.col("path").alias("dst")).distinct(), "dst")
    hit = tried.groupBy("path", "language", "name").agg(F.min_by("dst", "rank").alias("dst"))
    return names.select("path", "language", "name").distinct().join(hit, ["path", "language", "name"], "left")


def edges_of(resolved: DataFrame) -> DataFrame:
    """(src, dst) of imports that mean another file, each once."""
    return resolved.filter("path <> dst").select(F.col("path").alias("src"), "dst").distinct()


def edges(files: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(src, dst) of the file graph: imports that resolve to another file of the project, each once."""
    names = imports(files) if found is None else found
    hit = candidates(names).join(files.select(F.col("path").alias("dst")), "dst").groupBy("path", "name").agg(F.min_by("dst", "rank").alias("dst"))
    return edges_of(hit)


def stale(cached: DataFrame, current: DataFrame) -> DataFrame:
    """(path, state) of files (path, mtime) that were added, removed or modified since the cache was written."""
    both = cached.select("path", F.col("mtime").alias("was")).join(current.select("path", F.col("mtime").alias("now")), "path", "full_outer")
    state = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "modified")
    return both.select("path", state.alias("state")).filter("state is not null")
