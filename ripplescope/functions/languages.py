"""Languages by file extension: the narrow map for changes, the wide one for source files."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplescope.functions import paths

# Languages by extension, of changes and of more source files.
CHANGED = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".go": "go", ".rs": "rust",
    ".java": "java", ".rb": "ruby", ".c": "c", ".h": "c", ".cpp": "cpp", ".hpp": "cpp",
}
WIDER = {
    ".pyw": "python", ".mjs": "javascript", ".cjs": "javascript", ".cc": "cpp", ".cs": "csharp", ".php": "php", ".swift": "swift",
    ".kt": "kotlin", ".scala": "scala",
}
GRAPHED = (".py", ".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs", ".go", ".rs", ".java", ".rb", ".c", ".cpp", ".cc", ".h", ".hpp")


def _lookup(path: Column, known: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*map(F.lit, chain.from_iterable(known.items()))), paths.suffix(path))


def of_change(path: Column) -> Column:
    return F.coalesce(_lookup(path, CHANGED), F.lit("unknown"))


def of_source(path: Column, unknown: str = "unknown") -> Column:
    return F.coalesce(_lookup(path, CHANGED | WIDER), F.lit(unknown))


def frequency(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(language, n), most frequent first, then by name; unknown ones left out."""
    counted = files.select(of_source(F.col(path_col)).alias("language")).filter("language <> 'unknown'").groupBy("language").agg(F.count("*").alias("n"))
    return counted.orderBy(F.desc("n"), "language")
