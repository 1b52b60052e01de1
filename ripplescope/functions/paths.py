"""POSIX path parts as Column expressions; all but normal() take paths in normal form."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal(path: Column) -> Column:
    """Without doubled slashes, './' parts and a closing slash; the empty path is '.'."""
    plain = F.regexp_replace(F.regexp_replace(path, r"/(?:\.?/)+", "/"), r"(?<=.)/\.?$", "")
    plain = F.regexp_replace(plain, r"^(?:\./)+", "")
    return F.when(plain == "", ".").otherwise(plain)


def name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """The name up to its last dot, unless that begins or ends the name."""
    return F.regexp_replace(name(path), r"^(.+)\.[^.]+$", "$1")


def suffix(path: Column) -> Column:
    """The name's last dot and what follows, lower-cased; empty where stem() cuts nothing."""
    return F.lower(F.regexp_extract(name(path), r"^.+(\.[^.]+)$", 1))


def parts(path: Column) -> Column:
    return F.split(path, "/")


def parent_parts(path: Column) -> Column:
    split = parts(path)
    return F.slice(split, 1, F.size(split) - 1)


def parent(path: Column) -> Column:
    """The directory; '.' for a file at the root."""
    joined = F.array_join(parent_parts(path), "/")
    return F.when(joined == "", ".").otherwise(joined)


def part_stems(path: Column) -> Column:
    """Distinct lower-cased stems of all parts."""
    return F.array_distinct(F.transform(parts(path), lambda p: F.lower(F.regexp_replace(p, r"^(.+)\.[^.]+$", "$1"))))


def module(path: Column) -> Column:
    """The path as a dotted module name, without the last part's suffix."""
    return F.array_join(F.concat(parent_parts(path), F.array(stem(path))), ".")


def plural(count: Column, singular: str, many: str | None = None) -> Column:
    return F.when(count == 1, singular).otherwise(many or f"{singular}s")


def shortened(path: Column, width: int = 60) -> Column:
    """At most `width` characters, the front giving way to '...'."""
    return F.when(F.length(path) <= width, path).otherwise(F.concat(F.lit("..."), F.right(path, F.lit(width - 3))))
