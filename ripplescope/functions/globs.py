"""Shell patterns as regular expressions, and the three ways in which paths are held against them."""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ripplescope.functions import paths


def to_regex(pattern: str) -> str:
    """A Java expression for a whole match of a shell pattern; '*' also crosses '/'."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[":
            close = pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))
            if close < 0:
                out.append(r"\[")
                continue
            out.append(_set(pattern[i:close]))
            i = close + 1
        else:
            out.append(re.escape(c) if not c.isalnum() and c not in "_/" else c)
    return f"(?s)^{''.join(out)}\\z"


def _set(body: str) -> str:
    """A set of characters; ranges that run backwards hold none."""
    quoted = lambda c: c if c.isalnum() else "\\" + c
    none, out, k = body.startswith("!"), [], 0
    chars = body[none:]
    while k < len(chars):
        if chars[k + 1 : k + 2] == "-" and k + 2 < len(chars):
            out.append(f"{quoted(chars[k])}-{quoted(chars[k + 2])}" * (chars[k] <= chars[k + 2]))
            k += 3
        else:
            out.append(quoted(chars[k]))
            k += 1
    if not any(out):
        return "." if none else "(?!)"
    return f"[{'^' * none}{''.join(out)}]"


def user_regex(pattern: str) -> str:
    """The expression of user_ignored() for one pattern."""
    return f"(?s)^{re.escape(pattern.rstrip('/'))}" if pattern.endswith("/") else to_regex(pattern)


def matches(text: Column, pattern: str) -> Column:
    return text.rlike(to_regex(pattern))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def user_ignored(path: Column, patterns: list[str]) -> Column:
    """'dir/' stands for anything that starts with it, slash or not; else the whole path must match. '!' means nothing."""
    return any_of([path.startswith(p) | path.startswith(p.rstrip("/")) if p.endswith("/") else matches(path, p) for p in patterns])


def at_any_depth(path: Column, pattern: str) -> Column:
    """'dir/' at any depth; else the whole path or the name must match."""
    if pattern.endswith("/"):
        return path.startswith(pattern) | F.contains(F.concat(F.lit("/"), path), F.lit(f"/{pattern}"))
    return matches(path, pattern) | matches(paths.name(path), pattern)


def named_like(path: Column, patterns: list[str]) -> Column:
    """Whether the name matches one of the patterns."""
    return any_of([matches(paths.name(path), p) for p in patterns])
