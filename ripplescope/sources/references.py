"""Which files mention a name: an index of the words of all files, kept as a table, and many names looked up in it at once.

A word is a longest run of letters, digits and '_' of any script, so a name made of such characters stands in a file as a
word just if the index has it there. Null and empty texts have no words.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A word, in the syntax that Java's and RE2's expressions share.
WORD = r"[\p{L}\p{N}_]+"


def index(files: DataFrame, key: str = "path", text: str = "source") -> DataFrame:
    """(key, token, n, first): how often each word stands in each file and, counted in words from 0, where first.

    Rows of one key count together. Words are summed where their text is read, before they are shuffled.
    """
    words = files.select(key, F.posexplode(F.regexp_extract_all(text, F.lit(WORD), F.lit(0))).alias("at", "token"))
    return words.groupBy(key, "token").agg(F.count("*").alias("n"), F.min("at").alias("first"))


def lookup(entries: DataFrame, names: DataFrame, files: DataFrame | None = None, key: str = "path", text: str = "source") -> DataFrame:
    """(name, key) of the files in which each of `names` (name) stands as a word; entries: index().

    A name with other characters ('os.path', 'ready?') is looked for in the texts of `files`, in those alone that hold all of
    its words, bounded by word boundaries at both ends as there; without `files` such names are left out, and so are names
    without any word, which no boundary can hold.
    """
    wanted = names.select("name").filter("name is not null").distinct()
    plain = F.col("name").rlike(f"^{WORD}$")
    found = wanted.filter(plain).join(entries.select(F.col("token").alias("name"), key), "name").select("name", key).distinct()
    if files is None:
        return found
    parts = wanted.filter(~plain).select("name", F.array_distinct(F.regexp_extract_all("name", F.lit(WORD), F.lit(0))).alias("words")).filter(F.size("words") > 0)
    held = parts.select("name", F.size("words").alias("words"), F.explode("words").alias("token")).join(entries.select("token", key).distinct(), "token")
    whole = held.groupBy("name", key).agg(F.count("*").alias("n"), F.max("words").alias("words")).filter("n = words").select("name", key)
    quoted = F.concat(F.lit(r"(?U)\b\Q"), F.replace("name", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E\b"))
    checked = whole.join(files.select(key, text), key).filter(F.regexp_like(F.col(text), quoted))
    return found.unionByName(checked.select("name", key).distinct())
