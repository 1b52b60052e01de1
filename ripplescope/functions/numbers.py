"""Numbers as text with a fixed number of digits, rounded by their exact binary value, ties to even."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNIT = 1 << 60


def fixed(x: Column, digits: int = 2) -> Column:
    """x, from 0 up to 7, with `digits` (1 to 4) decimal places."""
    scaled = (x * float(_UNIT)).cast("long").cast("decimal(20,0)") * F.lit(10**digits).cast("decimal(6,0)")
    unit = F.lit(_UNIT).cast("decimal(20,0)")
    whole, rest = F.call_function("div", scaled, unit), scaled % unit
    up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
    whole = whole + F.when(up, 1).otherwise(0)
    left = F.call_function("div", whole, F.lit(10**digits)).cast("string")
    return F.concat(left, F.lit("."), F.lpad((whole % 10**digits).cast("string"), digits, "0"))


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def shortest(x: Column) -> Column:
    """x, from 0 up to 10**10, as the shortest decimal text that reads back the same, without an exponent.

    Java before 19 writes some numbers with a digit too many; those of over 15 decimal places are held against shorter ones.
    """
    java, exact = x.cast("string"), x.cast("decimal(38,26)")
    found = exact
    for places in range(22, 13, -1):
        cut = F.round(exact, places).cast("decimal(38,26)")
        found = F.when(cut.cast("double") == x, cut).otherwise(found)
    plain = F.regexp_replace(found.cast("string"), r"(\.\d+?)0+$", "$1")
    return F.when((F.length(java) <= 17) & ~F.contains(java, F.lit("E")), java).otherwise(plain)
