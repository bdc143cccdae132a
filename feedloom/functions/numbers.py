"""Numbers in JSON text: the shortest digits that read back, plain between 1e-6 and 1e21, with an exponent without leading zeros beyond."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def number_text(x: float) -> str:
    """A finite number as JSON."""
    if x == 0:
        return "0"
    if 1e-6 <= abs(x) < 1e21:
        t = format(Decimal(repr(x)), "f")
        return t.rstrip("0").rstrip(".") if "." in t else t
    m, _, e = repr(x).partition("e")
    return f"{m}e{e[0]}{e[1:].lstrip('0')}"


def number_column(x: Column) -> Column:
    """The same for a double column; null, NaN and infinity give null.  From 2**53 on, digits beyond the 17th may differ: the JVM's are not always the shortest."""
    size = F.abs(x)
    exact = x.try_cast("bigint").cast("string")
    # The two scales have no common type, so each is written before they meet.
    plain = F.when(size >= 1, x.try_cast("decimal(38,17)").cast("string")).otherwise(x.try_cast("decimal(38,30)").cast("string"))
    java = F.split(x.cast("string"), "E")
    power = java[1]
    short = F.concat(F.regexp_replace(java[0], r"\.0$", ""), F.lit("e"), F.when(power.startswith("-"), power).otherwise(F.concat(F.lit("+"), power)))
    fits = (size >= 1e-6) & (size < 1e21)
    whole = (size < 2.0**53) & (x % 1 == 0)
    return F.when(x.isNull() | F.isnan(x) | (size == float("inf")), None).when(x == 0, "0").when(whole, exact).when(fits, F.regexp_replace(F.regexp_replace(plain, r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")).otherwise(short)
