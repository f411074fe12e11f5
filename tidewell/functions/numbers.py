"""Numbers: rounding half up, shares, and short forms for display."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_up(c: Column) -> Column:
    """Rounds -2.5 to -2; Spark's round gives -3."""
    return F.floor(c + F.lit(0.5))


def one_decimal(c: Column) -> Column:
    """A number with one decimal as text, from whole tenths."""
    tenths = round_half_up(c * 10)
    return F.concat(F.floor(tenths / 10).cast("long").cast("string"), F.lit("."), F.pmod(tenths, F.lit(10)).cast("string"))


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def short_money(c: Column) -> Column:
    """$950, $25K or $1.2M; whole multiples have no decimals."""

    def scaled(unit: int, suffix: str) -> Column:
        body = F.when(c % unit == 0, (c / unit).cast("long").cast("string")).otherwise(one_decimal(c / F.lit(float(unit))))
        return F.concat(F.lit("$"), body, F.lit(suffix))

    return F.when(c >= 1_000_000, scaled(1_000_000, "M")).when(c >= 1_000, scaled(1_000, "K")).when(c.isNotNull(), F.concat(F.lit("$"), thousands(c)))


def file_size(n: Column) -> Column:
    """Empty for none; B, KB or MB."""
    small = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    kb = F.concat(one_decimal(n / 1024.0), F.lit(" KB"))
    mb = F.concat(one_decimal(n / (1024.0 * 1024.0)), F.lit(" MB"))
    return F.when(n.isNull() | (n == 0), "").when(n < 1024, small).when(n < 1024 * 1024, kb).otherwise(mb)


def percent_label(share: Column) -> Column:
    return F.concat(round_half_up(share * 100).cast("long").cast("string"), F.lit("%"))


def share_of_max(value: Column, most: Column) -> Column:
    """Whole percent of the largest value, which counts as 1 at least."""
    return round_half_up(100 * value / F.greatest(F.lit(1).cast("double"), most)).cast("long")


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def ratio(part: Column, whole: Column) -> Column:
    """Null where the whole isn't positive."""
    return F.when(whole > 0, part / whole)


def number(c: Column) -> Column:
    """A double, or null where the text is none."""
    return F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double")
