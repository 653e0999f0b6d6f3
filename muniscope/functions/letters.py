"""Letter numbers and fiscal years (1 April to 31 March)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: how a letter number is written.
LETTER = r"^LN/MP(\d+)/(\d{4})-(\d{4})/(\d+)$"


def parse_letter(raw: Column) -> Column:
    """struct(mp_code, fy_start_year, fy_end_year, letter_seq); all null unless the whole text fits."""
    text = F.regexp_replace(raw, r"\s+", "")

    def part(i: int) -> Column:
        return F.regexp_extract(text, LETTER, i).try_cast("int")

    return F.struct(
        part(1).alias("mp_code"), part(2).alias("fy_start_year"), part(3).alias("fy_end_year"), part(4).alias("letter_seq")
    )


def fiscal_year(day: Column) -> Column:
    """The year in which the fiscal year of a date starts."""
    return F.year(day) - F.when(F.month(day) < 4, 1).otherwise(0)


def fiscal_bounds(start_year: Column) -> Column:
    return F.struct(F.make_date(start_year, F.lit(4), F.lit(1)).alias("first"), F.make_date(start_year + 1, F.lit(3), F.lit(31)).alias("last"))


def fiscal_close(day: Column) -> Column:
    """31 March that closes the fiscal year of a date."""
    return F.make_date(fiscal_year(day) + 1, F.lit(3), F.lit(31))


def days_to_close(day: Column) -> Column:
    return F.datediff(fiscal_close(day), day)
