"""Exact normalisation of Indian currency text, as one struct-valued column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unit words and what they multiply by.
UNITS = {
    "thousand": 1_000,
    "k": 1_000,
    "lakhs": 100_000,
    "lakh": 100_000,
    "lacs": 100_000,
    "lac": 100_000,
    "l": 100_000,
    "crores": 10_000_000,
    "crore": 10_000_000,
    "cr": 10_000_000,
}
#: How rupees are marked.
CURRENCY = ("₹", "rs", "inr", "re")
DECIMAL = "decimal(38,6)"


def strip_space(x: Column) -> Column:
    """Trim all white space, not blanks alone."""
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _pieces(text: Column) -> Column:
    """The text cut where letters, digits, white space and other signs meet; every sign stands alone."""
    return F.regexp_extract_all(text, F.lit(r"[a-z]+|[0-9]+|\s+|[^a-z0-9\s]"), F.lit(0))


def _numerals(pieces: Column) -> Column:
    """What is written in digits, signs, commas and points without a break; a point after a currency word belongs to the word."""

    def mark(x: Column, i: Column) -> Column:
        after_currency = (i > 0) & F.get(pieces, F.greatest(i - 1, F.lit(0))).isin(*CURRENCY)
        inside = x.rlike("^[0-9]+$") | x.isin("+", "-", ",") | ((x == ".") & ~after_currency)
        return F.when(inside, x).otherwise(F.lit(" "))

    chunks = F.split(F.array_join(F.transform(pieces, mark), ""), " +")
    return F.filter(chunks, lambda c: c.rlike("[0-9]"))


def _number(written: Column) -> Column:
    """The value of one numeral, null unless its commas make Indian groups: the last of three digits, the others
    of two, the first of one or two."""
    sign = F.when(written.startswith("-"), "-").otherwise("")
    halves = F.split(F.when(written.startswith("-") | written.startswith("+"), F.substring(written, 2, 1 << 20)).otherwise(written), "[.]")
    whole, part = F.get(halves, F.lit(0)), F.coalesce(F.get(halves, F.lit(1)), F.lit(""))

    def of_groups(groups: Column) -> Column:
        n = F.size(groups)
        place = F.transform(groups, lambda g, i: F.when(i == n - 1, F.length(g) == 3).when(i == 0, F.length(g).between(1, 2)).otherwise(F.length(g) == 2))
        indian = (n == 1) | F.forall(place, lambda good: good)
        digits = F.forall(groups, lambda g: g.rlike("^[0-9]+$"))
        fraction = (F.size(halves) == 1) | ((F.size(halves) == 2) & ((part == "") | part.rlike("^[0-9]+$")))
        return F.when(indian & digits & fraction, F.concat(sign, F.array_join(groups, ""), F.lit("."), part, F.lit("0")).try_cast(DECIMAL))

    return _let(F.split(whole, ","), of_groups)


def normalise_amount(raw: Column) -> Column:
    """struct(status, parsed_value, unit, amount): status is ok, missing, unparseable or ambiguous_unit.

    One number must stand in the text besides units; its commas must group as in Indian usage; a
    value with two different unit words has no amount."""
    text = F.lower(strip_space(raw))
    missing = raw.isNull() | text.isin("", "nan", "none", "na", "<na>")
    times = F.create_map(*(F.lit(v) for kv in UNITS.items() for v in kv))

    def judge(read: Column) -> Column:
        units, value = read.units, read.value
        status = F.when(missing, "missing").when(value.isNull(), "unparseable").when(F.size(units) > 1, "ambiguous_unit").otherwise("ok")
        factor = F.coalesce(F.try_element_at(times, F.get(units, F.lit(0))), F.lit(1)).cast(DECIMAL)
        return F.struct(
            status.alias("status"),
            F.when(~missing, value).alias("parsed_value"),
            F.when(~missing & value.isNotNull() & (F.size(units) > 0), F.array_join(units, ",")).alias("unit"),
            F.when(status == "ok", (value * factor).cast(DECIMAL)).alias("amount"),
        )

    def read(pieces: Column) -> Column:
        units = F.array_sort(F.array_distinct(F.filter(pieces, lambda x: x.isin(*UNITS))))
        value = _let(_numerals(pieces), lambda found: F.when(F.size(found) == 1, _number(F.get(found, F.lit(0)))))
        return F.struct(units.alias("units"), value.alias("value"))

    return _let(_let(_pieces(text), read), judge)
