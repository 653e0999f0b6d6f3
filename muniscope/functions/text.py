"""Text normalisation, keys, jurisdictions and stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .amounts import strip_space

#: Renamed jurisdictions.
ALIASES = {
    "ORISSA": "ODISHA",
    "PONDICHERRY": "PUDUCHERRY",
    "UTTARANCHAL": "UTTARAKHAND",
    "NCT OF DELHI": "DELHI",
    "NATIONAL CAPITAL TERRITORY OF DELHI": "DELHI",
}


def blank(x: Column) -> Column:
    return x.isNull() | (strip_space(x.cast("string")) == "")


def upper_norm(x: Column) -> Column:
    return F.upper(strip_space(x))


#: Fixed value: the letter number that activities begin with.
ACTIVITY_PREFIX = r"^WS/MP\d+/\d{4}-\d{4}/\d+-"


def activity_norm(x: Column) -> Column:
    """Without a leading letter number."""
    return strip_space(F.regexp_replace(x, ACTIVITY_PREFIX, ""))


def description_norm(x: Column) -> Column:
    return F.regexp_replace(F.lower(strip_space(x)), r"\s+", " ")


def jurisdiction(x: Column) -> Column:
    """Comparable name of a place, null for blank ones. Lower case stands for case folding."""
    name = strip_space(x)
    known = F.create_map(*(F.lit(v) for kv in ALIASES.items() for v in kv))
    return F.when(~blank(x), F.lower(F.coalesce(F.try_element_at(known, F.upper(name)), name)))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws(" | ", *(F.coalesce(p.cast("string"), F.lit("nan")) for p in parts))


def work_key(work_id: Column, record_id: Column) -> Column:
    return F.coalesce(F.when(~blank(work_id), work_id.cast("string")), F.concat(F.lit("record:"), record_id.cast("string")))


def unit_joined(*parts: Column) -> Column:
    """Parts joined by the unit separator; nulls count as empty."""
    return F.array_join(F.array(*(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), "\x1f")


def alert_id(work: Column, code: Column, field: Column, raw: Column) -> Column:
    state = F.substring(F.sha1(F.coalesce(raw.cast("string"), F.lit(""))), 1, 8)
    return F.substring(F.sha1(unit_joined(work, code, field, state)), 1, 16)


def match_id(a: Column, b: Column, *versions: str) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.substring(F.sha1(unit_joined(F.least(a, b), F.greatest(a, b), *(F.lit(v) for v in versions))), 1, 16)


def case_id(work: Column, clusters: Column, state: Column, version: str) -> Column:
    return F.substring(F.sha1(unit_joined(work, F.array_join(F.array_sort(clusters), ","), state, F.lit(version))), 1, 16)


def rupees(x: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(x, 0))


def exactly(column: str, allowed: list[str]) -> Column:
    """The raw value is one of those allowed, without any normalisation; null is none."""
    return F.coalesce(F.col(column).isin(allowed), F.lit(False))


def holds(column: str, pattern: str, regex: bool = False) -> Column:
    """The value has the pattern in it, whatever the case of either; null has none. A plain pattern stands for itself."""
    found = F.col(column).rlike(f"(?iu){pattern}") if regex else F.contains(F.lower(column), F.lower(F.lit(pattern)))
    return F.coalesce(found, F.lit(False))
