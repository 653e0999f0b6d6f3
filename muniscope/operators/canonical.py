"""One canonical row per work from the two record families, with its validation issues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import work_key


def outer_merge(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Full outer join; where both have a column, the first's value wins unless it is null.

    has_first and has_second say where a row comes from."""
    both = [c for c in first.columns if c in second.columns and c != key]
    a = first.select(key, *(F.col(c).alias(f"a_{c}") for c in first.columns if c != key), F.lit(True).alias("_a"))
    b = second.select(key, *(F.col(c).alias(f"b_{c}") for c in second.columns if c != key), F.lit(True).alias("_b"))
    out = a.join(b, key, "full_outer")
    columns = [F.coalesce(f"a_{c}", f"b_{c}").alias(c) for c in both]
    columns += [F.col(f"a_{c}").alias(c) for c in first.columns if c not in (*both, key)]
    columns += [F.col(f"b_{c}").alias(c) for c in second.columns if c not in (*both, key)]
    return out.select(key, *columns, F.col("_a").isNotNull().alias("has_first"), F.col("_b").isNotNull().alias("has_second"))


def issue_list(rules: dict[str, Column]) -> Column:
    """Sorted array of the names of the rules that hold."""
    return F.array_sort(F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items()))))


def require_unique(df: DataFrame, key: str) -> DataFrame:
    """df, or an error when a key is null or stands on two rows."""
    bad = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(1)
    if bad.count():
        raise ValueError(f"{key} is missing or repeated: {bad.first()}")
    return df


def lineage(df: DataFrame, fields: dict[str, tuple[str, str, str]], source: str, version: str) -> DataFrame:
    """Long table (work, source, raw_field, raw_value, transformation, normalised_value, version).

    fields: name -> (raw column, normalised column, transformation)."""
    entries = [
        F.struct(
            F.lit(source).alias("source"),
            F.lit(name).alias("raw_field"),
            F.col(raw).cast("string").alias("raw_value"),
            F.lit(how).alias("transformation"),
            F.col(normalised).cast("string").alias("normalised_value"),
            F.lit(version).alias("version"),
        )
        for name, (raw, normalised, how) in fields.items()
    ]
    work = work_key(F.col("work_id"), F.col("record_id")).alias("work")
    return df.select(work, F.explode(F.array(*entries)).alias("e")).select("work", "e.*")
