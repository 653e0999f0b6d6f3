"""Seeded order and stratified samples from hashes, the same on every run and cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffled(key: str, seed: int = 42) -> Column:
    """A digest to sort by: an order that looks like chance and that any SQL engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified(df: DataFrame, strata: list[str], key: str, total: int, seed: int = 42) -> DataFrame:
    """total // strata rows of each stratum, first by a seeded digest.

    The number is known before the rows are ranked, so a task keeps no more than that of a stratum."""
    groups = df.select(*strata).distinct().count()
    w = Window.partitionBy(*strata).orderBy(shuffled(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= total // max(groups, 1)).drop("_r")
