"""Small scoring expressions shared by the signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the eight signals, 100 together.
WEIGHTS = {
    "cost_peer": 15,
    "missing_evidence": 5,
    "anomaly": 15,
    "photo_identical": 25,
    "photo_similar": 10,
    "text_exact": 20,
    "text_similar": 5,
    "entitlement_pace": 5,
}
MEDIUM, STRONG = 0.34, 0.67


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def strength(score: Column, fired: Column) -> Column:
    # The labels.
    return F.when(fired, F.when(score >= STRONG, "strong").when(score >= MEDIUM, "medium").otherwise("weak"))


def importance(code: str, raw: Column) -> Column:
    return raw * F.lit(WEIGHTS[code] / max(WEIGHTS.values()))


def cost_score(z: Column) -> Column:
    return clamp(z / 6.0)


def excess_ratio(x: Column, threshold: Column) -> Column:
    return clamp((x - threshold) / F.greatest(threshold, F.lit(1.0)))


def band(risk: Column, critical: Column | None = None) -> Column:
    top = risk > 80 if critical is None else critical | (risk > 80)
    return F.when(top, "Critical").when(risk > 60, "High").when(risk > 30, "Moderate").otherwise("Low")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def distance_bucket(d: Column) -> Column:
    return F.when(d.isNull(), "unknown").when(d == 0, "0").when(d <= 3, "1-3").otherwise("4-6")


def area_bucket(a: Column) -> Column:
    return F.when(a.isNull(), "unknown").when(a < 0.05, "<0.05").when(a <= 0.2, "0.05-0.2").otherwise(">0.2")


def watermark_rows(height: Column) -> Column:
    """Height of the band at the top and the bottom where stamps are."""
    return F.greatest(F.lit(1), F.round(height * 0.10).cast("int"))


def slippy_place(lat: Column, lon: Column, zoom: int) -> Column:
    """struct(x, y): a web map's tile numbers with the place inside the tile as their fraction."""
    n = float(1 << zoom)
    rad = F.radians(lat)
    x = (lon + 180.0) / 360.0 * n
    y = (1.0 - F.ln(F.tan(rad) + 1.0 / F.cos(rad)) / F.pi()) / 2.0 * n
    return F.struct(x.alias("x"), y.alias("y"))


def slippy_tile(lat: Column, lon: Column, zoom: int) -> Column:
    """struct(x, y): tile numbers of a web map."""
    place = slippy_place(lat, lon, zoom)
    return F.struct(F.floor(place.x).cast("long").alias("x"), F.floor(place.y).cast("long").alias("y"))
