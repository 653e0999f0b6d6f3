"""Change between two scenes, eligibility of an asset for screening, and their fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scores import band, slippy_place
from .peers import mean_std_z

RESOLUTION_M = 10

#: Smallest visible size in metres by word in a category.
VISIBLE_SIZE = {
    "road": 20,
    "building": 15,
    "community_hall": 15,
    "community_centre": 15,
    "dam": 30,
    "pond": 20,
    "playground": 25,
    "gym": 10,
    "laborator": 10,
    "cctv": 1,
    "toilet": 3,
    "bore_well": 2,
    "borewell": 2,
    "tube_well": 2,
    "streetlight": 1,
    "street_light": 1,
    "light": 1,
    "drain_minor": 2,
    "indoor_renovation": 0,
    "hand_pump": 1,
    "furniture": 0,
}

#: Weights of the second fusion.
WEIGHTS = {"cost": 15, "missing": 5, "satellite": 15, "vendor": 10}


def ndvi_mean(red: Column, nir: Column) -> Column:
    each = F.zip_with(red, nir, lambda r, n: F.coalesce(F.try_divide(n - r, n + r), F.lit(0.0)))
    return F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / F.size(red)


def pixel_difference(red0: Column, red1: Column, nir0: Column, nir1: Column) -> Column:
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(y - x)), F.lit(0.0), lambda s, x: s + x)
    return (total(red0, red1) + total(nir0, nir1)) / F.size(red0) / 20000


def change(scenes: DataFrame, ndvi: float = 0.15, pixels: float = 0.25) -> DataFrame:
    """(id, ndvi_before, ndvi_after, pixel_diff, changed) from arrays red0, nir0, red1, nir1."""
    before, after = ndvi_mean(F.col("red0"), F.col("nir0")), ndvi_mean(F.col("red1"), F.col("nir1"))
    m = scenes.select("id", before.alias("b"), after.alias("a"), pixel_difference(*(F.col(c) for c in ("red0", "red1", "nir0", "nir1"))).alias("d"))
    return m.select(
        "id", F.round("b", 4).alias("ndvi_before"), F.round("a", 4).alias("ndvi_after"), F.round("d", 4).alias("pixel_diff"),
        ((F.abs(F.col("a") - F.col("b")) > ndvi) & (F.col("d") > pixels)).alias("changed"),
    )


def visible_size(category: Column) -> Column:
    """By exact name first, then by the longest word the category holds; null if none."""
    text = F.regexp_replace(F.lower(category), "[-_]", " ")
    out = F.lit(None).cast("int")
    for word in sorted(VISIBLE_SIZE, key=len):  # the longest is applied last and so wins
        out = F.when(text.contains(word.replace("_", " ")), VISIBLE_SIZE[word]).otherwise(out)
    exact = F.create_map(*(F.lit(v) for kv in VISIBLE_SIZE.items() for v in kv))
    return F.coalesce(F.try_element_at(exact, F.replace(text, F.lit(" "), F.lit("_"))), out)


def eligibility(df: DataFrame) -> Column:
    """Status from lat, confidence, images, skew (days), cloud (percent) and category: the first gate that fails."""
    size = visible_size(df["category"])
    return (
        F.when(df["lat"].isNull(), "coordinates_missing")
        .when(df["confidence"] < 0.6, "geocode_uncertain")
        .when(~df["images"], "imagery_missing")
        .when(df["skew"] > 365, "imagery_misaligned")
        .when(df["cloud"] > 30, "cloudy")
        .when(size.isNull(), "inconclusive")
        .when(size < RESOLUTION_M, "asset_below_resolution")
        .otherwise("eligible")
    )


def fuse(works: DataFrame, flag_z: float = 2.5) -> DataFrame:
    """(id, risk, band) from id, category, amount, missing, changed (null: not screened), vendor."""
    z = mean_std_z(works, "amount", "category")
    cost = (F.abs("z") > flag_z).cast("double")
    parts = [
        (WEIGHTS["cost"], cost),
        (WEIGHTS["missing"], F.col("missing").cast("double")),
        (WEIGHTS["satellite"], (~F.col("changed")).cast("double")),
        (WEIGHTS["vendor"], F.col("vendor")),
    ]
    total = sum((F.coalesce(w * x, F.lit(0.0)) for w, x in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), w).otherwise(0) for w, x in parts), F.lit(0))
    r = z.select("id", F.round(F.coalesce(F.try_divide(100 * total, weight), F.lit(0.0)), 2).alias("risk"))
    return r.select("id", "risk", band(F.col("risk")).alias("band"))


def mosaic(windows: DataFrame, tiles: DataFrame, zoom: int, grid: int, side: int, crop: int) -> DataFrame:
    """(id, missing, pixels): for each window (id, lat, lon) a square of ``crop`` pixels around its place, row by row.

    tiles: (x, y, pixels) with ``side`` x ``side`` values row by row. A window asks for grid x grid tiles around its own by their
    numbers; those that are not there are 0 and counted. Each tile hands on only the rows and columns that lie in the square, so a
    window gathers its own pixels and no more. pixels is null where no tile is there; the square must fit the grid."""
    half = grid // 2
    place = slippy_place(F.col("lat"), F.col("lon"), zoom)
    at = windows.select("id", place.alias("p")).select("id", F.floor("p.x").cast("long").alias("tx"), F.floor("p.y").cast("long").alias("ty"), "p")
    left = F.floor((half + F.col("p.x") - F.col("tx")) * side - crop / 2).cast("int")
    top = F.floor((half + F.col("p.y") - F.col("ty")) * side - crop / 2).cast("int")
    at = at.select("id", "tx", "ty", left.alias("left"), top.alias("top"))
    steps = F.sequence(F.lit(0), F.lit(grid - 1))
    asked = at.withColumn("dx", F.explode(steps)).withColumn("dy", F.explode(steps))
    asked = asked.withColumns({"x": F.col("tx") + F.col("dx") - half, "y": F.col("ty") + F.col("dy") - half})
    met = asked.join(tiles.select("x", "y", "pixels"), ["x", "y"], "left")
    # The rows and columns of the square that this tile covers: begin and end in the square, and where the tile has them.
    row0, col0 = F.col("dy") * side - F.col("top"), F.col("dx") * side - F.col("left")
    rows = F.sequence(F.greatest(F.lit(0), row0), F.least(F.lit(crop), row0 + side) - 1)
    begin, end = F.greatest(F.lit(0), col0), F.least(F.lit(crop), col0 + side)
    covers = (row0 < crop) & (row0 + side > 0) & (end > begin) & F.col("pixels").isNotNull()
    strips = F.transform(rows, lambda r: F.struct(r.alias("row"), begin.alias("column"), F.slice(F.col("pixels"), (r - row0) * side + (begin - col0) + 1, end - begin).alias("values")))
    none = F.array().cast("array<struct<row:int,column:int,values:array<int>>>")
    part = met.select("id", F.col("pixels").isNull().cast("int").alias("gone"), F.when(covers, strips.cast("array<struct<row:int,column:int,values:array<int>>>")).otherwise(none).alias("strips"))
    whole = part.groupBy("id").agg(F.sum("gone").cast("int").alias("missing"), F.flatten(F.collect_list("strips")).alias("strips"))
    lines = F.array_sort("strips")  # by row, then column; absent tiles leave gaps

    def line(r: Column) -> Column:
        mine = F.filter(F.col("lines"), lambda s: s.row == r)
        padded = F.aggregate(mine, F.array().cast("array<int>"), lambda a, s: F.concat(a, F.array_repeat(F.lit(0), s.column - F.size(a)), s["values"]))
        return F.concat(padded, F.array_repeat(F.lit(0), crop - F.size(padded)))

    square = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(crop - 1)), line))
    return whole.withColumn("lines", lines).select("id", "missing", F.when(F.col("missing") < grid * grid, square).alias("pixels"))
