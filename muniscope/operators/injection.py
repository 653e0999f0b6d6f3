"""Synthetic irregularities put into real rows, with the truth beside them.

Every pattern takes works (id, mp, agency, activity, amount, sanction_date, end_date, image_count,
description, and with pictures md5 and phash) and returns changed or added rows with a pattern column. Rows are chosen by a
seeded hash, so a run repeats on any cluster. ``detect`` finds each pattern with the library's own rules."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import images
from ..session import ship_package
from . import peers, profile, similarity, vendors
from .graph import shared_table
from .sampling import shuffled

#: How far, in bits of its hash, an edited picture may be from the one it was made of.
NEAR = 6


#: The grain that all scenes have, and how many are drawn at once: as many as a core's cache holds.
_GRAIN = np.random.default_rng(0).normal(0, 3, (96, 96)).astype(np.float32)
TOGETHER = 16


def scenes(names: list[str]) -> np.ndarray:
    """Grey pictures of 96 x 96, each decided by its name: 64 squares by a digest of the name, under a grain."""
    digests = b"".join(hashlib.sha512(n.encode()).digest() for n in names)
    squares = 20 + np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8, 8).astype(np.float32) * np.float32(215 / 256)
    return np.clip(np.floor(squares).repeat(12, axis=2).repeat(12, axis=1) + _GRAIN, 0, 255).astype(np.uint8)


def scene(name: str) -> np.ndarray:
    """A grey picture of 96 x 96 that its name decides."""
    return scenes([name])[0]


def edited(pixels: np.ndarray, seed: int, most: int = NEAR) -> np.ndarray:
    """The picture cropped, brighter or darker and with more or less contrast, the stronger the nearer its hash is to
    ``most`` bits away: never further, and another picture all the same."""
    rng = np.random.default_rng(seed)
    contrast, light, (top, left) = rng.uniform(0.9, 1.1), rng.uniform(-12, 12), rng.integers(1, 5, 2)
    was = images.perceptual_hash(pixels)
    for part in (1.0, 0.75, 0.5, 0.25, 0.0):
        a, b = round(top * part), round(left * part)
        cut = pixels[a : len(pixels) - a, b : pixels.shape[1] - b].astype(float)
        made = np.clip(np.rint((cut - 128) * (1 + (contrast - 1) * part) + 128 + light * part), 0, 255)
        if (images.perceptual_hash(made) ^ was).bit_count() <= most:
            return made if part else np.clip(pixels.astype(int) + 1, 0, 255)
    raise AssertionError


@F.pandas_udf(T.LongType())
def picture_hash(name: pd.Series, edit: pd.Series) -> pd.Series:
    """The hash of a work's picture; where ``edit`` is a number, of an edited copy."""
    out = np.zeros(len(name), dtype=np.int64)
    for at in range(0, len(name), TOGETHER):
        out[at : at + TOGETHER] = images.perceptual_hashes(scenes(name.iloc[at : at + TOGETHER].tolist()))
    for at in np.flatnonzero(edit.notna()):
        out[at] = images.perceptual_hash(edited(scene(name.iloc[at]), int(edit.iloc[at])))
    return pd.Series(out)


def with_pictures(works: DataFrame) -> DataFrame:
    """works with the digest and the hash of a picture that their id decides."""
    ship_package(works.sparkSession)
    name = F.col("id").cast("string")
    return works.withColumns({"md5": F.md5(name.cast("binary")), "phash": picture_hash(name, F.lit(None).cast("long"))})


#: Words that tell the kind of an implementing agency; the longest one that is there decides.
AGENCY_WORDS = {
    "district collector": "government", "district magistrate": "government", "municipal corporation": "government", "municipal council": "government",
    "nagar palika": "government", "zilla parishad": "government", "zila panchayat": "government", "public works department": "government",
    "charitable trust": "trust", "trust": "trust", "cooperative society": "society", "co-operative society": "society", "society": "society",
    "sewa samiti": "society", "foundation": "trust", "private limited": "company", "pvt": "company", "ltd": "company",
}


def agency_kind(name: Column) -> Column:
    """government, trust, society, company or unknown, by the longest known word in the name."""
    text = F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(name.cast("string"), F.lit(""))), "[^a-z-]+", " "), F.lit(" "))
    out = F.lit("unknown")
    for word in sorted(AGENCY_WORDS, key=lambda w: (len(w), w)):
        out = F.when(text.contains(f" {word} "), AGENCY_WORDS[word]).otherwise(out)
    return out


def _pick(works: DataFrame, n: int, name: str) -> DataFrame:
    return works.orderBy(shuffled("id", sum(name.encode())), "id").limit(n).withColumn("pattern", F.lit(name))


def _copies(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("id", F.concat_ws("-", "id", "pattern", "_k"))


PATTERNS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "structuring": lambda r: _copies(r, 3).withColumn("amount", F.lit(990_000.0) - F.col("_k") * 1000).drop("_k"),
    "missing_images": lambda r: r.withColumn("image_count", F.lit(0)),
    "cost_outlier": lambda r: r.withColumn("amount", F.col("amount") * 12),
    "short_gap": lambda r: r.withColumn("end_date", F.date_add("sanction_date", 1)),
    "fy_end_dumping": lambda r: r.withColumn("end_date", F.make_date(F.year("sanction_date") + 1, F.lit(3), F.lit(30))),
    "cross_year_duplicate": lambda r: _copies(r, 1).withColumn("sanction_date", F.add_months("sanction_date", 12)).drop("_k"),
    "nonstandard_agency": lambda r: r.withColumn("agency", F.when(F.xxhash64("id") % 2 == 0, "Jan Kalyan Cooperative Society Ltd.").otherwise("Sri Seva Charitable Trust")),
    "broken_sequencing": lambda r: r.withColumn("end_date", F.date_sub("sanction_date", 30)),
    "benford_violation": lambda r: r.withColumn("amount", F.lit(900_000.0) + F.pmod(F.xxhash64("id"), F.lit(99_999))).withColumn("agency", F.lit("Municipal Council of Even Sums")),
    "split_purchase": lambda r: _copies(r, 4).withColumn("amount", F.col("amount") / 4).drop("_k"),
    "exact_image_duplicate": lambda r: _copies(r, 1).drop("_k"),
    "near_duplicate_image": lambda r: _edited(_copies(r.withColumn("_source", F.col("id")), 1).drop("_k")),
    "category_mismatch": lambda r: r.withColumn("activity", F.lit("Repair and Renovation")),
}


def _edited(rows: DataFrame) -> DataFrame:
    """Rows whose picture is an edited copy of the one of ``_source``, where works have pictures."""
    if "phash" in rows.columns:
        ship_package(rows.sparkSession)
        edit = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
        rows = rows.withColumns({"md5": F.md5(F.col("id").cast("binary")), "phash": picture_hash(F.col("_source"), edit)})
    return rows.drop("_source")


def detect(works: DataFrame, name: str, of: DataFrame | None = None) -> DataFrame:
    """(id) of the works in which a pattern is seen: injected ones and others alike.

    of: some rows of works, if the question is about these only; they are held against all works, and what is seen in
    others may be left out."""
    gap = F.datediff("end_date", "sanction_date")
    place = {"vendor": F.col("agency"), "day": F.col("sanction_date")}
    if name == "structuring":
        low, high = 900_000.0, 1_000_000.0
        found = vendors.split_invoicing(works.withColumns(place), high, 1 - low / high, 31).select(F.col("vendor").alias("agency"), "mp").distinct()
        return works.where((F.col("amount") >= low) & (F.col("amount") < high)).join(found, ["agency", "mp"], "left_semi").select("id")
    if name == "cost_outlier":
        return peers.ladder_z(works, "amount", "activity", "place").where(F.col("z") > peers.FLAG_Z).select("id")
    if name == "cross_year_duplicate":
        rows = works.select("id", "mp", "description", F.year("sanction_date").alias("year"))
        return similarity.cross_links(rows, ["mp", "description"], "id", "year").select(F.col("a").alias("id"))
    if name == "nonstandard_agency":
        return works.where(agency_kind(F.col("agency")) != "government").select("id")
    if name == "benford_violation":
        odd = profile.first_digits(works, "amount", "agency", least=10).where(F.col("chi_square") > BENFORD).select("agency")
        return works.join(odd, "agency", "left_semi").select("id")
    if name == "split_purchase":
        key = ["mp", "agency", "activity", "sanction_date", "amount"]
        many = works.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").drop("_n")
        return works.join(many, key, "left_semi").select("id")
    if name == "exact_image_duplicate":
        return similarity.members_of(works, ["md5"], "id", "mp", "id").select("id")
    if name == "near_duplicate_image":
        if of is not None:
            asked = shared_table(of.select("id", "phash"), "asked")  # its size is then known before all works would move
            return similarity.with_neighbour(asked, works.select("id", "phash"), "id", "phash", NEAR)
        near = similarity.hash_pairs(works.select("id", "phash"), "id", "phash", NEAR)
        return near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    plain = {
        "missing_images": F.col("image_count") == 0,
        "short_gap": gap.between(0, 7),
        "fy_end_dumping": (F.month("end_date") == 3) & (F.dayofmonth("end_date") >= 25),
        "broken_sequencing": gap < 0,
        "category_mismatch": ~F.col("description").contains(F.col("activity")),
    }
    return works.where(plain[name]).select("id")


#: The 5 percent point of chi square with eight degrees of freedom.
BENFORD = 15.507


def recall_by_detector(works: DataFrame, n: int = 10, names: list[str] | None = None) -> DataFrame:
    """(pattern, injected, found, recall): n works of each pattern put in, each looked for by its own rule."""
    names = names or list(PATTERNS)
    works = shared_table(works, "works")  # pictures are drawn once, not for every pattern
    mixed = shared_table(inject(works, n, names), "injected")
    seen = None
    for name in names:
        put = mixed.where(F.col("pattern") == name)
        one = detect(mixed, name, put).select("id").distinct().join(put.select("id"), "id", "left_semi")
        seen = one if seen is None else seen.unionByName(one)
    return recall(mixed, seen)


def inject(works: DataFrame, n: int = 10, names: list[str] | None = None) -> DataFrame:
    """works with the rows of each pattern; pattern is null for rows that were there. Changed rows get new ids."""
    typed = works.withColumn("agency", F.col("agency").cast("string")).withColumn("id", F.col("id").cast("string"))
    out = typed.withColumn("pattern", F.lit(None).cast("string"))
    for name in names or PATTERNS:
        rows = PATTERNS[name](_pick(typed, n, name))
        rows = rows.withColumn("id", F.concat_ws(":", F.lit("synthetic"), "pattern", "id"))
        out = out.unionByName(rows.select(*out.columns))
    return out


def recall(truth: DataFrame, flagged: DataFrame, key: str = "id") -> DataFrame:
    """(pattern, injected, found, recall) per injected pattern."""
    hit = flagged.select(key).distinct().withColumn("_hit", F.lit(1))
    met = truth.where("pattern IS NOT NULL").join(hit, key, "left")
    out = met.groupBy("pattern").agg(F.count(F.lit(1)).alias("injected"), F.count("_hit").alias("found"))
    return out.withColumn("recall", F.col("found") / F.col("injected"))
