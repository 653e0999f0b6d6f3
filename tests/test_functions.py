import datetime
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from muniscope.functions import amounts, images, letters, scores, text


@pytest.mark.parametrize(
    "raw,status,amount",
    [
        ("1010000.0", "ok", 1010000),
        ("12,34,567", "ok", 1234567),
        ("1,234,567", "unparseable", None),
        ("Rs. 5 Lakh", "ok", 500000),
        ("5L", "ok", 500000),
        ("₹12.5 Cr", "ok", 125000000),
        ("2Cr", "ok", 20000000),
        ("1.5 thousand", "ok", 1500),
        ("3 lakhs", "ok", 300000),
        ("50000/-", "ok", 50000),
        ("5 lakh crore", "ambiguous_unit", None),
        (None, "missing", None),
        ("", "missing", None),
        ("   ", "missing", None),
        ("NaN", "missing", None),
        ("N/A", "unparseable", None),
        ("-5", "ok", -5),
        ("0", "ok", 0),
        ("0.1", "ok", 0.1),
        ("50000000", "ok", 50000000),
        ("Rs.500", "ok", 500),
        ("INR 1,00,000.50 lakh", "ok", 10000050000),
        ("+12,345 /-", "ok", 12345),
        ("Rs. 500.", "ok", 500),
        ("about 3 lacs", "ok", 300000),
        ("1,23,45", "unparseable", None),
        ("123,456", "unparseable", None),
        ("1,,234", "unparseable", None),
        ("5 6", "unparseable", None),
        ("5-6", "unparseable", None),
        ("1.5.2", "unparseable", None),
        ("5 lakh 5 lakh", "unparseable", None),
        ("5 lakh lakh", "ok", 500000),
    ],
)
def test_amounts(spark, raw, status, amount):
    got = spark.createDataFrame([(raw,)], "r string").select(amounts.normalise_amount(F.col("r")).alias("a")).first().a
    assert got.status == status
    assert (None if got.amount is None else float(got.amount)) == amount


def test_ambiguous_amount_keeps_its_number(spark):
    got = spark.createDataFrame([("5 lakh crore",)], "r string").select(amounts.normalise_amount(F.col("r")).alias("a")).first().a
    assert (float(got.parsed_value), got.unit) == (5, "crore,lakh")


@pytest.mark.parametrize(
    "raw,want",
    [
        ("LN/MP612/2023-2024/45", (612, 2023, 2024, 45)),
        ("LN/MP612/\t2023-2024 /45", (612, 2023, 2024, 45)),
        ("  LN/MP1/2020-2021/7 ", (1, 2020, 2021, 7)),
        (None, (None,) * 4),
        ("", (None,) * 4),
        ("LN/MPx/2023-2024/45", (None,) * 4),
        ("LN/MP1/23-24/45", (None,) * 4),
        ("REF LN/MP1/2023-2024/45", (None,) * 4),
    ],
)
def test_letters(spark, raw, want):
    got = spark.createDataFrame([(raw,)], "r string").select(letters.parse_letter(F.col("r")).alias("p")).first().p
    assert tuple(got) == want


def test_fiscal_years(spark):
    d = spark.createDataFrame([(datetime.date(2024, 3, 31),), (datetime.date(2024, 4, 1),)], "d date")
    got = [tuple(r) for r in d.select(letters.fiscal_close(F.col("d")), letters.fiscal_year(F.col("d"))).collect()]
    assert got == [(datetime.date(2024, 3, 31), 2023), (datetime.date(2025, 3, 31), 2024)]


def test_strength_and_ids(spark):
    row = spark.range(1).select(
        scores.strength(F.lit(0.67), F.lit(True)), scores.strength(F.lit(0.34), F.lit(True)), scores.strength(F.lit(0.1), F.lit(True)),
        scores.strength(F.lit(0.9), F.lit(False)), text.match_id(F.lit("b"), F.lit("a"), "v"), text.match_id(F.lit("a"), F.lit("b"), "v"),
        text.alert_id(F.lit("w"), F.lit("c"), F.lit("f"), F.lit(None)),
    ).first()
    empty = hashlib.sha1(b"").hexdigest()[:8]
    assert tuple(row[:4]) == ("strong", "medium", "weak", None)
    assert row[4] == row[5]
    assert row[6] == hashlib.sha1(f"w\x1fc\x1ff\x1f{empty}".encode()).hexdigest()[:16]


def test_jurisdictions(spark):
    d = spark.createDataFrame([(" Orissa ",), ("ODISHA",), ("",), (None,), ("NCT of Delhi",)], "x string")
    assert [r[0] for r in d.select(text.jurisdiction(F.col("x"))).collect()] == ["odisha", "odisha", None, None, "delhi"]


def test_perceptual_hash_survives_scaling_and_noise():
    rng = np.random.default_rng(1)
    picture = np.kron(rng.random((8, 8)), np.ones((12, 12))) * 255
    h = images.perceptual_hash(picture)
    assert 0 <= h < 1 << 63
    assert bin(h ^ images.perceptual_hash(np.kron(picture, np.ones((2, 2))))).count("1") == 0
    assert bin(h ^ images.perceptual_hash(picture + rng.normal(0, 2, picture.shape))).count("1") <= 6
    assert bin(h ^ images.perceptual_hash(np.kron(rng.random((8, 8)), np.ones((12, 12))) * 255)).count("1") > 12


def test_hamming_expression(spark):
    rng = random.Random(3)
    pairs = [(rng.getrandbits(63), rng.getrandbits(63)) for _ in range(20)]
    d = spark.createDataFrame(pairs, "a long, b long").select("a", "b", scores.hamming(F.col("a"), F.col("b")).alias("d")).collect()
    assert all(r.d == bin(r.a ^ r.b).count("1") for r in d)
