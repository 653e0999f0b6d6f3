import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from muniscope.functions import images
from muniscope.operators import canonical, cases, evidence, graph, peers, profile, quality, quantiles, satellite, serving, similarity, vendors


def test_pair_counts_and_strongest_class(spark):
    pairs = spark.createDataFrame(
        [(1, 2, "exact", "rejected_watermark"), (1, 3, "near", "candidate_only"), (1, 1, "near", "processing_failed"), (2, 3, "near", "confirmed_visual_correspondence")],
        "a int, b int, tier string, class string",
    )
    got = {r.work: (r.exact, r.near, r.strongest) for r in evidence.pair_counts(pairs, ["exact", "near"]).collect()}
    assert got == {1: (1, 2, "candidate_only"), 2: (1, 1, "confirmed_visual_correspondence"), 3: (0, 2, "confirmed_visual_correspondence")}


def test_expansion_has_no_repeats(spark):
    pairs = spark.createDataFrame([("x", "y")], "a string, b string")
    members = spark.createDataFrame([("x", 1), ("x", 1), ("x", 2), ("y", 2), ("y", 3)], "content string, work int")
    assert sorted(tuple(r) for r in evidence.expand_pairs(pairs, members).collect()) == [(1, 2), (1, 3), (2, 3)]


def test_measures_of_pixels():
    assert evidence.measure(np.full((2, 4, 3), 100)) == (4, 2, 2, 0, 0)
    colours = np.random.default_rng(0).integers(0, 255, (16, 16, 3))
    assert evidence.measure(colours)[3] > 5 and evidence.measure(colours)[4] > 30


def test_match_classes(spark):
    rows = [(100, 0.2, 0.05, 500, False), (99, 0.9, 0.9, 500, True), (99, 0.9, 0.9, 500, False), (500, 0.9, 0.9, 9, False), (None, None, None, None, None)]
    d = spark.createDataFrame(rows, "g int, r double, c double, k int, s boolean")
    got = [r[0] for r in d.select(images.match_class(*(F.col(x) for x in "grcks"))).collect()]
    assert got == ["confirmed_visual_correspondence", "rejected_watermark", "rejected_generic_similarity", "insufficient_features", "processing_failed"]


def test_stretch_and_pairs(spark):
    d = spark.createDataFrame([("a", float(v)) for v in range(0, 101)] + [("b", 0.0)], "k string, v double")
    got = {(r.k, r.v): r.stretched for r in evidence.stretch(d, ["k"], "v").collect()}
    low, high = np.percentile(range(1, 101), [2, 98])
    assert got[("a", 50.0)] == pytest.approx((50 - low) / (high - low) * 255)
    assert (got[("a", 100.0)], got[("a", 0.0)], got[("b", 0.0)]) == (255, 0, 0)
    scenes = spark.createDataFrame([("x", 1, 5), ("x", 2, 3), ("x", 3, 9), ("y", 4, 1)], "k string, i int, t int")
    assert [tuple(r) for r in evidence.first_and_last(scenes, "k", "i", "t").collect()] == [("x", 2, 3)]


def test_eligibility_goes_gate_by_gate(spark):
    rows = [
        (None, 0.1, False, 999, 99, None), (1.0, 0.5, False, 999, 99, None), (1.0, 0.6, False, 999, 99, None), (1.0, 0.6, True, 366, 99, None),
        (1.0, 0.6, True, 365, 31, None), (1.0, 0.6, True, 365, 30, "Temple"), (1.0, 0.6, True, 365, 30, "Installing tube-wells"), (1.0, 0.6, True, 365, 30, "Community Hall"),
    ]
    d = spark.createDataFrame(rows, "lat double, confidence double, images boolean, skew int, cloud int, category string")
    assert [r[0] for r in d.select(satellite.eligibility(d)).collect()] == [
        "coordinates_missing", "geocode_uncertain", "imagery_missing", "imagery_misaligned", "cloudy", "inconclusive", "asset_below_resolution", "eligible",
    ]


def test_workflow_rules_cover_every_move(spark):
    moves = [(a, b, role, why) for a in serving.CASE_STATUS for b in serving.CASE_STATUS for role in serving.ROLE_TARGETS for why in (None, " ", "x")]
    d = spark.createDataFrame(moves, "from_status string, to_status string, role string, reason string")
    for r in serving.check_transitions(d).collect():
        if r.to_status not in serving.TRANSITIONS[r.from_status]:
            assert r.verdict == "illegal_transition"
        elif r.to_status not in serving.ROLE_TARGETS[r.role]:
            assert r.verdict == "role_not_allowed"
        elif (r.to_status in serving.NEEDS_REASON or r.from_status in serving.TERMINAL) and not (r.reason or "").strip():
            assert r.verdict == "reason_required"
        else:
            assert r.verdict == "ok"


def test_profile_pieces(spark):
    d = spark.createDataFrame([(1, "01-Feb-2024"), (2, "31-Feb-2024"), (3, ""), (4, None)], "v int, d string")
    r = profile.date_failures(d, "d", "dd-MMM-yyyy").first()
    assert (r.rows, r.blank, r.failed, r.failure_rate, r["first"]) == (4, 2, 1, 0.5, datetime.date(2024, 2, 1))
    assert quantiles.upper_median(d, "v", "m").first()[0] == 3
    assert quantiles.upper_median(d.where("v < 4"), "v", "m").first()[0] == 2
    top = {(x.column, x.value): x.n for x in profile.top_values(d, ["d"], 2).collect()}
    assert len(top) == 2 and all(n == 1 for n in top.values())
    p = {x.column: (x.nulls, x.distinct) for x in profile.column_profile(d, ["v", "d"]).collect()}
    assert p == {"v": (0, 4), "d": (1, 3)}


def test_benford_tells_uniform_from_real(spark):
    rng = np.random.default_rng(1)
    real = [("real", float(x)) for x in np.exp(rng.uniform(0, 12, 3000))]
    flat = [("flat", float(x)) for x in rng.uniform(1, 10, 3000)]
    got = {r.k: r.chi_square for r in profile.first_digits(spark.createDataFrame(real + flat, "k string, v double"), "v", "k").collect()}
    assert got["real"] < 25 < 200 < got["flat"]


def test_empty_tables(spark):
    works = spark.createDataFrame([], "id int, mp int, vendor int, day date, amount double, c string, p string")
    assert peers.ladder_z(works, "amount", "c", "p").count() == 0
    assert peers.average_rank(works, "amount").count() == 0
    assert vendors.concentration(works).count() == vendors.neighbouring_bids(works).count() == vendors.split_invoicing(works, 10.0).count() == 0
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0
    assert similarity.hamming_pairs(spark.createDataFrame([], "id int, x long"), "id", "x", 3).count() == 0
    assert quality.duplicated(works, "id", "mp").count() == 0
    none = spark.createDataFrame([], "k string, a int")
    assert canonical.outer_merge(none, none, "k").count() == 0
    signals = cases.standard_signals(none, "k", {"anomaly": (F.col("a").cast("double"), F.lit(True))})
    assert cases.consolidate(signals).count() == 0
    assert serving.related(works, "mp", "id", "amount").count() == 0
    assert profile.describe(works, "amount", "c").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.integers(0, (1 << 63) - 1), st.integers(0, 63))
def test_hash_bits(value, shift):
    moved = value ^ (1 << shift)
    assert bin(value ^ moved).count("1") == 1
