"""Forecasts, calibration, mosaics and case histories against plain loops."""

import random

import numpy as np
import pytest

from muniscope.operators import outlook, satellite, serving


def test_smoothing_fills_months(spark):
    d = spark.createDataFrame([("a", 10, 5.0), ("a", 12, 9.0), ("a", 13, 1.0), ("b", 7, 4.0)], "k string, month int, amount double")
    got = {r.k: r for r in outlook.smoothed(d, "k", 0.5, 0.3).collect()}
    level, trend = 5.0, -5.0
    for x in (0.0, 9.0, 1.0):
        new = 0.5 * x + 0.5 * (level + trend)
        level, trend = new, 0.3 * (new - level) + 0.7 * trend
    assert (got["a"].months, got["a"].last) == (4, 13) and got["a"].level == pytest.approx(level) and got["a"].trend == pytest.approx(trend)
    assert (got["b"].level, got["b"].trend) == (4, 0)
    granted = spark.createDataFrame([("a", 100.0), ("b", 4.0)], "k string, amount double")
    f = {r.k: r for r in outlook.fund_forecast(d, granted, "k", 3).collect()}
    assert f["b"].absorbed is None and f["b"].forecast == 12 and f["a"].balance == 85
    assert f["a"].forecast == pytest.approx(sum(max(0, level + h * trend) for h in (1, 2, 3)))


def test_thresholds_follow_outcomes(spark):
    rows = [("good", k / 100, k >= 45) for k in range(101)] + [("bad", k / 100, False) for k in range(101)] + [("open", 0.9, None), ("rare", 0.99, True)]
    d = spark.createDataFrame(rows, "signal string, score double, confirmed boolean")
    got = {r.signal: r for r in outlook.calibrated(d, {"good": 10.0, "bad": 10.0, "open": 5.0, "rare": 5.0, "new": 10.0}, 0.5, 1.0, 10).collect()}
    assert {k: round(r.threshold, 4) for k, r in got.items()} == {"good": 0.45, "bad": 0.5, "open": 0.5, "rare": 0.5, "new": 0.5}
    assert got["good"].weight > 10 > got["bad"].weight and got["open"].reviewed == 0
    assert sum(r.weight for r in got.values()) == pytest.approx(40)


def test_mosaic_of_tiles(spark):
    rng = np.random.default_rng(3)
    side, crop, grid, zoom = 6, 11, 3, 5
    world = rng.integers(1, 255, (32 * side, 32 * side))
    gone = {(x, y) for x in range(32) for y in range(32) if rng.random() < 0.2} | {(x, y) for x in (27, 28, 29) for y in (10, 11, 12)}
    tiles = [(x, y, world[y * side : (y + 1) * side, x * side : (x + 1) * side].ravel().tolist()) for x in range(32) for y in range(32) if (x, y) not in gone]
    rows = [(i, float(rng.uniform(-60, 60)), float(rng.uniform(-150, 150))) for i in range(40)] + [(99, 45.0, (28.5 / 32 * 360 - 180))]
    got = {r.id: r for r in satellite.mosaic(spark.createDataFrame(rows, "id int, lat double, lon double"), spark.createDataFrame(tiles, "x long, y long, pixels array<int>"), zoom, grid, side, crop).collect()}
    for x, y in gone:
        world[y * side : (y + 1) * side, x * side : (x + 1) * side] = 0
    for i, lat, lon in rows:
        x, y = (lon + 180) / 360 * 32, (1 - np.log(np.tan(np.radians(lat)) + 1 / np.cos(np.radians(lat))) / np.pi) / 2 * 32
        missing = sum((int(x) + a, int(y) + b) in gone for a in (-1, 0, 1) for b in (-1, 0, 1))
        left, top = (int(np.floor((1 + v - int(v)) * side - crop / 2)) + (int(v) - 1) * side for v in (x, y))
        assert got[i].missing == missing
        assert got[i].pixels == (None if missing == 9 else world[top : top + crop, left : left + crop].ravel().tolist())
    assert got[99].pixels is None


@pytest.mark.parametrize("parts", ["1", "7"])
def test_moves_of_a_case(spark, parts):
    rng = random.Random(1)
    states, roles = list(serving.TRANSITIONS), [*serving.ROLE_TARGETS, None]
    rows = [(rng.choice("aaaab"), i, rng.randrange(500), rng.choice([*states, None]), rng.choice(roles), rng.choice(["why", " ", None])) for i in range(900)]
    d = spark.createDataFrame(rows, "case string, item int, at int, to_status string, role string, reason string").repartition(5)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.item: (r["case"], r.from_status, r.verdict, r.status) for r in serving.replay(d, "case", "item", "at").collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    now, want = {}, {}
    for case, item, at, to, role, reason in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        status = now.get(case, "NEW")
        one = serving._verdict(status, to, role, reason)
        now[case] = to if one == "ok" else status
        want[item] = (case, status, one, now[case])
    assert got == want and {v[2] for v in want.values()} == {"ok", "illegal_transition", "role_not_allowed", "reason_required"}
    moves = spark.createDataFrame([(w[1], r[3], r[4], r[5], w[2]) for r in rows for w in [want[r[1]]]], "from_status string, to_status string, role string, reason string, want string")
    assert serving.check_transitions(moves).where("verdict <> want").count() == 0


def test_hits_of_either_branch(spark):
    from muniscope.operators import evaluation

    works = spark.createDataFrame(
        [(1, "B", "m", "road", 999_000.0, "x", False), (2, "B", "m", "road", 60_000_000.0, "x", True), (3, "B", "n", "road", 5.0, "y", True), (4, "A", "m", "road", 1.0, "z", True)],
        "id long, branch string, mp string, category string, amount double, description string, has_images boolean",
    )
    truth = spark.createDataFrame(
        [(4, "A", "phantom_work", "a1", None), (5, "A", "phantom_work", "a2", None), (6, "A", "genuine", "a2", None), (7, "A", "genuine", "a9", None), (1, "B", "structuring", None, [1, 2, 77]),
         (1, "B", "missing_evidence", None, None), (2, "B", "cross_year_text_duplicate", None, None), (3, "B", "cross_year_text_duplicate", None, None), (1, "B", "entitlement_pace_cluster", None, [1, 2, 3])],
        "id long, branch string, pattern string, asset string, cluster array<long>",
    )
    change = spark.createDataFrame([("a1", False), ("a2", True)], "asset string, changed boolean")
    got = {(r.branch, r.pattern): (r.hits, r.total) for r in evaluation.branch_report(works, truth, change).collect()}
    assert got == {
        ("A", "phantom_work"): (1, 2), ("A", "genuine_correctly_not_flagged"): (1, 1), ("B", "structuring"): (1, 3), ("B", "missing_evidence"): (1, 1),
        ("B", "cross_year_text_duplicate"): (1, 2), ("B", "entitlement_pace_cluster"): (1, 2),
    }


def test_alerts_are_settled_by_the_latest_decision(spark, tmp_path):
    from muniscope.operators import quality

    alerts = spark.createDataFrame([("a", "info"), ("b", "critical"), ("c", "info")], "id string, severity string")
    log, audit = str(tmp_path / "log"), str(tmp_path / "audit")
    ddl = "alert_id string, status string, reason string, actor string, in_scope boolean, at int"
    first = [("a", "resolved", "r", "p", True, 1), ("a", "accepted", "r", "p", True, 2), ("b", "resolved", "r", "q", False, 3), ("zz", "resolved", "r", "p", True, 4)]
    quality.resolve_alerts(alerts, spark.createDataFrame(first, ddl), log, audit)
    quality.resolve_alerts(alerts, spark.createDataFrame([("a", "resolved", "again", "q", True, 9)], ddl), log, audit)
    got = {r.id: (r.status, r.reason) for r in quality.alert_states(alerts, spark.read.parquet(log)).collect()}
    assert got == {"a": ("resolved", "again"), "b": ("open", None), "c": ("open", None)}
    lines = sorted((r["at"], r.alert_id, r.verdict, r.before, r.after) for r in spark.read.parquet(audit).collect())
    assert lines == [
        (1, "a", "ok", "open", "resolved"), (2, "a", "ok", "resolved", "accepted"), (3, "b", "forbidden", "open", "open"),
        (4, "zz", "not_found", "open", "open"), (9, "a", "ok", "accepted", "resolved"),
    ]


def test_details_of_works(spark):
    works = spark.createDataFrame([(1, "m", 5.0), (2, "m", 9.0), (3, "m", 7.0), (4, "n", 1.0)], "id int, mp string, amount double")
    actions = spark.createDataFrame([(1, 20, "u", "Confirm"), (1, 10, "v", "Dismiss"), (4, 5, "u", "Dismiss"), (2, 1, "u", "Confirm")], "id int, at int, actor string, decision string")
    ids = spark.createDataFrame([(1,), (1,), (4,), (99,), (3,)], "id int")
    got = {r.id: r for r in serving.work_detail(ids, works, actions, "mp", "id", "amount", 2).collect()}
    assert set(got) == {1, 3, 4}
    assert [(h["at"], h.decision) for h in got[1].history] == [(10, "Dismiss"), (20, "Confirm")] and got[1].status == "Confirm"
    assert (got[1].related, got[3].related, got[4].related) == ([2, 3], [2, 1], []) and (got[3].status, got[3].history) == ("Flagged", [])
