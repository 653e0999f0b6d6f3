"""Rows that links between neighbours alone would leave out."""

from muniscope.operators import similarity, vendors


def test_members_of_classes_across_groups(spark):
    rows = [("h", 1, "s"), ("h", 2, "s"), ("h", 2, "s"), ("h", 3, "t"), ("k", 4, "s"), ("k", 5, "s"), (None, 6, "s"), (None, 7, "t")]
    d = spark.createDataFrame(rows, "h string, id long, source string")
    got = sorted(tuple(r) for r in similarity.members_of(d, ["h"], "id", "source", "source").collect())
    assert got == [(1, 1, "s"), (1, 2, "s"), (1, 3, "t"), (6, 6, "s"), (6, 7, "t")]
    linked = {(r.a, r.b) for r in similarity.cross_links(d, ["h"], "id", "source").collect()}
    assert linked == {(1, 3), (2, 3), (3, 1), (6, 7), (7, 6)}
    assert len(similarity.members_of(d, ["h"], "id", "source", "id").collect()) == 7


def test_collusion_pairs_are_all_pairs_within_the_tolerance(spark):
    bids = [(1, "d", "V1", 100.0), (1, "d", "V2", 100.5), (1, "d", "V3", 101.0), (1, "d", "V4", 105.0), (2, "d", "V1", 100.0), (2, "e", "V2", 100.0)]
    bids += [(3, "d", "V1", 50.0), (3, "d", "V1", 50.2), (3, "d", "V1", 50.9), (3, "d", "V2", 51.0), (4, "d", "V1", 0.0), (4, "d", "V2", 0.0), (4, "d", "V3", -1.0)]
    bids += [(5, "d", f"W{k:03}", 10 * 1.0037**k) for k in range(120)]
    d = spark.createDataFrame(bids, "mp int, day string, vendor string, amount double")
    want = {(a[0], a[1], *sorted((a[2], b[2]))) for a in bids for b in bids if a[:2] == b[:2] and a[2] != b[2] and 0 <= b[3] - a[3] <= 0.02 * b[3]}
    got = [tuple(r) for r in vendors.collusion_pairs(d).collect()]
    assert len(got) == len(want) and set(got) == want and (1, "d", "V1", "V3") in want
    assert (1, "d", "V1", "V3") not in {tuple(r) for r in vendors.neighbouring_bids(d).collect()}
