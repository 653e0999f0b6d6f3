"""Near texts: ratios of many pairs at once, groups compared in place or by an index, texts that share their least item."""

import difflib
import random

import numpy as np
import pytest

from muniscope.functions import matching
from muniscope.operators import similarity


def _ratio(s, t):
    return difflib.SequenceMatcher(None, s, t, autojunk=False).ratio()


@pytest.mark.parametrize("cells", [1, 1 << 17])
def test_ratios_of_many_pairs_are_those_of_difflib(monkeypatch, cells):
    monkeypatch.setattr(matching, "CELLS", cells)
    rng = random.Random(4)
    texts = list({"".join(rng.choice("abé ") for _ in range(rng.randint(1, 30))) for _ in range(25)})
    texts += ["x" * 300, "x" * 254 + "y" * 46, "ab" * 150, "".join(map(chr, range(0x1F000, 0x1F190))), "".join(map(chr, range(0x1F010, 0x1F1A0)))]
    i, j = (np.array(v) for v in zip(*((a, b) for a in range(len(texts)) for b in range(len(texts)) if a != b)))
    want = np.array([_ratio(texts[a], texts[b]) for a, b in zip(i, j)])
    t = matching.Texts(texts)
    assert (matching.ratios(t, i, j, -1.0) == want).all()
    for threshold in (0.9, 0.6):
        place, ratio = matching.near(t, i, j, threshold)
        assert place.tolist() == np.flatnonzero(want > threshold).tolist() and (ratio == want[place]).all()


@pytest.mark.parametrize("most, threshold", [(similarity.GROUP, 0.9), (3, 0.9), (3, 0.6)])
def test_texts_with_one_least_item_are_all_compared(spark, monkeypatch, most, threshold):
    """works of several lines. Texts whose least item is the same were ranked as one text, and pairs were lost."""
    monkeypatch.setattr(similarity, "PAIRS", 50)
    rng = random.Random(7)
    rows = []
    for work in range(90):
        mp, year = rng.choice(["a", "b", "c", "d", None]), rng.choice([2019, 2020, None])
        for _ in range(rng.randint(1, 5)):
            name = f"{rng.choice(['red', 'old', 'cold'])} {rng.choice(['rod', 'bolt', 'gizmo'])} brand#{rng.randint(1, 12)}"
            rows.append((work, f"supply and laying of {name} for order of {rng.choice(['5-low', '4-not specified'])}", mp, year))
    rows += [(200, "supply and laying of red rod brand#1 for order of 5-low", "e", 2019), (None, "supply and laying of red rod brand#2 for order of 5-low", "e", 2020)]
    d = spark.createDataFrame(rows, "id long, t string, mp string, year int")
    for across in (None, "year"):
        texts: dict = {}
        for work, t, mp, year in rows:
            if mp is not None:
                texts.setdefault((mp, t), []).append((work, year))
        named = []
        for (mp, t), v in texts.items():
            years = [y for _, y in v if y is not None]
            works = [w for w, _ in v if w is not None]
            if works:
                named.append((mp, min(works), t, (min(years), max(years)) if years else None))
        want = []
        for mp, a, s, x in named:
            for other, b, t, y in named:
                if mp == other and (a, s) < (b, t) and _ratio(s, t) > threshold:
                    if not across or x and y and (x[0] != y[1] or x[1] != y[0]):
                        want.append((a, b, _ratio(s, t)))
        got = similarity.text_pairs(d, "id", "t", "mp", threshold, across, most)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want)
        assert any(a == b for a, b, _ in want)


def test_a_group_goes_on_over_many_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(100 * g + i, f"supply and laying of pump {chr(97 + i % 26)}{i // 26} in ward", g) for g in range(5) for i in range(30)]
        d = spark.createDataFrame(rows, "id long, t string, g long")
        got = {(r.a, r.b) for r in similarity.text_pairs(d, "id", "t", "g").collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {(a, b) for a, s, g in rows for b, t, h in rows if g == h and a < b and _ratio(s, t) > 0.9}
