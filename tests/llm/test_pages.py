"""Main text of open pages, of pages without an article and of other scripts, and which rule decided."""

import collections
import random
import re

import duckdb
import pytest

from muniscope.llm import html_extract as h

EN = "The river that runs to the north of the town is one of the oldest in the land and it was for many years the only way for goods to come in from the sea. "
NAV = '<nav><a href="/a">Home</a> <a href="/b">About the town</a></nav>'
FOOT = "<footer>All of the rights are reserved by the owners of this site and it is not for copying.</footer>"
TECH = "Kernel modules load firmware blobs via request handlers; userspace daemons parse netlink messages, update sysfs nodes, emit uevents, trigger udev rules, mount overlay filesystems, spawn containers, rotate logs, flush caches, sync disks."
RU = "Река, протекающая к северу от города, долгие годы оставалась единственной дорогой для товаров, приходивших с моря, и на её берегах выросли склады. " * 2
ZH = "这条河流经城市的北部，多年来一直是货物从海上运来的唯一通道，河岸上建起了仓库和码头，商人们在那里交易。" * 3


def page(body):
    return f"<html><head><title>t</title></head><body>{NAV}{body}{FOOT}</body></html>"


CASES = {
    "open page": (f"<div><h1>The river</h1><p>{EN * 2}</p><p>{EN * 2}</p><p>So it is.</p></div>", ["The river", EN * 2, EN * 2, "So it is."]),
    "link lists go": (f"<p>{EN * 2}</p><ul><li><a href='/x'>One more story to read</a></li></ul><p>{EN * 2}</p>", [EN * 2, EN * 2]),
    "keyword lists go": (f"<p>{EN * 2}</p><p>{'camera lens tripod filter battery charger ' * 6}</p><p>{'zoom case strap bag mount ' * 9}</p>", [EN * 2]),
    "teaser beside a body": (f"<article>Short teaser.</article><div><p>{EN * 3}</p><p>{EN * 2}</p></div>", ["Short teaser.", EN * 3, EN * 2]),
    "article with a note beside it": (f"<article><p>{EN * 3}</p><p>{EN * 2}</p></article><div>{EN * 2}</div>", [EN * 3, EN * 2]),
    "section named banner": (f"<article><p>{EN * 2}</p><div class='banner'><p>{EN * 2}</p></div><div class='share'>Share this</div></article>", [EN * 2, EN * 2]),
    "odd words inside": ("<article><p>Zq xv wkj.</p><p>" + "qx zv jk " * 40 + "</p></article>", ["Zq xv wkj.", "qx zv jk " * 40]),
    "Russian": (f"<div><p>{RU}</p><p>{RU}</p></div>", [RU, RU]),
    "Chinese": (f"<div><p>{ZH}</p><p>{ZH}</p></div>", [ZH, ZH]),
    "Chinese article": (f"<article><h1>河流</h1><p>{ZH}</p></article>", ["河流", ZH]),
    "notices inside an article go": (f"<article><p>{EN * 2}</p><div class='notice'><p>{EN * 2}</p></div><div class='promo'><p>{EN * 3}</p></div><p>{EN * 2}</p></article>", [EN * 2, EN * 2]),
    "technical words between text": (f"<div><p>{EN * 2}</p><p>{TECH}</p><p>{EN * 2}</p></div>", [EN * 2, TECH, EN * 2]),
    "a linked sentence between text": (f"<div><p>{EN * 2}</p><p><a href='/x'>Full report with all figures and tables of twelve years</a></p><p>{EN * 2}</p></div>", [EN * 2, "Full report with all figures and tables of twelve years", EN * 2]),
    "a long discussion beside an article": (f"<article><p>{EN * 2}</p></article><div class='thoughts'><p>{EN * 3}</p><p>{EN * 3}</p></div>", [EN * 2]),
    "an article in a share element": ("<article><div class='share'><p>Only a line.</p></div></article>", ["Only a line."]),
    "share lines beside text go": (f"<article><p>{EN * 2}</p><div class='share'><p>Only a line.</p></div></article>", [EN * 2]),
    "comments go": (f"<article><p>{EN * 2}</p><section id='comments'><p>{EN * 2}</p></section></article>", [EN * 2]),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_main_text(name):
    body, want = CASES[name]
    assert h.extract(page(body)) == "\n".join(" ".join(x.split()) for x in want)


def test_each_rule_decides_blocks_of_the_tables():
    """The blocks of the pages table by the rule that decided them: density decides, not markup alone."""
    rows = duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()
    rules = collections.Counter()
    for (x,) in rows:
        blocks = h.blocks_of(x or "")
        h.classify(blocks)
        rules.update((b.rule, b.label) for b in blocks)
        # An independent extractor for these pages: everything in the one article stands, all else goes.
        inner = (x or "").partition("<article>")[2].partition("</article>")[0]
        assert h.extract(x or "") == h.extract(f"<article>{inner}</article>")
    assert rules[("density", "good")] > rules[("length", "good")] + 500 and not any(label not in ("good", "bad") for _, label in rules)


@pytest.mark.parametrize(
    "make",
    [
        lambda n: "<div>" * n + "x</p>" * n, lambda n: "<a>" * n + "<div>x</div>" * n, lambda n: "<label><a>" * n + "<p>x</p><div>y</div>" * n,
        lambda n: "<p><button>" * n + "x</li></a>" * n, lambda n: "<li><p>x" * n + "</ul>" * n, lambda n: "<" * n + "a b='" * n, lambda n: "<!-- " * n + "<script " * n,
    ],
)
def test_time_follows_the_length_of_a_page(make):
    import time

    took = []
    for n in (8_000, 32_000):
        begin = time.process_time()
        h.extract(make(n))
        took.append(time.process_time() - begin)
    assert took[1] < 8 * took[0] + 0.3  # four times, not sixteen


def brute_labels(blocks):
    """The rules once more, block by block from their statement, with whole searches for neighbours."""
    def facts(b):
        w = [x for x in re.findall(r"[^\W\d_]+", b.text.lower())]
        return sum(x in h.STOP_WORDS for x in w), len(w), len(b.text) + 2 * len(h._WIDE.findall(b.text)), b.link / len(b.text)

    seen = [facts(b) for b in blocks if b.region != "out"]
    known = sum(s for s, *_ in seen) >= 0.08 * sum(n for _, n, *_ in seen)
    labels = []
    for b in blocks:
        stop, n, size, linked = facts(b)
        if b.region == "out":
            labels.append("bad")
        elif linked > 0.5:
            labels.append("short" if b.region == "in" else "thin" if b.tag in ("p", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") and b.region == "" else "bad")
        elif size < 70:
            labels.append("bad" if b.region == "weak" else "short")
        elif not known or n and stop / n >= 0.2:
            labels.append("good" if size > 200 else "near")
        else:
            labels.append("near" if b.region == "in" or n and stop / n >= 0.08 else "thin")
    inner = [i for i, b in enumerate(blocks) if b.region in ("in", "weak")]
    outer = [i for i, b in enumerate(blocks) if b.region == ""]
    if inner:
        teaser = all(labels[i] != "good" for i in inner) and sum(facts(blocks[i])[2] for i in inner) < 200
        for i in outer:
            labels[i] = "good" if teaser and labels[i] == "good" else "bad"
        if all(labels[i] == "bad" for i in inner) and all(labels[i] == "bad" for i in outer):
            for i in inner:
                if blocks[i].region == "weak" and facts(blocks[i])[3] <= 0.5:
                    labels[i] = "short"
    for part in (inner, outer):
        for kind in ("near", "thin", "short"):
            known_ = [i for i in part if labels[i] in ("good", "bad") and blocks[i].region != "weak"]
            fresh = {}
            for i in [i for i in part if labels[i] == kind]:
                place = part.index(i)
                left = [k for k in known_ if k < i][-1:]
                right = [k for k in known_ if k > i][:1]
                a, b = (labels[x[0]] if x else None for x in (left, right))
                if kind == "thin":
                    fresh[i] = "good" if a == b == "good" else "bad"
                elif a is b is None:
                    fresh[i] = "good"
                elif kind == "near":
                    fresh[i] = "bad" if a == b == "bad" else "good"
                elif a is None or b is None or a == b:
                    fresh[i] = a or b
                elif blocks[i].tag in ("h1", "h2", "h3", "h4", "h5", "h6") and b == "good":
                    fresh[i] = "good"
                else:
                    before, after = place - part.index(left[0]), part.index(right[0]) - place
                    fresh[i] = a if before < after else b if after < before else "bad"
            for i, x in fresh.items():
                labels[i] = x
    return labels


def test_labels_equal_a_plain_statement_of_the_rules():
    rng = random.Random(9)
    part = lambda: rng.choice([EN, EN * 2, EN * 3, TECH, "Short line.", "Zq xv.", "qx zv jk " * rng.randint(1, 40), RU, ZH, "<a href='/x'>" + rng.choice([EN, "link"]) + "</a>"])
    element = lambda x: (lambda t: f"<{t}>{x}</{t}>")(rng.choice(["p", "p", "p", "div", "li", "h2", "blockquote", "td", "nav", "aside", "div class='share'", "div class='banner'", "div class='notice'"]))
    for _ in range(400):
        inside, outside = ("".join(element(part()) for _ in range(rng.randint(0, 7))) for _ in range(2))
        body = rng.choice([outside, f"<article>{inside}</article>{outside}", f"{outside}<main>{inside}</main>"])
        blocks = h.blocks_of(page(body))
        want = brute_labels(blocks)
        h.classify(blocks)
        assert [b.label for b in blocks] == want
    for (x,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.001/pages.parquet'").fetchall():
        blocks = h.blocks_of(x or "")
        want = brute_labels(blocks)
        h.classify(blocks)
        assert [b.label for b in blocks] == want
