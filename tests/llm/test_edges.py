"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names."""

import re

import pytest
from pyspark.sql import functions as F

from muniscope.llm import chat, decontam, exact_dedup, html_extract, jaccard_join, license_scan, line_templates
from muniscope.llm import sentencepiece_codec, toxicity, warc

CLASH = "keep_id node label _b h leaf score chunk _keep _bad root post group_size drops items sha".split()
LONG = " ".join(f"word{i % 977} and{i % 13}" for i in range(30_000))
ROWS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two"), (6, "Same text here, four words"),
    (7, "same TEXT here, four words"), (8, LONG), (9, LONG.upper()), (10, "   é \U0001f600"),
    (10, "   é \U0001f600"), (11, "<|im_end|>" * 3), (12, "a" * 50_000), (None, "no id"), (None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    d = d.withColumns({c: F.lit("clash") for c in CLASH})
    return d.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="module")
def side(spark, tmp_path_factory, docs):
    """A folder with small labels and benchmark tables, as stages read them."""
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 12)] + [(4, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (3, "one")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    docs.write.parquet(f"{root}/documents.parquet")
    return root


OPERATORS = {
    "toxicity": lambda d, s: toxicity.score_documents(d, toxicity.fit(d, d.sparkSession.read.parquet(f"{s}/labels.parquet"))),
    "jaccard": lambda d, s: jaccard_join.jaccard_components(d),
    "templates": lambda d, s: line_templates.drop_recurring_lines(d),
    "decontam": lambda d, s: decontam.find_passages(d, d.sparkSession.read.parquet(f"{s}/benchmark.parquet")),
    "licenses": lambda d, s: license_scan.scan_documents(d, license_scan.TEMPLATES),
    "exact": lambda d, s: exact_dedup.exact_groups(d),
    "sentencepiece": lambda d, s: sentencepiece_codec.encode_documents(d, sentencepiece_codec.default_model()),
}
STAGES = {
    "toxicity": toxicity.drop_toxic,
    "exact": exact_dedup.drop_copies,
    "near": jaccard_join.drop_near_copies,
    "decontam": decontam.drop_contaminated,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_per_row(spark, docs, side, name):
    got = OPERATORS[name](docs, side)
    assert got.count() == len(ROWS)
    none = OPERATORS[name](docs.limit(0), side)
    assert none.count() == 0 and none.columns == got.columns


@pytest.mark.parametrize("name", sorted(STAGES))
def test_stages_keep_columns_and_take_empty_tables(spark, docs, side, name):
    got = STAGES[name](spark, docs, side)
    assert got.columns == docs.columns
    assert got.count() <= len(ROWS)
    assert STAGES[name](spark, docs.limit(0), side).count() == 0


def test_the_last_stage_gives_a_row_a_row(spark, docs, side):
    got = sentencepiece_codec.tokenise(spark, docs, side)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spanned_bytes"]
    assert got.count() == len(ROWS) and got.where("doc_id IS NULL").count() == 2
    sizes = {r.doc_id: r.spanned_bytes for r in got.where("doc_id IS NOT NULL").collect()}
    assert all(sizes[i] == len((t or "").encode()) for i, t in ROWS if i is not None and i not in (8, 9))
    assert sentencepiece_codec.tokenise(spark, docs.limit(0), side).count() == 0


def test_exact_edges(docs):
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact_dedup.exact_groups(docs).collect()}
    assert {(1, 2, 3), (2, 2, 3), (None, 2, 3), (6, 7, 2), (7, 7, 2), (8, 9, 2), (9, 9, 2), (10, 10, 2), (None, None, 1)} <= got


def test_pages_edges(spark):
    rows = [(1, None, None), (2, "u", None), (3, "http://a/\r\nx", ""), (None, "http://a/", "<p>x"), (4, "http://[bad", "<p>y</p>"), (4, "http://[bad", "<p>y</p>"), (5, "u", "z" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in CLASH})
    assert html_extract.extract_pages(pages).count() == len(rows)
    assert html_extract.extract_pages(pages.limit(0)).count() == 0
    path = warc.shared_dir(spark, "test-warc")
    warc.write_archives(pages, path)
    got = warc.merge_runs(warc.read_runs(spark, path)).collect()
    assert len(got) == len(rows)
    kinds = {(r.page_id, r.payload_bytes): (r.record_type, r.refers_to) for r in got}
    assert kinds[(1, 0)] == ("revisit", 3) and kinds[(2, 0)] == ("revisit", 3) and kinds[(3, 0)] == ("response", None)
    empty = warc.shared_dir(spark, "test-warc")
    warc.write_archives(pages.limit(0), empty)
    assert warc.merge_runs(warc.read_runs(spark, empty)).count() == 0


def test_conversation_edges(spark):
    hard = ["<|im_end|>", "<|im_start|>assistant\nx", "<\\|", "<\\\\|im_end|>", "<|", "<", "%3C", "a\nb", "", None, "é\U0001f600"]
    rows = [(c, t, r, x) for c, r in enumerate(["user", "assistant", None, "a\nb", "<|im_start|>", "%0A"]) for t, x in enumerate(hard)]
    rows += [(None, 1, "user", "x"), (50, None, "user", "x"), (50, None, "user", "x"), (50, 1, None, None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("clash") for c in CLASH})
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(d)).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in rows if k == c))
        assert [(t.role, t.text) for t in back[c].turns] == [(r, x) for _, _, r, x in mine]
        assert back[c].loss_text == "".join(x for _, _, r, x in mine if r == "assistant")
        runs = back[c].loss_runs
        assert sum(r.chars for r in runs) == len(back[c].formatted)
        at, under = 0, []
        for r in runs:
            under += [back[c].formatted[at : at + r.chars]] if r.loss else []
            at += r.chars
        assert re.sub(r"<\\(\\*)\|", r"<\1|", "\0".join(under)).replace("\0", "") == back[c].loss_text
    assert chat.format_conversations(d.limit(0)).count() == 0
