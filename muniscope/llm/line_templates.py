"""Recurring line templates, found with a fixed-depth parse tree, in DataFrame functions only.

Level one of the tree is a line's token count, the next DEPTH levels are its leading tokens;
tokens with a digit are variable from the start. A leaf holds any number of templates: a token
that recurs at its position of the leaf stays constant, each other one is generalised to a variable
field, and lines that are equal after this have one template. At most a third of the tokens
beyond the leading ones may be generalised, so lines of up to six tokens must agree in full.
A template recurs, and its lines are dropped wherever they stand, if it stands in as many documents
as SUPPORT asks of its length: two for a line of fifty tokens or more, which no two
documents have by chance, and twenty for one of up to three. A copy of a whole document recurs
like any other text: copies are to be dropped as documents first.

All counts are over all documents and combine before they shuffle. A line that a third of the
documents share is one row of the leaf's lines; where rows per document meet it, it is
broadcast. Support does not depend on the other lines of a leaf, so a line that recurs
in a corpus recurs in every larger one. Lines are told apart by 128 bits of hash.

Other columns of a table are not read and may have any name.

Defined results: null text counts as empty; empty and blank lines stay; every row counts as a document,
whether its doc_id is null, repeated or its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, join_groups, materialise, row_keyed, table

DEPTH = 3
#: (tokens from which it holds, documents in which a template of that length must stand)
SUPPORT = ((50, 2), (20, 4), (4, 10), (1, 20))
VARIABLE = "<*>"
_SPACE = r"[ \t\r\f\x0B]+"
LINE = ["h", "g"]


def _flat(line: Column) -> Column:
    """Single spaces between tokens; the regular expressions only run where there is something to do."""
    odd = line.contains("  ") | line.startswith(" ") | line.endswith(" ")
    for c in "\t\r\f\x0b":
        odd = odd | line.contains(c)
    return F.when(odd, F.regexp_replace(F.regexp_replace(line, _SPACE, " "), "^ | $", "")).otherwise(line)


def _mask(line: Column) -> Column:
    """A mark for each token that holds a digit."""
    return F.when(line.rlike("[0-9]"), F.regexp_replace(line, "[^ 0-9]*+[0-9][^ ]*+", VARIABLE)).otherwise(line)


def masked_lines(text: Column) -> Column:
    """Array of a text's masked lines. Nested transforms evaluate each step once per line,
    where a filter on a derived column would be pushed down and evaluate it again."""
    return F.transform(F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), _flat), _mask)


def _count(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def _support(n: str = "n") -> Column:
    chosen = F.when(F.col(n) >= SUPPORT[0][0], SUPPORT[0][1])
    for least, docs in SUPPORT[1:]:
        chosen = chosen.when(F.col(n) >= least, docs)
    return chosen


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h"), F.xxhash64(F.lit("g"), line).alias("g")]


def _lines(source: DataFrame, *extra: str) -> DataFrame:
    """(row, n, leaf, h, g, ...) per line that is not blank; extra: line."""

    def entry(line: Column) -> Column:
        more = [line.alias(x) for x in extra]
        return F.struct(_count(line).alias("n"), F.substring_index(line, " ", DEPTH).alias("head"), *_hashes(line), *more)

    found = F.filter(F.transform(F.filter(masked_lines(F.col("text")), lambda x: x != ""), entry), lambda e: e.n > 0)
    split = source.select("row", F.inline(found))
    return split.select("row", "n", F.xxhash64("n", "head").alias("leaf"), *LINE, *extra)


def _templates(kept: DataFrame) -> DataFrame:
    """(leaf, h, g, w, n, p, q): the template (leaf, p, q) of each line that may generalise no more than its length allows.

    kept: (n, leaf, h, g, w, line), a row for every distinct line of a leaf with its documents w."""
    tokens = kept.select("n", "leaf", *LINE, "w", F.posexplode(F.split("line", " ")).alias("pos", "token"))
    tokens = tokens.where((F.col("pos") >= DEPTH) & (F.col("token") != VARIABLE))
    tokens = tokens.select("n", "leaf", *LINE, "w", F.xxhash64("pos", "token").alias("t"), F.xxhash64("token", "pos").alias("u"))
    constant = tokens.groupBy("leaf", "t", "u").agg(F.sum("w").alias("_w"), F.first("n").alias("n"))
    constant = constant.where(F.col("_w") >= _support()).select("leaf", "t", "u")
    fixed = tokens.where(F.col("w") < _support()).join(constant, ["leaf", "t", "u"]).groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("constants"), F.bit_xor("t").alias("p"), F.bit_xor("u").alias("q")
    )
    # All tokens of a line with support of its own are constant.
    every = tokens.where(F.col("w") >= _support()).groupBy(*LINE).agg(F.bit_xor("t").alias("p"), F.bit_xor("u").alias("q"))
    sure = kept.where(F.col("w") >= _support()).join(every, LINE, "left").withColumn("loose", F.lit(0))
    later = F.filter(F.split("line", " "), lambda t, i: (i >= DEPTH) & (t != VARIABLE))
    weak = kept.where(F.col("w") < _support()).withColumn("later", F.size(later)).join(fixed, LINE, "left")
    columns = ["n", "leaf", *LINE, "w", "p", "q", "loose"]
    weak = weak.withColumn("loose", F.col("later") - F.coalesce("constants", F.lit(0)))
    named = sure.select(*columns).unionByName(weak.select(*columns))
    loose = F.col("loose")
    # Masks are equal where constants and leaf are, but for variable fields of both kinds, which may
    # stand in for each other.
    return named.where(3 * loose <= F.greatest(F.col("n") - DEPTH - 1, F.lit(0))).select(
        "leaf", *LINE, "w", "n", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("q", F.lit(0)).alias("q")
    )


def recurring_lines(source: DataFrame) -> DataFrame:
    """(row, drops): for rows of (row, text) with lines to drop, the hashes of these lines."""
    seen = materialise(_lines(source).distinct(), "template-seen")
    total = seen.count()
    spread = materialise(seen.groupBy("n", "leaf", *LINE).agg(F.count(F.lit(1)).alias("w")), "template-spread")
    # A line with support of its own goes; only lines of its leaf without it need more than counts.
    sure, weak = F.col("w") >= _support(), F.col("w") < _support()
    leaves = spread.groupBy("leaf").agg(F.sum("w").alias("_w"), F.first("n").alias("n"), F.count_if(weak).alias("_weak"))
    # Written first, so that their size is known before lines of all leaves would be shuffled to meet them.
    leaves = materialise(leaves.where((F.col("_w") >= _support()) & (F.col("_weak") > 0)).select("leaf"), "template-leaves")
    open_lines = materialise(spread.join(leaves, "leaf"), "template-open")
    # A line's text once, however many documents share it, and only then the join.
    texts = _lines(source, "line").join(leaves, "leaf", "left_semi").select(*LINE, "line").distinct()
    kept = materialise(open_lines.join(texts, LINE), "template-lines")
    made = materialise(_templates(kept), "template-made")
    discard(leaves, open_lines, kept)

    name = ["leaf", "p", "q"]
    alone = made.where(sure).select(*name).distinct()
    others = made.where(weak).join(alone, name, "left_anti")
    met = seen.select("row", *LINE).join(others, LINE)  # each of these lines is in few documents
    enough = met.select("row", "n", *name).distinct().groupBy("n", *name).agg(F.count(F.lit(1)).alias("docs"))
    good = alone.unionByName(enough.where(F.col("docs") >= _support()).select(*name))
    drops = spread.where(sure).select(*LINE, "w").unionByName(made.where(weak).join(good, name).select(*LINE, "w"))
    drops = materialise(drops, "template-drops")
    discard(spread, made)
    found = join_groups(seen.select("row", *LINE), drops, LINE, "w", total)
    return found.groupBy("row").agg(F.collect_set(F.struct(*LINE)).alias("drops"))


def drop_recurring_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text, n_lines, n_dropped) per row, text without the lines that recur."""
    keyed, key = row_keyed(docs)
    source = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    drops = materialise(recurring_lines(source.select("row", "text")), "template-rows")
    # Steps pass structs on, so that no lambda refers to a derived column: such a column would be
    # inlined and evaluated again for every line.
    stay = F.filter(_hashed_lines(), lambda s: ~F.array_contains("drops", s.k))
    rebuilt = F.transform(
        F.array(stay), lambda k: F.struct(F.array_join(F.transform(k, lambda s: s.raw), "\n").alias("text"), F.size(k).alias("n"))
    )
    few = drops.where(F.size("drops") <= FEW)
    joined = source.join(few, "row", "left").withColumn("_new", F.when(F.col("drops").isNotNull(), F.get(rebuilt, F.lit(0))))
    many = materialise(drops.where(F.size("drops") > FEW), "template-many")
    if many.limit(1).count():
        long = materialise(_rebuilt(source, many), "template-long")
        joined = joined.join(long, "row", "left").withColumn("_new", F.coalesce("_long", "_new"))
    n_lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return joined.select(
        "doc_id",
        F.coalesce("_new.text", "text").alias("text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(n_lines - F.col("_new.n"), F.lit(0)).cast("long").alias("n_dropped"),
    )


#: Lines to drop that are looked up one by one for each line of a text; with more, lines meet them by a join.
FEW = 64


def _hashed_lines() -> Column:
    """The text's lines as (raw, k: the hashes of the masked line)."""
    lines = F.transform(F.split("text", "\n", -1), lambda x: F.struct(x.alias("raw"), _mask(_flat(x)).alias("line")))
    return F.transform(lines, lambda s: F.struct(s.raw.alias("raw"), F.struct(*_hashes(s.line)).alias("k")))


def _rebuilt(source: DataFrame, drops: DataFrame) -> DataFrame:
    """(row, _long: struct<text, n>) of texts with many lines to drop: each line meets them by its hashes."""
    lines = source.join(drops.select("row"), "row", "left_semi").select("row", F.posexplode(_hashed_lines()).alias("pos", "s"))
    gone = drops.select("row", F.explode("drops").alias("_k")).select("row", "_k.h", "_k.g", F.lit(True).alias("gone"))
    met = lines.select("row", "pos", "s.raw", "s.k.h", "s.k.g").join(gone, ["row", "h", "g"], "left")
    kept = met.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("gone").isNull(), F.struct("pos", "raw")))).alias("k"))
    return kept.select("row", F.struct(F.array_join(F.transform("k", lambda s: s.raw), "\n").alias("text"), F.size("k").alias("n")).alias("_long"))


def op4_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = drop_recurring_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
    )


_NEEDED = "CASE " + " ".join(f"WHEN n >= {least} THEN {docs}" for least, docs in SUPPORT) + " END"
OP4_SQL = rf"""
WITH raw AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw,
    unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS no FROM documents
), flat AS (
  SELECT doc_id, no, raw,
    regexp_replace(regexp_replace(raw, '[ \t\r\f\x0B]+', ' ', 'g'), '^ | $', '', 'g') AS flat FROM raw
), line AS (
  SELECT doc_id, no, regexp_replace(flat, '[^ 0-9]*[0-9][^ ]*', '{VARIABLE}', 'g') AS line FROM flat WHERE flat <> ''
), l AS (
  SELECT *, string_split(line, ' ') AS t, len(string_split(line, ' ')) AS n FROM line
), w AS (
  SELECT line, t, n, n || chr(31) || array_to_string(t[1:{DEPTH}], chr(31)) AS leaf, count(DISTINCT doc_id) AS w FROM l GROUP BY ALL
), tok AS (
  SELECT leaf, n, line, w, pos, t[pos] AS token FROM w, unnest(range({DEPTH + 1}, n + 1)) AS r(pos) WHERE t[pos] <> '{VARIABLE}'
), const AS (
  SELECT leaf, pos, token FROM tok GROUP BY leaf, n, pos, token HAVING sum(w) >= {_NEEDED}
), fixed AS (
  SELECT line, list(tok.token ORDER BY pos) AS tokens, list(pos ORDER BY pos) AS poss FROM tok JOIN const USING (leaf, pos, token) GROUP BY line
), made AS (
  SELECT line, leaf, n, coalesce(tokens, []) AS tokens, coalesce(poss, []) AS poss FROM w LEFT JOIN fixed USING (line)
  WHERE 3 * (len(list_filter(t[{DEPTH + 1}:], lambda x: x <> '{VARIABLE}')) - coalesce(len(poss), 0)) <= greatest(n - {DEPTH + 1}, 0)
), good AS (
  SELECT leaf, tokens, poss FROM made JOIN l USING (line, n) GROUP BY leaf, n, tokens, poss HAVING count(DISTINCT doc_id) >= {_NEEDED}
), gone AS (SELECT doc_id, no FROM l JOIN made USING (line) JOIN good USING (leaf, tokens, poss)),
out AS (
  SELECT raw.doc_id, count(*) AS n_lines, count(gone.no) AS n_dropped,
    coalesce(string_agg(CASE WHEN gone.no IS NULL THEN raw.raw END, chr(10) ORDER BY raw.no), '') AS text
  FROM raw LEFT JOIN gone ON raw.doc_id = gone.doc_id AND raw.no = gone.no GROUP BY raw.doc_id
)
SELECT doc_id, n_lines, n_dropped, length(text) AS n_chars, sha256(text) AS text_sha256 FROM out
"""
