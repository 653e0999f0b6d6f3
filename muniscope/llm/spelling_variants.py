"""Spelling variants by anagram hashing.

A word's key is the sum of its letters' code points to the fifth power (modulo the prime 2^61 - 1, so that no length overflows):
words with the same letters have the same key. A key less the power of one of its letters is a *remainder*. Two words differ by
one removed or added letter only if a remainder of the longer one is the key of the shorter one, and by one exchanged letter only
if they have a remainder in common. Both are equi-joins of numbers on distinct keys, of which each meets a few hundred
others at most, an alphabet's worth for each of its letters; they leave those remainders that can matter.

Then letter order is verified: words are taken apart at the letters whose remainder matters, and two words are near if
what is left is the same text, for an exchange at the same position. That too is an equality, so no group of anagrams, however
large, is compared pair by pair: words that share one rest and position are at most as many as there are letters. Of each such group
every member needs only its size and its two first words.

Words are counted in each task before they meet. A form is the near word with the most occurrences, if it has ten times as
many; forms are followed by pointer jumping, in rounds that grow with the logarithm of the longest chain.

Defined results: null and empty texts have no words; a null id counts as the empty text in the checksum of ``damaged``; repeated rows
count each; an empty table gives an empty result; other columns are not read. Rests of words above LONG letters
are compared by SHA-256.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_arrow, discard, give_back, materialise, record_batch, table, utf8

LEAST_LETTERS, LEAST_COUNT, TIMES = 7, 2, 10
POWER, PRIME = 5, (1 << 61) - 1
LONG = 64
#: Distinct words a task holds before it hands their counts on.
HELD = 100_000
WORD = re.compile("[A-Za-zÀ-ÿ]{%d,}" % LEAST_LETTERS)  # a shorter run cannot become a word


def damaged(doc_id: int | None, word: str) -> str:
    """The word without its code point h % length, where 31 divides h, the crc32 of ``<doc_id>:<word>``."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 31:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


COUNTS = pa.schema([("word", pa.string()), ("n", pa.int64())])


def count_words(docs: DataFrame, change: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """(word, n): words of LEAST_LETTERS letters at least that occur LEAST_COUNT times or more in ``text``.

    A-Z are lower-cased; ``change(doc_id, word)`` may put another word in a word's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                mine = Counter(WORD.findall(raw.lower().decode("utf-8", "replace")))  # bytes.lower() changes A-Z only
                for word, n in mine.items():
                    word = change(doc_id, word) if change else word
                    if len(word) >= LEAST_LETTERS:
                        held[word] += n
                if len(held) > HELD:
                    yield record_batch(COUNTS, list(held), list(held.values()))
                    held.clear()
        if held:
            yield record_batch(COUNTS, list(held), list(held.values()))
        give_back()

    bound_arrow(docs.sparkSession)
    parts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("b")).mapInArrow(run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def letters(word: str = "word") -> Column:
    return F.filter(F.split(word, ""), lambda c: c != "")


def power(letter: Column) -> Column:
    """A letter's code point to the fifth power: below 2^40 in the alphabet at hand."""
    at = F.ascii(letter).cast("long")
    return at * at * at * at * at


def anagram_key(word: str = "word") -> Column:
    return F.aggregate(letters(word), F.lit(0).cast("long"), lambda acc, c: (acc + power(c)) % PRIME)


def _rest(p: Column) -> Column:
    """The word without its letter at position p (from 1)."""
    rest = F.concat(F.substring("word", F.lit(1), p - 1), F.substring("word", p + 1, F.length("word")))
    return F.when(F.length("word") <= LONG, rest).otherwise(F.sha2(rest, 256))


def _first_two(parts: DataFrame, key: list[str]) -> DataFrame:
    """(word, near, best) of each member of the groups of equal ``key`` and several words, at most an alphabet's worth."""
    group = parts.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("m"), "word"))).alias("g")).where(F.size("g") > 1)
    one, two = F.get("g", F.lit(0)), F.get("g", F.lit(1))
    each = group.select(F.explode("g").alias("x"), one.alias("one"), two.alias("two"), (F.size("g") - 1).cast("long").alias("near"))
    return each.select("x.word", "near", F.when(F.col("x.word") == F.col("one.word"), F.col("two")).otherwise(F.col("one")).alias("best"))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best: struct<m, word>) for every word of (word, n) that has near words.

    best is the near word of most occurrences (m: their number, negative), of several the first in code-point order."""
    keyed = materialise(words.select("word", "n", anagram_key().alias("key")), "variant-words")
    kinds = keyed.select("key", F.explode(F.array_distinct(letters())).alias("letter")).distinct()
    remainder = F.pmod(F.col("key") - power(F.col("letter")), F.lit(PRIME))
    kinds = materialise(kinds.withColumn("r", remainder), "variant-keys")
    # Remainders that several keys share (exchange), and those that are a key themselves (removal, addition).
    shared = kinds.groupBy("r").agg(F.count_distinct("key").alias("k")).where("k > 1").select("r", F.lit(True).alias("shared"))
    keys = keyed.select(F.col("key").alias("r")).distinct().withColumn("whole", F.lit(True))
    useful = kinds.join(shared, "r", "left").join(keys, "r", "left").where("shared OR whole")
    apart = keyed.join(useful, "key").select("word", "n", "r", "letter", letters().alias("c"), F.coalesce("shared", F.lit(False)).alias("shared"), F.coalesce("whole", F.lit(False)).alias("whole"))
    places = F.filter(F.sequence(F.lit(1), F.size("c")), lambda p: F.get("c", p - 1) == F.col("letter"))
    cut = apart.select("word", "n", "r", "shared", "whole", "letter", "c", F.explode(places).alias("p"))
    # In a row of equal letters each removal gives the same word: the first one stands for all.
    first = (F.col("p") == 1) | (F.get("c", F.col("p") - 2) != F.col("letter"))
    cut = cut.select("word", "n", "r", "p", "shared", (F.col("whole") & first).alias("whole"), _rest(F.col("p")).alias("rest"))
    cut = materialise(cut.where("shared OR whole"), "variant-rests")
    exchanged = _first_two(cut.where("shared"), ["r", "p", "rest"])
    whole = F.when(F.length("word") <= LONG, F.col("word")).otherwise(F.sha2("word", 256))
    short = keyed.select(F.col("word").alias("short"), F.col("n").alias("short_n"), F.col("key").alias("r"), whole.alias("rest"))
    met = cut.where("whole").join(short, ["r", "rest"])
    shorter = met.select("word", F.lit(1).cast("long").alias("near"), F.struct((-F.col("short_n")).alias("m"), F.col("short").alias("word")).alias("best"))
    longer = met.select(F.col("short").alias("word"), F.lit(1).cast("long").alias("near"), F.struct((-F.col("n")).alias("m"), "word").alias("best"))
    found = exchanged.unionByName(shorter).unionByName(longer)
    found = materialise(found.groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best")), "variant-near")
    discard(keyed, kinds, cut)
    return found


def roots(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form) without cycles: the last form that is reached."""
    state = materialise(links.select("word", F.col("form").alias("root")), "variant-roots")
    while True:
        up = state.select(F.col("word").alias("_w"), F.col("root").alias("_up"))
        met = state.join(up, state["root"] == up["_w"], "left")
        after = materialise(met.select("word", F.coalesce("_up", "root").alias("root"), F.col("_up").isNotNull().alias("moved")), "variant-roots")
        discard(state)
        state = after.select("word", "root")
        if not after.where("moved").limit(1).count():
            return state


def spelling_variants(words: DataFrame, times: int = TIMES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of (word, n)."""
    near = near_words(words)
    joined = words.join(near, "word", "left")
    much = -F.col("best.m") >= times * F.col("n")
    judged = joined.select(
        "word", F.when(much, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(much, -F.col("best.m")).alias("form_n"),
    )
    judged = materialise(judged, "variant-forms")
    last = roots(judged.where("form IS NOT NULL"))
    return judged.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialise(count_words(table(spark, sf_dir, "documents"), damaged), "variant-counts")
    return spelling_variants(words)
