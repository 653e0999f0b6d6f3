"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment verifies.

Texts and templates are words (runs of 0-9, a-z and characters beyond ASCII, A-Z lower-cased)
and their 5-word shingles. A template of n shingles has the size class c, the least power of two
not below n. For each class a document is cut into blocks of c shingles, and every two neighbouring
blocks are a window, so windows overlap by half. A window that holds m = ceil(CONTAINMENT * n) of
a template's shingles has a Jaccard similarity s of at least m / (2c + n - m) with it. A class has as
many bands, of one minimum hash each, as make (1 - s) ** bands less than MISS for every template
in it: the probability to overlook a template that is there. What the bands retrieve is verified
by exact shingle containment in the window.

Other columns of a table are not read and may have any name.

Defined results: null and empty texts, and texts of fewer words than a shingle, match
nothing; templates need five words; repeated rows give repeated results; an empty table an
empty result. Templates are a parameter; they go to the workers with the task, so
MOST_TEMPLATE_WORDS bounds them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, materialise, record_batch, row_keyed, table, utf8
from .decontam import words_of
from .jaccard_join import mix

SHINGLE = 5
CONTAINMENT = 0.8
MISS = 1e-4
SEGMENT = 1 << 16
FEW = 32
MOST_TEMPLATE_WORDS = 2_000_000

#: Statements and notices as they are commonly written.
TEMPLATES = {
    "Apache-2.0 line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required "
        "by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "BSD notice": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer."
    ),
    "CC-BY line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0 line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA line": "Text is available under the Creative Commons Attribution-ShareAlike License.",
    "GPL-3.0 line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
        "version."
    ),
    "MIT line": "Released under the MIT License.",
    "MIT notice": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "MPL-2.0 notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "Unlicense line": "This is free and unencumbered software released into the public domain.",
}

_U = np.uint64


class _Hashes(dict):
    MOST = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = _Hashes()


def shingle_row(words: list[bytes]) -> np.ndarray:
    """Hashes of the word shingles in order, repeats included."""
    n = len(words) - SHINGLE + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    s = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        s = s * _U(0x100000001B3) + mix(h[i : i + n] + _U(i))
    return mix(s)


def _class(n: int) -> int:
    c = 1
    while c < n:
        c *= 2
    return c


def _bands(n: int) -> int:
    c, m = _class(n), math.ceil(CONTAINMENT * n)
    return math.ceil(math.log(MISS) / math.log(1 - m / (2 * c + n - m)))


def _permuted(row: np.ndarray, bands: int) -> np.ndarray:
    """(bands, shingles): the shingles' upper halves under as many permutations of 32 bits."""
    odd = (mix(np.arange(1, bands + 1, dtype=np.uint64)) >> _U(32)).astype(np.uint32) | np.uint32(1)
    return (row >> _U(32)).astype(np.uint32)[None, :] * odd[:, None]


@dataclass
class SizeClass:
    bands: int
    templates: list[int]
    least: np.ndarray  # (bands, templates): each template's minimum hashes
    keys: np.ndarray  # the same with the band above, sorted, for many templates
    owners: np.ndarray


@dataclass
class Templates:
    names: list[str]
    sets: list[np.ndarray]  # sorted distinct shingles
    classes: dict[int, SizeClass]
    bands: int

    @staticmethod
    def of(texts: dict[str, str]) -> Templates:
        known = {name: np.unique(shingle_row(words_of(text.encode()))) for name, text in sorted(texts.items())}
        names = [name for name, s in known.items() if s.size]
        sets = [known[name] for name in names]
        classes = {}
        for c in sorted({_class(s.size) for s in sets}):
            mine = [i for i, s in enumerate(sets) if _class(s.size) == c]
            bands = max(_bands(sets[i].size) for i in mine)
            least = np.stack([_permuted(sets[i], bands).min(axis=1) for i in mine], axis=1)
            keys = least.astype(np.uint64) | (np.arange(bands, dtype=np.uint64)[:, None] << _U(32))
            order = np.argsort(keys.ravel(), kind="stable")
            classes[c] = SizeClass(bands, mine, least, keys.ravel()[order], np.tile(mine, bands)[order])
        return Templates(names, sets, classes, max((c.bands for c in classes.values()), default=0))


def _retrieve(windows: np.ndarray, size: SizeClass) -> set[tuple[int, int]]:
    """(window, template) with an equal minimum in some band."""
    if len(size.templates) <= FEW:
        return {
            (int(w), t)
            for k, t in enumerate(size.templates)
            for w in np.flatnonzero((windows == size.least[:, k : k + 1]).any(axis=0))
        }
    keys = windows.astype(np.uint64) | (np.arange(size.bands, dtype=np.uint64)[:, None] << _U(32))
    low, high = np.searchsorted(size.keys, keys, "left"), np.searchsorted(size.keys, keys, "right")
    return {
        (int(w), int(t)) for b, w in zip(*np.nonzero(high > low)) for t in size.owners[low[b, w] : high[b, w]]
    }


def scan(text: bytes, templates: Templates) -> list[tuple[str, float, int, int]]:
    """(template, best containment, first and past-the-last word of that window) found in a text."""
    row = shingle_row(words_of(text))
    best: dict[int, tuple[float, int, int]] = {}
    widest = max(templates.classes, default=1)
    segment = max(SEGMENT, widest)
    for at in range(0, row.size if templates.classes else 0, segment):
        least = _permuted(row[at : at + segment + widest], templates.bands)
        c = 1
        while c <= widest:
            if size := templates.classes.get(c):
                windows = least[: size.bands]
                if windows.shape[1] > 1:
                    windows = np.minimum(windows[:, :-1], windows[:, 1:])
                for w, t in _retrieve(windows[:, : segment // c], size):
                    begin = at + w * c
                    inside = np.isin(row[begin : begin + 2 * c], templates.sets[t])
                    share = np.unique(row[begin : begin + 2 * c][inside]).size / templates.sets[t].size
                    if share >= CONTAINMENT and (t not in best or (share, -begin) > (best[t][0], -best[t][1])):
                        best[t] = (float(share), begin, begin + int(np.flatnonzero(inside)[-1]) + SHINGLE)
            # Blocks of the next class: minima of neighbours, an odd last one alone.
            even, odd = least[:, 0::2], least[:, 1::2]
            joined = even.copy()
            joined[:, : odd.shape[1]] = np.minimum(even[:, : odd.shape[1]], odd)
            least = joined
            c *= 2
    return [(templates.names[t], *best[t]) for t in sorted(best)]


SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("licenses", pa.list_(pa.string())),
        ("containment", pa.list_(pa.float64())),
        ("word_begins", pa.list_(pa.int64())),
        ("word_ends", pa.list_(pa.int64())),
    ]
)


FOUND = ["licenses", "containment", "word_begins", "word_ends"]
LISTS = "licenses array<string>, containment array<double>, word_begins array<long>, word_ends array<long>"


def template_blocks(texts: dict[str, str]) -> list[dict[str, str]]:
    """The templates in order of name, in blocks of at most MOST_TEMPLATE_WORDS words, or of one template."""
    blocks: list[dict[str, str]] = [{}]
    held = 0
    for name in sorted(texts):
        n = len(texts[name].split())
        if blocks[-1] and held + n > MOST_TEMPLATE_WORDS:
            blocks.append({})
            held = 0
        blocks[-1][name] = texts[name]
        held += n
    return blocks


def _scan_block(source: DataFrame, texts: dict[str, str]) -> DataFrame:
    """(id, licenses, ...) per row of (id, _b)."""
    templates = Templates.of(texts)

    def rows(batch):
        found = [scan(t, templates) for t in batch.column(1).to_pylist()]
        return record_batch(SCHEMA, batch.column(0), *([[m[i] for m in f] for f in found] for i in range(4)))

    return map_rows(source, rows, f"doc_id long, {LISTS}")


def scan_documents(docs: DataFrame, texts: dict[str, str]) -> DataFrame:
    """(doc_id, licenses, containment, word_begins, word_ends) per row; lists in order of name.

    A task holds one block of templates (see template_blocks). Of several blocks one scans all documents after the other, what
    they find is written, and the lists of a row are united."""
    blocks = template_blocks(texts)
    if len(blocks) == 1:
        return _scan_block(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8().alias("_b")), blocks[0])
    keyed, key = row_keyed(docs)
    source = keyed.select(F.col(key).alias("row"), utf8().alias("_b"))
    found = None
    for k, block in enumerate(blocks):
        part = _scan_block(source, block).withColumnRenamed("doc_id", "row").where(F.size("licenses") > 0)
        part = materialise(part, f"license-{k}")
        found = part if found is None else found.unionByName(part)
    each = found.select("row", F.explode(F.arrays_zip(*FOUND)).alias("m"))
    lists = each.groupBy("row").agg(F.sort_array(F.collect_list("m")).alias("m"))  # one entry a template at most
    none = F.array().cast("array<struct<licenses:string,containment:double,word_begins:long,word_ends:long>>")
    ids = keyed.select(F.col(key).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    met = ids.join(lists, "row", "left").withColumn("m", F.coalesce("m", none))
    return met.select("doc_id", *(F.col(f"m.{c}").alias(c) for c in FOUND))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_documents(table(spark, sf_dir, "documents"), TEMPLATES)
    return found.select(
        "doc_id",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.array_join("licenses", ";").alias("licenses"),
        F.coalesce(F.round(F.array_max("containment"), 6), F.lit(0.0)).alias("best_containment"),
    )


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WORDS = (
    "regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)
OP7_SQL = f"""
WITH tpl(name, body) AS (VALUES {", ".join(f"({_quoted(k)}, {_quoted(v)})" for k, v in TEMPLATES.items())}),
tw AS (SELECT name, {_WORDS.format("body")} AS w FROM tpl),
ts AS (SELECT DISTINCT name, array_to_string(w[pos:pos + 4], ' ') AS s FROM tw, unnest(range(1, len(w) - 3)) AS r(pos)),
size AS (SELECT name, count(*) AS n, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS c FROM ts GROUP BY name),
dw AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
d AS (SELECT doc_id, pos - 1 AS pos, array_to_string(w[pos:pos + 4], ' ') AS s FROM dw, unnest(range(1, len(w) - 3)) AS r(pos)),
hit AS (SELECT d.doc_id, d.s, name, n, pos // c AS block FROM d JOIN ts USING (s) JOIN size USING (name)),
win AS (SELECT *, block AS win FROM hit UNION ALL SELECT *, block - 1 FROM hit WHERE block > 0),
share AS (SELECT doc_id, name, win, count(DISTINCT s) / any_value(n) AS share FROM win GROUP BY doc_id, name, win),
best AS (SELECT doc_id, name, max(share) AS share FROM share GROUP BY doc_id, name HAVING max(share) >= {CONTAINMENT}),
found AS (SELECT doc_id, count(*) AS n, string_agg(name, ';' ORDER BY name) AS names, round(max(share), 6) AS share FROM best GROUP BY doc_id)
SELECT dw.doc_id, coalesce(n, 0) AS n_licenses, coalesce(names, '') AS licenses, coalesce(share, 0.0) AS best_containment
FROM dw LEFT JOIN found USING (doc_id)
"""
