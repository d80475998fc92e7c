"""License scans with DataFrame functions alone.

A text's words (lower-case runs of ASCII letters and digits) give a hash for
every five-word shingle.  Overlapping windows of shingles are summarised by
MinHash: BANDS bands of one row each, a band being the least hash of a shingle
together with the band's constant.  A template is retrieved if one of
its bands equals a band of a window, and matches if the text holds at least
THRESHOLD of its shingles.

Windows come in two sizes.  A short template (up to SHORT shingles) is looked
for with windows of 4 that step by 2: a shingle is in two windows, and a window
with one shingle of a template that has one collides with probability
1 - (3/4)**24 = 0.999.  Longer templates are looked for with windows of 32 that
step by 16; a window within a template of 200 shingles collides with
probability 0.984, and twelve such windows lie in it.

A text without any anchor word cannot hold THRESHOLD of a template's shingles
(anchors are chosen so that every such share of shingles has one), so it is
answered without windows.  No text is shuffled and nothing grows with the data
but the rows themselves.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .staging import table

N_WORDS, THRESHOLD = 5, 0.8
BANDS = 24
SHORT = 16
#: Window and step in shingles, for short and for long templates.
WINDOWS = ((4, 2), (32, 16))

# fixed values: the wording of common license notices
TEMPLATES: dict[str, str] = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-permission": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}

#: Further usual wordings, which OP7_SQL does not know.
NOTICES: dict[str, str] = {
    "agpl-3.0-notice": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "apache-2.0-short": "Licensed under the Apache License 2.0",
    "bsd-short": "licensed under the BSD License",
    "bsd-2-clause-short": "licensed under the BSD 2-Clause License",
    "bsd-3-clause-short": "licensed under the BSD 3-Clause License",
    "cc-by-sa-4.0": "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-sa-4.0-short": "licensed under CC BY-SA 4.0",
    "cc-by-4.0-short": "licensed under CC BY 4.0",
    "cc0-1.0-notice": "waived all copyright and related or neighboring rights",
    "gpl-2.0-short": "GNU General Public License, version 2",
    "isc-short": "licensed under the ISC License",
    "lgpl-notice": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "lgpl-short": "licensed under the GNU Lesser General Public License",
    "agpl-3.0-short": "licensed under the GNU Affero General Public License",
    "mit-short": "Licensed under the MIT License",
    "mit-available": "available under the MIT License",
    "mit-terms": "under the terms of the MIT License",
    "mpl-2.0-short": "licensed under the Mozilla Public License 2.0",
    "unlicense-notice": "This is free and unencumbered software released into the public domain",
}


def all_templates() -> dict[str, str]:
    """TEMPLATES, NOTICES, and the full texts of license_texts as "name-text"."""
    full = {f"{f.stem}-text": f.read_text(encoding="utf-8") for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
    return TEMPLATES | NOTICES | full


#: A tag of four words has no shingle; it names its license itself.
SPDX = r"(?i)SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]

    @property
    def shingles(self) -> list[tuple[str, ...]]:
        return list(dict.fromkeys(self.words[i : i + N_WORDS] for i in range(len(self.words) - N_WORDS + 1)))


def templates_of(texts: dict[str, str]) -> list[Template]:
    """Templates by name; each needs five words at least."""
    out = [Template(name, tuple(re.findall(r"[a-z0-9]+", text.lower()))) for name, text in sorted(texts.items())]
    if short := [t.name for t in out if len(t.words) < N_WORDS]:
        raise ValueError(f"templates with fewer than {N_WORDS} words: {', '.join(short)}")
    return out


def anchors_for(templates: list[Template]) -> list[str]:
    """Words of which a text must have one to hold THRESHOLD of any template's shingles."""
    chosen: list[str] = []
    vocabulary = {w for t in templates for w in t.words}
    covered: set[str] = set()  # words that have an anchor in them
    for t in templates:
        shingles = t.shingles
        left = [s for s in shingles if covered.isdisjoint(s)]
        # the shingles without an anchor must be too few to match alone
        while len(left) >= THRESHOLD * len(shingles):
            within = Counter(w for s in left for w in set(s))
            best = max(within, key=lambda w: (min(len(w), 7), within[w], w))
            chosen.append(best)
            covered.update(w for w in vocabulary if best in w)
            left = [s for s in left if covered.isdisjoint(s)]
    return chosen


def _constants(scale: int) -> list[int]:
    rng = random.Random(1000 + scale)
    return [rng.getrandbits(63) for _ in range(BANDS)]


def _any(conditions: list[Column]) -> Column:
    """Whether any condition holds, as a tree of little depth."""
    if len(conditions) < 2:
        return conditions[0] if conditions else F.lit(False)
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a function in it uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of all runs of five words; an empty array if there are fewer words."""
    def runs(w: Column) -> Column:
        room = F.size(w) - (N_WORDS - 1)
        hashed = F.transform(F.sequence(F.lit(1), room), lambda i: F.xxhash64(*(F.element_at(w, i + k) for k in range(N_WORDS))))
        return F.when(room >= 1, hashed).otherwise(F.array().cast("array<bigint>"))

    return _let(words, runs)


def _bands(shingles: Column, scale: int) -> Column:
    """Band hashes of all windows of one size."""
    window, step = WINDOWS[scale]
    constants = F.array(*(F.lit(c) for c in _constants(scale)))

    def windows(own: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(step))
        return F.flatten(F.transform(starts, lambda s: _let(F.slice(own, s, window), lambda part: F.transform(constants, lambda c: _band(part, c, scale)))))

    return _let(shingles, windows)


def _band(part: Column, c: Column, scale: int) -> Column:
    return F.xxhash64(F.lit(scale), c, F.array_min(F.transform(part, lambda x: F.xxhash64(x, c))))


def _template_bands(constants: Column, scale: int) -> Column:
    return F.transform(constants, lambda c: _band(F.col("s"), c, scale))


def _signed(spark: SparkSession, templates: list[Template]) -> list[tuple[str, list[int], list[int]]]:
    """(name, shingle hashes, band hashes) of every template: a few rows, computed by the same expressions."""
    rows = spark.createDataFrame([(t.name, list(t.words), int(len(t.shingles) > SHORT)) for t in templates], "name string, words array<string>, scale int")
    own = F.array_distinct(_shingles(F.col("words")))
    constants = [F.array(*(F.lit(c) for c in _constants(k))) for k in range(2)]
    bands = [_template_bands(constants[k], k) for k in range(2)]
    signed = rows.withColumn("s", own).withColumn("b", F.when(F.col("scale") == 0, bands[0]).otherwise(bands[1]))
    return [(r["name"], list(r["s"]), list(r["b"])) for r in signed.select("name", "s", "b").collect()]


def scan_licenses(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_licenses, licenses (names by order, joined by commas) for every row of ``docs``.

    Without ``texts`` all_templates are looked for, and SPDX tags are reported
    as "spdx-" and the identifier in small letters (the first of an expression).
    Null text counts as empty and matches nothing, and so does a text of fewer
    than five words.  Repeated rows repeat, a missing id stays missing, extra
    columns are ignored, an empty table gives an empty table.
    """
    templates = templates_of(all_templates() if texts is None else texts)
    signed = _signed(docs.sparkSession, templates)
    # one literal, however long: the cast is folded by the optimizer
    longs = lambda values: F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")
    known = [sorted({b for _, s, bands in signed for b in bands if (len(s) > SHORT) == bool(k)}) for k in range(2)]

    nothing = F.array().cast("array<string>")
    # the catalogue is one literal of the plan, so the expression does not grow with it
    catalogue = F.array(*(F.struct(F.lit(name).alias("name"), longs(own).alias("shingles"), longs(bands).alias("bands"), F.lit(THRESHOLD * len(own) - 1e-9).alias("least")) for name, own, bands in signed))

    def found(own: Column) -> Column:
        hits = F.concat(*(F.array_intersect(_bands(own, k), longs(known[k])) for k in range(2)))
        return _let(hits, lambda h: F.when(F.size(h) > 0, verified(h, own)).otherwise(nothing))

    def verified(hits: Column, own: Column) -> Column:
        # only retrieved templates are verified
        retrieved = F.filter(catalogue, lambda t: F.arrays_overlap(hits, t["bands"]))
        held = F.filter(retrieved, lambda t: F.size(F.array_intersect(t["shingles"], own)) >= t["least"])
        return F.transform(held, lambda t: t["name"])

    text = F.coalesce(F.col("text"), F.lit(""))
    lowered = F.lower(text)
    possible = _any([lowered.contains(a) for a in anchors_for(templates)])
    names = F.when(possible, _let(_shingles(_words(text)), lambda own: F.when(F.size(own) > 0, found(own)).otherwise(nothing))).otherwise(nothing)
    if texts is None:
        tags = F.transform(F.regexp_extract_all(text, F.lit(SPDX), F.lit(1)), lambda t: F.concat(F.lit("spdx-"), F.lower(t)))
        names = F.when(lowered.contains("spdx-license-identifier"), F.array_sort(F.array_union(names, tags))).otherwise(names)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), names.alias("found"))
    return rows.select("doc_id", F.size("found").cast("long").alias("n_licenses"), F.array_join("found", ",").alias("licenses"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ",\n  ".join(f"('{t.name}', '{' '.join(t.words)}')" for t in templates_of(TEMPLATES))
    return f"""
with t(name, words) as (values
  {rows}),
ts as (select name, list_distinct(list_transform(range(1, len(w) - {N_WORDS - 2}), lambda i: array_to_string(w[i:i+{N_WORDS - 1}], ' '))) as s
  from (select name, string_split(words, ' ') as w from t)),
d as (select doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda x: x <> '') as w from documents),
ds as (select doc_id, list_distinct(list_transform(range(1, greatest(len(w) - {N_WORDS - 2}, 1)), lambda i: array_to_string(w[i:i+{N_WORDS - 1}], ' '))) as s from d),
hit as (select doc_id, name from ds join ts on len(list_intersect(ts.s, ds.s)) >= {THRESHOLD} * len(ts.s) - 1e-9)
select d.doc_id, count(name) as n_licenses, coalesce(string_agg(name, ',' order by name), '') as licenses
from d left join hit using (doc_id) group by d.doc_id
"""


OP7_SQL = _sql()
