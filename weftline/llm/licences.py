"""Licence scans: Dice coefficient of word bigrams with licence templates.  DataFrame operations only.

A unit is a line of a text, a run of lines, the whole text, or a window of words within or across lines; templates are
notices and full licence texts.  With a and b distinct bigrams, of which s are shared, Dice's 2s/(a+b) can reach t only
where s is at least b*t/(2-t), as a is at least s.  A text's bigrams are looked up in the templates' once, and only
templates of which so many occur in the whole text are compared with its units.

A window begins and ends with a shared bigram, and counts as at least as wide as its template: else a piece of the
template would look like the whole.  Runs of consecutive lines are units by their own width.  Both are sought outside
lines that are units themselves; of those that overlap the best counts.
"""

from __future__ import annotations

import math
import re
from functools import cache
from importlib import resources

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import ascii_lower

LEAST = 0.8
#: What stands between words, after A-Z has been lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Licence notices as their licences give them.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "This project is licensed under the terms of the MIT license.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        'distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "agpl-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
        "You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
    "bsd-3-clause-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def words_of(col: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(col), BETWEEN), "")


@cache
def full_texts() -> dict[str, str]:
    """Full licence texts, by license_id."""
    folder = resources.files(__package__) / "licence_texts"
    return {f.name.removesuffix(".txt"): f.read_text() for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def bigrams(text: str) -> list[str]:
    """The distinct bigrams of a template, sorted."""
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", "".join(c.lower() if c.isascii() else c for c in text))
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:], strict=False)})


def _let(value: str, name: str, body: str) -> str:
    """body with name standing for value, which is computed once: as a lambda's argument."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _candidates(known: dict[str, list[str]], least: float) -> str:
    """SQL: of the words lw by line, an array of one struct with all bigrams g and the templates c that have enough hits, or none."""
    quoted = {k: ", ".join(f"'{g}'" for g in v) for k, v in known.items()}
    every = ", ".join(f"'{g}'" for g in sorted({g for v in known.values() for g in v}))
    words = "flatten(transform(lw, (x, i) -> transform(x, y -> named_struct('w', y, 'l', i))))"
    pairs = "if(size(w) < 2, array(), transform(sequence(0, size(w) - 2), p -> named_struct('p', p, 'a', w[p].l, 'b', w[p + 1].l, 'g', concat(w[p].w, ' ', w[p + 1].w))))"
    sized = [(k, len(v), math.ceil(len(v) * least / (2 - least) - 1e-9)) for k, v in known.items()]
    each = ", ".join(f"named_struct('license_id', '{k}', 'size', {n}, 'need', {need}, 'hits', filter(h, x -> x.g in ({quoted[k]})))" for k, n, need in sized)
    enough = f"filter(array({each}), c -> size(c.hits) >= c.need and size(array_distinct(c.hits.g)) >= c.need)"
    some = _let(f"filter(g, x -> x.g in ({every}))", "h", f"if(size(h) < {min(x[2] for x in sized)}, array(), {enough})")
    made = _let(words, "w", _let(pairs, "g", f"named_struct('g', g, 'c', {some})"))
    return f"filter(array({made}), x -> size(x.c) > 0)"


def _windows(least: float) -> str:
    """SQL: of the bigrams g in order (at: number, before: where it stood before, first and last of a line, hit) and the numbers
    ps of the hits, an array of the windows and runs of lines that are units: b, e, dice."""
    wide = "2 * t.s / (c.size + greatest(t.own, c.size))"
    exact = "2 * t.s / (c.size + t.own)"
    counted = "named_struct('own', t.own + int(x.before < b), 's', t.s + int(x.hit and x.before < b), 'e', t.e, 'dice', t.dice)"
    here = f"greatest(if(x.hit, {wide}, 0.0D), if(q[b].first and x.last, {exact}, 0.0D))"
    kept = "if(d > t.dice, named_struct('own', t.own, 's', t.s, 'e', x.p, 'dice', d), t)"
    step = _let(counted, "t", _let(here, "d", kept))
    best = f"aggregate(slice(q, b + 1, size(q)), named_struct('own', 0, 's', 0, 'e', -1, 'dice', 0.0D), (t, x) -> {step})"
    # With fewer hits from here on than needed, no window begins.
    begins = "transform(filter(q, x -> (x.hit or x.first) and x.p <= ps[size(ps) - c.need]), x -> x.p)"
    found = f"filter(transform({begins}, b -> {_let(best, 'z', 'named_struct(\'b\', b, \'e\', z.e, \'dice\', z.dice)')}), x -> x.dice >= {least})"
    joined = "if(size(u) = 0 or x.b > element_at(u, -1).e, array_append(u, x), if(x.dice > element_at(u, -1).dice, array_append(slice(u, 1, size(u) - 1), x), u))"
    return f"aggregate({found}, cast(array() as array<struct<b: int, e: int, dice: double>>), (u, x) -> {joined})"


def scan(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id, license_id, units, dice: per document and licence with a unit of `least` or more, how many such
    units there are and the best coefficient.

    A text of one line is one unit.  Null and empty texts find nothing.  Rows with one doc_id are
    reported together, and equal lines in the same place of such rows as one unit.
    """
    known = {k: bigrams(v) for k, v in (TEMPLATES | full_texts()).items()}
    text = F.coalesce("text", F.lit(""))
    lines = F.split(text, "\n", -1)
    # What is computed once is a lambda's argument or a generator's.
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), lines.alias("lines"), F.transform(lines, words_of).alias("lw"))
    rows = rows.select("doc_id", "th", "lines", "lw", F.explode(F.expr(_candidates(known, least))).alias("x"))
    rows = rows.select("doc_id", "th", "lines", "lw", F.col("x.g").alias("g"), F.explode("x.c").alias("c"))
    # Lines with hits, and the whole text.
    own = _let("lw[i]", "v", "size(array_distinct(transform(sequence(0, size(v) - 2), p -> concat(v[p], ' ', v[p + 1]))))")
    shared = "size(array_distinct(filter(c.hits, y -> y.a = i and y.b = i).g))"
    numbers = "array_distinct(transform(filter(c.hits, x -> x.a = x.b), x -> x.a))"
    line = f"named_struct('unit', bigint(i), 'h', xxhash64(lines[i]), 'dice', 2 * {shared} / (c.size + {own}))"
    units = f"filter(transform({numbers}, i -> {line}), x -> x.dice >= {least})"
    whole = "if(size(lines) > 1, 2 * size(array_distinct(c.hits.g)) / (c.size + size(array_distinct(g.g))), 0.0D)"
    rows = rows.select("doc_id", "th", "lines", "g", "c", F.explode(F.expr(f"array(named_struct('units', {units}, 'whole', {whole}))")).alias("x"))
    # Hits outside of those lines, if they are enough.
    free = "filter(c.hits, x -> not array_contains(u, bigint(x.a)) and not array_contains(u, bigint(x.b)))"
    rest = f"if(x.whole >= {least}, array(), {_let('transform(x.units, y -> y.unit)', 'u', free)})"
    rest = _let(rest, "r", "if(size(array_distinct(r.g)) < c.need, cast(array() as array<int>), r.p)")
    rows = rows.select("doc_id", "th", "lines", "g", "c", "x", F.explode(F.expr(f"array({rest})")).alias("ps"))
    before = _let(
        "array_sort(transform(g, y -> struct(y.g as g, y.p as p)))", "o",
        "array_sort(transform(o, (y, i) -> named_struct('p', y.p, 'before', if(i > 0 and o[greatest(i - 1, 0)].g = y.g, o[greatest(i - 1, 0)].p, -1))))",
    )
    at = "y.p = 0 or g[greatest(y.p - 1, 0)].a != g[y.p].a", "y.p = size(g) - 1 or g[least(y.p + 1, size(g) - 1)].b != g[y.p].b"
    marked = f"transform({before}, y -> named_struct('p', y.p, 'before', y.before, 'first', {at[0]}, 'last', {at[1]}, 'hit', array_contains(ps, y.p)))"
    windows = f"if(size(ps) = 0, array(), {_let(marked, 'q', _windows(least))})"
    windows = f"transform({windows}, y -> named_struct('unit', bigint(size(lines) + 1 + y.b), 'h', th, 'dice', y.dice))"
    entire = f"filter(array(named_struct('unit', bigint(size(lines)), 'h', th, 'dice', x.whole)), y -> y.dice >= {least})"
    found = rows.select("doc_id", F.col("c.license_id").alias("license_id"), F.explode(F.expr(f"concat(x.units, {entire}, {windows})")).alias("u"))
    found = found.select("doc_id", "license_id", "u.unit", "u.h", "u.dice").distinct()
    return found.groupBy("doc_id", "license_id").agg(F.count(F.lit(1)).alias("units"), F.round(F.max("dice"), 6).alias("dice"))
