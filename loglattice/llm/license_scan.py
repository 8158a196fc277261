"""Licence scan: normalised lines and whole texts against templates, by Dice over word bigrams.

One projection of built-in functions; no shuffle, no Python. A text is lower-
cased and what is neither letter nor digit becomes a blank. Its units are its
lines and, if it has several, the whole text. The number of a unit's bigrams is
one less than its words, so the bound

    Dice >= t  only if  t / (2 - t) <= bigrams of unit / bigrams of template <= (2 - t) / t

leaves out templates by their size before any bigram is made; a template that
shares no bigram with the unit ends there; the rest get the coefficient, with
repeated bigrams counted as often as both have them.

A notice that is wrapped over lines or stands within a paragraph is found as a
span: any run of neighbouring words of the whole text that has as many words as
the template at least (or is the whole text, where that is shorter). Of all
spans the best counts, exactly: a best span starts and ends with a bigram of the
template, so for every such start the bigrams that follow are read once, each
counted while the template has it that often. Texts without any of a template's
telling words, too short ones, and those with too few of its distinct bigrams
cannot reach the limit and end before.

Defined results: a null or empty text matches nothing (licence null, dice 0);
``licence`` and ``dice`` are those of the best unit or span, ``licences`` names
all that any unit or span matches, in the alphabet's order, a licence that a unit
matches keeps the coefficient of its best unit, and ``lines`` counts units only,
so it is 0 where a notice stands in no line of its own;
texts of any length are read whole; of equally near templates the
alphabetically last counts; repeated rows give repeated results; further
columns are not looked at.
"""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICE = 0.8

#: Sentences of notices, by SPDX identifier: the templates of the SQL, for lines, whole texts and spans.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}

#: Notices as published and whole, for spans: further paragraphs that stand alone. The texts of licences are in ``licences``.
NOTICES = {
    "Apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "MIT": ['Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'],
    "GPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <http://www.gnu.org/licenses/>."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
}


def published() -> dict[str, list[str]]:
    """``NOTICES`` and the licences themselves, from the first word of the terms to their end."""
    found = {name: list(texts) for name, texts in NOTICES.items()}
    for path in sorted((Path(__file__).parent / "licences").glob("*.txt")):
        found.setdefault(path.stem, []).append(path.read_text(encoding="utf-8"))
    return found


def normalised(text: str) -> list[str]:
    """The words of a template, as the scan makes those of a text."""
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def template_rows(templates: dict[str, list[str]]) -> list[tuple[str, int, list[tuple[str, int]]]]:
    """(licence, number of bigrams, [(bigram, times)]) of each template."""
    rows = []
    for name, texts in templates.items():
        for text in texts:
            words = normalised(text)
            bigrams = Counter(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))
            if not bigrams:
                raise ValueError(f"a template of {name} has fewer than two words")
            rows.append((name, sum(bigrams.values()), sorted(bigrams.items())))
    return rows


def least_overlap(n: int, dice: float) -> int:
    """The bigrams that a span has to share with a template of ``n``: it has as many itself, or is shorter and whole."""
    return math.ceil(n * dice / (2 - dice) - 1e-9)


#: Words of licences, tried first as those without which a text has no notice.
TELLING = ["license", "licensed", "licensor", "licenses", "software", "redistribution", "copyright", "commons", "gnu", "warranty"]
#: Words of all texts, tried last.
COMMON = set("a an and any are as at be by can for from have if in is it its may not of on one or other such that the this to under use which with without you your".split())


def telling_words(templates: dict[str, list[str]], dice: float) -> list[str]:
    """Words of which every span that matches any template has one.

    Of each template so many are taken that the bigrams without them are fewer
    than the least overlap.
    """
    chosen: list[str] = []
    for texts in templates.values():
        for text in texts:
            words = normalised(text)
            rest = list(zip(words, words[1:], strict=False))
            need = least_overlap(len(rest), dice)
            rest = [b for b in rest if not set(b) & set(chosen)]
            often = Counter(words)
            for word in [*(w for w in TELLING if w in often), *sorted(often, key=lambda w: (w in COMMON, -often[w], w))]:
                if len(rest) < need:
                    break
                if any(word in b for b in rest):
                    chosen.append(word)
                    rest = [b for b in rest if word not in b]
    return chosen


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _literal(templates: dict[str, list[str]], dice: float) -> str:
    text, rows = _text, []
    for name, n, bigrams in template_rows(templates):
        keys = ", ".join(text(b) for b, _ in bigrams)
        times = ", ".join(str(k) for _, k in bigrams)
        low, high = n * dice / (2 - dice), n * (2 - dice) / dice
        need, sums = least_overlap(n, dice), 0
        for few, k in enumerate(sorted((k for _, k in bigrams), reverse=True), 1):  # noqa: B007
            sums += k
            if sums >= need:
                break
        rows.append(f"named_struct('name', {text(name)}, 'n', {n}, 'low', {low!r}D, 'high', {high!r}D, 'keys', array({keys}), 'times', array({times}), 'need', {need}, 'few', {few})")
    return f"array({', '.join(rows)})"


def _spans(own: str, templates: dict[str, list[str]], dice: float) -> str:
    """An array of (dice, name): of each template that has one, the best span of the bigrams ``own``.

    ``members`` are (number of the bigram in the template, place), ``ranked`` are
    (place, place of the bigram's occurrence before which it is one too many). A
    start counts if ``need`` members follow within the longest span that can match.
    """
    members = f"filter(transform({own}, (b, i) -> struct(int(array_position(t.keys, b)) AS k, i AS i)), x -> x.k > 0)"
    ranked = """array_sort(transform(s, (x, j) -> struct(x.i AS i,
        coalesce(if(get(s, j - get(t.times, x.k - 1)).k = x.k, get(s, j - get(t.times, x.k - 1)).i, -1), -1) AS q)))"""
    starts = "filter(transform(p, (x, j) -> struct(x.i AS i, get(p, j + t.need - 1).i - x.i < t.high AS near, j + 1 AS j)), x -> x.near)"
    useful = "filter(slice(p, a.j, int(t.high) + 1), y -> y.q < a.i AND y.i - a.i < t.high)"
    score = f"array_max(transform({useful}, (y, r) -> 2D * (r + 1) / (t.n + greatest(y.i - a.i + 1, least(t.n, size({own}))))))"
    best = f"array_max(flatten(transform(array(array_sort({members})), s -> flatten(transform(array({ranked}), p -> transform({starts}, a -> {score}))))))"
    fits = f"size({own}) >= t.low AND size(array_intersect({own}, t.keys)) >= t.few"
    return f"filter(transform(filter({_literal(templates, dice)}, t -> {fits}), t -> struct({best} AS dice, t.name AS name)), x -> x.dice >= {dice!r}D)"


def scan_licences(docs: DataFrame, templates: dict[str, list[str]] | None = None, dice: float = DICE) -> DataFrame:
    """doc_id, licence (of the nearest template at ``dice`` or more, else null), dice, lines (units that match), licences (all, by commas)."""
    wider = templates
    if templates is None:
        templates, wider = TEMPLATES, {k: [*TEMPLATES.get(k, []), *published().get(k, [])] for k in TEMPLATES | published()}
    sizes = [n for _, n, _ in template_rows(templates)]
    low, high = min(sizes) * dice / (2 - dice), max(sizes) * (2 - dice) / dice
    known = _literal(templates, dice)
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}\n]+", " "), r" ?\n ?", "\n"))
    units = """
        filter(transform(
            concat(split(bare, '\n'), if(contains(bare, '\n'), array(replace(bare, '\n', ' ')), array())),
            line -> split(regexp_replace(trim(line), ' +', ' '), ' ')), words -> size(words) - 1 BETWEEN {low} AND {high})
    """.format(low=repr(low), high=repr(high))
    telling = " OR ".join(f"contains(text, {_text(f' {w} ')})" for w in telling_words(wider, dice))
    words = "if(told, split(regexp_replace(trim(text), ' +', ' '), ' '), array())"
    pairs_of = "transform(slice(words, 2, greatest(size(words) - 1, 0)), (word, i) -> concat(words[i], ' ', word))"
    bigrams = f"transform(units, words -> {pairs_of})"
    scored = f"""
        transform(pairs, own -> filter(transform(
            filter({known}, t -> size(own) BETWEEN t.low AND t.high AND arrays_overlap(t.keys, own)),
            t -> struct(2D * aggregate(zip_with(t.keys, t.times, (key, k) -> least(k, size(filter(own, b -> b = key)))), 0, (a, b) -> a + b) / (t.n + size(own)) AS dice, t.name AS name)), s -> s.dice >= {dice!r}D))
    """
    spans = f"flatten(transform(whole, own -> {_spans('own', wider, dice)}))"
    found = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), bare.alias("bare"))
        .select("doc_id", F.expr(units).alias("units"), F.expr("concat(' ', replace(bare, '\n', ' '), ' ')").alias("text"))
        .select("doc_id", "units", "text", F.expr(telling).alias("told"))
        .select("doc_id", "units", F.expr(f"array({words})").alias("texts"))
        .select("doc_id", F.expr(bigrams).alias("pairs"), F.expr(f"transform(texts, words -> {pairs_of})").alias("whole"))
        .select("doc_id", F.expr(scored).alias("units"), F.expr(spans).alias("spans"))
        .select("doc_id", F.expr("concat(flatten(units), filter(spans, s -> NOT exists(units, u -> exists(u, h -> h.name = s.name))))").alias("hits"), F.expr("size(filter(units, u -> size(u) > 0))").alias("lines"))
        .select("doc_id", F.expr("array_max(hits)").alias("best"), "lines", F.expr("array_join(array_sort(array_distinct(hits.name)), ',')").alias("licences"))
    )
    return found.select("doc_id", F.col("best.name").alias("licence"), F.coalesce("best.dice", F.lit(0.0)).alias("dice"), "lines", "licences")


def oracle_sql(templates: dict[str, list[str]] | None = None, dice: float = DICE) -> str:
    """The same in DuckDB: units exploded, joined to every template, no size bound."""
    templates = TEMPLATES if templates is None else templates
    values = ",\n".join(
        "('{}', {}, [{}], [{}])".format(name, n, ", ".join("'" + b.replace("'", "''") + "'" for b, _ in bigrams), ", ".join(str(k) for _, k in bigrams))
        for name, n, bigrams in template_rows(templates)
    )
    return f"""
        WITH templates(name, n, keys, times) AS (VALUES {values}),
        bare AS (SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g')) AS bare FROM documents),
        units AS (
            SELECT r, unnest(list_concat(string_split(bare, chr(10)), CASE WHEN contains(bare, chr(10)) THEN [replace(bare, chr(10), ' ')] ELSE [] END)) AS line FROM bare),
        words AS (SELECT r, row_number() OVER () AS u, string_split(regexp_replace(trim(line), ' +', ' ', 'g'), ' ') AS w FROM units),
        pairs AS (SELECT r, u, list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1]) AS own FROM words WHERE len(w) > 1),
        scores AS (
            SELECT r, u, name, 2.0::DOUBLE * list_sum(list_transform(generate_series(1, len(keys)), lambda k: least(times[k], len(list_filter(own, lambda b: b = keys[k]))))) / (n + len(own)) AS dice
            FROM pairs JOIN templates ON list_has_any(own, keys)),
        best AS (
            SELECT r, max(struct_pack(dice := dice, name := name)) AS s, count(DISTINCT u) AS lines, string_agg(DISTINCT name, ',' ORDER BY name) AS licences
            FROM scores WHERE dice >= {dice} GROUP BY r)
        SELECT doc_id, s.name AS licence, coalesce(s.dice, 0.0) AS dice, coalesce(lines, 0)::INT AS lines, coalesce(licences, '') AS licences FROM bare LEFT JOIN best USING (r)
    """
