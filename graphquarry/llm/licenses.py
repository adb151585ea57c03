"""License scan: normalised pieces of a text against licence templates, by the Dice coefficient over word bigrams.

A text is lower-cased, all but letters, digits and line ends become spaces, and its pieces are its lines, its
paragraphs (where there are several) and the whole, and windows of a template's length wherever in the text one of its key
bigrams stands, laid so that the two match there.  A piece of a bigrams and a template of b share i of them
(with multiplicity): the Dice coefficient is 2 i / (a + b).  Exact bounds prune before any bigram is made or compared:

- size: a coefficient of t needs b t / (2 - t) <= a <= b (2 - t) / t;
- anchors: a piece without any of a template's anchor words misses more of its bigrams than t allows;
- keys: a window without any of a template's key bigrams, a few long ones, shares too few of its bigrams;
- common bigrams: a piece with fewer distinct bigrams in common with all templates than any of them needs.

Everything is a column expression over one row: no shuffle, no join, nothing that grows with hot lines or sources.

Null and empty texts, and those without a match, have null licence, score, piece and position, and 0 licences.
Ties: the higher score, then the template that sorts first, then lines before paragraphs before the whole before windows,
then the earlier piece (of the windows of one template only the best counts; their position is that of the first word).  Repeated rows give equal rows; an empty table gives an empty table.  Columns of the input keep their names
and values; n_lines or matches, where one of them has that name, get the name with _1.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

THRESHOLD = 0.8
PIECES = ("line", "paragraph", "text", "window")

#: Notices of public licences, by an identifier.
TEMPLATES = {
    "Apache-2.0/notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD-2-Clause/notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSD-2-Clause/conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-3-Clause/endorsement": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSD-3-Clause/notice": "Licensed under the BSD 3-Clause License.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/short": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0/short": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0/notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "GPL-3.0/notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later/header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC/grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-3.0/notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT/notice": "Released under the MIT License.",
    "MIT/grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MPL-2.0/notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense/notice": "This is free and unencumbered software released into the public domain.",
}


def normalised_words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


@dataclass
class Template:
    name: str
    grams: Counter
    n: int
    least: int  # bigrams of a piece
    most: int
    needs: int  # distinct bigrams in common
    anchors: list[str]
    keys: list[tuple[str, int]]  # bigrams of which a window needs one, with each of their places


def prepare(name: str, text: str, t: float) -> Template:
    words = normalised_words(text)
    pairs = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    grams, n = Counter(pairs), len(pairs)
    share = math.ceil(n * t / (2 - t) - 1e-9)
    anchors: list[str] = []
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        if sum(any(a in p.split() for a in anchors) for p in pairs) > n - share:
            break
        anchors.append(w)
    keys: list[str] = []
    for g in sorted(grams, key=lambda g: (-len(g), g)):
        if sum(grams[k] for k in keys) > n * (1 - t) + 1e-9:
            break
        keys.append(g)
    return Template(name, grams, n, max(1, share), math.floor(n * (2 - t) / t + 1e-9), max(1, share - (n - len(grams))), anchors, [(g, j) for j, g in enumerate(pairs) if g in keys])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs with n_lines and matches: array of (license, dice, piece, position), best first."""
    ready = [prepare(k, v, threshold) for k, v in sorted((templates or TEMPLATES).items())]
    ready = [t for t in ready if t.n > 0]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    norm, hits, n_lines, matches = (free(x, docs.columns) for x in ("scan_norm", "scan_hits", "n_lines", "matches"))
    df = docs.withColumn(norm, F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " "))
    anchors = F.array(*[F.lit(w) for w in sorted({w for t in ready for w in t.anchors})])
    everything = F.array(*[F.lit(g) for g in sorted({g for t in ready for g in t.grams})])
    table = F.array(
        *[
            F.struct(F.lit(t.name).alias("name"), F.lit(t.n).alias("n"), F.lit(t.least).alias("least"), F.lit(t.most).alias("most"), F.array(*[F.struct(F.lit(g).alias("g"), F.lit(c).alias("c")) for g, c in t.grams.items()]).alias("grams"), F.array(*[F.struct(F.lit(g).alias("g"), F.lit(j).alias("j")) for g, j in t.keys]).alias("keys"))
            for t in ready
        ]
    )
    least, most, needs = min(t.least for t in ready), max(t.most for t in ready), min(t.needs for t in ready)

    words = lambda s: F.filter(F.split(s, "[ \n]+"), lambda w: w != "")
    let = lambda value, f: F.get(F.transform(F.array(value), f), 0)  # noqa: E731  f of a value that is made once

    def pairs(ws: Column) -> Column:
        n = F.greatest(F.size(ws) - 1, F.lit(0))
        return F.zip_with(F.slice(ws, 1, n), F.slice(ws, 2, n), lambda a, b: F.concat_ws(" ", a, b))

    def pieces(kind: int, texts: Column) -> Column:
        return F.transform(texts, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), words(s).alias("words")))

    lines, paragraphs = F.split(F.col(norm), "\n"), F.split(F.col(norm), "\n *\n[ \n]*")
    none = F.array().cast("array<string>")
    units = F.concat(
        pieces(0, lines),
        pieces(1, F.when(F.size(paragraphs) > 1, paragraphs).otherwise(none)),
        pieces(2, F.when(F.size(lines) > 1, F.array(F.col(norm))).otherwise(none)),
    )
    sized = F.filter(units, lambda u: (F.size(u["words"]) - 1).between(least, most) & F.arrays_overlap(u["words"], anchors))
    paired = F.transform(sized, lambda u: F.struct(u["kind"].alias("kind"), u["at"].alias("at"), pairs(u["words"]).alias("grams")))
    likely = F.filter(paired, lambda u: F.size(F.array_intersect(u["grams"], everything)) >= needs)

    def match(grams: Column, t: Column, kind: Column, at: Column) -> Column:
        shared = F.aggregate(t["grams"], F.lit(0), lambda acc, g: acc + F.least(g["c"], F.size(F.filter(grams, lambda x: x == g["g"]))))
        return F.struct((-2.0 * shared / (F.size(grams) + t["n"])).alias("minus"), t["name"].alias("name"), kind.alias("kind"), at.alias("at"))

    keys = F.array(*[F.lit(g) for g in sorted({g for t in ready for g, _ in t.keys})])
    no_match = F.array().cast("array<struct<minus:double,name:string,kind:int,at:int>>")

    def best_window(p: Column, found: Column, t: Column) -> Column:
        start = lambda i: F.transform(F.filter(t["keys"], lambda k: k["g"] == F.get(p, i)), lambda k: F.greatest(F.lit(0), F.least(i - k["j"], F.size(p) - t["n"])))
        starts = F.array_distinct(F.flatten(F.transform(found, start)))
        best = lambda at: F.array_min(F.transform(at, lambda i: match(F.slice(p, i + 1, t["n"]), t, F.lit(3), i)))
        return F.when(F.size(p) < t["n"], no_match).otherwise(let(starts, lambda at: F.when(F.size(at) > 0, F.array(best(at))).otherwise(no_match)))

    def windows(p: Column) -> Column:
        places = F.when(F.size(p) > 0, F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: F.array_contains(keys, F.get(p, i)))).otherwise(F.array().cast("array<int>"))
        return let(places, lambda found: F.when(F.size(found) > 0, F.flatten(F.transform(table, lambda t: best_window(p, found, t)))).otherwise(no_match))

    in_pieces = F.flatten(F.transform(likely, lambda u: F.transform(F.filter(table, lambda t: F.size(u["grams"]).between(t["least"], t["most"])), lambda t: match(u["grams"], t, u["kind"], u["at"]))))
    found = F.concat(in_pieces, let(words(F.col(norm)), lambda ws: let(pairs(ws), windows)))
    found = F.array_sort(F.filter(found, lambda m: m["minus"] <= -threshold))
    shape = F.transform(
        found,
        lambda m: F.struct(m["name"].alias("license"), (-m["minus"]).alias("dice"), F.element_at(F.array(*[F.lit(p) for p in PIECES]), m["kind"] + 1).alias("piece"), m["at"].alias("position")),
    )
    kind = "array<struct<license:string,dice:double,piece:string,position:int>>"
    worth = F.arrays_overlap(F.split(F.col(norm), "[ \n]+"), anchors)
    return (
        df.withColumn(hits, F.when(worth, shape).otherwise(F.array().cast(kind)))
        .withColumn(n_lines, F.when(text == "", 0).otherwise(F.size(lines)).cast("long"))
        .withColumn(matches, F.col(hits).cast(kind))
        .drop(norm, hits)
    )


def oracle_sql(templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> str:
    """The same scan as plain DuckDB SQL, without any of the prunings."""
    rows = []
    for name, text in sorted((templates or TEMPLATES).items()):
        words = normalised_words(text)
        for g, c in Counter(zip(words, words[1:], strict=False)).items():
            rows.append(f"('{name}', {len(words) - 1}, '{g[0]} {g[1]}', {c})")
    keys = ", ".join(f"('{t.name}', {t.n}, '{g}', {j})" for k, v in sorted((templates or TEMPLATES).items()) for t in [prepare(k, v, threshold)] for g, j in t.keys)
    return f"""
WITH t(name, n, g, c) AS (VALUES {", ".join(rows)}),
d AS (SELECT doc_id, regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}\\n]+', ' ', 'g') AS norm, coalesce(text, '') = '' AS nothing FROM documents),
l AS (SELECT doc_id, string_split(norm, chr(10)) AS ls, string_split_regex(norm, '\\n *\\n[ \\n]*') AS ps, norm FROM d),
u AS (
  SELECT doc_id, 0 AS kind, unnest(range(len(ls))) AS pos, unnest(ls) AS s FROM l
  UNION ALL SELECT doc_id, 1, unnest(range(len(ps))), unnest(ps) FROM l WHERE len(ps) > 1
  UNION ALL SELECT doc_id, 2, 0, norm FROM l WHERE len(ls) > 1),
w AS (SELECT doc_id, kind, pos, list_filter(string_split_regex(s, '[ \\n]+'), lambda x: x <> '') AS ws FROM u),
b AS (SELECT doc_id, kind, pos, len(ws) - 1 AS n, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM w),
c AS (SELECT doc_id, kind, pos, n, g, count(*) AS k FROM b GROUP BY ALL),
wo AS (SELECT doc_id, list_filter(string_split_regex(norm, '[ \\n]+'), lambda x: x <> '') AS ws FROM d),
wb AS (SELECT doc_id, len(ws) - 1 AS m, unnest(range(0, len(ws) - 1)) AS i, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM wo WHERE len(ws) > 1),
tk(name, n, g, j) AS (VALUES {keys}),
hi AS (SELECT DISTINCT doc_id, name, n, greatest(0, least(i - j, m - n)) AS st FROM wb JOIN tk USING (g) WHERE m >= n),
wc AS (SELECT hi.doc_id, hi.name, hi.n, hi.st, wb.g, count(*) AS k FROM hi JOIN wb ON wb.doc_id = hi.doc_id AND wb.i BETWEEN hi.st AND hi.st + hi.n - 1 GROUP BY ALL),
wm AS (SELECT wc.doc_id, wc.name, wc.st, sum(least(k, c)) / any_value(wc.n) AS dice FROM wc JOIN t ON t.name = wc.name AND t.g = wc.g GROUP BY wc.doc_id, wc.name, wc.st),
wr AS (SELECT *, row_number() OVER (PARTITION BY doc_id, name ORDER BY dice DESC, st) AS r FROM wm),
m AS (SELECT doc_id, 3 AS kind, st AS pos, name, dice FROM wr WHERE r = 1 UNION ALL SELECT doc_id, kind, pos, name, 2.0 * sum(least(k, c)) / (any_value(c.n) + any_value(t.n)) AS dice FROM c JOIN t USING (g) GROUP BY doc_id, kind, pos, name),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY dice DESC, name, kind, pos) AS r FROM m WHERE dice >= {threshold}),
a AS (SELECT doc_id, count(DISTINCT name) AS n_licenses, string_agg(DISTINCT name, ',' ORDER BY name) AS licenses FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(CASE WHEN nothing THEN 0 ELSE len(ls) END AS BIGINT) AS n_lines, k.name AS license, round(CAST(k.dice AS DOUBLE), 6) AS dice,
  CASE k.kind WHEN 0 THEN 'line' WHEN 1 THEN 'paragraph' WHEN 2 THEN 'text' WHEN 3 THEN 'window' END AS piece, CAST(k.pos AS INT) AS position,
  CAST(coalesce(n_licenses, 0) AS INT) AS n_licenses, coalesce(licenses, '') AS licenses
FROM d JOIN l USING (doc_id) LEFT JOIN k ON d.doc_id = k.doc_id AND k.r = 1 LEFT JOIN a ON a.doc_id = d.doc_id"""
