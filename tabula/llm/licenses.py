"""Licence scans: pieces of texts compared with licence templates by the Dice coefficient of their word bigrams.

Texts and templates are normalised to lower-case words of letters and digits. Compared are the lines of a text, its
paragraphs of several lines, and windows of a template's length, so that notices inside longer lines and whole licences
in longer texts are found. Two sets of bigrams of sizes a and b can reach a Dice coefficient t only if they share
t / (2 - t) of each, so sizes select the templates that a line or paragraph is compared with. For the same reason a
match has at least one of a few telling words or bigrams of its template, those that stand in more of its bigrams than
a match may lack: texts and units without any of them are dropped before they are normalised, and windows are laid so
that a telling sign of the text lies on each place where the template has it. Everything runs in DataFrame expressions;
documents do not move until the few matches are gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabula.llm.shared import kept

#: Notices as their licences or their usual headers word them, paragraphs of short licences, and whole
#: short licences.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
                "option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                "to this work."),
    ("all-rights-reserved", "All rights reserved."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of "
            "the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT "
            "NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
            "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
            "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above "
                     "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                     "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                     "in the documentation and/or other materials provided with the distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                     "that the following conditions are met: 1. Redistributions of source code must retain the above "
                     "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary "
                     "form must reproduce the above copyright notice, this list of conditions and the following disclaimer "
                     "in the documentation and/or other materials provided with the distribution. 3. Neither the name of the "
                     "copyright holder nor the names of its contributors may be used to endorse or promote products derived "
                     "from this software without specific prior written permission."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
                     "promote products derived from this software without specific prior written permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS "
            "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
            "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
            "PERFORMANCE OF THIS SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
                   "software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR "
                   "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing "
                   "permissions and limitations under the License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held "
             "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
             "software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
)
#: Least Dice coefficient of a match; most templates of a list, and most words of them all, which bound what is broadcast.
DICE, MOST_TEMPLATES, MOST_WORDS = 0.8, 2000, 1_000_000


def normal_words(text: Column) -> Column:
    """The words of a text in lower case, without punctuation."""
    plain = F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))
    return F.when(text.isNull() | (plain == ""), F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def bigrams(words: Column) -> Column:
    """The distinct pairs of neighbouring words; a single word is paired with nothing and gives none."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(F.array_distinct(pairs))


def units(text: Column) -> Column:
    """The lines of a text, and its paragraphs of several lines."""
    lines = F.split(text, r"\n")
    paragraphs = F.filter(F.split(text, r"\n[ \t\r]*\n[ \t\r\n]*"), lambda p: F.contains(p, F.lit("\n")))
    return F.concat(lines, paragraphs)


#: Shorter words are too common to tell anything alone.
TELLING_LETTERS = 6


def telling_signs(grams: Sequence[str], ratio: float) -> list[str]:
    """Words of a template, the longest first, and where these are too short its bigrams, until they stand in more of
    its bigrams than a match may lack: any match contains one of them."""
    pairs = [g.split(" ") for g in grams]
    words = sorted({w for p in pairs for w in p if len(w) >= TELLING_LETTERS}, key=lambda w: (-len(w), w))
    open_, chosen = set(range(len(grams))), []
    for sign in [*words, *grams]:
        if len(grams) - len(open_) > (1 - ratio) * len(grams) + 1e-9:
            break
        covered = {n for n in open_ if sign == grams[n] or sign in pairs[n]}
        if covered:
            chosen.append(sign)
            open_ -= covered
    return chosen


def _has_any(plain: Column, signs: Sequence[str]) -> Column:
    """Whether a lower-case text contains one of the signs; the words of a bigram may stand apart by punctuation."""
    found = F.lit(False)
    for sign in signs:
        if " " not in sign:
            found = found | F.contains(plain, F.lit(sign))
    pairs = [r"[^\p{L}\p{N}]+".join(s.split(" ")) for s in signs if " " in s]
    return found | plain.rlike("|".join(pairs)) if pairs else found


def sign_places(templates: Sequence[tuple[int, Sequence[str], Sequence[str]]], ratio: float) -> list[tuple[str, int, int, int]]:
    """(sign, template, place, words): each telling sign of (number, words, bigrams) and where its template has it."""
    found = []
    for number, words, grams in templates:
        for sign in telling_signs(grams, ratio):
            long = 1 + sign.count(" ")
            places = [k for k in range(len(words) - long + 1) if " ".join(words[k : k + long]) == sign]
            found += [(sign, number, k, len(words)) for k in places]
    return found


def _in_units(texts: DataFrame, signs: Sequence[str], sizes: DataFrame, least: int, most: int) -> DataFrame:
    """(row, doc_id, kind, at, t, grams): the lines and paragraphs whose size fits a template."""
    cut = texts.select("row", "doc_id", F.posexplode(units(F.col("plain"))).alias("at", "body"))
    body = F.when(_has_any(F.col("body"), signs), F.col("body"))
    worded = cut.select("row", "doc_id", "at", F.explode(F.array(normal_words(body))).alias("words")).filter(F.size("words") > least)
    paired = worded.select("row", "doc_id", "at", F.explode(F.array(bigrams(F.col("words")))).alias("grams"))
    likely = paired.withColumn("size", F.size("grams")).filter(F.col("size").between(least, most))
    return likely.join(F.broadcast(sizes), "size").select("row", "doc_id", F.lit("unit").alias("kind"), "at", "t", "grams")


def _in_windows(texts: DataFrame, places: DataFrame, signs: Sequence[str], reach: int) -> DataFrame:
    """(row, doc_id, kind, at, t, grams): windows of a template's length around the telling signs of a text."""
    openers = sorted({s.split(" ")[0] for s in signs})
    worded = texts.select("row", "doc_id", F.explode(F.array(normal_words(F.col("plain")))).alias("words")).filter(F.size("words") > 1)
    words = F.col("words")
    hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get(words, i).isin(openers))
    near = F.transform(hits, lambda i: F.struct(i.alias("hit"), F.slice(words, F.greatest(i - reach, F.lit(0)) + 1, 2 * reach + 1).alias("near")))
    around = worded.select("row", "doc_id", F.explode(near).alias("h")).select("row", "doc_id", "h.hit", "h.near", F.least("h.hit", F.lit(reach)).alias("own"))
    one = F.get("near", F.col("own"))
    keyed = around.withColumn("sign", F.explode(F.array(one, F.concat_ws(" ", one, F.get("near", F.col("own") + 1)))))
    laid = keyed.join(F.broadcast(places), "sign").withColumn("begin", F.greatest(F.col("own") - F.col("place"), F.lit(0)))
    length = F.col("many") - (F.col("begin") - (F.col("own") - F.col("place")))
    window = F.slice("near", F.col("begin") + 1, length)
    return laid.select(
        "row", "doc_id", F.lit("window").alias("kind"), (F.col("hit") - F.col("own") + F.col("begin")).alias("at"), "t",
        F.explode(F.array(bigrams(window))).alias("grams"),
    )


def scan(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, dice: float = DICE
) -> DataFrame:
    """(doc_id, license, dice, units, windows): the licences found in each document, the best coefficient, and in how
    many lines and paragraphs and in how many windows (by their first word).

    A piece counts for each licence of which a template reaches `dice`; of one licence's templates the best counts.
    Null and blank texts match nothing. Rows with equal ids count their pieces together, each its own, and so do rows
    without an id. Templates of fewer than two words, more than MOST_TEMPLATES templates or MOST_WORDS words of them are
    an error. Other columns are not read.
    """
    spark = docs.sparkSession
    given = spark.createDataFrame([(n, name, body) for n, (name, body) in enumerate(templates)], "t long, license string, body string")
    worded = given.select("t", "license", normal_words(F.col("body")).alias("words"))
    known = worded.select("t", "license", "words", bigrams(F.col("words")).alias("grams")).collect()
    if len(known) > MOST_TEMPLATES or sum(len(r["words"]) for r in known) > MOST_WORDS:
        raise ValueError(f"more than {MOST_TEMPLATES} templates or {MOST_WORDS} words")
    if any(not r["grams"] for r in known):
        raise ValueError("a template needs two words")
    ratio = dice / (2 - dice)
    fitting = [
        (size, r["t"])
        for r in known
        for size in range(1, int(len(r["grams"]) / ratio) + 2)
        if ratio * len(r["grams"]) - 1e-9 <= size <= len(r["grams"]) / ratio + 1e-9
    ]
    least, most = min(f[0] for f in fitting), max(f[0] for f in fitting)
    where = sign_places([(r["t"], r["words"], r["grams"]) for r in known], ratio)
    signs, reach = sorted({p[0] for p in where}), max(len(r["words"]) for r in known)
    sizes = spark.createDataFrame(fitting, "size int, t long")
    places = spark.createDataFrame(where, "sign string, t long, place int, many int")
    bodies = spark.createDataFrame([(r["t"], r["license"], r["grams"]) for r in known], "t long, license string, template array<string>")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.explode(F.array(F.lower(F.col(text)))).alias("plain"))
    texts = kept(rows.filter(_has_any(F.col("plain"), signs)), "license-texts")
    pieces = _in_units(texts, signs, sizes, least, most).unionByName(_in_windows(texts, places, signs, reach))
    both = F.size(F.array_intersect("grams", "template"))
    compared = pieces.join(F.broadcast(bodies), "t").withColumn("dice", 2.0 * both / (F.size("grams") + F.size("template")))
    matched = compared.filter(F.col("dice") >= dice)
    by_piece = matched.groupBy("doc_id", "license", "row", "kind", "at").agg(F.max("dice").alias("dice"))
    return by_piece.groupBy("doc_id", "license").agg(
        F.round(F.max("dice"), 6).alias("dice"), F.count_if(F.col("kind") == "unit").alias("units"),
        F.count_if(F.col("kind") == "window").alias("windows"),
    )
