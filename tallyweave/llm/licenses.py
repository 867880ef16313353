"""License scans by diagonal voting.

Rolling hashes of ``GRAM`` words of the documents are joined to the positions of the same words in license
notices. Every match votes for a diagonal (place in the document minus place in the notice). Votes
are counted by diagonal, neighbouring diagonals (words added or left out) are merged, and
a merged span is accepted if it holds enough of the notice, by share or by words, and little else. Words are compared
beside their hashes, so no vote is an accident.

Short phrases that name a license outright are found in the same pass. Everything is built-in Spark
expressions. The notices (whole texts, notices of files and names) are the only table that is broadcast, and it is fixed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.registry import query, table
from tallyweave.llm.shared import alnum_words, keyed, stored

GRAM = 4
#: Diagonals so far apart are one span.
NEAR = 3
#: Share of a notice's grams that a span has to hold, or else words of it; and share of the span that these have to make up.
HELD, LONG, DENSE = 0.6, 40, 0.5

# Phrases that name a license, and their labels.
PHRASES = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
]

# Labels and texts as published with the licenses. Warranty clauses that other licenses have
# word for word are left out of all but one.
SHORT_TEXTS = [
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
        "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
        "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE.",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met: Redistributions of source code must retain the above copyright notice, this "
        "list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above "
        "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. Neither the name of the copyright holder nor the names of its "
        "contributors may be used to endorse or promote products derived from this software without specific prior "
        "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
        "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
        "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
        "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
        "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
        "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
        "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
        "IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
        "USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this "
        "software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject "
        "to the following restrictions: The origin of this software must not be misrepresented; you must not claim that "
        "you wrote the original software. If you use this software in a product, an acknowledgment in the product "
        "documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, "
        "and must not be misrepresented as being the original software. This notice may not be removed or altered from "
        "any source distribution.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, "
        "use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
        "purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the "
        "author or authors of this software dedicate any and all copyright interest in the software to the public domain. "
        "We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. "
        "We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to "
        "this software under copyright law.",
    ),
    (
        "apache",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
        "not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
]

#: Whole texts of the long licenses, by label and version.
TEXTS = Path(__file__).parent / "texts"
# Own patterns: the names that the Creative Commons licenses go by, of every kind and version.
CC_KINDS = ("by", "by-sa", "by-nc", "by-nd", "by-nc-sa", "by-nc-nd")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")


@cache
def all_notices() -> tuple[tuple[str, str], ...]:
    """(label, text) of the short texts, the long ones and the own patterns."""
    long = [(path.name.split("-")[0], path.read_text("utf-8")) for path in sorted(TEXTS.glob("*.txt"))]
    own = [(f"cc-{kind}", f"CC {kind} {version}") for kind in CC_KINDS for version in CC_VERSIONS]
    return (*SHORT_TEXTS, *long, *own)


def notice_grams(spark: SparkSession, notices: Sequence[tuple[str, str]] | None = None, gram: int = GRAM) -> DataFrame:
    """(hash, gram, places): every gram of the notices and where it stands.

    A place has ``notice`` (its number), ``label``, ``at`` and ``grams``, the notice's number of distinct places.
    """
    notices = all_notices() if notices is None else notices
    rows = spark.createDataFrame([(n, label, text) for n, (label, text) in enumerate(notices)], "notice int, label string, text string")
    words = rows.select("notice", "label", alnum_words(F.col("text")).alias("words")).filter(F.size("words") >= gram)
    words = words.withColumn("grams", F.size("words") - (gram - 1))
    placed = words.select("*", F.posexplode(F.slice("words", 1, F.col("grams"))).alias("at", "word"))
    return (
        placed.select(_hash(gram).alias("hash"), _gram(gram).alias("gram"), F.struct("notice", "label", "at", "grams").alias("place"))
        .groupBy("hash", "gram")
        .agg(F.collect_list("place").alias("places"))
    )


def _ahead(gram: int) -> list[Column]:
    return [F.get("words", F.col("at") + i) for i in range(gram)]


def _hash(gram: int) -> Column:
    return F.xxhash64(*_ahead(gram))


def _gram(gram: int) -> Column:
    return F.concat_ws(" ", *_ahead(gram))


def _named() -> Column:
    """The label of the phrase that begins at ``at``, or null."""
    found = F.lit(None).cast("string")
    for phrase, label in PHRASES:
        words = phrase.split()
        here = F.col("word") == words[0]
        for i, word in enumerate(words[1:], 1):
            here = here & (F.get("words", F.col("at") + i) == word)
        found = F.when(here, F.lit(label)).otherwise(found)
    return found


def matches(docs: DataFrame, notices: Sequence[tuple[str, str]] | None = None, gram: int = GRAM) -> DataFrame:
    """(doc, doc_id, n_words, at, named, places) where a phrase or a notice's gram stands, stored.

    The first place of every document (null, if it has no words) is there too.
    """
    grams = notice_grams(docs.sparkSession, notices, gram).withColumnRenamed("hash", "found").withColumnRenamed("gram", "same")
    words = keyed(docs.select("doc_id", "text")).select("doc", "doc_id", alnum_words(F.col("text")).alias("words"))
    placed = words.select("doc", "doc_id", "words", F.posexplode_outer("words").alias("at", "word"))
    inside = F.when(F.col("at") + gram <= F.size("words"), _hash(gram))
    placed = placed.withColumns({"hash": inside, "named": _named()})
    joined = placed.join(F.broadcast(grams), (F.col("hash") == F.col("found")) & (_gram(gram) == F.col("same")), "left")
    kept = joined.filter("at is null or at = 0 or named is not null or places is not null")
    return stored(kept.select("doc", "doc_id", F.size("words").cast("long").alias("n_words"), "at", "named", "places"))


def spans(found: DataFrame, gram: int = GRAM) -> DataFrame:
    """(doc, label, notice, start, stop, held, words, dense): the merged diagonals of ``matches``.

    ``held`` is the share of the notice's grams in the span, ``words`` the words of these, ``dense`` the share of the span's words that
    lie in them. A document that repeats a notice has a span for each.
    """
    votes = found.select("doc", "at", F.explode("places").alias("place")).distinct()
    diagonal = (F.col("at") - F.col("place.at")).alias("diagonal")
    diagonals = votes.groupBy("doc", "place.notice", "place.label", "place.grams", diagonal).agg(
        F.min("at").alias("start"), (F.max("at") + gram).alias("stop"), F.collect_set("place.at").alias("places")
    )
    own = Window.partitionBy("doc", "notice").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(own) > NEAR, F.lit(True))
    merged = (
        diagonals.withColumn("apart", apart.cast("int"))
        .withColumn("span", F.sum("apart").over(own.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("doc", "notice", "label", "grams", "span")
        .agg(
            F.min("start").alias("start"),
            F.max("stop").alias("stop"),
            F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places"),
        )
    )
    return merged.select(
        "doc",
        "label",
        "notice",
        "start",
        "stop",
        (F.col("places") / F.col("grams")).alias("held"),
        (F.col("places") + (gram - 1)).alias("words"),
        F.least(F.lit(1.0), (F.col("places") + (gram - 1)) / (F.col("stop") - F.col("start"))).alias("dense"),
    )


def scan(docs: DataFrame, notices: Sequence[tuple[str, str]] | None = None, gram: int = GRAM) -> DataFrame:
    """One row per document: its words, the phrases in it and its labels.

    ``score`` is 1 where a phrase names a license, otherwise the largest share of any notice that an accepted
    span holds (at least ``HELD``, if it is accepted for its length), or half the share of one that is not accepted. Words are those of ``alnum_words``. Null and empty
    texts have none and no labels, rows equal in id and text are one document, a null id is an id
    like others, other columns are ignored, and an empty table gives no rows.
    """
    found = matches(docs, notices, gram)
    accepted = ((F.col("held") >= HELD) | (F.col("words") >= LONG)) & (F.col("dense") >= DENSE)
    by_notice = (
        spans(found.filter("places is not null"), gram)
        .groupBy("doc")
        .agg(
            F.collect_set(F.when(accepted, F.col("label"))).alias("held_labels"),
            F.max(F.when(accepted, F.greatest(F.lit(HELD), F.col("held"))).otherwise(F.col("held") / 2)).alias("held"),
        )
    )
    places = found.groupBy("doc", "doc_id", "n_words", "at").agg(F.max("named").alias("named"))
    named = F.when(F.col("named").isNotNull(), F.col("at").cast("long"))
    by_phrase = places.groupBy("doc", "doc_id", "n_words").agg(
        F.count(named).alias("n_base"),
        F.min(named).alias("first_word"),
        F.max(named).alias("last_word"),
        F.collect_set("named").alias("named"),
    )
    labels = F.array_union("named", F.coalesce("held_labels", F.array().cast("array<string>")))
    return by_phrase.join(by_notice, "doc", "left").select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_sort("named").alias("base_labels"),
        F.array_sort(labels).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("held", F.lit(0.0))).alias("score"),
    )


@query()
def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Phrases and labels of every document."""
    found = scan(table(spark, folder, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("base_labels", "labels")})
