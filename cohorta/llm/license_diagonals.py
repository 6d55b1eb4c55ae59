"""License scan by diagonal voting, in DataFrame operations only.

Every k consecutive words of a text are hashed and joined to the places of the same words
in license templates. A match votes for the diagonal (place in the text minus place in the
template); votes are counted per diagonal, diagonals close to each other (a word more or
less in between) are merged, and a merged span holds if it covers enough of the template.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cohorta.llm.registry import texts
from cohorta.llm.words import PLAIN_PATTERN

GRAM = 4
#: Diagonals at most this far from the next one are one span.
DRIFT = 3
#: Share of a template's words that a span must cover.
COVER = 0.6
#: Templates of at most so many words together are sent to every executor; more are joined by shuffling.
BROADCAST_WORDS = 200_000

#: The Kelvin sign and the dotted capital I, whose lower case begins with an ASCII letter.
ODD = "\u212a\u0130"
# Phrases of the base scan with their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Wording of public license texts and notices, a template per paragraph.
TEMPLATES = {
    "agpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
    "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-line": "Licensed under the Apache License, Version 2.0",
    "bsd-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
    "without specific prior written permission.",
    "bsd-warranty": "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE "
    "FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING "
    "NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-line": "Licensed under CC BY 4.0",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0",
    "cc-by-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa-line": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
    "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-warranty": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or "
    "FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
    "copyright notice and this permission notice appear in all copies.",
    "isc-warranty": "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF "
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
    "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE "
    "OR PERFORMANCE OF THIS SOFTWARE.",
    "lgpl-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
    "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit-line": "Released under the MIT License",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
    "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
    "You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def words_of(text: Column) -> Column:
    """Words with A-Z in lower case. ``lower`` changes other letters too, but none into or
    out of a word, and none into A-Z but those of ODD, which go letter by letter."""
    t = F.coalesce(text, F.lit(""))
    odd = reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in ODD])
    low = F.when(odd, F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.lower(t))
    return F.regexp_extract_all(low, F.lit(PLAIN_PATTERN), 0)


def _grams(df: DataFrame, k: int, *keys: str) -> DataFrame:
    """One row per k consecutive words: keys, place, hash, and the words themselves."""
    later = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))).alias(f"g{i}") for i in range(k)]
    rows = df.select(*keys, *later).select(*keys, F.posexplode(F.arrays_zip(*(f"g{i}" for i in range(k)))).alias("place", "g"))
    rows = rows.select(*keys, "place", *(f"g.g{i}" for i in range(k))).where(f"g{k - 1} is not null")
    return rows.withColumn("hash", F.xxhash64(*(f"g{i}" for i in range(k))))


def template_grams(spark: SparkSession, templates: dict[str, str], k: int = GRAM) -> DataFrame:
    t = spark.createDataFrame(list(templates.items()), "template string, text string").withColumn("words", words_of(F.col("text")))
    return _grams(t.withColumn("length", F.size("words")), k, "template", "length").withColumnRenamed("place", "at")


def find_spans(docs: DataFrame, templates: dict[str, str], k: int = GRAM) -> DataFrame:
    """Verified spans: doc_id, tie (hash of the text), template, first (word), end (word,
    exclusive), votes, cover. Null and empty texts and templates shorter than k words have none."""
    d = texts(docs).select("doc_id", F.xxhash64("text").alias("tie"), words_of(F.col("text")).alias("words"))
    right = template_grams(docs.sparkSession, templates, k)
    same = ["hash", *(f"g{i}" for i in range(k))]
    if sum(len(t.split()) for t in templates.values()) <= BROADCAST_WORDS:
        right = F.broadcast(right)
    hits = _grams(d, k, "doc_id", "tie").join(right, same)
    keys = ["doc_id", "tie", "template", "length"]
    voted = hits.groupBy(*keys, (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("ats"))
    # One text and template a group: never more rows than the text has words.
    w = Window.partitionBy(*keys).orderBy("diagonal")
    opens = (F.col("diagonal") - F.lag("diagonal").over(w) > DRIFT).cast("int")
    merged = voted.withColumn("opens", F.coalesce(opens, F.lit(0))).withColumn("run", F.sum("opens").over(w))
    spans = merged.groupBy(*keys, "run").agg(
        F.array_distinct(F.flatten(F.collect_list("ats"))).alias("ats"), F.sum(F.size("ats")).alias("votes"),
        F.min(F.col("diagonal") + F.array_min("ats")).alias("first"), F.max(F.col("diagonal") + F.array_max("ats") + k).alias("end"),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform("ats", lambda a: F.sequence(a, a + (k - 1))))))
    return spans.withColumn("cover", covered / F.col("length")).where(F.col("cover") >= COVER).select("doc_id", "tie", "template", "first", "end", "votes", "cover")


def _places(words: Column, phrase: str) -> Column:
    parts = phrase.split()
    there = lambda i: reduce(lambda a, b: a & b, [F.get(words, i + k) == p for k, p in enumerate(parts)])
    return F.filter(F.sequence(F.lit(0), F.size(words) - 1), there)


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, phrases: dict[str, str] | None = None) -> DataFrame:
    """Per row: doc_id, n_words, places (struct arrays of the base phrases), base_labels,
    labels (templates' too), spans, score.

    The score is the largest cover of a verified span, and at least one half where a base
    phrase stands. Null and empty texts have no words, labels or score. Rows come out one
    for one; rows with equal id and text are scanned alike; other columns are not read.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    d = texts(docs)
    gap = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    # Word by word only where the phrase can stand at all.
    somewhere = F.lower("text").rlike("|".join(gap.join(p.split()) for p in phrases))
    base = d.select("doc_id", F.xxhash64("text").alias("tie"), F.coalesce(somewhere, F.lit(False)).alias("maybe"), words_of(F.col("text")).alias("words"))
    none = F.array().cast("array<int>")
    found = [F.when(F.col("maybe"), _places(F.col("words"), p)).otherwise(none) for p in phrases]
    base = base.select("doc_id", "tie", F.size("words").cast("long").alias("n_words"), F.array(*found).alias("by_phrase"))
    named = [F.when(F.size(F.get("by_phrase", F.lit(k))) > 0, F.lit(label)) for k, label in enumerate(phrases.values())]
    base = base.select("doc_id", "tie", "n_words", F.flatten("by_phrase").alias("places"), F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))).alias("base_labels"))
    spans = find_spans(docs, templates).groupBy("doc_id", "tie").agg(
        F.array_sort(F.collect_list(F.struct("first", "end", "template", "votes", "cover"))).alias("spans"), F.max("cover").alias("best"),
    )
    out = base.join(spans.select(F.col("doc_id").alias("d"), F.col("tie").alias("t"), "spans", "best"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    spans_ = F.coalesce("spans", F.array().cast("array<struct<first:int,end:int,template:string,votes:bigint,cover:double>>"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.transform(spans_, lambda s: s["template"]))))
    score = F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.size("places") > 0, 0.5).otherwise(0.0))
    return out.select("doc_id", "n_words", "places", "base_labels", labels.alias("labels"), spans_.alias("spans"), score.alias("score"))
