"""License scans by diagonal voting: no Python runs on the executors.

All rolling word k-grams of all texts are joined to the k-grams of the license templates. A hit at word p of the text
and word q of the template votes for the diagonal p - q, on which the whole template would start. Votes are summed by
diagonal, and neighbouring diagonals (words put in or left out) are merged in bands: a band is twice the drift wide and
overlaps the next by half, so that whatever lies within the drift is in one band, and no chain of diagonals makes a span
longer than its template and the band. The drift is ``slack`` words, or an eighth of a longer template. A span counts if
the distinct template places it matched reach ``coverage`` of the template and no overlapping band matched more. The
k-gram's words travel with its hash and are compared after the hash join, so a span holds true matches only. Short
phrases are templates that count only where one diagonal matched every k-gram.

Scale: the templates are a fixed list (a few hundred k-grams, broadcast with that bound); the k-grams of the texts
stream through the broadcast join and only hits and one row for each document are shuffled. Rows are keyed by document,
so no text, passage or label that many documents share meets in one task.

Edge cases: null and empty texts have no words, no label and score 0; repeated rows each get a result; two templates
may label the same words; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialize

K = 3
#: Everything but letters, digits and non-ASCII characters, after A-Z is lower-cased.
GAPS = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

# Short phrases, and the public wording of common licenses and notices.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("gpl", "under the GNU General Public License"),
    ("lgpl", "GNU Lesser General Public License"),
    ("agpl", "GNU Affero General Public License"),
    ("mit", "Released under the MIT License."),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("bsd", "Released under the BSD License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
)


def lowered(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but never into or out of ASCII: the two that would are replaced first."""
    return F.lower(F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u00e9")), F.lit("\u0130"), F.lit("\u00e9")))


def spaced(text: Column) -> Column:
    """The words of a text, lower-cased and set apart by one blank."""
    return F.trim(F.regexp_replace(lowered(text), GAPS, " "))


def grams(t: Column) -> Column:
    """All rolling K-grams of a spaced text, in order, as text: each word is consumed once and the K - 1 after it are looked ahead at."""
    return F.regexp_extract_all(t, F.lit(f"(?=([^ ]++(?: [^ ]++){{{K - 1}}}))[^ ]++ "), F.lit(1))


def template_grams(spark: SparkSession, templates: list[tuple[str, bool, str]]) -> DataFrame:
    """(t, label, phrase, n, q, h, g): template t's k-gram at word q; n k-grams in all."""
    rows = []
    for t, (label, phrase, text) in enumerate(templates):
        words = [w for w in re.split(GAPS, text.lower()) if w]
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        rows += [(t, label, phrase, len(words) - K + 1, q, " ".join(words[q : q + K])) for q in range(len(words) - K + 1)]
    df = spark.createDataFrame(rows, "t int, label string, phrase boolean, n int, q int, g string")
    return df.withColumn("h", F.xxhash64("g"))


def _votes(docs: DataFrame, templates, phrases, id_col: str, text_col: str) -> DataFrame:
    """A row for each hit, and one with t = -1 for each document."""
    spark = docs.sparkSession
    known = template_grams(spark, [(label, True, x) for label, x in phrases] + [(label, False, x) for label, x in templates])
    own = spark.createDataFrame([(-1, None, None, 0, 0, "")], "t int, label string, phrase boolean, n int, q int, g string").withColumn("h", F.xxhash64("g"))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), spaced(F.col(text_col)).alias("x"))
    n_words = F.when(F.col("x") == "", 0).otherwise(F.length("x") - F.length(F.replace("x", F.lit(" "), F.lit(""))) + 1).cast("long")
    # An empty gram comes before the others: it meets the template of t = -1 and carries the document along.
    each = texts.select("row", "doc_id", n_words.alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), grams(F.col("x")))).alias("p", "g"))
    flat = each.select("row", "doc_id", "n_words", (F.col("p") - 1).alias("p"), "g", F.xxhash64("g").alias("h"))
    return flat.join(F.broadcast(known.unionByName(own).withColumnsRenamed({"h": "__h", "g": "__g"})), (F.col("h") == F.col("__h")) & (F.col("g") == F.col("__g"))).drop("h", "g", "__h", "__g")


def _spans(hits: DataFrame, coverage: float, slack: int) -> DataFrame:
    """(row, doc_id, label, phrase, start, end, score) of each span that counts."""
    diagonals = hits.groupBy("row", "doc_id", "t", "label", "phrase", "n", (F.col("p") - F.col("q")).alias("d")).agg(F.collect_set("q").alias("qs"), F.min("p").alias("a"), F.max("p").alias("b"))
    width = F.greatest(F.lit(slack), F.floor(F.col("n") / 8)).cast("int") + 1
    band = F.floor(F.col("d") / width).cast("int")
    # A phrase's diagonal is alone in its band.
    bands = F.when(F.col("phrase"), F.array(F.col("d").cast("int"))).otherwise(F.array(band - 1, band))
    spans = diagonals.withColumn("band", F.explode(bands)).groupBy("row", "doc_id", "t", "label", "phrase", "n", "band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("qs")))).alias("votes"), F.min("a").alias("start"), (F.max("b") + K).alias("end"))
    score = F.col("votes") / F.col("n")
    enough = spans.where(F.when(F.col("phrase"), F.col("votes") == F.col("n")).otherwise(score >= coverage))
    run = Window.partitionBy("row", "t").orderBy("band")
    beside = lambda w, step: F.when(w("band").over(run) == F.col("band") + step, w("votes").over(run))
    best = (F.col("votes") > F.coalesce(beside(F.lag, -1), F.lit(0))) & (F.col("votes") >= F.coalesce(beside(F.lead, 1), F.lit(0)))
    peaks = enough.withColumn("best", F.col("phrase") | best).where("best")
    return peaks.select("row", "doc_id", "label", "phrase", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), score.alias("score"))


def license_report(docs: DataFrame, *, templates=TEMPLATES, phrases=PHRASES, coverage: float = 0.6, slack: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    votes = materialize(_votes(docs, templates, phrases, id_col, text_col), "license-votes")
    spans = _spans(votes.where("t >= 0"), coverage, slack)
    found = spans.groupBy("row").agg(
        F.count(F.when(F.col("phrase"), 1)).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("start"))).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("phrase"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "score"))).alias("spans"),
    )
    own = votes.where("t < 0").select("row", "doc_id", "n_words")
    return own.join(found, "row", "left").select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"), "spans")
