"""License scans by diagonal voting.

Every pair of neighbouring words of every text is joined, by hash and then by
the words themselves, to the places of that pair in the templates. A match at
word p of the text and word q of a template votes for the diagonal p - q. Votes
are summed by diagonal; a diagonal with all votes of a phrase is a verified
occurrence. For the longer templates the votes of up to ``drift`` neighbouring
diagonals are merged, so a few words put in or left out do not break a span. All
votes of such a span lie within its template's length plus the drift, and its
pairs are counted once each in the order of the template, so words scattered
over more of the text do not add up. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Base phrases with their labels.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]
# Wording of public licenses.
TEMPLATES = [
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software"
        " without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
        " persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all"
        " copies or substantial portions of the software",
        "mit",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code"
        " must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this"
        " list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "bsd-2-clause",
    ),
    (
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "bsd-3-clause",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"
        " http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is"
        " basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        "apache-2.0",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 3 of the license or at your option any later version",
        "gpl-3.0-or-later",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"
        " either version 2 of the license or at your option any later version",
        "gpl-2.0-or-later",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this"
        " permission notice appear in all copies",
        "isc",
    ),
    (
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source"
        " code form or as a compiled binary for any purpose commercial or non commercial and by any means",
        "unlicense",
    ),
    (
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        "mpl-2.0",
    ),
    (
        "this work is licensed under the creative commons attribution sharealike 4 0 international license to view a copy of this license visit http creativecommons org licenses by sa 4 0",
        "cc-by-sa-4.0",
    ),
]
#: Diagonals up to this far from the first of a span are merged; a span of this share of a template's pairs gives its label.
DRIFT, SHARE = 2, 0.75

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words() -> Column:
    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def template_rows(base: list[tuple[str, str]], templates: list[tuple[str, str]]) -> list[tuple[int, int, bool, str, int, str, str]]:
    """(template, pairs, is base, label, place, word, next word)."""
    out = []
    for t, (phrase, label) in enumerate([*base, *templates]):
        words = phrase.split()
        out += [(t, len(words) - 1, t < len(base), label, q, words[q], words[q + 1]) for q in range(len(words) - 1)]
    return out


def telling_places(base: list[tuple[str, str]], templates: list[tuple[str, str]], share: float = SHARE) -> list[list[list[int]]]:
    """For each template, and each of another label that would hold its label too, the places of the pairs that the other lacks.

    Two versions of a license differ by a word or two, so a span of one has most
    pairs of the other; what it must have is one of those that tell them apart. A
    template without any, which stands whole within another, needs none.
    """
    pairs = [list(zip(w, w[1:])) for w in (phrase.split() for phrase, _ in [*base, *templates])]
    labels = [label for _, label in [*base, *templates]]
    out: list[list[list[int]]] = []
    for t, own in enumerate(pairs):
        tells = []
        for other, theirs in enumerate(pairs):
            apart = [q for q, x in enumerate(own) if x not in set(theirs)]
            if min(t, other) >= len(base) and labels[t] != labels[other] and apart and len(own) - len(apart) >= share * len(own):
                tells.append(apart)
        out.append(tells)
    return out


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES, drift: int = DRIFT, share: float = SHARE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and non-ASCII
    characters. Base phrases count wherever their words stand consecutively;
    first_word and last_word are the smallest and largest such start. ``labels``
    adds those of templates with a span of at least ``share`` of their pairs, one
    at least of those that tell it from each like template among them; score is the largest share held by any template. Null and empty texts have
    no words, empty labels and score 0. Rows equal in doc_id and text get equal
    results; other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    table = spark.createDataFrame(template_rows(base, templates), "t int, pairs int, is_base boolean, label string, q int, a string, b string")
    table = table.withColumn("gram", F.xxhash64("a", "b"))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("key"), _words().alias("words"))
    marker = F.struct(F.lit(None).cast("long").alias("gram"), F.lit(None).cast("string").alias("w"), F.lit(None).cast("string").alias("n"))
    pair = F.transform(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.struct(F.xxhash64(w, F.get("words", i + 1)).alias("gram"), w.alias("w"), F.get("words", i + 1).alias("n")))
    # the first entry of every row joins with nothing and stands for the row, so texts are read into words once
    each = keyed.select("doc_id", "key", F.size("words").cast("long").alias("n_words"), F.posexplode(F.concat(F.array(marker), pair)).alias("at", "x"))
    votes = (
        each.select("doc_id", "key", "n_words", (F.col("at") - 1).alias("p"), "x.gram", "x.w", "x.n")
        .join(F.broadcast(table), "gram", "left")
        .filter("p = -1 or (w = a and n = b)")
        .groupBy("doc_id", "key", "t", "pairs", "is_base", "label", (F.col("p") - F.col("q")).alias("diagonal"))
        .agg(F.collect_set("q").alias("held"), F.count("*").alias("rows"), F.max("n_words").alias("n_words"))
    )
    near = Window.partitionBy("doc_id", "key", "t").orderBy("diagonal").rangeBetween(0, drift)
    whole = F.col("is_base") & (F.size("held") == F.col("pairs"))
    merged = F.array_distinct(F.flatten(F.collect_list("held").over(near)))
    tells = F.array(*(F.array(*(F.array(*(F.lit(q) for q in places)) for places in own)) if own else F.array().cast("array<array<int>>") for own in telling_places(base, templates, share)))
    told = F.forall(F.get(tells, F.col("t")), lambda places: F.arrays_overlap(places, "seen"))
    # a base phrase holds its label by verified places alone
    spans = votes.withColumn("seen", merged).withColumn("share", F.when(F.col("is_base"), F.when(whole, 1.0).otherwise(0.0)).otherwise(F.size("seen") / F.col("pairs"))).withColumn("whole", whole)
    spans = spans.withColumn("holds", F.when(F.col("is_base"), F.col("whole")).otherwise((F.col("share") >= share) & told))
    named = lambda cond: F.concat_ws(",", F.array_sort(F.collect_set(F.when(cond, F.col("label")))))
    found = spans.groupBy("doc_id", "key").agg(
        F.max(F.when(F.col("t").isNull(), F.col("rows"))).alias("rows"),
        F.max(F.when(F.col("t").isNull(), F.col("n_words"))).alias("n_words"),
        F.count_if("whole").alias("n_base"),
        F.min(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("whole"), F.col("diagonal"))).cast("long").alias("last_word"),
        named(F.col("whole")).alias("base_labels"),
        named(F.col("holds")).alias("labels"),
        F.coalesce(F.max("share"), F.lit(0.0)).alias("score"),
    )
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("copy")
    ).drop("copy")
