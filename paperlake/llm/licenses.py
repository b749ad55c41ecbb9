"""License scans by a positional rare-token index, in DataFrame functions only.

The words of the licence notices are weighed by their inverse document frequency over all
documents. For each notice a text looks up its highest-weighted words of that notice in the index
of the notices' words and positions, as many as it takes until the others together weigh less than
the least share to report; so every place that reaches that share agrees with a looked-up word.
Places that agree on the text's position relative to the notice are intersected: a place goes on
if its looked-up words and all others could reach the share. There the whole notice is compared
word by word. It is found if the share of its weight that stands at its place is at least `LEAST`
with a word outside its key phrase, and gives its label if the mandatory key phrase stands there
too. Base phrases are found besides, wherever their words stand in a row.

Words are runs of letters and digits, A-Z lower-cased; any character beyond ASCII counts as a
letter. Defined cases: null and empty texts have no words and no labels; rows that repeat a
`doc_id` and rows without one are scanned one by one; equal weights are in alphabetical order; a
key phrase without its notice has no label of its own; further columns are ignored; an empty table
gives no rows.
"""

import json
import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperlake.session import cut

LEAST = 0.4
"""The share of a notice's weight that must stand at its place."""
NAMED = 0.4
"""The score of a base phrase alone."""
BLOCK = 512
"""Words of a text that a place of a notice takes along, besides the longest notice's."""
_SLACK = 1e-9
"""For sums of the same weights in another order."""

# Phrases with their labels, and public licence notices with a mandatory key phrase.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge",
     "permission is hereby granted free of charge to any person obtaining a copy of this software "
     "and associated documentation files the software to deal in the software without restriction"),
    ("apache", "apache license version 2 0",
     "licensed under the apache license version 2 0 the license you may not use this file except "
     "in compliance with the license"),
    ("gpl", "gnu general public license",
     "this program is free software you can redistribute it and or modify it under the terms of "
     "the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license",
     "this library is free software you can redistribute it and or modify it under the terms of "
     "the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license",
     "under the terms of the gnu affero general public license as published by the free software "
     "foundation"),
    ("bsd", "redistribution and use in source and binary forms",
     "redistribution and use in source and binary forms with or without modification are "
     "permitted provided that the following conditions are met"),
    ("mpl", "mozilla public license",
     "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc0", "cc0 1 0 universal", "cc0 1 0 universal public domain dedication"),
    ("isc", "permission to use copy modify and or distribute this software",
     "permission to use copy modify and or distribute this software for any purpose with or "
     "without fee is hereby granted"),
    ("unlicense", "free and unencumbered software",
     "this is free and unencumbered software released into the public domain"),
    ("gpl", "gnu general public license",
     "This work is licensed under the GNU General Public License, version 3."),
    ("apache", "apache license version 2 0", "Licensed under the Apache License, Version 2.0."),
    ("mit", "mit license", "Released under the MIT License."),
    ("mit", "permission is hereby granted free of charge",
     "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
     "and associated documentation files (the \"Software\"), to deal in the Software without "
     "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
     "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom "
     "the Software is furnished to do so, subject to the following conditions: The above copyright "
     "notice and this permission notice shall be included in all copies or substantial portions of "
     "the Software. The software is provided \"as is\", without warranty of any kind, express or "
     "implied, including but not limited to the warranties of merchantability, fitness for a "
     "particular purpose and noninfringement. In no event shall the authors or copyright holders "
     "be liable for any claim, damages or other liability, whether in an action of contract, tort "
     "or otherwise, arising from, out of or in connection with the software or the use or other "
     "dealings in the software."),
    ("bsd", "redistribution and use in source and binary forms",
     "Redistribution and use in source and binary forms, with or without modification, are "
     "permitted provided that the following conditions are met: 1. Redistributions of source code "
     "must retain the above copyright notice, this list of conditions and the following "
     "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
     "this list of conditions and the following disclaimer in the documentation and/or other "
     "materials provided with the distribution."),
    ("isc", "permission to use copy modify and or distribute this software",
     "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
     "without fee is hereby granted, provided that the above copyright notice and this permission "
     "notice appear in all copies."),
    ("apache", "apache license version 2 0",
     "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
     "except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
     "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT "
     "WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the "
     "specific language governing permissions and limitations under the License."),
    ("gpl", "gnu general public license",
     "This program is free software: you can redistribute it and/or modify it under the terms of "
     "the GNU General Public License as published by the Free Software Foundation, either version "
     "3 of the License, or (at your option) any later version. This program is distributed in the "
     "hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
     "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
     "more details."),
    ("mpl", "mozilla public license",
     "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
     "copy of the MPL was not distributed with this file, You can obtain one at "
     "http://mozilla.org/MPL/2.0/."),
]

_SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOTICES = [
    (label, key.split(), re.findall("[a-z0-9]+", text.lower())) for label, key, text in TEMPLATES
]
"""(label, words of the key phrase, words) of the templates."""
_VOCABULARY = sorted({word for _, _, words in NOTICES for word in words})
_BASE_HINT = "(?i)" + "|".join(_BETWEEN.join(phrase.split()) for phrase in BASE)


def _texts(documents: DataFrame) -> DataFrame:
    """doc_id, row_text (a hash of the text) and the text, null as empty."""
    return documents.select(
        "doc_id", F.xxhash64("text").alias("row_text"), F.coalesce("text", F.lit("")).alias("text")
    )


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), _SEPARATOR), "")


def _array(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ") if words else F.array().cast("array<string>")


def _present(words: Column) -> Column:
    return F.array_intersect(_array(_VOCABULARY), words)


def _seen(documents: DataFrame) -> DataFrame:
    """Each row's number of words, base places and distinct licence words, without its text."""
    rows = _texts(documents).withColumn("words", _words(F.col("text")))
    return rows.select(
        "doc_id",
        "row_text",
        F.size("words").cast("long").alias("n_words"),
        F.when(F.col("text").rlike(_BASE_HINT) & (F.size("words") > 0), _based()).alias("base"),
        _present(F.col("words")).alias("present"),
    )


def weights(seen: DataFrame) -> dict[str, float]:
    """The inverse document frequency of each licence word, from rows of `_seen`.

    What comes to the driver is one number per licence word.
    """
    counted = (
        seen.select(F.explode(F.concat("present", _array([""]))).alias("word"))
        .groupBy("word")
        .count()
        .collect()
    )
    frequency = {row["word"]: row["count"] for row in counted}
    total = frequency.get("", 0)
    return {word: math.log((2 + total) / (1 + frequency.get(word, 0))) for word in _VOCABULARY}


def _phrase_at(words: Column, place: Column, phrase: str) -> Column:
    parts = phrase.split()
    found = F.get(words, place) == parts[0]
    for i, part in enumerate(parts[1:], 1):
        found = found & (F.get(words, place + i) == part)
    return F.coalesce(found, F.lit(False))


def _based() -> Column:
    """The places of the base phrases in `words`, (place, label) in order."""

    def label(place):
        found = F.lit(None).cast("string")
        for phrase, name in BASE.items():
            found = F.when(_phrase_at(F.col("words"), place, phrase), F.lit(name)).otherwise(found)
        return F.struct(place.cast("long").alias("place"), found.alias("label"))

    places = F.sequence(F.lit(0), F.size("words") - 1)
    return F.filter(F.transform(places, label), lambda x: x["label"].isNotNull())


def _key_at(key: list[str], words: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def _rarest(weighed: dict[str, float]) -> Column:
    """Each notice's distinct words, rarest first, with the weight of all their places."""
    notices = []
    for i, (_, _, words) in enumerate(NOTICES):
        masses = [
            {"word": word, "mass": weighed[word] * words.count(word)}
            for word in sorted(set(words), key=lambda word: (-weighed[word], word))
        ]
        least = LEAST * sum(weighed[word] for word in words)
        notices.append({"template": i, "least": least, "masses": masses})
    shape = "array<struct<template:int,least:double,masses:array<struct<word:string,mass:double>>>>"
    return F.from_json(F.lit(json.dumps(notices)), shape)


def _mass(words: Column) -> Column:
    return F.aggregate(words, F.lit(0.0), lambda total, x: total + x["mass"])


def _prefix(own: Column, least: Column) -> Column:
    """(words, rest): the first words until the others weigh less than the least share, and what
    these weigh."""
    return F.aggregate(
        own,
        F.struct(_array([]).alias("words"), _mass(own).alias("rest")),
        lambda done, x: F.when(
            done["rest"] >= least - _SLACK,
            F.struct(
                F.array_append(done["words"], x["word"]).alias("words"),
                (done["rest"] - x["mass"]).alias("rest"),
            ),
        ).otherwise(done),
    )


def _candidates(documents: DataFrame, weighed: dict[str, float]) -> DataFrame:
    """Texts whose licence words could reach a notice's least share: their words, and for each
    such notice the words to look up."""
    rows = _texts(documents).withColumn("words", _words(F.col("text")))

    def reachable(present):
        held = F.transform(
            _rarest(weighed),
            lambda t: F.struct(
                t["template"].alias("template"),
                t["least"].alias("least"),
                F.filter(t["masses"], lambda x: F.array_contains(present, x["word"])).alias("own"),
            ),
        )
        return F.filter(held, lambda t: _mass(t["own"]) >= t["least"] - _SLACK)

    # A generator of one element, so that the words present are computed once a row and only where
    # a needed word stands.
    needed = F.arrays_overlap("words", _array(_needed(weighed)))
    once = F.transform(
        F.array(_present(F.col("words"))),
        lambda present: F.struct(F.col("words").alias("words"), reachable(present).alias("notices")),
    )
    found = F.filter(F.when(needed, once), lambda x: F.size(x["notices"]) > 0)
    return rows.select("doc_id", "row_text", F.explode(found).alias("found")).select(
        "doc_id", "row_text", "found.words", "found.notices"
    )


def _needed(weighed: dict[str, float]) -> list[str]:
    """Words of which a text with the least share of a notice holds one at least: each notice's
    rarest words, until the others weigh less than that share."""
    needed = set()
    for _, _, words in NOTICES:
        rest = total = sum(weighed[word] for word in words)
        for word in sorted(set(words), key=lambda word: (-weighed[word], word)):
            if rest < LEAST * total - _SLACK:
                break
            needed.add(word)
            rest -= weighed[word] * words.count(word)
    return sorted(needed)


def _postings(spark, weighed) -> DataFrame:
    """(word, template, at, weight): a small table of fixed size."""
    rows = [
        (word, i, at, weighed[word])
        for i, (_, _, words) in enumerate(NOTICES)
        for at, word in enumerate(words)
    ]
    return spark.createDataFrame(rows, "word string, template int, at int, weight double")


def _placed(candidates: DataFrame, weighed: dict[str, float]) -> DataFrame:
    """(doc_id, row_text, template, shift): places of notices that their looked-up words allow."""
    looked = candidates.select("doc_id", "row_text", "words", F.explode("notices").alias("n")).select(
        "doc_id", "row_text", "words", "n.template", "n.least", _prefix(F.col("n.own"), F.col("n.least")).alias("look")
    )
    places = F.filter(
        F.transform("words", lambda word, i: F.struct(word.alias("word"), i.alias("place"))),
        lambda x: F.array_contains("look.words", x["word"]),
    )
    found = looked.select(
        "doc_id", "row_text", "template", (F.col("least") - F.col("look.rest")).alias("needed"), F.explode(places).alias("w")
    ).select("doc_id", "row_text", "template", "needed", "w.word", "w.place")
    postings = F.broadcast(_postings(candidates.sparkSession, weighed))
    return (
        found.join(postings, ["word", "template"])
        .groupBy("doc_id", "row_text", "template", (F.col("place") - F.col("at")).alias("shift"))
        .agg(F.sum("weight").alias("mass"), F.min("needed").alias("needed"))
        .where(F.col("mass") >= F.col("needed") - _SLACK)
        .select("doc_id", "row_text", "template", "shift")
    )


def _notices(spark, weighed) -> DataFrame:
    """(template, label, notice words, their weights, the key phrase's first and last place)."""
    rows = []
    for i, (label, key, words) in enumerate(NOTICES):
        at = _key_at(key, words)
        rows.append((i, label, words, [weighed[word] for word in words], at, at + len(key) - 1))
    shape = "template int, label string, notice array<string>, weights array<double>, key_first int, key_last int"
    return spark.createDataFrame(rows, shape)


def _found(candidates: DataFrame, weighed: dict[str, float]) -> DataFrame:
    """(doc_id, row_text, label, share, outside, keyed): the notices found, compared word by word."""
    longest = max(len(words) for _, _, words in NOTICES)
    last = F.floor((F.size("words") - 1) / BLOCK).cast("int")
    blocks = candidates.select(
        F.col("doc_id").alias("__id"),
        F.col("row_text").alias("__text"),
        F.explode(
            F.transform(
                F.sequence(F.lit(0), last),
                lambda b: F.struct(
                    b.alias("block"), F.slice("words", b * BLOCK + 1, BLOCK + longest).alias("words")
                ),
            )
        ).alias("__part"),
    )
    placed = _placed(candidates, weighed).withColumn(
        "block", F.greatest(F.floor(F.col("shift") / BLOCK), F.lit(0)).cast("int")
    )
    at_place = placed.join(
        blocks,
        F.col("doc_id").eqNullSafe(F.col("__id"))
        & (F.col("row_text").eqNullSafe(F.col("__text")))
        & (F.col("block") == F.col("__part.block")),
    ).select(
        "doc_id",
        "row_text",
        "template",
        (F.col("shift") - F.col("block") * BLOCK).alias("shift"),
        F.col("__part.words").alias("words"),
    )
    rows = at_place.join(F.broadcast(_notices(candidates.sparkSession, weighed)), "template")
    # A place before the text's first word is no place of the text.
    equal = F.transform(
        "notice",
        lambda word, i: F.coalesce(
            (F.col("shift") + i >= 0) & (F.get("words", F.col("shift") + i) == word), F.lit(False)
        ),
    )
    in_key = lambda i: (i >= F.col("key_first")) & (i <= F.col("key_last"))
    stands = F.zip_with("equal", "weights", lambda there, weight: F.when(there, weight).otherwise(0.0))
    total = F.aggregate("weights", F.lit(0.0), lambda done, x: done + x)
    share = F.aggregate(stands, F.lit(0.0), lambda done, x: done + x) / total
    return (
        rows.withColumn("equal", equal)
        .select(
            "doc_id",
            "row_text",
            "label",
            F.least(share, F.lit(1.0)).alias("share"),
            F.size(F.filter("equal", lambda there, i: there & ~in_key(i))).alias("outside"),
            F.forall(F.slice("equal", F.col("key_first") + 1, F.col("key_last") - F.col("key_first") + 1), lambda x: x).alias("keyed"),
        )
        .where((F.col("share") >= LEAST - _SLACK) & (F.col("outside") > 0))
    )


def scan(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the greatest share of a notice found, at least `NAMED` for a base phrase, else 0),
    candidates (labels of the notices found, with or without their key phrase).

    The texts are read twice, for the document frequencies and for the look-up, and never
    shuffled; of the texts that could hold a notice the words are.
    """
    seen = cut(_seen(documents), "license-words")
    weighed = weights(seen)
    candidates = cut(_candidates(documents, weighed), "licenses")
    hits = (
        _found(candidates, weighed)
        .groupBy("doc_id", "row_text")
        .agg(
            F.collect_set("label").alias("own"),
            F.collect_set(F.when(F.col("keyed"), F.col("label"))).alias("keyed"),
            F.max("share").alias("share"),
        )
    )
    none = F.array().cast("array<string>")
    base = F.coalesce(F.transform("base", lambda x: x["label"]), none)
    places = F.transform("base", lambda x: x["place"])

    def joined(labels):
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    return _same(seen.drop("present"), hits).select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(places).alias("first_word"),
        F.array_max(places).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, F.coalesce("keyed", none))).alias("labels"),
        F.greatest(
            F.coalesce("share", F.lit(0.0)), F.when(F.size(base) > 0, F.lit(NAMED)).otherwise(0.0)
        ).alias("score"),
        joined(F.coalesce("own", none)).alias("candidates"),
    )


def _same(left: DataFrame, right: DataFrame) -> DataFrame:
    """Left join on (doc_id, row_text), null ids being equal."""
    other = right.withColumnsRenamed({"doc_id": "__id", "row_text": "__text"})
    joined = left.join(
        other,
        left["doc_id"].eqNullSafe(other["__id"]) & (left["row_text"] == other["__text"]),
        "left",
    )
    return joined.drop("__id", "__text")
