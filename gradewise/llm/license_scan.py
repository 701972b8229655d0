"""License scans: phrases, and an exact set-similarity join of text blocks with license notices.

The notices are a table (label, notice); what follows a slash in a label tells notices of one license
apart. A block is any run of a text's words that is as long as a notice, repeats included; it meets the
notice if it holds at least ``THRESHOLD`` of its distinct words. Every such block is found:

- all words of all texts are counted, and each notice's words are ordered from the rarest on;
- prefix filter: a block that lacks the first ``n - need + 1`` of a notice's ``n`` words can't reach
  ``need``, so texts are joined with the notices on those words alone, and each hit stands for the
  blocks around it;
- length filter: the words around a hit must be ``need`` at least;
- positional filter: the prefix words around the hit, and the words of the notice after the last of
  them, must together reach ``need``;
- what passes is verified: the whole overlap of each block that holds the hit.

The join runs on words of the notices, which are broadcast up to ``BROADCAST_WORDS`` words of notices,
and never moves a text. What it finds goes back to the documents by the digest of the text (two 64-bit
hashes), broadcast up to ``BROADCAST_TEXTS`` texts. Everything is built-in DataFrame functions.

Defined results: a null or empty text has no words, no place and score 0; the score is 1 for a base
phrase, else the share of the best block that meets a notice, else 0; repeated rows each give a row;
null ids pass through; an empty table gives an empty result; other columns pass through under their
names, or give way to a new column of the same name in any case; of repeated notices one counts.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradewise.llm.common import cut, fresh, others, quoted, table

#: Fixed phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
THRESHOLD = 0.8

#: Most words of notices, over their prefixes, and most texts with a notice that are broadcast.
BROADCAST_WORDS, BROADCAST_TEXTS = 2_000_000, 200_000
NEW = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")

#: Paragraphs of well-known license notices.
NOTICES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
        modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is
        furnished to do so, subject to the following conditions""",
    "mit/warranty": """The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
        warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be
        liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in
        connection with the software or the use or other dealings in the software""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and
        the following disclaimer""",
    "bsd/binary": """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
        disclaimer in the documentation and/or other materials provided with the distribution""",
    "bsd/names": """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products
        derived from this software without specific prior written permission""",
    "bsd/warranty": """This software is provided by the copyright holders and contributors "as is" and any express or implied warranties,
        including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event
        shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
        the License. You may obtain a copy of the License at""",
    "apache/basis": """Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
        "as is" basis, without warranties or conditions of any kind, either express or implied. See the License for the specific language
        governing permissions and limitations under the License""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License
        as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version""",
    "lgpl": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
        License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version""",
    "agpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
        provided that the above copyright notice and this permission notice appear in all copies""",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
        any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including
        commercial applications, and to alter it and redistribute it freely, subject to the following restrictions""",
    "boost": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
        Software, and to prepare derivative works of the Software""",
    "unlicense": """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
        compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
        non-commercial, and by any means""",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "cc0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. This work
        is published under CC0""",
}


def notice_words(text: str) -> list[str]:
    return [w for w in re.split(SEPARATORS, text.lower()) if w]


def words_of(text: Column) -> Column:
    """The words of a text, with A-Z in lower case; null is empty."""
    low = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(low, SEPARATORS), "")


def digest(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text; null is empty."""
    whole = F.coalesce(text.cast("string"), F.lit(""))
    return [F.xxhash64(whole).alias("low"), F.xxhash64(F.lit(1), whole).alias("high")]


def templates(notices: DataFrame, docs: DataFrame, threshold: float, text: str) -> DataFrame:
    """(label, words from the rarest in all texts on, n, length, need) of each notice with words."""
    each = notices.select("label", words_of(F.col("notice")).alias("all")).where("size(all) > 0").distinct()
    each = each.select("label", F.size("all").alias("length"), F.array_distinct("all").alias("words")).withColumn("number", F.xxhash64("label", "words"))
    each = cut(each.dropDuplicates(["number"]))
    vocabulary = each.select(F.explode("words").alias("word")).distinct()
    seen = docs.select(F.explode_outer(words_of(quoted(text))).alias("word")).join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count("*").alias("n_seen"))
    rare = each.select("number", F.explode("words").alias("word")).join(F.broadcast(seen), "word", "left")
    order = rare.groupBy("number").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n_seen", F.lit(0)).alias("n_seen"), "word"))).alias("order"))
    n = F.size("words")
    return cut(
        each.select("number", "label", "length").join(order.select("number", F.col("order.word").alias("words")), "number")
        .select("label", "words", n.alias("n"), "length", F.ceil(F.lit(threshold) * n - 1e-9).cast("int").alias("need"))
    )


def blocks_that_meet(docs: DataFrame, notices: DataFrame, text: str) -> DataFrame:
    """(low, high, label, share): by text digest, the notices of ``templates`` that a block meets, and
    the largest share of their words in one."""
    prefix = F.slice("words", 1, F.col("n") - F.col("need") + 1)
    tokens = notices.withColumn("prefix", prefix)
    size = tokens.agg(F.sum(F.size("prefix") * F.col("n"))).first()[0] or 0
    tokens = tokens.select(F.explode("prefix").alias("word"), "*")
    tokens = F.broadcast(tokens) if size <= BROADCAST_WORDS else tokens
    spread = docs.select(*digest(quoted(text)), words_of(quoted(text)).alias("held")).select("low", "high", "held", F.posexplode_outer("held").alias("at", "word"))
    # The words that share a block with the hit. No lambda stands here: generated code streams from the
    # texts to the sums, and no row but a hit's is made.
    start = F.greatest(F.col("at") - F.col("length") + 2, F.lit(1))
    around = F.slice("held", start, F.col("at") + F.col("length") - start + 1)
    near = spread.join(tokens, "word").select("low", "high", "label", "words", "n", "need", "length", "prefix", around.alias("around"), F.sequence(F.lit(1), F.col("at") - start + 2).alias("starts"))
    first = F.array_intersect("prefix", "around")  # in the order of the prefix
    last = F.array_position("prefix", F.try_element_at(first, F.lit(-1)))
    near = near.where(F.size("around") >= F.col("need")).where(F.size(first) + F.col("n") - last >= F.col("need"))
    near = near.where(F.size(F.array_intersect("words", "around")) >= F.col("need"))
    near = near.select("low", "high", F.substring_index("label", "/", 1).alias("label"), "words", "n", "need", "length", "around", F.explode_outer("starts").alias("start"))
    best = F.size(F.array_intersect("words", F.slice("around", F.col("start"), F.col("length"))))
    found = near.withColumn("best", best).where("best >= need")
    return found.groupBy("low", "high", "label").agg(F.max(F.col("best") / F.col("n")).alias("share"))


def phrase_places(words: Column, phrase: str) -> Column:
    """The places, from 0, where a phrase's words stand consecutively."""
    parts = phrase.split(" ")
    last = F.size(words) - len(parts)
    starts = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.filter(starts, lambda i: reduce(Column.__and__, [F.get(words, i + j) == p for j, p in enumerate(parts)]))


def scan(
    docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, str] | DataFrame = NOTICES, threshold: float = THRESHOLD, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """Adds n_words, n_base, first_word, last_word, base_labels, labels and score; ``notices`` is a
    table (label, notice), or these by label."""
    if isinstance(notices, dict):
        notices = docs.sparkSession.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("label"), F.lit(v).alias("notice")) for k, v in notices.items()])))
    met = blocks_that_meet(docs, templates(notices, docs, threshold, text), text)
    met = cut(met.groupBy("low", "high").agg(F.collect_set("label").alias("more"), F.max("share").alias("share")))
    met = F.broadcast(met) if met.count() <= BROADCAST_TEXTS else met
    kept = others(docs.columns if keep is None else keep, NEW)
    row = F.struct(*[quoted(c) for c in kept], F.lit(0).alias(fresh("none", kept)))
    rows = docs.select(row.alias("row"), *digest(quoted(text)), words_of(quoted(text)).alias("words"))
    words, none = F.col("words"), F.array().cast("array<int>")
    marks = F.array(*map(F.lit, sorted({max(p.split(" "), key=len) for p in phrases})))
    places = F.when(F.arrays_overlap(words, marks), F.array(*[phrase_places(words, p) for p in phrases])).otherwise(F.array(*[none for _ in phrases]))
    rows = rows.select("row", "low", "high", F.size(words).cast("bigint").alias("n_words"), places.alias("places"))
    base = F.array_compact(F.array(*[F.when(F.size(F.get("places", F.lit(i))) > 0, F.lit(label)) for i, label in enumerate(phrases.values())]))
    rows = rows.select("row", "low", "high", "n_words", F.flatten("places").alias("every"), base.alias("base")).join(met, ["low", "high"], "left")
    shown = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return rows.select(
        *[F.col("row").getField(c).alias(c) for c in kept],
        "n_words",
        F.size("every").cast("bigint").alias("n_base"),
        F.array_min("every").cast("bigint").alias("first_word"),
        F.array_max("every").cast("bigint").alias("last_word"),
        shown(F.col("base")).alias("base_labels"),
        shown(F.concat("base", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


QUERIES = {"op1_license_scan": op1_license_scan}
