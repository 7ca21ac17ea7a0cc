r"""License texts found by phrases and by a set-similarity join with templates.

Built from DataFrame functions only. The base places are those where the words
of a phrase stand one after another. Beside these, blocks of text are joined
with license templates: a block meets a template when it contains at least the
template's threshold of its distinct words.

Blocks are windows of a text's words, of twice the template's length class and
with steps of that class, so any stretch as long as the template is inside one.
Words have one global order, rarest in the documents first. A block can only
meet a template if it has one of the first words of the template in that order,
as many as the threshold may miss and one more (the prefix); only texts with
such a word are cut into blocks. The join goes over the prefix words. It keeps a
pair at the first word that both have, if the block is long enough and if what
follows the word in both suffices for the threshold; then all words are compared.

Templates and phrases are parameters of a fixed number, so what is broadcast
does not grow with the data.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import materialize

#: Phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Label, least share of the template's distinct words, template. Short statements must be there in full.
TEMPLATES = [
    ("mit", 1.0, "Released under the MIT License"),
    ("mit", 0.8, "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software "
                 "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", 1.0, "Licensed under the Apache License, Version 2.0"),
    ("apache", 0.8, "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR "
                    "CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("gpl", 1.0, "licensed under the GNU General Public License"),
    ("gpl", 0.8, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
                 "Foundation, either version 3 of the License, or any later version"),
    ("cc-by", 0.8, "This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this license, visit creativecommons.org licenses by 4.0"),
    ("cc-by-nc", 1.0, "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", 1.0, "Licensed under CC BY-SA 4.0"),
    ("bsd", 0.8, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", 0.8, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright "
                 "notice and this permission notice appear in all copies"),
    ("mpl", 0.8, "This Source Code Form is subject to the terms of the Mozilla Public License. If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: str) -> list[str]:
    """The words of a template."""
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(str.maketrans(_UPPER, _UPPER.lower())))


def spaced(text: Column) -> Column:
    """The words of a text, A-Z in lower case, with one space between them and at both ends; of no words, one space."""
    lower = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.regexp_replace(F.concat(F.lit(" "), lower, F.lit(" ")), _NO_WORD, " ")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")


def length_class(n: int) -> int:
    """The power of two that ``n`` words fit in, at least 8."""
    return max(8, 1 << (n - 1).bit_length())


def word_order(docs: DataFrame, vocabulary: list[str], text_col: str) -> list[str]:
    """The words of templates by the number of documents that have them, rarest first, then by themselves."""
    held = docs.select(F.explode(F.array_intersect(_strings(vocabulary), F.split(spaced(F.col(text_col)), " ", -1))).alias("word"))
    counts = {r["word"]: r["n"] for r in held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each word of a template
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def places(words: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after another."""
    parts = words_of(phrase)
    starts = F.sequence(F.lit(0), F.size(words) - len(parts))
    here = lambda i: F.slice(words, i + 1, len(parts)) == _strings(parts)
    return F.when(F.size(words) >= len(parts), F.filter(starts, here)).otherwise(F.array().cast("array<int>"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))


class _Template:
    """A template's distinct words in the global order, how many must be met, and its prefix."""

    def __init__(self, at: int, label: str, share: float, words: list[str], order: list[str]):
        place = {w: i for i, w in enumerate(order)}
        self.at, self.label, self.size = at, label, length_class(len(words))
        self.words = sorted(set(words), key=place.__getitem__)
        self.least = math.ceil(share * len(self.words) - 1e-9)
        self.prefix = self.words[: len(self.words) - self.least + 1]


def _blocks(words: str, size: int, vocabulary: list[str], least: int) -> Column:
    """The windows of one class that hold ``least`` words of its templates; ``held`` has these in the global order."""
    cut = lambda s: F.array_intersect(_strings(vocabulary), F.slice(words, s + 1, 2 * size))
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 1, F.lit(size)), lambda s: F.struct(F.lit(size).alias("size"), s.alias("start"), cut(s).alias("held")))
    return F.filter(windows, lambda b: F.size(b["held"]) >= least)


def meeting(texts: DataFrame, table: list[_Template], order: list[str], keys: list[str], words: str) -> DataFrame:
    """``keys, label, start, words, containment`` of the blocks of ``texts`` that meet a template."""
    spark = texts.sparkSession
    index = spark.createDataFrame(
        [(w, t.size, i, t.at, t.label, t.least, t.words) for t in table for i, w in enumerate(t.prefix)],
        "word string, size int, i int, at int, label string, least int, template array<string>")
    parts = []
    for size in sorted({t.size for t in table}):
        own = [t for t in table if t.size == size]
        here = {w for t in own for w in t.words}
        parts.append(_blocks(words, size, [w for w in order if w in here], min(t.least for t in own)))
    blocks = texts.where(F.size(words) > 0).select(*keys, F.size(words).alias("of"), F.explode(F.concat(*parts)).alias("b")).select(*keys, "of", "b.*")
    listed = blocks.select(*keys, "of", "size", "start", "held", F.posexplode("held").alias("j", "word"))
    pairs = listed.join(F.broadcast(index), ["word", "size"])  # the index has a row for each prefix word
    n, m = F.size("template"), F.size("held")
    pairs = pairs.where((m >= F.col("least")) & (1 + F.least(n - 1 - F.col("i"), m - 1 - F.col("j")) >= F.col("least")))
    pairs = pairs.where(F.size(F.array_intersect(F.slice("template", 1, F.col("i")), "held")) == 0)  # the first word of both
    common = F.size(F.array_intersect("template", "held"))
    return pairs.where(common >= F.col("least")).select(
        *keys, "label", F.col("start").cast("long").alias("start"), F.least(2 * F.col("size"), F.col("of") - F.col("start")).cast("long").alias("words"), (common / n).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, float, str]] | None = None, phrases: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks`` of each row.

    ``blocks`` lists the label, first word, number of words and containment of
    each block that meets a template. ``score`` is 1 where a phrase stands, else
    the greatest containment of these blocks, or 0. Labels are distinct, sorted
    and joined by commas.

    A null or empty text has no words, no labels and the score 0. Texts of any
    length are read whole. Repeated rows, and rows without an id, each have
    their own result. Other columns are not read, whatever their names. An empty
    table gives an empty result.
    """
    templates, phrases = TEMPLATES if templates is None else templates, PHRASES if phrases is None else phrases
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    order = word_order(docs, sorted({w for _, _, t in templates for w in words_of(t)}), "text")
    table = [_Template(k, label, share, words_of(text), order) for k, (label, share, text) in enumerate(templates)]
    cut = docs.select("doc_id", spaced(F.col("text")).alias("line")).withColumn("split", F.split("line", " ", -1))
    said = F.lit(False)
    for p in phrases:
        said = said | F.contains("line", F.lit(f" {' '.join(words_of(p))} "))
    cut = cut.withColumns({"rare": F.arrays_overlap("split", _strings(sorted({w for t in table for w in t.prefix}))), "said": said})
    found = [_labelled(places(F.col("all_words"), p), label) for p, label in phrases.items()]
    none = F.array().cast("array<struct<at:bigint,label:string>>")
    held = cut.select(
        "doc_id", F.xxhash64("line").alias("row_key"), (F.size("split") - 2).cast("long").alias("n_words"), "rare", "said",
        F.when(F.col("rare") | F.col("said"), F.filter("split", lambda w: w != "")).alias("all_words"))
    held = held.select("doc_id", "row_key", "n_words", F.when(F.col("rare"), F.col("all_words")).alias("words"), F.when(F.col("said"), F.concat(none, *found)).otherwise(none).alias("places"))
    held = materialize(held, "license-words")

    hits = meeting(held.where("words is not null"), table, order, ["doc_id", "row_key"], "words")
    hits = hits.groupBy("doc_id", "row_key").agg(F.array_sort(F.collect_set(F.struct("start", "words", "label", "containment"))).alias("blocks"))
    hits = materialize(hits, "license-blocks").toDF("at_id", "at_key", "blocks")
    out = held.drop("words").join(hits, F.col("doc_id").eqNullSafe(F.col("at_id")) & (F.col("row_key") == F.col("at_key")), "left")
    blocks = F.coalesce("blocks", F.array().cast(dict(hits.dtypes)["blocks"]))
    base = F.transform("places", lambda x: x["label"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    starts = F.transform("places", lambda x: x["at"])
    n = F.size("places").cast("long")
    score = F.when(n > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(blocks, lambda b: b["containment"])), F.lit(0.0)))
    return out.select(
        "doc_id", "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), joined(base).alias("base_labels"),
        joined(F.concat(base, F.transform(blocks, lambda b: b["label"]))).alias("labels"), score.alias("score"), blocks.alias("blocks"))


def _sql(templates=tuple(TEMPLATES), phrases=tuple(PHRASES.items())) -> str:
    quoted = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    base = " || ".join(f"list_transform(list_filter(range(n), lambda i: w[i + 1:i + {len(words_of(p))}] = {quoted(words_of(p))}), lambda i: {{'at': i, 'label': '{label}'}})" for p, label in phrases)
    shares = []
    for label, share, text in templates:
        words, size = sorted(set(words_of(text))), length_class(len(words_of(text)))
        least = math.ceil(share * len(words) - 1e-9)
        common = f"coalesce(list_max(list_transform(range(0, n, {size}), lambda s: len(list_intersect(list_distinct(w[s + 1:s + {2 * size}]), {quoted(words)})))), 0)"
        shares.append(f"{{'label': '{label}', 'common': {common}, 'least': {least}, 'of': {len(words)}}}")
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
n AS (SELECT doc_id, w, len(w) AS n FROM d),
b AS (SELECT doc_id, n, {base} AS base, list_filter([{', '.join(shares)}], lambda t: t.common >= t.least) AS met FROM n)
SELECT doc_id, n AS n_words, len(base)::BIGINT AS n_base, list_min(list_transform(base, lambda x: x.at)) AS first_word, list_max(list_transform(base, lambda x: x.at)) AS last_word,
array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label))), ',') AS base_labels,
array_to_string(list_sort(list_distinct(list_transform(base, lambda x: x.label) || list_transform(met, lambda x: x.label))), ',') AS labels,
CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(list_max(list_transform(met, lambda x: x.common / x.of)), 0.0) END::DOUBLE AS score FROM b
"""


SQL = _sql()
