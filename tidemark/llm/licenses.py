"""License scans by an exact set-similarity join of license templates and text blocks, in DataFrame functions only.

A text is cut into overlapping blocks of words at a few scales, so that a passage as long as a template lies
whole in one block of the template's scale. A block meets a template if it contains a given share of the
template's distinct words. Words are ordered globally, rarest in the corpus first. If a template of s words
needs a of them, it shares one of its s - a + 1 rarest with one of the m - a + 1 rarest template words of any
block that meets it (prefix filter), the block has a words or more (length filter), and what comes after the
first shared word must be enough (positional filter). What remains is counted exactly. Words in no template
never count, so blocks are compared without them.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table, whole_text

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Phrases whose places are counted, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Share of a template's distinct words that a block must contain; of one-line notices all of them.
CONTAINMENT, NOTICE = 0.8, 1.0
#: Public license texts, an excerpt each: name, label, share, words.
TEMPLATES = (
    ("mit_grant", "mit", CONTAINMENT, "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache_notice", "apache", CONTAINMENT, "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("gpl_notice", "gpl", CONTAINMENT, "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl_notice", "lgpl", CONTAINMENT, "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("bsd_conditions", "bsd", CONTAINMENT, "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("isc_grant", "isc", CONTAINMENT, "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl_notice", "mpl", CONTAINMENT, "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "unlicense", CONTAINMENT, "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc_notice", "cc", NOTICE, "licensed under cc by"),
    ("cc_long_notice", "cc", NOTICE, "licensed under a creative commons attribution"),
    ("mit_notice", "mit", NOTICE, "released under the mit license"),
    ("apache_short", "apache", NOTICE, "licensed under the apache license version"),
    ("gpl_short", "gpl", NOTICE, "licensed under the gnu general public license"),
    ("spdx_mit", "mit", NOTICE, "spdx license identifier mit"),
    ("spdx_apache", "apache", NOTICE, "spdx license identifier apache"),
    ("spdx_gpl", "gpl", NOTICE, "spdx license identifier gpl"),
)


class Template:
    """A template's distinct words, how many of them a block needs, and the words of its blocks."""

    def __init__(self, name: str, label: str, share: float, text: str):
        words = text.split()
        self.name, self.label, self.words = name, label, list(dict.fromkeys(words))
        self.size, self.least = len(self.words), ceil(share * len(self.words) - 1e-9)
        self.scale = 2 ** (1 + ceil(len(words)).bit_length())


def prepared(templates: tuple) -> list[Template]:
    return [Template(*t) for t in templates]


def lowered(text: str | Column) -> Column:
    return F.translate(whole_text(text), UPPER, LOWER)


def texts(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def places_of(words: Column, phrases: dict[str, str]) -> Column:
    """at and label of every place where the words of a phrase stand consecutively."""
    def label_at(word: Column, i: Column) -> Column:
        tests = [(reduce(lambda a, b: a & b, [word == p[0], *[F.get(words, i + k) == w for k, w in enumerate(p) if k]]), label) for p, label in ((p.split(), label) for p, label in phrases.items())]
        return reduce(lambda made, t: made.when(t[0], F.lit(t[1])), tests[1:], F.when(tests[0][0], F.lit(tests[0][1])))

    return F.filter(F.transform(words, lambda w, i: F.struct(i.cast("long").alias("at"), label_at(w, i).alias("label"))), lambda x: x["label"].isNotNull())


def blocks_of(words: Column, templates: list[Template]) -> Column:
    """Blocks of one scale: first, scale, tokens (its template words), where the length filter of some template holds.

    A block begins at every multiple of half the scale.
    """
    scale, least = templates[0].scale, min(t.least for t in templates)
    known = texts(sorted({w for t in templates for w in t.words}))
    starts = F.sequence(F.lit(0), F.floor(F.greatest(F.size(words) - 1, F.lit(0)) / (scale // 2)).cast("int"))
    # Words are read by place: a slice would copy the whole array for each block.
    part = lambda i: F.transform(F.sequence(i * (scale // 2), F.least(i * (scale // 2) + scale, F.size(words)) - 1), lambda j: F.get(words, j))
    made = F.transform(starts, lambda i: F.struct((i * (scale // 2)).cast("long").alias("first"), F.lit(scale).alias("scale"), F.array_intersect(part(i), known).alias("tokens")))
    return F.filter(made, lambda b: F.size(b["tokens"]) >= least)


def scanned(docs: DataFrame, templates: list[Template], phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row: row (its number), doc_id, n_words, places, present (template words in it), blocks of all scales; stored.

    Blocks are cut only where the whole text has words enough for some template of their scale.
    """
    text = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), lowered("text").alias("text"))
    cut = text.select("doc_id", "row", F.exists(texts([p.split()[-1] for p in phrases]), lambda w: F.contains(F.col("text"), w)).alias("told"), F.regexp_extract_all("text", F.lit(WORD), 0).alias("words"))
    words = F.col("words")
    seen = cut.select("doc_id", "row", "told", "words", F.array_intersect(words, texts(sorted({w for t in templates for w in t.words}))).alias("present"))
    none = F.array().cast("array<struct<first:bigint,scale:int,tokens:array<string>>>")
    scales = {t.scale: [x for x in templates if x.scale == t.scale] for t in templates}
    enough = lambda held: reduce(lambda a, b: a | b, [F.size(F.array_intersect("present", texts(t.words))) >= t.least for t in held])
    blocks = F.concat(*[F.when(enough(held), blocks_of(words, held)).otherwise(none) for held in scales.values()])
    places = F.when(F.col("told"), places_of(words, phrases)).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))
    return stored(seen.select("doc_id", "row", F.size("words").cast("long").alias("n_words"), places.alias("places"), "present", blocks.alias("blocks")), "license-words")


def global_order(seen: DataFrame, templates: list[Template]) -> list[str]:
    """All template words, rarest in the corpus first (number of texts that have it), ties by the word.

    The driver sees one count for each word of the templates.
    """
    counts = {r["word"]: r["count"] for r in seen.select(F.explode("present").alias("word")).groupBy("word").count().collect()}
    return sorted({w for t in templates for w in t.words}, key=lambda w: (counts.get(w, 0), w))


def meeting(seen: DataFrame, templates: list[Template]) -> DataFrame:
    """row, doc_id, template, label, first, scale, shared, size: every block that meets a template, once."""
    order = global_order(seen, templates)
    rank = {w: i for i, w in enumerate(order)}
    prefixes = [(w, t.scale, t.name, t.label, i, t.size, t.least, t.words) for t in templates for i, w in enumerate(sorted(t.words, key=rank.get)[: t.size - t.least + 1])]
    # One row for each prefix word of the given templates.
    known = F.broadcast(seen.sparkSession.createDataFrame(prefixes, "word string, scale int, template string, label string, i int, size int, least int, words array<string>"))
    blocks = seen.select("row", "doc_id", F.explode("blocks").alias("block")).select("row", "doc_id", "block.first", "block.scale", F.array_intersect(texts(order), "block.tokens").alias("tokens"))
    dealt = blocks.select("*", F.size("tokens").alias("m"), F.posexplode("tokens").alias("j", "word"))
    left, here = F.col("m") - F.col("j"), F.col("size") - F.col("i")
    near = dealt.join(known, ["word", "scale"]).filter((F.col("m") >= F.col("least")) & (left >= F.col("least")) & (F.least(left, here) >= F.col("least")))
    # The rarest shared word stands for the pair: it is the first one both have, so each pair is checked once.
    both = F.array_intersect("tokens", "words")
    checked = near.withColumn("both", both).filter((F.get("both", F.lit(0)) == F.col("word")) & (F.size("both") >= F.col("least")))
    return checked.select("row", "doc_id", "template", "label", "first", "scale", F.size("both").alias("shared"), "size")


def license_blocks(docs: DataFrame, templates: tuple = TEMPLATES) -> DataFrame:
    """doc_id, template, label, first_word, last_word, containment: every block of a text that meets a template.

    Offsets count words from 0, the last one included; the end of the text cuts the last blocks. Neighbouring
    blocks overlap by half, so a passage may stand in two. Null, empty and wordless texts, and an empty table,
    give nothing; repeated rows and ids give their blocks each; texts of any length are cut whole. Only doc_id
    and text are read.
    """
    held = prepared(templates)
    seen = scanned(docs, held)
    found = meeting(seen, held).join(seen.select("row", "n_words"), "row")
    last = F.least(F.col("first") + F.col("scale"), F.col("n_words")) - 1
    return found.select("doc_id", "template", "label", F.col("first").alias("first_word"), last.alias("last_word"), (F.col("shared") / F.col("size")).alias("containment"))


def scan_licenses(docs: DataFrame, templates: tuple = TEMPLATES, phrases: dict[str, str] = PHRASES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    `score` is the largest containment of a template in a block that meets it; a phrase that stands whole counts
    1. Null, empty and wordless texts have no word, no label and score 0; each row stands for itself, whatever
    its id; only doc_id and text are read. An empty table gives an empty result.
    """
    held = prepared(templates)
    seen = scanned(docs, held, phrases)
    best = meeting(seen, held).groupBy("row").agg(F.collect_set("label").alias("met"), F.max(F.col("shared") / F.col("size")).alias("share"))
    base = F.transform("places", lambda p: p["label"])
    whole = seen.select("row", "doc_id", "n_words", "places", base.alias("base")).join(best, "row", "left")
    met = F.coalesce("met", F.array().cast("array<string>"))
    at = F.transform("places", lambda p: p["at"])
    return whole.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(at).alias("first_word"), F.array_max(at).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("base", met)), ",").alias("labels"),
        F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents against all templates."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def license_sql() -> str:
    """The same rows, every block compared with every template by plain counting."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    held = prepared(TEMPLATES)
    templates = ", ".join(f"('{t.label}', {t.scale}, {t.least}, {quoted(t.words)})" for t in held)
    vocabulary = quoted(sorted({w for t in held for w in t.words}))
    cases = " ".join("WHEN " + " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(p.split())) + f" THEN '{label}'" for p, label in PHRASES.items())
    return f"""
WITH cut AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
words AS (
  SELECT row, i, words, CASE {cases} END AS label FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM cut)),
places AS (
  SELECT row, count(*) AS n_base, min(i) - 1 AS first_word, max(i) - 1 AS last_word, list(DISTINCT label) AS base FROM words WHERE label IS NOT NULL GROUP BY row),
known(label, scale, least, tokens) AS (VALUES {templates}),
blocks AS (
  SELECT row, scale, list_intersect({vocabulary}, words[b * scale // 2 + 1 : b * scale // 2 + scale]) AS tokens
  FROM (SELECT row, scale, words, unnest(range(0, greatest(len(words) - 1, 0) // (scale // 2) + 1)) AS b FROM cut, (SELECT DISTINCT scale FROM known))),
met AS (
  SELECT row, list(DISTINCT label) AS met, max(shared / size) AS share
  FROM (SELECT b.row, k.label, k.least, len(k.tokens) AS size, len(list_intersect(b.tokens, k.tokens)) AS shared FROM blocks b JOIN known k USING (scale))
  WHERE shared >= least GROUP BY row)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  array_to_string(list_sort(coalesce(base, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(met, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM cut LEFT JOIN places USING (row) LEFT JOIN met USING (row)
"""


SQL = {"op12_license_scan": license_sql()}
QUERIES = {"op12_license_scan": op12_license_scan}
