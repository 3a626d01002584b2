"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks and templates are sets of words. Words are ordered by their frequency over
the whole corpus, rarest first; a template that a block covers to the threshold
must share one of its first words with it (prefix filter), the block must be
large enough (length filter), and what remains behind the shared word must
suffice (positional filter). Candidates are verified exactly. Words that no
template has cannot matter, so blocks keep only the templates' vocabulary.
A block is a line, a few adjacent lines of a hard-wrapped text, or a paragraph.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import ALNUM_SEPARATOR, ascii_lower, checkpointed

# The contract's phrases and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Label, kind of block and wording of common license notices.
TEMPLATES = (
    ("gpl", "line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "line", "under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("apache", "line", "Licensed under the Apache License, Version 2.0."),
    ("cc-by", "line", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "line", "Licensed under CC BY-NC 4.0."),
    ("mit", "line", "Released under the MIT License."),
    ("reserved", "line", "All rights reserved."),
    ("mpl", "line", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("bsd", "block", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mit", "block", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("isc", "block", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "block", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("apache", "block", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
)

# Words of notices that any English text has; they come last in the order of the first look.
COMMON = ("a", "above", "agreed", "all", "and", "any", "are", "as", "at", "be", "by", "can", "deal", "either", "following", "for", "form", "free", "in", "is", "it", "met", "modify", "notice", "of", "on", "option", "or", "person", "program", "rights", "same", "source", "subject", "terms", "that", "the", "this", "to", "under", "unless", "use", "with", "without", "work", "writing", "you", "your")

#: Share of a template's words that a block must hold.
CONTAINMENT = 0.8

#: A notice may be wrapped over so many lines, each of so many words at most. Templates of kind ``line`` are compared with such runs of lines as well.
WRAPPED_LINES, WRAPPED_WORDS = 3, 30


def words_of(text: Column) -> Column:
    """The contract's words of a text; null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), ALNUM_SEPARATOR), "")


def _template_words(text: str) -> list[str]:
    kept = "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text)
    return sorted(set(kept.split()))


def scan_licenses(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates=TEMPLATES, phrases=None, containment: float = CONTAINMENT) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches), one row per row.

    A block is a line, or two or three adjacent lines of up to 30 words each, for
    templates of kind ``line``, and a paragraph (up to a blank line) for those of kind
    ``block``. ``matches`` lists (label, kind, number of the line or paragraph it begins
    with, containment) of every block that meets the threshold. The templates' words are
    part of the plan, so a large set of templates makes a large plan. ``score`` is 1 with a
    phrase of the contract, else the largest containment found, else 0. Null or
    empty text has no words, no labels and score 0; rows that are the same in id and
    text get the same result; an empty table gives none.
    """
    phrases = PHRASES if phrases is None else phrases
    sets = [(i, label, kind, words, len(words), math.ceil(round(containment * len(words), 9))) for i, (label, kind, wording) in enumerate(templates) if (words := _template_words(wording))]
    vocabulary = sorted({w for x in sets for w in x[3]})
    spark = docs.sparkSession
    least = {kind: min((x[5] for x in sets if x[2] == kind), default=1 << 30) for kind in ("line", "block")}

    # One pass over the texts: counts, phrase places, and blocks that are large enough for some template.
    known = lambda words: F.array_distinct(F.filter(words, lambda w: w.isin(vocabulary)))
    kept = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("words", words_of(F.col("text")))
    # The prefix filter holds in any order: with one that is known beforehand, a text without any template's first words needs no blocks.
    seldom = lambda w: (w in COMMON or w.isdigit(), -len(w), w)
    firsts = sorted({w for _, _, _, words_, m, need in sets for w in sorted(words_, key=seldom)[: m - need + 1]})
    holds = lambda some: F.arrays_overlap("words", F.array(*map(F.lit, some)).cast("array<string>"))
    placed = F.when(holds(sorted({p.split()[0] for p in phrases})), F.flatten(F.array(*(_places(F.col("words"), p.split(), label) for p, label in phrases.items())))).otherwise(F.array().cast("array<struct<at:bigint,label:string>>"))
    line_of = lambda x: F.struct(F.size(x).alias("size"), known(x).alias("tokens"))
    lines = F.transform(F.split("text", "\n"), lambda x: line_of(words_of(x)))
    tokens = F.when(holds(firsts), lines).otherwise(F.array().cast("array<struct<size:int,tokens:array<string>>>"))

    def run(i: Column, n: int) -> Column:
        """The distinct tokens of n lines from the i-th; of several, none if one of them is no wrapped line."""
        parts = [F.get("tokens", i + k) for k in range(n)]
        if n == 1:
            return parts[0]["tokens"]
        short = F.lit(True)
        for x in parts:
            short = short & (x["size"] <= WRAPPED_WORDS)
        return F.when(short, F.array_distinct(F.concat(*(x["tokens"] for x in parts)))).otherwise(F.array().cast("array<string>"))

    block_of = lambda kind, i, words: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("no"), words.alias("tokens"))
    large = lambda blocks, kind: F.filter(blocks, lambda b: F.size(b["tokens"]) >= least[kind])
    none = F.array().cast("array<struct<kind:string,no:int,tokens:array<string>>>")

    def runs_of(n: int) -> Column:
        return large(F.transform(F.slice("tokens", 1, F.greatest(F.size("tokens") - n + 1, F.lit(0))), lambda _, i: block_of("line", i, run(i, n))), "line")

    held = F.aggregate("tokens", F.lit(0), lambda a, x: a + F.size(x["tokens"]))
    numbered = F.when(held >= least["line"], F.concat(*map(runs_of, range(1, WRAPPED_LINES + 1)))).otherwise(none)
    paragraphs = F.split(F.coalesce(F.col("text"), F.lit("")), r"\n[\x20\t\r]*\n")
    # A paragraph can only match if the whole text holds enough of the vocabulary.
    enough = F.size(F.array_distinct(F.flatten(F.transform("tokens", lambda x: x["tokens"])))) >= least["block"]
    blocks = F.when(enough, large(F.transform(paragraphs, lambda p, i: block_of("block", i, known(words_of(p)))), "block")).otherwise(none)
    counted = kept.select("doc_id", "text", F.xxhash64("text").alias("text_key"), F.size("words").cast("bigint").alias("n_words"), "words", tokens.alias("tokens"))
    base = checkpointed(counted.select("doc_id", "text_key", "n_words", placed.alias("places"), F.concat(numbered, blocks).alias("blocks")))

    # Global order: how many blocks hold each word; the vocabulary bounds what is collected.
    counts = base.select(F.explode("blocks").alias("b")).select(F.explode("b.tokens").alias("w")).groupBy("w").count()
    often = {r["w"]: r["count"] for r in counts.collect()}
    order = sorted(vocabulary, key=lambda w: (often.get(w, 0), w))
    place = {w: i for i, w in enumerate(order)}
    prefixes = [
        (w, i, pos, m, need)
        for i, _, _, words_, m, need in sets
        for pos, w in enumerate(sorted(words_, key=place.get)[: m - need + 1])
    ]
    prefix = spark.createDataFrame(prefixes, "w string, template int, t_pos int, t_size int, need int")
    table = spark.createDataFrame([(i, label, kind, words_, m) for i, label, kind, words_, m, _ in sets], "template int, label string, t_kind string, t_tokens array<string>, size int")

    block = base.filter(F.size("blocks") > 0).select("doc_id", "text_key", F.explode("blocks").alias("b")).select("doc_id", "text_key", "b.kind", "b.no", F.array_intersect(F.array(*map(F.lit, order)), F.col("b.tokens")).alias("tokens"))
    candidates = (
        block.select("*", F.size("tokens").alias("size_b"), F.posexplode("tokens").alias("b_pos", "w"))
        .join(F.broadcast(prefix), "w")
        .filter(F.col("size_b") >= F.col("need"))
        .filter(F.least(F.col("t_size") - F.col("t_pos"), F.col("size_b") - F.col("b_pos")) >= F.col("need"))
        .join(F.broadcast(table), "template")
        .filter(F.col("kind") == F.col("t_kind"))
        .withColumn("shared", F.size(F.array_intersect("tokens", "t_tokens")))
        .filter(F.col("shared") >= F.col("need"))
    )
    matched = candidates.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("label", "kind", "no", (F.col("shared") / F.col("t_size")).alias("containment")))).alias("matches")).withColumnRenamed("doc_id", "m_id").withColumnRenamed("text_key", "m_key")
    joined = base.join(matched, F.col("doc_id").eqNullSafe(F.col("m_id")) & F.col("text_key").eqNullSafe(F.col("m_key")), "left")
    matches = F.coalesce(F.col("matches"), F.array().cast("array<struct<label:string,kind:string,no:int,containment:double>>"))
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    own = F.transform("places", lambda p: p["label"])
    return joined.select(
        "doc_id",
        "n_words",
        F.size("places").cast("bigint").alias("n_base"),
        F.array_min(F.transform("places", lambda p: p["at"])).alias("first_word"),
        F.array_max(F.transform("places", lambda p: p["at"])).alias("last_word"),
        named(own).alias("base_labels"),
        named(F.concat(own, F.transform(matches, lambda m: m["label"]))).alias("labels"),
        F.when(F.size("places") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0))).alias("score"),
        matches.alias("matches"),
    )


def _places(words: Column, phrase: list[str], label: str) -> Column:
    """Where the phrase's words stand consecutively."""
    starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: _stands(words, i, phrase))
    return F.transform(starts, lambda i: F.struct(i.cast("bigint").alias("at"), F.lit(label).alias("label")))


def _stands(words: Column, at: Column, phrase: list[str]) -> Column:
    held = F.get(words, at) == phrase[0]
    for k, w in enumerate(phrase[1:], 1):
        held = held & (F.get(words, at + k) == w)
    return F.coalesce(held, F.lit(False))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Contract query 1: license phrases and templates in every document."""
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("matches")


_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def op1_sql() -> str:
    """DuckDB's form: every template against every block, without filters."""
    rows = ", ".join(f"({i}, '{label}', '{kind}', {_template_words(wording)})" for i, (label, kind, wording) in enumerate(TEMPLATES))
    places = " UNION ALL ".join(
        f"SELECT k, i - 1 AS place, '{label}' AS label FROM u WHERE " + " AND ".join(f"words[i + {j}] = '{w}'" for j, w in enumerate(p.split())) for p, label in PHRASES.items()
    )
    runs = " UNION ALL ".join(
        f"SELECT k, 'line', {' || chr(10) || '.join(f'lead(text, {j}) OVER o' if j else 'text' for j in range(n))} AS text, {' AND '.join(f'lead(short, {j}) OVER o' if j else 'short' for j in range(n))} AS run FROM n WINDOW o AS (PARTITION BY k ORDER BY i)"
        for n in range(2, WRAPPED_LINES + 1)
    )
    return rf"""
WITH t AS (SELECT * FROM (VALUES {rows}) v(template, label, kind, words)),
d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array({_LOWER}, '{_SEP}'), lambda w: w <> '') AS words FROM documents),
u AS (SELECT k, words, unnest(range(1, len(words) + 1)) AS i FROM d WHERE list_has_any(words, ['gnu', 'apache', 'cc', 'mit'])),
p AS ({places}),
l AS (SELECT k, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
n AS (SELECT *, len(list_filter(regexp_split_to_array({_LOWER}, '{_SEP}'), lambda w: w <> '')) <= {WRAPPED_WORDS} AS short FROM l),
b AS (SELECT k, 'line' AS kind, text FROM n UNION ALL SELECT k, 'line', text FROM ({runs}) WHERE run AND text IS NOT NULL UNION ALL SELECT k, 'block', unnest(regexp_split_to_array(text, '\n[ \t\r]*\n')) FROM d),
w AS (SELECT k, kind, regexp_split_to_array({_LOWER}, '{_SEP}') AS words FROM b),
m AS (SELECT k, label, len(list_intersect(w.words, t.words)) / len(t.words) AS part FROM w JOIN t USING (kind) WHERE len(list_intersect(w.words, t.words)) >= ceil(round({CONTAINMENT} * len(t.words), 9))),
a AS (SELECT k, label, 1.0 AS part FROM p UNION ALL SELECT k, label, part FROM m),
x AS (SELECT k, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(part) AS score FROM a GROUP BY k),
y AS (SELECT k, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY k)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN x USING (k) LEFT JOIN y USING (k)
"""
