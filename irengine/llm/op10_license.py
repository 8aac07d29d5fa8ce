"""Operator 10, license scans: phrases, and an exact set-similarity join with notice templates.

Native DataFrame operations only. A text block is a paragraph: lines up to one without a word, so that a notice
wrapped over lines, with comment marks or not, is one block. A template is the set of words of a license
notice. A block meets a template if it holds at least ``percent`` of the template's distinct words.

1. One pass over the texts cuts words and blocks, finds the phrases, and keeps of each block the words that any
   template has; what is left, a few numbers and words for each document, is written to the shared folder.
2. Template words are ordered by the number of documents that hold them, rarest first, ties by word.
3. The join: a block that meets a template of m words, r of them required, holds one of its m - r + 1 rarest words
   (prefix filter, an equi-join of block words with these), has r template words at least (length filter),
   and where a common word stands k-th in the template and j-th in the block, the rest of both
   must still reach r (positional filter). What passes is counted in full, so that every block is found.

The tables of templates grow with the templates only; they are broadcast up to BROADCAST_KEYS rows.

Null or empty text: no words, empty labels, score 0. Text without word
characters likewise. Repeated rows get equal results, each its own; ties cannot occur, since
every label is reported. Other columns, whatever their names, are ignored. Very long texts, lines and paragraphs are
searched whole. An empty table gives an empty result; without templates only the phrases count.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from irengine.llm.common import BROADCAST_KEYS, as_ids, materialise

PERCENT = 90  # of a template's distinct words that a block must hold
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices in common use and paragraphs of the licenses themselves; words only.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "licensed under cc by 4 0 international"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("bsd-3", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]
#: Word characters after A-Z has been lower-cased, and a line without any of them between two others.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BORDER = r"\n(?:[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]*\n)+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def let(value: Column, f) -> Column:
    """f(value) with value computed once for all its uses."""
    return F.transform(F.array(value), f)[0]


def required(size: int, percent: int) -> int:
    return math.ceil(size * percent / 100 - 1e-9)


def phrase_places(w: Column) -> Column:
    """array<struct<at, label>> of all places of all phrases in an array of words."""

    def places(ps: list[str], label: str) -> Column:
        def holds(i: Column) -> Column:
            return reduce(and_, [F.get(w, i + k) == p for k, p in enumerate(ps)])

        at = F.when(F.size(w) >= len(ps), F.filter(F.sequence(F.lit(0), F.size(w) - len(ps)), holds)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(label).alias("label")))

    return F.concat(*[places(phrase.split(), label) for phrase, label in PHRASES.items()])


def strings(words: list[str]) -> Column:
    return F.array(*map(F.lit, words)).cast("array<string>")


def scanned(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(row, doc_id, n_words, places, blocks): step 1; blocks are the template words of each paragraph that has any."""

    def of(blocks: Column) -> Column:
        kept = F.transform(blocks, lambda w: F.array_intersect(w, strings(vocabulary)))

        def rest(w: Column) -> Column:
            # phrases are looked for only where all words of one are there
            able = [reduce(and_, [F.array_contains(w, x) for x in phrase.split()]) for phrase in PHRASES]
            none = F.array().cast("array<struct<at:int,label:string>>")
            return F.struct(F.size(w).cast("long").alias("n_words"), F.when(reduce(lambda x, y: x | y, able), phrase_places(w)).otherwise(none).alias("places"), F.filter(kept, lambda x: F.size(x) > 0).alias("blocks"))

        return let(F.flatten(blocks), rest)

    cut = F.transform(F.split(lowered(F.col("text")), BORDER, -1), lambda p: F.regexp_extract_all(p, F.lit(WORD), F.lit(0)))
    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", let(cut, of).alias("x")).select("row", "doc_id", "x.*")


def word_order(seen: DataFrame, vocabulary: list[str]) -> list[str]:
    """Template words by the number of documents that hold them, rarest first, ties by word: one row for each word reaches the driver."""
    counts = {r.w: r.n for r in seen.select(F.explode(F.array_distinct(F.flatten("blocks"))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def matches(seen: DataFrame, templates: list[tuple[str, str]], order: list[str], percent: int) -> DataFrame:
    """(row, block, label, share) of every block and template that it meets."""
    spark = seen.sparkSession
    rank = {w: i for i, w in enumerate(order)}
    prefixes, whole = [], []
    for tid, (label, text) in enumerate(templates):
        tokens = sorted(set(text.split()), key=rank.__getitem__)
        m, r = len(tokens), required(len(tokens), percent)
        whole.append((tid, label, tokens))
        prefixes += [(tokens[k], tid, m, r, k) for k in range(m - max(r, 1) + 1)]

    def bounded(df: DataFrame, rows: list) -> DataFrame:
        return F.broadcast(df) if len(rows) <= BROADCAST_KEYS else df

    index = bounded(spark.createDataFrame(prefixes, "word string, tid int, m int, r int, k int"), prefixes)
    full = bounded(spark.createDataFrame(whole, "tid int, label string, tokens array<string>"), whole)
    blocks = seen.select("row", F.posexplode("blocks").alias("block", "found")).select("row", "block", F.array_intersect(strings(order), F.col("found")).alias("held"))
    words = blocks.select("row", "block", "held", F.posexplode("held").alias("j", "word"))
    able = (F.size("held") >= F.col("r")) & (F.col("m") - F.col("k") >= F.col("r")) & (F.size("held") - F.col("j") >= F.col("r"))
    near = words.join(index, "word").where(able).select("row", "block", "tid", "r", "m", "held").distinct()
    both = F.size(F.array_intersect("held", "tokens"))
    return near.join(full, "tid").where(both >= F.greatest("r", F.lit(1))).select("row", "block", "label", (both / F.col("m")).alias("share"))


def license_scan(docs: DataFrame, percent: int = PERCENT, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every document."""
    templates = TEMPLATES if templates is None else templates
    docs = as_ids(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocabulary = sorted({w for _, t in templates for w in t.split()})
    seen = materialise(scanned(docs, vocabulary), "license-blocks")
    found = seen
    if templates:
        met = matches(seen, templates, word_order(seen, vocabulary), percent)
        found = seen.join(met.groupBy("row").agg(F.collect_set("label").alias("met"), F.max("share").alias("share")), "row", "left")
    else:
        found = seen.withColumns({"met": F.array().cast("array<string>"), "share": F.lit(0.0)})
    p = F.col("places")
    base, at = F.transform(p, lambda x: x["label"]), F.transform(p, lambda x: x["at"])
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return found.select(
        "doc_id", "n_words", F.size(p).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.concat(base, F.coalesce("met", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(p) > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def oracle_sql(percent: int = PERCENT) -> str:
    """The same result in DuckDB, without filters: every paragraph against every template."""
    words = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    low = f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')"
    hit = []
    for phrase, label in PHRASES.items():
        ps = phrase.split()
        cond = " and ".join(f"w[i + {k}] = '{p}'" for k, p in enumerate(ps))
        hit.append(f"list_transform(list_filter(range(1, len(w) - {len(ps) - 2}), lambda i: {cond}), lambda i: {{'at': i - 1, 'label': '{label}'}})")
    tmpl = ", ".join(f"({i}, '{label}', {sorted(set(t.split()))!r})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
with d as (select doc_id, {low} as t, row_number() over () as rid from documents),
t(tid, label, toks) as (values {tmpl}),
w as (select rid, doc_id, {words.format("t")} as w from d),
b as (select rid, doc_id, len(w) as n, list_concat({hit[0]}, list_concat({hit[1]}, {hit[2]})) as p from w),
l as (select rid, list_distinct({words.format('line')}) as lw from (select rid, unnest(regexp_split_to_array(t, '{BORDER}')) as line from d)),
m as (select rid, label, len(list_intersect(lw, toks)) / len(toks)::double as share from l, t where 100 * len(list_intersect(lw, toks)) >= {percent} * len(toks)),
g as (select rid, list(label) as ls, max(share) as s from m group by rid)
select doc_id, n::bigint as n_words, len(p)::bigint as n_base, list_min(list_transform(p, lambda x: x.at))::bigint as first_word, list_max(list_transform(p, lambda x: x.at))::bigint as last_word,
 array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.label))), ',') as base_labels,
 array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.label), coalesce(ls, [])))), ',') as labels,
 case when len(p) > 0 then 1.0 else coalesce(s, 0.0) end::double as score
from b left join g using (rid)"""
