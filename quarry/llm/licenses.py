"""License scans by an exact set-similarity join, in DataFrame functions only.

A text block matches a template if it holds at least ``threshold`` of the template's distinct words. Blocks are lines; for templates
of ``LONG`` distinct words or more also paragraphs of several lines; for shorter ones, whose words any long paragraph holds, also
runs of adjacent lines where the words on both sides of every line break are words of the template, as in a wrapped notice, and so
of at most as many lines as it has words. The words of all templates are ordered by how often the
corpus uses them, rarest first. A match must share one of a template's first t - a + 1 words in that order (a: words it must
share at least), so only these are indexed; a block must have a words of the vocabulary (length filter), and after the first
common word enough must be left on both sides (positional filter). What passes is verified word by word.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.shared import Scratch

# Base phrases, and notices by license label.
PHRASES = {"mit": ["mit", "license"], "apache": ["apache", "license"], "gpl": ["general", "public", "license"]}
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc0", "This work is dedicated to the public domain under the CC0 1.0 Universal Public Domain Dedication"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
]
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LONG = 12


def _lowered(text: Column) -> Column:
    """Lower case; the Kelvin sign, the one other character that lowers to an ASCII letter alone, must not become k."""
    return F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Å")))


def _split(lowered: Column) -> Column:
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return list(dict.fromkeys(w for w in re.split(BETWEEN, text.lower()) if w))


def _starts(words: Column, phrase: list[str]) -> Column:
    def here(w: Column, i: Column) -> Column:
        hit = w == phrase[0]
        for j, p in enumerate(phrase[1:], 1):
            hit = hit & (F.get(words, i + j) == p)
        return F.when(hit, i)

    return F.filter(F.transform(words, here), lambda x: x.isNotNull())


def _base(docs: DataFrame) -> DataFrame:
    """__id, __dh, n_words and the base places of every row."""
    worded = docs.select("__id", "__dh", _lowered(F.col("__t")).alias("low")).withColumn("words", _split(F.col("low")))
    places = [F.when(F.contains(F.col("low"), F.lit("license")), _starts(F.col("words"), p)).otherwise(F.array().cast("array<int>")).alias(label) for label, p in PHRASES.items()]
    each = worded.select("__id", "__dh", F.size("words").cast("long").alias("n_words"), *places)
    every = F.concat(*PHRASES)
    found = F.array(*[F.when(F.size(label) > 0, F.lit(label)) for label in sorted(PHRASES)])
    return each.select("__id", "__dh", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"), F.array_compact(found).alias("base"))


def matches(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(__id, __dh, label, block, containment) of every distinct document (columns __id, __dh, __t), block and template that match.
    Blocks count from 0: lines first, then paragraphs, then runs of lines by their first line. Runs one word count; at most one row for each template word reaches the driver."""
    spark = docs.sparkSession
    sets = [(n, label, template_words(text)) for n, (label, text) in enumerate(templates)]
    vocabulary = sorted({w for _, _, ws in sets for w in ws})
    low = _lowered(F.col("__t"))
    used = docs.select(F.explode(F.filter(_split(low), lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count().collect()
    often = {r["w"]: r["count"] for r in used}
    rank = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (often.get(w, 0), w)))}

    index, wanted, wrapped = [], [], []
    for n, label, ws in sets:
        ordered, need = sorted(ws, key=rank.get), math.ceil(threshold * len(ws) - 1e-9)
        index += [(rank[w], n, i, len(ws), need) for i, w in enumerate(ordered[: len(ws) - need + 1])]
        wanted.append((n, label, sorted(rank[w] for w in ws), len(ws)))
        if len(ws) < LONG:
            wrapped.append((n, len([w for w in re.split(BETWEEN, templates[n][1].lower()) if w])))
    first_words = sorted({w for w, r in rank.items() if any(r == x[0] for x in index)})
    rows = lambda names, values: spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(x).alias(c) for c, x in zip(names, v, strict=True)]) for v in values])))
    prefixes = rows(("rank", "template", "i", "t", "need"), index)
    sought = rows(("template", "label", "t_ranks", "size"), wanted)

    some = rf"(?:\A|{BETWEEN[:-1]})(?:{'|'.join(first_words)})(?:\z|{BETWEEN[:-1]})"
    ranks = F.create_map(*[F.lit(x) for w, r in rank.items() for x in (w, r)])
    near = docs.select("__id", "__dh", low.alias("low")).where(F.col("low").rlike(some))
    lines = F.transform(F.split("low", "\n"), lambda x: F.struct(F.lit(False).alias("long"), x.alias("body")))
    paragraphs = F.transform(F.filter(F.split("low", r"\n[ \t\r]*\n"), lambda x: F.contains(x, F.lit("\n"))), lambda x: F.struct(F.lit(True).alias("long"), x.alias("body")))
    blocks = near.select("__id", "__dh", F.posexplode(F.concat(lines, paragraphs)).alias("block", "b")).select("__id", "__dh", "block", "b.long", "b.body").where(F.col("body").rlike(some))
    ranked = blocks.select("__id", "__dh", "block", "long", F.array_distinct(F.filter(_split(F.col("body")), lambda w: w.isin(vocabulary))).alias("ws")).select("__id", "__dh", "block", "long", F.array_sort(F.transform("ws", lambda w: F.element_at(ranks, w))).alias("ranks"))
    spread = ranked.select("__id", "__dh", "block", "long", "ranks", F.size("ranks").alias("b"), F.posexplode("ranks").alias("j", "rank"))
    candidates = spread.join(F.broadcast(prefixes), "rank").where((F.col("b") >= F.col("need")) & (1 + F.least(F.col("t") - F.col("i") - 1, F.col("b") - F.col("j") - 1) >= F.col("need")) & (~F.col("long") | (F.col("t") >= LONG)))
    verified = candidates.join(F.broadcast(sought), "template").withColumn("shared", F.size(F.array_intersect("ranks", "t_ranks"))).where("shared >= need")
    chosen = ["__id", "__dh", "label", "block", (F.col("shared") / F.col("size")).alias("containment")]
    if not wrapped:
        return verified.select(*chosen).distinct()

    # A run from each line: the following lines, cut for each template at the first line break that does not stand between words of it.
    short, most = {n for n, _ in wrapped}, max(m for _, m in wrapped)
    starts = sorted({x[0] for x in index if x[1] in short})
    lined = F.transform(F.split("low", "\n"), lambda x: F.transform(_split(x), lambda w: F.coalesce(F.element_at(ranks, w), F.lit(-1))))
    n_blocks = F.size(F.split("low", "\n")) + F.size(F.filter(F.split("low", r"\n[ \t\r]*\n"), lambda x: F.contains(x, F.lit("\n"))))
    held = near.where(F.contains("low", F.lit("\n"))).select("__id", "__dh", n_blocks.alias("n_blocks"), lined.alias("held"))
    runs = held.select("__id", "__dh", "n_blocks", "held", F.posexplode("held").alias("at", "first")).where((F.get("first", F.size("first") - 1) >= 0) & (F.get(F.get("held", F.col("at") + 1), F.lit(0)) >= 0)).select("__id", "__dh", (F.col("n_blocks") + F.col("at")).alias("block"), F.slice("held", F.col("at") + 1, most).alias("run"))
    met = runs.select("*", F.explode(F.filter(F.array_distinct(F.flatten("run")), lambda r: r.isin(starts))).alias("rank")).join(F.broadcast(prefixes), "rank").select("__id", "__dh", "block", "run", "template").distinct()
    lengths = rows(("template", "most"), wrapped)
    sized = met.join(F.broadcast(sought.join(lengths, "template")), "template").join(F.broadcast(prefixes.select("template", "need").distinct()), "template")
    nothing = F.struct(F.array().cast("array<int>").alias("found"), F.lit(True).alias("open"))
    ours = lambda r: F.coalesce(F.array_contains("t_ranks", r), F.lit(False))

    def add(acc: Column, line: Column) -> Column:
        joins = acc["open"] & ((F.size(acc["found"]) == 0) | ours(F.get(line, F.lit(0))))
        more = F.array_union(acc["found"], F.array_intersect(line, F.col("t_ranks")))
        return F.struct(F.when(joins, more).otherwise(acc["found"]).alias("found"), (joins & ours(F.get(line, F.size(line) - 1))).alias("open"))

    folded = sized.withColumn("shared", F.size(F.aggregate(F.slice("run", F.lit(1), F.col("most")), nothing, add)["found"])).where("shared >= need")
    return verified.select(*chosen).unionByName(folded.select(*chosen)).distinct()


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row.

    Null and empty texts have no words, places or labels; without places first_word and last_word are null, without labels the
    label strings are empty. score: the largest containment found, else 0. A null doc_id stays null; repeated rows get the same
    result each; other columns are ignored; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    plain = docs.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").alias("__t"), F.xxhash64(F.col(f"`{text}`")).alias("__dh"))
    found = scratch.keep(matches(plain, threshold=threshold)).groupBy(F.col("__id").alias("i"), F.col("__dh").alias("h")).agg(F.collect_set("label").alias("more"), F.max("containment").alias("score"))
    all_rows = _base(plain).join(found, F.col("__id").eqNullSafe(F.col("i")) & (F.col("__dh") == F.col("h")), "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    return all_rows.select(F.col("__id").alias(doc_id), "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


def oracle() -> str:
    """The same scan in DuckDB SQL, each block against each template."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    templates = ", ".join(f"({quoted(label)}, [{', '.join(map(quoted, template_words(text)))}])" for label, text in TEMPLATES)
    places = ", ".join(f"list_filter(range(1, len(ws) + 1), lambda i: {' AND '.join(f'ws[i + {j}] = {quoted(w)}' for j, w in enumerate(p))}) AS {label}" for label, p in PHRASES.items())
    return f"""
    WITH low AS (SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), '{letters}', '{letters.lower()}') AS t FROM documents),
    worded AS (SELECT r, doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM low),
    placed AS (SELECT r, doc_id, len(ws) AS n_words, {places} FROM worded),
    base AS (SELECT r, doc_id, n_words, list_concat(list_concat(mit, apache), gpl) AS p,
        list_filter([CASE WHEN len(apache) > 0 THEN 'apache' END, CASE WHEN len(gpl) > 0 THEN 'gpl' END, CASE WHEN len(mit) > 0 THEN 'mit' END], lambda x: x IS NOT NULL) AS b FROM placed),
    blocks AS (SELECT r, false AS long, unnest(string_split(t, chr(10))) AS body FROM low
        UNION ALL SELECT r, true, unnest(list_filter(string_split_regex(t, '\\n[ \\t\\r]*\\n'), lambda x: contains(x, chr(10)))) FROM low),
    sets AS (SELECT r, long, list_distinct(regexp_extract_all(body, '{word}')) AS ws FROM blocks),
    found AS (SELECT r, label, len(list_intersect(ws, tw)) / len(tw) AS c FROM sets, (VALUES {templates}) AS v(label, tw)
        WHERE (NOT long OR len(tw) >= {LONG}) AND len(list_intersect(ws, tw)) >= 0.8 * len(tw) - 1e-9),
    more AS (SELECT r, list(DISTINCT label) AS m, max(c) AS score FROM found GROUP BY r)
    SELECT doc_id, n_words, len(p) AS n_base, list_min(p) - 1 AS first_word, list_max(p) - 1 AS last_word, array_to_string(b, ',') AS base_labels,
        array_to_string(list_sort(list_distinct(list_concat(b, coalesce(m, [])))), ',') AS labels, coalesce(score, 0.0) AS score
    FROM base LEFT JOIN more USING (r)"""
