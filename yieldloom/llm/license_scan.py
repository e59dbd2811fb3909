"""License notices in texts, by diagonal voting.

A template is a phrase or a notice, as a sequence of words. Hashes of all rolling word
k-grams of the texts are joined with the templates' grams; a gram at word ``p`` of a text
and ``t`` of a template votes for the diagonal ``p - t``. Votes are kept as one bit per
template position, so a task hands on one row per document, template and diagonal however
many votes there are. A word put in or left out moves what follows to a neighbouring
diagonal, so neighbours are merged before the share of the template's grams is taken.
Votes count only where the words themselves are equal.

Phrases must be whole, on one diagonal. A notice stands if enough of its grams do and no
other notice fits the same place better.

All of it is DataFrame functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldloom.llm.common import ascii_lower

#: What stands between words, after A-Z are lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of a gram: phrases may be as short as two words; notices share short grams with ordinary prose.
PHRASE_GRAM, NOTICE_GRAM = 2, 4
#: Share of a notice's grams that must be found, and how far its diagonals may lie apart.
MIN_SHARE, SLACK = 0.8, 8
#: Votes in one long.
BITS = 62

#: Phrases to be found word for word, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: The wording of public license notices.
NOTICES = [
    (
        "agpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero "
        "General Public License as published by the Free Software Foundation, either version 3 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "apache",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer.",
    ),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    (
        "cc0",
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright "
        "and related or neighboring rights to this work",
    ),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version.",
    ),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    (
        "lgpl",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser "
        "General Public License as published by the Free Software Foundation; either version 2.1 of the License, or "
        "(at your option) any later version.",
    ),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ),
    (
        "mpl",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
        "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled "
        "binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
]

GRAM_COLUMNS = ("template", "label", "base", "spot", "grams", "w1", "w2", "w3", "w4")


def _words(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def template_grams(
    phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES
) -> list[tuple]:
    """Rows of ``GRAM_COLUMNS``; the third and fourth word are missing for phrases."""
    templates = [(label, True, PHRASE_GRAM, _words(text)) for text, label in phrases]
    templates += [(label, False, NOTICE_GRAM, _words(text)) for label, text in notices]
    rows = []
    for number, (label, base, k, words) in enumerate(templates):
        grams = len(words) - k + 1
        if grams < 1:
            raise ValueError(f"a template of {len(words)} words holds no gram of {k}")
        for at in range(grams):
            gram = words[at : at + k] + [None] * (NOTICE_GRAM - k)
            rows.append((number, label, base, at, grams, *gram))
    return rows


def grams_sql(rows: list[tuple]) -> str:
    """The rows as a VALUES list."""

    def value(x: object) -> str:
        if x is None:
            return "CAST(NULL AS VARCHAR(64))"
        return f"'{x}'" if isinstance(x, str) else str(x).lower()

    return "VALUES " + ", ".join(f"({', '.join(map(value, row))})" for row in rows)


def words_of(text: Column) -> Column:
    """Words of a text, A-Z lower-cased; none for null."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN, -1), "")


def text_key(text: Column) -> list[Column]:
    """128 bits that keep apart rows sharing an id."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def votes(rows: DataFrame, grams: list[tuple]) -> DataFrame:
    """(id, t1, t2, template, label, base, grams, diagonal, v0, v1, ...): bits of the template's positions found."""
    spark = rows.sparkSession
    # A few hundred rows, whatever the texts.
    side = spark.sql(f"SELECT * FROM ({grams_sql(grams)}) AS t({', '.join(GRAM_COLUMNS)})")
    side = F.broadcast(
        side.select(
            *[F.col(c).alias(f"t_{c}") for c in GRAM_COLUMNS],
            F.xxhash64("w1", "w2").alias("t_short"),
            F.when(F.col("w3").isNotNull(), F.xxhash64("w1", "w2", "w3", "w4")).alias("t_long"),
        )
    )
    words = F.col("words")
    shifted = [F.slice(words, k + 1, F.greatest(F.size(words), F.lit(1))) for k in range(1, NOTICE_GRAM)]
    # The outer variant: Spark would derive a filter from the inner one and split the text again.
    placed = (
        rows.select("id", *text_key(F.col("text")), words_of(F.col("text")).alias("words"))
        .select("id", "t1", "t2", F.arrays_zip(words, *shifted).alias("windows"))
        .select("id", "t1", "t2", F.posexplode_outer("windows").alias("pos", "w"))
        .select("id", "t1", "t2", "pos", *[F.col("w")[str(i) if i else "words"].alias(f"w{i + 1}") for i in range(4)])
    )
    placed = placed.withColumn("short", F.xxhash64("w1", "w2")).withColumn(
        "long", F.xxhash64("w1", "w2", "w3", "w4")
    )
    found = placed.join(
        side,
        (F.col("short") == F.col("t_short"))
        & (F.col("t_long").isNull() | (F.col("t_long") == F.col("long"))),
    )
    same = (F.col("w1") == F.col("t_w1")) & (F.col("w2") == F.col("t_w2"))
    same &= F.col("t_w3").isNull() | ((F.col("w3") == F.col("t_w3")) & (F.col("w4") == F.col("t_w4")))
    at = F.col("t_spot")
    n_longs = max(r[4] for r in grams) // BITS + 1
    bits = [
        F.coalesce(
            F.bit_or(
                F.when(
                    same & (F.floor(at / BITS) == i),
                    F.call_function("shiftleft", F.lit(1).cast("long"), at - i * BITS),
                )
            ),
            F.lit(0).cast("long"),
        ).alias(f"v{i}")
        for i in range(n_longs)
    ]
    return found.groupBy(
        "id",
        "t1",
        "t2",
        *[F.col(f"t_{c}").alias(c) for c in ("template", "label", "base", "grams")],
        (F.col("pos") - at).alias("diagonal"),
    ).agg(*bits)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    min_share: float = MIN_SHARE,
    slack: int = SLACK,
) -> DataFrame:
    """One row per document: id, n_words, n_base, first_word, last_word, base_labels, labels, score, notices.

    ``n_base`` counts all places of whole phrases, ``first_word`` and ``last_word`` are
    their smallest and largest start. ``notices`` lists the notices that stand, as
    (label, start, share): the place is the diagonal, the word where the notice would
    begin. ``score`` is the largest share of any template's grams, 1 for a phrase.

    Null and empty texts have no words and no labels. Rows are documents of their own,
    repeated ones and null ids too; equal rows share their votes. Of notices that fit
    one place equally well, the label that sorts first stands; of a notice's equally
    good places the first. Texts are read whole; an empty table gives no rows; other
    columns are not read. Words are never shuffled, only diagonals with votes are.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    grams = template_grams(phrases, notices)
    longs = [f"v{i}" for i in range(max(r[4] for r in grams) // BITS + 1)]
    key = ["id", "t1", "t2"]
    # Diagonals of one template in one document: never more than its words.
    order = Window.partitionBy(*key, "template").orderBy("diagonal")
    reach = order.rangeBetween(0, slack)
    merged = votes(rows, grams).select(
        *key,
        "template",
        "label",
        "base",
        "diagonal",
        *[
            F.when(F.col("base"), F.col(v)).otherwise(F.bit_or(v).over(reach)).alias(v)
            for v in longs
        ],
        "grams",
    )
    found = sum((F.bit_count(v) for v in longs), F.lit(0))
    shares = merged.withColumn("share", found / F.col("grams")).filter(F.col("share") > 0)
    whole = F.col("base") & (F.col("share") == 1)
    best = F.max_by(
        F.struct(F.col("diagonal").cast("long").alias("start"), "share"),
        F.struct("share", -F.col("diagonal")),
    )
    by_template = shares.groupBy(*key, "template", "label", "base", "grams").agg(
        F.count(F.when(whole, 1)).alias("places"),
        F.min(F.when(whole, F.col("diagonal"))).alias("first"),
        F.max(F.when(whole, F.col("diagonal"))).alias("last"),
        best.alias("best"),
    )
    notice = F.struct(
        "label",
        F.col("best.start").alias("start"),
        (F.col("best.start") + F.col("grams") + NOTICE_GRAM - 1).alias("end"),
        F.col("best.share").alias("share"),
    )
    # A row per template at most.
    by_doc = by_template.groupBy(*key).agg(
        F.sum("places").alias("n_base"),
        F.min("first").cast("long").alias("first_word"),
        F.max("last").cast("long").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("places") > 0, F.col("label")))).alias("base_labels"),
        F.collect_list(F.when(~F.col("base"), notice)).alias("candidates"),
        F.max(F.when(~F.col("base") | (F.col("places") > 0), F.col("best.share"))).alias("score"),
    )
    candidates = F.col("candidates")

    def better(one: Column, other: Column) -> Column:
        meets = (one["start"] < other["end"]) & (other["start"] < one["end"])
        first = (one["share"] > other["share"]) | (
            (one["share"] == other["share"]) & (one["label"] < other["label"])
        )
        return meets & first

    standing = F.filter(
        candidates,
        lambda x: (x["share"] >= min_share) & ~F.exists(candidates, lambda o: better(o, x)),
    )
    by_doc = by_doc.withColumn("notices", F.array_sort(standing)).withColumn(
        "labels",
        F.array_sort(F.array_union("base_labels", F.transform("notices", lambda x: x["label"]))),
    )
    none = F.array().cast("array<string>")
    every = rows.select(
        "id", *text_key(F.col("text")), F.size(words_of(F.col("text"))).cast("long").alias("n_words")
    )
    right = by_doc.select(*[F.col(c).alias(f"_{c}") for c in key], *by_doc.columns[len(key) :])
    # Both sides have a row per document at most and grow with them: merged, never broadcast.
    joined = every.join(
        right.hint("merge"),
        F.col("id").eqNullSafe(F.col("_id")) & (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")),
        "left",
    )
    return joined.select(
        F.col("id").alias(id_col),
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.coalesce("base_labels", none), ",").alias("base_labels"),
        F.array_join(F.coalesce("labels", none), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.transform(
            "notices",
            lambda x: F.struct(x["label"].alias("label"), x["start"].alias("start"), x["share"].alias("share")),
        ).alias("notices"),
    )


def oracle(grams: list[tuple], min_share: float = MIN_SHARE, slack: int = SLACK) -> str:
    """The same rows in SQL, with words in the place of hashes and lists of positions in that of bits."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"""
WITH templates(template, label, base, spot, grams, w1, w2, w3, w4) AS ({grams_sql(grams)}),
docs AS (
  SELECT doc_id, regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), placed AS (
  SELECT doc_id, p, w[p] AS w1, w[p + 1] AS w2, w[p + 2] AS w3, w[p + 3] AS w4
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM docs)
), votes AS (
  SELECT DISTINCT doc_id, template, label, base, grams, spot, p - 1 - spot AS diagonal
  FROM placed d JOIN templates t
    ON d.w1 = t.w1 AND d.w2 = t.w2 AND (t.w3 IS NULL OR (d.w3 = t.w3 AND d.w4 = t.w4))
), starts AS (
  SELECT DISTINCT doc_id, template, diagonal FROM votes
), shares AS (
  SELECT s.doc_id, s.template, v.label, v.base, v.grams, s.diagonal,
         count(DISTINCT v.spot) / v.grams AS share
  FROM starts s JOIN votes v
    ON v.doc_id = s.doc_id AND v.template = s.template
   AND v.diagonal BETWEEN s.diagonal AND s.diagonal + CASE WHEN v.base THEN 0 ELSE {slack} END
  GROUP BY s.doc_id, s.template, v.label, v.base, v.grams, s.diagonal
), phrases AS (
  SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM shares WHERE base AND share = 1 GROUP BY doc_id
), best AS (
  SELECT *, diagonal + grams + {NOTICE_GRAM - 1} AS until FROM shares WHERE NOT base
  QUALIFY row_number() OVER (PARTITION BY doc_id, template ORDER BY share DESC, diagonal) = 1
), standing AS (
  SELECT * FROM best b WHERE share >= {min_share} AND NOT EXISTS (
    SELECT 1 FROM best o WHERE o.doc_id = b.doc_id AND o.diagonal < b.until AND b.diagonal < o.until
      AND (o.share > b.share OR (o.share = b.share AND o.label < b.label)))
), labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT doc_id, label FROM standing
        UNION ALL SELECT doc_id, label FROM shares WHERE base AND share = 1) GROUP BY doc_id
), scored AS (
  SELECT doc_id, max(share) AS score FROM shares WHERE NOT base OR share = 1 GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base,
       CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM docs d LEFT JOIN phrases USING (doc_id) LEFT JOIN labelled USING (doc_id) LEFT JOIN scored USING (doc_id)
"""
