"""License scans by diagonal voting, with DataFrame functions only.

Every rolling k-gram of a text's words is hashed and joined to the positions of that hash in the templates. A hit at word p
of the text and position q of a template votes for the diagonal p - q: a verbatim occurrence puts all its votes on one
diagonal, words put in or left out move the rest of the votes to a neighbouring one. Votes are counted by diagonal and
neighbouring diagonals are merged. A merged span is then verified: its hits are walked in the order of the text, and a
template position counts only if it comes after the last one that did; a span is reported if it so holds enough of the
template within STRETCH times the template's length, from the first word that counts to the last. Hits are verified word by
word as well, so a collision of hashes counts for nothing.

Of a text's k-grams those whose hash is a template's go on to the join, with their own k words: what is sent on grows with
the hits, not with the text.

The table of template positions is broadcast. It holds literals of this module or of the caller, never the data, and more
than MAX_POSITIONS of them are refused.

Results: a null or empty text has no words and no spans; repeated rows each have their own result, also if ids repeat; an
empty table gives no rows; of the input's columns the named ones are carried.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm import _shared

K = 3
#: Neighbouring diagonals up to so many words apart are one span.
APART = 3
#: Least part of a template's k-grams in a span, and most words of a span against the template's.
COVERAGE, STRETCH = 0.7, 2
MAX_POSITIONS = 20_000
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: The phrases that the base labels go by; (label, words). They count only word for word.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Sentences of public licenses and their usual notices; (label, words). They count from COVERAGE on.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "either version 3 of the license or at your option any later version"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "under the terms of the gnu lesser general public license"),
    ("agpl-3", "under the terms of the gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "creative commons attribution noncommercial 4 0 international license"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)


def words_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def template_positions(spark: SparkSession, phrases=PHRASES, notices=NOTICES, k: int = K) -> DataFrame:
    """template, label, exact, grams (of the template), at (position from 0), gram array<string>, hash: one row a k-gram."""
    listed = [(i, label, i < len(phrases), re.findall(WORD, text)) for i, (label, text) in enumerate([*phrases, *notices])]
    if any(not k <= len(w) <= 62 for *_, w in listed):
        raise ValueError(f"templates need {k} to 62 words")
    rows = [(i, label, exact, len(w) - k + 1, at, w[at:at + k]) for i, label, exact, w in listed for at in range(len(w) - k + 1)]
    if len(rows) > MAX_POSITIONS:
        raise ValueError(f"more than {MAX_POSITIONS} template positions")
    made = ", ".join("({}, '{}', {}, {}, {}, array({}))".format(i, label, exact, n, at, ", ".join(f"'{w}'" for w in gram)) for i, label, exact, n, at, gram in rows)
    return spark.sql(f"select *, {hash_sql('gram', k)} as hash from values {made} as t(template, label, exact, grams, at, gram)")


def hash_sql(words: str, k: int, start: str = "0") -> str:
    return f"xxhash64({', '.join(f'{words}[{start} + {j}]' for j in range(k))})"


def scan(df: DataFrame, keys: list[str], text: str = "text", phrases=PHRASES, notices=NOTICES, k: int = K, apart: int = APART, coverage: float = COVERAGE) -> DataFrame:
    """keys, n_words long, spans array<struct<first_word, template, label, exact, last_word, coverage>> in order.

    One row for each row of df. A phrase gives a span for each place where its words stand; a notice gives one for each
    merged group of diagonals that holds at least coverage of its k-grams.
    """
    spark = df.sparkSession
    templates = F.broadcast(template_positions(spark, phrases, notices, k))
    carried = [F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)]
    ids = [f"_key{i}" for i in range(len(keys))]
    rows = df.select(F.monotonically_increasing_id().alias("_row"), *carried, words_of(F.col(text)).alias("_words"))
    known = ", ".join(str(r.hash) + "L" for r in template_positions(spark, phrases, notices, k).select("hash").distinct().collect())  # literals, at most MAX_POSITIONS
    gram = hash_sql("_words", k, "i")
    own_words = ", ".join(f"_words[x._pos + {j}]" for j in range(k))
    # position -1 stands for the row itself; position p for the k-gram that starts at word p
    found = f"if(size(_words) < {k}, array(), transform(filter(transform(sequence(0, size(_words) - {k}), i -> struct(i as _pos, {gram} as _hash)), x -> x._hash in ({known})), x -> struct(x._pos as _pos, x._hash as _hash, array({own_words}) as _gram)))"
    # the words stay behind before the rows are multiplied
    found = rows.select("_row", *ids, F.size("_words").cast("long").alias("n_words"), F.expr(f"concat(array(struct(-1 as _pos, cast(null as bigint) as _hash, cast(null as array<string>) as _gram)), {found})").alias("_found"))
    grams = found.select("_row", *ids, "n_words", F.explode("_found").alias("_g")).select("_row", *ids, "n_words", "_g.*")
    hits = grams.join(templates, F.col("_hash") == F.col("hash"), "left").where((F.col("_pos") < 0) | (F.col("_gram") == F.col("gram")))
    hit = F.struct(F.col("_pos").cast("long").alias("pos"), F.col("at").cast("long").alias("at"))
    votes = hits.groupBy("_row", *ids, "n_words", "template", "label", "exact", "grams", (F.col("_pos") - F.col("at")).cast("long").alias("diagonal")).agg(F.collect_set(hit).alias("hits"))
    line = Window.partitionBy("_row", "template").orderBy("diagonal")
    # a phrase has to lie on one diagonal; a notice's group ends where the next diagonal is further off
    opens = F.col("exact") | F.lag("diagonal").over(line).isNull() | (F.col("diagonal") - F.lag("diagonal").over(line) > apart)
    merged = (
        votes.withColumn("_group", F.sum(F.when(opens, 1).otherwise(0)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("_row", *ids, "n_words", "template", "label", "exact", "grams", "_group")
        .agg(F.sort_array(F.flatten(F.collect_list("hits"))).alias("hits"))
    )
    # walked in the text's order: pos and at of the last hit that counts, where the first is, and how many
    start = F.expr("struct(-1L as pos, -1L as at, -1L as first, 0L as n)")
    counts = lambda s, h: (h.pos > s.pos) & (h.at > s.at)
    step = lambda s, h: F.when(counts(s, h), F.struct(h.pos.alias("pos"), h.at.alias("at"), F.when(s.n == 0, h.pos).otherwise(s["first"]).alias("first"), (s.n + 1).alias("n"))).otherwise(s)
    walked = merged.withColumn("_walk", F.when(F.col("template").isNotNull(), F.aggregate("hits", start, step)))
    held = F.col("_walk.n") / F.col("grams")
    words = F.col("_walk.pos") - F.col("_walk.first") + k
    good = F.col("template").isNotNull() & F.when(F.col("exact"), held == 1).otherwise((held >= coverage) & (words <= STRETCH * (F.col("grams") + k - 1)))
    span = F.struct(F.col("_walk.first").alias("first_word"), "template", "label", "exact", (F.col("_walk.pos") + k - 1).alias("last_word"), held.alias("coverage"))
    return walked.groupBy("_row", *ids, "n_words").agg(F.sort_array(F.collect_list(F.when(good, span))).alias("spans")).select(
        *[F.col(i).alias(c) for i, c in zip(ids, keys, strict=True)], "n_words", "spans"
    )


def digests(df: DataFrame) -> DataFrame:
    """score: 1 with a base label, else the best coverage of a notice that is reported, else 0."""
    base = F.filter("spans", lambda s: s.exact)
    starts = F.transform(base, lambda s: s.first_word)
    joined = lambda spans: F.array_join(F.sort_array(F.array_distinct(F.transform(spans, lambda s: s.label))), ",")
    return scan(df, ["doc_id"]).select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s.coverage)), F.lit(0.0)).alias("score"), F.size("spans").cast("long").alias("n_spans"),
    )


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(_shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op5_licenses": op5_licenses}
