"""License texts in documents by an exact set-similarity join with templates.

DataFrame functions only: everything here runs inside the JVM.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ._store import discard, stash

#: What stands between words of a lower-cased text.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 64
# Labels and well-known sentences of public licenses.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-by-nc", "licensed under the creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "licensed under the creative commons attribution sharealike 4 0 international license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def lower_ascii(text: Column) -> Column:
    """A-Z as a-z.  Letters beyond ASCII stay beyond ASCII: the two whose lower case isn't are replaced first."""
    odd = F.contains(text, F.lit("İ")) | F.contains(text, F.lit("K"))
    return F.lower(F.when(odd, F.regexp_replace(text, "[İK]", "ķ")).otherwise(text))


def words_of(text: Column) -> Column:
    """Words of a text, lower-cased; null is empty.  Split at what lies between words, which is linear in the text."""
    return F.split(lower_ascii(F.coalesce(text.cast("string"), F.lit(""))), GAP)


def _inner(w: Column) -> Column:
    """Without the empty strings that a gap at either end of the text leaves."""
    first = F.when(w[0] == "", 2).otherwise(1)
    last = F.size(w) - F.when(F.element_at(w, -1) == "", 1).otherwise(0)
    return F.slice(w, first, F.greatest(last - first + 1, F.lit(0)))


def _starts(w: Column) -> Column:
    """Word numbers at which a base phrase stands."""
    ends = F.filter(F.transform(w, lambda x, i: F.when(x == "license", i).otherwise(F.lit(0))), lambda i: i > 0)
    before = lambda i, k: F.get(w, i - k)
    return F.filter(
        F.transform(
            ends,
            lambda i: F.when(before(i, 1) == "mit", F.struct((i - 1).alias("at"), F.lit("mit").alias("label")))
            .when(before(i, 1) == "apache", F.struct((i - 1).alias("at"), F.lit("apache").alias("label")))
            .when((i >= 2) & (before(i, 1) == "public") & (before(i, 2) == "general"), F.struct((i - 2).alias("at"), F.lit("gpl").alias("label"))),
        ),
        lambda s: s.isNotNull(),
    )


def _literal(items: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in items])


def license_scan(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    containment: float = 0.8,
    label_col: str = "labels",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, n_blocks.

    Base: places where a phrase's words stand consecutively.  Method: blocks of 64 words that start at
    every 32nd word (so that any passage of up to 33 words lies whole in one) are joined exactly with
    the templates: a block that holds ``containment`` of a template's distinct tokens gets its label.
    Tokens are ordered by how many documents of the corpus hold them, rarest first; a block is a
    candidate only through a token of the template's prefix, with enough tokens, and if the places of
    that token in both orders leave enough tokens behind it; candidates are then verified.
    ``score`` is the largest containment of a match (1 with a base place, 0 without a match), and
    ``n_blocks`` counts (block, template) matches.

    Every text is split into words once.  A text that holds enough different tokens of some template
    leaves (place, token) pairs of its template tokens behind, and blocks are built from those pairs, at
    most 64 in one, so neither words nor texts are shuffled or read again.

    Null and empty texts have no words; first and last word are null without a place.  Repeated rows
    (same id and text) get equal results.  The template tables are a bounded parameter."""
    sets = [(n, label, list(dict.fromkeys(text.split()))) for n, (label, text) in enumerate(templates)]
    needs = {n: max(1, math.ceil(containment * len(tokens) - 1e-9)) for n, _, tokens in sets}
    vocabulary = sorted({t for _, _, tokens in sets for t in tokens})
    w = F.col("w")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    split = own.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), words_of(F.col("text")).alias("w"))
    scanned = split.select("doc_id", "key", _inner(w).alias("w"))
    held = scanned.select("doc_id", "key", "w", F.array_intersect(_literal(vocabulary), w).alias("held"))
    enough = F.lit(False)
    for n, _, tokens in sets:
        enough = enough | (F.size(F.array_intersect("held", _literal(tokens))) >= needs[n])
    pairs = F.filter(F.transform(w, lambda x, i: F.when(x.isin(vocabulary), F.struct(i.alias("at"), x.alias("t")))), lambda s: s.isNotNull())
    base = stash(
        held.select(
            "doc_id", "key", F.size(w).cast("long").alias("n_words"), F.when(F.array_contains("held", "license"), _starts(w)).alias("places"),
            "held", F.when(enough, pairs).alias("pairs"),
        )
    )
    counted = base.select(F.explode("held").alias("t")).groupBy("t").count().collect()  # a row per template token at most
    often = {t: n for t, n in counted}
    ranked = sorted(vocabulary, key=lambda t: (often.get(t, 0), t))
    place = {t: i for i, t in enumerate(ranked)}
    index = []
    for n, _, tokens in sets:
        order = sorted(tokens, key=place.get)
        index += [(t, n, i, len(order), needs[n]) for i, t in enumerate(order[: len(order) - needs[n] + 1])]
    table = docs.sparkSession.createDataFrame(index, "t string, template int, i int, size int, need int")
    half = WINDOW // 2
    met = base.where("pairs is not null").select("key", "n_words", F.explode("pairs").alias("s")).select("key", "n_words", "s.*")
    start = F.floor(F.col("at") / half).cast("int") * half
    last = F.floor(F.greatest(F.col("n_words") - half - 1, F.lit(0)) / half) * half
    met = met.select("key", "t", F.explode(F.filter(F.array(start, start - half), lambda s: (s >= 0) & (s <= last))).alias("at"))
    blocks = met.groupBy("key", "at").agg(F.array_intersect(_literal(ranked), F.collect_set("t")).alias("b"))
    met = blocks.select("key", "at", "b", F.posexplode("b").alias("j", "t")).join(F.broadcast(table), "t")
    met = met.where((F.size("b") >= F.col("need")) & (F.least(F.col("size") - F.col("i"), F.size("b") - F.col("j")) + F.least("i", "j") >= F.col("need")))
    candidates = met.select("key", "at", "b", "template").distinct()
    share = F.lit(None)
    label = F.lit(None)
    for n, name, tokens in sets:
        share = F.when(F.col("template") == n, F.size(F.array_intersect("b", _literal(tokens))) / F.lit(float(len(tokens)))).otherwise(share)
        label = F.when(F.col("template") == n, F.lit(name)).otherwise(label)
    needed = F.lit(0)
    for n, need in needs.items():
        needed = F.when(F.col("template") == n, F.lit(need / len(sets[n][2]) - 1e-9)).otherwise(needed)
    judged = candidates.select("key", "at", "template", share.alias("share"), needed.alias("least"), label.alias("label"))
    method = stash(
        judged.groupBy("key").agg(
            F.max(F.when(F.col("share") >= F.col("least"), F.col("share"))).alias("share"), F.collect_set(F.when(F.col("share") >= F.col("least"), F.col("label"))).alias("found"),
            F.count(F.when(F.col("share") >= F.col("least"), F.lit(1))).alias("n_blocks"),
        )
    )
    at = F.transform("places", lambda s: s["at"])
    base_set = F.coalesce(F.array_sort(F.array_distinct(F.transform("places", lambda s: s["label"]))), F.expr("cast(array() as array<string>)"))
    both = F.array_sort(F.array_union(base_set, F.coalesce("found", F.expr("cast(array() as array<string>)"))))
    n_base = F.when(F.col("places").isNull(), F.lit(0)).otherwise(F.size("places"))
    return base.drop("pairs", "held").join(method, "key", "left").select(
        "doc_id", "n_words", n_base.cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"),
        F.array_join(base_set, ",").alias("base_labels"), F.array_join(both, ",").alias(label_col),
        F.when(n_base > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"), F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"),
    )
