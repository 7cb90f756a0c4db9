"""License scans, by DataFrame operations only.

Base labels: places where a phrase's words stand consecutively.

The method: an exact set-similarity join of text blocks with license templates.  A block is a line with a word and the
words that follow it in the text, as many as the longest template has: a notice of up to that length lies whole in the
block of the line that it begins in, however it is wrapped.  A block meets a template if it has at least ``threshold``
of the template's distinct words and one of its deciding phrases, word for word.  Words are ordered by how often the
whole corpus has them, rarest first; a block and a template that meet share a word among the first
``size - needed + 1`` of each (prefix filter), a block with fewer words of the vocabulary than needed is out (length
filter), and where a shared word stands bounds what can still be shared (positional filter).  Pairs that pass are
verified on all words, then on the phrases.  Words that no template has can meet nothing; they leave a block before
its words are ordered.

Templates are a parameter of any number; their words are literals in the plan, and the table of their prefixes is
broadcast up to ``broadcast_limit`` bytes.

Null, empty and wordless texts have no words, no places and no labels.  A very long text is one row; its blocks are
rows of their own.  Repeated rows each get a row.  Several places and templates of one label give the label once.
Other columns play no part.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEPARATORS, alnum_words, bind, split_words
from .decontaminate import RAW_SEPARATORS

#: Phrase -> label.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The parts of Creative Commons licenses: letters -> name.
CC_PARTS = {"by": "Attribution", "nc": "NonCommercial", "sa": "ShareAlike", "nd": "NoDerivatives"}
CC_KINDS = ("by", "by-sa", "by-nd", "by-nc", "by-nc-sa", "by-nc-nd")

Template = tuple[str, str, tuple[str, ...]]


def cc_templates(version: str = "4.0") -> list[Template]:
    """The short and the long notice of each Creative Commons license."""
    out: list[Template] = []
    for kind in CC_KINDS:
        name = "-".join(CC_PARTS[p] for p in kind.split("-"))
        out.append((f"cc-{kind}-{version}", f"Licensed under CC {kind.upper()} {version}", (f"CC {kind} {version}",)))
        out.append((f"cc-{kind}-{version}", f"Licensed under the Creative Commons {name} {version} International License", (f"Creative Commons {name} {version}",)))
    return out


#: (label, text of a notice, phrases that decide: one must stand in the block, if there are any).
TEMPLATES: tuple[Template, ...] = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("Apache License, Version 2.0", "Apache License 2.0")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("Redistribution and use in source and binary forms",)),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2", ("GNU General Public License, version 2", "GNU General Public License 2", "GNU General Public License v2")),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3", ("GNU General Public License, version 3", "GNU General Public License 3", "GNU General Public License v3")),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", ("GNU General Public License",)),
    ("mit", "Released under the MIT License", ("MIT License",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("Permission is hereby granted, free of charge",)),
    *cc_templates(),
)
#: Prefix words up to which a pattern finds the texts that have any.
MOST_IN_PATTERN = 300


def plain_words(text: str) -> list[str]:
    return [w for w in re.split(ALNUM_SEPARATORS, re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]


def longest(templates: Sequence[Template]) -> int:
    """Words of the longest template."""
    return max((len(plain_words(text)) for _, text, _ in templates), default=0)


def vocabulary_order(docs: DataFrame, text_col: str, vocabulary: list[str]) -> list[str]:
    """The templates' words, rarest in the corpus first."""
    # counts decide only the order, so lower() may stand for A-Z alone
    words = F.transform(split_words(F.col(text_col), RAW_SEPARATORS), lambda w: F.lower(w))
    seen = docs.select(F.explode(F.filter(words, lambda w: w.isin(vocabulary))).alias("w")).groupBy("w").count()
    count = {r["w"]: r["count"] for r in seen.collect()}  # one row for each word of the templates at most
    return sorted(vocabulary, key=lambda w: (count.get(w, 0), w))


def text_blocks(text: Column, most: int) -> Column:
    """(line, words) of each line with a word: its words, and the ``most`` that follow."""
    parts = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line"), alnum_words(x).alias("words")))

    def joined(own: Column) -> Column:
        def block(p: Column, i: Column) -> Column:
            # each of the next lines has a word at least
            after = F.flatten(F.transform(F.slice(own, i + 2, most), lambda q: F.slice(q["words"], 1, most)))
            return F.struct(p["line"].alias("line"), F.concat(p["words"], F.slice(after, 1, most)).alias("words"))

        return F.transform(own, block)

    return bind(F.filter(parts, lambda p: F.size(p["words"]) > 0), joined)


def matching_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[Template] = TEMPLATES, threshold: float = 0.8, broadcast_limit: int = 64 << 20) -> DataFrame:
    """(id, th, line, template, label, share): every block (by the number of its first line, from 0) and template that
    meet; th is the text's hash, template a number in the list, share the part of the template's words in the block."""
    sets = [(k, label, set(plain_words(text)), [" ".join(plain_words(p)) for p in must]) for k, (label, text, must) in enumerate(templates)]
    sets = [x for x in sets if x[2]]
    order = vocabulary_order(docs, text_col, sorted(set().union(*(x[2] for x in sets))))
    rank = {w: k for k, w in enumerate(order)}
    rows, starts, least = [], set(), None
    for k, label, s, must in sets:
        need = max(1, math.ceil(threshold * len(s) - 1e-9))
        own = sorted(s, key=rank.__getitem__)
        least = need if least is None else min(least, need)
        for i in range(len(own) - need + 1):
            rows.append((k, label, own[i], i, len(own), need, own, must))
            starts.add(own[i])
    table = docs.sparkSession.createDataFrame(rows, "template int, label string, start string, i int, size int, need int, set array<string>, must array<string>")
    if sum(64 + sum(map(len, r[6])) + sum(map(len, r[7])) for r in rows) <= broadcast_limit:
        table = F.broadcast(table)
    own = docs
    if len(starts) <= MOST_IN_PATTERN:  # the prefix filter once more, on the raw text
        own = docs.where(F.col(text_col).rlike("(?i)" + "|".join(re.escape(w) for w in sorted(starts))))
    some = F.array(*map(F.lit, sorted(starts)))
    blocks = F.filter(text_blocks(F.col(text_col), longest(templates)), lambda x: F.arrays_overlap(x["words"], some))
    own = own.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.explode(blocks).alias("x"))
    known = F.array_intersect(F.array(*map(F.lit, order)), "x.words")  # in the order of the first
    own = own.select("id", "th", "x.line", known.alias("b"), F.concat(F.lit(" "), F.array_join("x.words", " "), F.lit(" ")).alias("joined")).where(F.size("b") >= (least or 0))
    probes = own.select("id", "th", "line", "b", "joined", F.posexplode(F.slice("b", 1, F.size("b") - (least or 0) + 1)).alias("j", "start"))
    left = 1 + F.least(F.col("size") - F.col("i") - 1, F.size("b") - F.col("j") - 1)
    passed = probes.join(table, "start").where((F.size("b") >= F.col("need")) & (F.col("j") <= F.size("b") - F.col("need")) & (left >= F.col("need")))
    shared = F.size(F.array_intersect("b", "set"))
    met = passed.withColumn("shared", shared).where("shared >= need")
    met = met.where((F.size("must") == 0) | F.exists("must", lambda p: F.contains(F.col("joined"), F.concat(F.lit(" "), p, F.lit(" ")))))
    return met.groupBy("id", "th", "line", "template", "label").agg(F.max(F.col("shared") / F.col("size")).alias("share"))


def template_pairs(docs: DataFrame, id_col: str, text_col: str, templates: Sequence[Template], threshold: float) -> DataFrame:
    """(id, th, label, share): for each distinct document and label, the largest containment of a block that meets it."""
    return matching_blocks(docs, id_col, text_col, templates, threshold).groupBy("id", "th", "label").agg(F.max("share").alias("share"))


def phrase_places(text: Column, phrases: dict[str, str]) -> Column:
    """struct(n, first, last, labels) of all places of all phrases."""

    def places(joined: Column, phrase: str) -> Column:
        """Word numbers, from 0: the spaces before each place."""
        heads = F.split(joined, f" {phrase}(?= )")
        sizes = F.transform(heads, lambda x: F.size(F.split(x, " ")) - 1)
        width = len(phrase.split())
        starts = F.transform(F.slice(sizes, 1, F.size(sizes) - 1), lambda x, i: F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0), lambda t, y: t + y) + i * width)
        return starts

    def marked(at: Column, label: str) -> Column:
        return F.transform(at, lambda x: F.struct(x.alias("at"), F.lit(label).alias("label")))

    def found(joined: Column) -> Column:
        return F.concat(*[marked(places(joined, p), label) for p, label in phrases.items()])

    joined = F.concat(F.lit(" "), F.array_join(alnum_words(text), " "), F.lit(" "))
    return bind(
        bind(joined, found),
        lambda x: F.struct(
            F.size(x).cast("long").alias("n"),
            F.array_min(F.transform(x, lambda y: y["at"])).cast("long").alias("first"),
            F.array_max(F.transform(x, lambda y: y["at"])).cast("long").alias("last"),
            F.array_sort(F.array_distinct(F.transform(x, lambda y: y["label"]))).alias("labels"),
        ),
    )


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, templates=TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row for each row of ``docs``.

    ``score``: 1 where a base phrase stands, else the largest containment of a block that meets a template, else 0.
    """
    pairs = template_pairs(docs, id_col, text_col, templates, threshold)
    met = pairs.groupBy("id", "th").agg(F.collect_set("label").alias("met"), F.max("share").alias("share")).select(F.col("id").alias("id_"), F.col("th").alias("th_"), "met", "share")
    # every place of a phrase has its longest word, in some case, in the raw text
    hint = "(?i)" + "|".join(sorted({re.escape(max(p.split(), key=len)) for p in phrases}))
    nothing = F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last"), F.array().cast("array<string>").alias("labels"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(
        F.col(id_col).alias("id"),
        F.xxhash64(text_col).alias("th"),
        F.size(split_words(text, RAW_SEPARATORS)).cast("long").alias("n_words"),
        F.when(text.rlike(hint), phrase_places(text, phrases)).otherwise(nothing).alias("base"),
    )
    out = own.join(met, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    labels = F.array_sort(F.array_union("base.labels", F.coalesce("met", F.array().cast("array<string>"))))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        F.col("base.n").alias("n_base"),
        F.col("base.first").alias("first_word"),
        F.col("base.last").alias("last_word"),
        F.array_join("base.labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("base.n") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def query(docs: DataFrame) -> DataFrame:
    """The contract's rows."""
    return scan(docs.select("doc_id", "text"))
