import math
import random
import re

from geolith.llm import licenses as lic

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(rows, templates=lic.TEMPLATES, threshold=0.8):
    out = []
    for i, text in rows:
        w = WORD.findall(lowered(text))
        places = [(k, label) for p, label in lic.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        best, met = 0.0, set()
        most, lines = lic.longest(templates), (text or "").split("\n")
        for k, line in enumerate(lines):
            own = WORD.findall(lowered(line))
            if not own:
                continue
            block = own + WORD.findall(lowered("\n".join(lines[k + 1 :])))[:most]
            b, said = set(block), f" {' '.join(block)} "
            for label, t, must in templates:
                s = set(lic.plain_words(t))
                if s and len(b & s) >= max(1, math.ceil(threshold * len(s) - 1e-9)) and (not must or any(f" {' '.join(lic.plain_words(p))} " in said for p in must)):
                    met.add(label)
                    best = max(best, len(b & s) / len(s))
        base = {label for _, label in places}
        at = [k for k, _ in places]
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), 1.0 if at else best))
    return sorted(out, key=str)


def rows():
    rng = random.Random(4)
    bits = [t for _, t, _ in lic.TEMPLATES] + list(lic.PHRASES) + ["MIT-License mit license", "cc by cc_BY", "the apache", "MİT Licenſe", "and the of"]
    out = []
    for k in range(80):
        lines = []
        for _ in range(rng.randrange(5)):
            words = rng.choice(bits).split() + rng.choice(["", "the and of", "K elvin"]).split()
            for _ in range(rng.randrange(4)):
                if words:
                    words.pop(rng.randrange(len(words)))
            rng.random() < 0.3 and rng.shuffle(words)
            lines.append(" ".join(words))
        out.append((k, rng.choice(["\n", " ", "\n\n"]).join(lines)))
    return out + [(100, None), (101, ""), (102, "..."), (103, "mit license " * 300), (104, "a " * 50_000 + "cc by"), (None, "Apache License"), (5, out[5][1])]


def test_query_equals_brute_force(spark):
    data = rows()
    got = lic.query(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data)


def test_other_templates_and_thresholds(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string")
    templates = (("a", "the the", ()), ("b", "mit license of and", ("license", "of and")), ("c", "apache", ("apache",)), ("empty", "--", ()))
    for threshold in (0.3, 0.5, 1.0):
        got = lic.scan(df, templates=templates, threshold=threshold).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
        want = brute(data, templates[:3], threshold)
        assert sorted((tuple(r) for r in got), key=str) == want


def test_empty(spark):
    assert lic.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def labels_of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in lic.query(df).orderBy("doc_id").collect()]


MIT = """Permission is hereby granted, free of charge, to any
person obtaining a copy of this software and associated
documentation files (the "Software"), to deal"""


def test_words_that_decide_a_license(spark):
    found = labels_of(
        spark,
        "Licensed under CC BY 4.0",
        "Licensed under the Creative Commons Attribution 4.0 International License.",
        "This work is licensed under the GNU General Public License, version 2.",
        "Licensed under CC BY-NC-SA 4.0",
        "Licensed under the Apache License, Version 1.1",
    )
    assert found == ["cc-by,cc-by-4.0", "cc-by-4.0", "gpl,gpl-2.0", "cc-by,cc-by-nc-sa-4.0", "apache"]


def test_notices_over_several_lines(spark):
    bsd = "Some prose before. Redistribution and use in source and binary forms, with or\nwithout modification, are permitted provided that\n\nthe following conditions are met:"
    gpl = "# This program is free software: you can redistribute it\n# and/or modify it under the terms of the GNU General\n# Public License as published by the Free\n# Software Foundation"
    assert labels_of(spark, MIT, "prose\n" * 50 + MIT, bsd, gpl) == ["mit", "mit", "bsd", "gpl"]
    df = spark.createDataFrame([(1, "one line\n\nmore\n" + MIT)], "doc_id long, text string")
    # the blocks of the lines before reach into the notice too
    assert [(r.line, r.label) for r in lic.matching_blocks(df).where("share = 1").orderBy("line").collect()] == [(0, "mit"), (2, "mit"), (3, "mit")]


def test_many_templates(spark):
    templates = [(f"t{k}", f"notice number{k} of the collection {k}", ()) for k in range(2500)]
    df = spark.createDataFrame([(1, "Notice number2400 of the collection 2400"), (2, "no such")], "doc_id long, text string")
    assert [r.labels for r in lic.scan(df, templates=templates, threshold=1.0).orderBy("doc_id").collect()] == ["t2400", ""]


def test_columns_with_clashing_names(spark):
    names = ["th", "line", "b", "joined", "start", "size", "need", "label", "share", "id", "base", "met"]
    df = spark.createDataFrame([(1, "Released under the MIT License", *range(12))], ["doc_id", "text", *names])
    assert [r.labels for r in lic.scan(df).collect()] == ["mit"]
