import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from geolith.llm import simhash


def brute(rows):
    fps = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        values = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(v >> b & 1 for v in values) > len(values))
    comp = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 2 and comp[a] > comp[b]:
                    comp[a], changed = comp[b], True
    return {(i, f"{fps[i]:016x}", comp[i]) for i in fps}


def texts():
    rng = random.Random(5)
    vocab = [f"w{k}é" if k % 7 == 0 else f"W{k}" for k in range(60)]
    base = [[rng.choice(vocab) for _ in range(400)] for _ in range(6)]
    rows = []
    for k in range(70):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2])):
            words[rng.randrange(400)] = rng.choice(vocab)
        rows.append((k + 100, " ".join(words)))
    return rows + [(1, None), (2, ""), (3, " \n\t"), (4, "one"), (5, "one TWO"), (6, "ONE two"), (7, "x" * 100_000), (8, "a b c " * 30_000)]


def test_query_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {tuple(r) for r in simhash.query(df).select("doc_id", "fingerprint", "component_id").collect()}
    assert got == brute(rows)


def test_large_groups_take_the_exact_way_for_the_rest(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 63))
    fps = {centre} | {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (60, 2))} | {int(x) for x in rng.integers(0, 1 << 63, 40)}
    fps = sorted(simhash.signed(x) for x in fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")

    def parts(cap):
        found = simhash.links(df, 2, cap).collect()
        assert all((r.a ^ r.b & (1 << 64) - 1).bit_count() <= 2 or ((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 2 for r in found)
        at = {x: x for x in fps}
        for _ in fps:
            for r in found:
                at[r.a] = at[r.b] = min(at[r.a], at[r.b])
        return at

    exact = {x: x for x in fps}
    for _ in range(5):
        for x in fps:
            for y in fps:
                if ((x ^ y) & (1 << 64) - 1).bit_count() <= 2:
                    exact[x] = exact[y] = min(exact[x], exact[y])
    assert parts(2048) == parts(3) == exact


def test_near_duplicates_keeps_clashing_columns_and_repeated_rows(spark):
    rows = [(1, "a b c d", "x", 7), (1, "a b c d", "x", 7), (2, "a b c d", None, 8), (None, "a b c d", "y", 9), (None, "q r s t", "z", 1), (None, "u v w x y", "z", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string, fp long")
    out = simhash.near_duplicates(df)
    assert out.columns == ["doc_id", "text", "fingerprint", "fp", "fingerprint_1", "component_id"]
    assert sorted((r.doc_id or 0, r.component_id) for r in out.where("text like 'a%'").collect()) == [(0, 1), (1, 1), (1, 1), (2, 1)]
    kept = simhash.first_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "q r s t"), (0, "u v w x y"), (1, "a b c d")]


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.query(df).count() == 0
    assert simhash.first_of_each(df).count() == 0


def test_components_of_chains_stars_and_cycles(spark):
    from geolith.llm.common import connected_components

    edges = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(201, 202), (202, 203), (203, 201), (300, 300), (None, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, **{k: 100 for k in range(100, 160)}, 201: 201, 202: 201, 203: 201, 300: 300}


def test_rows_larger_than_a_batch(spark):
    long = "word " * 5_000_000
    rows = [(1, long), (2, "short text"), (3, long + "x"), (4, long)]
    got = {r.doc_id: r.component_id for r in simhash.query(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[1] == got[4] == got[3] == 1 and got[2] == 2
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b")) <= 16 << 20
