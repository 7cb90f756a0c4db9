import random

import numpy as np
import pytest

from geolith.llm import near_dedup


def grams(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def brute(rows):
    """The smallest id of each component of pairs with a Jaccard similarity of 0.8 or more."""
    sets = {i: grams(t) for i, t in rows}
    at = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if at[a] != at[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                    at[a] = at[b] = min(at[a], at[b])
                    changed = True
    return set(at.values())


def planted():
    """Copies with some words replaced, so that the similarity lies on both sides of 0.8, and chains of them."""
    rng = random.Random(3)
    vocab = [f"word{k}" for k in range(4000)]
    rows = []
    for base in range(20):
        words = [rng.choice(vocab) for _ in range(rng.randrange(100, 400))]
        for copy in range(5):
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((base * 10 + copy, " ".join(words)))
    return rows + [(1000, None), (1001, " \n"), (1002, "one Two"), (1003, "one two"), (1004, "one two three")]


def test_planted_near_copies_go(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id for r in near_dedup.first_of_each(docs).collect()} == brute(rows)


def test_the_pipeline_stage_takes_near_copies(spark):
    cp = pytest.importorskip("corpus_pipeline")
    words = [f"word{k}" for k in range(80)]
    near = [*words[:10], "other", *words[11:]]  # fingerprints seven bits apart
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, "no copy")], "doc_id long, text string")
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == [1, 3]


def test_null_ids_and_empty(spark):
    rows = [(1, "a b c d e f"), (None, "a b c d e f"), (None, "q r s t u v"), (None, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id or 0, r.text[0]) for r in near_dedup.first_of_each(df).collect()) == [(0, "q"), (1, "a")]
    assert near_dedup.first_of_each(df.limit(0)).count() == 0


def test_small_blocks_lose_no_link(spark):
    """A chain whose ends are not similar, its middles in buckets with heads that they are not linked to."""
    rng = random.Random(8)
    vocab = [f"word{k}" for k in range(9000)]
    rows = []
    for base in range(3):
        words = [rng.choice(vocab) for _ in range(120)]
        for step in range(40):
            words[(step * 7) % 120] = rng.choice(vocab)
            if step % 3 == 0:
                words[(step * 11 + 5) % 120] = rng.choice(vocab)
            rows.append((base * 100 + rng.randrange(10**6) * 1000 + step, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (2, 7, 1024):
        assert {r.doc_id for r in near_dedup.first_of_each(docs, block=block).collect()} == brute(rows)


def test_columns_with_clashing_names(spark):
    names = ["node", "bands", "row_number", "key", "head", "root", "least", "component", "id", "row"]
    docs = spark.createDataFrame([(1, "a b c d e f", *range(10)), (2, "A b c d e f", *range(10))], ["doc_id", "text", *names])
    (row,) = near_dedup.first_of_each(docs).collect()
    assert tuple(row) == (1, "a b c d e f", *range(10))


def test_candidates_of_the_stage_are_deletion_variants_of_fingerprints(spark, monkeypatch):
    """The stage finds links through the index of fingerprints, and links of other segments than equal ones."""
    cp = pytest.importorskip("corpus_pipeline")
    rng = random.Random(4)
    words = [f"word{rng.randrange(9000)}" for _ in range(200)]
    near = [*words[:60], "other", *words[61:140], "more", *words[141:]]  # similarity 0.9
    texts = {1: " ".join(words), 2: " ".join(near), 3: "no copy", 4: "NO copy"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    seen, links = [], near_dedup.links
    monkeypatch.setattr(near_dedup, "links", lambda fps: seen.append(fps) or links(fps))
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == [1, 3]
    assert seen and seen[0].columns == ["fp"]
    monkeypatch.setattr(near_dedup, "links", lambda fps: spark.createDataFrame([], "a long, b long"))
    assert sorted(r.doc_id for r in cp.near_dedup(spark, docs, "").collect()) == [1, 2, 3]


def test_solved_links_equal_brute_force():
    """Segments with one bit deleted, in small groups and in walked ones, against all pairs."""
    rng = np.random.default_rng(6)
    base = rng.integers(0, 2, (5, near_dedup.BITS), dtype=np.uint8)
    fps = base[np.concatenate((np.zeros(150, int), rng.integers(1, 5, 60)))] ^ (rng.random((210, near_dedup.BITS)) < 0.09).astype(np.uint8)
    fps = np.concatenate((fps, rng.integers(0, 2, (200, near_dedup.BITS), dtype=np.uint8)))
    keys, checks = near_dedup.index_rows(np.packbits(fps, axis=1))
    order = np.argsort(keys, kind="stable")
    a, b = near_dedup.solved(keys[order], checks[order])
    ids = near_dedup.ids_of(near_dedup.checks_of(np.packbits(fps, axis=1))).tolist()

    def parts(pairs):
        at = {x: x for x in ids}

        def root(x):
            while at[x] != x:
                x = at[x]
            return x

        for x, y in pairs:
            x, y = root(x), root(y)
            at[max(x, y)] = min(x, y)
        return [root(x) for x in ids]

    segment = fps[:, : near_dedup.SEGMENTS * near_dedup.WIDTH].reshape(len(fps), near_dedup.SEGMENTS, -1)
    check = fps[:, -near_dedup.CHECK_BITS :]
    want = []
    for i in range(len(fps)):
        shares = ((segment != segment[i]).sum(axis=2) <= 1).any(axis=1)
        want += [(ids[i], ids[j]) for j in np.flatnonzero(shares & ((check != check[i]).sum(axis=1) <= near_dedup.MOST))]
    assert parts(zip(a.tolist(), b.tolist())) == parts(want)
    assert len(set(parts(want))) < 260
