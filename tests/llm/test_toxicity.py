import random
import zlib

import numpy as np

from geolith.llm import toxicity as tox


def brute_marginals(e, start, step):
    """Sums over all labellings."""
    n = len(e)
    total, ones, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
    for code in range(1 << n):
        y = [code >> k & 1 for k in range(n)]
        s = start[y[0]] + sum(step[a][b] for a, b in zip(y, y[1:])) + sum(x for x, k in zip(e, y) if k)
        p = np.exp(s)
        total += p
        ones += p * np.array(y)
        for a, b in zip(y, y[1:]):
            pairs[a, b] += p
    return ones / total, pairs / total


def test_forward_backward_equals_all_labellings():
    rng = np.random.default_rng(0)
    sizes = [1, 0, 9, 3, 12, 0]
    e = rng.normal(0, 2, sum(sizes))
    last = np.cumsum(sizes)
    first = last - sizes
    start, step = rng.normal(size=2), rng.normal(size=(2, 2))
    old = tox.STEP
    try:
        for width in (1, 4, 64):
            tox.STEP = width
            got, pairs = tox.forward_backward(e, first, last, start, step, True)
            parts = [brute_marginals(e[a:b], start, step) for a, b in zip(first, last) if b > a]
            assert np.allclose(got, np.concatenate([p[0] for p in parts]))
            assert np.allclose(pairs, sum(p[1] for p in parts))
    finally:
        tox.STEP = old


def test_tokens_keep_their_places():
    texts = [b"", "Über  idiot, x".encode(), b"one", b"?!"]
    t = tox.tokens(texts)
    own = [[texts[k][a:b].decode() for a, b in zip(t.begins[i:j], t.ends[i:j])] for k, (i, j) in enumerate(zip(t.first, t.last))]
    assert own == [[], ["Über", "idiot", "x"], ["one"], []]
    assert (tox.tokens([b"IDIOT"]).features == tox.tokens([b"x idiot"]).features[1]).all()


def corpus(n=700):
    rng = random.Random(8)
    clean = [f"word{k}" for k in range(200)]
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        bad = rng.random() < 0.3
        for _ in range(rng.randrange(1, 4) if bad else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["idiot", "Scum", f"badstem{rng.randrange(1000)}"]))
        docs.append((k, " ".join(words)))
        labels.append((k, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_spans(spark):
    docs, labels = corpus()
    extra = [(9000, None), (9001, ""), (9002, "..."), (9003, "word1 " * 30_000 + "idiot"), (None, "no id")]
    d = spark.createDataFrame(docs + extra + docs[:1], "doc_id long, text string")
    y = spark.createDataFrame(labels + [(9500, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    got = tox.query(d, y).collect()
    assert len(got) == len(docs) + len(extra) + 1
    truth = dict(labels)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [(truth[r.doc_id], r.predicted) for r in got if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and np.mean([a == b for a, b in held]) > 0.97
    assert next(r.predicted for r in got if r.doc_id == 9003) == 1
    model = tox.fit([t.encode() for _, t in docs], np.array([v == 1 for _, v in labels]))
    text = "word1 é word2, IDIOT scum word3 badstem77"
    (spans,) = tox.apply(model, [text.encode()])[1]
    assert [text[s["start"] : s["end"]] for s in spans] == ["IDIOT scum", "badstem77"]


def test_without_labels_or_rows(spark):
    d = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    y = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert {r.score for r in tox.query(d, y.limit(0)).collect()} == {0.0}
    assert {r.score for r in tox.query(d, y).collect()} == {0.0}
    assert tox.query(d.limit(0), y).count() == 0


def test_clashing_columns(spark):
    d = spark.createDataFrame([(1, "a", "s", 3)], "doc_id long, text string, score string, spans int")
    assert tox.score(d, tox.Model()).columns == ["doc_id", "text", "score", "spans", "score_1", "spans_1"]
