import hashlib
import random
from collections import Counter

from geolith.llm import substring_dedup as sd


def brute(rows, window=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    starts = Counter(tuple(w[k : k + window]) for _, w in words for k in range(len(w) - window + 1))
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if starts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def texts(seed=3):
    rng = random.Random(seed)
    vocab = ["a", "b", "é", "Ünï", "word", "x" * 40, "it's", " ", "no break", "0"] + [f"v{k}" for k in range(400)]

    def say(n):
        return [rng.choice(vocab) for _ in range(n)]

    shared = [say(n) for n in (34, 35, 36, 53, 90)]
    rows = []
    for k in range(60):
        words = say(rng.randrange(0, 150))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = rng.choice(shared)
        rows.append((k, rng.choice([" ", "  ", "\n", "\t\r\n"]).join(words)))
    again = say(50)
    rows.append((100, " ".join(again + say(7) + again)))
    rows.append((101, " ".join(["la"] * 200)))
    rows.append((102, " ".join(["la"] * 36)))
    rows += [(103, None), (104, ""), (105, " \n "), (106, "one"), (107, "y" * 2_000_000), (108, " ".join(say(30_000))), (108, "same " * 3), (109, " ".join(shared[4]))]
    return rows + [rows[0], rows[0]]


def test_query_equals_brute_force(spark):
    rows = texts()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in sd.query(df).select("doc_id", "n_words", "n_removed", "kept_sha256").collect())
    assert got == brute(rows)
    assert 0 < sum(r[2] for r in got) < sum(r[1] for r in got)


def test_other_windows(spark):
    rows = texts(9)[:80]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for window in (1, 2, 8):
        got = sorted(tuple(r) for r in sd.remove_repeats(df, window=window).selectExpr("row.doc_id", "n_words", "n_removed", "sha2(coalesce(kept_words, ''), 256)").collect())
        assert got == brute(rows, window)


def test_kept_text_and_columns(spark):
    passage = " ".join(f"p{k}" for k in range(40))
    rows = [(1, f"Head  line\n{passage}\ntail  end", "s", 1), (2, f"{passage}", None, 2), (3, "clean\n text ", "s", 3), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, chunk string, n_words int")
    got = {r.row.doc_id: r for r in sd.remove_repeats(df).collect()}
    assert got[1].kept_text == "Head  line\ntail  end" and got[1].kept_words == "Head line tail end"
    assert got[2].kept_text == "" and got[2].n_removed == 40
    assert got[3].kept_text == "clean\n text " and got[3].row.chunk == "s"
    assert got[None].kept_text is None and got[None].n_words == 0


def test_empty(spark):
    assert sd.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_packing():
    import numpy as np

    for keys in ([5], [0, 1, 2**63, 2**64 - 1], [7, 8, 9]):
        keys = np.array(keys, np.uint64)
        assert (sd.unpacked(sd.packed(keys)) == keys).all()


def twins(n):
    """Two words of 2 ** n letters whose hashes by sums of powers modulo 2 ** 64 are equal."""
    a = "a"
    for _ in range(n):
        a += a.translate(str.maketrans("ab", "ba"))
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_words_that_differ_in_letters_only(spark):
    a, b = twins(11)
    texts = [" ".join(["w%d" % k for k in range(34)] + [x]) for x in (a, b)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.n_removed for r in sd.query(docs).collect()} == {0}
    again = spark.createDataFrame(list(enumerate([*texts, texts[0]])), "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in sd.query(again).collect()} == {0: 35, 1: 0, 2: 35}


def test_very_many_equal_rows_are_dealt_apart(spark):
    passage = " ".join("p%d" % k for k in range(40))
    rows = [(None, None)] * 300 + [(7, passage)] * 50 + [(8, "alone " + passage), (9, "other words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    _, spread, _, _ = sd.dealt(docs, "text", "doc_id", 4, 1 << 10, 1 << 10)
    assert "row_number" in str(spread)
    out = sd.remove_repeats(docs, chunk_bytes=1 << 10, range_bytes=1 << 10)
    found = Counter((r.row.doc_id, r.n_words, r.n_removed, r.kept_words) for r in out.collect())
    assert found == {(None, 0, 0, None): 300, (7, 40, 40, ""): 50, (8, 41, 40, "alone"): 1, (9, 2, 0, "other words"): 1}
