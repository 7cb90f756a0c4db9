import random

import pytest

from geolith.llm import sentencepiece_codec as sp

BYTES = tuple(range(3, 259))


def vocabulary(pieces, with_bytes=True):
    own = [("<unk>", 0.0, False), ("<s>", 0.0, False), ("</s>", 0.0, False)]
    own += [(f"<0x{b:02X}>", 0.0, False) for b in range(256)] if with_bytes else []
    own += [(p, s, True) for p, s in pieces]
    return sp.Vocabulary(tuple(p for p, _, _ in own), tuple(s for _, s, _ in own), tuple(k for _, _, k in own), BYTES if with_bytes else (), 0)


def brute_score(codec, v, text):
    """The best score over all segmentations, by plain dynamic programming over all substrings."""
    score = {p: s for p, s, k in zip(v.pieces, v.scores, v.plain) if k}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for begin in range(end):
            s = score.get(text[begin:end])
            if s is not None:
                best[end] = max(best[end], best[begin] + s)
        if text[end - 1] not in score:
            best[end] = max(best[end], best[end - 1] + codec.miss)
    return best[-1]


def own_score(codec, v, ids):
    total, k = 0.0, 0
    while k < len(ids):
        if ids[k] in BYTES:
            first = ids[k] - 3
            k += 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            total += codec.miss
        else:
            total += v.scores[ids[k]]
            k += 1
    return total


@pytest.mark.parametrize("crossing", [False, True])
def test_best_scores_equal_brute_force(crossing):
    rng = random.Random(3)
    pieces = {"▁", "▁▁", "a", "b", "ab", "ba", "▁a", "▁ab", "aba", "é", "abab", "\n"} | ({"a▁b"} if crossing else set())
    v = vocabulary([(p, -rng.uniform(1, 9)) for p in sorted(pieces)])
    codec = sp.Codec(v)
    for _ in range(300):
        text = "".join(rng.choice("aab é\nz\U0001f600") for _ in range(rng.randrange(14)))
        ids = codec.encode(text).tolist()
        assert codec.decode(codec.encode(text)).decode() == text
        if text:
            assert own_score(codec, v, ids) == pytest.approx(brute_score(codec, v, "▁" + text.replace(" ", "▁")))


def test_public_vocabulary_round_trip(spark):
    v = sp.load()
    texts = ["Hello  world\nfoo ▁ x", "", None, " ", "\t\r\x00", "naïve Ünï 梦 \U0001f600", "▁", "word " * 30_000, "x" * 50_000, "Hello  world\nfoo ▁ x"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = sp.encode(d, v)
    assert enc.columns == ["doc_id", "text", "piece_ids"]
    out = {r.doc_id: r for r in sp.decode(enc, v).collect()}
    assert [out[k].decoded for k in range(len(texts))] == texts
    assert out[1].piece_ids == [] and out[2].piece_ids is None
    assert "".join(v.pieces[i] for i in out[0].piece_ids).startswith("▁Hello▁▁world<0x0A>foo")
    got = sp.query(d).collect()
    assert all(r.round_trip for r in got) and len(got) == len(texts)


def test_no_byte_pieces_and_null_ids(spark):
    v = vocabulary([("▁", -1.0), ("a", -1.0)], with_bytes=False)
    d = spark.createDataFrame([(1, "aza", "x")], "doc_id long, text string, piece_ids string")
    enc = sp.encode(d, v)
    assert enc.columns[-1] == "piece_ids_1" and enc.first()["piece_ids_1"] == [3, 4, 0, 4]
    d = spark.createDataFrame([(1, [3, None, 4]), (2, None), (3, [])], "doc_id long, piece_ids array<int>")
    assert [r.decoded for r in sp.decode(d, v).orderBy("doc_id").collect()] == ["a", None, ""]


def test_empty(spark):
    assert sp.query(spark.createDataFrame([], "doc_id long, text string")).count() == 0
