import random
import re

import pytest

cp = pytest.importorskip("corpus_pipeline")

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Some hundred documents with toxic ones, copies, shared passages and test items planted in them."""
    rng = random.Random(12)
    vocab = [f"word{k}" for k in range(3000)]

    def say(n):
        return [rng.choice(vocab) for _ in range(n)]

    items = [(k, " ".join(say(15))) for k in range(4)]
    passage = say(60)
    docs, labels = [], []
    for k in range(400):
        words = say(rng.randrange(20, 120))
        kind = k % 8
        if kind == 0:
            words[5:5] = ["idiot", "scum"]
        if kind == 1:
            words[7:7] = passage
        if kind == 2:
            words += items[k % 4][1].split()
        if kind == 3 and k % 3 == 0:
            words += items[0][1].split() + say(9) + items[1][1].split()
        docs.append((k, " ".join(words), "en", "s", 1, "more"))
        if k % 2 == 0 or k % 3 == 0:
            labels.append((k, 1, int(kind == 0)))
    docs += [(1000 + k, docs[4][1], "en", "s", 1, None) for k in range(5)]
    docs += [(2000, None, None, None, None, None), (2001, "", "en", "s", 0, None), (2002, " \n", "en", "s", 2, None)]
    docs.append(docs[5])
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, extra string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, items, passage


def test_run_equals_plain_python(spark, tables):
    path, docs, items, passage = tables
    rows = {d[0]: d for d in docs}
    # 1. planted toxic documents go, and no others
    kept = {i: d for i, d in rows.items() if not re.search("idiot|scum", d[1] or "")}
    # 2. exact copies: the smallest id stays; texts without words are copies of one another
    first = {}
    for i in sorted(kept):
        first.setdefault(" ".join((kept[i][1] or "").split()), i)
    kept = {i: kept[i] for i in first.values()}
    # 3. windows of 35 words that start twice
    words = {i: (d[1] or "").split() for i, d in kept.items()}
    starts = {}
    for i, w in words.items():
        for k in range(len(w) - 34):
            starts.setdefault(tuple(w[k : k + 35]), []).append((i, k))
    gone = {(i, k + j) for at in starts.values() if len(at) > 1 for i, k in at for j in range(35)}
    words = {i: [x for k, x in enumerate(w) if (i, k) not in gone] for i, w in words.items()}
    # 4. windows of eight words of test items
    grams = {}
    for item, text in items:
        w = text.split()
        for k in range(len(w) - 7):
            grams.setdefault(tuple(w[k : k + 8]), set()).add(item)
    want = {}
    for i, w in words.items():
        hit, found = set(), set()
        for k in range(len(w) - 7):
            if tuple(w[k : k + 8]) in grams:
                hit |= set(range(k, k + 8))
                found |= grams[tuple(w[k : k + 8])]
        if len(found) < 2:
            want[i] = [x for k, x in enumerate(w) if k not in hit]
    out = cp.run(spark, path).collect()
    assert {r.doc_id: (r.text or "").split() for r in out} == want and len(out) == len(want)
    assert any(i % 8 == 1 and len(w) < 120 for i, w in want.items()) and passage[0] not in want[9]
    # 5. the pieces give the text back
    from geolith.llm import sentencepiece_codec as sp

    codec = sp.Codec(sp.load())
    for r in out:
        assert r.text is None or codec.decode(codec.encode(r.text)).decode() == r.text
        assert r.piece_ids == (None if r.text is None else codec.encode(r.text).tolist())
        assert r.n_chars == (None if r.text is None else len(r.text)) or r.text == rows[r.doc_id][1]


def test_stages_keep_the_columns(spark, tables):
    path = tables[0]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, path).columns == docs.columns
        assert stage(spark, docs.limit(0), path).count() == 0
