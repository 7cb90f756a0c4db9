import hashlib
import random
import re

from geolith.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def brute(docs, items, n=8):
    grams = {}
    for item, text in items:
        w = WORD.findall(lowered(text))
        k = min(n, len(w))
        if item is not None and w:
            for i in range(len(w) - k + 1):
                grams.setdefault(tuple(w[i : i + k]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = WORD.findall(lowered(text))
        hit, found = set(), set()
        for k in {len(g) for g in grams}:
            for i in range(len(w) - k + 1):
                own = grams.get(tuple(w[i : i + k]))
                if own:
                    hit |= set(range(i, i + k))
                    found |= own
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def data():
    rng = random.Random(2)
    vocab = ["The", "É", "über", "x1", "ẞ", "K", "naïve"] + [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(vocab) for _ in range(rng.choice([8, 12, 30])))) for k in range(12)]
    items += [(50, "Only four Words, here!"), (51, "short one"), (52, None), (53, "  .. "), (None, items[0][1]), (2, items[3][1]), (60, items[1][1]), (9, items[1][1])]
    docs = []
    for k in range(50):
        words = [rng.choice(vocab) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            words[at:at] = (rng.choice(items)[1] or "").upper().split()
        docs.append((k, rng.choice([" ", ", ", "\n", "_"]).join(words)))
    docs += [(100, None), (101, ""), (102, "?!"), (103, "a short ONE."), (104, "z " * 40_000 + items[0][1]), (105, "only four words here"), (None, items[1][1])]
    return docs + docs[:2], items


def test_query_equals_brute_force(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in dc.query(d, b).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=str)
    assert got == brute(docs, items)
    assert any(r[5] for r in got)


def test_shuffled_windows_give_the_same(spark):
    docs, items = data()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")

    def rows(df):
        return sorted((str(tuple(r)) for r in df.collect()))

    assert rows(dc.hits(d, b)) == rows(dc.hits(d, b, broadcast_limit=0))


def test_removal(spark):
    items = [(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, "one two three four five six seven eight")]
    docs = [
        (1, "Intro, alpha BETA gamma delta; epsilon zeta eta theta. Outro!", "s", "x"),
        (2, f"{items[0][1]} and {items[1][1]}", "s", "x"),
        (3, "clean  text,\n as it was", None, "x"),
        (4, None, None, None),
        (5, items[0][1], "s", "x"),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, th string, hit_places string")
    out = dc.remove_test_data(d, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == d.columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: "Intro, Outro!", 3: "clean  text,\n as it was", 4: None, 5: ""}


def test_empty(spark):
    d, b = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert dc.query(d.limit(0), b).count() == 0
    assert [tuple(r)[1:4] for r in dc.query(d, b.limit(0)).collect()] == [(2, 0, 0)]
    assert dc.remove_test_data(d, b.limit(0)).count() == 1


def test_columns_with_clashing_names_stay(spark):
    names = ["places_", "items_", "found_places", "Found_Items", "hit_places", "th", "gram", "pos", "size"]
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine", *range(9)), (2, "short item and more", *range(9)), (3, None, *range(9))], ["doc_id", "text", *names])
    items = spark.createDataFrame([("a", "two three four five six seven eight nine"), ("b", "short item")], "item_id string, text string")
    out = {r.doc_id: r for r in dc.remove_test_data(docs, items).collect()}
    assert out[1].text == "one " and out[2].text == "and more" and out[3].text is None
    assert dc.remove_test_data(docs, items).columns == docs.columns and list(out[1])[2:] == list(range(9))
