import random
import re
from collections import Counter, defaultdict

from geolith.llm import quality


def brute(rows, least=10, share=0.01, left=0.3):
    word = re.compile(r"[^\x20\x09-\x0D]+")
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    norm = lambda x: lower(" ".join(word.findall(x)))
    docs, all_docs = defaultdict(set), defaultdict(set)
    for i, text, host in rows:
        own_id = (i, None) if i is not None else (None, text)
        all_docs[host].add(own_id)
        for x in (text or "").split("\n"):
            if word.search(x):
                docs[host, norm(x)].add(own_id)
    out = []
    for i, text, host in rows:
        w = word.findall(text or "")
        own = [x for x in (text or "").split("\n") if word.search(x)]
        seen = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        rep = {k + j for k in range(len(w) - 4) if seen[tuple(w[k : k + 5])] > 1 for j in range(5)}
        lost = sum(len(word.findall(x)) for x in own if len(docs[host, norm(x)]) > max(least, share * len(all_docs[host])))
        failed = len(w) < 10 or 100 * len(rep) > 20 * len(w)
        out.append((i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(own) - len(set(own)), len(rep), failed, lost, not failed and len(w) - lost >= len(w) * left))
    return sorted(out, key=str)


def rows():
    rng = random.Random(6)
    vocab = [f"w{k}" for k in range(300)] + ["#", "**", "é<", "Ü"]
    common = ["Home | About us", "Copyright  NOTICE of this site and more words here"]
    out = []
    for k in range(150):
        lines = [" ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 12))) for _ in range(rng.randrange(8))]
        for c in common:
            if rng.random() < 0.5:
                lines.append(rng.choice([c, c.upper(), f"  {c}\t"]))
        if rng.random() < 0.2 and lines:
            lines += lines[:2]
        out.append((k, "\n".join(lines), rng.choice(["a", "a", "b", None])))
    text = " ".join(rng.choice(vocab) for _ in range(30))
    out += [(500 + k, text, "a") for k in range(40)]
    return out + [(1000, None, "a"), (1001, "", "a"), (1002, " \n ", "b"), (1003, "la " * 30_000, "a"), (1004, "a b c d e", "a"), (1005, "a b c d e a b c d e", "a"), (1006, "b " * 6, "a"), (None, text, None), (3, out[3][1], out[3][2])]


def test_query_equals_brute_force(spark):
    data = rows()
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    got = quality.query(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_boilerplate_words", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(data)
    assert {r.kept for r in got} == {True, False}


def test_rows_count_by_their_ids(spark):
    text = "one two three four five six seven eight nine ten eleven"
    apart = spark.createDataFrame([(k, text, "h") for k in range(60)], "doc_id long, text string, source string")
    assert not any(r.kept for r in quality.query(apart).collect())
    # one document, however often its row is repeated
    again = spark.createDataFrame([(7, text, "h")] * 60, "doc_id long, text string, source string")
    assert all(r.kept for r in quality.query(again).collect())



def test_empty(spark):
    assert quality.query(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
