import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from geolith.llm import sharding as sh


def brute_capacity(sizes, shards):
    def fits(c):
        used, room = 1, c
        for s in sizes:
            if s > c:
                return False
            if s > room:
                used, room = used + 1, c
            room -= s
        return used <= shards

    low, high = 0, sum(sizes)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if fits(mid) else (mid + 1, high)
    return low


@pytest.mark.parametrize("seed", range(6))
def test_partial_knowledge_gives_the_exact_cuts(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([16, 17, 100, rng.randrange(16, 5000)]) for _ in range(rng.choice([3, 50, 900]))]
    if seed % 2:
        sizes[rng.randrange(len(sizes))] = 40_000
    totals, t = [], 0
    for s in sizes:
        t += s
        totals.append(t)
    whole = sh.Totals(totals, set(totals))
    capacity = whole.capacity(12)
    assert capacity == brute_capacity(sizes, 12)
    df = spark.createDataFrame([(x,) for x in totals], "total long")
    assert sh.decide(df, [totals[-1]], 12, cells=20) == (capacity, whole.cuts(capacity, 12))
    cuts = [0, *whole.cuts(capacity, 12), totals[-1]]
    assert all(0 <= b - a <= capacity for a, b in zip(cuts, cuts[1:]))


def docs():
    rng = random.Random(1)
    rows = [(k, "".join(rng.choice("abcé \n") for _ in range(rng.randrange(300)))) for k in range(500)]
    rows += [(k, "the same text again " * 20) for k in range(1000, 1100)]
    return rows + [(2000, None), (2001, None), (2002, ""), (2003, "y" * 20_000), (None, "no id"), (3, rows[3][1])]


def test_query(spark):
    rows = docs()
    got = sh.query(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and all(r.grown_shard is None for r in got)
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    of, slots, held = defaultdict(set), defaultdict(list), Counter()
    text = {i: t for i, t in rows}
    for r in got:
        of[text[r.doc_id]].add(r.shard)
        slots[r.shard].append(r.slot)
        held[r.shard] += r.size
    assert all(len(s) == 1 for s in of.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(held) <= set(range(40))
    groups = Counter()
    for i, t in rows:
        groups[t] += len((t or "").encode()) + 16
    order = sorted(groups, key=lambda t: "" if t is None else hashlib.sha256(t.encode()).hexdigest())
    assert max(held.values()) == brute_capacity([groups[t] for t in order], 40)
    shard = [next(iter(of[t])) for t in order]
    assert shard == sorted(shard)


def test_few_rows_and_none(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "doc_id long, text string")
    got = sh.query(d).collect()
    assert sorted(r.slot for r in got) == [0, 0, 0] and len({r.shard for r in got}) == 3
    assert sh.query(d.limit(0)).count() == 0


def test_other_columns_may_clash(spark):
    d = spark.createDataFrame([(1, "a", "x", 3)], "doc_id long, text string, key string, size int")
    assert sh.assigned(d, shards=2).columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert sh.assigned(d, shards=2).select(F.sum("size")).first()[0] == 17
