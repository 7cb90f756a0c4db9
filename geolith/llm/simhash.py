"""SimHash near-duplicates, with deletion-variant signatures as the index.

A text's fingerprint has 64 bits: bit i is 1 if it is 1 in over half of the XXH64 values of the text's word
shingles, repeats included.  Two fingerprints are linked if they differ in at most ``max_bits`` bits.

Candidates: 64 bits are cut into ``max_bits // 2 + 1`` segments.  If two fingerprints differ in ``max_bits`` bits
at most, some segment differs in one bit at most, so the two share a *one-wildcard variant* of that segment (the
segment with the bit at one place deleted).  Every distinct fingerprint is indexed under all its variants, the
variants are grouped by equality, and members of a group are verified on all 64 bits.

No group gives all its pairs.  Groups stream through in key order; one of up to ``group_cap`` fingerprints is
verified in memory and leaves a spanning forest of its links.  A larger one is verified by equality alone: its
members are indexed again under every way to blank ``max_bits`` of 64 bits, which makes groups of at most
``2 ** max_bits`` members.  Both ways are exact.

Null, empty and blank texts have no words and the fingerprint zero, which links like any other.  A text with fewer
words than a shingle is one shingle; a very long one is hashed in parts.  Repeated rows each get a row.  Other columns
stay, and added ones take other names where they clash.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import near_dedup
from .common import connected_components, fresh, give_back, modest_batches, stored

SEED = 42
BLOCK = 1 << 16


def fingerprint(raw: bytes | None, shingle: int = 3) -> int:
    """The unsigned fingerprint of one UTF-8 text."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    n = len(words) - shingle + 1
    if n <= 1:
        return digest(joined, SEED)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends[: n - 1]]
    values = np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])), "<u8", n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, BLOCK):
        ones += np.unpackbits(values[k : k + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, fp_col: str, shingle: int = 3) -> DataFrame:
    """``docs`` with the signed 64-bit fingerprint of ``text_col`` as ``fp_col``."""
    modest_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(fp_col, T.LongType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).cast(pa.binary())
            fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), "<u8", batch.num_rows).view("<i8")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, fp_col])
            give_back()

    return docs.mapInArrow(run, schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    n = max_bits // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def variants(max_bits: int) -> list[tuple[int, int]]:
    """(number, mask of the bits that count) of each one-wildcard variant of each segment."""
    masks = [((1 << w) - 1 << low) & ~(1 << low + i) for low, w in segments(max_bits) for i in range(w)]
    return list(enumerate(masks))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links (a > b) that join all linked members of one small group, one fewer than members at most."""
    n = len(fps)
    if n == 2:
        return [(1, 0)] if int(fps[0] ^ fps[1]).bit_count() <= max_bits else []
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(1, n):
        for j in np.flatnonzero(np.bitwise_count(fps[:i] ^ fps[i]) <= max_bits):
            a, b = root(i), root(int(j))
            if a != b:
                parent[max(a, b)] = min(a, b)
                out.append((i, int(j)))
    return out


def links(fps: DataFrame, max_bits: int = 2, group_cap: int = 2048) -> DataFrame:
    """Distinct fingerprints (fp) -> (a, b): links enough to connect all that reach one another."""
    table = variants(max_bits)
    index = F.explode(F.array(*[F.struct(F.lit(k).alias("v"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("part")) for k, m in table]))
    keyed = fps.select("fp", index.alias("k")).select(F.xxhash64("k.v", "k.part").alias("key"), "fp")
    keyed = keyed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("hot", pa.int64())])

        def made(a, b, hot) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, hot)], schema=schema)

        held_k, held, hot = np.empty(0, "<i8"), np.empty(0, "<i8"), None

        def solve(keys: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            a, b, h = [], [], []
            for k in np.flatnonzero(np.diff(edge) > 1):
                group = own[edge[k] : edge[k + 1]]
                if len(group) > group_cap:
                    a += group.tolist()
                    b += group.tolist()
                    h += [1] * len(group)
                else:
                    for i, j in forest(group.view("<u8"), max_bits):
                        a.append(int(max(group[i], group[j])))
                        b.append(int(min(group[i], group[j])))
                        h.append(0)
            return made(a, b, h)

        for batch in batches:
            keys, own = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if not len(keys):
                continue
            if hot is not None:  # a large group goes on: pass its members through
                n = int(np.searchsorted(keys, hot, "right"))
                yield made(own[:n], own[:n], np.ones(n, "<i8"))
                keys, own = keys[n:], own[n:]
                if not len(keys):
                    continue
                hot = None
            held_k, held = np.concatenate((held_k, keys)), np.concatenate((held, own))
            last = int(np.searchsorted(held_k, held_k[-1]))
            if last:
                yield solve(held_k[:last], held[:last])
                held_k, held = held_k[last:], held[last:]
            if len(held) > group_cap:
                yield made(held, held, np.ones(len(held), "<i8"))
                hot, held_k, held = held_k[0], held_k[:0], held[:0]
        if len(held):
            yield solve(held_k, held)

    found = stored(keyed.mapInArrow(run, "a long, b long, hot long"), "simhash-links")
    direct = found.where("hot = 0").select("a", "b")
    hot = found.where("hot = 1").select(F.col("a").alias("fp")).distinct()
    if hot.isEmpty():
        return direct.distinct()
    blanks = [signed(~sum(1 << i for i in c) & (1 << 64) - 1) for c in combinations(range(64), max_bits)]
    wide = hot.select("fp", F.posexplode(F.array(*map(F.lit, blanks))).alias("v", "mask")).select("fp", "v", F.col("fp").bitwiseAND(F.col("mask")).alias("part"))
    # whoever shares all but max_bits bits is linked, so the smallest member stands for the group
    least = wide.groupBy("v", "part").agg(F.min("fp").alias("b"), F.collect_list("fp").alias("own")).where(F.size("own") > 1)
    return direct.union(least.select(F.explode("own").alias("a"), "b").where("a > b")).distinct()


def components(marked: DataFrame, fp_col: str, id_col: str, max_bits: int = 2, group_cap: int = 2048) -> DataFrame:
    """(fp, root, component): for each fingerprint in ``marked`` the least fingerprint and the smallest id it reaches."""
    least = marked.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("least"))
    roots = connected_components(links(least.select("fp"), max_bits, group_cap))
    placed = stored(least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "least"), "simhash-placed")
    # stored, so that the join of one very large component can be split
    named = stored(placed.groupBy("root").agg(F.min("least").alias("component")), "simhash-names")
    return placed.join(named, "root").select("fp", "root", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, max_bits: int = 2, group_cap: int = 2048) -> DataFrame:
    """``docs`` with ``fingerprint`` (long) and ``component_id``: the smallest id that its fingerprint reaches.

    The added columns take other names (``fingerprint_1`` ...) where ``docs`` has such columns.  A component whose
    ids are all null has a null id.
    """
    fp_col, comp_col, key = fresh(docs, "fingerprint", "component_id", "fp_key")
    marked = stored(with_fingerprints(docs, text_col, fp_col, shingle), "simhash")
    of = components(marked, fp_col, id_col, max_bits, group_cap).select(F.col("fp").alias(key), F.col("component").alias(comp_col))
    return marked.join(of, marked[fp_col] == of[key], "left").drop(key)


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float | None = 0.8, max_bits: int = 2) -> DataFrame:
    """One row of each group of near-duplicates, the one with the smallest id (of repeated rows, one); the columns of
    ``docs``.

    With a ``similarity``, texts are linked that share that much of their shingles; their fingerprints lie so many
    bits apart that 64 bits do not do: ``near_dedup`` takes the same index over wider ones.  With None,
    fingerprints at ``max_bits`` or fewer are.  Rows with a null id are kept only where no row of their component has
    an id.
    """
    if similarity is not None:
        return near_dedup.first_of_each(docs, id_col, text_col, shingle, similarity)
    fp_col, row_col = fresh(docs, "fingerprint", "row_number")
    marked = stored(with_fingerprints(docs, text_col, fp_col, shingle).withColumn(row_col, F.monotonically_increasing_id()), "simhash")
    of = components(marked, fp_col, id_col, max_bits)
    slim = marked.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(fp_col).alias("fp"))
    heads = slim.join(of, "fp").where(F.col("id").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min("row").alias("row"))
    return marked.join(heads.select(F.col("row").alias(row_col)), row_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, fingerprint (16 hex digits), component_id."""
    marked = stored(with_fingerprints(docs.select("doc_id", "text"), "text", "fp").select("doc_id", "fp"), "simhash")
    of = components(marked, "fp", "doc_id")
    out = marked.join(of, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))
