"""Near-duplicates by the overlap of word shingles: links of pairs with a Jaccard similarity of ``least`` or more.

A text's set has the XXH64 values of its ``shingle``-word shingles, ASCII letters lower-cased.  A text with fewer
words is one shingle; null, empty and blank texts have one empty shingle, so that they are copies of one another.

1. *Copies.*  Texts with equal words are one node.
2. *Fingerprints.*  SimHash of ``BITS`` bits: a bit is 1 if it is 1 in over half of the mixed values of the set.  With
   a similarity of 0.8, 15 of 100 bits differ: far too many for an index of 64 bits, hence the width.
3. *Candidates.*  As in ``simhash``, by deletion variants: fingerprints share a *one-wildcard variant* of a segment if
   that segment differs in one bit at most.  A segment is wildcarded in either half, so rows are dealt by (segment,
   half that is whole, its bits) and the variants of the other half are grouped by equality in memory.  A pair at 0.8
   shares none of ``SEGMENTS`` segments of ``WIDTH`` bits with probability 6e-6, less above.
4. *Verification on bits.*  Members of a group are linked if ``MOST`` or fewer of ``CHECK_BITS`` more bits differ (a pair
   at 0.8 has more with probability 5e-5).  Links are kept as stars, so no group gives its pairs; whoever reaches one
   another is a cluster.
5. *Heads.*  Every member of a cluster is compared with the cluster's least member, and those at ``least`` or more are
   linked: a pair of texts is a row, so no cluster is in one task.
6. *Rest.*  A cluster whose members are then all in one component is done.  In the others, the members outside the
   cluster's largest component are compared with all members of other components, in blocks of ``BLOCK_TEXTS`` by
   ``BLOCK_TEXTS`` texts.  So every pair in a cluster is compared or in one component already: no link between
   components is lost, however large a cluster is.

A very long text is one row and one set.  Repeated rows are copies like any others.  Other columns stay, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import connected_components, fresh, give_back, modest_batches, stored

SEED = 42
SEGMENTS, WIDTH = 64, 20
HALF = WIDTH // 2
#: Bits beside the segments that verify a link, and how many of them may differ.
CHECK_BITS, MOST = 128, 36
BITS = SEGMENTS * WIDTH + CHECK_BITS
#: Shingles that are counted at once, in bytes.
BLOCK = 255
#: Rows of the index that are solved at once, the members of a group beyond which it is walked, and pairs compared at once there.
SOLVED, WALKED, SLAB = 1 << 17, 64, 1 << 14
#: Texts on each side of a block that is compared in memory.
BLOCK_TEXTS = 256
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, BITS // 64, dtype=np.uint64) | np.uint64(1)
MIX = np.uint64(0xBF58476D1CE4E5B9)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


def shingles(words: list[bytes], shingle: int) -> np.ndarray:
    """The text's set, in order of value."""
    joined, n = b" ".join(words), len(words) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], "<u8")
    digest = xxhash.xxh64_intdigest
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[: n - 1]]
    return np.unique(np.fromiter((digest(joined[a : b - 1], SEED) for a, b in zip(starts, ends[shingle - 1 :])), "<u8", n))


def fingerprint(own: np.ndarray) -> bytes:
    """``BITS`` bits: the segments, then the bits that verify."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(own), BLOCK):
        x = own[k : k + BLOCK, None] * MULTIPLIERS
        x ^= x >> np.uint64(29)
        x *= MIX
        x ^= x >> np.uint64(32)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(own)).tobytes()


def checks_of(fps: np.ndarray) -> np.ndarray:
    """(fingerprints, bytes) -> the bits that verify, as two columns."""
    return np.ascontiguousarray(fps[:, -CHECK_BITS // 8 :]).view("<u8")


def ids_of(checks: np.ndarray) -> np.ndarray:
    """One value for the bits that verify; where two have the same, their clusters are one, which loses no link."""
    return (checks[:, 0] ^ (checks[:, 1] * MIX)).view("<i8")


def with_fingerprints(docs: DataFrame, text_col: str, node_col: str, id_col: str, fp_col: str, shingle: int) -> DataFrame:
    """``docs`` with the hash of the text's words, its fingerprint and the value that stands for this in clusters."""
    modest_batches(docs.sparkSession)
    schema = T.StructType([*docs.schema.fields, T.StructField(node_col, T.LongType()), T.StructField(id_col, T.LongType()), T.StructField(fp_col, T.BinaryType())])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps = np.empty(batch.num_rows, "<u8"), []
            for k, text in enumerate(batch.column(at).cast(pa.binary())):
                words = words_of(text.as_py())
                nodes[k] = xxhash.xxh64_intdigest(b" ".join(words), SEED)
                fps.append(fingerprint(shingles(words, shingle)))
            ids = ids_of(checks_of(np.frombuffer(b"".join(fps), np.uint8).reshape(-1, BITS // 8)))
            added = [pa.array(nodes.view("<i8")), pa.array(ids), pa.array(fps, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, node_col, id_col, fp_col])
            give_back()

    return docs.mapInArrow(run, schema)


def index_rows(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(fingerprints, bytes) -> (key, the bits that verify): for each segment and each half of it that is whole, a key
    of the segment, the half and its bits, with the bits of the other half below."""
    bits = np.unpackbits(fps[:, : SEGMENTS * WIDTH // 8], axis=1).reshape(len(fps), SEGMENTS, 2, HALF)
    value = bits @ (1 << np.arange(HALF, dtype=np.int64))
    part = np.arange(SEGMENTS * 2, dtype=np.int64).reshape(SEGMENTS, 2)
    keys = ((part << HALF | value) << HALF) | value[:, :, ::-1]
    return keys.reshape(-1), np.repeat(checks_of(fps), SEGMENTS * 2, axis=0)


def walked(members: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """(a, b): links that join all linked members of one group."""
    out, front, left = [np.empty((0, 2), np.int64)], members[:0], members
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
            continue
        n = max(1, SLAB // len(left))
        some, front = front[:n], front[n:]
        near = np.bitwise_count(checks[some][:, None] ^ checks[left]).sum(axis=2, dtype=np.int64) <= MOST
        hit = near.any(axis=0)
        out.append(np.stack((some[near.argmax(axis=0)[hit]], left[hit]), axis=1))
        front, left = np.concatenate((front, left[hit])), left[~hit]
    return np.concatenate(out)


def solved(keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the index, whole groups -> (a, b): each id that is linked to others, and the least of those it reaches here."""
    group, rest = keys >> HALF, keys & (1 << HALF) - 1
    ends: list[np.ndarray] = []
    for i in range(HALF):  # the variants without bit i
        variant = (group << HALF) | (rest >> i + 1 << i) | (rest & (1 << i) - 1)
        order = np.argsort(variant, kind="stable")
        variant = variant[order]
        edge = np.flatnonzero(np.concatenate(([True], variant[1:] != variant[:-1], [True])))
        sizes = np.diff(edge)
        for k in np.flatnonzero(sizes > WALKED):
            ends.append(walked(order[edge[k] : edge[k + 1]], checks))
        small = np.repeat(sizes <= WALKED, sizes)
        variant, order = variant[small], order[small]
        at = np.arange(len(variant))
        for d in range(1, WALKED):
            at = at[at + d < len(variant)]
            at = at[variant[at] == variant[at + d]]  # whoever has no member d places on has none further on
            if not len(at):
                break
            a, b = order[at], order[at + d]
            near = np.bitwise_count(checks[a] ^ checks[b]).sum(axis=1, dtype=np.int64) <= MOST
            ends.append(np.stack((a[near], b[near]), axis=1))
    pairs = np.concatenate(ends) if ends else np.empty((0, 2), np.int64)
    if not len(pairs):
        return np.empty(0, "<i8"), np.empty(0, "<i8")
    ids, same = np.unique(ids_of(checks), return_inverse=True)
    a, b = np.divmod(np.unique(same[pairs[:, 0]] * len(ids) + same[pairs[:, 1]]), len(ids))
    least, before = np.arange(len(ids)), None
    while before is None or (least != before).any():
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        least = least[least]
    far = least != np.arange(len(ids))
    return ids[far], ids[least[far]]


def links(fps: DataFrame) -> DataFrame:
    """(fp) -> (a, b): links between ids, enough to connect all that reach one another."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys, checks = index_rows(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, BITS // 8))
                columns = [keys, *checks.view("<i8").T]
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], names=["key", "c1", "c2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(rows: np.ndarray) -> pa.RecordBatch:
            found = solved(rows[0], np.ascontiguousarray(rows[1:].T).view("<u8"))
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

        held, n, enough = [], 0, SOLVED
        for batch in batches:
            held.append(np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]))
            n += batch.num_rows
            if n >= enough:
                rows = np.concatenate(held, axis=1)
                last = int(np.searchsorted(rows[0], rows[0, -1] >> HALF << HALF))
                if last:
                    yield made(rows[:, :last])
                held, n = [rows[:, last:].copy()], rows.shape[1] - last
                enough = max(SOLVED, 2 * n)  # a group that goes on is not put together again for each batch
        if n:
            yield made(np.concatenate(held, axis=1))
        give_back()

    rows = fps.mapInArrow(index, "key long, c1 long, c2 long")
    return rows.repartition(F.shiftright("key", HALF)).sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def clusters(nodes: DataFrame) -> DataFrame:
    """(node, id, fp) -> (key, head, node): the members of each cluster of two or more."""
    roots = connected_components(links(nodes.select("fp").distinct())).select(F.col("node").alias("id"), "root")
    # stored, so that the join of one very large cluster can be split
    placed = stored(nodes.select("node", "id").join(roots, "id", "left").select(F.coalesce("root", "id").alias("key"), "node"), "near-dedup-ids")
    heads = stored(placed.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1").select("key", "head"), "near-dedup-heads")
    return placed.join(heads, "key").select("key", "head", "node")


def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(key, values) of each key, from (key, value) rows in order of keys."""
    key, held = None, []
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False)
        values = batch.column(1)
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True]))) if len(keys) else [0]
        for a, b in zip(edge, edge[1:]):
            if keys[a] != key:
                if held:
                    yield key, held
                key, held = keys[a], []
            held.append(values.slice(a, b - a))
    if held:
        yield key, held


def similar(own: np.ndarray, other: np.ndarray, least: float) -> bool:
    if min(len(own), len(other)) < least * max(len(own), len(other)) - 1e-9:
        return False
    shared = len(np.intersect1d(own, other, assume_unique=True))
    return shared >= least * (len(own) + len(other) - shared) - 1e-9


def head_links(members: DataFrame, texts: DataFrame, least: float, shingle: int) -> DataFrame:
    """(key, head, node) and (node, text) -> (a, b): members linked to the head of their cluster."""
    pairs = members.where("node != head").select("head", "node").distinct()
    of_node = pairs.join(texts, "node").withColumnRenamed("text", "own")
    both = of_node.join(texts.select(F.col("node").alias("head"), "text"), "head").select("head", "node", "text", "own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            found = []
            for head, node, text, other in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), *(c.cast(pa.binary()) for c in batch.columns[2:])):
                if head != at:  # pairs come in the order of heads
                    at, own = head, shingles(words_of(text.as_py()), shingle)
                if similar(own, shingles(words_of(other.as_py()), shingle), least):
                    found.append((head, node))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])
            give_back()

    return both.mapInArrow(run, "a long, b long")


def across(small: list[tuple[int, np.ndarray]], rest: list[tuple[int, np.ndarray]], least: float) -> set[tuple[int, int]]:
    """(root, root) of the pairs of one block, each (root, set), with a link between different roots."""
    sets = [s for _, s in (*small, *rest)]
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    sizes = np.array([len(s) for s in sets])
    begin = np.cumsum(sizes) - sizes
    roots = np.array([r for r, _ in (*small, *rest)], np.int64)
    mark, out = np.zeros(int(ids.max()) + 1, np.int64), set()
    for i in range(len(small)):
        own = ids[begin[i] : begin[i] + sizes[i]]
        mark[own] = 1
        shared = np.add.reduceat(mark[ids], begin)
        mark[own] = 0
        hit = (shared >= least * (sizes[i] + sizes - shared) - 1e-9) & (roots != roots[i])
        out |= {(int(roots[i]), int(r)) for r in np.unique(roots[hit])}
    return out


def rest_links(members: DataFrame, roots: DataFrame, texts: DataFrame, least: float, shingle: int, block: int) -> DataFrame:
    """(a, b): roots that links within clusters join.  ``roots``: (node, root) of the nodes that are not their own."""
    placed = members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    placed = stored(placed, "near-dedup-placed")
    # partial counts, so that a cluster of very many texts is no task of its own
    open_keys = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high").select("key")
    open_keys = stored(open_keys, "near-dedup-open")
    counts = placed.join(open_keys, "key").groupBy("key", "root").agg(F.count("*").alias("n"))
    sizes = counts.groupBy("key").agg(F.max(F.struct("n", "root")).alias("big"), F.sum("n").alias("all")).select("key", F.col("big.root").alias("big"), F.ceil(F.col("all") / block).cast("int").alias("all_parts"), F.ceil((F.col("all") - F.col("big.n")) / block).cast("int").alias("small_parts"))
    sizes = stored(sizes, "near-dedup-sizes")
    rows = placed.join(sizes, "key").join(texts, "node")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    own = F.struct("root", "text").alias("own")
    every = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("small_parts") - 1))).select("key", "i", part("all_parts").alias("j"), F.lit(False).alias("is_small"), own)
    small = rows.where("root != big").withColumn("j", F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1))).select("key", part("small_parts").alias("i"), "j", F.lit(True).alias("is_small"), own)
    blocks = every.union(small).select(F.xxhash64("key", "i", "j").alias("block"), F.struct("is_small", "own").alias("own"))
    blocks = blocks.repartition("block").sortWithinPartitions("block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in groups(batches):
            sides: dict[bool, list[tuple[int, np.ndarray]]] = {True: [], False: []}
            for part in held:
                for is_small, row in zip(part.field(0).to_pylist(), part.field(1)):
                    sides[is_small].append((row["root"].as_py(), shingles(words_of(row["text"].cast(pa.binary()).as_py()), shingle)))
            found = sorted(across(sides[True], sides[False], least)) if sides[True] and sides[False] else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], names=["a", "b"])

    return blocks.mapInArrow(run, "a long, b long")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, block: int = BLOCK_TEXTS) -> DataFrame:
    """One row of each component, the one with the smallest id (of repeated rows, one); the columns of ``docs``.

    Rows with a null id are kept only where no row of their component has an id.
    """
    node_col, key_col, fp_col, row_col = fresh(docs, "node", "fp_id", "fingerprint", "row_number")
    marked = with_fingerprints(docs, text_col, node_col, key_col, fp_col, shingle).withColumn(row_col, F.monotonically_increasing_id())
    marked = stored(marked, "near-dedup")
    slim = marked.select(F.col(row_col).alias("row"), F.col(id_col).alias("id"), F.col(node_col).alias("node"))
    nodes = slim.groupBy("node").agg(F.min("id").alias("least"), F.min("row").alias("row"))
    nodes = stored(nodes, "near-dedup-nodes")
    heads = nodes.select(F.col("row").alias(row_col))
    distinct = stored(marked.join(heads, row_col, "left_semi").select(F.col(node_col).alias("node"), F.col(key_col).alias("id"), F.col(fp_col).alias("fp")), "near-dedup-fingerprints")
    members = stored(clusters(distinct), "near-dedup-clusters")
    needed = members.select("node").distinct().join(nodes, "node").select("node", F.col("row").alias(row_col))
    texts = stored(marked.select(row_col, F.col(text_col).alias("text")).join(needed, row_col).select("node", "text"), "near-dedup-texts")
    first = stored(connected_components(head_links(members, texts, least, shingle)), "near-dedup-roots")
    # joins of what the heads' links have made one already
    second = connected_components(rest_links(members, first, texts, least, shingle, block)).select(F.col("node").alias("of"), F.col("root").alias("last"))
    placed = nodes.join(first.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left").select("node", F.coalesce("root", "node").alias("root"), "least")
    placed = placed.join(second, F.col("root") == F.col("of"), "left").select("node", F.coalesce("last", "root").alias("root"), "least")
    placed = stored(placed, "near-dedup-placed")
    named = stored(placed.groupBy("root").agg(F.min("least").alias("component")), "near-dedup-names")
    of = stored(placed.join(named, "root").select("node", "root", "component"), "near-dedup-components")
    kept = slim.join(of, "node").where(F.col("id").eqNullSafe(F.col("component"))).groupBy("root").agg(F.min("row").alias("row"))
    return marked.join(kept.select(F.col("row").alias(row_col)), row_col, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
