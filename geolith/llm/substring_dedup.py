"""Repeated passages, found by fixed-block anchors.

A window is ``window`` consecutive words of one document.  Every word that some window covers whose word sequence
also starts anywhere else (the same document included) is removed; windows are judged on the input.

1. *Anchors.*  With blocks of ``(window + 1) // 2`` words, the non-overlapping blocks of each document are the
   index, and every rolling block of every document probes it.  Any window holds a whole block of the index, so of
   two equal windows each has a rolling block that hits the other's (or its own) indexed block.
2. *Extension.*  Around each hit the windows that hold it are compared with all other windows around hits, by 128
   bits of two digests over two hashes of each word that have nothing in common; those found twice are repeats, and
   their union is every maximal exact repeat of ``window`` words or more.

A word's hash takes its bytes eight at a time, each mixed before the next, and its length: words that differ have
unlike hashes whatever their length, which sums of powers do not give.

Neither step ships a row for each word.  Documents are dealt into chunks; a chunk sends each hash range one sorted,
de-duplicated and delta-coded list of keys, and gets back one bit for each key.  A key is in a list at most once
however often the chunk repeats it, so a passage that a third of all rows share loads no task more than another.
Chunks and ranges come from the bytes of all texts (``chunk_bytes``, ``range_bytes``), with one for each of the
shuffle's partitions at least.  A range gets a list from each chunk, so tables of many terabytes want larger ones.
Rows are dealt by id and text; where rows with an equal id and text make up more than a few chunks, the table is stored
with a number for each row and dealt by that too.  Lost executors only cause parts of the plan to run again: every step
depends on nothing but its input rows.

Words are runs of bytes other than 0x20 and 0x09-0x0D.  Null, empty and blank texts have no words and stay as they
are, in no chunk.  Texts shorter than a window lose nothing.  A very long text is one row of one chunk.  Repeated rows
are documents like any others, so their windows repeat.  Other columns, whatever their names, are fields of ``row``.
An empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, give_back, modest_batches, partitions, stored

P, Q1, Q2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xC2B2AE3D27D4EB4F))
#: Bytes that are hashed together, unless one text is longer.
BLOCK_BYTES = 1 << 20
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
#: Masks of the lowest bytes of eight, by their number.
LOW_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Words of more bytes are hashed one by one.
LONG = 64
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0 ... base ** (n - 1), modulo 2 ** 64."""
    at = int(base)
    if at not in _powers or len(_powers[at]) < n:
        x = np.full(max(n, 1 << 16), base, np.uint64)
        x[0] = 1
        _powers[at] = np.cumprod(x, dtype=np.uint64)
    return _powers[at][:n]


def inverse(base: np.uint64) -> np.uint64:
    return np.uint64(pow(int(base), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(values: np.ndarray, width: int, base: np.uint64) -> np.ndarray:
    """A hash of each ``width`` consecutive values."""
    n = len(values)
    if n < width:
        return np.empty(0, np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(inverse(base), n - width + 1))


def hashed_words(texts: list[bytes], seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each text)."""
    hashes, counts = [], []
    k = 0
    while k < len(texts):
        part, used = [], 0
        while k < len(texts) and (not part or used + len(texts[k]) < BLOCK_BYTES):
            part.append(texts[k])
            used += len(texts[k]) + 1
            k += 1
        joined = b" ".join(part) + b" "
        raw = np.frombuffer(joined, np.uint8)
        space = IS_SPACE[raw]
        turn = np.flatnonzero(np.diff(space.view(np.int8), prepend=1))  # starts and ends of words, in turn
        starts, ends = turn[0::2], turn[1::2]
        hashes.append(word_hashes(joined, starts, ends - starts, seed))
        bounds = np.cumsum([0, *[len(t) + 1 for t in part]])
        counts.append(np.diff(np.searchsorted(starts, bounds)))
    if not hashes:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


def word_hashes(joined: bytes, starts: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Eight bytes of every word at a time; words over LONG bytes by XXH3."""
    padded = joined + b"\0" * 8
    eights = np.ndarray(len(joined) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    out = mix(size.astype(np.uint64) * Q1 + np.uint64((seed * 2 + 1) * int(P) % (1 << 64)))
    own, at, left = np.arange(len(starts)), starts, size
    while len(own):
        part = eights[at] & LOW_BYTES[np.minimum(left, 8)]
        out[own] = mix(out[own] ^ part) * Q2
        more = (left > 8) & (size[own] <= LONG)
        own, at, left = own[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG).tolist():
        out[k] = xxhash.xxh3_64_intdigest(joined[starts[k] : starts[k] + size[k]], seed)
    return out


def packed(keys: np.ndarray) -> bytes:
    """Sorted keys as a first key and steps of four bytes, or eight where one needs them."""
    steps = np.diff(keys)
    wide = len(steps) and steps.max() >> np.uint64(32)
    return (b"8" if wide else b"4") + keys[:1].tobytes() + steps.astype("<u8" if wide else "<u4").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    steps = np.frombuffer(raw, "<u8" if raw[:1] == b"8" else "<u4", offset=9)
    out = np.empty(len(steps) + 1, np.uint64)
    out[0] = np.frombuffer(raw, "<u8", 1, 1)[0]
    out[1:] = steps
    return np.cumsum(out, dtype=np.uint64)


class Chunk:
    """The words of a chunk's documents, and what the two steps send and get back."""

    def __init__(self, texts: list[bytes | None], window: int, buckets: int):
        self.window, self.block, self.buckets = window, (window + 1) // 2, buckets
        self.texts = texts
        self.words, self.counts = hashed_words([x or b"" for x in texts])
        self.more = self.twice = None
        self.ends = np.cumsum(self.counts)
        self.first = self.ends - self.counts

    def fits(self, width: int) -> np.ndarray:
        """The starts of ``width`` words of one document."""
        out = np.zeros(len(self.words), bool)
        for a, b in zip(self.first, self.ends - width + 1):
            out[a : max(a, b)] = True
        return np.flatnonzero(out)

    def probes(self) -> None:
        """Keys of all rolling blocks: 46 bits of hash, then whether the chunk has it twice and as an indexed block.

        So few bits keep the steps between a chunk's keys within four bytes; a chance hit is only one more candidate.
        """
        self.at = self.fits(self.block)
        key = rolled(self.words, self.block, Q1)[self.at] >> np.uint64(18) << np.uint64(2)
        own = np.repeat(self.first, self.counts)[self.at]
        anchor = (self.at - own) % self.block == 0
        order = np.argsort(key)
        key, anchor = key[order], anchor[order]
        new = np.flatnonzero(np.diff(key, prepend=~key[:1]) != 0) if len(key) else np.empty(0, np.int64)
        self.order, self.new, self.size = order, new, np.diff(np.append(new, len(key)))
        flags = (self.size > 1).astype(np.uint64) * np.uint64(2) + (np.logical_or.reduceat(anchor, new) if len(new) else anchor).astype(np.uint64)
        self.keys = key[new] | flags

    def candidates(self, hit: np.ndarray) -> None:
        """Keys of the windows around hits (``hit``: of self.keys), with 64 more bits and whether the chunk has it twice."""
        flag = np.zeros(len(self.words) + 1, np.int64)
        flag[self.at[self.order[np.repeat(hit, self.size)]]] = 1
        seen = np.concatenate(([0], np.cumsum(flag)))
        at = self.fits(self.window)
        self.at = at[seen[at + self.window - self.block + 1] > seen[at]]
        key = more = np.empty(0, np.uint64)
        if len(self.at):
            key = rolled(self.words, self.window, Q1)[self.at]
            more = rolled(hashed_words([x or b"" for x in self.texts], 1)[0], self.window, Q2)[self.at]
        self.order = np.lexsort((more, key))
        key, more = key[self.order], more[self.order]
        differs = np.ones(len(key), bool)
        differs[1:] = (key[1:] != key[:-1]) | (more[1:] != more[:-1])
        self.new = np.flatnonzero(differs)
        self.size = np.diff(np.append(self.new, len(key)))
        self.keys, self.more, self.twice = key[self.new], more[self.new], self.size > 1

    def cuts(self) -> np.ndarray:
        """Where in self.keys each range of keys begins; a last entry for the end."""
        bits = 48 if self.more is None else 64
        width = -(-(1 << bits - 2) // self.buckets) << 2  # the two flags of a block's key decide nothing here
        lows = np.array([min(k * width, (1 << 64) - 1) for k in range(self.buckets)], np.uint64)
        return np.append(np.searchsorted(self.keys, lows), len(self.keys))

    def hits(self, replies: dict[int, bytes]) -> np.ndarray:
        out, cuts = np.zeros(len(self.keys), bool), self.cuts()
        for k, raw in replies.items():
            n = cuts[k + 1] - cuts[k]
            out[cuts[k] : cuts[k + 1]] = np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)
        return out

    def covered(self, repeated: np.ndarray) -> np.ndarray:
        """For each word, whether a repeated window covers it."""
        step = np.zeros(len(self.words) + 1, np.int64)
        at = self.at[self.order[np.repeat(repeated, self.size)]]
        step[at] += 1
        step[at + self.window] -= 1  # windows that end at one place start at one place
        return np.cumsum(step)[:-1] > 0


SENT = "bucket int, chunk int, keys binary, extra binary"
REPLY = "chunk int, step int, bucket int, bits binary"


def arrow(rows: list[tuple], schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "binary": pa.binary()}
    fields = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, fields)], schema=pa.schema(fields))


def without(raw: bytes, gone: np.ndarray) -> bytes:
    """``raw`` less each run of words that are gone, up to the next kept word."""
    out, since = [], 0
    for m, cut in zip(WORD.finditer(raw), gone.tolist()):
        if cut and since is not None:
            out.append(raw[since : m.start()])
            since = None
        elif not cut and since is None:
            since = m.start()
    return b"".join(out if since is None else [*out, raw[since:]])


def first_replies(table: pa.Table) -> pa.Table:
    """Of one range of block keys: those found twice or more and indexed somewhere."""
    chunks, lists = table.column("chunk").to_pylist(), [unpacked(x) for x in table.column("keys").to_pylist()]
    keys = np.concatenate(lists)
    order = np.argsort(keys)
    low = np.uint64(3)
    bare, flag = keys[order] >> np.uint64(2), keys[order] & low
    new = np.flatnonzero(np.diff(bare, prepend=~bare[:1]) != 0)
    size = np.diff(np.append(new, len(bare)))
    flags = np.bitwise_or.reduceat(flag, new)
    good = ((size > 1) | (flags >> np.uint64(1) > 0)) & (flags & np.uint64(1) > 0)
    return answered(table, chunks, lists, order, np.repeat(good, size), 1)


def second_replies(table: pa.Table) -> pa.Table:
    """Of one range of window keys: those found twice or more."""
    chunks, lists = table.column("chunk").to_pylist(), [unpacked(x) for x in table.column("keys").to_pylist()]
    extra = table.column("extra").to_pylist()
    keys = np.concatenate(lists)
    more = np.concatenate([np.frombuffer(x, "<u8", len(k)) for x, k in zip(extra, lists)])
    twice = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8, offset=8 * len(k)), count=len(k)) for x, k in zip(extra, lists)])
    order = np.lexsort((more, keys))
    k, m = keys[order], more[order]
    differs = np.ones(len(k), bool)
    differs[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
    new = np.flatnonzero(differs)
    size = np.diff(np.append(new, len(k)))
    good = (size > 1) | (np.maximum.reduceat(twice[order], new) > 0)
    return answered(table, chunks, lists, order, np.repeat(good, size), 2)


def answered(table: pa.Table, chunks: list, lists: list, order: np.ndarray, good: np.ndarray, step: int) -> pa.Table:
    mask = np.empty(len(order), bool)
    mask[order] = good
    give_back()
    bucket = table.column("bucket")[0].as_py()
    parts = np.split(mask, np.cumsum([len(x) for x in lists])[:-1])
    return arrow([(c, step, bucket, np.packbits(m).tobytes()) for c, m in zip(chunks, parts) if m.any()], REPLY)


def replies_of(table: pa.Table, step: int) -> dict[int, bytes]:
    return {b: x for s, b, x in zip(*(table.column(c).to_pylist() for c in ("step", "bucket", "bits"))) if s == step}


#: Cells that the bytes of texts are summed up in, to see whether rows with an equal id and text are very many.
CELLS = 4096


def dealt(docs: DataFrame, text_col: str, id_col: str, floor: int, chunk_bytes: int, range_bytes: int) -> tuple[DataFrame, Column, int, int]:
    """(the table, the number that deals each row, chunks, ranges of hashes)."""
    spread = F.xxhash64(F.col(id_col), F.col(text_col))
    size = F.octet_length(F.col(text_col))
    cells = docs.select(F.pmod(spread, F.lit(CELLS)).alias("cell"), size.cast("long").alias("size")).groupBy("cell").agg(F.sum("size").alias("all"), F.max("size").alias("most")).where("all is not null").collect()
    total = sum(r["all"] for r in cells)
    chunks, ranges = max(floor, -(-total // chunk_bytes)), max(partitions(docs.sparkSession), -(-total // range_bytes))
    if any(r["all"] - r["most"] > 4 * max(chunk_bytes, total / CELLS) for r in cells):
        (row,) = fresh(docs, "row_number")
        docs = stored(docs.withColumn(row, F.monotonically_increasing_id()), "substring-rows")
        spread = F.xxhash64(F.col(id_col), F.col(text_col), F.col(row))
    return docs, spread, chunks, ranges


def remove_repeats(
    docs: DataFrame,
    text_col: str = "text",
    id_col: str = "doc_id",
    window: int = 35,
    chunks_per_partition: int = 1,
    chunk_bytes: int = 6 << 20,
    range_bytes: int = 64 << 20,
) -> DataFrame:
    """(row, n_words, n_removed, kept_words, kept_text): ``row`` is the input row as a struct.

    ``kept_words`` is the kept words joined by one space (null where the text is null); ``kept_text`` is the text
    with each removed run of words cut out, up to the next kept word, and the text itself where nothing is removed.
    """
    spark = docs.sparkSession
    modest_batches(spark)
    columns = docs.columns
    docs, spread, n_chunks, buckets = dealt(docs, text_col, id_col, chunks_per_partition * partitions(spark), chunk_bytes, range_bytes)
    rows = docs.select(F.pmod(spread, F.lit(n_chunks)).cast("int").alias("chunk"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    at = columns.index(text_col)
    text = F.col("row").getField(text_col)
    wordless = F.coalesce(~text.rlike(r"[^\x20\x09-\x0D]"), F.lit(True))
    bare = rows.where(wordless).select("row", F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_removed"), F.when(text.isNotNull(), F.lit("")).alias("kept_words"), text.alias("kept_text"))
    rows = rows.where(~wordless)

    def texts(table: pa.Table) -> list[bytes | None]:
        return pa.chunked_array([x.field(at) for x in table.column("row").chunks], pa.string()).cast(pa.binary()).to_pylist()

    def sent(chunk: int, c: Chunk) -> pa.Table:
        cuts, out = c.cuts(), []
        for k in np.flatnonzero(np.diff(cuts)):
            a, b = cuts[k], cuts[k + 1]
            extra = c.more[a:b].astype("<u8").tobytes() + np.packbits(c.twice[a:b]).tobytes() if c.more is not None else None
            out.append((int(k), chunk, packed(c.keys[a:b]), extra))
        give_back()
        return arrow(out, SENT)

    def probe(key: tuple, table: pa.Table) -> pa.Table:
        c = Chunk(texts(table), window, buckets)
        c.probes()
        return sent(key[0].as_py(), c)

    def extend(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        if not table.num_rows or not replies.num_rows:
            return arrow([], SENT)
        c = Chunk(texts(table), window, buckets)
        c.probes()
        c.candidates(c.hits(replies_of(replies, 1)))
        return sent(key[0].as_py(), c)

    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_words", T.StringType()), T.StructField("kept_text", T.StringType())])

    def cut(key: tuple, table: pa.Table, replies: pa.Table) -> pa.Table:
        own_texts = texts(table)
        c = Chunk(own_texts, window, buckets)
        gone = None
        if replies.num_rows:
            c.probes()
            c.candidates(c.hits(replies_of(replies, 1)))
            gone = c.covered(c.hits(replies_of(replies, 2)))
        counts, c.words, c.texts = c.counts, None, None
        give_back()
        removed, words, whole = [], [], []
        for raw, a, b in zip(own_texts, c.first.tolist(), c.ends.tolist()):
            own = gone[a:b] if gone is not None else None
            n = int(own.sum()) if own is not None else 0
            removed.append(n)
            if raw is None:
                words.append(None)
                whole.append(None)
            elif not n:
                words.append(b" ".join(raw.split()))
                whole.append(raw)
            else:
                words.append(b" ".join(w for w, x in zip(raw.split(), own.tolist()) if not x))
                whole.append(without(raw, own))
        return pa.table([table.column("row"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(words, pa.binary()).cast(pa.string()), pa.array(whole, pa.binary()).cast(pa.string())], names=["row", "n_words", "n_removed", "kept_words", "kept_text"])

    first = rows.groupBy("chunk").applyInArrow(probe, SENT).groupBy("bucket").applyInArrow(first_replies, REPLY)
    second = rows.groupBy("chunk").cogroup(first.groupBy("chunk")).applyInArrow(extend, SENT).groupBy("bucket").applyInArrow(second_replies, REPLY)
    return rows.groupBy("chunk").cogroup(first.unionByName(second).groupBy("chunk")).applyInArrow(cut, schema).union(bare)


def query(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_removed, kept_sha256."""
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2(F.coalesce("kept_words", F.lit("")), 256).alias("kept_sha256"))
