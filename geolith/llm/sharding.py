"""Minimax contiguous partition of a corpus into shards, by DataFrame operations only.

Documents with equal texts are one atomic group; groups stand in the order of their texts' SHA-256.  The smallest
capacity for which a greedy fill needs no more shards than there are is found by binary search, and the order is cut
there: cuts keep every shard within that capacity and, within it, as near as they can to equal shares of what is left.

The sizes of the groups stay on the cluster, as running totals.  The driver knows a bounded set of those totals: the
ends of ``16 ** digits`` hash ranges, and then, wherever a decision falls between two known totals, up to ``cells``
more from there.  It decides again until every decision at the capacity found, and at one byte less, rests on totals
with none unknown between them; the result is then that of the whole list.

Rows are numbered in cells: a hash range of one shard, cut by a hash of id and text into as many salts as the largest
group needs for cells of about ``cell_rows`` rows.

Null texts are a group of their own, sizes as of an empty text.  A document's size is its UTF-8 bytes plus
``overhead``; a very long text is one row.  With fewer groups than shards some shards stay empty.  Repeated rows are
documents of their own, in one cell where their ids are equal too.  Other columns, whatever their names, are left out.
An empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stored


class Totals:
    """Running totals that are known, and which neighbours have none unknown between them."""

    def __init__(self, known: list[int], whole: set[int] | None = None):
        self.known = sorted({0, *known})
        self.whole = whole if whole is not None else set()  # upper ends of gaps with nothing unknown inside
        self.open: set[int] = set()  # upper ends of the others that decisions fell into

    @property
    def all(self) -> int:
        return self.known[-1]

    def below(self, v: int) -> int:
        """The largest known total of at most v."""
        k = bisect_right(self.known, v)
        if k < len(self.known) and self.known[k - 1] != v and self.known[k] not in self.whole:
            self.open.add(self.known[k])
        return self.known[k - 1]

    def above(self, v: int) -> int:
        """The smallest known total of at least v."""
        k = bisect_left(self.known, v)
        if k == len(self.known):
            return self.all
        if self.known[k] != v and self.known[k] not in self.whole:
            self.open.add(self.known[k])
        return self.known[k]

    def fits(self, capacity: int, shards: int) -> bool:
        at = 0
        for _ in range(shards):
            if at == self.all:
                break
            at = self.below(at + capacity)
        return at == self.all

    def capacity(self, shards: int) -> int:
        low, high = -(-self.all // shards), self.all
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.fits(mid, shards) else (mid + 1, high)
        return low

    def cuts(self, capacity: int, shards: int) -> list[int]:
        """Where shards 0 to shards - 2 end."""
        least, at = [], self.all  # from each of these on, the later shards hold the rest
        for _ in range(shards - 1):
            at = self.above(max(0, at - capacity))
            least.append(at)
        out, at = [], 0
        for k, floor in zip(range(shards, 1, -1), reversed(least)):
            ideal = at + -(-(self.all - at) // k)
            low, high = self.below(ideal), self.above(ideal)
            most = self.below(at + capacity)
            to = high if high - ideal < ideal - low else low
            at = max(at, min(most, max(floor, to)))
            out.append(at)
        return out


def decide(groups: DataFrame, known: list[int], shards: int, cells: int = 512) -> tuple[int, list[int]]:
    """(capacity, cuts) over the totals in column ``total`` of ``groups``."""
    t = Totals(known)
    if not t.all:
        return 0, [0] * (shards - 1)
    while True:  # every round learns a total, or that there is none between two
        capacity = t.capacity(shards)
        t.open = set()
        t.fits(capacity, shards)
        t.fits(capacity - 1, shards)
        cuts = t.cuts(capacity, shards)
        if not t.open:
            return capacity, cuts
        gaps = sorted((t.known[bisect_left(t.known, top) - 1], top) for top in t.open)
        width = max(2, cells * shards // len(gaps))
        at = F.col("total")
        which: Column = F.lit(None).cast("int")
        cell: Column = F.lit(None).cast("long")
        inside = F.lit(False)
        for k, (low, top) in enumerate(gaps):
            here = (at > low) & (at <= top)
            step = max(1, -(-(top - low) // width))
            inside = inside | here
            which = F.when(here, F.lit(k)).otherwise(which)
            cell = F.when(here, F.floor((at - low - 1) / step)).otherwise(cell)
        rows = groups.where(inside).select(which.alias("gap"), cell.alias("cell"), "total").groupBy("gap", "cell").agg(F.min("total").alias("first"), F.max("total").alias("top"), F.count("*").alias("n")).collect()
        # nothing lies between a cell's first total and the last of the cell before
        whole = {*[r["first"] for r in rows], *[r["top"] for r in rows if r["n"] <= 2]}
        t = Totals([*t.known, *[r["first"] for r in rows], *[r["top"] for r in rows]], t.whole | whole)


def assigned(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, digits: int = 3, cell_rows: int = 50_000) -> DataFrame:
    """``docs``' other columns are dropped: (id, size, text_crc32, shard, slot), a row for each row.

    Slots count from 0 in each shard, with none left out.  A document's place comes from its hash range and a salt.
    """
    text = F.col(text_col)
    key = F.coalesce(F.sha2(text, 256), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("key"),
    )
    rows = stored(rows, "sharding-rows")
    span = F.coalesce(F.conv(F.nullif(F.substring("key", 1, digits), F.lit("")), 16, 10).cast("int"), F.lit(0))
    groups = rows.groupBy("key").agg(F.sum("size").alias("size"), F.count("*").alias("n")).withColumn("span", span)
    groups = stored(groups, "sharding-groups")
    spans = groups.groupBy("span").agg(F.sum("size").alias("size"), F.max("n").alias("n")).collect()  # 16 ** digits at most
    sums = {r["span"]: r["size"] for r in spans}
    salts = max(32, -(-max((r["n"] for r in spans), default=0) // cell_rows))
    before, so_far = {}, 0
    for s in sorted(sums):
        before[s] = so_far
        so_far += sums[s]
    spark = docs.sparkSession
    offsets = spark.createDataFrame(list(before.items()), "span int, offset long")
    totals = groups.join(F.broadcast(offsets), "span").withColumn("total", F.col("offset") + F.sum("size").over(W.partitionBy("span").orderBy("key")))
    totals = stored(totals.select("key", "total"), "sharding-totals")
    _, cuts = decide(totals, [before[s] + sums[s] for s in before], shards)
    ends = {r["total"]: r["key"] for r in totals.where(F.col("total").isin(sorted(set(cuts)))).collect()} if cuts else {}
    # the last key of each shard but the last; a shard that ends at 0 has none
    last = [ends.get(c) for c in cuts]
    shard = F.lit(0)
    for k in last:
        shard = shard + (F.lit(1) if k is None else F.when(F.col("key") > k, 1).otherwise(0))
    placed = rows.withColumn("shard", shard).withColumn("span", span).withColumn("salt", F.pmod(F.xxhash64("id", "text_crc32"), F.lit(salts)).cast("int"))
    cells = placed.groupBy("shard", "span", "salt").count()
    first = F.sum("count").over(W.partitionBy("shard").orderBy("span", "salt")) - F.col("count")
    cells = cells.select("shard", "span", "salt", first.alias("first"))
    within = F.row_number().over(W.partitionBy("shard", "span", "salt").orderBy("id", "key"))
    # the rows lie by cell already, so only the cells' counts move for this join
    numbered = placed.withColumn("within", within).join(cells, ["shard", "span", "salt"])
    return numbered.select(F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("first") + F.col("within") - 1).cast("long").alias("slot"))


def query(docs: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    out = assigned(docs.select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
