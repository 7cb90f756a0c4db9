"""Pieces shared by the corpus operators: work tables, word expressions, connected components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.work import deleted, stored, stored_at

LIBC = ctypes.CDLL(None)

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Separators between alphanumeric words, once A-Z are lower case: all of ASCII but 0-9 and a-z.
ALNUM_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Separators between words of visible characters.
SPACE_SEPARATORS = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, all else as it is."""
    return F.translate(c, UPPER, LOWER)


def split_words(c: Column, separators: str) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(c, F.lit("")), separators), "")


def alnum_words(c: Column) -> Column:
    return split_words(ascii_lower(c), ALNUM_SEPARATORS)


def space_words(c: Column) -> Column:
    return split_words(c, SPACE_SEPARATORS)


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names like ``stems`` that ``df`` has no column of, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name, k = stem, 0
        while name.lower() in taken:
            k += 1
            name = f"{stem}_{k}"
        taken.add(name.lower())
        out.append(name)
    return out


def modest_batches(spark: SparkSession, rows: int = 1000, size: int = 16 << 20) -> None:
    """At most so many rows, and about so many bytes, in an Arrow batch: rows of text are long, and both sides of the
    pipe hold whole batches.  A longer row is a batch of its own.  The settings are the session's, as plans have none."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = int(spark.conf.get(key).rstrip("b"))  # with a default, get would not see the engine's own
        if not 0 < now <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Memory that a Python worker holds but does not use, returned to the system: workers live on between tasks."""
    pa.default_memory_pool().release_unused()
    if (trim := getattr(LIBC, "malloc_trim", None)) is not None:  # glibc has it
        trim(0)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) of any one ordered type -> (node, root): the smallest node that each node reaches.

    Alternating large-star and small-star steps until nothing changes; links move to ever smaller nodes, so that comes.
    Each step is a partial minimum per node and an equality join.  The minima are stored before they are joined: both
    sides of the join are then plain shuffles, which adaptive execution can split where a node has very many links.
    Tables of earlier rounds are deleted.  Self loops give a node that is its own root; null ends are dropped; an
    empty input gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.select("a", "b").where("a is not null and b is not null")
    now = stored(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "components")
    nodes = now.select(F.col("a").alias("node")).union(now.select("b")).distinct()
    links, old = now.where("a > b"), []

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    def kept(df: DataFrame, made: list[str]) -> DataFrame:
        out, path = stored_at(df, "components")
        made.append(path)
        return out

    before = state(links)
    while before[0]:
        made: list[str] = []
        # large star: every larger neighbour of u moves to u's smallest neighbour
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = kept(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), made)
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = kept(large.distinct(), made)
        # small star: the smaller neighbours of u, and u, move to the smallest of them
        least = kept(large.groupBy("a").agg(F.min("b").alias("m")), made)
        small = large.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = kept(small.union(least.select("a", F.col("m").alias("b"))).distinct(), made)
        after = state(links)
        for path in [*old, *made[:-1]]:
            deleted(spark, path)
        old = made[-1:]
        if after == before:
            break
        before = after
    roots = links.groupBy("a").agg(F.min("b").alias("root"))
    return nodes.join(roots, nodes["node"] == roots["a"], "left").select("node", F.coalesce("root", "node").alias("root"))
