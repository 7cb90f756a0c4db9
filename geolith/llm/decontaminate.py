"""Benchmark decontamination: test n-grams found in training texts, by DataFrame operations only.

Words are lower-cased (A-Z) runs of 0-9, a-z and non-ASCII characters.  A window is ``n`` consecutive words of a
test item; an item of fewer words, but not none, is one window.  The hash set of all windows is broadcast if it
takes at most ``broadcast_limit`` bytes, and joined by a shuffle otherwise.  Every window of every training text
is looked up by its 64-bit hash, and a hit is verified on the words themselves.

All window sizes (items of fewer than ``n`` words have their own) are looked up in one pass over the texts.

Null, empty and wordless texts have no words and no hits.  Items with a null id or no words have no windows;
repeated items count once.  Repeated rows each get a row; they share one row of hits.  A very long text is one row's
array of words, its windows are rows of their own.  Other columns stay, whatever their names: what is added for the
join takes names that are free.  An empty table, on either side, gives no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import alnum_words, bind, fresh, split_words, stored

#: ALNUM_SEPARATORS for texts whose A-Z are still there.
RAW_SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RAW_WORDS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def windows(words: Column, n: int) -> Column:
    """Every (pos, size, gram) of ``n`` words in order."""
    at = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("size"), F.concat_ws(" ", F.slice(words, i + 1, n)).alias("gram")))


def test_windows(benchmark: DataFrame, n: int, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(h, gram, n_gram, items): the distinct windows and the ids (as strings) of the items that have each."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), alnum_words(F.col(text_col)).alias("w")).where("item is not null and size(w) > 0")
    size = F.least(F.size("w"), F.lit(n))
    grams = F.transform(F.sequence(F.lit(0), F.size("w") - size), lambda i: F.concat_ws(" ", F.slice("w", i + 1, size)))
    flat = items.select("item", size.alias("n_gram"), F.explode(grams).alias("gram"))
    return flat.groupBy("gram", "n_gram").agg(F.array_sort(F.collect_set("item")).alias("items")).withColumn("h", F.xxhash64("gram"))


def hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 8, broadcast_limit: int = 64 << 20) -> DataFrame:
    """(id, th, places, items) of each distinct row of ``docs`` with hits: th is the text's hash, places the words hit."""
    grams = stored(test_windows(benchmark, n), "test-windows")
    # hash, words and pointers of a window, and 20 bytes for each of its items
    size = grams.agg(F.coalesce(F.sum(64 + F.octet_length("gram") + 20 * F.size("items")), F.lit(0))).first()[0]
    small = size <= broadcast_limit
    sizes = [r[0] for r in grams.select("n_gram").distinct().collect()]  # n values at most
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), alnum_words(F.col(text_col)).alias("w"))
    if not sizes:
        return own.select("id", "th", F.array().cast("array<int>").alias("places"), F.array().cast("array<string>").alias("items")).limit(0)
    every = [windows(F.col("w"), k) for k in sorted(sizes)]
    probes = own.select("id", "th", F.explode(F.concat(*every) if len(every) > 1 else every[0]).alias("x"))
    probes = probes.select("id", "th", F.xxhash64("x.gram").alias("h"), F.col("x.pos").alias("pos"), F.col("x.size").alias("size"), F.col("x.gram").alias("gram"))
    test = grams.select("h", F.col("gram").alias("test_gram"), "items")
    found = probes.join(F.broadcast(test) if small else test, "h").where("gram = test_gram").select("id", "th", "pos", "size", "items")
    spans = F.transform(F.collect_set(F.struct("pos", "size")), lambda x: F.sequence(x["pos"], x["pos"] + x["size"] - 1))
    return found.groupBy("id", "th").agg(
        F.array_sort(F.array_distinct(F.flatten(spans))).alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )


def with_hits(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 8) -> tuple[DataFrame, str, str]:
    """``docs`` with the words hit and the items (both empty where there are none), and the names of the two."""
    th, places, items, *keys = fresh(docs, "th", "hit_places", "hit_items", "found_id", "found_th", "found_places", "found_items")
    found = hits(docs, benchmark, id_col, text_col, n).toDF(*keys)
    of_id, of_th, at, which = map(F.col, keys)
    joined = docs.withColumn(th, F.xxhash64(text_col)).join(found, F.col(id_col).eqNullSafe(of_id) & (F.col(th) == of_th), "left")
    empty = F.array()
    added = [F.coalesce(at, empty.cast("array<int>")).alias(places), F.coalesce(which, empty.cast("array<string>")).alias(items)]
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns], *added), places, items


def remove_test_data(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 8, max_items: int = 1) -> DataFrame:
    """``docs`` less the documents with hits of more than ``max_items`` items, and less the words hit in the others.

    A removed word goes with the separator behind it; a text without hits stays as it is.
    """
    joined, places, items = with_hits(docs, benchmark, id_col, text_col, n)
    kept = joined.where(F.size(items) <= max_items)
    text = F.col(f"`{text_col}`")

    def rebuilt(seps: Column) -> Column:
        words = split_words(text, RAW_SEPARATORS)
        parts = F.transform(words, lambda w, i: F.when(F.array_contains(places, i), F.lit("")).otherwise(F.concat(w, F.element_at(seps, i + 2))))
        return F.concat(F.element_at(seps, 1), F.array_join(parts, ""))

    new = F.when(F.size(places) == 0, text).otherwise(bind(F.split(text, RAW_WORDS), rebuilt))
    return kept.select(*[new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's rows: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    own = docs.select("doc_id", "text")
    found = hits(own, benchmark).select(F.col("id").alias("id_"), F.col("th").alias("th_"), F.size("places").cast("long").alias("hit"), F.size("items").cast("long").alias("n"), F.array_join("items", ",").alias("ids"))
    base = own.select("doc_id", F.xxhash64("text").alias("th"), F.size(split_words(F.col("text"), RAW_SEPARATORS)).cast("long").alias("n_words"))
    out = base.join(found, F.col("doc_id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    n_items = F.coalesce("n", F.lit(0).cast("long"))
    return out.select("doc_id", "n_words", F.coalesce("hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"), (n_items >= 2).alias("contaminated"))
