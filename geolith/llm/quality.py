"""Quality rules with cross-document line frequency, by DataFrame operations only.

A text fails the base rules if it has fewer than ``min_words`` words, or if over ``max_repeat_percent`` % of its
words stand in five-word windows that the text has twice or more.

Line frequency: lines are normalised (blanks run together, A-Z lower-cased) and hashed; per host, the distinct
documents with each line are counted, by their ids (copies with ids of their own count each).  A line that is in more
than ``max(least_docs, share * distinct documents of the host)`` of them is boilerplate there and is removed.  A text
is *depleted*, and rejected, if less than ``min_left`` of its words are left.

Counts are partial before they are shuffled, so a line or a host that most documents share loads no task; very long
texts are one row's arrays.  Null, empty and blank texts have no words and fail the base rules.  A null host is a host
like any other.  Rows with a null id are told apart by their texts.  Repeated rows each get a row and count once.
Other columns play no part; ``cleaned`` keeps them, and its own take other names where they clash.  An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bind, fresh, space_words, stored

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def repeat_words(words: Column, window: int = WINDOW) -> Column:
    """Words that stand in a window whose words the text has at another place too."""
    at = F.when(F.size(words) > window, F.sequence(F.lit(0), F.size(words) - window)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(at, lambda i: F.xxhash64(F.slice(words, i + 1, window)))

    def covered(h: Column) -> Column:
        """Sorted by hash, equal neighbours are repeats; sorted by place, each adds what the one before left open."""
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        nothing = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))

        def repeated(s: Column) -> Column:
            before = F.concat(nothing, F.slice(s, 1, F.size(s) - 1))
            after = F.concat(F.slice(s, 2, F.size(s)), nothing)
            near = F.zip_with(before, after, lambda a, b: F.struct(a["h"].alias("a"), b["h"].alias("b")))
            marked = F.zip_with(s, near, lambda x, y: F.when(x["h"].eqNullSafe(y["a"]) | x["h"].eqNullSafe(y["b"]), x["i"]))
            return F.array_sort(F.filter(marked, lambda x: x.isNotNull()))

        def length(p: Column) -> Column:
            after = F.concat(F.slice(p, 2, F.size(p)), F.array(F.lit(None).cast("int")))
            steps = F.zip_with(p, after, lambda a, b: F.least(F.coalesce(b - a, F.lit(window)), F.lit(window)))
            return F.aggregate(steps, F.lit(0), lambda t, x: t + x)

        return bind(bind(ordered, repeated), length)

    return bind(hashes, lambda h: F.when(F.size(h) == F.size(F.array_distinct(h)), F.lit(0)).otherwise(covered(h)))


def lines(text: Column) -> Column:
    """Lines with a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def line_hash(line: Column) -> Column:
    return F.xxhash64(ascii_lower(F.trim(F.regexp_replace(line, r"[\x20\x09-\x0D]+", " "))))


def base(docs: DataFrame, id_col: str, text_col: str, min_words: int, max_repeat_percent: int) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), text.alias("text"), space_words(F.col(text_col)).alias("w"))
    out = own.select(
        "id",
        "th",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", f"{SYMBOLS}+", ""))).cast("long").alias("n_symbols"),
        bind(lines(F.col("text")), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
    )
    return out.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def boilerplate_lines(docs: DataFrame, id_col: str, text_col: str, host_col: str, least_docs: int, share: float, salts: int = 16) -> tuple[DataFrame, DataFrame]:
    """(id, th, host, line, n, salt) of each line, and (host, line, salt) of boilerplate for every salt."""
    host = F.coalesce(F.col(host_col).cast("string"), F.lit("\0"))
    own = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), host.alias("host"), lines(F.col(text_col)).alias("own"))
    normal = F.transform("own", lambda x: F.struct(line_hash(x).alias("line"), F.size(space_words(x)).alias("n")))
    # two uses follow; the lines are taken apart once
    flat = own.select("id", "th", "host", F.explode(normal).alias("x")).select("id", "th", "host", "x.line", "x.n")
    flat = stored(flat, "lines")
    doc = [F.col("id"), F.when(F.col("id").isNull(), F.col("th")).alias("no_id")]
    seen = flat.select("host", "line", *doc).distinct()
    counts = seen.groupBy("host", "line").agg(F.count("*").alias("docs")).where(F.col("docs") > least_docs)
    totals = own.select("host", *doc).distinct().groupBy("host").agg(F.count("*").alias("all"))
    often = counts.join(totals, "host").where(F.col("docs") > F.col("all") * share).select("host", "line")
    # a line that a third of all documents share is met by its documents in several parts
    often = stored(often, "boilerplate").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return flat.withColumn("salt", F.pmod("th", F.lit(salts)).cast("int")), often


def boilerplate(docs: DataFrame, id_col: str, text_col: str, host_col: str, least_docs: int, share: float, salts: int = 16) -> DataFrame:
    """(id, th, n_lost): the words that each document with boilerplate lines loses."""
    part, often = boilerplate_lines(docs, id_col, text_col, host_col, least_docs, share, salts)
    per_row = part.groupBy("id", "th", "host", "line", "salt").agg(F.max("n").alias("n"), F.count("*").alias("times"))
    return per_row.join(often, ["host", "line", "salt"]).groupBy("id", "th").agg(F.sum(F.col("n") * F.col("times")).alias("n_lost"))


def cleaned(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    least_docs: int = 10,
    share: float = 0.01,
    min_left: float = 0.3,
) -> DataFrame:
    """``docs`` with ``cleaned_text`` (boilerplate lines dropped, the others in order), ``n_boilerplate_words`` and ``kept``."""
    names = fresh(docs, "cleaned_text", "n_boilerplate_words", "kept", "th_key", "host_key", "gone")
    clean, lost, kept, th, host, gone = names
    part, often = boilerplate_lines(docs, id_col, text_col, host_col, least_docs, share)
    met = part.select("th", "host", "line", "salt").distinct().join(often, ["host", "line", "salt"])
    met = met.groupBy(F.col("th").alias(th), F.col("host").alias(host)).agg(F.collect_set("line").alias(gone))
    own = docs.withColumn(th, F.xxhash64(text_col)).withColumn(host, F.coalesce(F.col(host_col).cast("string"), F.lit("\0")))
    rest = F.array_join(F.filter(F.split(F.col(text_col), "\n"), lambda x: ~F.array_contains(F.col(gone), line_hash(x))), "\n")
    out = own.join(met, [th, host], "left").withColumn(clean, F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(rest))
    words, left = space_words(F.col(text_col)), F.size(space_words(F.col(clean)))
    fine = bind(words, lambda w: (F.size(w) >= min_words) & (100 * repeat_words(w) <= max_repeat_percent * F.size(w)) & (left >= F.size(w) * min_left))
    out = out.withColumn(lost, (F.size(words) - left).cast("long")).withColumn(kept, fine)
    return out.select(*[F.col(f"`{c}`") for c in [*docs.columns, clean, lost, kept]])


def judged(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 10,
    max_repeat_percent: int = 20,
    least_docs: int = 10,
    share: float = 0.01,
    min_left: float = 0.3,
) -> DataFrame:
    """(id, the base measures, base_failed, n_boilerplate_words, kept), a row for each row of ``docs``."""
    first = base(docs, id_col, text_col, min_words, max_repeat_percent)
    lost = boilerplate(docs, id_col, text_col, host_col, least_docs, share)
    lost = lost.select(F.col("id").alias("id_"), F.col("th").alias("th_"), "n_lost")
    # repeated rows were counted together: each loses its share
    times = first.groupBy("id", "th").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("id_r"), F.col("th").alias("th_r"), "rows")
    lost = lost.join(times, F.col("id_").eqNullSafe(F.col("id_r")) & (F.col("th_") == F.col("th_r")), "left").select("id_", "th_", (F.col("n_lost") / F.coalesce("rows", F.lit(1))).cast("long").alias("n_lost"))
    out = first.join(lost, F.col("id").eqNullSafe(F.col("id_")) & (F.col("th") == F.col("th_")), "left")
    gone = F.coalesce("n_lost", F.lit(0).cast("long"))
    kept = ~F.col("base_failed") & (F.col("n_words") - gone >= F.col("n_words") * min_left)
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", gone.alias("n_boilerplate_words"), kept.alias("kept"))


def query(docs: DataFrame) -> DataFrame:
    """The contract's rows, and n_boilerplate_words."""
    return judged(docs.select("doc_id", "text", "source"))
