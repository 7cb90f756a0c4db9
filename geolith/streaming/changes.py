"""Changes as a stream: duplicates dropped within a watermark, and each batch merged into a stored node table.

The table lies in parts by a hash of the id.  A batch writes anew only the parts that it touches, as a version, with a
note of which version each part is in; a batch that runs again after a failure finds its number there and changes
nothing, so results are exactly once.  Versions that the last two notes do not name are deleted.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from geolith.work import deleted, exists, file_system, stored

SCHEMA = "change string, type string, id bigint, version int, user bigint, tags map<string,string>, x bigint, y bigint, ts timestamp"
STATE = "id bigint, x bigint, y bigint, tags map<string,string>, version int, is_deleted boolean"


def read(spark: SparkSession, path: str, watermark: str = "1 day", max_files: int = 100) -> DataFrame:
    """A folder of change tables (Parquet) as a stream; a change that comes twice within the watermark counts once."""
    raw = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", max_files).parquet(path)
    return raw.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["type", "id", "version"])


def rates(stream: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window, type, change, n) of a stream with a watermark."""
    return stream.groupBy(F.window("ts", width), "type", "change").agg(F.count("*").alias("n"))


def notes(spark: SparkSession, path: str) -> dict[int, dict[str, int]]:
    """The notes that there are: batch -> part -> the version that holds it."""
    if not exists(spark, f"{path}/notes"):
        return {}
    fs, at = file_system(spark, f"{path}/notes")
    done = [int(s.getPath().getName()) for s in fs.listStatus(at) if exists(spark, f"{s.getPath()}/_SUCCESS")]
    return {n: json.loads(spark.read.text(f"{path}/notes/{n}", wholetext=True).first()["value"]) for n in done}


def read_parts(spark: SparkSession, path: str, note: dict[str, int], only: list[int] | None = None) -> DataFrame:
    """The rows of all parts, or of some."""
    own = {k: v for k, v in note.items() if only is None or int(k) in only}
    folders = [f"{path}/v{v}/part={k}" for k, v in sorted(own.items())]
    empty = spark.createDataFrame([], STATE)
    return spark.read.schema(STATE).parquet(*folders) if folders else empty


def current(spark: SparkSession, path: str) -> tuple[DataFrame | None, int]:
    """The newest state of the table at ``path`` and the batch that wrote it."""
    found = notes(spark, path)
    if not found:
        return None, -1
    last = max(found)
    return read_parts(spark, path, found[last]), last


def expired(spark: SparkSession, path: str) -> None:
    """Delete the parts and notes that the last two notes do not need."""
    found = notes(spark, path)
    kept = sorted(found)[-2:]
    needed = {(k, v) for n in kept for k, v in found[n].items()}
    for n in found:
        if n not in kept:
            deleted(spark, f"{path}/notes/{n}")
    for k, v in {(k, v) for n in found if n not in kept for k, v in found[n].items()} - needed:
        deleted(spark, f"{path}/v{v}/part={k}")


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")


def merged(stream: DataFrame, base: DataFrame, path: str, parts: int = 64) -> DataStreamWriter:
    """A writer that applies each batch of node changes to ``base``, kept in versions under ``path``.

    The versions of a feature that were applied stay beside it, so that an older one that comes in a later batch
    changes nothing.
    """

    def apply(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        found = notes(spark, path)
        last = max(found, default=-1)
        if last >= number:
            return
        newest = batch.where("type = 'N'").groupBy("id").agg(F.max_by(F.struct("change", "version", "tags", "x", "y"), F.struct("version", (F.col("change") == "delete").cast("int"))).alias("c"))
        newest = stored(newest, "stream")
        touched = [r[0] for r in newest.select(part_of(parts)).distinct().collect()]  # so many parts at most
        if found:
            note = found[last]
            now = read_parts(spark, path, note, touched)
        else:  # the first batch writes all parts
            note, touched = {}, list(range(parts))
            now = base.select("id", "x", "y", "tags").withColumn("version", F.lit(0)).withColumn("is_deleted", F.lit(False))
        both = now.join(newest, "id", "full_outer")
        later = F.col("c").isNotNull() & (F.col("version").isNull() | (F.col("c.version") > F.col("version")))
        gone = F.coalesce(F.when(later, F.col("c.change") == "delete").otherwise(F.col("is_deleted")), F.lit(False))

        def pick(name: str) -> Column:
            return F.when(later & ~(F.col("c.change") == "delete"), F.coalesce(f"c.{name}", name)).otherwise(F.col(name)).alias(name)

        out = both.select("id", pick("x"), pick("y"), pick("tags"), F.when(later, F.col("c.version")).otherwise(F.col("version")).alias("version"), gone.alias("is_deleted"))
        out.withColumn("part", part_of(parts)).write.mode("overwrite").partitionBy("part").parquet(f"{path}/v{number}")
        fs, at = file_system(spark, f"{path}/v{number}")
        written = {s.getPath().getName().removeprefix("part="): number for s in fs.listStatus(at) if s.getPath().getName().startswith("part=")}
        spark.createDataFrame([(json.dumps(note | written),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/notes/{number}")
        expired(spark, path)

    return stream.writeStream.foreachBatch(apply)


def nodes(spark: SparkSession, path: str) -> DataFrame:
    """The nodes as of the last batch."""
    df, _ = current(spark, path)
    if df is None:
        raise ValueError(f"nothing was applied to {path} yet")
    return df.where("not is_deleted").select("id", "x", "y", "tags")


__all__ = ["SCHEMA", "current", "merged", "nodes", "rates", "read"]
