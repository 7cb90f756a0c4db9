"""Stored libraries: a feature table in files, by kind, key bucket and tile, with a table of what its parts cover.

    features/    the features, partitioned by kind_part, key_part and tile_part, sorted along a space-filling curve
    parts/       (kind_part, key_part, tile_part, minx, miny, maxx, maxy, n) of each partition
    way_nodes/   (way_id, node_ids) in the order of ways, of libraries that can be updated
    _library     properties: the library's id, its settings
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolith import model
from geolith.operators.build import deepest_tile, spatial_order
from geolith.work import deleted, exists, stored, stored_at

COARSE = 6
PARTS = ["kind_part", "key_part", "tile_part"]
#: Fields of a partition's box, of the features in it.
COVER = ["minx", "miny", "maxx", "maxy"]
MIXED = "mixed"
NOWHERE = "none"


class LibraryError(Exception):
    """A folder that is no library, or another one."""


def _sidecar(path: str) -> str:
    return f"{path.rstrip('/')}/_library"


def _table(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def properties(spark: SparkSession, path: str) -> dict:
    if not exists(spark, _sidecar(path)):
        raise LibraryError(f"no library at {path}")
    return json.loads(spark.read.text(_sidecar(path), wholetext=True).first()["value"])


def _write_properties(spark: SparkSession, path: str, content: dict) -> None:
    spark.createDataFrame([(json.dumps(content),)], "value string").coalesce(1).write.mode("overwrite").text(_sidecar(path))


def coarse_tile(zoom: int = COARSE) -> Column:
    """The tile's parent at ``zoom``, as its partition; features without a place go to ``none``."""
    parts = F.split("tile", "/")
    up = parts[0].cast("int") - zoom
    col = F.expr(f"shiftright(cast(split(tile, '/')[1] as int), cast(split(tile, '/')[0] as int) - {zoom})")
    row = F.expr(f"shiftright(cast(split(tile, '/')[2] as int), cast(split(tile, '/')[0] as int) - {zoom})")
    return F.when(F.col("tile").isNull() | (up < 0), F.lit(NOWHERE)).otherwise(F.concat_ws("-", col.cast("string"), row.cast("string")))


def in_tiles(features: DataFrame, tiles: DataFrame) -> DataFrame:
    """``features`` with tile_part: the deepest tile of a tile set (zoom, col, row) that holds the feature's place."""
    out = deepest_tile(features, tiles)
    name = F.concat_ws("-", *[F.col(f"tile_{c}").cast("string") for c in ("zoom", "col", "row")])
    return out.select(*features.columns, F.when(F.col("tile_zoom").isNull(), NOWHERE).otherwise(name).alias("tile_part"))


def key_part(features: DataFrame, most: int, least_features: int) -> Column:
    """The bucket of a feature: its key bits if they are among the ``most - 1`` largest of its kind and
    ``least_features`` or more have them, else ``mixed``."""
    groups = features.groupBy("kind", "key_bits").agg(F.count("*").alias("n")).where(F.col("n") >= least_features)
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("n"), "key_bits"))
    own = groups.withColumn("rank", rank).where(F.col("rank") <= max(0, most - 1)).collect() if most > 1 else []  # most - 1 rows of each kind
    names = [f"{r['kind']}{r['key_bits']}" for r in own]
    return F.when(F.concat("kind", F.col("key_bits").cast("string")).isin(names), F.col("key_bits").cast("string")).otherwise(F.lit(MIXED)) if names else F.lit(MIXED)


def write(
    features: DataFrame,
    path: str,
    guid: str | None = None,
    extra: dict | None = None,
    mode: str = "errorifexists",
    tiles: DataFrame | None = None,
    most_buckets: int = 6,
    least_features: int = 300,
    updatable: bool = False,
    page_rows: int = 1024,
) -> str:
    """The library's id.  Rows are dealt by kind, key bucket and tile (of ``tiles``, else coarse ones) and sorted along
    a space-filling curve, so that partitions, row groups and pages (of ``page_rows`` rows) prune.

    The features are made once and stored: their buckets, the ranges, the rows and the index each read them.
    """
    spark = features.sparkSession
    guid = guid or str(uuid.uuid4())
    placed = in_tiles(features, stored(tiles, "tiles")) if tiles is not None else features.withColumn("tile_part", coarse_tile())
    placed, work_path = stored_at(placed.select(*model.COLUMNS, "tile_part"), "features")
    own = placed
    placed = placed.withColumns({"kind_part": F.col("kind"), "key_part": key_part(own, most_buckets, least_features)})
    curve = F.when(F.col("x").isNotNull(), spatial_order(F.col("x"), F.col("y")))
    ordered = placed.repartitionByRange(*PARTS, curve).sortWithinPartitions(*PARTS, curve).select(*model.COLUMNS, *PARTS)
    ordered.write.mode(mode).option("parquet.page.row.count.limit", page_rows).partitionBy(*PARTS).parquet(_table(path, "features"))
    covers(raw(spark, path)).write.mode(mode).parquet(_table(path, "parts"))
    if updatable:
        index = own.where("type = 'W' and not is_missing and size(node_ids) > 0").select(F.col("id").alias("way_id"), "node_ids")
        index.orderBy("way_id").write.mode(mode).parquet(_table(path, "way_nodes"))
    deleted(spark, work_path)
    _write_properties(spark, path, {"guid": guid, **(extra or {})})
    return guid


def raw(spark: SparkSession, path: str) -> DataFrame:
    """The stored rows with their partitions, all of them text."""
    schema = ", ".join([*[f"`{c}` {t}" for c, t in model.COLUMNS.items()], *[f"{c} string" for c in PARTS]])
    return spark.read.schema(schema).parquet(_table(path, "features"))


def covers(rows: DataFrame) -> DataFrame:
    """What each partition covers: the box around all its features, which may reach out of its tile."""
    b = F.col("bbox")
    return rows.groupBy(*PARTS).agg(*[(F.min if c[:3] == "min" else F.max)(b[c]).alias(c) for c in COVER], F.count("*").alias("n"))


def checked_schema(spark: SparkSession, path: str) -> None:
    found = dict(spark.read.parquet(_table(path, "features")).dtypes)
    for name, kind in model.COLUMNS.items():
        if found.get(name) != kind:
            raise LibraryError(f"column {name} of {path} should be {kind}, not {found.get(name)}")


def pruned(spark: SparkSession, path: str, kinds: str | None = None, box: tuple[int, int, int, int] | None = None, bits: list[int] | None = None) -> list[tuple[str, str, str]]:
    """The partitions that can hold what is asked for: of some kinds, meeting a box, with all categories of any of
    ``bits``.  There are no more than tiles, kinds and buckets."""
    parts = spark.read.parquet(_table(path, "parts"))
    if kinds:
        parts = parts.where(F.col("kind_part").isin(list(kinds)))
    if box is not None:
        minx, miny, maxx, maxy = box
        parts = parts.where((F.col("minx") <= maxx) & (F.col("maxx") >= minx) & (F.col("miny") <= maxy) & (F.col("maxy") >= miny))
    if bits:
        own = F.col("key_part").try_cast("int")
        any_of = F.col("key_part") == MIXED
        for b in bits:
            any_of = any_of | (own.bitwiseAND(F.lit(b)) == b)
        parts = parts.where(any_of)
    return [tuple(r) for r in parts.select(*PARTS).distinct().collect()]


def read(spark: SparkSession, path: str, kinds: str | None = None, tiles: list[str] | None = None, box: tuple[int, int, int, int] | None = None, bits: list[int] | None = None, keep_parts: bool = False) -> DataFrame:
    """The features; ``kinds``, ``box`` and ``bits`` leave out the partitions that hold nothing for them, ``tiles`` all
    but these."""
    properties(spark, path)
    checked_schema(spark, path)
    out = raw(spark, path)
    if tiles is not None:
        out = out.where(F.col("tile_part").isin([*tiles, NOWHERE]))
    if kinds or box is not None or bits:
        found = pruned(spark, path, kinds, box, bits)
        for k, name in enumerate(PARTS):
            out = out.where(F.col(name).isin(sorted({f[k] for f in found})))
    return out.select(*model.COLUMNS, *(PARTS if keep_parts else []))


def way_nodes(spark: SparkSession, path: str) -> DataFrame | None:
    """(way_id, node_ids) of a library that can be updated, else None."""
    return spark.read.parquet(_table(path, "way_nodes")) if exists(spark, _table(path, "way_nodes")) else None


def tile_list(spark: SparkSession, path: str) -> DataFrame:
    """(tile): the tiles, ``none`` among them always."""
    own = spark.read.parquet(_table(path, "parts")).select(F.col("tile_part").alias("tile")).distinct()
    return own.union(spark.createDataFrame([(NOWHERE,)], "tile string")).distinct()


def tiles_of(rows: DataFrame) -> list[str]:
    """The tiles of some rows read with their partitions: as many as the library has at most."""
    return [r[0] for r in rows.select("tile_part").distinct().collect()]


def save(spark: SparkSession, path: str, to: str, tiles: list[str] | None = None) -> int:
    """A tile set of the library's tiles (and ``none``); a folder that holds another library's is refused."""
    own_properties = properties(spark, path)
    guid = own_properties["guid"]
    had: list[str] = []
    if exists(spark, _sidecar(to)):
        if properties(spark, to)["guid"] != guid:
            raise LibraryError(f"{to} holds the tiles of another library")
        had = tiles_of(spark.read.parquet(_table(to, "parts")))
    own, parts = raw(spark, path), spark.read.parquet(_table(path, "parts"))
    if tiles is not None:
        own, parts = (df.where(F.col("tile_part").isin([*tiles, NOWHERE])) for df in (own, parts))
    n = parts.select("tile_part").distinct().count()
    own.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(_table(to, "features"))
    parts.where(~F.col("tile_part").isin(had)).write.mode("append").parquet(_table(to, "parts"))
    _write_properties(spark, to, own_properties)
    return n


def load(spark: SparkSession, path: str, source: str, tiles: list[str] | None = None) -> int:
    """Append the tiles (all, or some) that the library at ``path`` does not have yet; a new folder becomes a library."""
    own_properties = properties(spark, source)
    had: list[str] = []
    if exists(spark, _sidecar(path)):
        if properties(spark, path)["guid"] != own_properties["guid"]:
            raise LibraryError(f"{source} holds the tiles of another library")
        had = tiles_of(spark.read.parquet(_table(path, "parts")))
    parts = spark.read.parquet(_table(source, "parts")).where(~F.col("tile_part").isin(had))
    if tiles is not None:
        parts = parts.where(F.col("tile_part").isin([*tiles, NOWHERE]))
    new = tiles_of(parts)
    if new:
        raw(spark, source).where(F.col("tile_part").isin(new)).write.mode("append").partitionBy(*PARTS).parquet(_table(path, "features"))
        parts.write.mode("append").parquet(_table(path, "parts"))
    if not exists(spark, _sidecar(path)):
        _write_properties(spark, path, own_properties)
    return len(new)


def check(features: DataFrame) -> DataFrame:
    """(error, n) of the table's integrity: doubles, short ways, members and parents that nothing is.

    One pass: features, members and parents are rows of one shape, counted by type and id in one aggregate.
    """
    way = (F.col("type") == "W") & ~F.col("is_missing")
    short, bare = way & (F.size("node_ids") < 2), way & (F.size("node_ids") != F.size("coords"))

    def row(type_: Column, id_: Column, what: str) -> Column:
        return F.struct(type_.alias("type"), id_.alias("id"), F.lit(what).alias("what"))

    own = F.array(row(F.col("type"), F.col("id"), "f"))
    below = F.when(F.col("type") == "R", F.transform("members", lambda m: row(m["type"], m["id"], "m")))
    above = F.transform("parents", lambda p: row(F.lit("R"), p, "p"))
    none = F.array().cast("array<struct<type:string,id:bigint,what:string>>")
    each = features.select(short.alias("short"), bare.alias("bare"), F.explode(F.concat(own, F.coalesce(below, none), F.coalesce(above, none))).alias("e"))
    is_own = F.col("e.what") == "f"
    found = each.groupBy("e.type", "e.id").agg(
        F.count_if(is_own).alias("n"), F.count_if(is_own & F.col("short")).alias("short"), F.count_if(is_own & F.col("bare")).alias("bare"), F.bool_or(F.col("e.what") == "m").alias("is_member"), F.bool_or(F.col("e.what") == "p").alias("is_parent")
    )
    nothing = (F.col("n") == 0) | F.col("type").isNull() | F.col("id").isNull()  # a null is no feature
    counts = {
        "feature twice": F.count_if(F.col("n") > 1),
        "way with fewer than two nodes": F.sum("short"),
        "way without a place for each node": F.sum("bare"),
        "member without feature": F.count_if(F.col("is_member") & nothing),
        "parent without feature": F.count_if(F.col("is_parent") & nothing),
    }
    total = found.agg(F.array(*[F.struct(F.lit(name).alias("error"), n.alias("n")) for name, n in counts.items()]).alias("c"))
    return total.select(F.inline("c")).where("n > 0")
