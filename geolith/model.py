"""The feature table and what derives from single rows of it.

features(type, id, kind, is_area, tags, x, y, lon, lat, bbox, node_ids, coords, members, parents, is_missing, key_bits,
tile).  type: N, W, R.  kind: n nodes, w ways that are not areas, a areas, r relations that are not areas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.functions import tags as T

TAGS = "map<string,string>"
BOX = "struct<minx:bigint,miny:bigint,maxx:bigint,maxy:bigint>"
COORDS = "array<struct<x:bigint,y:bigint>>"
MEMBERS = "array<struct<type:string,id:bigint,role:string>>"
COLUMNS = {
    "type": "string",
    "id": "bigint",
    "kind": "string",
    "is_area": "boolean",
    "tags": TAGS,
    "x": "bigint",
    "y": "bigint",
    "lon": "double",
    "lat": "double",
    "bbox": BOX,
    "node_ids": "array<bigint>",
    "coords": COORDS,
    "members": MEMBERS,
    "parents": "array<bigint>",
    "is_missing": "boolean",
    "key_bits": "int",
    "tile": "string",
}
TILE_ZOOM = 12
#: Prefix of the keys that quality checks add.
CHECK_KEY = "check:"


def no_tags() -> Column:
    return F.create_map().cast(TAGS)


def feature_rows(df: DataFrame, indexed=T.INDEXED_KEYS, zoom: int = TILE_ZOOM) -> DataFrame:
    """``df`` with every column of the table: those it lacks are derived where they can be, null elsewhere."""
    out = df
    have = set(df.columns)
    if "bbox" not in have and {"x", "y"} <= have:
        out = out.withColumn("bbox", geo.point_box("x", "y"))
    if "x" not in have and "bbox" in have:  # the centre
        b = F.col("bbox")
        out = out.withColumn("x", F.floor((b["minx"] + b["maxx"]) / 2)).withColumn("y", F.floor((b["miny"] + b["maxy"]) / 2))
    if "lon" not in have:
        out = out.withColumn("lon", geo.lon_of("x")).withColumn("lat", geo.lat_of("y"))
    if "is_missing" not in have:
        out = out.withColumn("is_missing", F.lit(False))
    if "key_bits" not in have:
        out = out.withColumn("key_bits", T.key_bits("tags", T.categories(list(indexed))))
    if "tile" not in have:
        out = out.withColumn("tile", F.when(F.col("x").isNotNull(), geo.tile_name("x", "y", zoom)))
    return out.select(*[(F.col(c) if c in out.columns else F.lit(None)).cast(t).alias(c) for c, t in COLUMNS.items()])


def kind_of(type_: Column, is_area: Column) -> Column:
    return F.when(type_ == "N", "n").when(is_area, "a").when(type_ == "W", "w").otherwise("r")


def typed_id(type_: Column, id_: Column) -> Column:
    """Type and id as one number: the type in the two lowest bits."""
    return F.shiftleft(id_, 2).bitwiseOR(F.when(type_ == "N", 0).when(type_ == "W", 1).otherwise(2))


def type_and_id(typed: Column) -> Column:
    """struct(type, id) of a typed id."""
    low = typed.bitwiseAND(F.lit(3))
    return F.struct(F.when(low == 0, "N").when(low == 1, "W").otherwise("R").alias("type"), F.shiftright(typed, 2).alias("id"))
