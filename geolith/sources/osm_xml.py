"""OSM XML and change files, read by Spark's XML source: one row for each element, in parallel over large files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith import model
from geolith.functions import geo

TAG = "tag array<struct<_k:string,_v:string>>"
COMMON = f"_id long, _version int, _uid long, _user string, _timestamp string, {TAG}"
NODE = f"{COMMON}, _lat double, _lon double"
WAY = f"{COMMON}, nd array<struct<_ref:long>>"
RELATION = f"{COMMON}, member array<struct<_type:string,_ref:long,_role:string>>"


def tags_of(c: Column) -> Column:
    """The last of equal keys wins."""
    return F.coalesce(F.map_from_entries(F.transform(F.array_distinct(F.transform(c, lambda t: t["_k"])), lambda k: F.struct(k, F.element_at(F.filter(c, lambda t: t["_k"] == k), -1)["_v"]))), model.no_tags())


def letter(c: Column) -> Column:
    return F.when(c == "node", "N").when(c == "way", "W").otherwise("R")


def read(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """nodes (id, lon, lat, x, y, tags), ways (id, tags), way_nodes, relations (id, tags), members."""
    raw = {k: spark.read.format("xml").options(rowTag=k).schema(s).load(path) for k, s in (("node", NODE), ("way", WAY), ("relation", RELATION))}
    n = raw["node"].select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), geo.x_of("_lon").alias("x"), geo.y_of("_lat").alias("y"), tags_of(F.col("tag")).alias("tags"))
    w, r = raw["way"], raw["relation"]
    return {
        "nodes": n,
        "ways": w.select(F.col("_id").alias("id"), tags_of(F.col("tag")).alias("tags")),
        "way_nodes": w.select(F.col("_id").alias("way_id"), F.posexplode("nd").alias("p", "n")).select("way_id", (F.col("p") + 1).alias("pos"), F.col("n._ref").alias("node_id")),
        "relations": r.select(F.col("_id").alias("id"), tags_of(F.col("tag")).alias("tags")),
        "members": r.select(F.col("_id").alias("rel_id"), F.posexplode("member").alias("p", "m")).select("rel_id", (F.col("p") + 1).alias("pos"), letter(F.col("m._type")).alias("type"), F.col("m._ref").alias("id"), F.coalesce("m._role", F.lit("")).alias("role")),
    }


ELEMENTS = f"node array<struct<{NODE.replace(' array', ':array').replace(', ', ',').replace(' ', ':')}>>, way array<struct<{WAY.replace(' array', ':array').replace(', ', ',').replace(' ', ':')}>>, relation array<struct<{RELATION.replace(' array', ':array').replace(', ', ',').replace(' ', ':')}>>"


FLAT = "struct<type:string,id:bigint,version:int,user:bigint,user_name:string,ts:timestamp,tags:map<string,string>,x:bigint,y:bigint,node_ids:array<bigint>,members:array<struct<type:string,id:bigint,role:string>>>"


def flat_changes(blocks: DataFrame, change: str) -> DataFrame:
    """(change, type, id, version, user, user_name, ts, tags, x, y, node_ids, members) of one kind of change blocks, in
    one pass over them."""
    gone = change == "delete"  # deleted elements carry no tags and no parts

    def all_of(name: str, type_: str) -> Column:
        return F.coalesce(F.transform(name, lambda e: flat(e, type_)), none)

    def flat(e: Column, type_: str) -> Column:
        node_ids = F.transform(e["nd"], lambda n: n["_ref"]) if type_ == "W" and not gone else F.lit(None)
        members = F.transform(e["member"], lambda m: F.struct(letter(m["_type"]).alias("type"), m["_ref"].alias("id"), F.coalesce(m["_role"], F.lit("")).alias("role"))) if type_ == "R" and not gone else F.lit(None)
        return F.struct(
            F.lit(type_).alias("type"),
            e["_id"].alias("id"),
            F.coalesce(e["_version"], F.lit(1)).alias("version"),
            e["_uid"].alias("user"),
            e["_user"].alias("user_name"),
            F.try_to_timestamp(e["_timestamp"]).alias("ts"),
            (model.no_tags() if gone else tags_of(e["tag"])).alias("tags"),
            (geo.x_of(e["_lon"]) if type_ == "N" else F.lit(None)).cast("bigint").alias("x"),
            (geo.y_of(e["_lat"]) if type_ == "N" else F.lit(None)).cast("bigint").alias("y"),
            node_ids.cast("array<bigint>").alias("node_ids"),
            members.cast(model.MEMBERS).alias("members"),
        ).cast(FLAT)

    none = F.array().cast(f"array<{FLAT}>")
    parts = [all_of("node", "N"), all_of("way", "W"), all_of("relation", "R")]
    return blocks.select(F.explode(F.concat(*parts)).alias("e")).select(F.lit(change).alias("change"), "e.*")


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A change file (``.osc`` or ``.osc.gz``), or a folder of them; a pass for each kind of change."""
    out = None
    for change in ("create", "modify", "delete"):
        blocks = spark.read.format("xml").options(rowTag=change).schema(ELEMENTS).load(path)
        part = flat_changes(blocks, change)
        out = part if out is None else out.unionByName(part)
    return out
