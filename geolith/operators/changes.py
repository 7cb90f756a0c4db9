"""Change files: the newest version wins; applying changes; what else they change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.functions import tags as T


def latest(changes: DataFrame) -> DataFrame:
    """One change of each feature: of the highest version; of equal ones a delete, then the least change name.

    A feature that any of the changes creates and the last deletes was never there: both go.  A create survives later
    modifications.  Versions of one feature meet in a partial maximum, so one that changes often loads no task.
    """
    rank = F.struct("version", (F.col("change") == "delete").cast("int").alias("gone"), F.struct(*[c for c in changes.columns if c not in ("type", "id", "version", "tags")]).alias("rest"))
    best = changes.groupBy("type", "id").agg(F.max_by(F.struct(*[c for c in changes.columns if c not in ("type", "id")]), rank).alias("c"), F.max((F.col("change") == "create").cast("int")).alias("created"))
    out = best.select("type", "id", "c.*", "created").where(~((F.col("created") == 1) & (F.col("change") == "delete")))
    change = F.when((F.col("created") == 1) & (F.col("change") == "modify"), "create").otherwise(F.col("change"))
    return out.withColumn("change", change).select(*changes.columns)


def of_existing(changes: DataFrame) -> DataFrame:
    """The changes of features that were there before: those of a first version have nothing to be looked up."""
    return changes.where("version != 1")


def by_way(way_nodes: DataFrame) -> DataFrame:
    """(way_id, node_ids) in the order of ways: the way-node index of libraries that can be updated."""
    listed = way_nodes.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("own"))
    return listed.select("way_id", F.transform("own", lambda c: c["node_id"]).alias("node_ids")).orderBy("way_id")


def ways_of_interest(index: DataFrame, moved: DataFrame) -> DataFrame:
    """(way_id): ways of a stored way-node index with a node of ``moved`` (id)."""
    each = index.select("way_id", F.explode("node_ids").alias("id"))
    return each.join(moved.select("id"), "id", "left_semi").select("way_id").distinct()


def apply_to_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``nodes`` (id, lon, lat, x, y, tags) after ``changes``: deleted ones go, the others take the newest values."""
    now = latest(changes.where("type = 'N'"))
    new = now.select("id", F.col("change").alias("c_change"), F.col("tags").alias("c_tags"), F.col("x").alias("c_x"), F.col("y").alias("c_y"))
    both = nodes.join(new, "id", "full_outer").where("c_change is null or c_change != 'delete'")
    x, y = F.coalesce("c_x", "x"), F.coalesce("c_y", "y")
    return both.select(
        "id",
        F.when(F.col("c_x").isNull(), F.col("lon")).otherwise(geo.lon_of(x)).alias("lon"),
        F.when(F.col("c_y").isNull(), F.col("lat")).otherwise(geo.lat_of(y)).alias("lat"),
        x.alias("x"),
        y.alias("y"),
        F.when(F.col("c_change").isNull(), F.col("tags")).otherwise(F.coalesce("c_tags", "tags")).alias("tags"),
    )


def moved_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(id): nodes whose place the changes change, deleted ones too."""
    now = latest(changes.where("type = 'N'")).select("id", F.col("change").alias("c"), F.col("x").alias("c_x"), F.col("y").alias("c_y"))
    both = nodes.select("id", "x", "y").join(now, "id")
    return both.where((F.col("c") == "delete") | ~F.col("x").eqNullSafe(F.col("c_x")) | ~F.col("y").eqNullSafe(F.col("c_y"))).select("id")


def implicit_ways(nodes: DataFrame, way_nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """(way_id): ways that change because a node of theirs moves."""
    moved = moved_nodes(nodes, changes).select(F.col("id").alias("node_id"))
    return way_nodes.join(moved, "node_id", "left_semi").select("way_id").distinct()


def implicit_relations(members: DataFrame, changes: DataFrame, ways: DataFrame) -> DataFrame:
    """(rel_id): relations with a member that changes itself or (``ways``) through its nodes."""
    changed = latest(changes).select("type", "id").union(ways.select(F.lit("W"), "way_id")).distinct()
    return members.join(changed, ["type", "id"], "left_semi").select("rel_id").distinct()


def promoted(nodes: DataFrame, members: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, effect): nodes that become features (``promoted``: the change brings tags) or stop being one
    (``demoted``: it takes the last tag of a node that is no member)."""
    now = latest(changes.where("type = 'N' and change != 'delete'")).select("id", F.size("tags").alias("after"))
    member = members.where("type = 'N'").select("id").distinct().withColumn("is_member", F.lit(True))
    both = nodes.select("id", F.size("tags").alias("before")).join(now, "id").join(member, "id", "left")
    effect = F.when((F.col("before") == 0) & (F.col("after") > 0), "promoted").when((F.col("before") > 0) & (F.col("after") == 0), "demoted")
    return both.where("is_member is null").select("id", effect.alias("effect")).where("effect is not null")


def tag_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(id, change): what turns the tags of ``old`` into those of ``new``, where they differ."""
    both = old.select("id", F.col("tags").alias("a")).join(new.select("id", F.col("tags").alias("b")), "id")
    return both.select("id", T.diff("a", "b").alias("change")).where(F.size("change") > 0)


def added_and_dropped(old: DataFrame, new: DataFrame, key: str = "rel_id") -> DataFrame:
    """(key, added, dropped): distinct members that came and went, as type and id.

    Members are compared as rows: lists of structs are compared each with each, the square of a large relation.
    """
    rows = old.select(key, "type", "id", F.lit(1).alias("was"), F.lit(0).alias("now")).union(new.select(key, "type", "id", F.lit(0), F.lit(1)))
    each = rows.groupBy(key, "type", "id").agg(F.max("was").alias("was"), F.max("now").alias("now"))
    member = F.struct("type", "id")
    lists = [F.sort_array(F.collect_list(F.when(F.col(a) < F.col(b), member))).alias(n) for n, a, b in (("added", "was", "now"), ("dropped", "now", "was"))]
    return each.groupBy(key).agg(*lists)


def raw_of(features: DataFrame, index: DataFrame | None = None) -> dict[str, DataFrame]:
    """The raw tables behind a feature table: nodes (those that are only places of ways too), ways, relations and
    parts.  ``index``: its stored way-node index, if there is one."""
    own = features.where("not is_missing")
    ways, rels = own.where("type = 'W'"), own.where("type = 'R'")
    lists = index if index is not None else ways.select(F.col("id").alias("way_id"), "node_ids")
    way_nodes = lists.select("way_id", F.posexplode("node_ids").alias("p", "node_id")).select("way_id", (F.col("p") + 1).alias("pos"), "node_id")
    points = own.where("type = 'N'").select("id", "lon", "lat", "x", "y", "tags")
    places = ways.select(F.explode(F.arrays_zip("node_ids", "coords")).alias("z")).groupBy(F.col("z.node_ids").alias("id")).agg(F.min(F.struct("z.coords.x", "z.coords.y")).alias("c"))
    bare = places.join(points.select("id"), "id", "left_anti").select("id", geo.lon_of("c.x").alias("lon"), geo.lat_of("c.y").alias("lat"), "c.x", "c.y", F.create_map().cast("map<string,string>").alias("tags"))
    members = rels.select(F.col("id").alias("rel_id"), F.posexplode("members").alias("p", "m")).select("rel_id", (F.col("p") + 1).alias("pos"), "m.type", "m.id", "m.role")
    return {"nodes": points.unionByName(bare), "ways": ways.select("id", "tags"), "way_nodes": way_nodes, "relations": rels.select("id", "tags"), "members": members}


def apply_all(raw: dict[str, DataFrame], changes: DataFrame) -> dict[str, DataFrame]:
    """The raw tables after ``changes`` (with node_ids and members): built again, features are promoted, demoted,
    moved and missing as the changes have it."""
    now = latest(changes)
    out = {"nodes": apply_to_nodes(raw["nodes"], changes)}
    for kind, table, parts, key in (("W", "ways", "way_nodes", "way_id"), ("R", "relations", "members", "rel_id")):
        own = now.where(F.col("type") == kind)
        kept, ids = own.where("change != 'delete'"), own.select("id")
        out[table] = raw[table].join(ids, "id", "left_anti").unionByName(kept.select("id", "tags"))
        rest = raw[parts].join(ids.select(F.col("id").alias(key)), key, "left_anti")
        if kind == "W":
            new = kept.select(F.col("id").alias(key), F.posexplode("node_ids").alias("p", "node_id")).select(key, (F.col("p") + 1).alias("pos"), "node_id")
        else:
            new = kept.select(F.col("id").alias(key), F.posexplode("members").alias("p", "m")).select(key, (F.col("p") + 1).alias("pos"), "m.type", "m.id", "m.role")
        out[parts] = rest.unionByName(new)
    return out
