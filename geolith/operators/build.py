"""From raw nodes, ways and relations to the feature table: cleaning, geometry, bounds, membership, tiles, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolith import model
from geolith.functions import geo
from geolith.functions import tags as T
from geolith.work import deleted, stored, stored_at


# --- ways


def way_geometry(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, node_ids, coords, n_known): nodes in order, unknown places taken from their neighbours."""
    places = nodes.select(F.col("id").alias("node_id"), "x", "y")
    joined = way_nodes.join(places, "node_id", "left")
    rows = joined.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id", "x", "y"))).alias("own"), F.count("x").alias("n_known"))
    raw = F.transform("own", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y")))
    coords = F.when(F.col("n_known") == F.size("own"), raw).otherwise(geo.filled(raw))  # most ways have no gaps to look for
    return rows.select("way_id", F.col("own.node_id").alias("node_ids"), coords.alias("coords"), "n_known")


def way_bounds(way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(way_id, bbox) of the ways with two nodes or more, one of them known: without their geometry, by partial minima."""
    joined = way_nodes.join(nodes.select(F.col("id").alias("node_id"), "x", "y"), "node_id", "left")
    box = F.struct(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    out = joined.groupBy("way_id").agg(F.count("*").alias("n"), F.count("x").alias("n_known"), box.alias("bbox"))
    return out.where("n >= 2 and n_known > 0").select("way_id", "bbox")


def way_features(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(type, id, kind, is_area, tags, node_ids, coords, bbox, parents) of the ways with two nodes or more, one of them
    known.  ``up``: ``parents``; they are joined to the tags, by the key that the coordinates then come by."""
    shaped = way_geometry(way_nodes, nodes).where((F.size("node_ids") >= 2) & (F.col("n_known") > 0))
    own = with_parents(ways, up, "W")
    out = own.join(shaped, own["id"] == shaped["way_id"]).withColumn("bbox", geo.coords_box("coords"))
    area = geo.is_closed("coords") & T.says_area("tags")
    return out.select(F.lit("W").alias("type"), "id", model.kind_of(F.lit("W"), area).alias("kind"), area.alias("is_area"), "tags", "node_ids", "coords", "bbox", "parents")


def rejected_ways(ways: DataFrame, way_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, reason) of the ways that are left out: ``few nodes`` or ``unknown nodes``."""
    known = way_nodes.join(nodes.select(F.col("id").alias("node_id"), F.lit(1).alias("known")), "node_id", "left")
    counts = known.groupBy("way_id").agg(F.count("*").alias("n"), F.count("known").alias("n_known"))
    out = ways.join(counts, ways["id"] == counts["way_id"], "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_known", F.lit(0)).alias("n_known"))
    reason = F.when(F.col("n") < 2, "few nodes").when(F.col("n_known") == 0, "unknown nodes")
    return out.select("id", reason.alias("reason")).where("reason is not null")


# --- relations


def clean_members(members: DataFrame) -> DataFrame:
    """Without relations that are members of themselves."""
    return members.where(~((F.col("type") == "R") & (F.col("id") == F.col("rel_id"))))


def parents(members: DataFrame) -> DataFrame:
    """(type, id, parents): the distinct relations of each member, in order."""
    return members.groupBy("type", "id").agg(F.array_sort(F.collect_set("rel_id")).alias("parents"))


def with_parents(df: DataFrame, up: DataFrame | None, type_: str) -> DataFrame:
    """``df`` (id ...) with ``parents``; an empty list for features that no relation has."""
    none = F.array().cast("array<bigint>")
    if up is None:
        return df.withColumn("parents", none)
    own = up.where(F.col("type") == type_).select("id", F.col("parents").alias("up"))
    return df.join(own, "id", "left").select(*df.columns, F.coalesce("up", none).alias("parents"))


def missing(members: DataFrame, features: DataFrame) -> DataFrame:
    """(type, id): members that no feature is."""
    return members.select("type", "id").distinct().join(features.select("type", "id"), ["type", "id"], "left_anti")


def rejected_relations(relations: DataFrame, members: DataFrame, features: DataFrame) -> DataFrame:
    """(id): relations with members, none of them a relation, that no feature is."""
    known = features.select("type", "id", F.lit(1).alias("known")).distinct()
    counts = clean_members(members).join(known, ["type", "id"], "left").groupBy("rel_id").agg(F.count("known").alias("n_known"), F.max((F.col("type") == "R").cast("int")).alias("is_super"))
    return relations.join(counts, relations["id"] == counts["rel_id"]).where("n_known = 0 and is_super = 0").select("id")


def empty_relations(relations: DataFrame, members: DataFrame) -> DataFrame:
    """(id, is_kept): relations without members; those that another relation has as a member are kept."""
    own = clean_members(members)
    bare = relations.select("id").join(own.select(F.col("rel_id").alias("id")).distinct(), "id", "left_anti")
    used = own.where("type = 'R'").select("id").distinct().withColumn("is_kept", F.lit(True))
    return bare.join(used, "id", "left").select("id", F.coalesce("is_kept", F.lit(False)).alias("is_kept"))


def member_closure(members: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """(rel_id, type, id): every feature that a relation reaches through relations; cycles end where they close.

    ``roots`` (rel_id): only what these reach.  Each round joins the pairs found last with the members of relations and
    drops what is known, so work ends with the deepest chain, however deep, and never repeats around a cycle.
    """
    own = stored(clean_members(members).select("rel_id", "type", "id").distinct(), "closure")
    reach = own if roots is None else stored(own.join(roots.select("rel_id").distinct(), "rel_id", "left_semi"), "closure")
    last, parts = reach, 1
    while True:
        via = last.where("type = 'R'").select(F.col("rel_id").alias("root"), F.col("id").alias("via"))
        more = via.join(own, via["via"] == own["rel_id"]).select(F.col("root").alias("rel_id"), "type", "id").distinct()
        more = stored(more.join(reach, ["rel_id", "type", "id"], "left_anti"), "closure")
        if more.isEmpty():
            return reach
        parts += 1
        reach = reach.union(more) if parts % 8 else stored(reach.union(more), "closure")
        last = more


def reached(members: DataFrame, start: DataFrame) -> DataFrame:
    """(type, id): ``start`` (type, id) and all that its relations reach, each once.

    Only relations that were not met before are followed; which of the start reaches what is not kept.
    """
    own = clean_members(members).select("rel_id", "type", "id")
    found = stored(start.select("type", "id").distinct(), "reached")
    last, parts = found, 1
    while True:
        at = last.where("type = 'R'").select(F.col("id").alias("rel_id"))
        more = stored(own.join(at, "rel_id", "left_semi").select("type", "id").distinct().join(found, ["type", "id"], "left_anti"), "reached")
        if more.isEmpty():
            return found
        parts += 1
        found = found.union(more) if parts % 8 else stored(found.union(more), "reached")
        last = more


BOX_FIELDS = ("minx", "miny", "maxx", "maxy")


def boxes_around(box: str = "bbox") -> list[Column]:
    b = F.col(box)
    return [F.min(b["minx"]).alias("minx"), F.min(b["miny"]).alias("miny"), F.max(b["maxx"]).alias("maxx"), F.max(b["maxy"]).alias("maxy")]


def relation_bounds(members: DataFrame, boxes: DataFrame) -> DataFrame:
    """(rel_id, bbox): around all that a relation reaches.  ``boxes``: (type, id, bbox) of nodes and ways.

    Each relation's box goes up to the relations that have it, as long as boxes grow: a row for each relation, never
    one for each that it reaches.  Cycles end as boxes stop to grow.
    """
    spark = members.sparkSession
    own = clean_members(members)
    links = stored(own.where("type = 'R'").select("rel_id", F.col("id").alias("child")).distinct(), "bounds-links")
    direct = own.where("type != 'R'").select("rel_id", "type", "id").join(boxes.where("bbox is not null").select("type", "id", "bbox"), ["type", "id"])
    now, path = stored_at(direct.groupBy("rel_id").agg(*boxes_around()).select("*", F.lit(True).alias("is_new")), "bounds")
    while True:
        grown = now.where("is_new").select(F.col("rel_id").alias("child"), F.struct(*BOX_FIELDS).alias("bbox"))
        more = links.join(grown, "child").groupBy("rel_id").agg(*boxes_around()).toDF("rel_id", *[f"new_{c}" for c in BOX_FIELDS])
        low = [F.least(c, f"new_{c}").alias(c) for c in BOX_FIELDS[:2]]
        high = [F.greatest(c, f"new_{c}").alias(c) for c in BOX_FIELDS[2:]]
        same = F.lit(True)
        for c, whole in zip(BOX_FIELDS, (*low, *high)):
            same = same & whole.eqNullSafe(F.col(c))
        both = now.join(more, "rel_id", "full_outer").select("rel_id", *low, *high, (~same).alias("is_new"))
        after, after_path = stored_at(both, "bounds")
        deleted(spark, path)
        now, path = after, after_path
        if now.where("is_new").isEmpty():
            return now.select("rel_id", F.struct(*BOX_FIELDS).alias("bbox"))


def relation_features(relations: DataFrame, members: DataFrame, boxes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """(type, id, kind, is_area, tags, members, bbox, parents); an ``outer`` member makes an area."""
    own = clean_members(members)
    listed = own.groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("pos", "type", "id", "role"))).alias("m"))
    listed = listed.select("rel_id", F.transform("m", lambda c: F.struct(c["type"].alias("type"), c["id"].alias("id"), c["role"].alias("role"))).alias("members"))
    bounds = relation_bounds(own, boxes).withColumnRenamed("rel_id", "box_id")
    base = with_parents(relations, up, "R")
    out = base.join(listed, base["id"] == listed["rel_id"], "left").join(bounds, base["id"] == bounds["box_id"], "left")
    rows = F.coalesce("members", F.array().cast(model.MEMBERS))
    area = F.exists(rows, lambda m: m["role"] == "outer")
    return out.select(F.lit("R").alias("type"), "id", model.kind_of(F.lit("R"), area).alias("kind"), area.alias("is_area"), "tags", rows.alias("members"), "bbox", "parents")


# --- nodes


def node_features(nodes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """Nodes with tags, and those that are members (``up``: ``parents``); the others are only places of ways."""
    own = with_parents(nodes.withColumn("type", F.lit("N")), up, "N").where((F.size("tags") > 0) | (F.size("parents") > 0))
    return own.select("type", "id", F.lit("n").alias("kind"), F.lit(False).alias("is_area"), "tags", "x", "y", "lon", "lat", "parents")


def checked_nodes(nodes: DataFrame, way_nodes: DataFrame, members: DataFrame) -> DataFrame:
    """``nodes`` with is_orphan (no tags, in no way, in no relation) and is_duplicate (an untagged non-member at
    another node's place)."""
    in_way = way_nodes.select(F.col("node_id").alias("id")).distinct().withColumn("in_way", F.lit(True))
    member = members.where("type = 'N'").select("id").distinct().withColumn("is_member", F.lit(True))
    # a place with very many nodes sums up before it is met again
    shared = nodes.groupBy("x", "y").agg(F.count("*").alias("n")).where("n > 1").select("x", "y", F.lit(True).alias("is_shared"))
    out = nodes.join(in_way, "id", "left").join(member, "id", "left").join(shared, ["x", "y"], "left")
    plain = (F.size("tags") == 0) & F.col("is_member").isNull()
    orphan = plain & F.col("in_way").isNull()
    return out.select(*nodes.columns, orphan.alias("is_orphan"), (plain & F.col("is_shared").isNotNull()).alias("is_duplicate"))


def with_check_tags(checked: DataFrame, prefix: str = model.CHECK_KEY) -> DataFrame:
    """Tags ``orphan=yes`` and ``duplicate=yes`` under ``prefix``."""
    tags = F.col("tags")
    for flag, key in (("is_orphan", "orphan"), ("is_duplicate", "duplicate")):
        tags = F.when(F.col(flag), F.map_concat(tags, F.create_map(F.lit(prefix + key), F.lit("yes")))).otherwise(tags)
    return checked.withColumn("tags", tags).drop("is_orphan", "is_duplicate")


# --- all together


def features(nodes: DataFrame, ways: DataFrame, way_nodes: DataFrame, relations: DataFrame, members: DataFrame, indexed=T.INDEXED_KEYS, check: bool = False) -> DataFrame:
    """The feature table; members that nothing is stand in it as missing.

    Members, nodes and ways are stored once: relations need their boxes, and which members are missing their ids.
    """
    if check:
        nodes = with_check_tags(checked_nodes(nodes, way_nodes, members))
    own = stored(clean_members(members), "members")
    up = stored(parents(own), "parents")
    n = stored(model.feature_rows(node_features(nodes, up), indexed), "nodes")
    w = stored(model.feature_rows(way_features(ways, way_nodes, nodes, up), indexed), "ways")
    boxes = n.select("type", "id", "bbox").union(w.select("type", "id", "bbox"))
    r = model.feature_rows(relation_features(relations, own, boxes, up), indexed)
    known = n.select("type", "id").union(w.select("type", "id")).union(relations.select(F.lit("R"), "id"))
    gone = up.join(known, ["type", "id"], "left_anti")
    tags = F.create_map(F.lit(model.CHECK_KEY + "missing"), F.lit("yes"))
    m = model.feature_rows(gone.select("type", "id", model.kind_of(F.col("type"), F.lit(False)).alias("kind"), F.lit(False).alias("is_area"), tags.alias("tags"), F.lit(None).cast(model.BOX).alias("bbox"), "parents", F.lit(True).alias("is_missing")), indexed)
    return n.union(w).union(r).union(m)


# --- tiles


def tile_sets(features: DataFrame, zoom: int = 12) -> DataFrame:
    """(type, id, tiles): the tiles (col, row) that nodes lie in, that ways pass and that relations have through all
    their members."""
    own = features.where("not is_missing")
    point = F.array(F.struct(geo.tile_column("x", zoom).alias("col"), geo.tile_row("y", zoom).alias("row")))
    parts = own.where("type = 'N'").select("type", "id", point.alias("tiles")).union(own.where("type = 'W'").select("type", "id", geo.line_tiles("coords", zoom).alias("tiles")))
    parts = stored(parts, "tile-sets")
    members = own.where("type = 'R'").select(F.col("id").alias("rel_id"), F.explode("members").alias("m")).select("rel_id", "m.type", "m.id")
    below = member_closure(members).where("type != 'R'").join(parts, ["type", "id"]).select("rel_id", F.explode("tiles").alias("t")).distinct()
    return parts.union(below.groupBy(F.lit("R").alias("type"), F.col("rel_id").alias("id")).agg(F.array_sort(F.collect_list("t")).alias("tiles")).select("type", "id", "tiles"))


def node_density(nodes: DataFrame, zoom: int = 12) -> DataFrame:
    """(col, row, n) of the tiles with nodes."""
    return nodes.groupBy(geo.tile_column("x", zoom).alias("col"), geo.tile_row("y", zoom).alias("row")).agg(F.count("*").alias("n"))


def tile_pyramid(density: DataFrame, zooms=(0, 3, 6, 9, 12), max_tiles: int = 64000, min_density: int = 75000, base: int = 12) -> DataFrame:
    """(zoom, col, row, n) of the tiles that are kept: the root, then the densest, ``max_tiles`` in all, each with
    ``min_density`` nodes or more."""
    levels = density.select(F.col("col"), F.col("row"), "n", F.explode(F.array(*map(F.lit, sorted(zooms)))).alias("zoom"))
    sums = levels.groupBy("zoom", F.expr(f"shiftright(col, {base} - zoom)").alias("col"), F.expr(f"shiftright(row, {base} - zoom)").alias("row")).agg(F.sum("n").alias("n"))
    kept = sums.where((F.col("zoom") == 0) | (F.col("n") >= min_density))
    return kept.orderBy((F.col("zoom") != 0), F.desc("n"), "zoom", "col", "row").limit(max_tiles)


def deepest_tile(points: DataFrame, tiles: DataFrame, zooms=(0, 3, 6, 9, 12)) -> DataFrame:
    """``points`` (x, y, ...) with tile_zoom, tile_col, tile_row: the deepest of ``tiles`` that holds each."""
    out, found = points, F.lit(None).cast("struct<zoom:int,col:int,row:int>")
    for z in sorted(zooms):
        # a tile set has ``max_tiles`` rows at most, so each zoom's part is small by construction
        here = tiles.where(F.col("zoom") == z).select(F.col("col").alias(f"col_{z}"), F.col("row").alias(f"row_{z}"), F.lit(z).alias(f"at_{z}"))
        out = out.join(F.broadcast(here), (geo.tile_column("x", z) == F.col(f"col_{z}")) & (geo.tile_row("y", z) == F.col(f"row_{z}")), "left")
        found = F.when(F.col(f"at_{z}").isNotNull(), F.struct(F.lit(z).alias("zoom"), F.col(f"col_{z}").alias("col"), F.col(f"row_{z}").alias("row"))).otherwise(found)
    return out.withColumn("found_tile", found).select(*points.columns, F.col("found_tile.zoom").alias("tile_zoom"), F.col("found_tile.col").alias("tile_col"), F.col("found_tile.row").alias("tile_row"))


def key_buckets(features: DataFrame, most: int = 6, least_features: int = 300, single: bool = False) -> DataFrame:
    """(tile, kind, key_bits, bucket, n): in each tile and kind the ``most - 1`` largest key groups of
    ``least_features`` or more have a bucket of their own, the others share ``mixed``.

    ``single`` (the newer scheme): features of several categories are ``mixed`` from the start."""
    groups = features.groupBy("tile", "kind", "key_bits").agg(F.count("*").alias("n"))
    one = F.bit_count("key_bits") <= 1 if single else F.lit(True)
    rank = F.row_number().over(W.partitionBy("tile", "kind").orderBy(~one, F.desc("n"), "key_bits"))
    own = (rank <= max(1, most - 1)) & (F.col("n") >= least_features) & one
    return groups.withColumn("bucket", F.when(own, F.col("key_bits").cast("string")).otherwise("mixed"))


def spatial_order(x: Column, y: Column, bits: int = 16) -> Column:
    """A Morton key: sorting files by it keeps near features together, so that min/max prune."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        bit_x = F.shiftright(x + F.lit(geo.HALF), 31 - k).bitwiseAND(F.lit(1))
        bit_y = F.shiftright(y + F.lit(geo.HALF), 31 - k).bitwiseAND(F.lit(1))
        out = F.shiftleft(out, 2).bitwiseOR(F.shiftleft(bit_x, 1)).bitwiseOR(bit_y)
    return out
