"""What a selection refers to, all the way down, and ids for the nodes that have none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.operators.build import reached
from geolith.work import stored


def referenced(selected: DataFrame, members: DataFrame, way_nodes: DataFrame) -> DataFrame:
    """(type, id): the selection, the members of its relations however deep, and the nodes of all ways; each once."""
    found = reached(members, selected)
    ways = found.where("type = 'W'").select(F.col("id").alias("way_id"))
    nodes = way_nodes.join(ways, "way_id", "left_semi").select(F.lit("N").alias("type"), F.col("node_id").alias("id"))
    return found.union(nodes).distinct()


def with_references(features: DataFrame, selected: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(features, places): the selection with all that it refers to, and the places (id, x, y) of ways' nodes that are
    no features, so that a file of both refers to nothing outside.

    Ways stored without the ids of their nodes get them here: that of the node feature at a place, else a new one.
    """
    own = features.where("not is_missing")
    members = own.where("type = 'R'").select(F.col("id").alias("rel_id"), F.explode("members").alias("m")).select("rel_id", "m.type", "m.id")
    found = stored(reached(members, selected), "references")
    whole = stored(own.join(found, ["type", "id"], "left_semi").select(*features.columns), "references")
    points, ways = own.where("type = 'N'"), whole.where("type = 'W'")
    bare = ways.where("node_ids is null").select(F.col("id").alias("way_id"), F.posexplode("coords").alias("pos", "c")).select("way_id", "pos", "c.x", "c.y")
    named = points.groupBy("x", "y").agg(F.min("id").alias("node_id"))
    highest = points.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    rest = bare.join(named, ["x", "y"], "left_anti")
    ids = named.union(synthetic_ids(rest, highest)).toDF("x", "y", "node_id")
    lists = bare.join(ids, ["x", "y"]).groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("own"))
    lists = lists.select(F.col("way_id").alias("of_way"), F.transform("own", lambda c: c["node_id"]).alias("made_ids"))
    ways = ways.join(lists, F.col("id") == F.col("of_way"), "left").withColumn("node_ids", F.coalesce("node_ids", "made_ids")).select(*features.columns)
    ways = stored(ways, "references")
    each = ways.select(F.explode(F.arrays_zip("node_ids", "coords")).alias("z")).select(F.col("z.node_ids").alias("id"), "z.coords.x", "z.coords.y")
    nodes = each.groupBy("id").agg(F.min(F.struct("x", "y")).alias("c")).select("id", "c.x", "c.y")
    more = points.join(nodes.select("id"), "id", "left_semi").select(*features.columns)
    kept = whole.where("type = 'N'").union(more).dropDuplicates(["id"])
    places = nodes.join(points.select("id"), "id", "left_anti")
    return kept.union(ways).union(whole.where("type = 'R'")), places


def synthetic_ids(places: DataFrame, after: int, zoom: int = 12) -> DataFrame:
    """(x, y, id): ids from ``after + 1`` on for distinct places, in order of x and y, with none left out.

    Places are numbered within columns of tiles, and the columns' counts (2 ** zoom at most) give the offsets.
    """
    own = places.select("x", "y").distinct().withColumn("c", geo.tile_column("x", zoom))
    counts = own.groupBy("c").agg(F.count("*").alias("n"))
    offsets = counts.select("c", (F.sum("n").over(W.orderBy("c")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("c").orderBy("x", "y"))
    return own.withColumn("r", rank).join(F.broadcast(offsets), "c").select("x", "y", (F.col("before") + F.col("r") + F.lit(after)).cast("long").alias("id"))
