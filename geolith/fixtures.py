"""Features derived from the test tables, which hold no geography of their own: the input of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolith import model
from geolith.functions import geo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str, duplicates: bool = False) -> DataFrame:
    """(id, lon, lat, x, y, tags); with ``duplicates`` every fiftieth stands where the one before it does."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey")
    k = F.when((key % 50 == 0) & (key > 0), key - 1).otherwise(key) if duplicates else key
    tagged = F.create_map(F.lit("name"), "p_name", F.lit("shop"), F.lower("p_type"), F.lit("brand"), "p_brand", F.lit("level"), F.col("p_size").cast("string"))
    out = p.select(
        (key + 1).alias("id"),
        ((((k * 7919) % 36000) - 18000).cast("double") / 100).alias("lon"),
        ((((k * 104729) % 16000) - 8000).cast("double") / 100).alias("lat"),
        F.when(key % 4 == 0, model.no_tags()).otherwise(tagged).alias("tags"),
    )
    return out.select("id", "lon", "lat", geo.x_of("lon").alias("x"), geo.y_of("lat").alias("y"), "tags")


def way_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(way_id, pos, node_id); every third way with three nodes or more ends where it begins.

    Items alike in number and part are the same node, so no more columns need to order them.
    """
    by_way = W.partitionBy("l_orderkey")
    own = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") + 1).alias("way_id"),
        F.row_number().over(by_way.orderBy("l_linenumber", "l_partkey")).alias("pos"),
        (F.col("l_partkey") + 1).alias("node_id"),
        F.count("*").over(by_way).cast("int").alias("n"),
    )
    closing = (F.col("pos") == 1) & (F.col("way_id") % 3 == 0) & (F.col("n") >= 3)
    places = F.when(closing, F.array("pos", F.col("n") + 1)).otherwise(F.array("pos"))
    return own.select("way_id", F.explode(places).alias("pos"), "node_id")


def ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tags); rings are buildings."""
    o = table(spark, sf_dir, "orders")
    counts = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").count()
    joined = o.join(counts, o["o_orderkey"] == counts["l_orderkey"], "left")
    way = F.col("o_orderkey") + 1
    base = F.create_map(F.lit("highway"), "o_orderpriority", F.lit("status"), "o_orderstatus")
    ring = F.create_map(F.lit("highway"), "o_orderpriority", F.lit("status"), "o_orderstatus", F.lit("building"), F.lit("yes"))
    return joined.select(way.alias("id"), F.when((way % 3 == 0) & (F.coalesce("count", F.lit(0)) >= 3), ring).otherwise(base).alias("tags"))


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, tags) of three levels: customers, nations, regions."""
    one = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("id"), F.create_map(F.lit("route"), F.lower("c_mktsegment")).alias("tags"))
    two = table(spark, sf_dir, "nation").select((F.lit(1000000) + F.col("n_nationkey")).cast("long").alias("id"), F.create_map(F.lit("boundary"), F.lit("nation"), F.lit("name"), F.col("n_name")).alias("tags"))
    three = table(spark, sf_dir, "region").select((F.lit(2000000) + F.col("r_regionkey")).cast("long").alias("id"), F.create_map(F.lit("boundary"), F.lit("region"), F.lit("name"), F.col("r_name")).alias("tags"))
    return one.union(two).union(three)


def members(spark: SparkSession, sf_dir: str, cycles: bool = False) -> DataFrame:
    """(rel_id, pos, type, id, role); with ``cycles`` nations refer back to their region."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    role = F.when(F.col("o_orderstatus") == "F", "outer").when(F.col("o_orderstatus") == "O", "inner").otherwise("")
    one = o.select((F.col("o_custkey") + 1).alias("rel_id"), F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).alias("pos"), F.lit("W").alias("type"), (F.col("o_orderkey") + 1).alias("id"), role.alias("role"))
    two = c.select((F.lit(1000000) + F.col("c_nationkey")).cast("long").alias("rel_id"), F.row_number().over(W.partitionBy("c_nationkey").orderBy("c_custkey")).alias("pos"), F.lit("R").alias("type"), (F.col("c_custkey") + 1).alias("id"), F.lit("subarea").alias("role"))
    three = n.select((F.lit(2000000) + F.col("n_regionkey")).cast("long").alias("rel_id"), F.row_number().over(W.partitionBy("n_regionkey").orderBy("n_nationkey")).alias("pos"), F.lit("R").alias("type"), (F.lit(1000000) + F.col("n_nationkey")).cast("long").alias("id"), F.lit("subarea").alias("role"))
    out = one.union(two).union(three)
    if cycles:
        out = out.union(n.select((F.lit(1000000) + F.col("n_nationkey")).cast("long"), F.lit(1000000), F.lit("R"), (F.lit(2000000) + F.col("n_regionkey")).cast("long"), F.lit("parent")))
    return out


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(change, type, id, version, user, tags, x, y): node changes from the events."""
    e = table(spark, sf_dir, "events")
    change = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "delete").otherwise("modify")
    k = F.col("event_id")
    tags = F.map_filter(F.create_map(F.lit("note"), F.get_json_object("props", "$.k"), F.lit("event"), F.col("event_type")), lambda a, b: b.isNotNull())
    out = e.select(
        change.alias("change"),
        F.lit("N").alias("type"),
        (F.col("user_id") + 1).alias("id"),
        F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")).alias("version"),
        (F.col("user_id") % 100).alias("user"),
        tags.alias("tags"),
        ((((k * 7919) % 36000) - 18000).cast("double") / 100).alias("lon"),
        ((((k * 104729) % 16000) - 8000).cast("double") / 100).alias("lat"),
    )
    return out.select("change", "type", "id", "version", "user", "tags", geo.x_of("lon").alias("x"), geo.y_of("lat").alias("y"))
