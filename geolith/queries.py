"""The registered queries, each with the SQL that gives the same rows.

Features are derived from the test tables (``fixtures``); the SQL derives them again, on its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith import fixtures as X
from geolith import model
from geolith.functions import geo
from geolith.functions import tags as T
from geolith.operators import build, changes, closure, query, reports, stats
from geolith.sinks import formats
from geolith.sources import library

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def registered(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# --- SQL of the derived tables

NODE_SQL = """
n{0} AS (
  SELECT id, lon, lat, CAST(round(lon / 360 * 4294967296) AS BIGINT) AS x, CAST(round(ln(tan(pi() / 4 + lat * (pi() / 360))) / pi() * 2147483648) AS BIGINT) AS y, name, shop, brand, level, tagged
  FROM (
    SELECT p_partkey + 1 AS id, CAST((k * 7919) % 36000 - 18000 AS DOUBLE) / 100 AS lon, CAST((k * 104729) % 16000 - 8000 AS DOUBLE) / 100 AS lat,
      CASE WHEN tagged THEN p_name END AS name, CASE WHEN tagged THEN lower(p_type) END AS shop, CASE WHEN tagged THEN p_brand END AS brand, CASE WHEN tagged THEN CAST(p_size AS VARCHAR) END AS level, tagged
    FROM (SELECT *, {1} AS k, p_partkey % 4 <> 0 AS tagged FROM part)))"""
N = NODE_SQL.format("", "p_partkey")
ND = NODE_SQL.format("d", "CASE WHEN p_partkey % 50 = 0 AND p_partkey > 0 THEN p_partkey - 1 ELSE p_partkey END")
WN = """
wn0 AS (
  SELECT l_orderkey + 1 AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax, l_shipdate, l_returnflag, l_linestatus) AS pos,
    l_partkey + 1 AS node_id, count(*) OVER (PARTITION BY l_orderkey) AS n
  FROM lineitem),
wn AS (SELECT way_id, pos, node_id FROM wn0 UNION ALL SELECT way_id, n + 1, node_id FROM wn0 WHERE pos = 1 AND way_id % 3 = 0 AND n >= 3)"""
WAYS = """
w AS (
  SELECT o_orderkey + 1 AS id, o_orderpriority AS highway, o_orderstatus AS status, coalesce(c, 0) AS n0, (o_orderkey + 1) % 3 = 0 AND coalesce(c, 0) >= 3 AS ring
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS c FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey),
wf AS (SELECT * FROM w WHERE n0 >= 2)"""
PT = """
pt AS (SELECT way_id, pos, node_id, x, y, x * (360 / 4294967296.0::DOUBLE) AS plon, degrees(2 * atan(exp(y * (pi() / 2147483648))) - pi() / 2) AS plat FROM wn JOIN n ON n.id = node_id)"""
MEM = """
m AS (
  SELECT o_custkey + 1 AS rel_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, 'W' AS type, o_orderkey + 1 AS id, CASE o_orderstatus WHEN 'F' THEN 'outer' WHEN 'O' THEN 'inner' ELSE '' END AS role FROM orders
  UNION ALL SELECT 1000000 + c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey), 'R', c_custkey + 1, 'subarea' FROM customer
  UNION ALL SELECT 2000000 + n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 'R', 1000000 + n_nationkey, 'subarea' FROM nation)"""
REL = """
r AS (
  SELECT c_custkey + 1 AS id, lower(c_mktsegment) AS route, NULL AS boundary, NULL AS name FROM customer
  UNION ALL SELECT 1000000 + n_nationkey, NULL, 'nation', n_name FROM nation
  UNION ALL SELECT 2000000 + r_regionkey, NULL, 'region', r_name FROM region)"""
REACH = """
reach AS (
  SELECT rel_id, type, id FROM m
  UNION SELECT a.rel_id, b.type, b.id FROM m a JOIN m b ON a.type = 'R' AND a.id = b.rel_id
  UNION SELECT a.rel_id, c.type, c.id FROM m a JOIN m b ON a.type = 'R' AND a.id = b.rel_id JOIN m c ON b.type = 'R' AND b.id = c.rel_id)"""
CH = """
c AS (
  SELECT CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'modify' END AS change, user_id + 1 AS id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS version, user_id % 100 AS u,
    json_extract_string(props, '$.k') AS note, event_type AS event, CAST(round(lon / 360 * 4294967296) AS BIGINT) AS x, CAST(round(ln(tan(pi() / 4 + lat * (pi() / 360))) / pi() * 2147483648) AS BIGINT) AS y
  FROM (SELECT *, CAST((event_id * 7919) % 36000 - 18000 AS DOUBLE) / 100 AS lon, CAST((event_id * 104729) % 16000 - 8000 AS DOUBLE) / 100 AS lat FROM events)),
latest AS (
  SELECT CASE WHEN created AND change = 'modify' THEN 'create' ELSE change END AS change, id, version, note, event, x, y
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY version DESC) AS rn, bool_or(change = 'create') OVER (PARTITION BY id) AS created FROM c)
  WHERE rn = 1 AND NOT (created AND change = 'delete'))"""


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


# --- derived tables as features


def node_rows(spark: SparkSession, d: str) -> DataFrame:
    return model.feature_rows(build.node_features(X.nodes(spark, d)))


def way_rows(spark: SparkSession, d: str) -> DataFrame:
    return model.feature_rows(build.way_features(X.ways(spark, d), X.way_nodes(spark, d), X.nodes(spark, d)))


def relation_rows(spark: SparkSession, d: str) -> DataFrame:
    """Without bounds, for queries that need none."""
    own = X.members(spark, d).groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("pos", "type", "id", "role"))).alias("m"))
    r = X.relations(spark, d).join(own, F.col("id") == F.col("rel_id"), "left")
    rows = F.coalesce(F.transform("m", lambda c: F.struct(c["type"].alias("type"), c["id"].alias("id"), c["role"].alias("role"))), F.array().cast(model.MEMBERS))
    area = F.exists(rows, lambda m: m["role"] == "outer")
    return r.select(F.lit("R").alias("type"), "id", model.kind_of(F.lit("R"), area).alias("kind"), area.alias("is_area"), "tags", rows.alias("members"))


def box_columns(df: DataFrame, *before: str) -> DataFrame:
    return df.select(*before, *[F.col(f"bbox.{c}").alias(c) for c in ("minx", "miny", "maxx", "maxy")])


# --- selection


@registered(with_(N) + " SELECT 'N' AS t, id FROM n WHERE shop IS NOT NULL")
def select_nodes_tag_present(spark, d):
    return query.select(node_rows(spark, d), "n[shop]").select(F.col("type").alias("t"), "id")


@registered(with_(N) + " SELECT 'N' AS t, id FROM n WHERE shop = 'promo'")
def select_nodes_tag_equals(spark, d):
    return query.select(node_rows(spark, d), "n[shop=promo]").select(F.col("type").alias("t"), "id")


@registered(with_(N, WAYS) + " SELECT 'N' AS t, id FROM n WHERE level = '7' UNION ALL SELECT 'W', id FROM wf WHERE ring AND highway = '1-URGENT'")
def select_multi_type(spark, d):
    all_rows = node_rows(spark, d).unionByName(way_rows(spark, d))
    return query.select(all_rows, "n[level=7]; a[highway=1-URGENT]").select(F.col("type").alias("t"), "id")


@registered(with_(N) + " SELECT 'N' AS t, id FROM n WHERE shop = 'promo' AND level = '7'")
def select_and_clauses(spark, d):
    return query.select(node_rows(spark, d), "n[shop=promo][level=7]").select(F.col("type").alias("t"), "id")


@registered(with_(N, WAYS) + " SELECT 'N' AS t, id FROM n WHERE shop = 'promo' UNION ALL SELECT 'W', id FROM wf WHERE false")
def select_pruned_by_key_bits(spark, d):
    all_rows = node_rows(spark, d).unionByName(way_rows(spark, d))
    return query.select(all_rows, "*[shop=promo]", T.INDEXED_KEYS).select(F.col("type").alias("t"), "id")


BOX = "-30,-20,40,50"
BOX_SQL = "x BETWEEN {} AND {} AND y BETWEEN {} AND {}".format(*[geo.bbox_of(BOX)[k] for k in (0, 2, 1, 3)])


@registered(with_(N) + f" SELECT id FROM n WHERE tagged AND {BOX_SQL}")
def filter_bbox(spark, d):
    return query.within(node_rows(spark, d), BOX).select("id")


@registered(with_(N) + " SELECT id FROM n WHERE tagged AND (x + 2147483648) >> 29 = 4 AND (2147483647 - y) >> 29 = 3")
def filter_tile(spark, d):
    return query.within(node_rows(spark, d), "3/4/3").select("id")


@registered(with_(N) + f" SELECT id FROM n WHERE tagged AND {BOX_SQL}")
def filter_polygon_rect(spark, d):
    x0, y0, x1, y1 = geo.bbox_of(BOX)
    return query.within(node_rows(spark, d), area=[[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]]).select("id")


@registered(with_(N) + " SELECT id, name FROM n WHERE shop IS NOT NULL ORDER BY id LIMIT 25")
def top_limit_ordered(spark, d):
    return query.limited(query.select(node_rows(spark, d), "n[shop]").orderBy("id"), 25).select("id", F.col("tags")["name"].alias("name"))


# --- projection


@registered(with_(N) + " SELECT 'N' AS t, id, name, shop FROM n WHERE tagged")
def project_exact(spark, d):
    return query.projected(node_rows(spark, d), "name,shop")


@registered(with_(N) + " SELECT 'N' AS t, id, 'name=' || name AS wild, brand, 'level=' || level || ',shop=' || shop AS rest FROM n WHERE tagged")
def project_wildcard(spark, d):
    return query.projected(node_rows(spark, d), "n*e,brand,*").withColumnsRenamed({"n*e": "wild", "*": "rest"})


@registered(with_(N) + " SELECT 'N' AS t, id, 'brand=' || brand || ',level=' || level || ',name=' || name || ',shop=' || shop AS everything FROM n WHERE tagged")
def project_any(spark, d):
    return query.projected(node_rows(spark, d)).withColumnRenamed("*", "everything")


@registered(with_(N) + " SELECT id, round(lon, 5) AS lon, round(lat, 5) AS lat, x, y FROM n WHERE tagged")
def project_lonlat(spark, d):
    return node_rows(spark, d).select("id", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "x", "y")


# --- ways and relations


@registered(with_(N, WN, WAYS, PT) + " SELECT w.id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM wf w JOIN pt ON w.id = way_id GROUP BY w.id")
def way_bounds(spark, d):
    return box_columns(build.way_bounds(X.way_nodes(spark, d), X.nodes(spark, d)).withColumnRenamed("way_id", "id"), "id")


@registered(with_(WAYS) + " SELECT id, ring AS is_area, CASE WHEN ring THEN 'a' ELSE 'w' END AS kind FROM wf")
def way_is_area(spark, d):
    return way_rows(spark, d).select("id", "is_area", "kind")


LENGTH = """
seg AS (SELECT way_id, pos, x, y, plon, plat, lead(x) OVER o AS x2, lead(y) OVER o AS y2, lead(plon) OVER o AS lon2, lead(plat) OVER o AS lat2 FROM pt WINDOW o AS (PARTITION BY way_id ORDER BY pos)),
len AS (
  SELECT way_id, sum(12742017.6 * asin(sqrt(least(1, pow(sin((radians(lat2) - radians(plat)) / 2), 2) + cos(radians(plat)) * cos(radians(lat2)) * pow(sin(radians(lon2 - plon) / 2), 2))))) AS m
  FROM seg WHERE lon2 IS NOT NULL GROUP BY way_id),
box AS (SELECT way_id, min(y) AS miny, max(y) AS maxy FROM pt GROUP BY way_id),
area AS (
  SELECT seg.way_id, abs(sum(CAST(x AS DOUBLE) * y2 - CAST(x2 AS DOUBLE) * y)) / 2 * pow(2 * pi() * 6378137.0 / 4294967296, 2) * pow(cos(radians(degrees(2 * atan(exp((any_value(miny) + any_value(maxy)) / 2 * (pi() / 2147483648))) - pi() / 2))), 2) AS m2
  FROM seg JOIN box ON seg.way_id = box.way_id WHERE x2 IS NOT NULL GROUP BY seg.way_id)"""


@registered(with_(N, WN, WAYS, PT, LENGTH) + " SELECT id, round(m / 1000, 3) AS km FROM wf JOIN len ON id = way_id WHERE NOT ring")
def way_length(spark, d):
    return query.select(way_rows(spark, d), "w").select("id", F.round(geo.length_m("coords") / 1000, 3).alias("km"))


@registered(with_(N, WN, WAYS, PT, LENGTH) + " SELECT id, round(m2 / 1000000, 1) AS km2 FROM wf JOIN area ON id = way_id WHERE ring")
def way_area(spark, d):
    return query.select(way_rows(spark, d), "a").select("id", F.round(geo.area_m2("coords") / 1000000, 1).alias("km2"))


@registered(with_(N, WN, WAYS, PT, MEM, REACH) + " SELECT rel_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM reach JOIN wf ON type = 'W' AND reach.id = wf.id JOIN pt ON wf.id = way_id GROUP BY rel_id")
def relation_bounds(spark, d):
    boxes = build.way_bounds(X.way_nodes(spark, d), X.nodes(spark, d)).select(F.lit("W").alias("type"), F.col("way_id").alias("id"), "bbox")
    return box_columns(build.relation_bounds(X.members(spark, d), boxes), "rel_id")


@registered(with_(REL, MEM) + " SELECT r.id, coalesce(bool_or(role = 'outer'), false) AS is_area FROM r LEFT JOIN m ON r.id = rel_id GROUP BY r.id")
def relation_is_area(spark, d):
    return relation_rows(spark, d).select("id", "is_area")


@registered(with_(N, WN, WAYS, PT, REL, MEM, REACH) + """
, b AS (SELECT rel_id, min(x) AS minx, max(y) AS maxy FROM reach JOIN wf ON type = 'W' AND reach.id = wf.id JOIN pt ON wf.id = way_id GROUP BY rel_id),
wb AS (SELECT way_id, min(x) AS minx, max(y) AS maxy FROM pt GROUP BY way_id)
SELECT 'N' AS type, id, 'n' AS kind, false AS is_missing, 0 AS n_parents, x AS minx, y AS maxy FROM n WHERE tagged
UNION ALL SELECT 'W', id, CASE WHEN ring THEN 'a' ELSE 'w' END, false, 1, minx, maxy FROM wf JOIN wb ON id = way_id
UNION ALL SELECT 'W', id, 'w', true, 1, NULL, NULL FROM w WHERE n0 < 2
UNION ALL SELECT 'R', r.id, CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.rel_id = r.id AND role = 'outer') THEN 'a' ELSE 'r' END, false, CASE WHEN r.id < 2000000 THEN 1 ELSE 0 END, minx, maxy FROM r LEFT JOIN b ON r.id = b.rel_id""")
def feature_build(spark, d):
    """The whole build, in one table."""
    f = build.features(X.nodes(spark, d), X.ways(spark, d), X.way_nodes(spark, d), X.relations(spark, d), X.members(spark, d))
    return f.select("type", "id", "kind", "is_missing", F.size("parents").alias("n_parents"), F.col("bbox.minx").alias("minx"), F.col("bbox.maxy").alias("maxy"))


@registered(with_(MEM) + " SELECT type, id, count(DISTINCT rel_id) AS n_parents, min(rel_id) AS first_parent FROM m GROUP BY type, id")
def parents_of_member(spark, d):
    return build.parents(X.members(spark, d)).select("type", "id", F.size("parents").cast("long").alias("n_parents"), F.element_at("parents", 1).alias("first_parent"))


@registered(with_(WAYS, MEM) + " SELECT DISTINCT type, id FROM m WHERE type = 'W' AND id NOT IN (SELECT id FROM wf)")
def members_missing(spark, d):
    f = way_rows(spark, d).select("type", "id").union(X.relations(spark, d).select(F.lit("R"), "id"))
    return build.missing(X.members(spark, d), f)


@registered(with_(MEM, REACH) + " SELECT rel_id, type, count(*) AS n, max(id) AS last_id FROM reach GROUP BY rel_id, type")
def super_relation_closure(spark, d):
    return build.member_closure(X.members(spark, d)).groupBy("rel_id", "type").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


@registered(with_(MEM) + """
,
mc AS (SELECT rel_id, type, id FROM m UNION ALL SELECT 1000000 + n_nationkey, 'R', 2000000 + n_regionkey FROM nation),
step AS (SELECT rel_id, type, id FROM mc UNION SELECT a.rel_id, b.type, b.id FROM mc a JOIN mc b ON a.type = 'R' AND a.id = b.rel_id),
reach AS (SELECT rel_id, type, id FROM step UNION SELECT a.rel_id, b.type, b.id FROM step a JOIN step b ON a.type = 'R' AND a.id = b.rel_id)
SELECT rel_id, type, count(*) AS n FROM (SELECT * FROM reach UNION SELECT a.rel_id, b.type, b.id FROM reach a JOIN step b ON a.type = 'R' AND a.id = b.rel_id) GROUP BY rel_id, type""")
def closure_with_cycles(spark, d):
    return build.member_closure(X.members(spark, d, cycles=True)).groupBy("rel_id", "type").agg(F.count("*").alias("n"))


@registered(with_(WN, REL, MEM, REACH) + """
, roots AS (SELECT id FROM r WHERE boundary IS NOT NULL),
f AS (SELECT 'R' AS type, id FROM roots UNION SELECT type, id FROM reach WHERE rel_id IN (SELECT id FROM roots))
SELECT type, id FROM f UNION SELECT 'N', node_id FROM wn WHERE way_id IN (SELECT id FROM f WHERE type = 'W')""")
def xml_closure(spark, d):
    roots = query.select(relation_rows(spark, d), "*[boundary]").select("type", "id")
    return closure.referenced(roots, X.members(spark, d), X.way_nodes(spark, d))


@registered(with_(N) + " SELECT x, y, 9000000 + row_number() OVER (ORDER BY x, y) AS id FROM (SELECT DISTINCT x, y FROM n WHERE NOT tagged)")
def synthetic_ids(spark, d):
    return closure.synthetic_ids(X.nodes(spark, d).where("size(tags) = 0"), 9_000_000)


# --- cleaning


@registered(with_(WAYS) + " SELECT id, 'few nodes' AS reason FROM w WHERE n0 < 2")
def ways_rejected(spark, d):
    return build.rejected_ways(X.ways(spark, d), X.way_nodes(spark, d), X.nodes(spark, d))


@registered(with_(WAYS, REL, MEM) + " SELECT rel_id AS id FROM m LEFT JOIN wf ON m.type = 'W' AND m.id = wf.id GROUP BY rel_id HAVING count(wf.id) = 0 AND bool_and(m.type = 'W')")
def relations_rejected(spark, d):
    return build.rejected_relations(X.relations(spark, d), X.members(spark, d), way_rows(spark, d))


@registered(with_(MEM) + " SELECT rel_id, count(*) AS n FROM m GROUP BY rel_id")
def self_refs_removed(spark, d):
    m = X.members(spark, d)
    looped = m.union(m.select("rel_id", F.lit(0), F.lit("R"), "rel_id", F.lit("self")))
    return build.clean_members(looped).groupBy("rel_id").agg(F.count("*").alias("n"))


@registered(with_(REL, MEM) + " SELECT id, EXISTS (SELECT 1 FROM m WHERE m.type = 'R' AND m.id = r.id) AS is_kept FROM r WHERE id NOT IN (SELECT rel_id FROM m)")
def empty_relations(spark, d):
    return build.empty_relations(X.relations(spark, d), X.members(spark, d))


@registered(with_(ND, WN) + """
SELECT id, NOT tagged AND id NOT IN (SELECT node_id FROM wn) AS is_orphan, NOT tagged AND count(*) OVER (PARTITION BY x, y) > 1 AS is_duplicate FROM nd""")
def dup_orphan_nodes(spark, d):
    return build.checked_nodes(X.nodes(spark, d, duplicates=True), X.way_nodes(spark, d), X.members(spark, d)).select("id", "is_orphan", "is_duplicate")


# --- tiles and indexes

TILE = "(x + 2147483648) >> (32 - {0}) AS {1}, (2147483647 - y) >> (32 - {0}) AS {2}"
DENSITY = f"density AS (SELECT {TILE.format(12, 'c', 'r')}, count(*) AS k FROM n GROUP BY ALL)"
PYRAMID = f"""
{DENSITY},
pyramid AS (
  SELECT zoom, c >> (12 - zoom) AS c, r >> (12 - zoom) AS r, sum(k) AS k FROM density, (VALUES (0), (3), (6), (9), (12)) AS z(zoom) GROUP BY ALL),
tiles AS (SELECT * FROM pyramid WHERE zoom = 0 OR k >= 10 ORDER BY zoom <> 0, k DESC, zoom, c, r LIMIT 40)"""


@registered(with_(N, DENSITY) + " SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, k AS n FROM density")
def node_density(spark, d):
    return build.node_density(X.nodes(spark, d))


def tile_set(spark: SparkSession, d: str) -> DataFrame:
    return build.tile_pyramid(build.node_density(X.nodes(spark, d)), max_tiles=40, min_density=10)


@registered(with_(N, PYRAMID) + " SELECT zoom, CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, CAST(k AS BIGINT) AS n FROM tiles")
def tile_pyramid(spark, d):
    return tile_set(spark, d)


@registered(with_(N, PYRAMID) + """
SELECT id, max(zoom) AS tile_zoom FROM n JOIN tiles ON (x + 2147483648) >> (32 - zoom) = c AND (2147483647 - y) >> (32 - zoom) = r GROUP BY id""")
def tile_of_feature(spark, d):
    return build.deepest_tile(X.nodes(spark, d).select("id", "x", "y"), tile_set(spark, d)).select("id", "tile_zoom")


@registered(with_(WAYS) + """
, g AS (SELECT CASE WHEN ring THEN 'a' ELSE 'w' END AS kind, CASE WHEN ring THEN 2 + 2097152 ELSE 2 END AS key_bits, count(*) AS n FROM wf GROUP BY ALL)
SELECT kind, key_bits, n, CASE WHEN n >= 300 THEN CAST(key_bits AS VARCHAR) ELSE 'mixed' END AS bucket FROM g""")
def key_buckets(spark, d):
    rows = way_rows(spark, d).withColumn("tile", F.lit("0/0/0"))
    return build.key_buckets(rows).select("kind", "key_bits", "n", "bucket")


@registered(with_(N, WAYS) + """
, f AS (
  SELECT 'n' AS kind, CASE WHEN shop IS NOT NULL THEN ['shop'] ELSE [] END AS own FROM n WHERE tagged
  UNION ALL SELECT CASE WHEN ring THEN 'a' ELSE 'w' END, CASE WHEN ring THEN ['highway', 'building'] ELSE ['highway'] END FROM wf),
e AS (SELECT kind, unnest(CASE WHEN len(own) > 1 THEN list_append(own, '(multiple)') WHEN len(own) = 0 THEN ['(unindexed)'] ELSE own END) AS key FROM f),
a AS (SELECT kind, key FROM e UNION ALL SELECT 'all', key FROM e),
t AS (SELECT kind, count(*) AS k FROM f GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM f)
SELECT a.kind, key, count(*) AS n, round(count(*) / any_value(k), 6) AS of_kind FROM a JOIN t ON a.kind = t.kind GROUP BY a.kind, key""")
def index_report(spark, d):
    out = reports.index_report(node_rows(spark, d).unionByName(way_rows(spark, d)))
    return out.withColumn("of_kind", F.round("of_kind", 6))


# --- tallies


def shares(df: DataFrame, **names: str) -> DataFrame:
    return df.withColumn("share", F.round("share", 6)).withColumnsRenamed(names)


@registered(with_(WAYS) + """
, g AS (SELECT status, count(*) AS k FROM wf GROUP BY 1)
SELECT status, CAST(k AS DOUBLE) AS tally, round(k / sum(k) OVER (), 6) AS share, 'row' AS kind FROM g UNION ALL SELECT '', CAST(sum(k) AS DOUBLE), 1, 'total' FROM g""")
def stats_count(spark, d):
    return shares(stats.tally(way_rows(spark, d), "count", "status"), g0="status")


@registered(with_(N, WN, WAYS, PT, LENGTH) + """
, g AS (SELECT highway, sum(m) / 1000 AS k FROM wf JOIN len ON id = way_id WHERE NOT ring GROUP BY 1)
SELECT highway, round(k, 1) AS tally, round(k / sum(k) OVER (), 6) AS share, 'row' AS kind FROM g UNION ALL SELECT '', round(sum(k), 1), 1, 'total' FROM g""")
def stats_length(spark, d):
    out = stats.tally(query.select(way_rows(spark, d), "w"), "length", "highway", unit="km")
    return shares(out.withColumn("tally", F.round("tally", 1)), g0="highway")


@registered(with_(N, WN, WAYS, PT, LENGTH) + """
, g AS (SELECT status, sum(m2) * 0.0000010 AS k FROM wf JOIN area ON id = way_id WHERE ring GROUP BY 1)
SELECT status, round(k, -2) AS tally, round(k / sum(k) OVER (), 6) AS share, 'row' AS kind FROM g UNION ALL SELECT '', round(sum(k), -2), 1, 'total' FROM g""")
def stats_area(spark, d):
    out = stats.tally(query.select(way_rows(spark, d), "a"), "area", "status", unit="km")
    return shares(out.withColumn("tally", F.round("tally", -2)), g0="status")


@registered(with_(REL, MEM) + """
, g AS (SELECT coalesce(route, '-') AS route, CASE role WHEN '' THEN '(empty)' ELSE role END AS role, count(*) AS tally, count(DISTINCT rel_id) AS relations FROM r JOIN m ON r.id = rel_id GROUP BY 1, 2)
SELECT route, role, tally, relations, round(tally / sum(tally) OVER (), 6) AS share, 'row' AS kind FROM g
UNION ALL SELECT '', '', (SELECT count(*) FROM m), (SELECT count(*) FROM r), 1, 'total'""")
def stats_roles(spark, d):
    return shares(stats.roles(relation_rows(spark, d), "route", cut=stats.CutOff(0, 0)), g0="route")


KV = """
kv AS (SELECT 'highway' AS key, highway AS value FROM wf UNION ALL SELECT 'status', status FROM wf UNION ALL SELECT 'building', 'yes' FROM wf WHERE ring)"""


@registered(with_(WAYS, KV) + """
, k AS (SELECT key, count(*) AS n FROM kv GROUP BY 1), v AS (SELECT key, value, count(*) AS n FROM kv GROUP BY 1, 2), t AS (SELECT count(*) AS n FROM wf)
SELECT key, NULL AS value, k.n AS tally, NULL::DOUBLE AS of_key, round(k.n / t.n, 6) AS of_all FROM k, t
UNION ALL SELECT v.key, value, v.n, round(v.n / k.n, 6), round(v.n / t.n, 6) FROM v JOIN k ON v.key = k.key, t""")
def stats_keys(spark, d):
    out = stats.keys(way_rows(spark, d))
    return out.withColumn("of_key", F.round("of_key", 6)).withColumn("of_all", F.round("of_all", 6))


@registered(with_(WAYS, KV) + """
, v AS (SELECT key, value, count(*) AS n FROM kv GROUP BY 1, 2)
SELECT (SELECT count(*) FROM wf) AS features, count(DISTINCT key) AS keys, count(*) AS pairs, CAST(sum(n) AS BIGINT) AS tags FROM v""")
def stats_tags(spark, d):
    return stats.keys_totals(way_rows(spark, d))


@registered(with_(WAYS) + """
, g AS (SELECT s, count(*) AS k FROM (SELECT unnest([status, lower(status), 'x']) AS s FROM wf) GROUP BY 1)
SELECT s AS part, CAST(k AS DOUBLE) AS tally, round(k / (SELECT count(*) FROM wf), 6) AS share, 'row' AS kind FROM g UNION ALL SELECT '', CAST((SELECT count(*) FROM wf) AS DOUBLE), 1, 'total'""")
def stats_split(spark, d):
    s = F.col("tags")["status"]
    rows = way_rows(spark, d).withColumn("tags", F.create_map(F.lit("part"), F.concat(s, F.lit("; "), F.lower(s), F.lit(" ;x;;"))))
    return shares(stats.tally(rows, "count", "part", split=True), g0="part")


@registered(with_(N) + """
, g AS (SELECT level, count(*) AS k FROM n WHERE tagged GROUP BY 1), s AS (SELECT *, k / sum(k) OVER () AS share, sum(k) OVER () AS total FROM g)
SELECT level, CAST(k AS DOUBLE) AS tally, round(share, 6) AS share, 'row' AS kind FROM s WHERE share >= 0.02
UNION ALL SELECT CAST(count(*) AS VARCHAR), CAST(sum(k) AS DOUBLE), round(sum(k) / any_value(total), 6), 'others' FROM s WHERE share < 0.02 HAVING count(*) > 0
UNION ALL SELECT '', CAST(any_value(total) AS DOUBLE), 1, 'total' FROM s""")
def stats_cutoff_others(spark, d):
    return shares(stats.tally(node_rows(spark, d), "count", "level", cut=stats.CutOff.parse("2%")), g0="level")


@registered(with_(WAYS) + " SELECT CAST(count(*) AS DOUBLE) AS tally, 'total' AS kind FROM wf")
def stats_totals(spark, d):
    return stats.tally(way_rows(spark, d), "count", "status", cut=stats.CutOff.parse("1000000000")).where("kind = 'total'").select("tally", "kind")


# --- strings and sources

STRINGS = """
tag AS (
  SELECT unnest(['name', 'shop', 'brand', 'level']) AS k, unnest([name, shop, brand, level]) AS v FROM n WHERE tagged
  UNION ALL SELECT unnest(['highway', 'status']), unnest([highway, status]) FROM w UNION ALL SELECT 'building', 'yes' FROM w WHERE ring),
used AS (SELECT k AS s, 1 AS k, 0 AS v, 0 AS r FROM tag UNION ALL SELECT v, 0, 1, 0 FROM tag UNION ALL SELECT role, 0, 0, 1 FROM m),
strings AS (SELECT s AS string, count(*) AS total, CAST(sum(k) AS BIGINT) AS keys, CAST(sum(v) AS BIGINT) AS "values", CAST(sum(r) AS BIGINT) AS roles FROM used GROUP BY s)"""


def all_strings(spark: SparkSession, d: str) -> DataFrame:
    own = X.nodes(spark, d).select("tags").union(X.ways(spark, d).select("tags"))
    return reports.string_counts(own, X.members(spark, d))


@registered(with_(N, WAYS, MEM, STRINGS) + " SELECT * FROM strings")
def string_counts(spark, d):
    return all_strings(spark, d)


@registered(with_(N, WAYS, MEM, STRINGS) + """
, u AS (SELECT *, string IN ('highway', 'shop', 'building') AS is_key, CASE WHEN regexp_full_match(string, '0|-?[1-9][0-9]*') THEN 0 ELSE "values" END AS vals FROM strings)
SELECT string, CAST(5 * keys + 2 * roles + vals + CASE WHEN is_key THEN 10000000000000 ELSE 0 END AS BIGINT) AS weight FROM u WHERE total >= 2 AND (is_key OR keys + roles + vals >= 300) ORDER BY weight DESC, string LIMIT 50""")
def top_strings(spark, d):
    return reports.top_strings(all_strings(spark, d), most=50)


@registered(with_(N, WAYS, MEM, STRINGS) + " SELECT string, total FROM strings WHERE total >= 100 AND string <> ''")
def string_summary(spark, d):
    return reports.string_summary(all_strings(spark, d)).select("string", "total")


@registered(with_(N, WAYS, MEM, STRINGS) + " SELECT k AS string FROM tag UNION SELECT v FROM tag")
def strings_in_use(spark, d):
    return reports.strings_in_use(X.nodes(spark, d).select("tags").union(X.ways(spark, d).select("tags")))


@registered(with_(N, WN, WAYS, REL, MEM) + """
, pw AS (SELECT way_id, count(*) AS k FROM wn GROUP BY 1), pr AS (SELECT rel_id, count(*) AS k, bool_or(type = 'R') AS sup FROM m GROUP BY 1)
SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM n WHERE tagged) AS tagged_nodes, (SELECT 4 * count(*) FROM n WHERE tagged) AS node_tags, (SELECT max(id) FROM n) AS max_node_id,
  (SELECT count(*) FROM wn) AS way_nodes, (SELECT max(k) FROM pw) AS max_way_nodes, (SELECT way_id FROM pw ORDER BY k DESC, way_id LIMIT 1) AS max_way_nodes_id,
  (SELECT count(*) FROM w) AS ways, (SELECT CAST(sum(CASE WHEN ring THEN 3 ELSE 2 END) AS BIGINT) FROM w) AS way_tags, (SELECT max(id) FROM w) AS max_way_id,
  (SELECT count(*) FROM r) AS relations, (SELECT CAST(sum(CASE WHEN route IS NULL THEN 2 ELSE 1 END) AS BIGINT) FROM r) AS relation_tags, (SELECT max(id) FROM r) AS max_relation_id,
  (SELECT count(*) FROM r WHERE id NOT IN (SELECT rel_id FROM m)) AS empty_relations, (SELECT count(*) FROM pr WHERE sup) AS super_relations, (SELECT count(*) FROM m) AS members, (SELECT max(k) FROM pr) AS max_members""")
def source_stats(spark, d):
    return reports.source_stats(X.nodes(spark, d), X.way_nodes(spark, d), X.ways(spark, d), X.relations(spark, d), X.members(spark, d))


@registered(with_(N) + """
, s AS (SELECT level AS z, CASE WHEN id % 5 <> 0 THEN id * 100 END AS bytes FROM n WHERE tagged)
SELECT CAST(z AS INTEGER) AS zoom, count(*) AS tiles, count(bytes) AS loaded, min(bytes / 1024) AS min_kb, max(bytes / 1024) AS max_kb, round(coalesce(sum(bytes / 1024), 0), 3) AS total_kb, round(coalesce(sum(bytes / 1024), 0) / (SELECT sum(bytes / 1024) FROM s), 6) AS share
FROM s GROUP BY z""")
def tile_report(spark, d):
    sizes = node_rows(spark, d).select(F.col("tags")["level"].cast("int").alias("zoom"), F.when(F.col("id") % 5 != 0, F.col("id") * 100).alias("bytes"))
    return reports.tile_report(sizes).select("zoom", "tiles", "loaded", "min_kb", "max_kb", F.round("total_kb", 3).alias("total_kb"), F.round("share", 6).alias("share"))


@registered(with_(N) + " SELECT CAST(ceil((id * 100 + 4) / 4096) AS BIGINT) AS pages, count(*) AS n FROM n WHERE tagged GROUP BY 1")
def size_histogram(spark, d):
    return reports.size_histogram(node_rows(spark, d).select((F.col("id") * 100).alias("bytes")))


@registered(with_(WAYS) + """
SELECT 'kind_a' AS name, CAST(count(*) FILTER (WHERE ring) AS VARCHAR) AS value FROM wf UNION ALL SELECT 'kind_w', CAST(count(*) FILTER (WHERE NOT ring) AS VARCHAR) FROM wf""")
def info_summary(spark, d):
    return reports.info(way_rows(spark, d), "0").where("name in ('kind_a', 'kind_w')")


@registered(with_(WAYS, MEM) + " SELECT 'member without feature' AS error, count(DISTINCT id) AS n FROM m WHERE type = 'W' AND id NOT IN (SELECT id FROM wf)")
def library_check(spark, d):
    members = F.coalesce("members", F.array().cast(model.MEMBERS))
    r = model.feature_rows(relation_rows(spark, d).withColumn("members", members).withColumn("bbox", F.lit(None).cast(model.BOX)))
    rows = way_rows(spark, d).unionByName(r).withColumn("parents", F.array().cast("array<bigint>"))
    return library.check(rows)


# --- changes


@registered(with_(CH) + " SELECT id, change, version, x, y, note, event FROM latest")
def changes_latest(spark, d):
    out = changes.latest(X.changes(spark, d))
    return out.select("id", "change", "version", "x", "y", T.value("tags", "note").alias("note"), T.value("tags", "event").alias("event"))


@registered(with_(CH) + " SELECT 'N' AS type, change, count(*) AS n, CAST(sum(CASE WHEN note IS NULL THEN 1 ELSE 2 END) AS BIGINT) AS tags, count(DISTINCT u) AS users FROM c GROUP BY change")
def changes_report(spark, d):
    return reports.change_report(X.changes(spark, d))


@registered(with_(N, WN, CH) + """
, moved AS (SELECT n.id FROM n JOIN latest l ON n.id = l.id WHERE l.change = 'delete' OR n.x <> l.x OR n.y <> l.y)
SELECT DISTINCT way_id FROM wn WHERE node_id IN (SELECT id FROM moved)""")
def changes_implicit_ways(spark, d):
    return changes.implicit_ways(X.nodes(spark, d), X.way_nodes(spark, d), X.changes(spark, d))


@registered(with_(N, WN, MEM, CH) + """
, moved AS (SELECT n.id FROM n JOIN latest l ON n.id = l.id WHERE l.change = 'delete' OR n.x <> l.x OR n.y <> l.y)
SELECT DISTINCT rel_id FROM m WHERE type = 'W' AND id IN (SELECT way_id FROM wn WHERE node_id IN (SELECT id FROM moved))""")
def changes_implicit_relations(spark, d):
    c = X.changes(spark, d)
    return changes.implicit_relations(X.members(spark, d), c, changes.implicit_ways(X.nodes(spark, d), X.way_nodes(spark, d), c))


@registered(with_(N, CH) + """
SELECT coalesce(n.id, l.id) AS id, coalesce(l.x, n.x) AS x, coalesce(l.y, n.y) AS y, CASE WHEN l.id IS NULL THEN shop END AS shop, l.event
FROM n FULL JOIN latest l ON n.id = l.id WHERE l.change IS NULL OR l.change <> 'delete'""")
def apply_changes(spark, d):
    out = changes.apply_to_nodes(X.nodes(spark, d), X.changes(spark, d))
    return out.select("id", "x", "y", T.value("tags", "shop").alias("shop"), T.value("tags", "event").alias("event"))


@registered(with_(N, CH) + " SELECT n.id, 'promoted' AS effect FROM n JOIN latest l ON n.id = l.id WHERE NOT tagged AND l.change <> 'delete'")
def changes_promoted(spark, d):
    return changes.promoted(X.nodes(spark, d), X.members(spark, d), changes.latest(X.changes(spark, d)))


@registered(with_(WN, MEM, CH) + """
, p AS (SELECT way_id, count(*) AS k, count(*) FILTER (WHERE node_id IN (SELECT id FROM c)) AS h FROM wn GROUP BY 1)
SELECT CAST(sum(k) AS BIGINT) AS way_nodes, (SELECT count(DISTINCT node_id) FROM wn) AS distinct_way_nodes, count(*) AS ways, count(*) FILTER (WHERE k = h) AS complete_ways,
  (SELECT count(*) FROM m) AS members, (SELECT count(*) FROM (SELECT DISTINCT type, id FROM m)) AS distinct_members FROM p""")
def change_completeness(spark, d):
    return reports.change_completeness(X.way_nodes(spark, d), X.changes(spark, d), X.members(spark, d))


def two_tag_tables(spark: SparkSession, d: str) -> DataFrame:
    c = X.changes(spark, d).where("version = 1").select("id", F.col("tags").alias("b"))
    return X.nodes(spark, d).where("size(tags) > 0").select("id", F.col("tags").alias("a")).join(c, "id")


@registered(with_(N, CH) + " SELECT n.id, 'brand=,event=' || event || ',level=,name=' || CASE WHEN note IS NULL THEN '' ELSE ',note=' || note END || ',shop=' AS change FROM n JOIN c ON n.id = c.id WHERE version = 1 AND tagged")
def tag_diff(spark, d):
    return two_tag_tables(spark, d).select("id", T.pairs(T.diff("a", "b")).alias("change"))


@registered(with_(N, CH) + " SELECT n.id, 'event=' || event || CASE WHEN note IS NULL THEN '' ELSE ',note=' || note END AS merged, true AS same FROM n JOIN c ON n.id = c.id WHERE version = 1 AND tagged")
def tag_merge(spark, d):
    t = two_tag_tables(spark, d)
    m = T.merge("a", T.diff("a", "b"))
    return t.select("id", T.pairs(m).alias("merged"), (T.pairs(m) == T.pairs("b")).alias("same"))


# --- formats

CSV_CELL = "CASE WHEN regexp_matches({0}, '[\", ]') THEN '\"' || replace({0}, '\"', '\"\"') || '\"' ELSE {0} END"


@registered(with_(N) + " SELECT 'N' || id AS line FROM n WHERE tagged")
def format_list(spark, d):
    return formats.lines(node_rows(spark, d), "list").select("line")


@registered(with_(N) + f" SELECT 'N,' || id || ',' || {CSV_CELL.format('name')} || ',' || {CSV_CELL.format('shop')} || ',' AS line FROM n WHERE tagged")
def format_csv(spark, d):
    return formats.lines(node_rows(spark, d), "csv", "name,shop,none").select("line")


@registered(with_(N) + " SELECT 'node/' || id || ':' || chr(10) || chr(9) || 'brand: ' || brand || chr(10) || chr(9) || 'level: ' || level || chr(10) || chr(9) || 'name: ' || name || chr(10) || chr(9) || 'shop: ' || shop || chr(10) AS line FROM n WHERE tagged")
def format_fab(spark, d):
    return formats.lines(node_rows(spark, d), "fab").select("line")


SHORT = "rtrim(rtrim(printf('%.5f', {0}), '0'), '.')"


@registered(with_(N) + f""" SELECT '{{"type":"Feature","id":"N' || id || '","geometry":{{"type":"Point","coordinates":[' || {SHORT.format('x * (360 / 4294967296.0::DOUBLE)')} || ',' || {SHORT.format('degrees(2 * atan(exp(y * (pi() / 2147483648))) - pi() / 2)')}
  || ']}},"properties":{{"name":' || to_json(name) || ',"shop":' || to_json(shop) || '}}}}' AS line FROM n WHERE tagged""")
def format_geojsonl(spark, d):
    return formats.lines(node_rows(spark, d), "geojsonl", "name,shop", precision=5).select("line")


@registered(with_(N, WN, WAYS, PT) + """
SELECT CASE WHEN ring THEN 'POLYGON ((' ELSE 'LINESTRING (' END || string_agg(x || ' ' || y, ', ' ORDER BY pos) || CASE WHEN ring THEN '))' ELSE ')' END AS line FROM wf JOIN pt ON id = way_id GROUP BY id, ring""")
def format_wkt(spark, d):
    return formats.wkt_lines(way_rows(spark, d), projected=True).select("line")


@registered(with_(WN, WAYS) + """
SELECT '  <way id="' || id || '" version="1" visible="true">' || chr(10) || string_agg('    <nd ref="' || node_id || '"/>' || chr(10), '' ORDER BY pos)
  || CASE WHEN ring THEN '    <tag k="building" v="yes"/>' || chr(10) ELSE '' END || '    <tag k="highway" v="' || highway || '"/>' || chr(10) || '    <tag k="status" v="' || status || '"/>' || chr(10) || '  </way>' AS line
FROM wf JOIN wn ON id = way_id GROUP BY id, ring, highway, status""")
def format_xml(spark, d):
    return formats.lines(way_rows(spark, d), "xml").select("line")
