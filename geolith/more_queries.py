"""More registered queries: sources and sinks by round trips through files, cleaning, tiles, order and small functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith import fixtures as X
from geolith import model, work
from geolith.functions import geo, quads, text
from geolith.functions import tags as T
from geolith.operators import build, changes, query, stats
from geolith.queries import BOX, BOX_SQL, CH, CSV_CELL, KV, MEM, N, PT, PYRAMID, REL, SHORT, STRINGS, TILE, WAYS, WN, all_strings, node_rows, registered, shares, tile_set, way_rows, with_
from geolith.sinks import formats
from geolith.sources import library, osm_xml, text_tables


def place(spark: SparkSession, name: str) -> str:
    """A new folder among the work tables; it goes when the driver ends."""
    path = f"{work.folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, at = work.file_system(spark, path)
    fs.deleteOnExit(at)
    return path


def both_rows(spark: SparkSession, d: str) -> DataFrame:
    return node_rows(spark, d).unionByName(way_rows(spark, d))


# --- libraries

LAT, LON = "degrees(2 * atan(exp({0} * (pi() / 2147483648))) - pi() / 2)", "{0} * (360 / 4294967296.0::DOUBLE)"
WAY_BOX = "wb AS (SELECT way_id, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM pt GROUP BY way_id)"
X0, Y0, X1, Y1 = geo.bbox_of(BOX)
MEETS_BOX = f"minx <= {X1} AND maxx >= {X0} AND miny <= {Y1} AND maxy >= {Y0}"


@registered(with_(N, WN, WAYS, PT, WAY_BOX) + f" SELECT 'N' AS type, id FROM n WHERE tagged AND {BOX_SQL} UNION ALL SELECT 'W', id FROM wf JOIN wb ON id = way_id WHERE ring AND {MEETS_BOX}")
def library_box(spark, d):
    """Written with a tile set and key buckets, read by kind and box."""
    path = place(spark, "library")
    library.write(both_rows(spark, d), path, tiles=tile_set(spark, d), least_features=100)
    return query.within(library.read(spark, path, kinds="na", box=geo.bbox_of(BOX)).where("kind in ('n', 'a')"), BOX).select("type", "id")


@registered(with_(N) + " SELECT id, shop FROM n WHERE shop = 'promo'")
def library_key_buckets(spark, d):
    """Partitions without the key's category are not read."""
    path = place(spark, "library")
    library.write(both_rows(spark, d), path, least_features=10)
    bits = 1 << T.categories(list(T.INDEXED_KEYS))["shop"] - 1
    return query.select(library.read(spark, path, bits=[bits]), "*[shop=promo]", T.INDEXED_KEYS).select("id", F.col("tags")["shop"].alias("shop"))


COARSE_SQL = "((x + 2147483648) >> 26) || '-' || ((2147483647 - y) >> 26)"


@registered(with_(N) + f" SELECT {COARSE_SQL} AS tile FROM n WHERE tagged UNION SELECT 'none'")
def library_tile_list(spark, d):
    path = place(spark, "library")
    library.write(node_rows(spark, d), path)
    return library.tile_list(spark, path)


@registered(with_(N) + f" SELECT id FROM n WHERE tagged AND {COARSE_SQL} IN (SELECT {COARSE_SQL} FROM n WHERE tagged AND {BOX_SQL})")
def library_save_and_load(spark, d):
    """The tiles with features in a box, saved to a folder and loaded into a new library."""
    path, folder, new = (place(spark, n) for n in ("library", "tiles", "loaded"))
    library.write(node_rows(spark, d), path)
    tiles = library.tiles_of(query.within(library.read(spark, path, box=geo.bbox_of(BOX), keep_parts=True), BOX))
    library.save(spark, path, folder, tiles)
    library.load(spark, new, folder)
    return library.read(spark, new).select("id")


@registered(with_(WN, WAYS) + " SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS nodes FROM wn JOIN wf ON id = way_id GROUP BY way_id")
def way_node_index(spark, d):
    path = place(spark, "library")
    library.write(way_rows(spark, d), path, updatable=True)
    return library.way_nodes(spark, path).select("way_id", F.array_join(F.transform("node_ids", lambda n: n.cast("string")), ",").alias("nodes"))


@registered(with_(N, WN, CH) + """
, moved AS (SELECT n.id FROM n JOIN latest l ON n.id = l.id WHERE l.change = 'delete' OR n.x <> l.x OR n.y <> l.y)
SELECT DISTINCT way_id FROM wn WHERE node_id IN (SELECT id FROM moved)""")
def ways_of_interest(spark, d):
    return changes.ways_of_interest(changes.by_way(X.way_nodes(spark, d)), changes.moved_nodes(X.nodes(spark, d), X.changes(spark, d)))


# --- files


@registered(with_(CH) + f"""
SELECT change, id, CAST(version AS INTEGER) AS version, CAST(u AS BIGINT) AS user, 'u' || u AS user_name, CASE WHEN change = 'delete' THEN NULL ELSE event END AS event, CAST(round(lo / 360 * 4294967296) AS BIGINT) AS x
FROM (SELECT *, CAST(printf('%.7f', {LON.format("x")}) AS DOUBLE) AS lo FROM c)""")
def change_file(spark, d):
    """Changes written as a change file and read again."""
    c = X.changes(spark, d)
    tag = F.concat(F.lit('<tag k="event" v="'), text.xml_escaped(F.col("tags")["event"]), F.lit('"/>'))
    attributes = [F.lit('<node id="'), F.col("id").cast("string"), F.lit('" version="'), F.col("version").cast("string"), F.lit('" uid="'), F.col("user").cast("string"), F.lit('" user="u'), F.col("user").cast("string"), F.lit('" lat="0" lon="'), F.format_string("%.7f", geo.lon_of("x")), F.lit('">')]
    line = F.concat(F.lit("<"), F.col("change"), F.lit(">"), *attributes, tag, F.lit("</node></"), F.col("change"), F.lit(">"))
    path = place(spark, "changes")
    formats.framed(c.select(line.alias("line")), '<osmChange version="0.6">', "</osmChange>").write.text(path)
    out = osm_xml.read_changes(spark, path)
    return out.select("change", "id", "version", "user", "user_name", T.value("tags", "event").alias("event"), "x")


@registered(with_(N, WAYS, MEM, STRINGS) + " SELECT string, total, keys, \"values\", roles FROM strings WHERE total >= 50 AND string <> ''")
def string_table_file(spark, d):
    path = place(spark, "strings")
    text_tables.write_strings(all_strings(spark, d), path, 50)
    return text_tables.read_strings(spark, path)


@registered(with_(N) + f" SELECT CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, count(*) AS n FROM (SELECT {TILE.format(12, 'c', 'r')} FROM n) GROUP BY c, r")
def density_file(spark, d):
    path = place(spark, "density")
    text_tables.write_density(build.node_density(X.nodes(spark, d)), path)
    return text_tables.read_density(spark, path)


@registered(with_(N, PYRAMID) + " SELECT CAST(zoom AS INTEGER) AS zoom, CAST(c AS INTEGER) AS col, CAST(r AS INTEGER) AS row, row_number() OVER (ORDER BY zoom, c, r) AS tip FROM tiles")
def tile_catalog(spark, d):
    path = place(spark, "catalog")
    text_tables.write_catalog(tile_set(spark, d), path)
    return text_tables.read_catalog(spark, path)


# --- cleaning, where there is something to clean

#: Nodes with ids three times as far apart, so that ways name many that there are not.
NK = "nk AS (SELECT * REPLACE (id * 3 AS id) FROM n)"


def sparse_nodes(spark: SparkSession, d: str) -> DataFrame:
    return X.nodes(spark, d).withColumn("id", F.col("id") * 3)


@registered(with_(N, WN, WAYS, NK) + """
, k AS (SELECT way_id, count(nk.id) AS known, count(*) AS c FROM wn LEFT JOIN nk ON nk.id = node_id GROUP BY way_id)
SELECT w.id, CASE WHEN n0 < 2 THEN 'few nodes' ELSE 'unknown nodes' END AS reason FROM w LEFT JOIN k ON w.id = way_id WHERE n0 < 2 OR known = 0""")
def ways_without_known_nodes(spark, d):
    return build.rejected_ways(X.ways(spark, d), X.way_nodes(spark, d), sparse_nodes(spark, d))


@registered(with_(N, WN, WAYS, NK) + """
, j AS (SELECT way_id, pos, nk.x, nk.y FROM wn LEFT JOIN nk ON nk.id = node_id),
f AS (
  SELECT way_id, pos, coalesce(last_value(x IGNORE NULLS) OVER a, first_value(x IGNORE NULLS) OVER b) AS x, coalesce(last_value(y IGNORE NULLS) OVER a, first_value(y IGNORE NULLS) OVER b) AS y
  FROM j WINDOW a AS (PARTITION BY way_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY way_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT way_id AS id, string_agg(x || ' ' || y, ', ' ORDER BY pos) AS places FROM f JOIN wf ON id = way_id WHERE x IS NOT NULL GROUP BY way_id""")
def way_places_filled(spark, d):
    out = build.way_features(X.ways(spark, d), X.way_nodes(spark, d), sparse_nodes(spark, d))
    return out.select("id", F.array_join(F.transform("coords", lambda c: F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))), ", ").alias("places"))


@registered(with_(WAYS, REL, MEM) + " SELECT rel_id AS id FROM m LEFT JOIN (SELECT id AS known FROM wf WHERE ring) k ON m.type = 'W' AND m.id = known GROUP BY rel_id HAVING count(known) = 0 AND bool_and(m.type = 'W')")
def relations_without_known_members(spark, d):
    return build.rejected_relations(X.relations(spark, d), X.members(spark, d), way_rows(spark, d).where("is_area"))


@registered(with_(REL, MEM) + """
SELECT 'ways' AS only, id, EXISTS (SELECT 1 FROM m WHERE type = 'R' AND type = 'W' AND m.id = r.id) AS is_kept FROM r WHERE id NOT IN (SELECT rel_id FROM m WHERE type = 'W')
UNION ALL SELECT 'relations', id, EXISTS (SELECT 1 FROM m WHERE type = 'R' AND m.id = r.id) FROM r WHERE id NOT IN (SELECT rel_id FROM m WHERE type = 'R')""")
def relations_without_members(spark, d):
    """Where only ways, or only relations, count as members."""
    r, m = X.relations(spark, d), X.members(spark, d)
    ways, rels = (build.empty_relations(r, m.where(F.col("type") == t)) for t in "WR")
    return ways.select(F.lit("ways").alias("only"), "id", "is_kept").union(rels.select(F.lit("relations"), "id", "is_kept"))


@registered(with_(N) + " SELECT id, 'level=' || level || ',shop=' || shop AS rest FROM n WHERE tagged")
def tags_excluded(spark, d):
    return node_rows(spark, d).select("id", T.pairs(T.without("tags", ["name", "br*"])).alias("rest"))


@registered(with_(CH) + " SELECT change, count(*) AS n, max(version) AS last_version FROM c WHERE version <> 1 GROUP BY change")
def changes_of_existing(spark, d):
    return changes.of_existing(X.changes(spark, d)).groupBy("change").agg(F.count("*").alias("n"), F.max("version").cast("long").alias("last_version"))


@registered(with_(MEM) + """
, old AS (SELECT DISTINCT rel_id, type, id FROM m WHERE role <> 'inner'), new AS (SELECT DISTINCT rel_id, type, id FROM m WHERE role <> 'subarea')
SELECT rel_id, count(*) FILTER (WHERE NOT was) AS added, count(*) FILTER (WHERE NOT is_now) AS dropped
FROM (SELECT coalesce(o.rel_id, w.rel_id) AS rel_id, o.id IS NOT NULL AS was, w.id IS NOT NULL AS is_now FROM old o FULL JOIN new w ON o.rel_id = w.rel_id AND o.type = w.type AND o.id = w.id) GROUP BY rel_id""")
def members_added_and_dropped(spark, d):
    m = X.members(spark, d)
    out = changes.added_and_dropped(m.where("role != 'inner'"), m.where("role != 'subarea'"))
    return out.select("rel_id", F.size("added").cast("long").alias("added"), F.size("dropped").cast("long").alias("dropped"))


# --- tiles and areas

RECTS = [(k, -170 + 37 * k, -70 + 11 * k, -120 + 37 * k, -20 + 14 * k) for k in range(8)]
RECT_SQL = ", ".join("({}, {}, {}, {}, {})".format(k, *geo.bbox_of(f"{w},{s},{e},{n}")) for k, w, s, e, n in RECTS)


@registered(with_(N) + f" SELECT CAST(k AS BIGINT) AS area, id FROM n JOIN (VALUES {RECT_SQL}) AS a(k, x0, y0, x1, y1) ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 WHERE tagged")
def spatial_join_areas(spark, d):
    """Nodes in each of several areas, by shared tiles."""
    rows = []
    for k, w, s, e, n in RECTS:
        x0, y0, x1, y1 = geo.bbox_of(f"{w},{s},{e},{n}")
        rows.append(("R", k, (x0, y0, x1, y1), [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]]))
    areas = spark.createDataFrame(rows, f"type string, id bigint, bbox {model.BOX}, polygons array<array<array<struct<x:bigint,y:bigint>>>>")
    return query.spatial_join(areas, node_rows(spark, d), 4).select(F.col("area_id").alias("area"), "id")


@registered(with_(N, WN, WAYS) + """
, t AS (SELECT DISTINCT way_id, (x + 2147483648) >> 20 AS c, (2147483647 - y) >> 20 AS r FROM wn JOIN n ON n.id = node_id JOIN wf ON wf.id = way_id),
e AS (SELECT way_id, min(c) AS c0, max(c) AS c1, min(r) AS r0, max(r) AS r1 FROM t GROUP BY way_id),
u AS (SELECT way_id, min(u) AS u FROM e, generate_series(0, 12) AS g(u) WHERE (c1 >> u) - (c0 >> u) <= 1 AND (r1 >> u) - (r0 >> u) <= 1 GROUP BY way_id),
b AS (SELECT DISTINCT t.way_id, u, (c0 >> u) AS col, (r0 >> u) AS row, ((c >> u) - (c0 >> u)) + 2 * ((r >> u) - (r0 >> u)) AS k FROM t JOIN e ON t.way_id = e.way_id JOIN u ON t.way_id = u.way_id)
SELECT way_id, CAST(12 - u AS INTEGER) AS zoom, CAST(col AS INTEGER) AS col, CAST(row AS INTEGER) AS row, CAST(sum(1 << k) AS INTEGER) AS tiles FROM b GROUP BY way_id, u, col, row""")
def tile_quads(spark, d):
    """The deepest four tiles that hold the nodes of a way."""
    nodes = X.nodes(spark, d).select(F.col("id").alias("node_id"), F.struct(geo.tile_column("x", 12).alias("col"), geo.tile_row("y", 12).alias("row")).alias("t"))
    kept = way_rows(spark, d).select(F.col("id").alias("way_id"))
    own = X.way_nodes(spark, d).join(kept, "way_id", "left_semi").join(nodes, "node_id").groupBy("way_id").agg(F.collect_set("t").alias("t"))
    return own.select("way_id", quads.of_tiles(F.col("t"), 12).alias("q")).select("way_id", "q.*")


@registered(with_(N) + """
, t AS (SELECT id, (x + 2147483648) >> 24 AS c, (2147483647 - y) >> 24 AS r FROM n WHERE tagged)
SELECT id, CAST((c + 1) % 256 AS INTEGER) AS east, CAST(CASE WHEN r < 255 THEN r + 1 END AS INTEGER) AS south FROM t""")
def tile_neighbours(spark, d):
    c, r = geo.tile_column("x", 8), geo.tile_row("y", 8)
    return node_rows(spark, d).select("id", geo.neighbour(c, r, 8, 1, 0)["col"].alias("east"), geo.neighbour(c, r, 8, 0, 1)["row"].alias("south"))


@registered(with_(N, WN, WAYS, PT, WAY_BOX) + f"""
SELECT id, CAST(maxx - minx + 1 AS DOUBLE) * CAST(maxy - miny + 1 AS DOUBLE) AS size, CASE WHEN {MEETS_BOX} THEN greatest(minx, {X0}) END AS cut_minx, CASE WHEN {MEETS_BOX} THEN least(maxy, {Y1}) END AS cut_maxy, least(minx, {X0}) AS around_minx FROM wf JOIN wb ON id = way_id""")
def box_sizes(spark, d):
    whole = F.struct(*[F.lit(v).cast("long").alias(c) for v, c in zip((X0, Y0, X1, Y1), build.BOX_FIELDS)])
    cut, around = geo.box_intersection(F.col("bbox"), whole), geo.box_union(F.col("bbox"), whole)
    return way_rows(spark, d).select("id", geo.box_area().alias("size"), cut["minx"].alias("cut_minx"), cut["maxy"].alias("cut_maxy"), around["minx"].alias("around_minx"))


@registered(with_(WAYS) + """
, g AS (SELECT CASE WHEN ring THEN 'a' ELSE 'w' END AS kind, CASE WHEN ring THEN 2 + 2097152 ELSE 2 END AS key_bits, ring, count(*) AS n FROM wf GROUP BY ALL)
SELECT kind, key_bits, n, CASE WHEN n >= 50 AND NOT ring THEN CAST(key_bits AS VARCHAR) ELSE 'mixed' END AS bucket FROM g""")
def key_buckets_newer(spark, d):
    rows = way_rows(spark, d).withColumn("tile", F.lit("0/0/0"))
    return build.key_buckets(rows, least_features=50, single=True).select("kind", "key_bits", "n", "bucket")


# --- order


@registered(with_(WAYS, KV) + """
, k AS (SELECT key, count(*) AS n FROM kv GROUP BY 1), v AS (SELECT key, value, count(*) AS n FROM kv GROUP BY 1, 2),
o AS (SELECT key, NULL AS value, n AS tally, n AS parent, 0 AS depth FROM k UNION ALL SELECT v.key, value, v.n, k.n, 1 FROM v JOIN k ON v.key = k.key)
SELECT key, value, tally FROM o ORDER BY parent DESC, key, depth, tally DESC, value LIMIT 8""")
def stats_keys_in_order(spark, d):
    """The first rows of the report: each key with its values under it."""
    return stats.ordered(stats.keys(way_rows(spark, d)), "keys").limit(8).select("key", "value", "tally")


@registered(with_(N) + " SELECT brand, CAST(count(*) AS DOUBLE) AS tally FROM n WHERE tagged GROUP BY brand ORDER BY tally DESC, brand LIMIT 5")
def stats_by_tally(spark, d):
    return stats.ordered(stats.tally(node_rows(spark, d), "count", "brand", cut=stats.CutOff(0, 0)), "count").limit(5).select(F.col("g0").alias("brand"), "tally")


@registered(with_(N) + " SELECT brand, CAST(count(*) AS DOUBLE) AS tally FROM n WHERE tagged GROUP BY brand ORDER BY brand LIMIT 5")
def stats_lexical(spark, d):
    return stats.ordered(stats.tally(node_rows(spark, d), "count", "brand", cut=stats.CutOff(0, 0)), "count", lexical=True).limit(5).select(F.col("g0").alias("brand"), "tally")


# --- formats and functions


@registered(with_(N, WAYS) + " SELECT count(*) AS n FROM (SELECT id FROM n WHERE shop IS NOT NULL UNION ALL SELECT id FROM wf WHERE ring)")
def format_count(spark, d):
    return query.select(both_rows(spark, d), "na[shop]; a[building]").agg(F.count("*").alias("n"))


WAY_LINE = f"string_agg('[' || {SHORT.format(LON.format('x'))} || ',' || {SHORT.format(LAT.format('y'))} || ']', ',' ORDER BY pos)"


@registered(with_(N, WN, WAYS, PT) + f"""
SELECT id, CASE WHEN ring THEN '{{"type":"Polygon","coordinates":[[' ELSE '{{"type":"LineString","coordinates":[' END || {WAY_LINE} || CASE WHEN ring THEN ']]}}' ELSE ']}}' END AS geometry FROM wf JOIN pt ON id = way_id GROUP BY id, ring""")
def format_geojson_ways(spark, d):
    return way_rows(spark, d).select("id", formats.geojson_geometry(5).alias("geometry"))


@registered(with_(N, WN, WAYS, PT) + f"""
SELECT 'ring_W' || id || chr(10) || string_agg(chr(9) || {SHORT.format(LON.format('x'))} || ' ' || {SHORT.format(LAT.format('y'))} || chr(10), '' ORDER BY pos) || 'END' AS line FROM wf JOIN pt ON id = way_id WHERE ring GROUP BY id""")
def format_poly(spark, d):
    return formats.poly_lines(way_rows(spark, d), 5).select("line")


@registered(with_(N) + f" SELECT 'node/' || id AS name, 'https://www.openstreetmap.org/node/' || id AS link, {CSV_CELL.format('name')} AS cell FROM n WHERE tagged")
def links_and_cells(spark, d):
    kind = formats.type_name(F.col("type"))
    return node_rows(spark, d).select(F.concat(kind, F.lit("/"), F.col("id").cast("string")).alias("name"), formats.osm_link().alias("link"), text.csv_cell(F.col("tags")["name"]).alias("cell"))


@registered(with_(N) + " SELECT id, CASE WHEN CAST(level AS INTEGER) % 4 = 0 THEN CAST(CAST(level AS INTEGER) // 4 AS VARCHAR) ELSE CAST(CAST(level AS INTEGER) / 4.0::DOUBLE AS VARCHAR) END AS quarter, id * 4 AS typed FROM n WHERE tagged")
def numbers_as_text(spark, d):
    quarter = F.col("tags")["level"].cast("int") / 4
    return node_rows(spark, d).select("id", text.number(quarter).alias("quarter"), model.typed_id(F.col("type"), F.col("id")).alias("typed"))


@registered(with_(WAYS) + " SELECT status, CAST(count(*) AS DOUBLE) AS tally, 'row' AS kind FROM wf GROUP BY status HAVING count(*) >= 100 UNION ALL SELECT CAST(count(*) AS VARCHAR), CAST(sum(k) AS DOUBLE), 'others' FROM (SELECT count(*) AS k FROM wf GROUP BY status HAVING count(*) < 100) HAVING count(*) > 0 UNION ALL SELECT '', CAST(count(*) AS DOUBLE), 'total' FROM wf")
def stats_min_tally(spark, d):
    return shares(stats.tally(way_rows(spark, d), "count", "status", cut=stats.CutOff.parse("100")), g0="status").select("status", "tally", "kind")
