import json

from pyspark.sql import functions as F

from geolith import model
from geolith.functions import geo
from geolith.operators import rings, stats
from geolith.sinks import formats


def test_stitching():
    a, b, c, d = (0, 0), (10, 0), (10, 10), (0, 10)
    found = rings.stitched([[a, b], [d, c], [b, c], [d, a], [a, (5, 5), (9, 9)], [a, b, c, a]])
    assert sorted(len(r) for r in found) == [4, 5] and all(r[0] == r[-1] for r in found)
    shells = rings.assembled([[a, b, c, d, a]], [[(2, 2), (4, 2), (4, 4)], [(4, 4), (2, 2)], [(20, 20), (21, 20), (21, 21), (20, 20)]])
    assert len(shells) == 1 and len(shells[0]) == 2


def test_relations(spark):
    s = 1_000_000
    p = lambda *xy: [(x * s, y * s) for x, y in xy]
    ways = [(1, p((0, 0), (10, 0), (10, 10))), (2, p((0, 0), (0, 10), (10, 10))), (3, p((2, 2), (4, 2), (4, 4), (2, 2))), (4, p((20, 20), (30, 20), (30, 30), (20, 20)))]
    w = spark.createDataFrame([("W", i, "a" if i == 4 else "w", i == 4, {}, c) for i, c in ways], f"type string, id long, kind string, is_area boolean, tags map<string,string>, coords {model.COORDS}").withColumn("bbox", geo.coords_box("coords"))
    members = [[("W", 1, "outer"), ("W", 3, "inner"), ("W", 2, "outer")], [("W", 1, "outer"), ("W", 2, "outer"), ("W", 4, "outer")], [("W", 1, "outer"), ("N", 1, "")]]
    r = spark.createDataFrame([("R", k, "a", True, {}, m) for k, m in enumerate(members, 1)], f"type string, id long, kind string, is_area boolean, tags map<string,string>, members {model.MEMBERS}")
    r = r.withColumn("bbox", F.struct(F.lit(0).alias("minx"), F.lit(0).alias("miny"), F.lit(30 * s).alias("maxx"), F.lit(30 * s).alias("maxy")))
    f = rings.with_polygons(model.feature_rows(w).unionByName(model.feature_rows(r)))
    got = {(x.type, x.id): json.loads(x.line)["geometry"] for x in formats.geojson_lines(f).collect()}
    assert [got["R", k]["type"] for k in (1, 2, 3)] == ["Polygon", "MultiPolygon", "Polygon"]
    assert len(got["R", 1]["coordinates"]) == 2 and len(got["R", 2]["coordinates"]) == 2 and got["W", 1]["type"] == "LineString"
    wkt = {(x.type, x.id): x.line for x in formats.wkt_lines(f, projected=True).collect()}
    assert wkt["R", 2].startswith("MULTIPOLYGON (((") and "((0 0, 10000000 0, " in wkt["R", 2] and wkt["W", 4].startswith("POLYGON ((20000000 20000000")
    size = {x.id: x.a for x in f.where("type = 'R'").select("id", rings.polygons_area_m2().alias("a")).collect()}
    assert size[3] is None and abs(size[1] / size[2] - 98 / 150) < 1e-9
    total = stats.tally(f, "area", "none").where("kind = 'total'").first().tally
    assert total > size[1] + size[2]
