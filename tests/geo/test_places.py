"""Tiles, quads, boxes, areas: each against plain Python."""

import random

from pyspark.sql import functions as F

from geolith.functions import geo, quads
from geolith.operators import build, query

COORDS = "array<struct<x:bigint,y:bigint>>"


def col_of(x, z):
    return x + geo.HALF >> 32 - z


def row_of(y, z):
    return geo.HALF - 1 - y >> 32 - z


def test_line_tiles_hold_points_along_the_line(spark):
    rng = random.Random(5)
    lines = [[(rng.randrange(-(1 << 30), 1 << 30), rng.randrange(-(1 << 30), 1 << 30)) for _ in range(rng.randrange(1, 6))] for _ in range(40)]
    lines += [[(0, 0), (0, 1 << 29)], [(5, 5), (1 << 29, 5)], [(7, 7), (7, 7)]]
    df = spark.createDataFrame([(k, [{"x": x, "y": y} for x, y in line]) for k, line in enumerate(lines)], f"k int, coords {COORDS}")
    got = {r.k: {(t.col, t.row) for t in r.t} for r in df.select("k", geo.line_tiles("coords", 6).alias("t")).collect()}
    for k, line in enumerate(lines):
        near = set()
        for (ax, ay), (bx, by) in zip(line, line[1:] or line):
            for s in range(2001):
                x, y = ax + (bx - ax) * s / 2000, ay + (by - ay) * s / 2000
                near.add((col_of(int(x), 6), row_of(int(y), 6)))
        assert near <= got[k] and len(got[k] - near) <= 3 + len(near) // 8, k  # the samples may miss corners


def test_filled_places(spark):
    def plain(c):
        out = []
        for p in c:
            out.append(p if p else (out[-1] if out else None))
        nxt = None
        for k in range(len(out) - 1, -1, -1):
            nxt = out[k] = out[k] or nxt
        return out

    rng = random.Random(1)
    lines = [[(rng.randrange(99), 1) if rng.random() < 0.5 else None for _ in range(rng.randrange(1, 9))] for _ in range(60)]
    df = spark.createDataFrame([(k, [{"x": p[0], "y": p[1]} if p else {"x": None, "y": None} for p in c]) for k, c in enumerate(lines)], f"k int, coords {COORDS}")
    for r in df.select("k", geo.filled("coords").alias("c")).collect():
        assert [(p.x, p.y) if p.x is not None else None for p in r.c] == plain(lines[r.k])


def test_quads(spark):
    cases = [[(5, 5)], [(5, 5), (6, 5)], [(5, 5), (6, 6)], [(7, 7), (8, 8), (7, 8), (8, 7)], [(0, 0), (2, 0)], [(0, 0), (63, 63)], []]
    df = spark.createDataFrame([(k, [{"col": c, "row": r} for c, r in t]) for k, t in enumerate(cases)], "k int, t array<struct<col:int,row:int>>")
    q = quads.of_tiles(F.col("t"), 6)
    got = {r.k: r for r in df.select("k", q.alias("q"), quads.tiles_of(q).alias("t"), quads.zoomed_out(q, 1, 6).alias("up")).collect()}
    assert tuple(got[0].q) == (6, 5, 5, 1) and tuple(got[1].q) == (6, 5, 5, 3) and tuple(got[2].q) == (6, 5, 5, 9)
    assert tuple(got[3].q) == (6, 7, 7, 15) and tuple(got[4].q) == (5, 0, 0, 3) and tuple(got[5].q) == (1, 0, 0, 9) and got[6].q is None
    assert [tuple(t) for t in got[2].t] == [(6, 5, 5), (6, 6, 6)] and tuple(got[3].up) == (5, 3, 3, 15)
    two = df.where("k in (1, 2)").select("k", q.alias("q"))
    both = two.where("k = 1").select(F.col("q").alias("a")).join(two.where("k = 2").select(F.col("q").alias("b")))
    (r,) = both.select(quads.added(F.col("a"), F.col("b"), 6).alias("sum"), quads.subtracted(F.col("a"), F.col("b")).alias("less")).collect()
    assert tuple(r["sum"]) == (6, 5, 5, 11) and [tuple(t) for t in r.less] == [(6, 6, 5)]


def test_quads_move_up_where_a_tile_is_missing(spark):
    tiles = spark.createDataFrame([(0, 0, 0), (3, 0, 0), (3, 1, 0), (6, 1, 1)], "zoom int, col int, row int")
    own = spark.createDataFrame([("W", 1, [(1, 1)]), ("W", 2, [(1, 1), (2, 1)]), ("W", 3, [(1, 1), (9, 1)]), ("W", 4, [(20, 20)])], "type string, id long, tiles array<struct<col:int,row:int>>")
    got = sorted(tuple(r) for r in quads.validated(own, tiles, (0, 3, 6), 6).collect())
    assert got == [("W", 1, 6, 1, 1), ("W", 2, 3, 0, 0), ("W", 3, 3, 0, 0), ("W", 3, 3, 1, 0), ("W", 4, 0, 0, 0)]


def test_boxes(spark):
    df = spark.createDataFrame([((0, 0, 5, 5), (3, 4, 9, 9)), ((0, 0, 1, 1), (3, 4, 9, 9))], "a struct<minx:long,miny:long,maxx:long,maxy:long>, b struct<minx:long,miny:long,maxx:long,maxy:long>")
    got = [(tuple(r.u), r.i and tuple(r.i)) for r in df.select(geo.box_union(F.col("a"), F.col("b")).alias("u"), geo.box_intersection(F.col("a"), F.col("b")).alias("i")).collect()]
    assert got == [((0, 0, 9, 9), (3, 4, 5, 5)), ((0, 0, 9, 9), None)]
    n = df.select(geo.neighbour(F.lit(0), F.lit(0), 3, -1, 0).alias("w"), geo.neighbour(F.lit(0), F.lit(0), 3, 0, -1).alias("n")).first()
    assert tuple(n.w) == (7, 0) and n.n is None


def features_of(spark, rows):
    """(type, id, x, y, coords, is_area) with boxes."""
    df = spark.createDataFrame(rows, f"type string, id long, x long, y long, coords {COORDS}, is_area boolean")
    return df.withColumn("bbox", F.when(F.col("coords").isNotNull(), geo.coords_box("coords")).otherwise(geo.point_box("x", "y")))


def ring(x0, y0, x1, y1):
    return [{"x": x, "y": y} for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]


def test_areas_meet_and_join(spark):
    rows = [
        ("N", 1, 50, 50, None, False),
        ("N", 2, 500, 50, None, False),
        ("W", 3, 0, 0, [{"x": -50, "y": 50}, {"x": 500, "y": 50}], False),  # through
        ("W", 4, 0, 0, [{"x": 200, "y": 0}, {"x": 300, "y": 0}], False),
        ("W", 5, 0, 0, ring(-900, -900, 900, 900), True),  # around
        ("W", 6, 0, 0, ring(-900, -900, 900, 900), False),  # a ring that is no area
        ("W", 7, 0, 0, ring(20, 20, 30, 30), True),  # within
        ("N", 8, 100, 100, None, False),  # on the corner
    ]
    f = features_of(spark, rows)
    area = [[[(0, 0), (100, 0), (100, 100), (0, 100)]]]
    assert sorted(r.id for r in query.meets(f, area).collect()) == [1, 3, 5, 7, 8]
    areas = spark.createDataFrame([("R", 90, (0, 0, 100, 100), [[ring(0, 0, 100, 100)]]), ("R", 91, (190, -10, 310, 60), [[ring(190, -10, 310, 60)]])], "type string, id long, bbox struct<minx:long,miny:long,maxx:long,maxy:long>, polygons array<array<array<struct<x:bigint,y:bigint>>>>")
    got = sorted((r.area_id, r.id) for r in query.spatial_join(areas, f, zoom=24).collect())
    assert got == [(90, 1), (90, 3), (90, 5), (90, 7), (90, 8), (91, 3), (91, 4), (91, 5)]


def test_tile_sets_of_relations(spark):
    z = 1 << 20
    f = spark.createDataFrame(
        [("N", 1, 5, 5, None, None, False), ("W", 2, None, None, [{"x": 5, "y": 5}, {"x": 3 * z, "y": 5}], None, False), ("R", 3, None, None, None, [("N", 1, ""), ("W", 2, "")], False), ("R", 4, None, None, None, [("R", 3, "")], False)],
        f"type string, id long, x long, y long, coords {COORDS}, members array<struct<type:string,id:bigint,role:string>>, is_missing boolean",
    )
    got = {(r.type, r.id): [t.col - 2048 for t in r.tiles] for r in build.tile_sets(f).collect()}
    assert got == {("N", 1): [0], ("W", 2): [0, 1, 2, 3], ("R", 3): [0, 1, 2, 3], ("R", 4): [0, 1, 2, 3]}
