import pytest
from pyspark.sql import functions as F

from geolith import fixtures, model
from geolith.functions import geo
from geolith.functions import tags as T
from geolith.operators import build, changes, closure, query, stats
from geolith.sinks import formats
from geolith.sources import library

TAGS = "tags map<string,string>"


@pytest.fixture(scope="module")
def raw(spark):
    """A ring, a line with an unknown node, a short way, an unknown way, a cycle of relations, two nodes at one place."""
    def node(i, lon, lat, tags=None):
        return (i, float(lon), float(lat), tags or {})

    nodes = [node(1, 0, 0, {"name": 'a "b", c', "amenity": "pub"}), node(2, 1, 0), node(3, 1, 1), node(4, 0, 1), node(5, 10, 10), node(6, 10, 10, {"shop": "x;y"}), node(7, 20, 20), node(8, 30, 30)]
    n = spark.createDataFrame(nodes, f"id long, lon double, lat double, {TAGS}").select("id", "lon", "lat", geo.x_of("lon").alias("x"), geo.y_of("lat").alias("y"), "tags")
    ways = [(10, {"building": "yes"}), (11, {"highway": "primary", "note": "<&>"}), (12, {"highway": "x"}), (13, {"highway": "y"}), (14, {"building": "yes", "area": "no"})]
    wn = [(10, k, i) for k, i in enumerate((1, 2, 3, 4, 1), 1)] + [(11, 1, 99), (11, 2, 2), (11, 3, 98), (11, 4, 5), (12, 1, 1), (13, 1, 97), (13, 2, 96)] + [(14, k, i) for k, i in enumerate((1, 2, 3, 1), 1)]
    rels = [(20, {"type": "multipolygon"}), (21, {"route": "bus"}), (22, {"route": "bus"}), (23, {}), (24, {})]
    mem = [(20, 1, "W", 10, "outer"), (20, 2, "R", 20, "self"), (21, 1, "R", 22, ""), (21, 2, "W", 11, "a"), (21, 3, "N", 7, "stop"), (22, 1, "R", 21, ""), (22, 2, "N", 1000, "stop"), (22, 3, "R", 23, "x")]
    return {
        "nodes": n,
        "ways": spark.createDataFrame(ways, f"id long, {TAGS}"),
        "way_nodes": spark.createDataFrame(wn, "way_id long, pos int, node_id long"),
        "relations": spark.createDataFrame(rels, f"id long, {TAGS}"),
        "members": spark.createDataFrame(mem, "rel_id long, pos int, type string, id long, role string"),
    }


@pytest.fixture(scope="module")
def features(raw):
    return build.features(raw["nodes"], raw["ways"], raw["way_nodes"], raw["relations"], raw["members"], check=True).persist()


def test_features(features):
    got = {(r.type, r.id): r for r in features.collect()}
    assert {k: r.kind for k, r in got.items() if not r.is_missing} == {
        ("N", 1): "n", ("N", 5): "n", ("N", 6): "n", ("N", 7): "n", ("N", 8): "n", ("W", 10): "a", ("W", 11): "w", ("W", 14): "w",
        ("R", 20): "a", ("R", 21): "r", ("R", 22): "r", ("R", 23): "r", ("R", 24): "r",
    }
    assert {k for k, r in got.items() if r.is_missing} == {("N", 1000)}
    assert got["N", 1000].tags == {model.CHECK_KEY + "missing": "yes"}
    assert got["N", 5].tags == {model.CHECK_KEY + "duplicate": "yes"} and got["N", 8].tags == {model.CHECK_KEY + "orphan": "yes"}
    line = got["W", 11]
    assert line.node_ids == [99, 2, 98, 5] and line.coords[0] == line.coords[1] == line.coords[2] != line.coords[3]
    assert got["R", 20].members == [("W", 10, "outer")] and got["R", 20].bbox == got["W", 10].bbox
    assert got["R", 21].bbox == got["R", 22].bbox and got["R", 23].bbox is None
    assert got["W", 10].parents == [20] and got["R", 21].parents == [22] and got["W", 14].parents == []


def test_rejections(raw, features):
    assert {tuple(r) for r in build.rejected_ways(raw["ways"], raw["way_nodes"], raw["nodes"]).collect()} == {(12, "few nodes"), (13, "unknown nodes")}
    assert {tuple(r) for r in build.empty_relations(raw["relations"], raw["members"]).collect()} == {(23, True), (24, False)}
    f = features.where("not is_missing")
    mem = raw["members"].union(raw["members"].sparkSession.createDataFrame([(24, 1, "N", 5000, "")], raw["members"].schema))
    assert [r.id for r in build.rejected_relations(raw["relations"], mem, f).collect()] == [24]


def test_closure_ends_on_cycles(raw):
    got = {(r.rel_id, r.type, r.id) for r in build.member_closure(raw["members"]).collect()}
    both = {("R", 21), ("R", 22), ("R", 23), ("W", 11), ("N", 7), ("N", 1000)}
    assert got == {(20, "W", 10)} | {(k, t, i) for k in (21, 22) for t, i in both}
    one = raw["relations"].where("id = 20").select(F.lit("R").alias("type"), "id")
    assert {tuple(r) for r in closure.referenced(one, raw["members"], raw["way_nodes"]).collect()} == {("R", 20), ("W", 10), *(("N", k) for k in (1, 2, 3, 4))}


def test_spatial_filters(features, spark):
    def ids(df):
        return {(r.type, r.id) for r in df.collect()}

    own = features.where("not is_missing and type != 'R'")
    assert ids(query.within(own, "9,9,11,11")) == {("N", 5), ("N", 6), ("W", 11)}
    x = lambda v: geo.x_at(v)
    square = [[[(x(0.2), geo.y_at(0.2)), (x(0.8), geo.y_at(0.2)), (x(0.8), geo.y_at(0.8)), (x(0.2), geo.y_at(0.8))]]]
    assert ids(query.within(own, area=square)) == {("W", 10), ("W", 14)}  # inside the ring; across the line 3-1
    hole = [[[(x(-5), geo.y_at(-5)), (x(25), geo.y_at(-5)), (x(25), geo.y_at(25)), (x(-5), geo.y_at(25))], [(x(9), geo.y_at(9)), (x(11), geo.y_at(9)), (x(11), geo.y_at(11)), (x(9), geo.y_at(11))]]]
    assert ids(query.within(own.where("type = 'N'"), area=hole)) == {("N", 1), ("N", 7)}
    assert query.within(own).count() == own.count()
    assert query.limited(own, 0).count() == own.count() and query.limited(own, 2).count() == 2


def test_projection_takes_each_tag_once(spark):
    df = spark.createDataFrame([("N", 1, {"name": "a", "name:de": "b", "ref": "1", "x": "y z"})], f"type string, id long, {TAGS}")
    df = df.withColumn("lon", F.lit(1.25)).withColumn("lat", F.lit(2.0))
    row = query.projected(df, "name,name:*,n*,*,lon").first()
    assert tuple(row) == ("N", 1, "a", "name:de=b", None, "ref=1,x=y z", "1.25")
    assert [tuple(e) for e in df.select(query.Columns("*,name").properties().alias("p")).first().p] == [("name:de", "b"), ("ref", "1"), ("x", "y z"), ("name", "a")]


def test_formats(features):
    one = features.where("type = 'N' and id = 1")
    assert formats.rendered(one, "list") == "N1\n"
    assert formats.rendered(one, "csv", "name,none,*") == 't,id,name,none,*\nN,1,"a ""b"", c",,amenity=pub\n'
    assert formats.rendered(one, "fab") == 'node/1:\n\tamenity: pub\n\tname: a "b", c\n\n'
    assert formats.rendered(one, "geojsonl", "name") == '{"type":"Feature","id":"N1","geometry":{"type":"Point","coordinates":[0,0]},"properties":{"name":"a \\"b\\", c"}}\n'
    way = features.where("type = 'W' and id = 11")
    text = formats.rendered(way, "xml")
    assert '<way id="11" version="1" visible="true">\n    <nd ref="99"/>' in text and 'v="&lt;&amp;&gt;"' in text and text.endswith("</osm>\n")
    assert formats.rendered(features.where("type = 'W' and id = 10"), "wkt", precision=3) == "GEOMETRYCOLLECTION (\nPOLYGON ((0 0, 1 0, 1 1, 0 1, 0 0))\n)\n"
    assert formats.rendered(features.where("type = 'W' and id = 10"), "poly", precision=1).startswith("from_query\nring_W10\n\t0 0\n\t1 0\n")
    import json

    assert len(json.loads(formats.rendered(features, "geojson", "bbox,*"))["features"]) == features.count()
    assert "ID" in formats.feature_table(features, "name,*")
    assert "L.geoJSON" in formats.map_page(one) and "openstreetmap.org/node/1" in formats.map_page(one)
    with pytest.raises(ValueError):
        formats.lines(features, "no such")


def test_areas_and_lengths(features):
    got = {r.id: r for r in features.where("type = 'W'").select("id", geo.length_m("coords").alias("m"), geo.area_m2("coords").alias("m2")).collect()}
    assert abs(got[10].m - 444_759) < 1000 and abs(got[10].m2 / 1.2309e10 - 1) < 0.01


@pytest.mark.parametrize("tags,area", [({"building": "no"}, False), ({"highway": "services"}, True), ({"highway": "primary"}, False), ({"natural": "cliff"}, False), ({"natural": "wood"}, True), ({"area": "yes"}, True), ({"building": "yes", "area": "no"}, False), ({}, False)])
def test_area_rules(spark, tags, area):
    df = spark.createDataFrame([(tags,)], TAGS)
    assert df.select(T.says_area("tags").alias("a")).first().a is area


def test_tallies(features):
    def rows(df):
        return {tuple(r) for r in df.collect()}

    n = features.where("type = 'N' and not is_missing")
    assert ("x", 1.0, 0.2, "row") in rows(stats.tally(n, "count", "shop", split=True)) and ("y", 1.0, 0.2, "row") in rows(stats.tally(n, "count", "shop", split=True))
    assert rows(stats.tally(n, "count", "shop", cut=stats.CutOff.parse("2"))) == {("-", 4.0, 0.8, "row"), ("1", 1.0, 0.2, "others"), ("", 5.0, 1.0, "total")}
    got = rows(stats.roles(features.where("not is_missing"), "route", cut=stats.CutOff(0, 0)))
    assert ("bus", "(empty)", 2, 2, 2 / 7, "row") in got and ("", "", 7, 5, 1.0, "total") in got
    keys = rows(stats.keys(features.where("type = 'R'")))
    assert ("route", None, 2, None, 0.4) in keys and ("route", "bus", 2, 1.0, 0.4) in keys
    empty = stats.tally(n.limit(0), "count", "shop").collect()
    assert [tuple(r) for r in empty] == [("", 0.0, 1.0, "total")]


def test_tag_diff_and_merge(spark):
    a = {"maxweight": "7.31", "highway": "primary", "name": "A", "banana": "apple", "lit": "yes"}
    b = {"maxweight": "12", "surface": "asphalt", "highway": "primary", "name": "B", "lit": "no"}
    df = spark.createDataFrame([(a, b), (b, a), (a, a), ({}, a), (a, {})], "old map<string,string>, new map<string,string>")
    for r in df.select("old", "new", T.diff("old", "new").alias("d"), T.merge("old", T.diff("old", "new")).alias("m")).collect():
        assert r.m == r.new and (r.d == {}) == (r.old == r.new)


def test_changes(spark, raw):
    schema = f"change string, type string, id long, version int, {TAGS}, x long, y long"
    rows = [
        ("modify", "N", 1, 2, {"a": "1"}, 0, 0), ("modify", "N", 1, 3, {"a": "2"}, 0, 0), ("create", "N", 50, 1, {}, 5, 5), ("modify", "N", 50, 2, {"b": "1"}, 6, 6),
        ("create", "N", 51, 1, {}, 1, 1), ("delete", "N", 51, 2, {}, None, None), ("delete", "N", 5, 9, {}, None, None), ("modify", "N", 2, 2, {"new": "x"}, 1, 1),
    ]
    c = spark.createDataFrame(rows, schema)
    assert {(r.id, r.change, r.version) for r in changes.latest(c).collect()} == {(1, "modify", 3), (50, "create", 2), (5, "delete", 9), (2, "modify", 2)}
    out = {r.id: r for r in changes.apply_to_nodes(raw["nodes"], c).collect()}
    assert set(out) == {1, 2, 3, 4, 6, 7, 8, 50} and out[1].tags == {"a": "2"} and (out[50].x, out[50].y) == (6, 6)
    assert {r.way_id for r in changes.implicit_ways(raw["nodes"], raw["way_nodes"], c).collect()} == {10, 11, 14}
    assert {tuple(r) for r in changes.promoted(raw["nodes"], raw["members"], c).collect()} == {(2, "promoted")}
    moved = changes.implicit_ways(raw["nodes"], raw["way_nodes"], c)
    assert {r.rel_id for r in changes.implicit_relations(raw["members"], c, moved).collect()} == {20, 21}
    old, new = raw["members"], raw["members"].where("id != 7").union(spark.createDataFrame([(21, 9, "N", 8, "")], raw["members"].schema))
    got = {r.rel_id: r for r in changes.added_and_dropped(old, new).collect()}
    assert got[21].added == [("N", 8)] and got[21].dropped == [("N", 7)] and got[22].added == []


def test_members_of_a_large_relation(spark):
    """No list of members is compared with another, each with each."""
    n = 100_000
    m = spark.range(n).select(F.lit(1).alias("rel_id"), F.when(F.col("id") % 2 == 0, "N").otherwise("W").alias("type"), "id")
    old, new = m.where(f"id < {n - 10}").union(m.where("id < 5")), m.where("id >= 20")
    out = changes.added_and_dropped(old, new)
    assert "array_except" not in out._jdf.queryExecution().optimizedPlan().toString()
    (got,) = out.collect()
    assert [tuple(r) for r in got.added] == sorted(("NW"[k % 2], k) for k in range(n - 10, n))
    assert [tuple(r) for r in got.dropped] == sorted(("NW"[k % 2], k) for k in range(20))


def test_library(spark, features, tmp_path):
    path, other = str(tmp_path / "lib"), str(tmp_path / "set")
    guid = library.write(features, path)
    assert library.properties(spark, path)["guid"] == guid
    back = library.read(spark, path)
    assert back.columns == list(model.COLUMNS) and back.count() == features.count()
    assert library.read(spark, path, kinds="a").count() == features.where("kind = 'a'").count()
    n = library.save(spark, path, other)
    assert n == library.tile_list(spark, path).count()
    fresh = str(tmp_path / "new")
    assert library.load(spark, fresh, other) == n and library.load(spark, fresh, other) == 0
    assert library.read(spark, fresh).count() == features.count()
    library.write(features, str(tmp_path / "lib2"))
    with pytest.raises(library.LibraryError):
        library.save(spark, str(tmp_path / "lib2"), other)
    with pytest.raises(library.LibraryError):
        library.read(spark, str(tmp_path))
    assert library.check(back).count() == 0
    assert {r.error for r in library.check(back.union(back.where("id = 1")).where("id != 22")).collect()} == {"feature twice", "member without feature", "parent without feature"}


def test_library_check_is_one_pass(spark, features):
    """All errors, nulls among them, from one read of the table."""
    way = features.where("id = 10")
    short = way.withColumn("node_ids", F.array(F.lit(1).cast("long")))
    loose = way.withColumns({"id": F.lit(77).cast("long"), "parents": F.array(F.lit(None).cast("long"), F.lit(20).cast("long"))})
    rows = features.where("id not in (10, 22)").union(short).union(loose).union(short)
    out = library.check(rows)
    assert {r.error: r.n for r in out.collect()} == {"feature twice": 1, "way with fewer than two nodes": 2, "way without a place for each node": 2, "member without feature": 1, "parent without feature": 2}
    assert "Join" not in library.check(spark.createDataFrame([], features.schema))._jdf.queryExecution().optimizedPlan().toString()


def test_library_makes_its_features_once(spark, raw, features, tmp_path):
    """What the buckets, the ranges, the rows and the index of a library read is a stored table."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    path = str(tmp_path / "once")
    library.write(features.mapInArrow(passed, features.schema), path, updatable=True, tiles=build.tile_pyramid(build.node_density(raw["nodes"]), min_density=1))
    assert seen.value == features.count()
    assert {(r.way_id, tuple(r.node_ids)) for r in library.way_nodes(spark, path).collect()} == {(r.id, tuple(r.node_ids)) for r in features.where("type = 'W' and not is_missing").collect()}


def test_way_nodes_come_from_one_scan(spark, tmp_path):
    """Ends of rings need no second read; equal numbers are in the order of parts."""
    rows = [(2, 1, 7, 0), (2, 1, 5, 9), (2, 3, 6, 0), (3, 2, 8, 0), (3, 1, 9, 0), (3, 1, 9, 1), (5, 1, 4, 0), (5, 2, 3, 0)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = fixtures.way_nodes(spark, str(tmp_path))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert sorted(tuple(r) for r in out.collect()) == [(3, 1, 6), (3, 2, 8), (3, 3, 7), (3, 4, 6), (4, 1, 10), (4, 2, 10), (4, 3, 9), (6, 1, 5), (6, 2, 4)]


def test_whole_update(spark, raw, features):
    schema = f"change string, type string, id long, version int, {TAGS}, x long, y long, node_ids array<long>, members {model.MEMBERS}"
    rows = [
        ("modify", "N", 2, 2, {"amenity": "bench"}, geo.x_at(1), geo.y_at(0), None, None),  # promoted, not moved
        ("modify", "W", 11, 2, {"highway": "track"}, None, None, [5, 7], None),
        ("delete", "W", 14, 2, {}, None, None, None, None),
        ("create", "W", 15, 1, {"building": "yes"}, None, None, [1, 2, 3, 1], None),
        ("modify", "R", 21, 2, {"route": "tram"}, None, None, None, [("W", 15, "x"), ("W", 14, "y")]),
    ]
    new = changes.apply_all(changes.raw_of(features), spark.createDataFrame(rows, schema))
    got = {(r.type, r.id): r for r in build.features(new["nodes"], new["ways"], new["way_nodes"], new["relations"], new["members"]).collect()}
    assert got["N", 2].tags == {"amenity": "bench"} and got["N", 2].x == geo.x_at(1)
    assert got["W", 11].node_ids == [5, 7] and got["W", 11].parents == [] and got["W", 11].coords[1].x == geo.x_at(20)
    assert got["W", 14].is_missing and got["W", 15].kind == "a" and got["W", 15].parents == [21]
    assert got["R", 21].tags == {"route": "tram"} and got["R", 21].bbox == got["W", 15].bbox
    assert got["W", 10].coords == features.where("type = 'W' and id = 10").first().coords
