import pytest
from pyspark.sql import functions as F

from geolith import model
from geolith.functions import geo, text
from geolith.functions import tags as T
from geolith.operators import reports
from geolith.sources import text_tables as tt


def test_round_trips(spark, tmp_path):
    rows = spark.createDataFrame([({"name": "a\tb", "x": "y"},)] * 60 + [({"name": "rare"},)], "tags map<string,string>")
    tt.write_strings(reports.string_counts(rows), str(tmp_path / "s"), 60)
    assert [tuple(r) for r in tt.read_strings(spark, str(tmp_path / "s")).orderBy("string").collect()] == [("a b", 60, 0, 60, 0), ("name", 61, 61, 0, 0), ("x", 60, 60, 0, 0), ("y", 60, 0, 60, 0)]
    d = spark.createDataFrame([(1, 2, 3)], "col int, row int, n long")
    tt.write_density(d, str(tmp_path / "d"))
    assert tt.read_density(spark, str(tmp_path / "d")).collect() == d.collect()
    tiles = spark.createDataFrame([(z, 0, 0, 9) for z in (3, 0)], "zoom int, col int, row int, n long")
    tt.write_catalog(tiles, str(tmp_path / "c"))
    assert [tuple(r) for r in tt.read_catalog(spark, str(tmp_path / "c")).orderBy("tip").collect()] == [(0, 0, 0, 1), (3, 0, 0, 2)]
    assert tt.tile_map(tiles).count("<rect") == 2


def test_typed_ids_and_excluded_keys(spark):
    df = spark.createDataFrame([("N", 5, {"a": "1", "k:x": "2"}), ("W", -7, {}), ("R", 1 << 50, {"b": "1"})], "type string, id long, tags map<string,string>")
    back = df.select("type", "id", model.type_and_id(model.typed_id(F.col("type"), F.col("id"))).alias("t")).collect()
    assert all((r.t.type, r.t.id) == (r.type, r.id) for r in back)
    assert [r.t for r in df.select(T.without("tags", ["a", "k:*"]).alias("t")).collect()] == [{}, {}, {"b": "1"}]


def test_numbers_and_text(spark):
    values = ["0", "-0", "7.31", "007", "1.", "12.5", "1e3", "-3.125", "1.2345", "x", "10", "0.50"]
    got = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.narrow_number(F.col("v")).alias("n")).collect()
    assert [r.v for r in got if r.n is not None] == ["0", "7.31", "12.5", "-3.125", "10", "0.50"]
    one = spark.createDataFrame([(" a\nb ", "x; y ;;")], "a string, b string").select(text.cleaned(F.col("a")), text.split_values(F.col("b"))).first()
    assert tuple(one) == ("a b", ["x", "y"])
    assert text.parse_share("5%") == (0.05, True) and text.parse_size("64K") == 65536 and text.parse_boolean(None)
    for bad in (lambda: text.parse_boolean("maybe"), lambda: text.parse_size("x"), lambda: geo.bbox_of("1,2,3"), lambda: geo.bbox_of("3/9/0"), lambda: geo.bbox_of("10,0,5,5")):
        with pytest.raises(ValueError):
            bad()


def test_projection_round_trip(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x in (-179.9, -1.5, 0, 77.123456) for y in (-80, -0.001, 0, 51.5)], "lon double, lat double")
    got = df.select("lon", "lat", geo.x_of("lon").alias("x"), geo.y_of("lat").alias("y")).select("*", geo.lon_of("x").alias("lon2"), geo.lat_of("y").alias("lat2")).collect()
    for r in got:
        assert abs(r.lon - r.lon2) < 1e-6 and abs(r.lat - r.lat2) < 1e-6
        assert (r.x, r.y) == (geo.x_at(r.lon), geo.y_at(r.lat))
    for zoom in (0, 3, 12):
        for r in df.select(geo.x_of("lon").alias("x"), geo.y_of("lat").alias("y")).select("x", "y", geo.tile_column("x", zoom).alias("c"), geo.tile_row("y", zoom).alias("r")).collect():
            x0, y0, x1, y1 = geo.tile_bounds(zoom, r.c, r.r)
            assert x0 <= r.x <= x1 and y0 <= r.y <= y1
