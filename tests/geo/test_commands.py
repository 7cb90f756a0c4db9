"""The command line over one small library."""

import json
import re
import xml.etree.ElementTree as ET

import pytest

from geolith import cli
from geolith.sources import library

OSM = (
    '<osm version="0.6">'
    + "".join(f'<node id="{k}" lat="{k % 7 / 10}" lon="{k}" version="1">{"<tag k=\"shop\" v=\"x\"/>" if k % 2 else ""}</node>' for k in range(1, 41))
    + '<way id="5" version="1"><nd ref="2"/><nd ref="3"/><nd ref="4"/><nd ref="2"/><tag k="building" v="yes"/></way>'
    + '<way id="6" version="1"><nd ref="8"/><nd ref="10"/><nd ref="999"/><tag k="highway" v="path"/></way>'
    + '<relation id="9" version="1"><member type="way" ref="5" role="outer"/><tag k="name" v="area"/></relation>'
    + '<relation id="11" version="1"><member type="way" ref="6" role=""/><member type="node" ref="1" role="stop"/><tag k="route" v="bus"/></relation>'
    + '<relation id="12" version="1"><member type="relation" ref="11" role=""/><tag k="type" v="all"/></relation>'
    + '<relation id="13" version="1"><member type="way" ref="6" role=""/><tag k="route" v="one"/></relation></osm>'
)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "a.osm").write_text(OSM)
    settings = ["--min-tile-density=5", "--tile-zoom-levels=3,6", "--key-index-min-features=2", "-u"]
    assert cli.main(["build", str(d / "lib"), str(d / "a.osm"), *settings], spark) == 0
    assert cli.main(["build", str(d / "bare"), str(d / "a.osm"), "--id-indexing=no"], spark) == 0
    return d


@pytest.fixture
def run(spark, capsys):
    def go(*args):
        code = cli.main([str(a) for a in args], spark)
        return code, capsys.readouterr().out

    return go


def test_settings_act_on_the_layout(spark, built):
    parts = spark.read.parquet(str(built / "lib/parts")).collect()
    assert {r.kind_part for r in parts} == set("nwar") and len({r.tile_part for r in parts if r.tile_part.startswith("6-")}) > 1
    assert "mixed" in {r.key_part for r in parts} and len({r.key_part for r in parts}) > 1
    assert [r.way_id for r in library.way_nodes(spark, str(built / "lib")).collect()] == [5, 6]
    assert library.way_nodes(spark, str(built / "bare")) is None
    assert not (built / "lib/_work").exists()


def test_selectors_and_boxes_prune_partitions(spark, built):
    path = str(built / "lib")
    every = len(library.pruned(spark, path))
    assert 0 < len(library.pruned(spark, path, kinds="a")) < every
    assert 0 < len(library.pruned(spark, path, box=(0, 0, 1 << 25, 1 << 25))) < every
    plan = library.read(spark, path, kinds="n", box=(0, 0, 1 << 25, 1 << 25))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*kind_part.*tile_part", plan)


def test_every_feature_is_found_however_it_is_pruned(run, built):
    whole = set(run("query", built / "lib", "*")[1].split())
    assert len(whole) == 20 + 2 + 4 and whole == set(run("query", built / "bare", "*")[1].split())
    shops = set(run("query", built / "lib", "n[shop]")[1].split())
    assert shops == {f"N{k}" for k in range(1, 41, 2)}
    assert set(run("query", built / "lib", "*", "-b", "1.5,-1,4.5,1")[1].split()) == {"N3", "W5", "R9", "R11", "R12"}


def test_xml_refers_to_nothing_outside(run, built):
    for lib in ("lib", "bare"):
        code, text = run("query", built / lib, "r[type=all]", "-f=xml")
        root = ET.fromstring(text)
        have = {(e.tag, e.get("id")) for e in root}
        assert code == 0 and ("relation", "12") in have and ("relation", "11") in have and ("way", "6") in have and ("way", "5") not in have
        for e in root:
            assert all(("node", nd.get("ref")) in have for nd in e.findall("nd"))
            assert all((m.get("type"), m.get("ref")) in have for m in e.findall("member"))
        assert len(have) == len(list(root)) == 3 + 1 + 2 + (lib == "lib")


def test_collections_and_polygons(run, built):
    found = {f["id"]: f["geometry"] for f in map(json.loads, run("query", built / "lib", "*[name]; r", "-f=geojsonl")[1].splitlines())}
    assert found["R9"]["type"] == "Polygon" and found["R13"]["type"] == "LineString"
    assert [g["type"] for g in found["R11"]["geometries"]] == ["LineString", "Point"] and found["R12"]["geometries"] == []
    assert json.loads(run("query", built / "lib", "*", "-f=geojson")[1])["features"]
    assert run("query", built / "lib", "*", "-f=map")[1].count("L.geoJSON(") == 26


def test_null_debug_and_info(run, built):
    assert run("query", built / "lib", "*", "-f=null") == (0, "")
    assert "kind_part" in run("debug", built / "lib")[1]
    tile = run("debug", built / "lib")[1]
    name = next(x.split()[2] for x in tile.splitlines() if x.startswith("a "))
    assert "W5 a" in run("debug", built / "lib", name.replace("-", "/"))[1]
    assert "Pages" in run("info", built / "lib", "-f", "-t", "-i")[1]


def test_options(run, built, capsys):
    assert run("query", built / "lib", "*", "--colour=red")[0] == 2 and run("build", built / "x", built / "a.osm", "--nothing=1")[0] == 2
    assert run("query", built / "lib", "n[shop]", "-f=count", "-q", "-v")[0] == 0
    assert cli.verbosity(["-v", "-s"]) == -2 and cli.verbosity([]) == 0
    assert cli.failure(MemoryError())[0] == 10 and cli.failure(KeyError("x"))[0] == 127 and cli.failure(OSError("x"))[0] == 4
    assert run("query", built / "nothing", "*", "-s")[0] == 5 and capsys.readouterr().err == ""


def test_save_and_load_by_area(run, spark, built, tmp_path):
    area = tmp_path / "a.poly"
    area.write_text("name\n1\n 1.5 -1\n 4.5 -1\n 4.5 1\n 1.5 1\nEND\nEND\n")
    assert run("save", built / "lib", tmp_path / "set", "-a", area)[0] == 0
    some = set(run("query", tmp_path / "set", "*")[1].split())
    assert {"N3", "W5", "R9"} <= some
    assert run("load", tmp_path / "new", tmp_path / "set", "-n")[0] == 0 and run("load", tmp_path / "new", tmp_path / "set", "-n")[0] == 2
    assert run("save", built / "lib", tmp_path / "set")[0] == 0
    assert set(run("query", tmp_path / "set", "*")[1].split()) == set(run("query", built / "lib", "*")[1].split())
    assert run("load", tmp_path / "new", tmp_path / "set")[0] == 0
    assert set(run("query", tmp_path / "new", "*")[1].split()) == set(run("query", built / "lib", "*")[1].split())


def test_a_build_goes_on_where_it_broke_off(run, built, monkeypatch, tmp_path):
    def broken(*a, **b):
        raise OSError("disk")

    monkeypatch.setattr(cli.library, "write", broken)
    assert run("build", tmp_path / "lib", built / "a.osm")[0] == 4
    monkeypatch.undo()
    monkeypatch.setattr(cli.osm_xml, "read", broken)
    monkeypatch.setattr(cli.build, "features", broken)
    assert run("build", tmp_path / "lib", built / "a.osm", "-k")[0] == 0 and (tmp_path / "lib/_work/features").exists()
    assert run("query", tmp_path / "lib", "*", "-f=count") == (0, "26\n")
    assert run("build", tmp_path / "lib2", built / "a.osm")[0] == 4


def test_each_written_file_is_whole(spark, built, tmp_path):
    from geolith.sinks import formats

    f = library.read(spark, str(built / "lib")).where("coords is not null or type = 'N'").repartition(3)
    for form in ("geojson", "xml", "csv", "wkt", "list"):
        formats.write_text(f, form, str(tmp_path / form), "shop")
        files = sorted((tmp_path / form).glob("part-*"))
        assert len(files) == 3
        for p in files:
            if form == "geojson":
                assert json.loads(p.read_text())["features"]
            elif form == "xml":
                assert len(ET.fromstring(p.read_text()))
            elif form == "csv":
                assert p.read_text().startswith("t,id,shop\n")
        n = sum(len(re.findall(r"Feature\"|<node|<way|^[NW]|POINT|POLYGON|LINESTRING", p.read_text(), re.M)) for p in files)
        assert n == 22, form
