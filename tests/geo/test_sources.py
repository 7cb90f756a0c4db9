import gzip
import struct
import zlib

import pytest

from geolith import cli
from geolith.sources import osm_xml, pbf, poly, settings

OSM = """<?xml version="1.0"?><osm version="0.6">
<node id="1" lat="0" lon="0"><tag k="name" v="a"/><tag k="amenity" v="pub"/></node><node id="2" lat="1" lon="1"/><node id="3" lat="1" lon="0"/>
<way id="5"><nd ref="1"/><nd ref="2"/><nd ref="3"/><nd ref="1"/><tag k="building" v="yes"/></way>
<relation id="9"><member type="way" ref="5" role="outer"/><member type="node" ref="1" role=""/><tag k="type" v="multipolygon"/></relation></osm>"""

OSC = """<osmChange><create><node id="7" version="1" lat="2" lon="2"><tag k="shop" v="x"/></node></create>
<modify><node id="1" version="2" lat="0.5" lon="0"><tag k="name" v="b"/></node><way id="5" version="3"><nd ref="1"/><nd ref="2"/></way></modify>
<delete><node id="2" version="4" lat="1" lon="1"><tag k="gone" v="1"/></node><relation id="9" version="2"><member type="way" ref="5" role=""/></relation></delete></osmChange>"""


def test_xml(spark, tmp_path):
    p = tmp_path / "a.osm"
    p.write_text(OSM)
    t = osm_xml.read(spark, str(p))
    assert {r.id: r.tags for r in t["nodes"].collect()} == {1: {"name": "a", "amenity": "pub"}, 2: {}, 3: {}}
    assert [tuple(r) for r in t["way_nodes"].orderBy("pos").collect()] == [(5, 1, 1), (5, 2, 2), (5, 3, 3), (5, 4, 1)]
    assert [tuple(r) for r in t["members"].orderBy("pos").collect()] == [(9, 1, "W", 5, "outer"), (9, 2, "N", 1, "")]


def test_changes(spark, tmp_path):
    p = tmp_path / "a.osc.gz"
    p.write_bytes(gzip.compress(OSC.encode()))
    got = {(r.type, r.id): r for r in osm_xml.read_changes(spark, str(p)).collect()}
    assert {k: r.change for k, r in got.items()} == {("N", 7): "create", ("N", 1): "modify", ("W", 5): "modify", ("N", 2): "delete", ("R", 9): "delete"}
    assert got["N", 2].tags == {} and got["R", 9].members is None and got["W", 5].node_ids == [1, 2] and got["N", 1].version == 2


def vi(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def field(k, v):
    return vi(k << 3) + vi(v) if isinstance(v, int) else vi(k << 3 | 2) + vi(len(v)) + v


def zz(n):
    return (n << 1) ^ (n >> 63)


def deltas(values):
    last, out = 0, b""
    for v in values:
        out += vi(zz(v - last) & (1 << 64) - 1)
        last = v
    return out


def blob(kind, data, compress=True):
    body = field(2, len(data)) + field(3, zlib.compress(data)) if compress else field(1, data)
    head = field(1, kind.encode()) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def pbf_file(path):
    strings = ["", "name", "a", "building", "yes", "outer"]
    table = b"".join(field(1, s.encode()) for s in strings)
    dense = field(1, deltas([1, 2, -3])) + field(8, deltas([0, 10_000_000, -10_000_000])) + field(9, deltas([0, 10_000_000, 5])) + field(10, vi(1) + vi(2) + vi(0) + vi(0) + vi(0))
    way = field(1, 5) + field(2, vi(3)) + field(3, vi(4)) + field(8, deltas([1, 2, -3, 1]))
    rel = field(1, 9) + field(8, vi(5) + vi(0)) + field(9, deltas([5, 1])) + field(10, vi(1) + vi(0))
    block = field(1, table) + field(2, field(2, dense)) + field(2, field(3, way)) + field(2, field(4, rel))
    header = field(4, b"DenseNodes") + field(16, b"prog") + field(33, 77)
    path.write_bytes(blob("OSMHeader", header, False) + blob("OSMData", block) + blob("OSMData", field(1, table) + field(2, field(1, field(1, zz(40)) + field(8, zz(7)) + field(9, zz(-7)))), False))


def test_pbf(spark, tmp_path, monkeypatch):
    p = tmp_path / "a.osm.pbf"
    pbf_file(p)
    t = pbf.frames(spark, str(p))
    assert {r.id: (r.lon, r.lat, r.tags) for r in t["nodes"].collect()} == {1: (0.0, 0.0, {"name": "a"}), 2: (1.0, 1.0, {}), -3: (5e-7, -1.0, {}), 40: (-7e-7, 7e-7, {})}
    assert [tuple(r) for r in t["way_nodes"].orderBy("pos").collect()] == [(5, 1, 1), (5, 2, 2), (5, 3, -3), (5, 4, 1)]
    assert [tuple(r) for r in t["members"].orderBy("pos").collect()] == [(9, 1, "W", 5, "outer"), (9, 2, "N", 1, "")]
    assert tuple(pbf.header(spark, str(p)).first())[1:3] == ("prog", ["DenseNodes"])
    # the same through Spark's readers, as for other stores
    monkeypatch.setattr(pbf, "is_local", lambda path: False)
    key = lambda r: (r.type, r.id)
    assert sorted(pbf.read(spark, str(p)).collect(), key=key) == sorted(spark.read.format("osm_pbf").load(str(p)).collect(), key=key)
    assert tuple(pbf.header(spark, str(p)).first())[1:3] == ("prog", ["DenseNodes"])


def test_poly():
    area = poly.parse("name\n1\n 0 0\n 1 0\n 1 1\n 0 0\nEND\n!2\n 0.1 0.1\n 0.2 0.1\n 0.2 0.2\nEND\nEND\n")
    assert len(area) == 1 and len(area[0]) == 2 and len(area[0][0]) == 3
    for bad in ("name\nEND\n", "name\n1\n 0 0\n 1 1\nEND\nEND\n", "name\n1\n 0 0\n 1 1\n 2 2\n"):
        with pytest.raises(ValueError):
            poly.parse(bad)


def test_settings():
    s = settings.parse("max-tiles: 1k // few\nindexed-keys:\n  shop/craft\n  highway // more\nproperties:\n  license: X\nunknown: 1\nsorter:\n  heap: 1g\nupdatable: yes\ntile-zoom-levels: 3,6\n")
    assert (s.max_tiles, s.indexed_keys, s.properties, s.updatable, s.tile_zoom_levels, s.has_id_index) == (1024, ("shop/craft", "highway"), {"license": "X"}, True, (0, 3, 6), True)
    with pytest.raises(ValueError):
        settings.Settings().set("no-such", "1")
    with pytest.raises(ValueError):
        settings.Settings().set("max-strings", "1")


def test_command_line(spark, tmp_path, capsys):
    src, lib = tmp_path / "a.osm", str(tmp_path / "lib")
    src.write_text(OSM)

    def run(*args):
        code = cli.main(list(args), spark)
        return code, capsys.readouterr().out

    assert run("build", lib, str(src))[0] == 0
    assert run("query", lib, "na[amenity=pub]") == (0, "N1\n")
    assert run("query", lib, "a[building]", "-f", "count") == (0, "1\n")
    assert run("query", lib, "*", "-b", "0.9,0.9,1.1,1.1", "-f=csv", "-t", "building") == (0, "t,id,building\nW,5,yes\nR,9,\n")
    assert "building" in run("query", lib, "w", "a", "-f=stats")[1] or run("query", lib, "wa", "-f=stats")[1]
    assert run("query", lib, "wa[building]", "-f=stats", "-f:tally=count", "-t", "building")[1].splitlines()[2].split() == ["yes", "1", "100.0%"]
    assert run("check", lib) == (0, "no errors\n")
    assert "indexed-keys" in run("info", lib, "-i")[1]
    assert run("save", lib, str(tmp_path / "set"))[0] == 0 and run("load", str(tmp_path / "lib2"), str(tmp_path / "set"))[0] == 0
    osc = tmp_path / "b.osc"
    osc.write_text(OSC)
    assert run("update", lib, str(osc), str(tmp_path / "lib3"))[0] == 0
    assert run("query", str(tmp_path / "lib3"), "n[shop]") == (0, "N7\n")
    assert run("query", lib, "n[")[0] == 2 and run("query", lib, "n", "-f=nope")[0] == 2 and run("query", lib)[0] == 2
    assert run("query", str(tmp_path / "nothing"), "n")[0] == 5 and run("nope")[0] == 2
    assert run("query", lib, "n", "-f=list", "-f:tally=count")[0] == 2
