"""The text formats: a frame (ord, line) of body lines for each, and the lines before and after.

Bodies are built by columns and scale with the data.  ``write_text`` puts them out as files; ``streamed`` gives the
pieces of one text, however long, with one partition at a time on the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions import geo, text
from geolith.functions import tags as T
from geolith.operators.query import PSEUDO, Columns

NAMES = {"N": "node", "W": "way", "R": "relation"}
FORMATS = ("list", "csv", "fab", "geojson", "geojsonl", "xml", "wkt", "count", "map", "poly", "stats", "table", "null")


def type_name(c: Column) -> Column:
    return F.when(c == "N", "node").when(c == "W", "way").otherwise("relation")


def osm_link() -> Column:
    """The page of a feature."""
    return F.concat(F.lit("https://www.openstreetmap.org/"), type_name(F.col("type")), F.lit("/"), F.col("id").cast("string"))


def list_lines(features: DataFrame) -> DataFrame:
    return features.select("type", "id", F.concat("type", F.col("id").cast("string")).alias("line"))


def csv_header(columns: str | None = None) -> str:
    return ",".join(["t", "id", *Columns(columns).names])


def csv_lines(features: DataFrame, columns: str | None = None, precision: int = 7) -> DataFrame:
    """Cells in the order of the list; an empty cell stays as an empty cell."""
    c = Columns(columns)
    cells = [text.csv_cell(F.coalesce(c.value(n, precision), F.lit(""))) for n in c.names]
    return features.select("type", "id", F.concat_ws(",", "type", F.col("id").cast("string"), *cells).alias("line"))


def fab_lines(features: DataFrame, columns: str | None = None) -> DataFrame:
    """``node/1:``, a line for each property, and a blank line, as one text."""
    own = F.transform(Columns(columns).properties(), lambda e: F.concat(F.lit("\t"), e["key"], F.lit(": "), e["value"], F.lit("\n")))
    return features.select("type", "id", F.concat(type_name(F.col("type")), F.lit("/"), F.col("id").cast("string"), F.lit(":\n"), F.array_join(own, "")).alias("line"))


def point_text(x: Column, y: Column, precision: int, separator: str) -> Column:
    """Degrees, rounded, without zeros at the end."""
    def short(c: Column) -> Column:
        fixed = F.format_string(f"%.{precision}f", c)
        return F.regexp_replace(F.regexp_replace(fixed, r"(\.\d*?)0+$", "$1"), r"\.$", "")

    return F.concat(short(geo.lon_of(x)), F.lit(separator), short(geo.lat_of(y)))


def line_text(coords: Column, precision: int, separator: str, before: str, after: str, between: str) -> Column:
    return F.array_join(F.transform(coords, lambda c: F.concat(F.lit(before), point_text(c["x"], c["y"], precision, separator), F.lit(after))), between)


def rings_text(polygon: Column, precision: int) -> Column:
    return F.array_join(F.transform(polygon, lambda ring: F.concat(F.lit("["), line_text(ring, precision, ",", "[", "]", ","), F.lit("]"))), ",")


def geojson_polygons(precision: int) -> Column:
    """Polygon or MultiPolygon of ``polygons``; null where there are none."""
    p = F.col("polygons")
    one = F.concat(F.lit('{"type":"Polygon","coordinates":['), rings_text(F.try_element_at(p, F.lit(1)), precision), F.lit("]}"))
    many = F.concat(F.lit('{"type":"MultiPolygon","coordinates":['), F.array_join(F.transform(p, lambda x: F.concat(F.lit("["), rings_text(x, precision), F.lit("]"))), ","), F.lit("]}"))
    return F.when(F.size(p) == 1, one).when(F.size(p) > 1, many)


def wkt_polygons(part) -> Column:
    p = F.col("polygons")

    def body(polygon: Column) -> Column:
        return F.concat(F.lit("("), F.array_join(F.transform(polygon, lambda ring: F.concat(F.lit("("), part(ring), F.lit(")"))), ", "), F.lit(")"))

    one = F.concat(F.lit("POLYGON "), body(F.try_element_at(p, F.lit(1))))
    return F.when(F.size(p) == 1, one).when(F.size(p) > 1, F.concat(F.lit("MULTIPOLYGON ("), F.array_join(F.transform(p, body), ", "), F.lit(")")))


def geojson_geometry(precision: int = 7, assembled: bool = False, collected: bool = False) -> Column:
    """Point, LineString, Polygon, MultiPolygon; relations without polygons get the collection of their members if
    there is a column ``collection``, else their box, or an empty collection."""
    point = F.concat(F.lit('{"type":"Point","coordinates":['), point_text(F.col("x"), F.col("y"), precision, ","), F.lit("]}"))
    line = line_text(F.col("coords"), precision, ",", "[", "]", ",")
    way = F.when(F.col("is_area"), F.concat(F.lit('{"type":"Polygon","coordinates":[['), line, F.lit("]]}"))).otherwise(F.concat(F.lit('{"type":"LineString","coordinates":['), line, F.lit("]}")))
    b = F.col("bbox")
    ring = F.array(*[F.struct(b[x].alias("x"), b[y].alias("y")) for x, y in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
    box = F.concat(F.lit('{"type":"Polygon","coordinates":[['), line_text(ring, precision, ",", "[", "]", ","), F.lit("]]}"))
    rest = F.when(b.isNotNull(), box).otherwise(F.lit('{"type":"GeometryCollection","geometries":[]}'))
    if collected:
        rest = F.coalesce("collection", F.lit('{"type":"GeometryCollection","geometries":[]}'))
    plain = F.when(F.col("type") == "N", point).when(F.col("coords").isNotNull(), way).otherwise(rest)
    return F.coalesce(geojson_polygons(precision), plain) if assembled else plain


def with_collections(features: DataFrame, library: DataFrame, precision: int = 7) -> DataFrame:
    """``features`` with ``collection``: of relations that are no areas, the geometries of their members that are nodes
    and ways of ``library``, in order; one alone stands for itself."""
    each = features.where("type = 'R' and not is_area").select(F.col("id").alias("rel_id"), F.posexplode("members").alias("pos", "m")).select("rel_id", "pos", "m.type", "m.id")
    shapes = library.where("type != 'R' and not is_missing").select("type", "id", geojson_geometry(precision).alias("shape"))
    listed = each.join(shapes, ["type", "id"]).groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("pos", "shape"))).alias("own"))
    own = F.transform("own", lambda x: x["shape"])
    many = F.concat(F.lit('{"type":"GeometryCollection","geometries":['), F.array_join(own, ","), F.lit("]}"))
    made = listed.select("rel_id", F.when(F.size("own") == 1, own[0]).otherwise(many).alias("collection"))
    key = F.when((F.col("type") == "R") & ~F.col("is_area"), F.col("id"))
    return features.join(made, key == F.col("rel_id"), "left").select(*[features[c] for c in features.columns], "collection")


def geojson_lines(features: DataFrame, columns: str | None = None, precision: int = 7) -> DataFrame:
    """A compact Feature; ``bbox`` only if the column list has it; keys and values are escaped."""
    c = Columns(columns)
    own = F.array_join(F.transform(c.properties(), lambda e: F.concat(text.json_text(e["key"]), F.lit(":"), text.json_text(e["value"]))), ",")
    b = F.col("bbox")
    box = F.lit("")
    if "bbox" in c.names:
        box = F.coalesce(F.concat(F.lit(',"bbox":['), point_text(b["minx"], b["miny"], precision, ","), F.lit(","), point_text(b["maxx"], b["maxy"], precision, ","), F.lit("]")), F.lit(""))
    line = F.concat(F.lit('{"type":"Feature","id":"'), F.col("type"), F.col("id").cast("string"), F.lit('"'), box, F.lit(',"geometry":'), geojson_geometry(precision, "polygons" in features.columns, "collection" in features.columns), F.lit(',"properties":{'), own, F.lit("}}"))
    return features.select("type", "id", line.alias("line"))


def wkt_text(precision: int = 7, projected: bool = False, assembled: bool = False) -> Column:
    """Degrees, or the projection's own units."""
    def part(coords: Column) -> Column:
        if projected:
            return F.array_join(F.transform(coords, lambda c: F.concat_ws(" ", c["x"].cast("string"), c["y"].cast("string"))), ", ")
        return line_text(coords, precision, " ", "", "", ", ")

    point = part(F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y"))))
    way = F.when(F.col("is_area"), F.concat(F.lit("POLYGON (("), part(F.col("coords")), F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING ("), part(F.col("coords")), F.lit(")")))
    plain = F.when(F.col("type") == "N", F.concat(F.lit("POINT ("), point, F.lit(")"))).when(F.col("coords").isNotNull(), way).otherwise(F.lit("GEOMETRYCOLLECTION EMPTY"))
    return F.coalesce(wkt_polygons(part), plain) if assembled else plain


def wkt_lines(features: DataFrame, precision: int = 7, projected: bool = False) -> DataFrame:
    return features.select("type", "id", wkt_text(precision, projected, "polygons" in features.columns).alias("line"))


def poly_lines(features: DataFrame, precision: int = 7) -> DataFrame:
    """The rings of areas, each a numbered section."""
    own = features.where("is_area and coords is not null")
    return own.select("type", "id", F.concat(F.lit("ring_"), F.col("type"), F.col("id").cast("string"), F.lit("\n"), line_text(F.col("coords"), precision, " ", "\t", "\n", ""), F.lit("END")).alias("line"))


def xml_lines(features: DataFrame, places: DataFrame | None = None, precision: int = 7) -> DataFrame:
    """OSM XML 0.6 elements.  ``places`` (id, x, y): anonymous nodes of ways, with the ids they go by."""
    tags = F.array_join(F.transform(F.array_sort(F.map_entries("tags")), lambda e: F.concat(F.lit('    <tag k="'), text.xml_escaped(e["key"]), F.lit('" v="'), text.xml_escaped(e["value"]), F.lit('"/>\n'))), "")
    nds = F.coalesce(F.array_join(F.transform("node_ids", lambda n: F.concat(F.lit('    <nd ref="'), n.cast("string"), F.lit('"/>\n'))), ""), F.lit(""))
    kind = lambda c: F.when(c == "N", "node").when(c == "W", "way").otherwise("relation")
    mem = F.coalesce(F.array_join(F.transform("members", lambda m: F.concat(F.lit('    <member type="'), kind(m["type"]), F.lit('" ref="'), m["id"].cast("string"), F.lit('" role="'), text.xml_escaped(m["role"]), F.lit('"/>\n'))), ""), F.lit(""))
    body = F.concat(nds, mem, tags)
    at = F.when(F.col("type") == "N", F.concat(F.lit(' lat="'), F.split_part(point_text(F.col("x"), F.col("y"), precision, ","), F.lit(","), F.lit(2)), F.lit('" lon="'), F.split_part(point_text(F.col("x"), F.col("y"), precision, ","), F.lit(","), F.lit(1)), F.lit('"'))).otherwise(F.lit(""))
    name = type_name(F.col("type"))
    head = F.concat(F.lit("  <"), name, F.lit(' id="'), F.col("id").cast("string"), F.lit('"'), at, F.lit(' version="1" visible="true"'))
    line = F.when(body == "", F.concat(head, F.lit("/>"))).otherwise(F.concat(head, F.lit(">\n"), body, F.lit("  </"), name, F.lit(">")))
    out = features.select("type", "id", line.alias("line"))
    if places is not None:
        lat = F.split_part(point_text(F.col("x"), F.col("y"), precision, ","), F.lit(","), F.lit(2))
        lon = F.split_part(point_text(F.col("x"), F.col("y"), precision, ","), F.lit(","), F.lit(1))
        bare = F.concat(F.lit('  <node id="'), F.col("id").cast("string"), F.lit('" lat="'), lat, F.lit('" lon="'), lon, F.lit('" version="1" visible="true"/>'))
        out = places.select(F.lit("N").alias("type"), "id", bare.alias("line")).union(out)
    return out


#: (lines before, lines after) of each format.
FRAMES = {
    "list": ("", ""),
    "fab": ("", ""),
    "geojsonl": ("", ""),
    "geojson": ('{"type":"FeatureCollection","generator":"geolith","features":[', "]}"),
    "xml": ('<?xml version="1.0" encoding="UTF-8"?>\n<osm version="0.6" generator="geolith" upload="never">', "</osm>"),
    "wkt": ("GEOMETRYCOLLECTION (", ")"),
    "poly": ("from_query", "END"),
}


def lines(features: DataFrame, form: str, columns: str | None = None, precision: int = 7) -> DataFrame:
    """(type, id, line) of a format."""
    if not 0 <= precision <= 15:
        raise ValueError("precision must be between 0 and 15")
    makers = {
        "list": lambda: list_lines(features),
        "csv": lambda: csv_lines(features, columns, precision),
        "fab": lambda: fab_lines(features, columns),
        "geojson": lambda: geojson_lines(features, columns, precision),
        "geojsonl": lambda: geojson_lines(features, columns, precision),
        "wkt": lambda: wkt_lines(features, precision),
        "poly": lambda: poly_lines(features, precision),
        "xml": lambda: xml_lines(features, None, precision),
    }
    if form not in makers:
        raise ValueError(f"unknown format: {form}")
    return makers[form]()


def framed(lines: DataFrame, before: str, after: str, between: str = "\n") -> DataFrame:
    """(value): the lines of each partition with the lines before and after, so that each file is whole by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, began = None, False
        for batch in batches:
            own = ([] if last is None else [last]) + batch.column(0).to_pylist()
            if not own:
                continue
            # the last line waits: what separates lines does not follow it
            head, last = [x + between[:-1] for x in own[:-1]], own[-1]
            if not began and before:
                head.insert(0, before)
            began = True
            yield pa.RecordBatch.from_arrays([pa.array(head, pa.string())], names=["value"])
        rest = ([] if began or not before else [before]) + ([] if last is None else [last]) + ([after] if after else [])
        yield pa.RecordBatch.from_arrays([pa.array(rest, pa.string())], names=["value"])

    return lines.mapInArrow(run, "value string")


def write_text(features: DataFrame, form: str, path: str, columns: str | None = None, precision: int = 7) -> None:
    """Text files, each with the lines that its format has before and after the body."""
    before, after = (csv_header(columns), "") if form == "csv" else FRAMES[form]
    own = lines(features, form, columns, precision).select("line")
    framed(own, before, after, ",\n" if form in ("geojson", "wkt") else "\n").write.text(path)


def in_order(lines: DataFrame) -> DataFrame:
    """Nodes before ways before relations, by id."""
    return lines.orderBy(F.when(F.col("type") == "N", 0).when(F.col("type") == "W", 1).otherwise(2), "id")


def streamed(features: DataFrame, form: str, columns: str | None = None, precision: int = 7, places: DataFrame | None = None) -> Iterator[str]:
    """The pieces of one text of any length.  ``places``: see ``xml_lines``."""
    body = xml_lines(features, places, precision) if form == "xml" else lines(features, form, columns, precision)
    before, after = (csv_header(columns), "") if form == "csv" else FRAMES[form]
    if before:
        yield before + "\n"
    between, first = ",\n" if form in ("geojson", "wkt") else "\n", True
    for row in in_order(body).select("line").toLocalIterator(prefetchPartitions=True):
        yield row["line"] if first else between + row["line"]
        first = False
    if not first:
        yield "\n"
    if after:
        yield after + "\n"
    elif first and not before:
        yield "\n"


def rendered(features: DataFrame, form: str, columns: str | None = None, precision: int = 7) -> str:
    """``streamed`` as one text."""
    return "".join(streamed(features, form, columns, precision))


def shown(v) -> str:
    """Thousands apart; shares as percent with one digit."""
    if v is None or v == "":
        return "-"
    if isinstance(v, int):
        return f"{v:,}"
    return f"{v:.1%}" if isinstance(v, float) and 0 <= v <= 1 else str(v)


def table_lines(rows: Callable[[], Iterator[tuple]], header: list[str], max_width: int = 100) -> Iterator[str]:
    """The lines of an aligned table; numbers to the right, long cells cut.  ``rows`` is called twice: once for the
    widths, once for the lines, so that no more than a row need be held."""
    widths, right, n = [len(h) for h in header], [True] * len(header), 0
    for row in rows():
        n += 1
        for k, v in enumerate(row):
            widths[k] = max(widths[k], len(shown(v)))
            right[k] = right[k] and (v is None or isinstance(v, int | float))
    right = [r and n > 0 for r in right]
    over = sum(widths) + 2 * (len(widths) - 1) - max_width
    if over > 0 and widths:
        k = max(range(len(widths)), key=widths.__getitem__)
        widths[k] = max(len(header[k]), widths[k] - over)

    def cut(x: str, w: int) -> str:
        return x if len(x) <= w else x[: max(0, w - 1)] + "…"

    def line(r: list[str]) -> str:
        return "  ".join(cut(x, w).rjust(w) if a else cut(x, w).ljust(w) for x, w, a in zip(r, widths, right)).rstrip() + "\n"

    yield line(header)
    yield "=" * min(max_width, sum(widths) + 2 * (len(widths) - 1)) + "\n"
    for row in rows():
        yield line([shown(v) for v in row])


def table_text(rows: list[tuple], header: list[str], max_width: int = 100) -> str:
    return "".join(table_lines(lambda: iter(rows), header, max_width))


def feature_table_lines(features: DataFrame, columns: str | None = None, limit: int = 0, max_width: int = 100) -> Iterator[str]:
    """The ID and the columns of each feature, of ``limit`` at most if it is not 0; the tags of a wildcard stack in
    rows of their own."""
    c = Columns(columns)
    cells = [T.value("tags", n) if "*" not in n and n not in PSEUDO else F.array_join(F.transform(F.map_entries(c.part(n)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "\n") if "*" in n else c.value(n) for n in c.names]
    ordered = features.select(F.concat("type", F.col("id").cast("string")), *cells).orderBy("type", "id")
    ordered = ordered.limit(limit) if limit else ordered

    def rows() -> Iterator[tuple]:
        for r in ordered.toLocalIterator():
            parts = [(x or "").split("\n") for x in r]
            for k in range(max(map(len, parts))):
                yield tuple(p[k] if k < len(p) else (" " if j == 0 or k else "") for j, p in enumerate(parts))

    return table_lines(rows, ["ID", *c.names], max_width)


def feature_table(features: DataFrame, columns: str | None = None, limit: int = 0, max_width: int = 100) -> str:
    return "".join(feature_table_lines(features, columns, limit, max_width))


MAP_HEAD = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><link rel="stylesheet" href="https://unpkg.com/leaflet/dist/leaflet.css"><script src="https://unpkg.com/leaflet/dist/leaflet.js"></script>
<style>#map{{height:100vh}}body{{margin:0}}</style></head><body><div id="map"></div><script>
var map = L.map("map");
L.tileLayer("{basemap}", {{attribution: "{attribution}"}}).addTo(map);
var all = L.featureGroup().addTo(map);
"""
MAP_FOOT = """map.fitBounds(all.getBounds());
</script></body></html>
"""


def map_lines(features: DataFrame, columns: str | None = None, basemap: str = "https://tile.openstreetmap.org/{z}/{x}/{y}.png", attribution: str = "", color: str = "blue", link: str = "osm") -> Iterator[str]:
    """A Leaflet page: each feature with its name and tags as a tooltip, and a link where ``link`` is ``osm``."""
    if link not in ("none", "osm"):
        raise ValueError(f"no link scheme: {link}")
    c = Columns(columns)
    pre = F.array_join(F.transform(c.properties(), lambda e: F.concat(text.html_escaped(e["key"]), F.lit("="), text.html_escaped(e["value"]))), "\n")
    tip = F.concat(F.lit("<h3>"), type_name(F.col("type")), F.lit("/"), F.col("id").cast("string"), F.lit("</h3><pre>"), pre, F.lit("</pre>"))
    url = osm_link()
    click = F.concat(F.lit('.on("click", function(){window.open("'), url, F.lit('")})')) if link == "osm" else F.lit("")
    shape = geojson_geometry(7, "polygons" in features.columns, "collection" in features.columns)
    line = F.concat(F.lit("L.geoJSON("), shape, F.lit(f', {{color: "{color}"}}).bindTooltip('), text.json_text(tip), F.lit(")"), click, F.lit(".addTo(all);"))
    yield MAP_HEAD.format(basemap=basemap, attribution=attribution)
    for row in features.select(line.alias("line")).toLocalIterator(prefetchPartitions=True):
        yield row["line"] + "\n"
    yield MAP_FOOT


def map_page(features: DataFrame, columns: str | None = None, **options: str) -> str:
    return "".join(map_lines(features, columns, **options))
