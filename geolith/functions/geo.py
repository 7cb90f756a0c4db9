"""Projection, tiles, bounds, lengths and areas as column expressions.

Coordinates are whole numbers of a spherical Mercator square: x and y run from -2**31 to 2**31 - 1, x grows east and
y north.  Tiles have columns and rows from 0 to 2**zoom - 1; rows grow south.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

WORLD = 1 << 32
HALF = 1 << 31
EARTH_RADIUS_M = 6371008.8
EARTH_CIRCUMFERENCE_M = 2 * math.pi * 6378137.0

#: Unit -> (units of length in a metre, units of area in a square metre, name of the length, of the area).
UNITS = {
    "m": (1.0, 1.0, "m", "m²"),
    "km": (0.001, 0.000001, "km", "km²"),
    "mi": (0.0006213711922373339, 3.861021585424458e-7, "mi", "sq mi"),
    "ft": (3.28084, 10.76391, "ft", "sq ft"),
    "yd": (1.093613, 1.19599, "yd", "sq yd"),
    "ha": (1.0, 0.0001, "m", "ha"),
    "ac": (1.0, 2.471053814671653e-4, "m", "ac"),
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def x_of(lon: Column | str) -> Column:
    return F.round(col(lon) / 360 * WORLD).cast("long")


def y_of(lat: Column | str) -> Column:
    return F.round(F.ln(F.tan(F.lit(math.pi / 4) + col(lat) * F.lit(math.pi / 360))) / F.lit(math.pi) * HALF).cast("long")


def lon_of(x: Column | str) -> Column:
    return col(x) * F.lit(360.0 / WORLD)


def lat_of(y: Column | str) -> Column:
    return F.degrees(F.lit(2.0) * F.atan(F.exp(col(y) * F.lit(math.pi / HALF))) - F.lit(math.pi / 2))


def tile_column(x: Column | str, zoom: int) -> Column:
    return F.shiftright(col(x).cast("long") + F.lit(HALF), 32 - zoom).cast("int")


def tile_row(y: Column | str, zoom: int) -> Column:
    return F.shiftright(F.lit(HALF - 1) - col(y).cast("long"), 32 - zoom).cast("int")


def tile_name(x: Column | str, y: Column | str, zoom: int) -> Column:
    return F.concat_ws("/", F.lit(str(zoom)), tile_column(x, zoom).cast("string"), tile_row(y, zoom).cast("string"))


def zoomed_out(c: Column | str, by: int) -> Column:
    """A tile's column or row ``by`` zoom levels up."""
    return F.shiftright(col(c), by)


def x_at(lon: float) -> int:
    return math.floor(lon / 360 * WORLD + 0.5)


def y_at(lat: float) -> int:
    lat = max(-85.0511287798, min(85.0511287798, lat))
    return max(-HALF, min(HALF - 1, math.floor(math.log(math.tan(math.pi / 4 + lat * math.pi / 360)) / math.pi * HALF + 0.5)))


def tile_bounds(zoom: int, column: int, row: int) -> tuple[int, int, int, int]:
    """(minx, miny, maxx, maxy)."""
    if not (0 <= zoom <= 31 and 0 <= column < 1 << zoom and 0 <= row < 1 << zoom):
        raise ValueError(f"no tile {zoom}/{column}/{row}")
    size = 1 << 32 - zoom
    return column * size - HALF, HALF - (row + 1) * size, (column + 1) * size - HALF - 1, HALF - row * size - 1


def bbox_of(text: str) -> tuple[int, int, int, int]:
    """Bounds of a literal: ``W,S,E,N`` in degrees, or a tile ``zoom/column/row``."""
    if "/" in text:
        return tile_bounds(*(int(x) for x in text.split("/")))
    w, s, e, n = (float(x) for x in text.split(","))
    if not (-180 <= w <= e <= 180 and -90 <= s <= n <= 90):
        raise ValueError(f"not a bounding box: {text}")
    return x_at(w), y_at(s), x_at(e), y_at(n)


def overlaps(bounds: tuple[int, int, int, int], box: str = "bbox") -> Column:
    """Whether ``box`` (minx, miny, maxx, maxy) meets ``bounds``; edges count."""
    minx, miny, maxx, maxy = bounds
    b = F.col(box)
    return (b["minx"] <= maxx) & (b["maxx"] >= minx) & (b["miny"] <= maxy) & (b["maxy"] >= miny)


def point_box(x: Column | str, y: Column | str) -> Column:
    return F.struct(col(x).alias("minx"), col(y).alias("miny"), col(x).alias("maxx"), col(y).alias("maxy"))


def coords_box(coords: Column | str) -> Column:
    xs, ys = F.transform(col(coords), lambda c: c["x"]), F.transform(col(coords), lambda c: c["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def box_area(box: str = "bbox") -> Column:
    b = F.col(box)
    return (b["maxx"] - b["minx"] + 1).cast("double") * (b["maxy"] - b["miny"] + 1).cast("double")


def is_closed(coords: Column | str) -> Column:
    c = col(coords)
    first, last = F.try_element_at(c, F.lit(1)), F.try_element_at(c, F.lit(-1))
    return F.coalesce((F.size(c) > 2) & (first["x"] == last["x"]) & (first["y"] == last["y"]), F.lit(False))


def segments(coords: Column | str, then) -> Column:
    """``then(from, to)`` of each two consecutive points."""
    c = col(coords)
    n = F.greatest(F.size(c) - 1, F.lit(0))
    return F.zip_with(F.slice(c, 1, n), F.slice(c, 2, n), then)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda t, x: t + x)


def length_m(coords: Column | str) -> Column:
    """Great-circle metres along ``coords``."""

    def step(a: Column, b: Column) -> Column:
        f1, f2 = F.radians(lat_of(a["y"])), F.radians(lat_of(b["y"]))
        dx = F.radians(lon_of(b["x"]) - lon_of(a["x"]))
        h = F.pow(F.sin((f2 - f1) / 2), 2) + F.cos(f1) * F.cos(f2) * F.pow(F.sin(dx / 2), 2)
        return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))

    return total(segments(coords, step))


def area_m2(coords: Column | str, box: str = "bbox") -> Column:
    """The ring's planar area, scaled by the squared cosine of its middle latitude."""
    twice = F.abs(total(segments(coords, lambda a, b: (a["x"] * F.lit(1.0) * b["y"] - b["x"] * F.lit(1.0) * a["y"]))))
    middle = F.radians(lat_of((F.col(box)["miny"] + F.col(box)["maxy"]) / 2))
    return twice / 2 * F.lit((EARTH_CIRCUMFERENCE_M / WORLD) ** 2) * F.pow(F.cos(middle), 2)


def filled(coords: Column | str) -> Column:
    """``coords`` with places that are not known taken from the one before, else from the next that is known.

    Known places get the numbers of the runs that they begin, so each place is looked up, not carried along.
    """

    def carry(c: Column) -> Column:
        known = F.filter(F.transform(c, lambda x, i: F.struct(i.alias("i"), x.alias("c"))), lambda x: x["c"]["x"].isNotNull())

        def runs(k: Column) -> Column:
            ends = F.concat(F.transform(F.slice(k, 2, F.size(k)), lambda x: x["i"]), F.array(F.size(c)))
            first = F.try_element_at(k, F.lit(1))
            head = F.array_repeat(first["c"], first["i"])
            own = F.zip_with(k, ends, lambda x, end: F.array_repeat(x["c"], end - x["i"]))
            return F.when(F.size(k) == 0, c).otherwise(F.concat(head, F.flatten(own)))

        return F.element_at(F.transform(F.array(known), runs), 1)

    c = col(coords)
    whole = F.forall(c, lambda x: x["x"].isNotNull())
    return F.when(whole, c).otherwise(carry(c))


def segment_tiles(a: Column, b: Column, zoom: int) -> Column:
    """The tiles (col, row) that a segment passes: in each column of tiles, the rows between where it enters and leaves."""
    low, high = F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])
    size = 1 << 32 - zoom

    def y_at_x(x: Column) -> Column:
        return F.when(a["x"] == b["x"], a["y"].cast("double")).otherwise(a["y"] + (x - a["x"]).cast("double") * (b["y"] - a["y"]) / F.nullif(b["x"] - a["x"], F.lit(0)))

    def rows(c: Column) -> Column:
        left = F.greatest(low, c.cast("long") * size - HALF)
        right = F.least(high, (c.cast("long") + 1) * size - HALF - 1)
        y1 = F.when(a["x"] == b["x"], a["y"].cast("double")).otherwise(y_at_x(left))
        y2 = F.when(a["x"] == b["x"], b["y"].cast("double")).otherwise(y_at_x(right))
        first, last = tile_row(F.ceil(F.greatest(y1, y2)), zoom), tile_row(F.floor(F.least(y1, y2)), zoom)
        return F.transform(F.sequence(first, last), lambda r: F.struct(c.alias("col"), r.alias("row")))

    return F.flatten(F.transform(F.sequence(tile_column(low, zoom), tile_column(high, zoom)), rows))


def line_tiles(coords: Column | str, zoom: int) -> Column:
    """The tiles (col, row) that a line passes, each once, in order."""
    c = col(coords)
    one = F.transform(F.slice(c, 1, 1), lambda p: F.struct(tile_column(p["x"], zoom).alias("col"), tile_row(p["y"], zoom).alias("row")))
    return F.array_sort(F.array_distinct(F.concat(one, F.flatten(segments(c, lambda a, b: segment_tiles(a, b, zoom))))))


def box_tiles(box: Column | str, zoom: int) -> Column:
    """The tiles (col, row) that a box meets."""
    b = col(box)
    columns = F.sequence(tile_column(b["minx"], zoom), tile_column(b["maxx"], zoom))
    rows = F.sequence(tile_row(b["maxy"], zoom), tile_row(b["miny"], zoom))
    return F.flatten(F.transform(columns, lambda c: F.transform(rows, lambda r: F.struct(c.alias("col"), r.alias("row")))))


def box_union(a: Column, b: Column) -> Column:
    """The box around both; one that is null adds nothing."""
    low = [F.least(a[c], b[c]).alias(c) for c in ("minx", "miny")]
    high = [F.greatest(a[c], b[c]).alias(c) for c in ("maxx", "maxy")]
    return F.struct(*low, *high)


def box_intersection(a: Column, b: Column) -> Column:
    """What both boxes cover; null where they do not meet."""
    low = [F.greatest(a[c], b[c]).alias(c) for c in ("minx", "miny")]
    high = [F.least(a[c], b[c]).alias(c) for c in ("maxx", "maxy")]
    meet = (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])
    return F.when(meet, F.struct(*low, *high))


def neighbour(column: Column, row: Column, zoom: int, east: int, south: int) -> Column:
    """struct(col, row) of the tile so many columns east and rows south; columns go round the world, rows end."""
    n = 1 << zoom
    return F.when((row + south >= 0) & (row + south < n), F.struct(F.pmod(column + east, F.lit(n)).cast("int").alias("col"), (row + south).cast("int").alias("row")))
