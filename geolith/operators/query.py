"""Select, filter by place, limit and project features."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.functions import tags as T
from geolith.plans import selector

PSEUDO = ("lon", "lat", "x", "y", "bbox", "geom")


def select(features: DataFrame, text: str, indexed=None) -> DataFrame:
    """The features that a selector matches; with ``indexed`` keys, ``key_bits`` are compared before tags are."""
    return features.where(selector.predicate(text, T.categories(list(indexed)) if indexed else None))


def box_of(bbox: str | None = None, area: list | None = None) -> tuple[int, int, int, int] | None:
    """The bounds of a box literal or of an area, which outranks a box."""
    if area is not None:
        points = [p for rings in area for ring in rings for p in ring]
        return min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)
    return geo.bbox_of(bbox) if bbox else None


def within(features: DataFrame, bbox: str | tuple[int, int, int, int] | None = None, area: list | None = None) -> DataFrame:
    """Features that meet a bounding box or an area; an area outranks a box.

    ``area``: polygons, each a list of rings of (x, y), the first the shell.  Its box prunes first, and the exact test
    runs on what is left, batch by batch.
    """
    if area is not None:
        return meets(features.where(geo.overlaps(box_of(area=area))), area)
    if bbox is None:
        return features
    return features.where(geo.overlaps(geo.bbox_of(bbox) if isinstance(bbox, str) else bbox))


def inside(px: np.ndarray, py: np.ndarray, area: list) -> np.ndarray:
    """Points in the area, its edges included."""
    out = np.zeros(len(px), bool)
    for rings in area:
        odd, edge = np.zeros(len(px), bool), np.zeros(len(px), bool)
        for ring in rings:
            for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
                cross = (bx - ax) * (py - ay) - (by - ay) * (px - ax)
                edge |= (cross == 0) & (px >= min(ax, bx)) & (px <= max(ax, bx)) & (py >= min(ay, by)) & (py <= max(ay, by))
                if ay != by:
                    odd ^= ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        out |= odd | edge
    return out


def by_row(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Whether any value of each row is true; rows have a value at least."""
    return np.logical_or.reduceat(values, begin) if len(begin) else np.zeros(0, bool)


def lines_meet(x: np.ndarray, y: np.ndarray, size: np.ndarray, closed: np.ndarray, area: list) -> np.ndarray:
    """Whether each line (so many points in a row, one at least) meets the area; closed ones also by what they hold.

    All points and all segments of all lines meet each edge of the area at once.
    """
    begin = np.cumsum(size) - size
    hit = by_row(inside(x, y, area), begin)
    row = np.repeat(np.arange(len(size)), size)
    at = np.flatnonzero(row[:-1] == row[1:])
    ax, ay, bx, by = x[at], y[at], x[at + 1], y[at + 1]
    met = np.zeros(len(at), bool)
    for rings in area:
        for ring in rings:
            for (cx, cy), (dx, dy) in zip(ring, ring[1:] + ring[:1]):
                s1 = np.sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx))
                s2 = np.sign((dx - cx) * (by - cy) - (dy - cy) * (bx - cx))
                s3 = np.sign((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))
                s4 = np.sign((bx - ax) * (dy - ay) - (by - ay) * (dx - ax))
                met |= (s1 != s2) & (s3 != s4)
    hit[row[at[met]]] = True
    for rings in area:  # an area around a whole polygon holds its first point
        px, py = rings[0][0]
        with np.errstate(divide="ignore", invalid="ignore"):
            odd = ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)
        times = np.bincount(row[at], weights=odd, minlength=len(size))
        hit |= closed & (times % 2 == 1)
    return hit


def batch_meets(batch: pa.RecordBatch, area: list) -> np.ndarray:
    """Which features (type, x, y, coords, is_area, bbox) of a batch meet the area."""
    n = batch.num_rows
    out = np.zeros(n, bool)
    is_node = pc.fill_null(pc.equal(batch.column("type"), "N"), False).to_numpy(zero_copy_only=False)
    coords = batch.column("coords")
    size = pc.fill_null(pc.list_value_length(coords), 0).to_numpy(zero_copy_only=False)
    has_box = pc.is_valid(batch.column("bbox")).to_numpy(zero_copy_only=False)

    def numbers(column) -> np.ndarray:
        return pc.fill_null(column, 0).to_numpy(zero_copy_only=False).astype(float)

    if is_node.any():
        out[is_node] = inside(numbers(batch.column("x"))[is_node], numbers(batch.column("y"))[is_node], area)
    own = ~is_node & (size > 0)
    if own.any():
        flat = coords.filter(pa.array(own)).flatten()
        closed = pc.fill_null(batch.column("is_area"), False).to_numpy(zero_copy_only=False)
        out[own] = lines_meet(numbers(flat.field("x")), numbers(flat.field("y")), size[own].astype(np.int64), closed[own], area)
    rest = ~is_node & (size == 0) & has_box
    if rest.any():  # by the corners of the box
        box = batch.column("bbox").filter(pa.array(rest))
        x0, y0, x1, y1 = (numbers(box.field(c)) for c in ("minx", "miny", "maxx", "maxy"))
        x, y = np.stack((x0, x1, x1, x0, x0), 1).ravel(), np.stack((y0, y0, y1, y1, y0), 1).ravel()
        k = int(rest.sum())
        out[rest] = lines_meet(x, y, np.full(k, 5), np.ones(k, bool), area)
    return out


def meets(features: DataFrame, area: list) -> DataFrame:
    """Exact test of points and lines; an area feature also counts if the polygon lies inside it, and features without
    coordinates (relations) count by their box."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(batch_meets(batch, area)))

    return features.mapInArrow(run, features.schema)


def spatial_join(areas: DataFrame, features: DataFrame, zoom: int = 8) -> DataFrame:
    """(area_type, area_id, type, id): the features that meet each of ``areas`` (type, id, bbox, polygons), exactly.

    Both sides are dealt to the tiles that their boxes meet and joined by equal tiles, so nothing is compared with
    everything; of a pair that shares several tiles, the one with the corner of what both boxes cover counts.
    """
    left = areas.where("polygons is not null and bbox is not null").select(F.col("type").alias("area_type"), F.col("id").alias("area_id"), F.col("bbox").alias("area_box"), "polygons").withColumn("tile", F.explode(geo.box_tiles("area_box", zoom)))
    right = features.where("bbox is not null").select("type", "id", "x", "y", "coords", "is_area", "bbox").withColumn("tile", F.explode(geo.box_tiles("bbox", zoom)))
    a, b = F.col("area_box"), F.col("bbox")
    meet = (a["minx"] <= b["maxx"]) & (a["maxx"] >= b["minx"]) & (a["miny"] <= b["maxy"]) & (a["maxy"] >= b["miny"])
    corner = (F.col("tile.col") == geo.tile_column(F.greatest(a["minx"], b["minx"]), zoom)) & (F.col("tile.row") == geo.tile_row(F.greatest(a["miny"], b["miny"]), zoom))
    pairs = left.join(right, "tile").where(meet & corner).select("area_type", "area_id", "polygons", "type", "id", "x", "y", "coords", "is_area", "bbox")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            rows: dict[tuple, list[int]] = {}
            for k, key in enumerate(zip(batch.column("area_type").to_pylist(), batch.column("area_id").to_pylist())):
                rows.setdefault(key, []).append(k)
            for at in rows.values():
                area = [[[(p["x"], p["y"]) for p in ring[:-1]] for ring in polygon] for polygon in batch.column("polygons")[at[0]].as_py()]
                keep[at] = batch_meets(batch.take(pa.array(at)), area)
            yield batch.select(["area_type", "area_id", "type", "id"]).filter(pa.array(keep))

    return pairs.mapInArrow(run, "area_type string, area_id bigint, type string, id bigint")


def limited(features: DataFrame, n: int = 0) -> DataFrame:
    """The first ``n`` in no particular order; 0 means all."""
    return features.limit(n) if n else features


class Columns:
    """A column list such as ``name,addr:*,*``: exact keys first, then wildcards as listed, then ``*``."""

    def __init__(self, spec: str | None = None):
        self.names = [c.strip() for c in spec.split(",")] if spec else ["*"]
        self.exact = [c for c in self.names if "*" not in c and c not in PSEUDO]
        self.wild = [c for c in self.names if "*" in c and c != "*"]

    def matches(self, key: Column, name: str) -> Column:
        head, _, tail = name.partition("*")
        return key.startswith(head) & key.endswith(tail) & (F.length(key) >= len(head) + len(tail))

    def taken(self, key: Column, before: str) -> Column:
        """Whether an exact column, or a wildcard listed before ``before``, has the key."""
        out = key.isin(self.exact) if self.exact else F.lit(False)
        for name in self.wild:
            if name == before:
                break
            out = out | self.matches(key, name)
        return out

    def part(self, name: str, tags: str = "tags") -> Column:
        """The tags in one column."""
        if name == "*":
            return F.map_filter(tags, lambda k, v: ~self.taken(k, ""))
        if "*" in name:
            return F.map_filter(tags, lambda k, v: self.matches(k, name) & ~self.taken(k, name))
        return F.map_filter(tags, lambda k, v: k == name)

    def value(self, name: str, precision: int = 7) -> Column:
        """One column's text; null if it is empty."""
        if name in ("lon", "lat"):
            return F.round(F.col(name), precision).cast("string")
        if name in ("x", "y"):
            return F.col(name).cast("string")
        if name in ("bbox", "geom"):
            return F.lit(None).cast("string")
        if "*" in name:
            return F.nullif(T.pairs(self.part(name)), F.lit(""))
        return T.value("tags", name)

    def properties(self) -> Column:
        """(key, value) in the order of columns, by key within a wildcard."""
        own = [F.array_sort(F.map_entries(self.part(c))) for c in self.names if c not in PSEUDO]
        return F.concat(*own) if own else F.array().cast("array<struct<key:string,value:string>>")


def projected(features: DataFrame, spec: str | None = None, precision: int = 7) -> DataFrame:
    """(t, id, a text column for each in the list); a repeated name counts up (``name_1``)."""
    c = Columns(spec)
    seen: dict[str, int] = {}
    out = []
    for name in c.names:
        n = seen.get(name, -1) + 1
        seen[name] = n
        out.append(c.value(name, precision).alias(f"{name}_{n}" if n else name))
    return features.select(F.col("type").alias("t"), "id", *out)
