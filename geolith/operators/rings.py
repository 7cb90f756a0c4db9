"""Polygons of area relations: member ways stitched into rings, holes put into the shells that hold them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions import geo

POLYGONS = "array<array<array<struct<x:bigint,y:bigint>>>>"
Point = tuple[int, int]


def stitched(lines: list[list[Point]]) -> list[list[Point]]:
    """Closed rings from lines in any order and direction; lines that close no ring are left out."""
    rings = [x for x in lines if len(x) > 3 and x[0] == x[-1]]
    open_lines = [x for x in lines if len(x) > 1 and x[0] != x[-1]]
    at_end: dict[Point, list[int]] = {}
    for k, line in enumerate(open_lines):
        for p in (line[0], line[-1]):
            at_end.setdefault(p, []).append(k)
    used = [False] * len(open_lines)
    for k, line in enumerate(open_lines):
        if used[k]:
            continue
        used[k], chain = True, list(line)
        while chain[0] != chain[-1]:
            follow = next((j for j in at_end[chain[-1]] if not used[j]), None)
            if follow is None:
                break
            used[follow] = True
            more = open_lines[follow]
            chain += more[1:] if more[0] == chain[-1] else more[-2::-1]
        if chain[0] == chain[-1] and len(chain) > 3:
            rings.append(chain)
    return rings


def holds(ring: list[Point], p: Point) -> bool:
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:]):
        if (ay > p[1]) != (by > p[1]) and p[0] < (bx - ax) * (p[1] - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def assembled(outer: list[list[Point]], inner: list[list[Point]]) -> list[list[list[Point]]]:
    """Polygons as a shell and its holes; a hole that no shell holds is left out."""
    shells = [[r] for r in stitched(outer)]
    for hole in stitched(inner):
        home = next((s for s in shells if any(holds(s[0], p) for p in hole[:2])), None)
        if home is not None:
            home.append(hole)
    return shells


def with_polygons(features: DataFrame, library: DataFrame | None = None) -> DataFrame:
    """``features`` with ``polygons``: of areas that are ways their ring, of area relations their assembled polygons,
    null elsewhere.  ``library``: where the ways are, if not in ``features`` themselves: only the relations that were
    selected are assembled then.  A relation's own members meet in one row, as they do in the relation itself."""
    areas = features.where("type = 'R' and is_area").select(F.col("id").alias("rel_id"), F.explode("members").alias("m"))
    parts = areas.where("m.type = 'W'").select("rel_id", F.col("m.id").alias("way_id"), (F.col("m.role") == "inner").alias("is_hole"))
    lines = (features if library is None else library).where("type = 'W' and coords is not null").select(F.col("id").alias("way_id"), "coords")
    grouped = parts.join(lines, "way_id").groupBy("rel_id").agg(F.sort_array(F.collect_list(F.struct("is_hole", "way_id", "coords"))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.int64()), ("y", pa.int64())]))))
        for batch in batches:
            out = []
            for row in batch.column(1).to_pylist():
                own = [(p["is_hole"], [(c["x"], c["y"]) for c in p["coords"]]) for p in row]
                found = assembled([x for h, x in own if not h], [x for h, x in own if h])
                out.append([[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in found] or None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], names=["rel_id", "rel_polygons"])

    made = grouped.mapInArrow(run, f"rel_id bigint, rel_polygons {POLYGONS}")
    # relation ids only meet relations: the key is null for other features
    key = F.when((F.col("type") == "R") & F.col("is_area"), F.col("id"))
    own = F.when((F.col("type") == "W") & F.col("is_area") & F.col("coords").isNotNull(), F.array(F.array("coords"))).cast(POLYGONS)
    return features.join(made, key == F.col("rel_id"), "left").select(*[features[c] for c in features.columns], F.coalesce("rel_polygons", own).alias("polygons"))


def polygons_area_m2(polygons: Column | str = "polygons", box: str = "bbox") -> Column:
    """Shells less holes."""

    def of(polygon: Column) -> Column:
        sizes = F.transform(polygon, lambda ring, i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(-1.0)) * geo.area_m2(ring, box))
        return geo.total(sizes)

    return geo.total(F.transform(geo.col(polygons), of))
