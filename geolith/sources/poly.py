"""Polygon files: a name, then rings of ``lon lat`` lines, each ended by END; a ``!`` before a ring's name is a hole."""

from __future__ import annotations

from pyspark.sql import SparkSession

from geolith.functions import geo


def parse(content: str) -> list[list[list[tuple[int, int]]]]:
    """Polygons as lists of rings of (x, y), each hole with the shell before it."""
    lines = [x.strip() for x in content.splitlines() if x.strip()][1:]
    out: list[list[list[tuple[int, int]]]] = []
    k = 0
    while k < len(lines) and lines[k] != "END":
        hole, ring = lines[k].startswith("!"), []
        k += 1
        while k < len(lines) and lines[k] != "END":
            lon, lat = (float(v) for v in lines[k].split()[:2])
            ring.append((geo.x_at(lon), geo.y_at(lat)))
            k += 1
        if k == len(lines) or len(ring) < 3:
            raise ValueError("a ring of a polygon file is not ended, or has fewer than three points")
        k += 1
        if len(ring) > 3 and ring[0] == ring[-1]:
            ring.pop()
        if hole and out:
            out[-1].append(ring)
        else:
            out.append([ring])
    if not out:
        raise ValueError("a polygon file without rings")
    return out


def read(spark: SparkSession, path: str) -> list[list[list[tuple[int, int]]]]:
    """One small file, read by Spark so that any store will do."""
    (row,) = spark.read.text(path, wholetext=True).take(1)
    return parse(row["value"])
