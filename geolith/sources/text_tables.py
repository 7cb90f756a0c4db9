"""Small text tables between build steps: string summaries (TSV), node densities (CSV), tile catalogs (TSV)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolith.functions import geo
from geolith.operators import reports

STRINGS = "String string, Total long, Keys long, Values long, Roles long"
DENSITY = "col int, row int, n long"
CATALOG = "TIP string, Tile string"


def write_strings(counts: DataFrame, path: str, least: int = 100) -> None:
    """Cleaned strings in use, the most used first."""
    reports.string_summary(counts, least).toDF("String", "Total", "Keys", "Values", "Roles").write.options(sep="\t", header=True).csv(path)


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """(string, total, keys, values, roles)."""
    return spark.read.options(sep="\t", header=True).schema(STRINGS).csv(path).toDF("string", "total", "keys", "values", "roles")


def write_density(density: DataFrame, path: str) -> None:
    density.select("col", "row", "n").write.csv(path)


def read_density(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DENSITY).csv(path)


def catalog(tiles: DataFrame) -> DataFrame:
    """(TIP, Tile): numbers in hexadecimal from 1, in order of zoom, column and row.  A tile set is bounded."""
    n = F.row_number().over(W.orderBy("zoom", "col", "row"))
    return tiles.select(F.hex(n).alias("TIP"), F.concat_ws("/", *[F.col(c).cast("string") for c in ("zoom", "col", "row")]).alias("Tile"))


def write_catalog(tiles: DataFrame, path: str) -> None:
    catalog(tiles).coalesce(1).write.options(sep="\t", header=True).csv(path)


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """(zoom, col, row, tip)."""
    raw = spark.read.options(sep="\t", header=True).schema(CATALOG).csv(path)
    part = F.split("Tile", "/")
    return raw.select(part[0].cast("int").alias("zoom"), part[1].cast("int").alias("col"), part[2].cast("int").alias("row"), F.conv("TIP", 16, 10).cast("long").alias("tip"))


def tile_map(tiles: DataFrame, limit: int = 0) -> str:
    """A page that shows the tiles of a set, ``limit`` at most if it is not 0, with their numbers of nodes."""
    ordered = tiles.orderBy("zoom", "col", "row")
    rows = (ordered.limit(limit) if limit else ordered).collect()
    shapes = []
    for r in rows:
        x0, y0, x1, y1 = geo.tile_bounds(r["zoom"], r["col"], r["row"])
        size = 1 / geo.WORLD
        shapes.append(f'<rect x="{(x0 + geo.HALF) * size:.6f}" y="{(geo.HALF - 1 - y1) * size:.6f}" width="{(x1 - x0 + 1) * size:.6f}" height="{(y1 - y0 + 1) * size:.6f}"><title>{r["zoom"]}/{r["col"]}/{r["row"]}: {r["n"]}</title></rect>')
    return '<!DOCTYPE html><html><body style="margin:0"><svg viewBox="0 0 1 1" style="width:100vmin;height:100vmin" fill="none" stroke="blue" stroke-width="0.0005" pointer-events="all">' + "".join(shapes) + "</svg></body></html>\n"
