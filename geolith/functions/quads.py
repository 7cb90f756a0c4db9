"""Quads: up to four neighbouring tiles of one zoom level, by their north-west tile and a bit for each of the four.

struct(zoom, col, row, tiles): 1 is the tile itself, 2 the one east, 4 the one south, 8 the one south-east.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (bit, columns east, rows south) of the four tiles.
PLACES = ((1, 0, 0), (2, 1, 0), (4, 0, 1), (8, 1, 1))


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def up_by(c: Column, by: Column) -> Column:
    return F.call_function("shiftright", c, by)


def of_tiles(tiles: Column, zoom: int) -> Column:
    """The deepest quad that holds all ``tiles`` (col, row at ``zoom``); null of none."""

    def ends(t: Column) -> Column:
        cols, rows = F.transform(t, lambda x: x["col"]), F.transform(t, lambda x: x["row"])
        return F.struct(t.alias("t"), F.array_min(cols).alias("c0"), F.array_max(cols).alias("c1"), F.array_min(rows).alias("r0"), F.array_max(rows).alias("r1"))

    def levels(e: Column) -> Column:
        fit = F.filter(F.sequence(F.lit(0), F.lit(zoom)), lambda u: (up_by(e["c1"], u) - up_by(e["c0"], u) <= 1) & (up_by(e["r1"], u) - up_by(e["r0"], u) <= 1))
        return F.struct(e.alias("e"), F.try_element_at(fit, F.lit(1)).alias("up"))

    def quad(x: Column) -> Column:
        e, up = x["e"], x["up"]
        col, row = up_by(e["c0"], up), up_by(e["r0"], up)
        place = lambda t: F.when(up_by(t["col"], up) == col, F.when(up_by(t["row"], up) == row, 1).otherwise(4)).otherwise(F.when(up_by(t["row"], up) == row, 2).otherwise(8))
        bits = F.aggregate(F.array_distinct(F.transform(e["t"], place)), F.lit(0), lambda b, p: b + p)
        return F.when(up.isNotNull(), F.struct((F.lit(zoom) - up).alias("zoom"), col.alias("col"), row.alias("row"), bits.alias("tiles")))

    return bind(bind(bind(tiles, ends), levels), quad)


def tiles_of(quad: Column) -> Column:
    """The tiles (zoom, col, row) of a quad."""

    def listed(q: Column) -> Column:
        every = [F.struct(F.lit(bit).alias("bit"), q["zoom"].alias("zoom"), (q["col"] + east).alias("col"), (q["row"] + south).alias("row")) for bit, east, south in PLACES]
        own = F.filter(F.array(*every), lambda t: q["tiles"].bitwiseAND(t["bit"]) != 0)
        return F.transform(own, lambda t: F.struct(t["zoom"].alias("zoom"), t["col"].alias("col"), t["row"].alias("row")))

    return bind(quad, listed)


def added(a: Column, b: Column, zoom: int) -> Column:
    """The quad around two quads of ``zoom``."""
    bare = lambda q: F.transform(tiles_of(q), lambda t: F.struct(t["col"].alias("col"), t["row"].alias("row")))
    return of_tiles(F.array_union(bare(a), bare(b)), zoom)


def subtracted(a: Column, b: Column) -> Column:
    """The tiles of one quad that another of the same zoom does not have."""
    return F.array_except(tiles_of(a), tiles_of(b))


def zoomed_out(quad: Column, by: int, zoom: int) -> Column:
    """The quad of ``zoom``, ``by`` levels up."""
    up = F.transform(tiles_of(quad), lambda t: F.struct(F.shiftright(t["col"], by).alias("col"), F.shiftright(t["row"], by).alias("row")))
    return of_tiles(F.array_distinct(up), zoom - by)


def validated(features: DataFrame, tiles: DataFrame, zooms=(0, 3, 6, 9, 12), base: int = 12) -> DataFrame:
    """``features`` (type, id, tiles: array of (col, row) at ``base``) -> (type, id, zoom, col, row): the tiles of the
    deepest quad whose tiles are all in the tile set ``tiles`` (zoom, col, row), which is small by construction."""
    own = features.select("type", "id", F.explode(F.array(*[zoomed(F.col("tiles"), base, z) for z in sorted(zooms)])).alias("quad")).where("quad is not null")
    each = own.select("type", "id", F.explode(tiles_of(F.col("quad"))).alias("t")).select("type", "id", "t.*")
    known = tiles.select("zoom", "col", "row", F.lit(True).alias("known"))
    met = each.join(F.broadcast(known), ["zoom", "col", "row"], "left")
    deepest = met.groupBy("type", "id", "zoom").agg(F.count("*").alias("n"), F.count("known").alias("n_known"), F.collect_list(F.struct("col", "row")).alias("own"))
    best = deepest.where("n = n_known").groupBy("type", "id").agg(F.max_by("own", "zoom").alias("own"), F.max("zoom").alias("zoom"))
    return best.select("type", "id", "zoom", F.explode("own").alias("t")).select("type", "id", "zoom", "t.col", "t.row")


def zoomed(tiles: Column, base: int, zoom: int) -> Column:
    """The quad of tiles at ``base``, at ``zoom`` if four tiles of it are enough, else null."""
    up = F.array_distinct(F.transform(tiles, lambda t: F.struct(F.shiftright(t["col"], base - zoom).alias("col"), F.shiftright(t["row"], base - zoom).alias("row"))))
    quad = of_tiles(up, zoom)
    return F.when(quad["zoom"] == zoom, quad)
