"""Tallies: count, length, area, roles, keys and tags, with split values, cut-off, others and totals."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolith.functions import geo, text
from geolith.functions import tags as T
from geolith.operators.query import Columns
from geolith.operators.rings import polygons_area_m2

MODES = ("count", "length", "area", "roles", "keys", "tags")


@dataclass(frozen=True)
class CutOff:
    """Rows below are left out: by number of the tally, or by share of the total."""

    tally: float = 0.0
    share: float = 0.01

    @classmethod
    def parse(cls, value: str | None) -> CutOff:
        if value is None:
            return cls()
        number, is_share = text.parse_share(value)
        return cls(0.0, number) if is_share else cls(number, 0.0)


def measure(mode: str, unit: str = "m", assembled: bool = False) -> Column:
    """What a feature adds to a tally.  Areas and points have no length; only areas have an area.

    ``assembled``: features have ``polygons``, so that relations have an area too.
    """
    per_m, per_m2, _, _ = geo.UNITS[unit]
    if mode == "length":
        return F.when(F.col("kind") == "w", geo.length_m("coords") * per_m).otherwise(F.lit(0.0))
    if mode == "area" and assembled:
        return F.coalesce(polygons_area_m2() * per_m2, F.lit(0.0))
    if mode == "area":
        return F.when(F.col("is_area") & F.col("coords").isNotNull(), geo.area_m2("coords") * per_m2).otherwise(F.lit(0.0))
    return F.lit(1.0)


def group_columns(features: DataFrame, columns: str, split: bool) -> tuple[DataFrame, list[str]]:
    """``features`` with g0, g1 ...: a row for each combination of split values.  Wildcards and gaps group as ``-``."""
    out, names = features, []
    for k, name in enumerate(Columns(columns).names):
        v = F.coalesce(T.value("tags", name), F.lit("-")) if "*" not in name else F.lit("-")
        out = out.withColumn(f"g{k}", F.explode(text.split_values(v)) if split and "*" not in name else v)
        names.append(f"g{k}")
    return out, names


def tally(features: DataFrame, mode: str = "count", columns: str = "*", unit: str = "m", split: bool = False, cut: CutOff | None = None) -> DataFrame:
    """(g0 ..., tally, share, kind): kind is ``row``, ``others`` or ``total``.

    Totals count each feature once, before the cut-off; with split values shares may exceed 1.  ``others`` has the
    number of rows left out as g0.
    """
    cut = cut or CutOff()
    own = features.withColumn("m", measure(mode, unit, "polygons" in features.columns))
    exploded, names = group_columns(own, columns, split)
    rows = exploded.groupBy(*names).agg(F.sum("m").alias("tally"))
    total = own.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("total"))
    shared = rows.withColumn("total", total.scalar()).withColumn("share", F.try_divide("tally", "total"))
    return with_others(shared, total, names, cut)


def with_others(shared: DataFrame, total: DataFrame, names: list[str], cut: CutOff) -> DataFrame:
    keep = F.coalesce((F.col("tally") >= cut.tally) & (F.col("share") >= cut.share), F.lit(False))
    kept = shared.where(keep).select(*names, "tally", "share", F.lit("row").alias("kind"))
    rest = shared.where(~keep).agg(F.count("*").alias("n"), F.sum("tally").alias("tally"), F.max("total").alias("total")).where("tally > 0")
    others = rest.select(F.col("n").cast("string").alias(names[0]), *[F.lit("").alias(c) for c in names[1:]], "tally", F.try_divide("tally", "total").alias("share"), F.lit("others").alias("kind"))
    whole = total.select(F.lit("").alias(names[0]), *[F.lit("").alias(c) for c in names[1:]], F.col("total").alias("tally"), F.lit(1.0).alias("share"), F.lit("total").alias("kind"))
    return kept.union(others).union(whole)


def roles(features: DataFrame, columns: str = "*", split: bool = False, cut: CutOff | None = None) -> DataFrame:
    """(g0 ..., role, tally, relations, share, kind): members by role, and the relations that have any in it.

    Features that are not relations count for nothing.
    """
    cut = cut or CutOff()
    own = features.where("type = 'R'")
    exploded, names = group_columns(own, columns, split)
    each = exploded.select("id", *names, F.explode("members").alias("m"))
    each = each.withColumn("role", F.when(F.col("m.role") == "", "(empty)").otherwise(F.col("m.role")))
    per_relation = each.groupBy(*names, "role", "id").agg(F.count("*").alias("n"))
    rows = per_relation.groupBy(*names, "role").agg(F.sum("n").alias("tally"), F.count("*").alias("relations"))
    total = own.agg(F.coalesce(F.sum(F.size("members")), F.lit(0)).cast("long").alias("total"), F.count("*").alias("all_relations"))
    shared = rows.withColumn("total", total.select("total").scalar()).withColumn("share", F.try_divide("tally", "total"))
    keep = F.coalesce((F.col("tally") >= cut.tally) & (F.col("share") >= cut.share), F.lit(False))
    kept = shared.where(keep).select(*names, "role", "tally", "relations", "share", F.lit("row").alias("kind"))
    gone = shared.where(~keep)
    ids = per_relation.join(gone.select(*names, "role"), [*names, "role"], "left_semi").agg(F.countDistinct("id").alias("relations"))
    rest = gone.agg(F.count("*").alias("n"), F.sum("tally").alias("tally"), F.max("total").alias("total")).where("tally > 0").withColumn("relations", ids.scalar())
    blank = [F.lit("").alias(c) for c in [*names[1:], "role"]]
    others = rest.select(F.col("n").cast("string").alias(names[0]), *blank, "tally", "relations", F.try_divide("tally", "total").alias("share"), F.lit("others").alias("kind"))
    whole = total.select(F.lit("").alias(names[0]), *blank, F.col("total").alias("tally"), F.col("all_relations").alias("relations"), F.lit(1.0).alias("share"), F.lit("total").alias("kind"))
    return kept.union(others).union(whole)


def keys(features: DataFrame, columns: str = "*", cut: CutOff | None = None) -> DataFrame:
    """(key, value, tally, of_key, of_all): a row with a null value for each key, and one for each key and value.

    of_key: share of the features with the key; of_all: share of all features, by which the cut-off goes.
    """
    cut = cut or CutOff(0.0, 0.0)
    pairs = features.select(F.explode(Columns(columns).properties()).alias("e")).select("e.key", "e.value")
    sets = pairs.groupingSets([["key"], ["key", "value"]], "key", "value").agg(F.count("*").alias("tally"), F.grouping("value").alias("is_key"))
    rows = sets.select("key", F.when(F.col("is_key") == 0, F.col("value")).alias("value"), "tally", "is_key")
    parent = F.max(F.when(F.col("is_key") == 1, F.col("tally"))).over(W.partitionBy("key"))
    total = features.agg(F.count("*").alias("total"))
    out = rows.withColumn("parent", parent).withColumn("total", total.scalar()).withColumn("of_all", F.try_divide("tally", "total"))
    out = out.where((F.col("tally") >= cut.tally) & (F.col("of_all") >= cut.share))
    return out.select("key", "value", "tally", F.when(F.col("is_key") == 0, F.col("tally") / F.col("parent")).alias("of_key"), "of_all")


def keys_totals(features: DataFrame, columns: str = "*") -> DataFrame:
    """(features, keys, pairs, tags): before any cut-off."""
    pairs = features.select(F.explode(Columns(columns).properties()).alias("e")).select("e.key", "e.value")
    counts = pairs.groupBy("key", "value").agg(F.count("*").alias("n"))
    out = counts.agg(F.countDistinct("key").alias("keys"), F.count("*").alias("pairs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tags"))
    return out.withColumn("features", features.agg(F.count("*")).scalar()).select("features", "keys", "pairs", "tags")


def ordered(rows: DataFrame, mode: str, lexical: bool = False) -> DataFrame:
    """In the order of the report: by tally, groups breaking ties; keys with their values under them; or lexically."""
    if mode == "keys" and not lexical:
        parent = F.max(F.when(F.col("value").isNull(), F.col("tally"))).over(W.partitionBy("key"))
        return rows.withColumn("parent", parent).orderBy(F.desc("parent"), "key", F.col("value").isNotNull(), F.desc("tally"), "value").drop("parent")
    names = [c for c in rows.columns if c in ("key", "value", "role") or (c[:1] == "g" and c[1:].isdigit())]
    last = [F.when(F.col("kind") == "row", 0).when(F.col("kind") == "others", 1).otherwise(2)] if "kind" in rows.columns else []
    return rows.orderBy(*last, *([] if lexical else [F.desc("tally")]), *names)
