"""Tags: presence, equality, areas, key categories, diff and merge.  A tag table is MAP<STRING, STRING>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Keys that make a closed way an area.  None: any value but ``no``; ("only", ...): these values alone;
#: ("not", ...): any but these.
AREA_KEYS: dict[str, tuple[str, ...] | None] = {
    "aeroway": ("not", "taxiway"),
    "amenity": None,
    "area:highway": None,
    "barrier": ("only", "city_wall", "ditch", "hedge", "retaining_wall", "wall", "spikes"),
    "boundary": None,
    "building": None,
    "building:part": None,
    "craft": None,
    "golf": None,
    "highway": ("only", "services", "rest_area", "escape", "elevator"),
    "historic": None,
    "indoor": None,
    "landuse": None,
    "leisure": None,
    "man_made": ("not", "cutline", "embankment", "pipeline"),
    "military": None,
    "natural": ("not", "coastline", "cliff", "ridge", "arete", "tree_row"),
    "office": None,
    "place": None,
    "power": ("only", "plant", "substation", "generator", "transformer"),
    "public_transport": None,
    "railway": ("only", "station", "turntable", "roundhouse", "platform"),
    "ruins": None,
    "shop": None,
    "tourism": None,
    "waterway": ("only", "riverbank", "dock", "boatyard", "dam"),
}

#: The key categories of the default settings.
INDEXED_KEYS = (
    "place", "highway", "railway", "aeroway", "aerialway", "tourism", "amenity", "shop", "craft", "power", "industrial", "man_made", "leisure", "landuse", "waterway",
    "natural/geological", "military", "historic", "healthcare", "office", "emergency", "building", "boundary", "building:part", "telecom/communication", "route",
)


def value(tags: Column | str, key: str) -> Column:
    return F.try_element_at(F.col(tags) if isinstance(tags, str) else tags, F.lit(key))


def has(tags: Column | str, key: str, no_is_absent: bool = True) -> Column:
    v = value(tags, key)
    return F.coalesce(v.isNotNull() & (v != "no" if no_is_absent else F.lit(True)), F.lit(False))


def equals(tags: Column | str, key: str, wanted: str) -> Column:
    return F.coalesce(value(tags, key) == wanted, F.lit(False))


def says_area(tags: Column | str, keys: dict[str, tuple[str, ...] | None] = AREA_KEYS) -> Column:
    """``area`` decides; without it, any listed key whose value passes its rule."""
    t = F.col(tags) if isinstance(tags, str) else tags
    plain = [k for k, rule in keys.items() if rule is None]
    most = [k for k, rule in keys.items() if rule and rule[0] == "not"]
    bad = [f"{k}={v}" for k, rule in keys.items() if rule and rule[0] == "not" for v in rule[1:]]
    good = [f"{k}={v}" for k, rule in keys.items() if rule and rule[0] == "only" for v in rule[1:]]

    def passes(e: Column) -> Column:
        pair = F.concat(e["key"], F.lit("="), e["value"])
        return (e["value"] != "no") & (e["key"].isin(plain) | (e["key"].isin(most) & ~pair.isin(bad)) | pair.isin(good))

    # one test for each tag that there is, not for each key that there may be
    listed = F.coalesce(F.exists(F.map_entries(t), passes), F.lit(False))
    area = value(t, "area")
    return F.when(area.isNotNull(), area != "no").otherwise(listed)


def categories(indexed: list[str]) -> dict[str, int]:
    """Key -> category number (from 1) of entries such as ``highway`` or ``place/boundary``; 30 at most."""
    if len(indexed) > 30:
        raise ValueError("over 30 key categories")
    out: dict[str, int] = {}
    for n, entry in enumerate(indexed, 1):
        for key in entry.split("/"):
            key = key.strip()
            if key in out:
                raise ValueError(f"{key} is in more than one category")
            out[key] = n
    return out


def key_bits(tags: Column | str, category_of: dict[str, int]) -> Column:
    """Bit n - 1 is 1 if the tags have a key of category n with a value other than ``no``."""
    t = F.col(tags) if isinstance(tags, str) else tags
    if not category_of:
        return F.lit(0)
    bits = F.create_map(*[F.lit(x) for key, n in category_of.items() for x in (key, 1 << n - 1)])

    def added(out: Column, e: Column) -> Column:
        return F.when(e["value"] != "no", out.bitwiseOR(F.coalesce(F.try_element_at(bits, e["key"]), F.lit(0)))).otherwise(out)

    return F.coalesce(F.aggregate(F.map_entries(t), F.lit(0), added), F.lit(0)).cast("int")


def bucket_name(bits: Column, names: dict[int, str], separator: str = "/", none: str = "-") -> Column:
    """The names of the categories in ``bits``."""
    parts = [F.when(bits.bitwiseAND(F.lit(1 << n - 1)) != 0, F.lit(name)) for n, name in sorted(names.items())]
    return F.when(bits == 0, F.lit(none)).otherwise(F.concat_ws(separator, *parts))


def diff(old: Column | str, new: Column | str) -> Column:
    """What turns ``old`` into ``new``; an empty value deletes its key."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (old, new))
    both = F.map_zip_with(a, b, lambda k, x, y: F.when(x.eqNullSafe(y), F.lit(None).cast("string")).otherwise(F.coalesce(y, F.lit(""))))
    return F.map_filter(both, lambda k, v: v.isNotNull())


def merge(old: Column | str, change: Column | str) -> Column:
    """``old`` after ``change``."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (old, change))
    both = F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))
    return F.map_filter(both, lambda k, v: v != "")


def pairs(tags: Column | str) -> Column:
    """``k=v`` in order of keys, comma-joined."""
    t = F.col(tags) if isinstance(tags, str) else tags
    return F.array_join(F.transform(F.array_sort(F.map_entries(t)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")


def without(tags: Column | str, patterns: list[str]) -> Column:
    """Tags less the keys that a pattern names; ``*`` at a pattern's end takes any rest."""
    t = F.col(tags) if isinstance(tags, str) else tags

    def named(key: Column) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | (key.startswith(p[:-1]) if p.endswith("*") else key == p)
        return out

    return F.map_filter(t, lambda k, v: ~named(k))
