"""Command line: ``python -m geolith.cli COMMAND ...``.

    build LIBRARY SOURCE [-c SETTINGS] [-k] [-u] [--NAME=VALUE ...]    from .osm, .osm.pbf; goes on where it broke off
    query LIBRARY SELECTOR [-b BOX|TILE] [-a POLY] [-f FORMAT[:OPTION[=VALUE]]...] [-t COLUMNS] [-l N] [--precision=N]
    info LIBRARY [-i] [-t] [-f]         check LIBRARY
    save LIBRARY FOLDER [-b BOX] [-a POLY]      load LIBRARY FOLDER [-b BOX] [-a POLY] [-n]
    update LIBRARY CHANGES OUT          strings LIBRARY         debug LIBRARY [TILE]

All take -s (silent), -q (quiet), -v (verbose), -d (debug).  Formats: list, csv, fab, geojson, geojsonl, xml, wkt,
count, map, poly, stats, table, null.

Exit codes: 0 done, 2 bad arguments, 4 a file can't be read or written, 5 an invalid library, 10 out of memory, 127 an
internal error.
"""

from __future__ import annotations

import json
import sys
import time
import traceback
from collections.abc import Callable, Iterator

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolith.functions import tags as T
from geolith.functions.text import parse_choice
from geolith.operators import build, changes, closure, query, reports, rings, stats
from geolith.plans import selector
from geolith.sinks import formats
from geolith.sources import library, osm_xml, pbf, poly, settings
from geolith.work import deleted, exists

#: How much is said, by option.
VERBOSITY = {"s": -2, "silent": -2, "q": -1, "quiet": -1, "v": 1, "verbose": 1, "d": 2, "debug": 2}
FORMAT_OPTIONS = {
    "stats": {"tally", "unit", "split-values", "min-tally", "sort", "max-width"},
    "table": {"max-width"},
    "map": {"basemap", "attribution", "color", "link"},
}
RAW = ("nodes", "ways", "way_nodes", "relations", "members")


class UsageError(ValueError):
    pass


def parse(args: list[str], with_value: set[str], flags: set[str] = frozenset(), open_ended: bool = False) -> tuple[list[str], dict[str, str | None]]:
    """Positional arguments and options: ``-k v``, ``-k=v``, ``--k=v``, ``-f:x=v``.  An option that is not known is an
    error, unless the command takes any (``open_ended``)."""
    places, options = [], {}
    k = 0
    while k < len(args):
        a = args[k]
        if a.startswith("-") and len(a) > 1 and not a[1].isdigit():
            name, eq, value = a.lstrip("-").partition("=")
            head = name.partition(":")[0]
            if not open_ended and head not in with_value and name not in flags and name not in VERBOSITY:
                raise UsageError(f"unknown option: {a}")
            if not eq and name in with_value:
                if k + 1 == len(args):
                    raise UsageError(f"-{name} needs a value")
                k += 1
                value = args[k]
            if name not in VERBOSITY:
                options[name] = value if eq or name in with_value else None
        else:
            places.append(a)
        k += 1
    return places, options


def verbosity(args: list[str]) -> int:
    """From -2 (silent) to 2 (debug); the last one counts."""
    found = [VERBOSITY[a.lstrip("-")] for a in args if a.startswith("-") and a.lstrip("-") in VERBOSITY]
    return found[-1] if found else 0


def needed(places: list[str], names: list[str], most: int | None = None) -> list[str]:
    if len(places) < len(names):
        raise UsageError(f"missing: {names[len(places)]}")
    if most is not None and len(places) > most:
        raise UsageError(f"not expected: {places[most]}")
    return places


def either(options: dict, *names: str) -> str | None:
    return next((options[n] for n in names if options.get(n)), None)


# --- build


def state_of(spark: SparkSession, work: str) -> dict:
    """The marker of a build that broke off: its steps done and what it was of."""
    if not exists(spark, f"{work}/state"):
        return {"task": 0}
    return json.loads(spark.read.text(f"{work}/state", wholetext=True).first()["value"])


def mark(spark: SparkSession, work: str, state: dict) -> None:
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{work}/state")


def run_build(spark: SparkSession, args: list[str]) -> str:
    """Three steps, each stored: the raw tables, the features, the library.  A build of the same source and settings
    goes on after the last step that was done; ``-k`` keeps what the steps stored."""
    places, options = parse(args, {"c", "config"}, open_ended=True)
    path, source = needed(places, ["library", "source"], 2)
    config, keep = either(options, "c", "config"), bool({"k", "keep-work"} & {*options})
    for name in ("c", "config", "k", "keep-work"):
        options.pop(name, None)
    if config is None and exists(spark, f"{path}.fab"):
        config = f"{path}.fab"
    own = settings.parse(spark.read.text(config, wholetext=True).first()["value"]) if config else settings.Settings()
    for name, value in options.items():
        own.set({"u": "updatable"}.get(name, name), value or "")
    work = f"{path.rstrip('/')}/_work"
    what = json.dumps([source, repr(own)])
    state = state_of(spark, work)
    if state.get("what") != what:
        deleted(spark, work)
        state = {"task": 0, "what": what}

    def done(task: int) -> None:
        state["task"] = task
        mark(spark, work, state)

    if state["task"] < 1:
        raw = pbf.frames(spark, source) if source.endswith(".pbf") else osm_xml.read(spark, source)
        for name in RAW:
            df = raw[name]
            if own.excluded_keys and "tags" in df.columns:
                df = df.withColumn("tags", T.without("tags", list(own.excluded_keys)))
            df.write.mode("overwrite").parquet(f"{work}/{name}")
        done(1)
    tables = {name: spark.read.parquet(f"{work}/{name}") for name in RAW}
    if state["task"] < 2:
        f = build.features(*(tables[name] for name in RAW), own.indexed_keys, own.tag_duplicate_nodes or own.tag_orphan_nodes)
        f.write.mode("overwrite").parquet(f"{work}/features")
        done(2)
    f = spark.read.parquet(f"{work}/features")
    tiles = build.tile_pyramid(build.node_density(tables["nodes"]), own.tile_zoom_levels, own.max_tiles, own.min_tile_density)
    tiles.write.mode("overwrite").parquet(f"{work}/tiles")
    strings = reports.top_strings(reports.string_counts(f, tables["members"]), own.max_strings, own.min_string_usage, own.indexed_keys)
    strings.write.mode("overwrite").parquet(f"{path.rstrip('/')}/strings")
    if not own.has_id_index and own.id_indexing is False:  # the ids of nodes that are no features are not kept
        f = f.withColumn("node_ids", F.lit(None).cast("array<bigint>"))
    extra = {"indexed-keys": list(own.indexed_keys), "properties": own.properties, "source": own.source, "updatable": own.updatable}
    guid = library.write(f, path, extra=extra, mode="overwrite", tiles=spark.read.parquet(f"{work}/tiles"), most_buckets=own.max_key_indexes, least_features=own.key_index_min_features, updatable=own.updatable, page_rows=64 * own.rtree_bucket_size)
    done(3)
    if not keep:
        deleted(spark, work)
    return f"{guid}\n"


# --- query


def area_of(spark: SparkSession, options: dict) -> tuple[str | None, list | None]:
    """(box, area) of -b and -a; the area outranks the box."""
    area = either(options, "a", "area")
    return (None, poly.read(spark, area)) if area else (either(options, "b", "bbox"), None)


def run_query(spark: SparkSession, args: list[str]) -> str | Iterator[str]:
    places, options = parse(args, {"b", "bbox", "a", "area", "f", "format", "t", "tags", "l", "limit", "precision"})
    needed(places, ["library", "selector"])
    text = " ".join(places[1:])
    form, extra = "list", {}
    for name, value in list(options.items()):
        head, colon, option = name.partition(":")
        if head in ("f", "format"):
            if colon:
                extra[option] = value
            else:
                form = value or "list"
    if form not in formats.FORMATS:
        raise UsageError(f"unknown format: {form}")
    every = set().union(*FORMAT_OPTIONS.values())
    for option in extra:
        if option not in every:
            raise UsageError(f"unknown option: {option}")
        if option not in FORMAT_OPTIONS.get(form, ()):
            raise UsageError(f"{form} has no option {option}")
    columns, limit, precision = either(options, "t", "tags"), int(either(options, "l", "limit") or 0), int(options.get("precision") or 7)
    if not 0 <= precision <= 15:
        raise UsageError("precision must be between 0 and 15")
    meta = library.properties(spark, places[0])
    box, area = area_of(spark, options)
    indexed = meta.get("indexed-keys") and list(meta["indexed-keys"])
    kinds, bits = selector.pruning(text, T.categories(indexed) if indexed else None)
    stored = library.read(spark, places[0], kinds, box=query.box_of(box, area), bits=bits)
    rows = query.limited(query.within(query.select(stored, text, indexed), box, area), limit)
    if form in ("geojson", "geojsonl", "wkt", "map") or extra.get("tally") == "area":
        # polygons and collections of what was selected only; their members may lie anywhere
        whole = library.read(spark, places[0])
        rows = rings.with_polygons(rows, whole)
        if form in ("geojson", "geojsonl", "map"):
            rows = formats.with_collections(rows, whole, precision)
    if form == "count":
        return f"{rows.count()}\n"
    if form == "null":
        rows.write.format("noop").mode("overwrite").save()
        return ""
    if form == "stats":
        return run_stats(rows, columns, extra)
    width = int(extra.get("max-width") or 100)
    if form == "table":
        return formats.feature_table_lines(rows, columns, max_width=width)
    if form == "map":
        return formats.map_lines(rows, columns, **{k: v for k, v in extra.items() if v is not None})
    if form == "xml":
        found, bare = closure.with_references(library.read(spark, places[0]), rows.select("type", "id"))
        return formats.streamed(found, form, None, precision, bare)
    return formats.streamed(rows, form, columns, precision)


def run_stats(rows: DataFrame, columns: str | None, extra: dict) -> Iterator[str]:
    mode = parse_choice(extra.get("tally") or "keys", stats.MODES)
    cut = stats.CutOff.parse(extra.get("min-tally"))
    split, lexical = "split-values" in extra, "sort" in extra
    width = int(extra.get("max-width") or 100)
    names = query.Columns(columns).names
    titles = {"others": "(others)", "total": "Total"}

    def titled(r, *cells) -> tuple:
        return (f"{titles[r['kind']]} {cells[0]}".strip(), *cells[1:]) if r["kind"] in titles else cells

    if mode in ("keys", "tags"):
        table, header = stats.keys(rows, columns or "*", cut), ["Key", "Value", "Count", "/key", "/count"]

        def cells(r) -> tuple:
            return r["key"] if r["value"] is None or mode == "tags" else "", r["value"] if r["value"] is not None else "*", r["tally"], r["of_key"], r["of_all"]

    elif mode == "roles":
        table, header = stats.roles(rows, columns or "*", split, cut), [*names, "Role", "Members", "Relations", "Share"]

        def cells(r) -> tuple:
            return titled(r, *[r[f"g{k}"] for k in range(len(names))], r["role"], r["tally"], r["relations"], r["share"])

    else:
        table, header = stats.tally(rows, mode, columns or "*", extra.get("unit") or "m", split, cut), [*names, "Tally", "Share"]

        def cells(r) -> tuple:
            return titled(r, *[r[f"g{k}"] for k in range(len(names))], round(r["tally"]), r["share"])

    ordered = stats.ordered(table, mode, lexical)
    return formats.table_lines(lambda: (cells(r) for r in ordered.toLocalIterator()), header, width)


# --- the other commands


def run_info(spark: SparkSession, args: list[str]) -> Iterator[str]:
    places, options = parse(args, set(), {"i", "t", "f"})
    (path,) = needed(places, ["library"], 1)
    meta = library.properties(spark, path)
    rows = library.read(spark, path)

    def made() -> Iterator[str]:
        for r in reports.info(rows, meta["guid"]).collect():  # a few rows
            yield f"{r['name']}: {r['value']}\n"
        if "i" in options:
            index = reports.index_report(rows).orderBy("kind", F.desc("n"), "key")
            yield from formats.table_lines(lambda: (tuple(r) for r in index.toLocalIterator()), ["Class", "Key", "Features", "Share"])
        if "t" in options:
            tiles = rows.groupBy("tile").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tile")
            yield from formats.table_lines(lambda: ((r["tile"], r["n"]) for r in tiles.toLocalIterator()), ["Tile", "Features"])
        if "f" in options:
            sizes = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{path.rstrip('/')}/features").select(F.col("length").alias("bytes"))
            pages = reports.size_histogram(sizes)
            yield from formats.table_lines(lambda: ((r["pages"], r["n"]) for r in pages.toLocalIterator()), ["Pages", "Files"])

    return made()


def chosen_tiles(spark: SparkSession, path: str, options: dict) -> list[str] | None:
    """The tiles with features in the box or area that is asked for."""
    box, area = area_of(spark, options)
    if not box and not area:
        return None
    return library.tiles_of(query.within(library.read(spark, path, box=query.box_of(box, area), keep_parts=True), box, area))


PLACE = {"b", "bbox", "a", "area"}


def run_save(spark: SparkSession, args: list[str]) -> str:
    places, options = parse(args, PLACE)
    path, to = needed(places, ["library", "folder"], 2)
    return f"{library.save(spark, path, to, chosen_tiles(spark, path, options))} tiles\n"


def run_load(spark: SparkSession, args: list[str]) -> str:
    places, options = parse(args, PLACE | {"u", "url"}, {"n", "new"})
    if source := either(options, "u", "url"):
        places = [*places, source]
    path, source = needed(places, ["library", "folder"], 2)
    if {"n", "new"} & {*options} and exists(spark, f"{path.rstrip('/')}/_library"):
        raise UsageError(f"{path} is a library already")
    return f"{library.load(spark, path, source, chosen_tiles(spark, source, options))} tiles\n"


def run_check(spark: SparkSession, args: list[str]) -> str:
    (path,) = needed(parse(args, set())[0], ["library"], 1)
    found = library.check(library.read(spark, path)).collect()  # a row for each kind of error
    if found:
        raise library.LibraryError("; ".join(f"{r['error']}: {r['n']}" for r in found))
    return "no errors\n"


def run_update(spark: SparkSession, args: list[str]) -> str:
    """The library's features built again from its raw tables after the changes."""
    path, source, to = needed(parse(args, set())[0], ["library", "changes", "out"], 3)
    meta = library.properties(spark, path)
    own = library.read(spark, path)
    if not own.where("type = 'W' and not is_missing and node_ids is null").isEmpty():
        raise library.LibraryError(f"{path} was built without the ids of nodes")
    raw = changes.apply_all(changes.raw_of(own, library.way_nodes(spark, path)), osm_xml.read_changes(spark, source))
    f = build.features(raw["nodes"], raw["ways"], raw["way_nodes"], raw["relations"], raw["members"], meta.get("indexed-keys") or settings.Settings().indexed_keys)
    return f"{library.write(f, to, meta.pop('guid'), meta, updatable=bool(meta.get('updatable')))}\n"


def run_strings(spark: SparkSession, args: list[str]) -> Iterator[str]:
    (path,) = needed(parse(args, set())[0], ["library"], 1)
    return (r["string"] + "\n" for r in reports.strings_in_use(library.read(spark, path)).orderBy("string").toLocalIterator())


def run_debug(spark: SparkSession, args: list[str]) -> Iterator[str]:
    """What a tile's partitions hold: each feature with its parents and places; without a tile, the partitions."""
    places, _ = parse(args, set())
    path = needed(places, ["library"], 2)[0]
    library.properties(spark, path)
    if len(places) == 1:
        parts = spark.read.parquet(f"{path.rstrip('/')}/parts").orderBy(*library.PARTS)
        header = [*library.PARTS, *library.COVER, "n"]
        return formats.table_lines(lambda: (tuple(r[c] for c in header) for r in parts.toLocalIterator()), header, 200)
    own = library.read(spark, path, keep_parts=True).where(F.col("tile_part") == places[1].replace("/", "-"))
    n = F.coalesce(F.size("coords"), F.size("members"), F.lit(0))
    line = F.concat_ws(" ", F.concat("type", F.col("id").cast("string")), "kind", F.to_json("bbox"), F.concat(F.lit("parts="), n.cast("string")), F.concat(F.lit("parents="), F.array_join(F.transform("parents", lambda p: p.cast("string")), ",")), T.pairs("tags"))
    return (r["line"] + "\n" for r in formats.in_order(own.select("type", "id", line.alias("line"))).toLocalIterator())


def run_help(spark: SparkSession | None, args: list[str]) -> str:
    return __doc__ or ""


COMMANDS: dict[str, Callable] = {
    "build": run_build,
    "query": run_query,
    "info": run_info,
    "save": run_save,
    "load": run_load,
    "check": run_check,
    "update": run_update,
    "strings": run_strings,
    "debug": run_debug,
    "help": run_help,
}


def failure(e: BaseException) -> tuple[int, str]:
    """(exit code, what to say)."""
    if isinstance(e, library.LibraryError):
        return 5, f"invalid library: {e}"
    if isinstance(e, MemoryError) or "OutOfMemoryError" in str(e):
        return 10, "out of memory"
    if isinstance(e, OSError | AnalysisException):
        return 4, f"can't read or write: {e}"
    if isinstance(e, UsageError | selector.SelectorError | ValueError):
        return 2, f"bad arguments: {e}"
    return 127, f"internal error: {e}"


def main(args: list[str], spark: SparkSession | None = None) -> int:
    if not args or args[0] not in COMMANDS:
        print(__doc__, file=sys.stderr)
        return 2 if args else 0
    level, began = verbosity(args[1:]), time.perf_counter()
    try:
        if args[0] != "help" and spark is None:
            spark = SparkSession.builder.appName("geolith").getOrCreate()
            spark.sparkContext.setLogLevel("INFO" if level >= 2 else "WARN" if level == 1 else "ERROR")
        out = COMMANDS[args[0]](spark, args[1:])
        for piece in [out] if isinstance(out, str) else out:
            sys.stdout.write(piece)
        if level >= 1:
            print(f"{args[0]}: {time.perf_counter() - began:.1f} s", file=sys.stderr)
        return 0
    except Exception as e:  # noqa: BLE001
        code, said = failure(e)
        if level > -2:
            print(said, file=sys.stderr)
        if level >= 2:
            traceback.print_exc()
        return code


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
