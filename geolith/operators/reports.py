"""Reports on sources, strings, indexes, tiles and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolith.functions import tags as T
from geolith.functions import text


def string_counts(features: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """(string, total, keys, values, roles): how often each string is a key, a value and a role; exact."""
    tags = features.select(F.explode("tags").alias("k", "v"))
    used = tags.select(F.col("k").alias("s"), F.lit(1).alias("k"), F.lit(0).alias("v"), F.lit(0).alias("r")).union(tags.select("v", F.lit(0), F.lit(1), F.lit(0)))
    if members is not None:
        used = used.union(members.select("role", F.lit(0), F.lit(0), F.lit(1)))
    out = used.groupBy("s").agg(F.count("*").alias("total"), F.sum("k").alias("keys"), F.sum("v").alias("values"), F.sum("r").alias("roles"))
    return out.select(F.col("s").alias("string"), "total", "keys", "values", "roles")


def string_summary(counts: DataFrame, least: int = 100) -> DataFrame:
    """Cleaned strings that are used ``least`` times or more, the most used first."""
    own = counts.where(F.col("total") >= least).withColumn("string", text.cleaned(F.col("string"))).where("string != ''")
    return own.orderBy(F.desc("total"), "string")


def top_strings(counts: DataFrame, most: int = 32000, least_usage: int = 300, indexed=T.INDEXED_KEYS) -> DataFrame:
    """(string, weight) of the strings that a dictionary would hold: indexed keys first, then by weighted use.

    Values that are numbers do not count, as they need no dictionary.
    """
    known = list(T.categories(list(indexed)))
    narrow = text.narrow_number(F.col("string")).isNotNull()
    values = F.when(narrow, 0).otherwise(F.col("values"))
    is_key = F.col("string").isin(known)
    usage = F.col("keys") + F.col("roles") + values
    weight = 5 * F.col("keys") + 2 * F.col("roles") + values + F.when(is_key, F.lit(10**13)).otherwise(F.lit(0))
    own = counts.where((F.col("total") >= 2) & (is_key | (usage >= least_usage)))
    return own.select("string", weight.cast("long").alias("weight")).orderBy(F.desc("weight"), "string").limit(most)


def source_stats(nodes: DataFrame, way_nodes: DataFrame, ways: DataFrame, relations: DataFrame, members: DataFrame) -> DataFrame:
    """One row: how many nodes, ways, relations, their parts and tags, and the largest."""
    n = nodes.agg(F.count("*").alias("nodes"), F.count_if(F.size("tags") > 0).alias("tagged_nodes"), F.sum(F.size("tags")).alias("node_tags"), F.max("id").alias("max_node_id"))
    wn = way_nodes.groupBy("way_id").agg(F.count("*").alias("n"))
    most = wn.agg(F.sum("n").alias("way_nodes"), F.max(F.struct(F.col("n"), (-F.col("way_id")).alias("w"))).alias("m")).select("way_nodes", F.col("m.n").alias("max_way_nodes"), (-F.col("m.w")).alias("max_way_nodes_id"))
    w = ways.agg(F.count("*").alias("ways"), F.sum(F.size("tags")).alias("way_tags"), F.max("id").alias("max_way_id"))
    own = members.groupBy("rel_id").agg(F.count("*").alias("n"), F.max(((F.col("type") == "R") & (F.col("id") != F.col("rel_id"))).cast("int")).alias("is_super"))
    r = relations.join(own, relations["id"] == own["rel_id"], "left").agg(
        F.count("*").alias("relations"),
        F.sum(F.size("tags")).alias("relation_tags"),
        F.max("id").alias("max_relation_id"),
        F.count_if(F.col("n").isNull()).alias("empty_relations"),
        F.coalesce(F.sum("is_super"), F.lit(0)).alias("super_relations"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("members"),
        F.coalesce(F.max("n"), F.lit(0)).alias("max_members"),
    )
    out = n
    for k, other in enumerate((most, w, r)):
        out = out.withColumn(f"part{k}", other.select(F.struct("*")).scalar())
    return out.select(*n.columns, "part0.*", "part1.*", "part2.*")


def index_report(features: DataFrame, indexed=T.INDEXED_KEYS) -> DataFrame:
    """(kind, key, n, of_kind): per class and for ``all``, the features with each indexed key; ``(multiple)`` have
    more than one, ``(unindexed)`` none.  The value ``no`` does not count."""
    known = list(T.categories(list(indexed)))
    own = F.filter(F.array(*map(F.lit, known)), lambda k: F.coalesce(F.try_element_at("tags", k) != "no", F.lit(False)))
    rows = features.select("kind", own.alias("own"))
    extra = F.when(F.size("own") > 1, F.array(F.lit("(multiple)"))).when(F.size("own") == 0, F.array(F.lit("(unindexed)"))).otherwise(F.array().cast("array<string>"))
    each = rows.withColumn("key", F.explode(F.concat("own", extra))).select(F.explode(F.array("kind", F.lit("all"))).alias("kind"), "key")
    totals = rows.select(F.explode(F.array("kind", F.lit("all"))).alias("kind")).groupBy("kind").agg(F.count("*").alias("total"))
    return each.groupBy("kind", "key").agg(F.count("*").alias("n")).join(totals, "kind").select("kind", "key", "n", (F.col("n") / F.col("total")).alias("of_kind"))


def tile_report(sizes: DataFrame) -> DataFrame:
    """(zoom, tiles, loaded, min_kb, avg_kb, max_kb, total_kb, share) from (zoom, bytes); null bytes: not loaded."""
    kb = F.col("bytes") / 1024
    out = sizes.groupBy("zoom").agg(F.count("*").alias("tiles"), F.count("bytes").alias("loaded"), F.min(kb).alias("min_kb"), F.avg(kb).alias("avg_kb"), F.max(kb).alias("max_kb"), F.coalesce(F.sum(kb), F.lit(0.0)).alias("total_kb"))
    return out.withColumn("share", F.try_divide("total_kb", sizes.agg(F.sum(kb)).scalar())).orderBy("zoom")


def size_histogram(sizes: DataFrame, page: int = 4096) -> DataFrame:
    """(pages, n): how many files take so many pages, four bytes of header included."""
    pages = F.ceil((F.col("bytes") + 4) / page)
    return sizes.where("bytes is not null").groupBy(pages.alias("pages")).agg(F.count("*").alias("n")).orderBy("pages")


def change_report(changes: DataFrame) -> DataFrame:
    """(type, change, n, tags, users)."""
    return changes.groupBy("type", "change").agg(F.count("*").alias("n"), F.sum(F.size("tags")).alias("tags"), F.countDistinct("user").alias("users"))


def change_completeness(changed_ways: DataFrame, changed_nodes: DataFrame, changed_members: DataFrame | None = None) -> DataFrame:
    """(way_nodes, distinct_way_nodes, ways, complete_ways, members, distinct_members): complete ways have all their
    nodes in the change file.

    ``changed_ways``: (way_id, node_id); ``changed_members``: (rel_id, type, id)."""
    here = changed_nodes.select(F.col("id").alias("node_id")).distinct().withColumn("here", F.lit(1))
    per_way = changed_ways.join(here, "node_id", "left").groupBy("way_id").agg(F.count("*").alias("n"), F.count("here").alias("n_here"))
    a = per_way.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("way_nodes"), F.count("*").alias("ways"), F.count_if(F.col("n") == F.col("n_here")).alias("complete_ways"))
    a = a.withColumn("distinct_way_nodes", changed_ways.select("node_id").distinct().agg(F.count("*")).scalar())
    members, distinct = F.lit(0).cast("long"), F.lit(0).cast("long")
    if changed_members is not None:
        members = changed_members.agg(F.count("*")).scalar()
        distinct = changed_members.select("type", "id").distinct().agg(F.count("*")).scalar()
    return a.select("way_nodes", "distinct_way_nodes", "ways", "complete_ways", members.alias("members"), distinct.alias("distinct_members"))


def info(features: DataFrame, guid: str, indexed=T.INDEXED_KEYS) -> DataFrame:
    """(name, value): the library's id, its tiles, its features of each kind, its indexed keys."""
    a = features.agg(F.countDistinct("tile").alias("tiles"), *[F.count_if(F.col("kind") == k).alias(f"kind_{k}") for k in "nwar"])
    rows: list[Column] = [F.struct(F.lit("guid").alias("name"), F.lit(guid).alias("value"))]
    rows += [F.struct(F.lit(c).alias("name"), F.col(c).cast("string").alias("value")) for c in a.columns]
    rows.append(F.struct(F.lit("indexed-keys").alias("name"), F.lit(",".join(sorted(T.categories(list(indexed))))).alias("value")))
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def strings_in_use(features: DataFrame) -> DataFrame:
    """(string): every distinct key and value."""
    each = features.select(F.explode("tags").alias("k", "v"))
    return each.select(F.col("k").alias("string")).union(each.select("v")).distinct()
