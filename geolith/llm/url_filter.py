"""URL rules with redirect equivalence.

A rule is (action, host, path): it fits its host and all subdomains if the url's path starts with the rule's.  The
longest rule that fits decides; of two equally long, an allow rule.

Redirects, meta refreshes and canonical links join a page's url to its target, and every url is joined to its usual
form, which sites redirect to by convention: https, no ``www.`` or ``m.`` before the host, no slash at the path's end
and no tracking parameters (``TRACKING``).  Connected components over these edges are one site under several names: a
url that no rule fits takes the decision of its component, which is allow if any of its urls is allowed by a rule,
else block if any is blocked by a rule, else allow.  Urls are compared without fragment, with scheme and host in lower
case.

A component's votes are stored before its urls are joined with them, so that adaptive execution can split the join of
one that most urls belong to.

Null urls and urls without ``://`` have an empty host and path, no rule and no links.  A null page has no links.
Links that lead to the page itself count for nothing.  Very long urls and pages are single values.  Repeated rows each
get a row.  Other columns play no part.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, connected_components, stored

#: (action, host, path) of the registered query.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Rules up to this number are one expression; more are a table that hosts are joined with.
MOST_IN_EXPRESSION = 200
#: Names of query parameters that only track visitors.
TRACKING = "utm_[^=]*|ref|fbclid|gclid"


def host_of(url: Column) -> Column:
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def node_of(url: Column) -> Column:
    """The url without fragment, with scheme and host in lower case; null without ``://``."""
    scheme = F.regexp_extract(url, r"(?s)^(.*?)://", 1)
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return F.when(url.contains("://"), F.concat(ascii_lower(scheme), F.lit("://"), host_of(url), rest))


def usual_form(url: Column) -> Column:
    """What sites redirect ``url`` to by convention; null for schemes other than http and https."""
    scheme = ascii_lower(F.regexp_extract(url, r"(?s)^(.*?)://", 1))
    host = F.regexp_replace(host_of(url), r"^((www|m)\.)+([^.]+\..+)$", "$3")
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: ~x.rlike(f"^({TRACKING})(=|$)") & (x != "")), "&")
    return F.when(scheme.isin("http", "https"), F.concat(F.lit("https://"), host, F.regexp_replace(path_of(url), "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def decision(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> Column:
    """struct(rule, action) of the longest rule that fits, else null."""
    out = None
    for action, rule_host, rule_path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0] != "allow", r[1:])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        then = F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(action).alias("action"))
        out = F.when(fits, then) if out is None else out.when(fits, then)
    return out if out is not None else F.lit(None).cast("struct<rule:string,action:string>")


def decided(urls: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """``urls`` (host, path, ...) with ``found``: struct(rule, action), by the longest rule."""
    if len(rules) <= MOST_IN_EXPRESSION:
        return urls.withColumn("found", decision(F.col("host"), F.col("path"), rules))
    table = urls.sparkSession.createDataFrame([(h, p, h + p, a) for a, h, p in rules], "suffix string, start string, rule string, action string")
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    each = urls.select("host", "path").distinct().withColumn("suffix", F.explode(suffixes))
    best = F.max(F.struct(F.length("rule").alias("n"), (F.col("action") == "allow").alias("allow"), "rule", "action"))
    found = each.join(table, "suffix").where(F.col("path").startswith(F.col("start"))).groupBy(F.col("host").alias("of_host"), F.col("path").alias("of_path")).agg(best.alias("best"))
    found = found.select("of_host", "of_path", F.struct("best.rule", "best.action").alias("found"))
    return urls.join(found, (F.col("host") == F.col("of_host")) & (F.col("path") == F.col("of_path")), "left").drop("of_host", "of_path")


def target(base: Column, link: Column) -> Column:
    """``link`` as seen from the page at ``base``."""
    site = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*(?:/[^?#]*/|/)?)", 1)
    return (
        F.when(F.trim(link) == "", None)
        .when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"(?s)^(.*?):", 1), F.lit(":"), link))
        .when(link.startswith("/"), F.concat(site, link))
        .when(link.startswith("#"), None)
        .when(folder.endswith("/"), F.concat(folder, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(a, b): a page's url and the target of its canonical link or meta refresh."""
    page = F.col(html_col)
    some = pages.where(page.rlike("(?i)canonical|http-equiv")).select(F.col(url_col).alias("url"), page.alias("page"))
    tags = F.concat(F.regexp_extract_all("page", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0)), F.regexp_extract_all("page", F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0)))
    tag = some.select("url", F.explode(tags).alias("tag"))

    def value(name: str) -> Column:
        return F.regexp_extract("tag", rf"(?is)\b{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", 0)

    def bare(c: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)^[\w-]+\s*=\s*", ""), r"^[\"']|[\"']$", ""))

    canonical = tag.where(bare(value("rel")).rlike(r"(?i)(^|\s)canonical(\s|$)")).select("url", bare(value("href")).alias("link"))
    refresh = tag.where(bare(value("http-equiv")).rlike("(?i)^refresh$")).select("url", F.trim(F.regexp_extract(bare(value("content")), r"(?i)url\s*=\s*['\"]?([^'\"]*)", 1)).alias("link"))
    found = canonical.union(refresh)
    return found.select(node_of(F.col("url")).alias("a"), node_of(target(F.col("url"), F.col("link"))).alias("b")).where("a != b")


def judged(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    redirects: DataFrame | None = None,
    key_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    usual_forms: bool = True,
) -> DataFrame:
    """(key, host, path, rule, verdict, component), a row for each row of ``pages``.

    ``redirects`` (source, target): urls that redirect.  ``component``: the least url of the page's component, null
    where no link leads to or from the page.
    """
    url = F.col(url_col)
    edges = links(pages, url_col, html_col)
    if usual_forms:
        edges = edges.union(pages.select(node_of(url).alias("a"), usual_form(url).alias("b")).where("a != b"))
    if redirects is not None:
        edges = edges.union(redirects.select(node_of(F.col("source")).alias("a"), node_of(F.col("target")).alias("b")).where("a != b"))
    comps = stored(connected_components(edges), "url-components")
    nodes = decided(comps.withColumns({"host": host_of(F.col("node")), "path": path_of(F.col("node"))}), rules)
    votes = nodes.groupBy(F.col("root").alias("of_root")).agg(F.max(F.col("found.action") == "allow").alias("allowed"), F.max(F.col("found.action") == "block").alias("blocked"))
    votes = stored(votes, "url-votes")
    action = F.when(F.coalesce("allowed", F.lit(False)), "allow").when(F.coalesce("blocked", F.lit(False)), "block")
    of = comps.join(votes, F.col("root") == F.col("of_root")).select("node", F.col("root").alias("component"), action.alias("group_action"))
    of = stored(of, "url-actions")
    own = pages.select(F.col(key_col).alias("key"), host_of(url).alias("host"), path_of(url).alias("path"), node_of(url).alias("own_node"))
    own = decided(own, rules).join(of, F.col("own_node") == F.col("node"), "left")
    verdict = F.coalesce("found.action", "group_action", F.lit("allow"))
    return own.select(F.col("key").alias(key_col), "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "component")


def query(pages: DataFrame) -> DataFrame:
    """The contract's rows, and component."""
    return judged(pages)


def redirect_query(pages: DataFrame, chain: int = 6) -> DataFrame:
    """(page_id, rule, verdict, component) where each page redirects to the one before it, in chains of ``chain``; the first of
    each chain redirects to itself."""
    one = pages.select("url", (F.col("page_id") - F.least(F.col("page_id") % chain, F.lit(1))).alias("to"))
    redirects = one.join(pages.select(F.col("page_id").alias("to"), F.col("url").alias("target")), "to").select(F.col("url").alias("source"), "target")
    return judged(pages, redirects=redirects, usual_forms=False).select("page_id", "rule", "verdict", "component")
