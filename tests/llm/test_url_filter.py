from geolith.llm import url_filter as uf


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    k = next((k for k, c in enumerate(rest) if c in "/?#"), len(rest))
    path = rest[k:].split("?")[0].split("#")[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:k]), path


def rule(url):
    host, path = parts(url)
    fit = [(len(h + p), a == "allow", h + p, a) for a, h, p in uf.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2:] if fit else (None, None)


URLS = [
    "http://A.example.ORG/es/x", "https://example.org/en/12", "https://example.org/en/2?q", "http://org", "http://org/", "http://x.org?u=/es/", "http://com/de/", "http://notcom/de/",
    "http://a.com/fr/1#de", "http://a.com/it/1", "http://ÉX.com/de/", "ftp://b.net/fr/#://x/", "no scheme/fr/", None, "", "http://", "://x.com/de/y", "http://x.com:80/de/", "http://example.org/es/?://y.com/fr/", "http://myexample.org/es/", "http://line\nbreak.com/de/\nx",
]


def test_rules_equal_brute_force(spark):
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(URLS)] + [(0, URLS[0], None)], "page_id long, url string, html string")
    got = uf.query(df).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        found, action = rule(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (*parts(URLS[r.page_id]), found, action or "allow"), URLS[r.page_id]


def link(url, kind=0):
    return [f'<head><LINK href="{url}" data-x=1 rel="nofollow Canonical"/>', f"<link rel=canonical href={url}>", f"<META HTTP-EQUIV='Refresh' content='0; URL={url}'>"][kind]


def test_decisions_propagate(spark):
    pages = [
        (1, "http://a.net/1", link("http://b.net/2", 0)),
        (2, "http://b.net/2", link("http://www.example.org/es/blocked", 1)),
        (3, "http://c.net/3#frag", link("/1", 2)),
        (4, "HTTP://C.net/1", link("//a.net/1")),
        (5, "http://d.org/x", link("http://example.org/es/z")),  # explicit allow on its own url
        (6, "http://e.net/6", link("http://f.net/7")),
        (7, "http://f.net/7", link("http://com/de/no")),
        (8, "http://e.net/6", link("http://ok.org/yes")),  # allowed alias outranks the blocked one
        (9, "http://alone.net/", "<p>canonical</p>"),
        (10, "http://self.net/", link("http://SELF.net/#top")),
        (11, "http://r.net/", None),
        (12, "http://rel.net/a/b", link("c?x=1")),
        (13, "http://rel.net/a/c?x=1", link("http://com/de/q")),
        (14, None, link("http://com/de/")),
        (15, "http://b.net/2", None),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    redirects = spark.createDataFrame([("http://r.net/", "http://a.net/1"), (None, "http://x/"), ("http://q/", None)], "source string, target string")
    got = {r.page_id: r.verdict for r in uf.judged(df, redirects=redirects).collect()}
    assert got == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "block", 12: "block", 13: "block", 14: "allow", 15: "block"}


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "http://a.com/de/", "", "x", "y")], "page_id long, url string, html string, host string, verdict string")
    assert [tuple(r)[:5] for r in uf.query(df).collect()] == [(1, "a.com", "/de/", "com/de/", "block")]
    assert uf.query(df.limit(0)).count() == 0


def test_usual_forms_are_one_component(spark):
    pages = [
        (1, "http://www.a.net/x/?utm_source=f&page=2&ref=y#top"),
        (2, "https://m.a.net/x?page=2"),
        (3, "https://a.net/x?page=2"),
        (4, "https://a.net/x"),
        (5, "http://site.com/de"),  # no rule fits; its other form is blocked
        (6, "https://www.site.com/de/"),
        (7, "http://m.io/"),
        (8, "ftp://www.a.net/x"),
        (9, "https://plain.net/y"),
    ]
    df = spark.createDataFrame([(*p, None) for p in pages], "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.component) for r in uf.query(df).collect()}
    assert got[1] == got[2] == got[3] == ("allow", "http://www.a.net/x/?utm_source=f&page=2&ref=y")
    assert got[4] == got[8] == got[9] == ("allow", None) and got[7] == ("allow", "http://m.io/")
    assert got[5] == ("block", "http://site.com/de") and got[6] == ("block", "http://site.com/de")


def test_a_hub_passes_its_decision_on(spark):
    hub = "http://com/de/hub"
    df = spark.createDataFrame([(k, f"http://n{k}.net/", None) for k in range(3000)] + [(9999, hub, None)], "page_id long, url string, html string")
    redirects = spark.createDataFrame([(f"http://n{k}.net/", hub) for k in range(0, 3000, 2)], "source string, target string")
    got = uf.judged(df, redirects=redirects, usual_forms=False).collect()
    assert all((r.verdict == "block") == (r.page_id == 9999 or r.page_id % 2 == 0) for r in got)
    assert {r.component for r in got if r.verdict == "block"} == {hub}


def test_more_rules_than_an_expression_holds(spark):
    rules = [("block" if k % 3 else "allow", f"h{k % 500}.net", f"/{k // 500}" if k >= 500 else "/") for k in range(1500)] + list(uf.RULES)
    urls = [f"http://{'www.' * (k % 2)}h{k % 700}.net/{k % 4}x" for k in range(1400)] + [None, "x", "http://a.com/de/1"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(urls)], "page_id long, url string, html string")
    for r in uf.judged(df, rules, usual_forms=False).collect():
        host, path = parts(urls[r.page_id])
        fit = [(len(h + p), a == "allow", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fit)[2:] if fit else (None, "allow"))
