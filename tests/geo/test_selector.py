import pytest

from geolith.functions import tags as T
from geolith.plans.selector import Clause, SelectorError, parse, predicate


def test_parts():
    (s,) = parse("na[shop=a,\"b c\"][name:en]")
    assert s.kinds == frozenset("na")
    assert s.clauses == (Clause("shop", ("a", "b c")), Clause("name:en"))
    assert [p.kinds for p in parse("n[a]; w[!b]")] == [frozenset("n"), frozenset("w")]
    assert parse("*[k!=v]")[0].clauses == (Clause("k", ("v",), True),)
    assert parse("[k]")[0].kinds == frozenset("nwar")


@pytest.mark.parametrize("text", ["", "x[a]", "nn[a]", "n[a", "n[=b]", "n[a] b", "n[!a=b]", "n;"])
def test_errors(text):
    with pytest.raises(SelectorError):
        parse(text)


def test_matching(spark):
    rows = [(1, "n", {"shop": "a"}), (2, "n", {"shop": "no"}), (3, "a", {"shop": "b c", "x": "1"}), (4, "w", {}), (5, "r", {"x": "2"})]
    df = spark.createDataFrame(rows, "id long, kind string, tags map<string,string>")
    df = df.withColumn("key_bits", T.key_bits("tags", T.categories(["shop/craft", "x"])))

    def ids(text, indexed=None):
        return {r.id for r in df.where(predicate(text, indexed)).collect()}

    assert ids("n[shop]") == {1}
    assert ids("*[shop=no]") == {2}
    assert ids("na[shop]") == {1, 3}
    assert ids("[!shop]") == {2, 4, 5}
    assert ids("[shop!=a]") == {2, 3, 4, 5}
    assert ids("a[shop=\"b c\"][x=1]") == {3}
    assert ids("n[shop=a]; r[x]") == {1, 5}
    indexed = T.categories(["shop/craft", "x"])
    for text in ("n[shop]", "*[shop=no]", "[shop][x]", "[!shop]", "w"):
        assert ids(text, indexed) == ids(text)


def test_categories():
    assert T.categories(["a/b", "c"]) == {"a": 1, "b": 1, "c": 2}
    with pytest.raises(ValueError):
        T.categories(["a", "b/a"])
    with pytest.raises(ValueError):
        T.categories([str(k) for k in range(31)])
