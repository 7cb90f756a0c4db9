import datetime as dt

from geolith.streaming import changes as stream


def test_batches_are_merged_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    t = dt.datetime(2024, 1, 1)

    def put(name, rows):
        spark.createDataFrame(rows, stream.SCHEMA).coalesce(1).write.parquet(str(tmp_path / name))
        src.mkdir(exist_ok=True)
        for k, p in enumerate((tmp_path / name).glob("*.parquet")):
            p.rename(src / f"{name}-{k}.parquet")

    base = spark.createDataFrame([(1, 10, 10, {"a": "1"}), (2, 20, 20, {})], "id long, x long, y long, tags map<string,string>")
    put("one", [("modify", "N", 1, 3, 1, {"a": "2"}, 11, 11, t), ("create", "N", 5, 1, 1, {}, 5, 5, t), ("modify", "N", 1, 3, 1, {"a": "2"}, 11, 11, t)])

    def run():
        s = stream.read(spark, str(src))
        q = stream.merged(s, base, out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    assert {r.id: (r.x, r.tags) for r in stream.nodes(spark, out).collect()} == {1: (11, {"a": "2"}), 2: (20, {}), 5: (5, {})}
    # an older version that comes late changes nothing; a delete removes
    put("two", [("modify", "N", 1, 2, 1, {"a": "old"}, 1, 1, t), ("delete", "N", 2, 4, 1, {}, None, None, t)])
    run()
    assert {r.id: (r.x, r.tags) for r in stream.nodes(spark, out).collect()} == {1: (11, {"a": "2"}), 5: (5, {})}
    run()
    assert stream.nodes(spark, out).count() == 2
    # only what a batch touches is written anew, and what nothing names goes
    for k in range(4):
        put(f"more{k}", [("modify", "N", 5, 10 + k, 1, {}, 50 + k, 5, t)])
        run()
    assert {r.id: r.x for r in stream.nodes(spark, out).collect()} == {1: 11, 5: 53}
    found = stream.notes(spark, out)
    assert len(found) == 2 and len(set(found[max(found)].values())) > 1
    left = {(v.name, p.name) for v in (tmp_path / "out").glob("v*") for p in v.glob("part=*")}
    assert left == {(f"v{v}", f"part={k}") for n in found.values() for k, v in n.items()}


def test_rates(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 0, 30)
    spark.createDataFrame([("create", "N", 1, 1, 1, {}, 1, 1, t), ("create", "N", 2, 1, 1, {}, 1, 1, t)], stream.SCHEMA).write.parquet(str(tmp_path / "in"))
    q = stream.rates(stream.read(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("rates_out").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.n for r in spark.table("rates_out").collect()] == [2]
