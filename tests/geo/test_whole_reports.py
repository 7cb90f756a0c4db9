from pyspark.sql import functions as F

from geolith import cli
from geolith.sinks import formats
from geolith.sources import text_tables


def test_no_rows_are_left_out(spark, monkeypatch):
    rows = spark.range(10_005).select(F.lit("N").alias("type"), "id", F.create_map(F.lit("name"), F.lit("x")).alias("tags"))
    assert formats.feature_table(rows, "name").count("\n") == 10_007
    assert formats.feature_table(rows, "name", limit=5).count("\n") == 7
    tiles = spark.range(100_003).select(F.lit(12).alias("zoom"), (F.col("id") % 4096).cast("int").alias("col"), (F.col("id") / 4096).cast("int").alias("row"), F.lit(1).alias("n"))
    assert text_tables.tile_map(tiles).count("<rect") == 100_003
    monkeypatch.setattr(cli.library, "properties", lambda *a: {"guid": "g"})
    monkeypatch.setattr(cli.library, "read", lambda *a: spark.range(1005).select(F.col("id").alias("tile")))
    monkeypatch.setattr(cli.reports, "info", lambda *a: spark.createDataFrame([], "name string, value string"))
    assert "".join(cli.run_info(spark, ["library", "-t"])).count("\n") >= 1007
