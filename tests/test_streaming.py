import pytest
from pyspark.sql import functions as F

from fragmill.functions import fragments as fr
from fragmill.operators import choose, quality, sampling, summaries
from fragmill.sources import sinks
from fragmill.sources.tables import read_csv, table
from fragmill.streaming import metrics

SF = "/root/testdata/sf0.01"


def test_row_operators_run_in_micro_batches(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/predictions.parquet")
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(f"{SF}/predictions.parquet*")
    step = lambda df: df.select("pred_id", fr.swap_labels(F.col("default_pred_n0")).alias("s"))
    metrics.run_in_batches(stream, step, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("pred_id", "s").collect())) == sorted(map(tuple, step(batch).collect()))


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    rows = spark.sql("select * from values (timestamp'2024-01-01 01:00', 'a', 1D), (timestamp'2024-01-01 02:00', 'a', double('nan')), (timestamp'2024-01-09 00:00', 'a', 3D) as t(ts, k, v)")
    late = spark.sql("select * from values (timestamp'2024-01-01 03:00', 'a', 9D), (timestamp'2024-01-20 00:00', 'a', 3D) as t(ts, k, v)")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
        q = metrics.windowed_metrics(stream, "ts", ["k"], "v").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {str(r.start)[:10]: (r.n, r.mean) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["2024-01-01"] == (2, 1.0)


def test_empty_tables_and_checks(spark, tmp_path):
    none = spark.createDataFrame([], "g string, x long")
    assert summaries.group_sizes(none, "g").first().n == 0 and summaries.distribution(none, "g").count() == 0
    assert quality.flag_frequency(none.withColumn("flag_a", F.lit(True)), ["a"]).first().share is None
    assert choose.top_n_padded(none, "g", [F.col("x")], "x", 3).count() == 0
    assert sampling.weighted(none, "x", none.withColumn("s", F.lit(1.0)), "g", "s").count() == 0
    with pytest.raises(ValueError, match="lacks nosuch"):
        table(spark, SF, "part", ["nosuch"])
    with pytest.raises(ValueError, match="0..1"):
        sampling.first_share(none, "x", 2)


def test_csv_out_and_in(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi", you\nthere'), (2, None)], "id int, note string")
    sinks.write_table(df, str(tmp_path / "c"), kind="csv")
    assert sorted(map(tuple, read_csv(spark, str(tmp_path / "c"), "id int, note string").collect())) == [(1, 'say "hi", you\nthere'), (2, None)]
    lines = sinks.result_lines(spark.createDataFrame([('C,"', "[*:2]A.[*:1]B[*:2].[*:1]C", "m"), ("D", None, "m")], "smiles string, default_pred_n0 string, model_name string"))
    assert [r.value for r in lines.collect()] == ['"C,""",[*:2]A,[*:1]B[*:2],[*:1]C,m', "D,,,,m"]
