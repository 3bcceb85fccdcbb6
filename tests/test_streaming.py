"""The streaming surface gives what the batch operators give."""

from datetime import datetime

from pyspark.sql import functions as F

from chronoweave.streaming import live


def stamped(spark, rows):
    return spark.createDataFrame([(e, datetime.fromtimestamp(s)) for e, s in rows], "entity string, ts timestamp")


def source(spark, df, path):
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def finished(df, tmp_path, mode="append"):
    q = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(f"{tmp_path}/out")


H = 3600


def test_sessions(spark, tmp_path):
    rows = [("x", 0), ("x", 1000), ("x", 1000 + 1799), ("x", 9 * H), ("x", 99 * H)]
    out = finished(live.input_sessions(source(spark, stamped(spark, rows), f"{tmp_path}/in")), tmp_path)
    assert sorted((r.last_ms - r.first_ms, r.n) for r in out.collect()) == [(0, 1), (2_799_000, 3)]


def test_hours(spark, tmp_path):
    out = finished(live.hourly(source(spark, stamped(spark, [("x", 10), ("x", H - 1), ("x", H), ("x", 50 * H)]), f"{tmp_path}/in")), tmp_path)
    assert sorted((r.time_ms, r.n) for r in out.collect()) == [(0, 2), (H * 1000, 1)]


def test_first_rows_stay_and_batches_repeat(spark, tmp_path):
    path = f"{tmp_path}/t"
    write = live.keep_first_rows(path, ["k"], ["v"])
    make = lambda rows: spark.createDataFrame(rows, "k int, v int")
    write(make([(1, 5), (1, 4), (2, 9)]), 0)
    for _ in range(2):  # a batch that is written again
        write(make([(2, 1), (3, 7)]), 1)
    assert sorted((r.k, r.v) for r in spark.read.parquet(path).select("k", F.col("v")).collect()) == [(1, 4), (2, 9), (3, 7)]
