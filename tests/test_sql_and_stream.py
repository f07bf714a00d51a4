"""SQL functions, and density over a stream."""

import datetime

from favora.functions import sqlfuncs
from favora.streaming.density import point_density


def test_sql_functions(spark):
    sqlfuncs.register(spark)
    row = spark.sql("select round(fv_voter(fv_prior_logit(0.5), 0.1), 8) as p, fv_minmax(3, 1, 5) as m, fv_distance(0, 0, 3, 4) as d").first()
    assert tuple(row) == (0.52497919, 0.5, 5.0)


def test_stream_equals_batch(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(float(i % 7), float(i % 5), start + datetime.timedelta(minutes=i)) for i in range(300)]
    df = spark.createDataFrame(rows, "x double, y double, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = point_density(stream, 2.0).writeStream.outputMode("complete").format("memory").queryName("density").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("density").collect())) == sorted(map(tuple, point_density(df, 2.0).collect()))
