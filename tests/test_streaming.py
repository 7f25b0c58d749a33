import os
import tempfile

from pyspark.sql import functions as F

from equiaudit.operators import cube as cube_ops
from equiaudit.streaming import windowed_cube


def test_windowed_cube_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="equiaudit-stream-")
    rows = [(f"2024-01-0{1 + i % 3} 10:00:00", "good" if i % 2 else "bad", "good" if i % 3 else "bad",
             "a" if i % 4 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "ts string, y_true string, y_pred string, g string").withColumn(
        "ts", F.to_timestamp("ts"))
    df.write.mode("overwrite").parquet(os.path.join(d, "in"))
    stream = spark.readStream.schema(df.schema).parquet(os.path.join(d, "in"))
    q = (windowed_cube(stream, ["g"], "good", "ts").writeStream.outputMode("update").format("memory")
         .queryName("cube_stream").start())
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT attribute, `group`, yt, yp, SUM(n) AS n FROM cube_stream GROUP BY 1, 2, 3, 4")
    batch = cube_ops.confusion_cube(df, ["g"], "good").groupBy("attribute", "group", "yt", "yp").agg(
        F.sum("n").alias("n"))
    assert got.exceptAll(batch).count() == 0 and batch.exceptAll(got).count() == 0
