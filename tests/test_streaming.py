"""A stream in chunks gives what one batch gives."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkwake.functions import steps, topology
from sparkwake.operators.folds import fold
from sparkwake.streaming.stateful import stream_fold


MACHINES = [
    steps.Cusum(0.2, 1.0, 0.9), steps.EProcess(0.05), steps.Rls(2), steps.RecursiveRun(2, cost_rate=0.01), steps.BlockShift(3, 1.0), steps.WassersteinLearner(2),
    topology.TopologyDetector(cloud=6, least=3, periods=3, window=8), topology.PersistentCusum(cloud=5, least=4, periods=3, window=8),
]


@pytest.mark.parametrize("machine", MACHINES, ids=lambda m: type(m).__name__)
def test_chunked_stream_equals_batch(spark, tmp_path, machine):
    data = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("t"), F.abs(F.sin(F.col("id") * 1.7)).alias("x"), F.sin(F.col("id") * 0.7).alias("score"))
    data = data.withColumns({"features": F.array("x", "score"), "target": F.col("x") - F.col("score"), "step": F.col("t"), "available_step": F.col("t") + 5, "instability": F.col("x")})
    for i in range(3):
        data.where(f"t >= {20 * i} and t < {20 * i + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    query = stream_fold(stream, ["k"], "t", machine).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=lambda r: r[:2])
    assert rows(spark.table("folded")) == rows(fold(data, ["k"], "t", machine))


def test_a_row_behind_what_was_taken_is_an_error(spark, tmp_path):
    for i, t in enumerate((5, 3)):
        spark.createDataFrame([(0, t, 1.0)], "k long, t long, x double").coalesce(1).write.parquet(str(tmp_path / "in" / f"b={i}"))
    stream = spark.readStream.schema("k long, t long, x double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "b=*"))
    query = stream_fold(stream, ["k"], "t", steps.Cusum(0.2, 1.0)).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    with pytest.raises(Exception, match="came after"):
        query.processAllAvailable()
    query.stop()
