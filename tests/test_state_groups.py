"""What the counter asks of the state store grows with buckets, not with tracks."""

from pyspark.sql import functions as F

from gatewise.config import OBSERVATION, SECOND, CounterConfig, Line
from gatewise.operators.ingest import with_prev_tick
from gatewise.operators.transitions import crossing_events
from gatewise.streaming import counter

L1, L2, CONFIG = Line(0, 0.4, 1, 0.4), Line(0, 0.6, 1, 0.6), CounterConfig(width=1.0, height=1.0)


def test_many_tracks_share_state_groups(spark, tmp_path):
    """Every one of 300 tracks still waits at the end; those before are counted as the table counts them."""
    rows = [(t * SECOND, k, 0, 0, 0, k, 0.5, (0.3, 0.5, 0.7)[t - 1] if k % 2 else 0.9 - 0.2 * t, 0.0, 0.0) for k in range(300) for t in (1, 2, 3)]
    last = [(9 * SECOND, k, 0, 0, 0, k, 0.5, 0.1, 0.0, 0.0) for k in range(300)]
    table = with_prev_tick(spark.createDataFrame(rows + last, OBSERVATION))
    table.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in")).withColumn("at", F.timestamp_micros("t"))
    with counter.state_store(spark):
        out = counter.crossing_stream(stream, L1, L2, CONFIG).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(counter.EVENT).parquet(str(tmp_path / "out")).collect()))
    want = crossing_events(table, L1, L2, CONFIG).where(F.col("t") < 9 * SECOND)
    assert len(got) == 300 and got == sorted(map(tuple, want.collect()))
    assert counter.checkpointed_tracks(spark, str(tmp_path / "state")).count() == 300
    groups = spark.read.format("statestore").option("stateVarName", "waiting").load(str(tmp_path / "state")).select("key").distinct().count()
    assert 0 < groups <= 64
