"""Queries against their SQL on events of which many share a time, as in larger tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gatewise.plans import queries as plans


@pytest.fixture(scope="module")
def repeated(spark, tmp_path_factory):
    """Events of sf0.001 three times, with other ids and users at the same times."""
    path = str(tmp_path_factory.mktemp("events"))
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    users = events.agg(F.max("user_id")).first()[0] // 6 * 6 + 6
    copies = events.crossJoin(spark.range(3)).withColumn("event_id", F.col("event_id") + 1000 * F.col("id")).withColumn("user_id", F.col("user_id") + users * F.col("id"))
    copies.drop("id").write.parquet(f"{path}/events.parquet")
    return path


def against_sql(spark, path, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet/*.parquet'")
    got = sorted(map(tuple, plans.queries()[name](spark, path).collect()), key=repr)
    return got, sorted(con.execute(plans.oracle_sql()[name]).fetchall(), key=repr)


def test_a_time_is_one_tick(spark, repeated):
    got, want = against_sql(spark, repeated, "tick_timeline")
    assert len(got) == 1000 and got == want


@pytest.mark.parametrize("name", ["mjpeg_parts", "mjpeg_frames", "snapshot"])
def test_frames_of_one_time_stay_whole(spark, repeated, name):
    """Halves of frames of one time in one stream may not mix; their order is that of their numbers."""
    got, want = against_sql(spark, repeated, name)
    assert got and got == want


def test_slices_of_many_files(spark, repeated, monkeypatch):
    """A slice of more files than one trigger took: rows of the later ones came behind the watermark and were lost."""
    from gatewise.plans import event_tables as ev

    ticked = ev.ticked
    monkeypatch.setattr(ev, "ticked", lambda *args: ticked(*args).repartition(20))
    got, want = against_sql(spark, repeated, "stream_counts")
    assert sum(got[0]) and got == want
