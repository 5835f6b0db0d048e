"""The streaming queries do not depend on how a table lies in files."""

import pytest
from pyspark.sql import functions as F

from driftwood.plans import registered
from driftwood.streaming import incremental

SF = "/root/testdata/sf0.001"
QUERIES = ("stream_first_seen", "stream_usage", "stream_sessions", "stream_failure_streak")


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("shuffled"))
    rows = spark.read.parquet(f"{SF}/events.parquet")
    rows.repartition(12, F.xxhash64("event_id")).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", QUERIES)
def test_many_shuffled_files_give_the_same(spark, shuffled, name):
    rows = [r.asDict() for r in registered()[name][0](spark, shuffled).collect()]
    want = [r.asDict() for r in registered()[name][0](spark, SF).collect()]
    key = lambda r: str(sorted((k, round(v, 2) if isinstance(v, float) else v) for k, v in r.items()))
    assert sorted(map(key, rows)) == sorted(map(key, want)) and rows


def test_streaks_and_first_seen_over_batches_out_of_order(spark, shuffled):
    stream = lambda: incremental.event_stream(spark, f"{shuffled}/events.parquet", 3)
    found = incremental.drained(incremental.failure_streaks(stream()), "update")
    assert found.agg(F.count_distinct("batch")).first()[0] == 4
    best = found.groupBy("user_id").agg(F.max_by(F.struct("streak", "last_event"), "batch").alias("b")).select("user_id", "b.streak", "b.last_event")
    assert sorted(map(tuple, best.collect())) == sorted(map(tuple, registered()["stream_failure_streak"][0](spark, SF).collect()))
    kept = incremental.drained(incremental.first_seen(stream(), ["event_id"]))
    assert kept.count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_a_folder_of_one_file_streams_its_rows(spark, tmp_path):
    for name, rows in (("conversations", spark.read.parquet(f"{SF}/conversations.parquet")), ("events", spark.read.parquet(f"{SF}/events.parquet"))):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("late_outcomes", "late_bodies", "stream_first_seen"):
        got, want = (sorted(map(str, registered()[name][0](spark, folder).collect())) for folder in (str(tmp_path), SF))
        assert got and got == want


def test_a_table_without_rows_streams_none(spark, tmp_path):
    import pyarrow.parquet as pq

    pq.write_table(pq.read_table(f"{SF}/conversations.parquet").slice(0, 0), f"{tmp_path}/conversations.parquet")
    assert registered()["late_outcomes"][0](spark, str(tmp_path)).collect() == []
