"""Streams of late bodies, revisions and attempts against folds of the same rows in order; ledgers of batches."""

import datetime as dt
import os
import random
import shutil
import tempfile
import uuid

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from driftwood.streaming import incremental, late, ledger, lifecycle

VERSION = "item_id long, at long, kind string, status string, text string"


def read(texts):
    """Each line is a candidate: its first word is the key, its second the title."""
    words = lambda line: F.split(line, " ")
    lines = F.filter(F.split("text", "\n"), lambda line: line != "")
    made = F.transform(lines, lambda line: F.struct(F.get(words(line), F.lit(0)).alias("key"), F.get(words(line), F.lit(1)).alias("title"), line.alias("detail")))
    return texts.select("digest", made.alias("candidates"))


def shuffled_files(spark, rows, schema, parts, seed):
    """The rows in files of any order, as a folder."""
    folder = tempfile.mkdtemp(prefix="spark-")
    rows = list(rows)
    random.Random(seed).shuffle(rows)
    for k in range(parts):
        piece = spark.createDataFrame(rows[k::parts], schema).coalesce(1)
        piece.write.parquet(f"{folder}/{k}")
        for name in os.listdir(f"{folder}/{k}"):
            if name.endswith(".parquet"):
                shutil.move(f"{folder}/{k}/{name}", f"{folder}/{k:03d}-{uuid.uuid4().hex}.parquet")
    return folder


def stream(spark, folder, schema, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).option("pathGlobFilter", "*.parquet").parquet(folder)


def made_versions():
    rnd = random.Random(4)
    line = lambda: f"{rnd.choice('abcd')} {rnd.choice('xyz')} {rnd.randrange(3)}"
    texts = ["\n".join(line() for _ in range(rnd.randrange(0, 4))) for _ in range(14)]
    rows = []
    for item in range(12):
        for at in range(rnd.randrange(1, 8)):
            kind = "REVIEW" if rnd.random() < 0.08 else "BODY"
            rows.append((item, at, kind, rnd.choice(["FULL", "FULL", "BLOCKED"]), None if kind == "REVIEW" else rnd.choice([*texts, None])))
    return [*rows, rows[0], rows[0]]


def test_late_bodies_agree_in_any_order(spark):
    rows = made_versions()
    batch = late.LateReadings(spark, read)
    batch.take(spark.createDataFrame(rows, VERSION), 0)
    want_outcomes, want = sorted(map(tuple, batch.outcomes().collect())), sorted(map(str, batch.candidates().collect()))
    assert {r[4] for r in want_outcomes} == {"EXTRACTED", "UNCHANGED", "REVIEWED", "KEPT_HUMAN_REVIEWED", "PRESERVED_BODY_LOST"}
    assert batch.corrections().isEmpty()
    followed = late.LateReadings(spark, read).follow(stream(spark, shuffled_files(spark, rows, VERSION, 4, 1), VERSION))
    assert len(followed.batches) == 4
    assert sorted(map(tuple, followed.outcomes().collect())) == want_outcomes
    assert sorted(map(str, followed.candidates().collect())) == want
    # what came late was said anew, and each text was read once
    assert followed.corrections().count() > 0
    readings = followed._table("readings", f"digest string, candidates array<{late.CANDIDATE}>")
    assert readings.count() == readings.select("digest").distinct().count()


def test_a_batch_of_bodies_that_runs_again_changes_nothing(spark):
    rows = made_versions()
    twice = late.LateReadings(spark, read)
    first, second = spark.createDataFrame(rows[:20], VERSION), spark.createDataFrame(rows[20:], VERSION)
    twice.take(first, 0)
    twice.take(second, 1)
    before = sorted(map(str, twice.outcomes().collect() + twice.candidates().collect() + twice.corrections().collect()))
    twice.take(second, 1)
    assert sorted(map(str, twice.outcomes().collect() + twice.candidates().collect() + twice.corrections().collect())) == before
    # a driver that starts again finds what was done
    again = late.LateReadings(spark, read, twice.folder)
    assert again.batches == [0, 1] and sorted(map(str, again.outcomes().collect() + again.candidates().collect() + again.corrections().collect())) == before


def test_candidates_keep_their_ids_when_read_again(spark):
    rows = [(1, 0, "BODY", "FULL", "a x 1\nb y 1"), (1, 1, "BODY", "FULL", "b y 2\nc z 1\na x 1"), (1, 2, "BODY", "BLOCKED", "b y"), (1, 3, "BODY", "FULL", "q q q"), (1, 4, "BODY", "FULL", "r r r"), (2, 0, "BODY", "FULL", "a x 1"), (2, 1, "REVIEW", "FULL", None), (2, 2, "BODY", "FULL", "b b b")]
    found = late.LateReadings(spark, read)
    found.take(spark.createDataFrame(rows[:2], VERSION), 0)
    assert {(r["candidate_id"], r["detail"]) for r in found.candidates().collect()} == {("1-0", "a x 1"), ("1-1", "b y 2"), ("1-2", "c z 1")}
    found.take(spark.createDataFrame(rows[2:], VERSION), 1)
    assert {(r["item_id"], r["candidate_id"], r["detail"]) for r in found.candidates().collect()} == {(1, "1-3", "r r r"), (2, "2-0", "a x 1")}
    outcomes = {(r["item_id"], r["at"]): (r["outcome"], r["kept"], r["added"], r["retired"]) for r in found.outcomes().collect()}
    assert outcomes[1, 1] == ("EXTRACTED", 2, 1, 0) and outcomes[1, 2][0] == "PRESERVED_BODY_LOST" and outcomes[1, 3] == ("EXTRACTED", 0, 1, 3) and outcomes[1, 4] == ("EXTRACTED", 1, 0, 0)
    assert outcomes[2, 2][0] == "KEPT_HUMAN_REVIEWED"


MADE = StructType([StructField("id", LongType()), StructField("ratio", LongType())])
INPUT = "id long, digest string, n string"


def ratios():
    """Rows whose number is empty are left out; a zero or a word ends in an error."""

    def step(batch):
        some = batch[batch["n"] != ""]
        return pd.DataFrame({"id": some["id"], "ratio": [100 // int(n) for n in some["n"]]}, index=some.index)

    return step


def numbers(bad=True):
    return [(k, f"d{k}", "" if k % 7 == 0 else "0" if bad and k == 15 else "word" if bad and k == 33 else str(k)) for k in range(60)]


def test_a_poisoned_row_fails_alone(spark):
    made = ledger.Ledger(spark, "id", ratios(), MADE)
    assert made.take(spark.createDataFrame(numbers(), INPUT), 0)
    rows = {r["id"]: r for r in made.current().collect()}
    assert len(rows) == 60 and {k for k, r in rows.items() if r["outcome"] == "FAILED"} == {15, 33}
    assert rows[15]["error"].startswith("ZeroDivisionError") and rows[33]["error"].startswith("ValueError")
    assert all(r["ratio"] == 100 // k for k, r in rows.items() if r["outcome"] == "NORMALIZED")
    assert {k for k, r in rows.items() if r["outcome"] == "SKIPPED"} == {k for k in range(60) if k % 7 == 0}


def test_a_batch_taken_again_changes_nothing_and_an_uncommitted_one_is_not_seen(spark):
    made = ledger.Ledger(spark, "id", ratios(), MADE)
    made.take(spark.createDataFrame(numbers(), INPUT), 0)
    before = sorted(map(str, made.entries().collect()))
    assert not made.take(spark.createDataFrame(numbers(bad=False), INPUT), 0)
    assert sorted(map(str, made.entries().collect())) == before
    # a batch that broke off before its commit
    made.entries().drop("batch").write.parquet(f"{made.folder}/rows/batch=1")
    assert sorted(map(str, made.entries().collect())) == before
    assert made.take(spark.createDataFrame([(15, "new", "5")], INPUT), 1)
    assert {(r["id"], r["ratio"]) for r in made.current().filter("batch = 1").collect()} == {(15, 20)}


def test_batches_drain_what_is_stale(spark):
    made = ledger.Ledger(spark, "id", ratios(), MADE)
    inputs = spark.createDataFrame(numbers(), INPUT)
    assert made.drain(inputs, 25) == 3 and made.current().count() == 60
    assert made.drain(inputs, 25) == 0
    changed = spark.createDataFrame([(k, d if k != 15 else "mended", n if k != 15 else "4") for k, d, n in numbers()], INPUT)
    assert made.stale(changed).count() == 1 and made.drain(changed, 25) == 1
    assert made.current().filter("outcome = 'FAILED'").count() == 1


START = dt.datetime(2024, 1, 1)
REVISION = "event_id long, revision_id long, ts timestamp, role string, start_time string, venue string"
ATTEMPT = "client long, attempt_id long, ts timestamp, what string"


@pytest.fixture
def stateful(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(key)


def test_revisions_apply_in_order_of_time(stateful):
    rnd = random.Random(2)
    rows = [(rnd.randrange(5), k, START + dt.timedelta(minutes=rnd.randrange(500)), rnd.choice(["ORIGINAL", "UPDATE", "UPDATE", "CANCELLATION"]), rnd.choice([None, "20:00"]), rnd.choice([None, "hall"])) for k in range(120)]
    rows.append((99, 1000, START + dt.timedelta(days=3), "ORIGINAL", None, None))
    want, state, count = [], {}, {}
    for event, number, ts, role, clock, venue in sorted(rows, key=lambda r: (r[2], r[1])):
        if event != 99:
            before = state.get(event, "ACTIVE")
            state[event], count[event] = lifecycle.next_status(before, role), count.get(event, 0) + 1
            want.append((event, number, role, before, state[event], clock, venue, count[event]))
    folder = shuffled_files(stateful, rows, REVISION, 3, 7)
    log = incremental.drained(lifecycle.applied_revisions(stream(stateful, folder, REVISION, 3)))
    assert sorted((r["event_id"], r["revision_id"], r["role"], r["status_from"], r["status_to"], r["start_time"], r["venue"], r["nth"]) for r in log.collect()) == sorted(want, key=lambda r: (r[0], r[1]))


def test_attempts_are_limited_as_in_one_ordered_fold(stateful):
    rnd = random.Random(3)
    limits = lifecycle.Limits(short=(3, 60), long=(6, 900), duplicate=300)
    rows = [(rnd.randrange(4), k, START + dt.timedelta(seconds=rnd.randrange(4000)), rnd.choice("abcdef")) for k in range(250)]
    rows.append((99, 1000, START + dt.timedelta(days=3), "a"))
    want, stamps, seen = [], {}, {}
    for client, number, ts, what in sorted(rows, key=lambda r: (r[2], r[1])):
        if client != 99:
            at = int((ts - dt.datetime(1970, 1, 1)).total_seconds()) * 10**6
            want.append((client, number, *lifecycle.limited(stamps.setdefault(client, []), seen.setdefault(client, {}), at, what, limits)))
    assert {w[2] for w in want} == {"ADMITTED", "LIMITED", "DUPLICATE"}
    folder = shuffled_files(stateful, rows, ATTEMPT, 3, 8)
    found = incremental.drained(lifecycle.limited_attempts(stream(stateful, folder, ATTEMPT, 3), limits))
    assert sorted((r["client"], r["attempt_id"], r["verdict"], r["wait"]) for r in found.collect()) == sorted(want)


def test_one_client_by_hand():
    limits = lifecycle.Limits(short=(2, 10), long=(3, 100), duplicate=50)
    stamps, seen, s = [], {}, 10**6
    take = lambda at, what: lifecycle.limited(stamps, seen, int(at * s), what, limits)
    assert [take(0, "a"), take(1, "a"), take(2, "b"), take(10, "b"), take(11.5, "c"), take(99, "d"), take(100, "a")] == [("ADMITTED", 0), ("DUPLICATE", 0), ("LIMITED", 8), ("ADMITTED", 0), ("LIMITED", 89), ("LIMITED", 1), ("ADMITTED", 0)]


class Waiting:
    """A list state."""

    def __init__(self):
        self.parts = []

    def appendValue(self, value):  # noqa: N802
        self.parts.append(value)

    def get(self):
        return iter(self.parts)

    def clear(self):
        self.parts = []


def test_what_a_batch_brings_waits_as_one_element_and_leaves_in_order():
    waiting = Waiting()
    lifecycle._wait(waiting, [(30, 3, None), (10, 2, "b"), (10, 1, "a")])
    lifecycle._wait(waiting, [(20, 4, "c"), (50, 5, None)])
    assert len(waiting.parts) == 2
    assert lifecycle._passed(waiting, 5) == ([], [(10, 1, "a"), (10, 2, "b"), (20, 4, "c"), (30, 3, None), (50, 5, None)]) and len(waiting.parts) == 2
    assert lifecycle._passed(waiting, 20) == ([(10, 1, "a"), (10, 2, "b"), (20, 4, "c")], [(30, 3, None), (50, 5, None)]) and len(waiting.parts) == 1
    assert lifecycle._passed(waiting, 90)[1] == [] and waiting.parts == [] and lifecycle._passed(waiting, 90) == ([], [])
