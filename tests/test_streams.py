"""Streams of several files: late events, restart from the checkpoint, and what comes out against the batch."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from larkspan.streaming import metrics as S
from larkspan.streaming import state as T

START = datetime(2024, 3, 1)


@pytest.fixture
def source(spark, tmp_path):
    """A folder of files in the order of their writing, as a stream of one file a batch."""
    folder = tmp_path / "events"
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"

    def add(*rows):
        number = len(list(folder.glob("*.parquet"))) if folder.exists() else 0
        part = tmp_path / f"part{number}"
        spark.createDataFrame([(i, START + timedelta(hours=h), u, "x", v) for i, h, u, v in rows], schema).coalesce(1).write.parquet(str(part))
        folder.mkdir(exist_ok=True)
        next(part.glob("*.parquet")).rename(folder / f"{number:03d}.parquet")

    add.stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder)).withWatermark("ts", "1 day")
    return add


def test_changes_come_in_event_order_and_go_on_after_a_restart(source, tmp_path):
    home = str(tmp_path / "out")
    source((1, 0, 7, 10.0), (2, 10, 7, 12.0), (3, 12, 8, 5.0))
    source((4, 5, 7, 11.0), (5, 40, 7, 20.0))  # the first one is late, within a day
    rows = lambda: sorted((r["user_id"], r["event_id"], r["change"]) for r in T.drained(T.changes_in_order(source.stream()), home).collect())
    first = rows()
    # The watermark stands at hour 16: hour 40 may still be preceded.
    assert first == [(7, 1, 10.0), (7, 2, 1.0), (7, 4, 1.0), (8, 3, 5.0)]
    assert rows() == first
    source((6, 80, 8, 6.0))
    assert rows() == sorted([*first, (7, 5, 8.0)])
    source((7, 81, 7, 1.0), (8, 2, 8, 99.0))  # the second one is too late
    source((9, 200, 9, 0.0))
    assert rows() == sorted([*first, (7, 5, 8.0), (8, 6, 1.0), (7, 7, -19.0)])


def test_entries_expire_unless_renewed(source, tmp_path):
    source((1, 0, 1, 0.0), (2, 3, 2, 0.0), (3, 20, 1, 0.0))
    source((4, 100, 3, 0.0))
    got = T.drained(T.expired_entries(source.stream(), days=1), str(tmp_path / "out")).collect()
    hour = 3_600_000
    zero = min(r["ms"] for r in got) - 3 * hour
    assert sorted((r["user_id"], r["event_id"], (r["expired_ms"] - zero) // hour) for r in got) == [(1, 3, 44), (2, 2, 27)]


def test_entries_of_a_key_expire_by_one_timer(source, tmp_path):
    """Repeats, late renewals and ties over several batches, and a restart; a batch's entries cost one write of the state and one timer."""
    home = str(tmp_path / "out")
    rows = lambda: sorted((r["user_id"], r["event_id"]) for r in T.drained(T.expired_entries(source.stream(), days=1), home).collect())
    source((1, 0, 1, 0.0), (2, 0, 1, 0.0), (3, 30, 1, 0.0), (4, 0, 2, 0.0), (5, 25, 2, 0.0), (5, 25, 2, 0.0), (6, 49, 3, 0.0))
    assert rows() == [(1, 2), (2, 4)]
    source((7, 54, 1, 0.0), (8, 50, 2, 0.0))  # the first one a day after entry 3, so that it renews it
    assert rows() == [(1, 2), (2, 4)]
    source((9, 200, 4, 0.0))
    assert rows() == [(1, 2), (1, 7), (2, 4), (2, 5), (2, 8), (3, 6)]


def test_a_batch_of_a_key_is_one_value_and_one_timer():
    calls = []

    class Handle:
        def getValueState(self, *_):
            return self

        getMapState = getValueState
        exists = lambda self: False
        update = updateValue = lambda self, *a: calls.append("state")
        registerTimer = lambda self, end: calls.append(end)

    p = T.Expiring(10)
    p.init(Handle())
    list(p.handleInputRows((1,), iter([T.pd.DataFrame({"ms": range(100, 200), "event_id": range(100)})]), None))
    assert calls == ["state", 110]


def test_windows_in_append_mode_wait_for_late_events(spark, source, tmp_path):
    home = str(tmp_path / "out")
    source((1, 1, 1, 1.0), (2, 30, 1, 1.0))
    source((3, 2, 1, 1.0), (4, 60, 1, 1.0))
    rows = lambda: sorted((r["start"].day, r["n"]) for r in T.drained(S.tumbling_counts(source.stream()), home).collect())
    assert rows() == [(1, 2)]
    source((5, 3, 1, 1.0), (6, 100, 1, 1.0))  # the first one is too late for its window
    assert rows() == [(1, 2), (2, 1), (3, 1)]


def test_complete_results_go_on_from_the_folder(source, tmp_path):
    home = str(tmp_path / "out")
    source((1, 1, 1, 1.0))
    latest = lambda: sorted((r["user_id"], r["event_id"]) for r in S.finished(S.latest_states(source.stream()), folder=home).collect())
    assert latest() == [(1, 1)]
    source((2, 2, 1, 1.0), (3, 1, 2, 1.0))
    assert latest() == [(1, 2), (2, 3)]


def test_runs_skip_what_was_confirmed_meanwhile(spark, source, tmp_path):
    home, table = str(tmp_path / "out"), str(tmp_path / "links")
    candidates = spark.createDataFrame([(1, 10, 50), (1, 11, 60), (2, 10, 70)], "spec_id long, offer_id long, confidence int")
    spark.createDataFrame([(9, 1)], "spec_id long, is_confirmed int").write.parquet(table)
    run = lambda: sorted((r["spec_id"], r["offer_id"], r["rank"]) for r in T.drained(source.stream().select(F.col("user_id").alias("spec_id")), home, T.unsettled(spark.read.parquet(table), candidates)).collect())
    source((1, 1, 1, 0.0))
    assert run() == [(1, 10, 2), (1, 11, 1)]
    spark.createDataFrame([(2, 1)], "spec_id long, is_confirmed int").write.mode("append").parquet(table)
    source((2, 2, 2, 0.0))
    assert run() == [(1, 10, 2), (1, 11, 1)]
