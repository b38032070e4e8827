"""Streams with state of a key: values in event order, entries that expire, and runs that skip what is settled.

State is kept by key in the engine's state store and goes when the watermark
has passed it, so it is as large as the keys that are open and the events that
may still be followed by earlier ones.  A stream writes to a folder of its own,
from whose checkpoint it goes on when it is started again.
"""

from __future__ import annotations

import sys
from array import array
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from larkspan.sources.shared import settings

# The worker in which the driver prepares a processor has no files of the application, so processors travel whole.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class InOrder(StatefulProcessor):
    """Holds a key's events until no earlier one can come, then gives them in order with the change since the one before."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "value double")
        self.open = handle.getMapState("open", "ms long, event_id long", "value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        sooner = None
        for batch in rows:
            for ms, event_id, value in zip(batch["ms"], batch["event_id"], batch["value"], strict=True):
                self.open.updateValue((int(ms), int(event_id)), (float(value),))
                sooner = int(ms) if sooner is None else min(sooner, int(ms))
        if sooner is not None:
            self.handle.registerTimer(sooner)
        yield pd.DataFrame({"user_id": [], "ms": [], "event_id": [], "value": [], "change": []})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        events = sorted((k[0], k[1], v[0]) for k, v in self.open.iterator())
        before = self.last.get()[0] if self.last.exists() else 0.0
        out = []
        for ms, event_id, value in events:
            if ms > now:
                self.handle.registerTimer(ms)
                break
            out.append((key[0], ms, event_id, value, value - before))
            before = value
            self.open.removeKey((ms, event_id))
        if out:
            self.last.update((before,))
        yield pd.DataFrame(out, columns=["user_id", "ms", "event_id", "value", "change"])

    def close(self) -> None:
        pass


class Expiring(StatefulProcessor):
    """Keeps the newest entry of a key; one that is not renewed for ``ttl`` milliseconds is given out and forgotten.

    A key's entries that may still count are one value of the state, and one
    timer stands for the first of them to end, so that a batch of a key costs a
    few calls of the state, however many entries it has.
    """

    def __init__(self, ttl: int):
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getValueState("entries", "packed binary")

    def _open(self) -> list[tuple[int, int]]:
        """(ms, event_id) of what is held."""
        kept = self.entries.get() if self.entries.exists() else None
        numbers = array("q", bytes(kept[0])) if kept else ()
        return list(zip(numbers[::2], numbers[1::2], strict=True))

    def _keep(self, entries: list[tuple[int, int]]) -> None:
        self.entries.update((array("q", [n for e in entries for n in e]).tobytes(),))
        self.handle.registerTimer(entries[0][0] + self.ttl)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._open()
        new = [e for batch in rows for e in zip(batch["ms"].tolist(), batch["event_id"].tolist(), strict=True)]
        # A write that is repeated counts once, and of one millisecond the last.
        newest = dict(sorted(held + new))
        self._keep(list(newest.items()))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        end, now = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        held, out = self._open(), []
        ended = [e for e in held if e[0] + self.ttl <= end or e[0] + self.ttl < now]
        # A write that came while an entry lived has renewed it.
        for (ms, event_id), (later, _) in zip(ended, [*held[1:], (None, None)], strict=False):
            if later is None or later > ms + self.ttl:
                out.append((key[0], ms, event_id, ms + self.ttl))
        if len(ended) < len(held):
            self._keep(held[len(ended) :])
        elif held:
            self.entries.clear()
        if out:
            yield pd.DataFrame(out, columns=["user_id", "ms", "event_id", "expired_ms"])

    def close(self) -> None:
        pass


def _keyed(events: DataFrame) -> DataFrame:
    return events.select("user_id", F.unix_millis("ts").alias("ms"), "event_id", "value", "ts").groupBy("user_id")


def changes_in_order(events: DataFrame) -> DataFrame:
    """(user_id, ms, event_id, value, change): every event once no earlier one of its key can come, and its change from the one before, whatever the order in which they arrive."""
    return _keyed(events).transformWithStateInPandas(InOrder(), "user_id long, ms long, event_id long, value double, change double", "Append", "EventTime")


def expired_entries(events: DataFrame, days: int = 30) -> DataFrame:
    """(user_id, ms, event_id, expired_ms): a key's last entry, once the watermark has passed ``days`` days without a new one."""
    return _keyed(events).transformWithStateInPandas(Expiring(days * 86_400_000), "user_id long, ms long, event_id long, expired_ms long", "Append", "EventTime")


def drained(stream: DataFrame, folder: str, each: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> DataFrame:
    """What the stream has put out in ``folder`` so far, after all that is there now has been read in append mode.

    Started again with the folder it goes on where it stopped.  A batch is
    written under its number, so that one that runs again replaces itself.
    ``each`` makes the rows of a batch from what came; it has to give the same
    columns for every batch.
    """
    spark = stream.sparkSession
    spark.createDataFrame([], each(spark.createDataFrame([], stream.schema)).schema).write.mode("overwrite").parquet(f"{folder}/rows/batch=-1")

    def put(batch: DataFrame, number: int) -> None:
        each(batch).write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    with settings(spark, _STORE):
        stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/rows").drop("batch")


def unsettled(links: DataFrame, candidates: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """For ``drained``: the candidates of a batch's specs (spec_id) that have no confirmed link, best first by rank.

    ``links`` and ``candidates`` are tables; both are read anew for every batch,
    so that what was confirmed meanwhile is skipped.
    """
    def run(batch: DataFrame) -> DataFrame:
        settled = links.where("is_confirmed = 1").select("spec_id")
        asked = batch.select("spec_id").distinct().join(settled, "spec_id", "left_anti")
        return candidates.join(asked, "spec_id", "left_semi").selectExpr("*", "row_number() OVER (PARTITION BY spec_id ORDER BY confidence DESC, offer_id) AS rank")

    return run
