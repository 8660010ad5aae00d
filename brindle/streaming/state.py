"""What a stream remembers: behaviour per user, thresholds that change, and output that a restart does not repeat."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from brindle.operators import behavior, policy

HISTORY = "user_id long, detection_id long, created_at timestamp, thread_id string, kind string, thread_count long, n_user long, n_thread long, n_kinds long, gap double"
#: Keyed map state needs this store of state.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class UserHistory(StatefulProcessor):
    """A user's threads (detections, last time, kinds) as map state beside the user's own totals.

    Only the threads of a batch's rows are read and written, however many a user has. Rows of a batch are taken in order of
    time and id, each sees those before it, and is recorded after it was looked at. Nothing is forgotten.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.threads = handle.getMapState("threads", "thread string", "n long, last long, kinds array<string>")
        self.user = handle.getValueState("user", "n long, threads long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["created_at", "detection_id"])
        n_user, n_threads = self.user.get() if self.user.exists() else (0, 0)
        seen: dict[str, tuple[int, int, list]] = {}
        out = []
        for r in batch.itertuples():
            thread, kind, now = str(r.thread_id), None if pd.isna(r.kind) else str(r.kind), r.created_at.value // 1000
            if thread not in seen:
                known = self.threads.containsKey((thread,))
                n, last, kinds = self.threads.getValue((thread,)) if known else (0, 0, [])
                seen[thread] = (n, last, list(kinds))
                n_threads += not known
            n, last, kinds = seen[thread]
            out.append((key[0], r.detection_id, r.created_at, thread, kind, n_threads, n_user, n, len(kinds), (now - last) / 1e6 if n else None))
            seen[thread] = (n + 1, now, kinds if kind in kinds else [*kinds, kind])
            n_user += 1
        for thread, value in seen.items():
            self.threads.updateValue((thread,), value)
        self.user.update((n_user, n_threads))
        yield pd.DataFrame(out, columns=["user_id", "detection_id", "created_at", "thread_id", "kind", "thread_count", "n_user", "n_thread", "n_kinds", "gap"])

    def close(self) -> None:
        pass


def behavior_stream(detections: DataFrame) -> DataFrame:
    """``stage3_as_documented`` of a stream (user_id, detection_id, created_at, thread_id, kind): signals from what was seen so far."""
    d = detections.select("user_id", "detection_id", "created_at", F.col("thread_id").cast("string").alias("thread_id"), F.col("kind").cast("string").alias("kind"))
    history = d.groupBy("user_id").transformWithStateInPandas(statefulProcessor=UserHistory(), outputStructType=HISTORY, outputMode="Append", timeMode="None")
    return behavior.signals(history)


def write_once(rows: DataFrame, path: str, batch_id: int) -> None:
    """A batch's rows under its own number: whoever writes a batch again replaces it, so none is there twice."""
    rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")


def run_once(stream: DataFrame, change: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Each micro-batch through ``change`` into ``path``, exactly once across restarts; by default what is there, then stop."""
    writer = stream.writeStream.foreachBatch(lambda rows, batch_id: write_once(change(rows), path, batch_id))
    return writer.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def banded_stream(detections: DataFrame, versions_path: str, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Detections with the band of the thresholds in force at their time.

    The versions are a table of their own, read anew for every micro-batch, so an update counts from the next batch on, for
    detections from its time on. ``jobs.strike_stream`` takes the bands from there.
    """
    spark = detections.sparkSession

    def band(rows: DataFrame) -> DataFrame:
        return policy.band_as_of(rows, spark.read.parquet(versions_path))

    return run_once(detections, band, path, checkpoint, **trigger)
