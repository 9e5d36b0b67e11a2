"""Structured Streaming: metric tails that emit each epoch once, and newest frames per session."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tail_new_epochs(rows: DataFrame) -> DataFrame:
    """Rows (run_id, epoch, value) above the run's high-water mark: a rewritten epoch is not emitted again.

    State is one integer per run, kept in the checkpoint, so a restart goes on where it stopped."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.get[0] if state.exists else -1
        got = pd.concat(list(parts))
        fresh = got[got["epoch"] > mark].drop_duplicates("epoch", keep="last").sort_values("epoch")
        if len(fresh):
            state.update((int(fresh["epoch"].max()),))
            yield fresh[["run_id", "epoch", "value"]]

    return rows.groupBy("run_id").applyInPandasWithState(step, "run_id long, epoch int, value double", "mark int", "append", GroupStateTimeout.NoTimeout)


def latest_frames(batch: DataFrame) -> DataFrame:
    """Of a micro-batch (session, frame_id, payload): the newest frame of each session and how many were dropped."""
    return batch.groupBy("session").agg(F.max("frame_id").alias("frame_id"), F.max_by("payload", "frame_id").alias("payload"), (F.count(F.lit(1)) - 1).alias("dropped"))
