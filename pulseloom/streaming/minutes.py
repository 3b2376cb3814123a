"""Minute features over a stream of beats, and hopping windows on event time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulseloom.operators.signal import time_domain_of
from pulseloom.schemas import TIME_3

OUT = "rec long, minute long, n long, " + ", ".join(f"{c} double" for c in TIME_3)
#: Beats of the windows that are still open, and the last minute given out.
STATE = "t array<long>, rr array<double>, done long"
MINUTE = 60_000


def trailing_features(beats: DataFrame, minutes: int = 3, least: int = 5, late: str = "2 minutes") -> DataFrame:
    """(rec, minute, n, the ten features of three minutes) of each minute of beats (rec, ts, rr_ms), on event time.

    minute counts from the epoch. A minute is given out once the watermark, ``late``
    behind the newest beat, has passed its end, so that beats may come in any order within
    that; later ones are dropped. A recording that falls silent is closed by a timeout: what
    it still holds is given out, and its state goes. The state holds the beats of one
    trailing window and of the minutes that the watermark hasn't passed, no more.
    """
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, rr, done = state.get if state.exists else ([], [], None)
        t, rr = np.asarray(t, np.int64), np.asarray(rr, float)
        if not state.hasTimedOut:
            new = pd.concat(list(batches))
            new = new[new["rr_ms"].between(200, 2000)]
            t, rr = np.append(t, new["t_ms"].to_numpy(np.int64)), np.append(rr, new["rr_ms"].to_numpy(float))
            order = np.argsort(t, kind="stable")
            t, rr = t[order], rr[order]
        passed = int(t[-1]) // MINUTE if state.hasTimedOut and len(t) else state.getCurrentWatermarkMs() // MINUTE
        done = done if done is not None else int(t[0]) // MINUTE - 1 if len(t) else passed
        rows = []
        # Minutes beyond the last beat's window are empty, whatever the watermark says.
        for m in range(done + 1, min(passed, int(t[-1]) // MINUTE + minutes + 1 if len(t) else passed) + 1):
            a, b = np.searchsorted(t, (m - minutes) * MINUTE, "left"), np.searchsorted(t, m * MINUTE, "right")
            if b - a >= least:
                rows.append({"rec": key[0], "minute": m, "n": int(b - a), **time_domain_of(rr[a:b])})
        done = max(done, passed)
        if state.hasTimedOut:
            state.remove()
        else:
            keep = t >= (done + 1 - minutes) * MINUTE
            state.update((t[keep].tolist(), rr[keep].tolist(), done))
            state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(t[-1]) if len(t) else 0) + (minutes + 1) * MINUTE)
        if rows:
            yield pd.DataFrame(rows, columns=["rec", "minute", "n", *TIME_3])

    rows = timed(beats).withWatermark("ts", late).select("rec", "ts", F.unix_millis("ts").alias("t_ms"), F.col("rr_ms").cast("double").alias("rr_ms"))
    return rows.groupBy("rec").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def timed(events: DataFrame) -> DataFrame:
    """``events`` with ts as an instant; times without a zone are taken in the session's."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def hopping(events: DataFrame, size: str = "60 minutes", hop: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Counts and means of (ts, user_id, value) in hopping windows, late rows within the watermark included."""
    w = timed(events).withWatermark("ts", late).groupBy(F.window("ts", size, hop), "user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"))
    return w.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user_id", "n", "mean_value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Clusters of a user's events with gaps below ``gap``."""
    w = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user_id", "n")
