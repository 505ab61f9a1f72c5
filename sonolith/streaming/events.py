"""Streaming forms: windows over late data, and intervals and bouts by state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(events: DataFrame, width: str, slide: str | None = None, late: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ("event_type",)) -> DataFrame:
    """Counts and sums in tumbling windows, or in hopping ones if they slide; events later than ``late`` are not counted."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    counted = events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *by, "n", "total")


def gap_sessions(events: DataFrame, gap: str, late: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    """Sessions of point events that are nearer than the gap; not bouts, whose gap runs from a stop."""
    s = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return s.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *by, "n")


def _intervals(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last = state.get if state.exists else (None, None)
    out = []
    for p in pdfs:
        for r in p.sort_values("row_idx").itertuples():
            sex, stop = last
            if sex is not None and sex == r.sex and r.sex in ("male", "female"):
                out.append((key[0], int(r.row_idx), r.sex, float(r.start - stop)))
            last = (r.sex, float(r.stop))
    state.update(last)
    yield pd.DataFrame(out, columns=["session", "row_idx", "sex", "interval_s"])


def streaming_intervals(events: DataFrame) -> DataFrame:
    """End-to-start intervals of consecutive events of one identified sex, as rows arrive.

    The state of a session is its last emitter and stop, so it doesn't grow. Rows of a batch are
    taken in file order; rows that come in a later batch count as later, which is the order of arrival.
    """
    cols = events.select(F.col("session_id").cast("string").alias("session"), "row_idx", "sex", "start", "stop")
    return cols.groupBy("session").applyInPandasWithState(_intervals, "session string, row_idx long, sex string, interval_s double", "sex string, stop double", "append", GroupStateTimeout.NoTimeout)


def _bouts(gap: float):
    def work(key: tuple[Any, ...], pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        open_ = list(state.get) if state.exists else None
        out = []
        for p in pdfs:
            for r in p.sort_values(["start", "row_idx"]).itertuples():
                if open_ is None:
                    open_ = [float(r.start), float(r.stop), float(r.stop), 1]
                elif r.start - open_[2] > gap:
                    out.append((key[0], open_[0], open_[1], int(open_[3])))
                    open_ = [float(r.start), float(r.stop), float(r.stop), 1]
                else:
                    open_ = [open_[0], max(open_[1], float(r.stop)), float(r.stop), open_[3] + 1]
        state.update(tuple(open_))
        yield pd.DataFrame(out, columns=["session", "onset", "offset", "n_calls"])

    return work


def streaming_bouts(events: DataFrame, gap: float) -> DataFrame:
    """Bouts that have ended: a call more than ``gap`` behind the stop before it ends the bout. The open one stays in the state."""
    cols = events.select(F.col("session_id").cast("string").alias("session"), "row_idx", "start", "stop")
    return cols.groupBy("session").applyInPandasWithState(_bouts(gap), "session string, onset double, offset double, n_calls long", "onset double, latest double, last double, n long", "append", GroupStateTimeout.NoTimeout)


def upsert_batches(table_path: str, keys: list[str]):
    """For ``foreachBatch``: a batch takes the place of the slices (key values) that it has in a table partitioned by the keys.

    Other slices are neither read nor written; a batch that runs again gives the same table.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(table_path)

    return run
