"""Daily budgets, status and progress by key: rules once, for finished tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def daily_usage(events: DataFrame, key: str, at: str, amount: Column) -> DataFrame:
    """key, day, used: a tumbling day in UTC; works on batches and streams alike."""
    return events.groupBy(key, F.window(F.col(at), "1 day").alias("w")).agg(F.sum(amount).alias("used")).select(
        key, F.to_date("w.start").alias("day"), "used"
    )


def walk(deltas: list[int], limit: int, used: int = 0) -> tuple[list[bool], list[int], int]:
    """Accept or reject each delta in turn: a reservation must fit, a credit stops at zero."""
    accepted, after = [], []
    for delta in deltas:
        fits = delta <= 0 or used + delta <= limit
        if fits:
            used = max(0, used + delta)
        accepted.append(fits)
        after.append(used)
    return accepted, after, used


def reserved(events: DataFrame, key: str, at: str, delta: str, limit: int, tie: str) -> DataFrame:
    """key, day, at, tie, delta, accepted, used after it: per key and day in order of time.

    A rule's result depends on all before it in its day, which no window
    function can say. Days are hashed to partitions and sorted there, and one
    pass folds over the rows as they come: nothing is held but the amount used,
    however long a day is. A day with a null key is a day of its own; a null
    delta changes nothing and is accepted.
    """
    kinds = {c: events.schema[c].dataType.simpleString() for c in (key, at, delta, tie)}
    daily = events.select(key, F.to_date(at).alias("day"), at, tie, delta)
    schema = f"{key} {kinds[key]}, day date, {at} {kinds[at]}, {tie} {kinds[tie]}, {delta} {kinds[delta]}, accepted boolean, used long"

    def fold(batches):
        import pyarrow as pa

        day: tuple | None = None
        used = 0
        for batch in batches:
            accepted, after = [], []
            keys, days, deltas = (batch.column(i).to_pylist() for i in (0, 1, 4))
            for k, d, x in zip(keys, days, deltas, strict=True):
                if (k, d) != day:
                    day, used = (k, d), 0
                ok, _, used = walk([x or 0], limit, used)
                accepted += ok
                after.append(used)
            columns = [*batch.columns, pa.array(accepted, pa.bool_()), pa.array(after, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "accepted", "used"])

    return daily.repartition(key, "day").sortWithinPartitions(key, "day", at, tie).mapInArrow(fold, schema)


def reserved_stream(events: DataFrame, key: str, delta: str, limit: int) -> DataFrame:
    """The same over a stream, with the used amount of each (key, day) as state that ends with its day."""
    daily = events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).withWatermark("ts", "1 day")

    def run(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values("ts")
            accepted, after, used = walk(frame[delta].tolist(), limit, used)
            yield pd.DataFrame({key: group[0], "day": group[1], delta: frame[delta], "accepted": accepted, "used": after})
        state.update((used,))
        end = int((pd.Timestamp(group[1], tz="UTC") + pd.Timedelta(days=2)).timestamp() * 1000)
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    kind = events.schema[key].dataType.simpleString()
    kind_delta = events.schema[delta].dataType.simpleString()
    return daily.groupBy(key, "day").applyInPandasWithState(
        run, f"{key} {kind}, day string, {delta} {kind_delta}, accepted boolean, used long", "used long", "append", "EventTimeTimeout"
    )


def latest_status(events: DataFrame, key: str, at: str, status: str, tie: str) -> DataFrame:
    """The last status of each key."""
    best = events.groupBy(key).agg(F.max(F.struct(at, tie, status)).alias("b"))
    return best.select(key, F.col(f"b.{status}").alias(status), F.col(f"b.{at}").alias(at))


def progress(lines: DataFrame, line: str) -> DataFrame:
    """done, total and percent of lines with a fraction a/b."""
    parts = lines.where(F.col(line).rlike(r"\d+/\d+"))
    found = parts.withColumns(
        {"done": F.regexp_extract(line, r"(\d+)/(\d+)", 1).cast("int"), "total": F.regexp_extract(line, r"(\d+)/(\d+)", 2).cast("int")}
    )
    share = F.when(F.col("total") > 0, F.least(F.lit(100), F.round(F.col("done") * 100 / F.col("total")))).otherwise(0)
    return found.withColumn("percent", share.cast("int"))
