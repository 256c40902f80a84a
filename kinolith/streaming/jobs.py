"""Jobs over time: flags that expire, status changes that are allowed, and how failures are classed."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds that a cancel flag and a process id are kept. Fixed values.
CANCEL_SECONDS, PROCESS_SECONDS = 600, 900
#: Words in a message, and exit codes, that mean a lack of memory. Fixed values.
MEMORY_WORDS = ("memory", "ram", "oom", "out of memory", "killed", "sigkill")
MEMORY_CODES = (-9, 137)
#: Status changes that are allowed; the first status of a job is PENDING.
PENDING = "Pending"
CHANGES = ((PENDING, "Processing"), (PENDING, "Failed"), ("Processing", "Completed"), ("Processing", "Failed"))


def flag_is_set(probes: DataFrame, flags: DataFrame, key: str, at: str, seconds: int, name: str = "flagged") -> DataFrame:
    """probes with whether a flag of their key was set at most so many seconds before, or at that moment.

    Time is cut into slots as long as a flag lives: only a probe's own slot and
    the one before can hold its flag, and of those only the first and the last
    time matter. So flags shrink to one row per key and slot, probes meet them
    by equality, and a hot key's flags spread over its slots.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    life = seconds * 1_000_000
    slots = flags.select(F.col(key), micros(at).alias("_t")).groupBy(key, F.floor(F.col("_t") / life).alias("_slot")).agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    probed = probes.withColumns({"_t": micros(at)}).withColumn("_slot", F.floor(F.col("_t") / life))
    before = slots.select(key, (F.col("_slot") + 1).alias("_slot"), F.col("_last").alias("_before"))
    both = probed.join(slots.select(key, "_slot", "_first"), [key, "_slot"], "left").join(before, [key, "_slot"], "left")
    here = (F.col("_first") <= F.col("_t")) | (F.col("_before") >= F.col("_t") - life)
    return both.withColumn(name, F.coalesce(here, F.lit(False))).select(*probes.columns, name)


def flags_stream(events: DataFrame, key: str, seconds: int = CANCEL_SECONDS) -> DataFrame:
    """The same over a stream of (key, ts, action): each `probe` answers key, ts, flagged; `set` starts or renews the flag.

    The state of a key is when its flag ends; it goes away with it.
    """

    def run(group, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        until = state.get[0] if state.exists else -1
        for frame in frames:
            frame = frame.sort_values(["ts", "action"], ascending=[True, False])  # set before probe
            answers = []
            for at, action in zip(frame["ts"], frame["action"], strict=True):
                now = int(at.timestamp() * 1_000_000)
                if action == "set":
                    until = now + seconds * 1_000_000
                else:
                    answers.append((group[0], at, now <= until))
            yield pd.DataFrame(answers, columns=[key, "ts", "flagged"])
        if until >= 0:
            state.update((until,))
            state.setTimeoutTimestamp(max(until // 1000 + 1, state.getCurrentWatermarkMs() + 1))

    kind = events.schema[key].dataType.simpleString()
    timed = events.withWatermark("ts", f"{seconds} seconds").groupBy(key)
    return timed.applyInPandasWithState(run, f"{key} {kind}, ts timestamp, flagged boolean", "until long", "append", "EventTimeTimeout")


def status_changes(events: DataFrame, key: str, at: str, status: str, tie: str, changes: Sequence[tuple[str, str]] = CHANGES, start: str = PENDING) -> DataFrame:
    """events with the status before each of a key, and whether that change is allowed; a first status must be start.

    A key's rows are looked at day by day, each day beginning with the last
    status of the key's day before, so that no task needs a whole history.
    """
    dated = events.withColumn("_day", F.to_date(at))
    order = Window.partitionBy(key, "_day").orderBy(at, tie)
    last = dated.groupBy(key, "_day").agg(F.max(F.struct(at, tie, F.col(status).alias("s"))).alias("_l"))
    earlier = last.withColumn("_carried", F.lag("_l.s").over(Window.partitionBy(key).orderBy("_day")))  # a row a day
    joined = dated.join(earlier.select(key, "_day", "_carried"), [key, "_day"])
    before = F.coalesce(F.lag(status).over(order), F.col("_carried"))
    allowed = F.lit(False)
    for one, two in changes:
        allowed = allowed | ((F.col("before") == one) & (F.col(status) == two))
    first = F.col("before").isNull() & (F.col(status) == start)
    return joined.withColumn("before", before).withColumn("allowed", F.coalesce(allowed, F.lit(False)) | F.coalesce(first, F.lit(False))).select(*events.columns, "before", "allowed")


def failure_class(code: Column, message: Column) -> Column:
    """memory, failed, or null for an exit code of 0 and no message.

    A word counts wherever it stands: "ram" within "parameter" means memory too,
    as users of the surveyed service get it. The refund is the same for both.
    """
    words = F.lit(False)
    for w in MEMORY_WORDS:
        words = words | F.contains(F.lower(message), F.lit(w))
    memory = F.coalesce(code.isin(*MEMORY_CODES), F.lit(False)) | F.coalesce(words, F.lit(False))
    failed = F.coalesce(code != 0, F.lit(False)) | message.isNotNull()
    return F.when(memory, "memory").when(failed, "failed")


def compensations(jobs: DataFrame, key: str, code: str, message: str, requested: str) -> DataFrame:
    """key, class and refund of failed jobs: all of what was asked for comes back."""
    kind = failure_class(F.col(code), F.col(message))
    return jobs.select(key, kind.alias("class"), F.greatest(F.lit(0), F.col(requested)).cast("long").alias("refund")).where("class is not null")


def read_or_refund(read, ip: str, rows: int):
    """(table, None), or (None, (ip, rows)) if it cannot be read: a refund to append to the day's credits.

    Every column of every row is parsed once before the table counts as
    readable; a reader in mode FAILFAST therefore also finds a malformed line.
    Only what goes wrong with reading is made a refund, other errors are raised.
    """
    try:
        table = read()
        table.agg(*[F.count(F.col(f"`{c}`")) for c in table.columns] or [F.count("*")]).first()
        return table, None
    except (PySparkException, Py4JJavaError, OSError, UnicodeError):
        return None, (ip, rows)
