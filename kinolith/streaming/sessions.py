"""Lines of a job's session as a stream: in order, with an end, and a sign of life while nothing comes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: The line that ends a session, and seconds of silence before a keep-alive. Fixed values.
FINISHED, KEEP_ALIVE_SECONDS = "__FINISHED__", 15
#: Seconds that a session which never ends is kept after its last line, and one that ended so that late lines are known.
ABANDONED_SECONDS, ENDED_SECONDS = 86_400, 900

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
KINDS = ("open", "line", "keep-alive", "end", "late")


class SessionFeed(StatefulProcessor):
    """The state of a session: how many lines it had, when the last came, whether it ended. One timer at a time."""

    def __init__(self, key: str, seconds: float):
        self.key, self.wait = key, int(seconds * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "lines long, last long, ended boolean")

    def _arm(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _frame(self, group, rows) -> pd.DataFrame:
        return pd.DataFrame([(group, *r) for r in rows], columns=[self.key, "number", "kind", "line"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        now = timerValues.getCurrentProcessingTimeInMs()
        lines, _, ended = self.held.get() if self.held.exists() else (0, now, False)
        out = [(0, "open", None)] if not lines and not ended else []
        for frame in [pd.concat(list(rows)).sort_values("seq", kind="stable")]:
            for line in frame["line"]:
                text = (line or "").rstrip("\n")
                if ended:
                    out.append((lines, "late", text))
                elif text == FINISHED:
                    ended = True
                    out.append((lines, "end", None))
                else:
                    lines += 1
                    out.append((lines, "line", text))
        self.held.update((lines, now, ended))
        self._arm(now + (ENDED_SECONDS * 1000 if ended else self.wait))
        yield self._frame(key[0], out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        if not self.held.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        lines, last, ended = self.held.get()
        if ended or now - last >= ABANDONED_SECONDS * 1000:
            self.held.clear()
            return
        self.handle.registerTimer(now + self.wait)
        yield self._frame(key[0], [(lines, "keep-alive", None)])

    def close(self) -> None:
        pass


def session_feed(lines: DataFrame, key: str = "session", seconds: float = KEEP_ALIVE_SECONDS) -> DataFrame:
    """key, number, kind and line over a stream of (key, seq, line).

    A session opens with its first line; its lines come numbered from 1, in
    order of seq within what arrives together; FINISHED ends it, and lines
    behind the end are marked late, not lost. While it is open and nothing
    comes, a keep-alive follows every so many seconds, by the clock of the
    stream's trigger. State and timers are in the checkpoint, so a restarted
    stream goes on where it stopped. Null keys are left out; a null line is
    empty. Needs the state store STORE.
    """
    some = lines.where(F.col(key).isNotNull()).select(key, "seq", "line")
    kind = lines.schema[key].dataType.simpleString()
    return some.groupBy(key).transformWithStateInPandas(
        SessionFeed(key, seconds), f"{key} {kind}, number long, kind string, line string", outputMode="Append", timeMode="ProcessingTime"
    )
