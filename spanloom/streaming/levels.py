"""How many intervals of a stream are open at once, with state that timers empty."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: What the state store has to be, as these operators keep maps and timers (fixed value of the engine).
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Levels(StatefulProcessor):
    """Keeps each owner's begins and ends that the watermark hasn't passed, and the number of intervals open where it stands."""

    def __init__(self, by: str):
        self.by = by

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getMapState("steps", "t bigint", "d bigint")
        self.here = handle.getValueState("here", "t bigint, level bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = max(0, timerValues.getCurrentWatermarkInMs())
        new: Counter = Counter()
        for batch in rows:
            for s, e in zip(batch["s"].tolist(), batch["e"].tolist(), strict=True):
                if s >= passed:  # later rows are dropped: their cells have gone out
                    new[s] += 1
                    new[e] -= 1
        for t, d in new.items():
            known = self.steps.getValue((t,))[0] if self.steps.containsKey((t,)) else 0
            self.steps.updateValue((t,), (known + d,))
            self.handle.registerTimer(t)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        due = sorted((t, d) for (t,), (d,) in self.steps.iterator() if t <= passed)
        at, level = self.here.get() if self.here.exists() else (None, 0)
        cells = []
        for t, d in due:
            if level and t > at:
                cells.append((*key, at, t, level))
            at, level = t, level + d
            self.steps.removeKey((t,))
        if due:
            self.here.update((at, level))
        if cells:
            yield pd.DataFrame(cells, columns=[self.by, "s", "e", "level"])

    def close(self) -> None:
        pass


def concurrency(stream: DataFrame, by: str, late: str = "1 hour") -> DataFrame:
    """(by, s, e, level): cells of time, in milliseconds, in which ``level`` > 0 intervals are open; each goes out once, when the watermark passes its end.

    ``stream`` has by, begins and ends (TIMESTAMP). Rows may come in any order within ``late``; those that begin before the watermark are
    dropped. An owner's state is the begins and ends that the watermark hasn't passed, which timers remove, and one number.
    The session's state store is STATE_STORE.
    """
    rows = stream.where("ends > begins").withWatermark("begins", late)
    rows = rows.select(by, "begins", F.unix_millis("begins").alias("s"), F.unix_millis("ends").alias("e"))
    kind = stream.schema[by].dataType.simpleString()
    return rows.groupBy(by).transformWithStateInPandas(_Levels(by), f"{by} {kind}, s bigint, e bigint, level bigint", "Append", "EventTime")
