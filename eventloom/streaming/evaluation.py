"""ST5: delayed evaluation of signals as a stateful stream with event-time timers."""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3_600_000_000


class Evaluation(StatefulProcessor):
    """Signals of one key and hour: pending until their target, refreshed by each earlier bar, final when the watermark is past the deadline.

    A key's signals are one value of its state and its bars another, and a key waits for two timers, its earliest deadline and its
    newest bar: each read, write and timer is a call to the JVM, and one for every row takes most of the time.
    """

    def __init__(self, tolerance_us: int):
        self.tolerance = tolerance_us

    def init(self, handle) -> None:
        self.handle = handle
        self.signals = handle.getValueState("signals", "id array<long>, target array<long>, observed array<long>, price array<double>")
        self.bars = handle.getValueState("bars", "at array<long>, price array<double>")

    def due(self, target: int) -> int:
        """The first millisecond past a deadline."""
        return (target + self.tolerance) // 1000 + 1

    def read(self) -> tuple[dict, dict]:
        """Signals by id and prices of bars by time."""
        number, *rest = self.signals.get() or ([], [], [], [])
        return dict(zip(number, zip(*rest))), dict(zip(*(self.bars.get() or ([], []))))

    def write(self, state, columns: list[list]) -> None:
        if columns and columns[0]:
            state.update(tuple(columns))
        else:
            state.clear()

    def handleInputRows(self, key, rows, timerValues):
        waiting, known = self.read()
        earliest, newest = min((s[0] for s in waiting.values()), default=None), max(known, default=None)
        changed, more = False, False
        for r in sorted(rows, key=lambda r: (r.at, -1 if r.price is None else r.price)):
            if r.id is None and r.at not in known:  # of several bars at one time the first to come, the least of a batch
                known[r.at], more = r.price, True
            elif r.id is not None and r.id not in waiting:
                waiting[r.id], changed = (r.at, None, None), True
        times = sorted(known)
        for number, (target, observed, _) in waiting.items():
            place = bisect_left(times, target)
            first = times[place] if place < len(times) and times[place] <= target + self.tolerance else None
            if first is not None and (observed is None or first < observed):
                waiting[number], changed = (target, first, known[first]), True
        if changed:
            self.write(self.signals, [list(waiting), *map(list, zip(*waiting.values()))])
            if earliest is None or min(s[0] for s in waiting.values()) < earliest:
                self.handle.registerTimer(self.due(min(s[0] for s in waiting.values())))
        if more:
            self.write(self.bars, [times, [known[t] for t in times]])
            if newest is None or times[-1] > newest:
                self.handle.registerTimer(times[-1] // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()  # all that is due leaves with the first timer
        waiting, known = self.read()
        out = [
            Row(signal_id=number, ticker=key[0], target_us=target, observed_us=observed, price=price, status="missed_window" if observed is None else "evaluated")
            for number, (target, observed, price) in waiting.items() if self.due(target) <= now
        ]
        left = {number: s for number, s in waiting.items() if self.due(s[0]) > now}
        oldest = min((s[0] for s in left.values()), default=None)
        if out:
            self.write(self.signals, [list(left), *map(list, zip(*left.values()))])
            if left:
                self.handle.registerTimer(self.due(oldest))
        kept = sorted(t for t in known if t >= now * 1000 or (oldest is not None and t >= oldest))
        if len(kept) < len(known):
            self.write(self.bars, [kept, [known[t] for t in kept]])
        return iter(out)

    def close(self) -> None:
        pass


def evaluate_signals(signals: DataFrame, bars: DataFrame, hours: int = 4, tolerance_s: int = 1200, delay: str = "10 minutes") -> DataFrame:
    """One final row a signal: signal_id, ticker, target_us, observed_us, price, status (evaluated or missed_window).

    signals: a stream of signal_id, ticker, decision_at; bars: of ticker, at, price. A signal's outcome is the first bar from its
    target (decision and `hours`) to `tolerance_s` later. Until the watermark, `delay` behind the younger of both streams'
    newest rows, has passed that deadline, bars may come in any order and an earlier one replaces the outcome; then the row is
    emitted and its state goes. Rows behind the watermark are left out. Signals repeated under one id count once.

    State is kept by ticker and hour of the target, so that a hot ticker is many keys; a bar goes to the hours that it can
    serve, two at most where the tolerance is under an hour. Rows without key, time or price are left out. Needs the RocksDB
    state store (ROCKS).
    """
    tolerance = tolerance_s * 1_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    asked = signals.where("signal_id IS NOT NULL AND ticker IS NOT NULL AND decision_at IS NOT NULL").select(
        "ticker", F.col("signal_id").cast("long").alias("id"), (us("decision_at") + hours * HOUR).alias("at"), F.lit(None).cast("double").alias("price"), F.col("decision_at").cast("timestamp").alias("event_time")
    ).withColumn("bucket", F.floor(F.col("at") / HOUR))
    seen = bars.where("ticker IS NOT NULL AND at IS NOT NULL AND price IS NOT NULL").select("ticker", F.lit(None).cast("long").alias("id"), us("at").alias("at"), F.col("price").cast("double"), F.col("at").cast("timestamp").alias("event_time"))
    seen = seen.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - tolerance) / HOUR), F.floor(F.col("at") / HOUR))))
    both = asked.withWatermark("event_time", delay).unionByName(seen.withWatermark("event_time", delay))
    schema = "signal_id long, ticker string, target_us long, observed_us long, price double, status string"
    return both.groupBy("ticker", "bucket").transformWithState(statefulProcessor=Evaluation(tolerance), outputStructType=schema, outputMode="Append", timeMode="EventTime")
