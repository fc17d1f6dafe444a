"""Keyed stream processors with map state and timers: order books, episodes that close on silence, silent feeds.

They need the RocksDB state store (``run.keyed_state``). A key's rows of one micro-batch are put in order of (ts, id); how
many these are is bounded by the source's rate limit (maxFilesPerTrigger, maxBytesPerTrigger). Every call to the state goes to
the JVM and back, so a key reads and writes what it needs once per micro-batch, not once per row. Event time is in
microseconds, timers are in milliseconds, so a timer fires up to 2 ms after what it waits for. Rows later than the
watermark are dropped and counted (``run.late_rows``).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def in_order(rows: Iterator[Row]) -> list[Row]:
    """A key's rows, with the columns of ``timed``, by (us, id), nulls last."""
    last = lambda x: (x is None, x or 0)
    return sorted(rows, key=lambda r: (last(r[1]), last(r[2])))


def timed(stream: DataFrame, key: str, delay: str | None, *columns) -> DataFrame:
    """The key, the event time as a number that no worker's time zone changes (us), id, ts and ``columns``, in this order, with a
    watermark. Rows without a key are no one's: they are left out."""
    s = stream.withWatermark("ts", delay) if delay else stream
    return s.where(F.col(key).isNotNull()).select(key, F.unix_micros("ts").alias("us"), "id", "ts", *columns)


def past(us: int) -> int:
    """The first timer, in milliseconds, that is past a time in microseconds."""
    return us // 1000 + 1


BLOCK = 1000  # a whole unit of price


class Ladder(StatefulProcessor):
    """The ask side of a book as map entries of a thousand adjacent prices each, beside the best price and the list of the entries. A micro-batch
    reads the entries that it changes, and the lowest one when the best level goes; each once. It writes those that it has changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.levels = handle.getMapState("levels", "block bigint", "prices array<bigint>, sizes array<double>")
        self.head = handle.getValueState("head", "best bigint, blocks array<bigint>")
        self.row = Row("asset", "ts", "id", "best")

    def handleInputRows(self, key, rows, timerValues):
        got = self.head.get()
        best, stored = (got[0], set(got[1])) if got else (None, set())
        before, blocks, read, changed = best, set(stored), {}, set()

        def levels(block):
            if block not in read:
                read[block] = dict(zip(*self.levels.getValue((block,)))) if block in stored else {}
            return read[block]

        for _, _, i, ts, price, size, *reset in in_order(rows):
            now = best
            if any(reset):
                if stored:
                    self.levels.clear()
                stored, blocks, read, changed, now = set(), set(), {}, set(), None
            block = price // BLOCK
            here = levels(block)
            if size > 0:
                here[price] = size
                blocks.add(block)
                changed.add(block)
                now = price if now is None else min(now, price)
            elif here.pop(price, None) is not None:
                changed.add(block)
                if not here:
                    blocks.remove(block)
                if now == price:
                    now = min(levels(min(blocks))) if blocks else None
            if now != best:
                best = now
                yield self.row(key[0], ts, i, best)
        for block in changed:
            if read[block]:
                self.levels.updateValue((block,), (list(read[block]), list(read[block].values())))
            elif block in stored:
                self.levels.removeKey((block,))
        if blocks and (best != before or blocks != set(got[1] if got else [])):
            self.head.update((best, sorted(blocks)))
        elif got and not blocks:
            self.head.clear()

    def close(self) -> None:
        pass


def book_state(deltas: DataFrame, delay: str = "1 minute") -> DataFrame:
    """Best ask per asset after each change. deltas: asset, side, price (thousandths), size, ts, id and optionally
    ``reset``, which begins a snapshot: what the book held before goes. A size of 0 removes its level, whichever it is;
    only side SELL holds asks; rows without a price or size change nothing."""
    reset = [c for c in ("reset",) if c in deltas.columns]
    asks = timed(deltas, "asset", delay, F.col("price").cast("bigint"), F.col("size").cast("double"), *reset, "side").where("side = 'SELL' AND price IS NOT NULL AND size IS NOT NULL AND NOT isnan(size)").drop("side")
    return asks.groupBy("asset").transformWithState(Ladder(), "asset string, ts timestamp, id bigint, best bigint", "append", "eventTime")


EPISODE = "start_us bigint, end_us bigint, status string, least bigint, mean double, updates bigint, phantom boolean, run string"


class Episodes(StatefulProcessor):
    """Sums of all legs' last prices under a limit, from opening to close; see ``arb_episodes``. An event's legs and open episode are one
    value; its timer is where the open episode's last tick puts it."""

    def __init__(self, key: str, legs: int, below: int, phantom: int, gap_us: int, run: str):
        self.key, self.n_legs, self.below, self.phantom, self.gap_us, self.run = key, legs, below, phantom, gap_us, run

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.book = handle.getValueState("book", "prices map<string,bigint>, start bigint, last bigint, least bigint, sums bigint, n bigint")
        self.row = Row(self.key, *[c.split()[0] for c in EPISODE.split(", ")])

    def _row(self, key, live, end, status):
        start, _, least, total, n = live
        return self.row(key[0], start, end, status, least, total / n, n, least < self.phantom, self.run)

    def _read(self):
        got = self.book.get()
        if got is None:
            return {}, None
        return dict(got[0]), tuple(got[1:]) if got[1] is not None else None

    def _write(self, prices, live) -> None:
        self.book.update((prices, *(live or [None] * 5)))

    def _due(self, live) -> int | None:
        return past(live[1] + self.gap_us) if live else None

    def handleInputRows(self, key, rows, timerValues):
        prices, live = self._read()
        total, due = sum(prices.values()), self._due(live)
        touched = False
        for _, us, _, _, leg, price in in_order(rows):
            total += price - prices.get(leg, 0)
            prices[leg] = price
            if live and us - live[1] > self.gap_us:
                yield self._row(key, live, live[1] + self.gap_us, "silence")
                live = None
            if len(prices) < self.n_legs:
                continue
            if total < self.below:
                start, _, least, sums, n = live or (us, us, total, 0, 0)
                live, touched = (start, us, min(least, total), sums + total, n + 1), True
            elif live:
                yield self._row(key, live, us, "closed")
                live = None
        if live and touched:
            yield self._row(key, live, None, "open")
        self._write(prices, live)
        if self._due(live) != due:
            if due is not None:
                self.handle.deleteTimer(due)
            if live:
                self.handle.registerTimer(self._due(live))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        prices, live = self._read()
        if live and expiredTimerInfo.getExpiryTimeInMs() >= self._due(live):
            self._write(prices, None)
            yield self._row(key, live, live[1] + self.gap_us, "silence")

    def close(self) -> None:
        pass


def arb_episodes(ticks: DataFrame, legs: int, below: int, phantom: int, gap_s: float = 3.0, delay: str = "1 minute", run: str = "") -> DataFrame:
    """A log of episodes per event. Once all ``legs`` are known, an episode opens when the sum of their last prices falls
    under ``below``. It closes at the tick that lifts the sum again, or ``gap_s`` seconds after its last tick if none of
    its event comes until then (a timer, moved at each tick). ``phantom``: the least sum is under that. An open episode
    has a row of status "open" for each micro-batch that moved it. ticks: event, leg, price, ts, id; rows without a leg or price
    change nothing."""
    kind = dict(ticks.dtypes)["event"]
    processor = Episodes("event", legs, below, phantom, int(gap_s * 1e6), run)
    known = timed(ticks, "event", delay, "leg", F.col("price").cast("bigint")).where("leg IS NOT NULL AND price IS NOT NULL")
    return known.groupBy("event").transformWithState(processor, f"event {kind}, {EPISODE}", "append", "eventTime")


def settled_episodes(log: DataFrame, runs: list[tuple[str, int]]) -> DataFrame:
    """One row per episode of the logs of several runs, in the order in which they started (name, start in microseconds).
    What an earlier run left open ended when the next began, with no duration: status "orphan". The last run's are open."""
    keys = ["run", "event", "start_us"]
    last = log.groupBy(*keys).agg(F.max_by(F.struct("end_us", "status", "least", "mean", "updates", "phantom"), F.struct((F.col("status") != "open").cast("int"), "updates")).alias("s")).select(*keys, "s.*")
    began = F.create_map(*[x for (name, _), (_, start) in zip(runs, runs[1:]) for x in (F.lit(name), F.lit(start))]) if len(runs) > 1 else F.lit(None).cast("map<string,bigint>")
    orphan = (F.col("status") == "open") & F.col("run").isin([name for name, _ in runs[:-1]])
    last = last.withColumn("status", F.when(orphan, "orphan").otherwise(F.col("status")))
    return last.withColumn("duration_us", F.when(F.col("status").isin("closed", "silence"), F.col("end_us") - F.col("start_us"))).withColumn("end_us", F.when(F.col("status") == "orphan", began[F.col("run")]).otherwise(F.col("end_us")))


class Silence(StatefulProcessor):
    """A row when a feed has had no item for a while; armed again by its next item."""

    def __init__(self, feed: str, limit_us: int, event_time: bool):
        self.feed, self.limit_us, self.event_time = feed, limit_us, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint, items bigint, warned boolean")
        self.row = Row(self.feed, "last_us", "silent_us", "items")

    def handleInputRows(self, key, rows, timerValues):
        last, items, warned = self.last.get() or (None, 0, False)
        before = last
        for _, us, _, _ in in_order(rows):
            us = us if self.event_time else timerValues.getCurrentProcessingTimeInMs() * 1000
            if last is not None and us - last > self.limit_us and not warned:
                yield self.row(key[0], last, last + self.limit_us, items)
            if last is None or us > last:
                last, warned = us, False
            items += 1
        self.last.update((last, items, warned))
        if last != before:
            if before is not None:
                self.handle.deleteTimer(past(before + self.limit_us))
            self.handle.registerTimer(past(last + self.limit_us))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        last, items, warned = self.last.get()
        if not warned and expiredTimerInfo.getExpiryTimeInMs() >= past(last + self.limit_us):
            self.last.update((last, items, True))
            yield self.row(key[0], last, last + self.limit_us, items)

    def close(self) -> None:
        pass


def feed_silence_warnings(stream: DataFrame, feed: str, limit: float = 3 * 3600, delay: str = "10 minutes", clock: str = "event") -> DataFrame:
    """A row for every time that a feed is silent for over ``limit`` seconds: its last item's time, the time when the limit was
    reached, and how many items it has sent so far. ``clock`` is "event" (the watermark, which other feeds move on) or
    "processing" (the wall clock: rows come without any input). stream: the feed's column, ts, id."""
    kind = dict(stream.dtypes)[feed]
    s = timed(stream, feed, delay if clock == "event" else None)
    processor = Silence(feed, int(limit * 1e6), clock == "event")
    return s.groupBy(feed).transformWithState(processor, f"{feed} {kind}, last_us bigint, silent_us bigint, items bigint", "append", "eventTime" if clock == "event" else "processingTime")
