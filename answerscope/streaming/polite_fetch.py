"""Polite fetching as a stateful stream: each host is a key with its own pages, rules and clock.

Requests are a stream of urls. A host's state holds the pages that wait, those that are done, its robots rules, and when
it may be asked next; a timer wakes it then, it asks for `quantum` pages, and sets the next timer. So no host waits for
another, a task holds the bodies of a quantum at a time, and a host of very many pages only is a long list in the state
store, of which a few are read at a time. A busy answer (429) sets the clock by what it asks for; the page is asked for
once more.

State, clock and the place in the stream are checkpointed with every micro-batch, whose attempts go to the crawl cache
under the batch's number. A restart goes on where it was and asks for no page of a committed batch again; only pages of
a batch that was under way are repeated: `quantum` a host at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.pages import cache_key
from ..functions.urls import authority
from ..sources.crawl import ATTEMPT, Robots, _requests_get, attempt_rows, fetch_one
from .crawl_cache import CrawlCache, merge_batch

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FETCHED = ATTEMPT.removeprefix("key string, ")
#: A host's rules are read again after so many milliseconds; a page that stays busy is asked for so often.
RULES_HOLD, TRIES = 24 * 3600 * 1000, 2


class _Host(StatefulProcessor):
    def __init__(self, make_get: Callable[[], Callable], delay: float, timeout: float, quantum: int):
        self.make_get, self.delay, self.timeout, self.quantum = make_get, delay, timeout, quantum

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "url string", "tries int")
        self.done = handle.getMapState("done", "url string", "at long")
        self.rules = handle.getMapState("rules", "place string", "kind int, text string, read long")
        self.clock = handle.getValueState("clock", "due long, timer boolean")
        self.get = self.make_get()

    def _wake(self, now: int, due: int) -> None:
        due = max(due, now + 1)
        self.handle.registerTimer(due)
        self.clock.update((due, True))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        fresh = False
        for f in rows:
            for url in f["url"]:
                if not self.waiting.containsKey((url,)) and not self.done.containsKey((url,)):
                    self.waiting.updateValue((url,), (0,))
                    fresh = True
        due, timer = self.clock.get() if self.clock.exists() else (0, False)
        if fresh and not timer:
            self._wake(now, due)
        yield from ()

    def _robots(self, now: int) -> Robots:
        """Rules of the state, read from the host where it has none."""
        robots = Robots(self.get, timeout=min(self.timeout, 10))
        read = robots.read_text

        def kept(place: str) -> tuple[int, str]:
            known = self.rules.getValue((place,)) if self.rules.containsKey((place,)) else None
            if known and now - known[2] < RULES_HOLD:
                return known[0], known[1]
            kind, text = read(place)
            self.rules.updateValue((place,), (kind, text, now))
            return kind, text

        robots.read_text = kept
        return robots

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        robots, found, wait = self._robots(now), [], self.delay
        urls = []
        for (url,), (tries,) in self.waiting.iterator():
            urls.append((url, tries))
            if len(urls) > self.quantum:
                break
        for url, tries in urls[: self.quantum]:
            page = fetch_one(self.get, robots, url, self.timeout)
            if page.wait is not None and tries + 1 < TRIES:
                self.waiting.updateValue((url,), (tries + 1,))
                wait = max(wait, page.wait)
                break  # the host asks for a pause
            self.waiting.removeKey((url,))
            self.done.updateValue((url,), (now,))
            found.append(page)
        if len(urls) > len(found):
            self._wake(now, now + int(wait * 1000))
        else:
            self.clock.update((now + int(wait * 1000), False))
        if found:
            yield attempt_rows(found)

    def close(self) -> None:
        pass


def fetch_politely(requests: DataFrame, cache: CrawlCache, checkpoint: str, make_get: Callable[[], Callable] = _requests_get, delay: float = 1.0, timeout: float = 20, quantum: int = 1, trigger: str = "1 second") -> StreamingQuery:
    """requests: a stream with a column url, read in a session of `polite_session`. Attempts go to the cache until the query is stopped."""
    hosts = requests.select("url", authority(F.col("url")).alias("host")).groupBy("host")
    found = hosts.transformWithStateInPandas(_Host(make_get, delay, timeout, quantum), outputStructType=FETCHED, outputMode="Update", timeMode="ProcessingTime")
    rows = found.select(cache_key(F.col("url")).alias("key"), "*")
    return rows.writeStream.outputMode("update").foreachBatch(merge_batch(cache)).option("checkpointLocation", checkpoint).trigger(processingTime=trigger).start()


def polite_session(spark: SparkSession) -> SparkSession:
    """A session of its own whose state lies in RocksDB; the caller's settings stay as they are."""
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return session
