"""The crawl cache as a table of deltas: one row a page, the newest good attempt or else the newest.

Every micro-batch is written as a delta, in proportion to itself: its attempts with their bodies as they come, and beside
them a narrow table of what they are chosen by and where they lie. A numbered manifest names the deltas that count;
it appears whole or not at all, so readers see a batch or they don't, and a batch that is replayed after it was committed
does nothing. FANOUT deltas of a level are merged into one of the next, so that a row is rewritten once a level and the
number of deltas stays logarithmic. Folders that no manifest of the last two names are removed.

Readers choose on the narrow tables alone. Bodies are not shuffled: rows that others have overtaken are left out by an
anti-join with their places, which are broadcast while they are few.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.crawl import ATTEMPT, is_good

FANOUT = 4
#: Places of overtaken rows that may be broadcast.
BROADCAST = 100_000
PLACE = ["delta", "file", "at"]
NARROW = "key string, good boolean, fetched_at string, file string, at long"


class CrawlCache:
    def __init__(self, spark: SparkSession, root: str, schema: str = ATTEMPT, fanout: int = FANOUT):
        self.spark, self.root, self.schema, self.fanout = spark, root.rstrip("/"), schema, fanout
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        path = self._hadoop.Path(self.root)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.root}/{name}")

    # The manifest

    def _numbers(self) -> list[int]:
        folder = self._path("manifest")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, number: int | None = None) -> dict:
        numbers = self._numbers()
        if number is None and not numbers:
            return {"number": -1, "batch": -1, "deltas": []}
        number = numbers[-1] if number is None else number
        text = self.spark.read.text(str(self._path(f"manifest/{number}.json")), wholetext=True).first()[0]
        return json.loads(text)

    def _publish(self, manifest: dict) -> None:
        """Written aside, and put in place by a rename, which fails where another writer was first."""
        tmp, place = self._path(f"manifest/.{manifest['number']}.tmp"), self._path(f"manifest/{manifest['number']}.json")
        out = self.fs.create(tmp, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.fs.exists(place) or not self.fs.rename(tmp, place):
            raise RuntimeError(f"another writer has published {place}")

    @property
    def last_batch(self) -> int:
        return self._manifest()["batch"]

    # Deltas

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/attempts")
        written = self.spark.read.schema(self.schema).parquet(f"{self.root}/{name}/attempts")
        narrow = written.select("key", is_good().alias("good"), "fetched_at", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
        narrow.write.mode("overwrite").parquet(f"{self.root}/{name}/narrow")

    def _union(self, deltas: list[dict], what: str, schema: str, *more: str) -> DataFrame:
        frames = [self.spark.read.schema(schema).parquet(f"{self.root}/{d['name']}/{what}").select("*", F.lit(k).alias("delta"), *map(F.expr, more)) for k, d in enumerate(deltas)]
        return reduce(DataFrame.unionByName, frames)  # as many as a few levels hold

    def _read(self, deltas: list[dict]) -> DataFrame:
        """One attempt a key, of a later delta among equals."""
        if not deltas:
            return self.spark.createDataFrame([], self.schema)
        narrow = self._union(deltas, "narrow", NARROW)
        rows = self._union(deltas, "attempts", self.schema, "_metadata.file_name AS file", "_metadata.row_index AS at")
        best = narrow.groupBy("key").agg(F.max(F.struct("good", "fetched_at", *PLACE)).alias("best"), F.count("*").alias("n")).where("n > 1")
        overtaken = narrow.join(best, "key").where(F.struct(*PLACE) != F.struct(*[F.col(f"best.{c}").alias(c) for c in PLACE])).select(*PLACE)
        if overtaken.count() <= BROADCAST:
            overtaken = F.broadcast(overtaken)
        return rows.join(overtaken, PLACE, "left_anti").drop(*PLACE)

    def add(self, batch: DataFrame, batch_id: int) -> bool:
        """Commits a batch of attempts; False if it was committed before."""
        now = self._manifest()
        if batch_id <= now["batch"]:
            return False
        name = f"d{batch_id}-0"
        self._write(batch, name)
        deltas = [*now["deltas"], {"name": name, "level": 0}]
        while len(level := [d for d in deltas if d["level"] == deltas[-1]["level"]]) >= self.fanout:
            up = level[0]["level"] + 1
            self._write(self._read(level), f"d{batch_id}-{up}")
            deltas = [*[d for d in deltas if d not in level], {"name": f"d{batch_id}-{up}", "level": up}]
        self._publish({"number": now["number"] + 1, "batch": batch_id, "deltas": deltas})
        self._sweep()
        return True

    def _sweep(self) -> None:
        """Readers may still hold the manifest before the last."""
        numbers = self._numbers()
        kept = {d["name"] for n in numbers[-2:] for d in self._manifest(n)["deltas"]}
        for s in self.fs.listStatus(self._path("")):
            name = s.getPath().getName()
            if name.startswith("d") and name not in kept:
                self.fs.delete(s.getPath(), True)
        for n in numbers[:-2]:
            self.fs.delete(self._path(f"manifest/{n}.json"), False)

    def read(self) -> DataFrame:
        return self._read(self._manifest()["deltas"])

    def good_keys(self) -> DataFrame:
        """Keys with a good attempt, from the narrow tables: no body is read."""
        deltas = self._manifest()["deltas"]
        if not deltas:
            return self.spark.createDataFrame([], "key string")
        paths = [f"{self.root}/{d['name']}/narrow" for d in deltas]
        return self.spark.read.schema(NARROW).parquet(*paths).where("good").select("key").distinct()


def merge_batch(cache: CrawlCache) -> Callable[[DataFrame, int], None]:
    def run(batch: DataFrame, batch_id: int) -> None:
        cache.add(batch, batch_id)

    return run


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    return CrawlCache(spark, root).read()


def keep_merged(spark: SparkSession, attempts_dir: str, root: str, checkpoint: str, files_a_batch: int = 100) -> StreamingQuery:
    """Merges all attempts that are there, batch by batch, and ends."""
    stream = spark.readStream.schema(ATTEMPT).option("maxFilesPerTrigger", files_a_batch).parquet(attempts_dir)
    return stream.writeStream.foreachBatch(merge_batch(CrawlCache(spark, root))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
