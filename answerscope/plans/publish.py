"""Results of a job, published whole, and stages that a restart finds done.

A stage's rows lie in a folder that is named by its content: its name, its settings and the digests of what it is made
from, down to the files of the inputs. A stage that is there is read; another is built into a folder aside and put in
place by one rename, so that half a stage is never seen, and a run that was killed goes on at the stage where it was.

Publishing writes a numbered manifest of table names and folders, by one rename as well: readers see all tables of one
run, or those of the run before.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from .contracts import Watched, observing


#: Part of every digest: stages of another form of the store are none of this one.
FORM = 2
#: A stage's observations, in a file that readers of its folder pass over.
OBSERVED = "_observed.json"


class Staged(NamedTuple):
    """A stage's rows, the digest of what they are made from, where they lie, and what their write has observed."""

    df: DataFrame
    digest: str
    path: str
    observed: dict[str, int] = {}


class StageStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._Path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self._Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self.built: list[str] = []

    def _path(self, name: str):
        return self._Path(f"{self.root}/{name}")

    def source(self, path: str, schema: str | None = None, format: str = "parquet", **options) -> Staged:
        """An input: its digest is that of its files' names, sizes and times."""
        place = self._Path(path)
        fs = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found, todo = [], [fs.getFileStatus(place)]
        while todo:
            s = todo.pop()
            if s.isDirectory():
                todo += list(fs.listStatus(s.getPath()))
            else:
                found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
        reader = self.spark.read.format(format).options(**options)
        df = (reader.schema(schema) if schema else reader).load(path)
        return Staged(df, hashlib.sha256(json.dumps([sorted(found), schema, format, sorted(options.items())]).encode()).hexdigest(), path)

    def stage(self, name: str, inputs: list[Staged], build: Callable[..., DataFrame | Watched], settings: str = "") -> Staged:
        """build(*frames of inputs), or what an earlier run has made of the same inputs and settings; what the write observes
        (rows, breaks of contracts) lies beside the rows."""
        digest = hashlib.sha256(json.dumps([FORM, name, settings, [i.digest for i in inputs]]).encode()).hexdigest()
        place = f"stages/{name}-{digest[:24]}"
        if not self.fs.exists(self._path(f"{place}/_SUCCESS")):
            aside = f"aside/{name}-{uuid.uuid4().hex}"
            df, seen = observing(build(*[i.df for i in inputs]))
            df.write.parquet(f"{self.root}/{aside}")
            self._write(self._path(f"{aside}/{OBSERVED}"), dict(seen.get))
            self.fs.mkdirs(self._path("stages"))
            if not self.fs.rename(self._path(aside), self._path(place)) and not self.fs.exists(self._path(f"{place}/_SUCCESS")):
                raise RuntimeError(f"{place} could not be put in place")
            self.built.append(name)
        return Staged(self.spark.read.parquet(f"{self.root}/{place}"), digest, f"{self.root}/{place}", self._json(f"{place}/{OBSERVED}"))

    def _runs(self) -> list[int]:
        folder = self._path("published")
        if not self.fs.exists(folder):
            return []
        return sorted(int(n.removesuffix(".json")) for s in self.fs.listStatus(folder) if (n := s.getPath().getName()).endswith(".json"))

    def publish(self, tables: dict[str, Staged]) -> int:
        """All tables at once; the number of the publication. The same tables again are no new one."""
        runs = self._runs()
        said = {n: t.path for n, t in sorted(tables.items())}
        if runs and self._manifest(runs[-1]) == said:
            return runs[-1]
        number = runs[-1] + 1 if runs else 0
        aside, place = self._path(f"aside/{uuid.uuid4().hex}.json"), self._path(f"published/{number}.json")
        self.fs.mkdirs(self._path("published"))
        self._write(aside, said)
        if self.fs.exists(place) or not self.fs.rename(aside, place):
            raise RuntimeError(f"another run has published {place}")
        return number

    def _write(self, path, said: dict) -> None:
        out = self.fs.create(path, True)
        out.write(bytearray(json.dumps(said).encode()))
        out.close()

    def _json(self, name: str) -> dict:
        """A small file of the store, read by the driver without a job."""
        file = self.fs.open(self._path(name))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
        finally:
            file.close()

    def _manifest(self, number: int) -> dict[str, str]:
        return self._json(f"published/{number}.json")

    def read(self, number: int | None = None) -> dict[str, DataFrame]:
        """The tables of the last publication, or of a given one."""
        runs = self._runs()
        if not runs:
            return {}
        return {n: self.spark.read.parquet(p) for n, p in self._manifest(runs[-1] if number is None else number).items()}

    def sweep(self, keep: int = 2) -> int:
        """Removes stages that none of the last publications has, and what was left aside; call it while no run is under way."""
        kept = {p.rsplit("/", 1)[-1] for n in self._runs()[-keep:] for p in self._manifest(n).values()}
        gone = 0
        for folder in ("stages", "aside"):
            if self.fs.exists(self._path(folder)):
                for s in self.fs.listStatus(self._path(folder)):
                    if s.getPath().getName() not in kept:
                        gone += self.fs.delete(s.getPath(), True)
        return gone
