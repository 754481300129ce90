"""Tables that grow by versions: what a version holds of a unit (a video, a key) replaces all that earlier ones held of it.

A version is a folder of rows and one of its units, and counts only when its marker is there, which is written last. So a run that is
killed leaves nothing behind that is read, a run that is done again replaces itself, and readers meanwhile see what they saw before.
One writer at a time; readers may be many."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .staging import put_bytes

#: Live versions at which an append compacts.
MOST = 16


class Versions:
    """unit: DDL of the columns that name a unit. order: columns by whose ranges rows are written, so that a search for units reads few row groups.
    stats: aggregates that are noted for each unit when it is committed."""

    def __init__(self, spark: SparkSession, path: str, unit: str, order: list[str] | None = None, stats: dict[str, Column] | None = None):
        self.spark, self.path = spark, path
        self.kinds = StructType.fromDDL(unit)
        self.unit = self.kinds.names
        self.order, self.stats = order or self.unit, {"rows": F.count("*")} | (stats or {})

    def _folder(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _markers(self) -> dict[str, list[str]]:
        """Versions with a marker, oldest first, and what each replaces."""
        fs, folder = self._folder("live")
        if not fs.exists(folder):
            return {}
        text = lambda s: self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(fs.open(s.getPath()), "UTF-8")
        found = {s.getPath().getName(): text(s) for s in fs.listStatus(folder) if s.getPath().getName().endswith(".json")}
        return {name.removesuffix(".json"): json.loads(found[name])["replaces"] for name in sorted(found)}

    def live(self) -> list[str]:
        """Versions that count, oldest first: a few names."""
        markers = self._markers()
        gone = {old for replaced in markers.values() for old in replaced}
        return [v for v in markers if v not in gone]

    def append(self, rows: DataFrame, replaces: list[str] | None = None, commit: bool = True) -> str:
        """Write rows as a version. Without `commit` it stays unread, as if the run had been killed before its end."""
        version = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
        rows.repartitionByRange(*self.order).sortWithinPartitions(*self.order).write.parquet(f"{self.path}/data/{version}")
        held = self.spark.read.schema(rows.schema).parquet(f"{self.path}/data/{version}")
        held.groupBy(*self.unit).agg(*[c.alias(name) for name, c in self.stats.items()]).write.parquet(f"{self.path}/units/{version}")
        if commit:
            put_bytes(self.spark, f"{self.path}/live/{version}.json", json.dumps({"replaces": replaces or []}).encode())
            if not replaces and len(self.live()) > MOST:
                self.compact()
        return version

    def _units(self, version: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/units/{version}")

    def _latest(self, live: list[str], read) -> DataFrame:
        """read(version) of each, without the units that a later version has. The later ones are the small ones: a base, then what came since."""
        parts = []
        for i, version in enumerate(live):
            part = read(version)
            if live[i + 1 :]:
                later = reduce(DataFrame.unionByName, [self._units(v).select(*self.unit) for v in live[i + 1 :]]).distinct()
                same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in self.unit]
                part = part.join(later.select(*[F.col(c).alias(f"_{c}") for c in self.unit]), reduce(lambda a, b: a & b, same), "left_anti")
            parts.append(part)
        return reduce(DataFrame.unionByName, parts)

    def units(self) -> DataFrame:
        """The units held, with their stats, read from what was noted of them; empty if nothing is committed."""
        live = self.live()
        return self._latest(live, self._units) if live else self.spark.createDataFrame([], StructType([*self.kinds.fields, *self.spark.range(0).agg(F.count("*").alias("rows")).schema.fields]))

    def read(self) -> DataFrame:
        live = self.live()
        if not live:
            raise ValueError(f"nothing is committed in {self.path}")
        return self._latest(live, lambda v: self.spark.read.parquet(f"{self.path}/data/{v}"))

    def compact(self) -> None:
        """One version in place of all; the marker of the new one takes the old ones away, then their files go."""
        old = self.live()
        if len(old) < 2:
            return
        self.append(self.read(), replaces=old)
        for version in old:
            with contextlib.suppress(Exception):  # a reader may hold them yet; they do not count any more
                for name in (f"data/{version}", f"units/{version}"):
                    fs, folder = self._folder(name)
                    fs.delete(folder, True)
