"""Tables published in versions: a version is there as a whole or not at all, and readers never see half of one.

    {path}/data/{name}/       the rows of a version, in Parquet or JSON lines
    {path}/versions/{n}.json  its manifest: format, name, schema, statistics

Rows are written first, under a name that nobody knows. Then their manifest is put in place by a rename, which fails if another publisher has
taken that number; so publishers don't overwrite each other either. Readers go by the last manifest. The last few versions are kept.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as K

from ..errors import StoreError

#: Hours after which rows that belong to no version are taken to be left by a run that ended midway.
ABANDONED = 24.0


@dataclass(frozen=True)
class Version:
    """A published version of a table."""

    number: int
    name: str
    format: str
    schema: str
    published_at: float
    statistics: dict[str, object]


class Versions:
    """The versions of the table at a path, on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        self._store = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[tuple[str, float]]:
        """Names in a folder, and when they were last changed (in seconds)."""
        at = self._paths(f"{self.path}/{folder}")
        found = self._store.listStatus(at) if self._store.exists(at) else []
        return [(x.getPath().getName(), x.getModificationTime() / 1000) for x in found]

    def _put(self, text: str, to: str) -> bool:
        """Write a small file in one step; False if it is there already."""
        target, part = self._paths(f"{self.path}/{to}"), self._paths(f"{self.path}/versions/_{uuid.uuid4().hex}")
        if self._store.exists(target):
            return False
        out = self._store.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        try:
            done = self._store.rename(part, target)
        except Exception:  # file systems that say so instead of returning false
            done = False
        if not done:
            self._store.delete(part, False)
        return bool(done)

    def all(self) -> list[Version]:
        """The versions that are kept, from the first to the last."""
        numbers = sorted(int(name[:-5]) for name, _ in self._names("versions") if name.endswith(".json") and name[:-5].isdigit())
        return [self.version(n) for n in numbers]

    def version(self, number: int) -> Version:
        at = self._paths(f"{self.path}/versions/{number:010d}.json")
        try:
            data = self._store.open(at)
            raw = bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(data))
            data.close()
        except Exception as e:
            raise StoreError(f"{self.path} has no version {number}", "publish", e) from e
        return Version(**json.loads(raw))

    def last(self) -> Version | None:
        numbers = [int(name[:-5]) for name, _ in self._names("versions") if name.endswith(".json") and name[:-5].isdigit()]
        return self.version(max(numbers)) if numbers else None

    def read(self, number: int | None = None) -> DataFrame:
        """The rows of the last version, or of another one that is kept."""
        found = self.last() if number is None else self.version(number)
        if found is None:
            raise StoreError(f"nothing was published at {self.path}", "publish")
        schema = K.StructType.fromJson(json.loads(found.schema))
        return self.spark.read.schema(schema).format(found.format).load(f"{self.path}/data/{found.name}")

    def publish(self, rows: DataFrame, keep: int = 3, format: str = "parquet", statistics: dict[str, Column] | None = None, partition_by: list[str] | None = None) -> Version:
        """Publish rows as the next version, with statistics (aggregates of the rows as written); of all versions the last keep stay.

        If writing fails, or the driver ends before the manifest is in place, the versions before are what readers see, and the rows written so far go
        with a later clean(). Publishers at the same time get numbers one after the other.
        """
        name = uuid.uuid4().hex
        at = f"{self.path}/data/{name}"
        rows.write.format(format).partitionBy(*partition_by or []).save(at)
        schema = json.dumps(rows.schema.jsonValue())
        written = self.spark.read.schema(rows.schema).format(format).load(at)
        counted = written.agg(F.count("*").alias("rows"), *(c.alias(k) for k, c in (statistics or {}).items())).first().asDict()
        number = (found.number if (found := self.last()) else 0) + 1
        while True:
            version = Version(number, name, format, schema, time.time(), counted)
            if self._put(json.dumps(asdict(version), default=str), f"versions/{number:010d}.json"):
                break
            number += 1
        self.forget(keep)
        return version

    def forget(self, keep: int) -> None:
        """Leave the last keep versions (one at least); rows go after their manifest, so no manifest is without rows."""
        for old in self.all()[: -max(1, keep)]:
            self._store.delete(self._paths(f"{self.path}/versions/{old.number:010d}.json"), False)
            self._store.delete(self._paths(f"{self.path}/data/{old.name}"), True)

    def clean(self, hours: float = ABANDONED, clock: Callable[[], float] = time.time) -> int:
        """Remove rows that belong to no version and were left so many hours ago; how many such tables there were."""
        listed, used = self._names("data"), {v.name for v in self.all()}  # names first: a version may be published meanwhile
        gone = [name for name, at in listed if name not in used and clock() - at >= hours * 3600]
        for name in gone:
            self._store.delete(self._paths(f"{self.path}/data/{name}"), True)
        return len(gone)


def chunk_statistics() -> dict[str, Column]:
    """What is told of published chunks: documents, the sections in them (a section cut into several chunks counts in each) and characters, and the shortest, mean and longest chunk."""
    size = F.col("char_count")
    return {"documents": F.count_distinct("doc_id"), "sections": F.sum(F.size("source_section_indexes")), "chars": F.sum(size), "least": F.min(size), "mean": F.round(F.avg(size), 1), "most": F.max(size)}
