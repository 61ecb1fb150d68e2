"""What services answered, kept by the content of the request: nothing that has an answer is asked again.

A ledger is a folder that driver and workers share, given by path or URI. A task writes each answer as a file of its own, named
by the request's digest, before it goes on; so a task that is repeated, another run, and another job find it. settle() appends
such files to a Parquet table. Nothing is ever changed: two tasks that ask at the same time leave the same digest, which counts once.

Requests that may only be made so often go to tasks of one barrier stage, which share one schedule.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from heapq import merge
from itertools import count

import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark import BarrierTaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ImportFailure
from ..functions.names import unused

#: A request's row as it was given -> the answer; an ImportFailure if there is none.
Call = Callable[[dict], str]


def digest_of(*parts: Column) -> Column:
    """A digest of a request: of its parts with their lengths, so that no two requests have one."""
    coded = [F.coalesce(F.concat(F.length(x).cast("string").cast("binary"), F.lit(":").cast("binary"), x), F.lit("-").cast("binary")) for x in (p.cast("binary") for p in parts)]
    return F.sha2(F.concat(*coded), 256)


class Ledger:
    """Answers by digest, in a folder."""

    def __init__(self, path: str):
        self.path = path.rstrip("/")

    def _at(self) -> tuple[FileSystem, str]:
        return FileSystem.from_uri(self.path)

    def _file(self, digest: str) -> tuple[FileSystem, str]:
        store, path = self._at()
        return store, f"{path}/fresh/{digest[:2]}/{digest}.json"

    def get(self, digest: str) -> str | None:
        """The answer to a request, if a task has just written it."""
        store, path = self._file(digest)
        if store.get_file_info(path).type != FileType.File:
            return None
        with store.open_input_stream(path) as data:
            return json.loads(data.read())["answer"]

    def put(self, digest: str, answer: str) -> None:
        """Keep an answer; it is there as a whole or not at all."""
        store, path = self._file(digest)
        store.create_dir(path.rsplit("/", 1)[0])
        part = f"{path}.{uuid.uuid4().hex}"
        with store.open_output_stream(part) as out:
            out.write(json.dumps({"digest": digest, "answer": answer}).encode())
        store.move(part, path)

    def _folders(self, *beginnings: str) -> list[str]:
        store, path = self._at()
        found = store.get_file_info(FileSelector(path, allow_not_found=True))
        return [x.base_name for x in found if x.type == FileType.Directory and x.base_name.startswith(beginnings)]

    def known(self, spark: SparkSession) -> DataFrame:
        """digest, answer of all requests that were answered, each once."""
        out = spark.createDataFrame([], "digest string, answer string")
        for name in self._folders("table", "fresh"):
            reader = spark.read.schema("digest string, answer string")
            at = f"{self.path}/{name}"
            out = out.union(reader.parquet(at) if name == "table" else reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(at))
        return out.dropDuplicates(["digest"])

    def settle(self, spark: SparkSession) -> None:
        """Append the answers in files to the table. The files are set aside first, and go when the table has them; none is lost if this ends midway."""
        store, path = self._at()
        if store.get_file_info(f"{path}/fresh").type == FileType.Directory:
            store.move(f"{path}/fresh", f"{path}/fresh-{uuid.uuid4().hex}")
        for name in self._folders("fresh-"):
            answers = spark.read.schema("digest string, answer string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(f"{self.path}/{name}")
            answers.dropDuplicates(["digest"]).write.mode("append").parquet(f"{self.path}/table")
            store.delete_dir(f"{path}/{name}")


class Slots:
    """Times at which the tasks of one schedule may call: n calls in any window of seconds, over all tasks together.

    Slots follow each other evenly and belong to one task each. The first are dealt by how many requests each task has, spread over the
    time that all take, so a task with few requests leaves the others the rest. Who comes too late for a slot loses it and takes the
    next of its own; those after the last request go round. counts: the requests of each task; mine: this task's number.
    """

    def __init__(self, n: int, counts: list[int], mine: int, seconds: float = 60.0, clock: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep, start: float | None = None):
        self.late = seconds / n / 4  # a call may begin so long after its slot
        self.gap = (seconds + self.late) / n
        self.clock, self.sleep, self.start = clock, sleep, clock() if start is None else start
        self.numbers = self._numbers(counts, mine)

    @staticmethod
    def _spread(task: int, n: int) -> Iterator[tuple[float, int]]:
        return (((k + 0.5) / n, task) for k in range(n))

    @classmethod
    def _numbers(cls, counts: list[int], mine: int) -> Iterator[int]:
        dealt = merge(*(cls._spread(task, n) for task, n in enumerate(counts)))
        yield from (number for number, (_, task) in enumerate(dealt) if task == mine)
        yield from count(sum(counts) + mine, len(counts))

    def wait(self) -> None:
        """Return when this task may call."""
        for number in self.numbers:
            at = self.start + number * self.gap
            while (ahead := at - self.clock()) > 0:
                self.sleep(ahead)
            if self.clock() - at <= self.late:
                return


def scheduled(requests: DataFrame, work: Callable[[Iterator[pa.RecordBatch], Callable[[], None]], Iterator[pa.RecordBatch]], schema: str, per_minute: int, workers: int, seconds: float = 60.0) -> DataFrame:
    """work over requests in tasks that may call per_minute times in any window of seconds together; work calls its second argument before each call.

    The tasks begin together (a barrier stage: the cluster must have workers free slots), and if one fails all are repeated.
    """
    workers = max(1, min(workers, per_minute))
    part = unused("part", requests)
    dealt = requests.withColumn(part, F.pmod(F.xxhash64(*[c for c, kind in requests.dtypes if not kind.startswith("map")]), F.lit(workers)).cast("int"))
    found = {r[0]: r[1] for r in dealt.groupBy(part).count().collect()}  # a number for each worker
    counts = [found.get(k, 0) for k in range(workers)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = BarrierTaskContext.get()
        start = max(map(float, task.allGather(repr(time.time()))))  # clocks of machines agree to milliseconds, and so do the tasks
        yield from work(batches, Slots(per_minute, counts, task.partitionId(), seconds, start=start).wait)

    return dealt.repartitionById(workers, part).drop(part).mapInArrow(run, schema, barrier=True)


_OUTCOME = "digest string, error_class string, error_message string"


def asked_once(requests: DataFrame, digest: Column, ledger: Ledger, factory: Callable[[], Call], per_minute: int | None = None, workers: int = 1, seconds: float = 60.0) -> DataFrame:
    """requests with answer, error_class and error_message; what the ledger has is not asked, and equal requests are asked once.

    factory makes the call in the worker. An ImportFailure leaves the request without an answer in this run; the next run asks it again. Any other
    error fails the task, and what it was answered before stays answered. With per_minute the calls of all workers keep to one schedule.
    """
    spark, key = requests.sparkSession, unused("digest", requests)
    keyed = requests.withColumn(key, digest)
    open_ = keyed.join(ledger.known(spark).select(F.col("digest").alias(key)), key, "left_anti").dropDuplicates([key])

    def work(batches: Iterator[pa.RecordBatch], wait: Callable[[], None] = lambda: None) -> Iterator[pa.RecordBatch]:
        call = None
        for batch in batches:
            failed = []
            for row in batch.to_pylist():
                own = row.pop(key)
                if ledger.get(own) is not None:
                    continue
                wait()
                try:
                    call = call or factory()
                    ledger.put(own, call(row))
                except ImportFailure as e:
                    failed.append((own, type(e).__name__, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in failed], pa.string()) for k in range(3)], [x.split()[0] for x in _OUTCOME.split(", ")])

    outcome = scheduled(open_, work, _OUTCOME, per_minute, workers, seconds) if per_minute else open_.mapInArrow(work, _OUTCOME)
    at = f"{ledger.path}/failed/{uuid.uuid4().hex}"
    outcome.write.parquet(at)
    answers = ledger.known(spark).select(F.col("digest").alias(key), "answer")
    failures = spark.read.schema(_OUTCOME).parquet(at).withColumnRenamed("digest", key)
    return keyed.join(answers, key, "left").join(failures, key, "left").drop(key)
