"""What Python workers are given at a time, and what they and the driver keep."""

import os
import re
import uuid
from pathlib import Path

import numpy as np
import pyarrow as pa

from inkstone.llm import prefixes, simhash, spaced
from inkstone.llm.components import components
from inkstone.llm.batch import frugal
from inkstone.llm.scratch import NARROW


def own_mb() -> float:
    return int(re.search(r"Anonymous:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text())[1]) / 1024


def noted(run, at: str):
    """run, noting the bytes of each batch that it is given."""

    def seen(batches):
        def each():
            for batch in batches:
                Path(at, uuid.uuid4().hex).write_text(str(batch.nbytes))
                yield batch

        yield from run(each())

    return seen


def test_near_duplicates_are_sought_in_narrow_batches(spark, tmp_path, monkeypatch):
    """4000 texts of 4000 bytes in one partition, 16 MB: no function of texts is given them as one batch."""
    places = {x: tmp_path / x for x in ("prints", "described", "sets")}
    for at in places.values():
        at.mkdir()
    described, sets = prefixes._described, prefixes._sets
    monkeypatch.setattr(simhash, "_fingerprints", noted(simhash._fingerprints, str(places["prints"])))
    monkeypatch.setattr(prefixes, "_described", lambda tally: noted(described(tally), str(places["described"])))
    monkeypatch.setattr(prefixes, "_sets", lambda asked: noted(sets(asked), str(places["sets"])))
    rng = np.random.default_rng(1)
    words = np.array([f"w{k:06d}" for k in range(100_000)])
    rows = [(i, " ".join(rng.choice(words, 500))) for i in range(4000)]
    rows += [(10_000 + i, rows[i][1] + " tail") for i in range(50)]
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), simhash.alike)
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(4000))
    for at in places.values():
        given = [int(x.read_text()) for x in at.iterdir()]
        assert given and max(given) < 1.5 * NARROW
    assert spark.conf.get(key, None) == before


def test_memory_goes_back_at_the_end_of_a_task():
    """150 MB of freed pieces below one that is still in use."""
    in_use = []

    @frugal
    def run(batches):
        for batch in batches:
            pieces = [np.ones(3000, np.uint8) for _ in range(50_000)]
            in_use.append(pieces[-1])
            del pieces
            yield batch

    start = own_mb()
    assert len(list(run(iter([pa.record_batch({"a": [1]})])))) == 1
    assert own_mb() < start + 50
    for function in (prefixes._tallies, simhash._fingerprints):
        assert function.__wrapped__  # the operators' own functions are such


def executions(spark) -> int:
    """The number of the last query that Spark has run."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return spark._jsparkSession.sharedState().statusStore().executionsList().last().executionId()


def test_near_duplicates_leave_the_driver_little(spark, monkeypatch):
    """The driver plans few queries (each leaves it garbage, threads and plans), none of which only count what was just written, and no broadcast stays with it."""
    rng = np.random.default_rng(2)
    words = np.array([f"w{k:04d}" for k in range(3000)])
    texts = []
    for k in range(40):
        text = rng.choice(words, 200)
        texts.append(" ".join(text))
        for changed in (1, 3, 5):
            text[rng.choice(200, changed, replace=False)] = f"x{k}"
            texts.append(" ".join(text))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shared, real = [], spark.sparkContext.broadcast
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda value: shared.append(real(value)) or shared[-1])
    spark.range(1).collect()
    before = executions(spark)
    kept = simhash.deduplicated(docs, simhash.alike).collect()
    assert 40 <= len(kept) < len(texts)
    assert executions(spark) - before <= 75
    assert len(shared) > 2 and not [b for b in shared if os.path.exists(b._path)]


def test_a_round_of_components_is_one_query(spark):
    """A star of 200 links: the links, their first labels and one round that moves some, one that moves none; no query only counts."""
    links = spark.range(1, 201).selectExpr("id as a", "500L as b").union(spark.range(1).selectExpr("0L as a", "1L as b"))
    links.count()
    before = executions(spark)
    roots = components(links)
    assert executions(spark) - before <= 6
    assert {(r.id, r.root) for r in roots.collect()} == {(i, 0) for i in [*range(201), 500]}


def test_components_without_links(spark):
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_items_are_sought_in_narrow_batches(spark, tmp_path, monkeypatch):
    """4000 texts of 4000 bytes in one partition, 16 MB, 40 of which hold an item."""
    hits = spaced._hits
    monkeypatch.setattr(spaced, "_hits", lambda *a: noted(hits(*a), str(tmp_path)))
    rng = np.random.default_rng(3)
    words = np.array([f"w{k:06d}" for k in range(100_000)])
    texts = [" ".join(rng.choice(words, 500)) for _ in range(4000)]
    item = texts[7].split()[100:130]
    for i in range(0, 4000, 100):
        texts[i] += " " + " ".join(item)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    clean = spaced.decontaminated(docs, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.select("doc_id").collect()) == [i for i in range(4000) if i % 100 and i != 7]
    given = [int(x.read_text()) for x in tmp_path.iterdir()]
    assert given and max(given) < 1.5 * NARROW
