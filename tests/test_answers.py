"""Services that are asked once, and calls that keep to one schedule."""

import os
import time
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from inkstone.errors import ModelError, PdfError, StoreError
from inkstone.sources import connectors as X
from inkstone.sources.answers import Ledger, Slots, asked_once, digest_of


def counting(folder, name, text):
    """A call that leaves a line in a file for each time it is made."""
    with open(f"{folder}/{name}", "a") as out:
        out.write(text + "\n")


def calls(folder, name="calls"):
    path = folder / name
    return Counter(path.read_text().split("\n")[:-1]) if path.exists() else Counter()


def test_one_call_for_each_digest_over_runs_and_a_failed_task(spark, tmp_path):
    folder, ledger = str(tmp_path), Ledger(str(tmp_path / "ledger"))
    rows = [(i, f"q{i % 7}", "other") for i in range(40)] + [(99, "bad", "x"), (100, None, "x")]
    requests = spark.createDataFrame(rows, "doc_id long, question string, digest string").repartition(3)

    def factory():
        def call(row):
            counting(folder, "calls", str(row["question"]))
            if row["question"] == "q5" and not os.path.exists(f"{folder}/was killed"):
                open(f"{folder}/was killed", "w").close()
                raise RuntimeError("the worker dies")
            if row["question"] == "bad":
                raise ModelError("refused", "images")
            return f"answer to {row['question']}"

        return call

    ask = lambda: asked_once(requests, digest_of(F.col("question")), ledger, factory)
    with pytest.raises(PySparkException):  # the only attempt of that task fails
        ask()
    first = {(r.doc_id, r.answer, r.error_class) for r in ask().collect()}
    assert first == {(i, None if q == "bad" else f"answer to {q}", "ModelError" if q == "bad" else None) for i, q, _ in rows}
    assert "digest" in ask().columns and ask().count() == len(rows)
    ledger.settle(spark)
    ledger.settle(spark)
    assert {(r.doc_id, r.answer, r.error_class) for r in ask().collect()} == first
    made = calls(tmp_path)
    assert all(n == 1 for q, n in made.items() if q not in ("bad", "q5")) and made["q5"] == 2 and set(made) == {*(f"q{i}" for i in range(7)), "bad", "None"}
    assert not (tmp_path / "ledger/fresh").exists() and ledger.known(spark).count() == 8


def test_a_settlement_that_ends_midway_loses_nothing(spark, tmp_path):
    ledger = Ledger(str(tmp_path))
    assert ledger.known(spark).count() == 0 and ledger.get("ab" * 32) is None
    ledger.put("ab" * 32, "é\n")
    assert ledger.get("ab" * 32) == "é\n"
    os.rename(tmp_path / "fresh", tmp_path / "fresh-1")  # set aside, then stopped
    ledger.put("cd" * 32, "two")
    (tmp_path / "fresh/cd/half.json.0").write_text("{")  # a file that was being written
    assert {r.answer for r in ledger.known(spark).collect()} == {"é\n", "two"}
    ledger.settle(spark)
    assert {r.answer for r in ledger.known(spark).collect()} == {"é\n", "two"} and sorted(x.name for x in tmp_path.iterdir()) == ["table"]


def test_connectors_with_a_ledger(spark, tmp_path):
    folder, ledger = str(tmp_path), Ledger("file://" + str(tmp_path / "ledger"))

    def converter():
        def convert(path, content):
            counting(folder, "pdf", path)
            if not content:
                raise PdfError(f"{path}: empty", "pdf")
            return "# " + content.decode()

        return convert

    files = spark.createDataFrame([(1, "a.pdf", bytearray(b"x")), (2, "b.pdf", bytearray(b"x")), (3, "c.pdf", bytearray(b"")), (None, "d.pdf", None)], "doc_id long, pdf_path string, content binary")
    for _ in range(2):
        got = {(r.doc_id, r.md_content, r.error_class) for r in X.convert_pdfs(files, converter, ledger).collect()}
        assert got == {(1, "# x", None), (2, "# x", None), (3, None, "PdfError"), (None, None, "PdfError")}
    assert sum(calls(tmp_path, "pdf")[x] for x in ("a.pdf", "b.pdf")) == 1

    def describer():
        def ask(prompt, url):
            counting(folder, "seen", prompt)
            return f"seen {prompt}"

        return ask

    images = spark.createDataFrame([("p", "u"), ("p", "u"), ("q", "u"), ("r", None)], "prompt string, data_url string")
    for _ in range(2):
        assert sorted((r.prompt, r.summary) for r in X.describe_images(images, describer, 1000, 2, ledger).collect()) == [("p", "seen p"), ("p", "seen p"), ("q", "seen q"), ("r", None)]
    assert calls(tmp_path, "seen") == {"p": 1, "q": 1}

    def store():
        def put(key, path, kind):
            counting(folder, "stored", key)
            if key == "k2":
                raise StoreError("down")

        return put

    files = spark.createDataFrame([("/a", "k1", "t", "http://s/k1", "v1"), ("/b", "k2", "t", "http://s/k2", "v1")], "path string, object_key string, content_type string, object_url string, changed string")
    for table in (files, files, files.withColumn("changed", F.lit("v2"))):
        assert {r.url for r in X.store_images(table, store, ledger, F.col("changed")).collect()} == {"http://s/k1", "/b"}
    assert calls(tmp_path, "stored") == {"k1": 2, "k2": 3}


@pytest.mark.parametrize("counts", [[40, 3, 0, 11], [1, 1, 1, 1], [60], [0, 0, 25, 0]])
def test_no_window_has_more_calls_than_allowed(counts):
    """Four tasks with uneven work, each with a clock of its own that started with the others, and calls that take their time."""
    n, seconds, began = 15, 60.0, []
    for mine, most in enumerate(counts):
        now = [0.0]
        slots = Slots(n, counts, mine, seconds, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))  # noqa: B023
        for k in range(most):
            slots.wait()
            began.append(now[0])
            now[0] += (k * 7 + mine * 3) % 11 + (120 if k % 13 == 5 else 0)  # some take longer than the task's next slots
    began.sort()
    assert all(b - a >= seconds for a, b in zip(began, began[n:], strict=False)) and len(began) == sum(counts)


def test_the_whole_rate_is_used():
    """Calls that take no time end when the last slot comes: those who have nothing to do take none."""
    counts, last = [50, 2, 0, 8], 0.0
    for mine, most in enumerate(counts):
        now = [0.0]
        slots = Slots(15, counts, mine, 60.0, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))  # noqa: B023
        for _ in range(most):
            slots.wait()
        last = max(last, now[0])
    assert last <= 59 * 60 / 15 * 1.02


def test_tasks_keep_to_one_schedule(spark, tmp_path):
    folder = str(tmp_path)

    def describer():
        def ask(prompt, url):
            counting(folder, "times", repr(time.time()))
            return prompt

        return ask

    images = spark.createDataFrame([(f"p{i}", "u") for i in range(24)], "prompt string, data_url string")
    assert X.describe_images(images, describer, 10, 4, seconds=1.0).filter("summary = prompt").count() == 24
    times = sorted(float(x) for x in calls(tmp_path, "times"))
    assert len(times) == 24 and all(b - a >= 0.97 for a, b in zip(times, times[10:], strict=False))
    none = images.filter("prompt is null")
    assert X.describe_images(none, describer, 10, 4).count() == 0
