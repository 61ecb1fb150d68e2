"""Tables in versions."""

import json
import time

import pytest
from pyspark.sql import functions as F

from inkstone.errors import StoreError
from inkstone.plans.documents import split
from inkstone.sources import files as S
from inkstone.sources.versions import Versions


def table(spark, n, part=4):
    return spark.range(0, n, 1, part).select("id", F.concat(F.lit("x"), F.col("id").cast("string")).alias("x"), F.array(F.col("id")).alias("xs"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_follow_each_other(spark, tmp_path):
    store = Versions(spark, str(tmp_path))
    assert store.last() is None and store.all() == []
    with pytest.raises(StoreError):
        store.read()
    for n in (5, 7, 0, 9):
        version = store.publish(table(spark, n), keep=3, statistics={"most": F.max("id")})
        assert version.statistics == {"rows": n, "most": n - 1 if n else None} and store.read().count() == n
    assert [v.number for v in store.all()] == [2, 3, 4] and len(list((tmp_path / "data").iterdir())) == 3
    assert rows(store.read(2)) == rows(table(spark, 7)) and store.read(3).count() == 0 and store.read().dtypes == table(spark, 1).dtypes
    with pytest.raises(StoreError):
        store.read(1)


def test_a_job_that_ends_midway_leaves_the_version_before(spark, tmp_path, monkeypatch):
    store = Versions(spark, f"file://{tmp_path}")
    store.publish(table(spark, 5))
    broken = table(spark, 100).withColumn("id", F.when(F.col("id") == 99, F.raise_error(F.lit("killed")).cast("long")).otherwise(F.col("id")))
    with pytest.raises(Exception, match="killed"):
        store.publish(broken)
    monkeypatch.setattr(Versions, "_put", lambda self, text, to: (_ for _ in ()).throw(KeyboardInterrupt))
    with pytest.raises(KeyboardInterrupt):  # the rows are written, the manifest isn't
        store.publish(table(spark, 50))
    monkeypatch.undo()
    assert rows(store.read()) == rows(table(spark, 5)) and [v.number for v in store.all()] == [1]
    assert store.clean() == 0 and store.clean(clock=lambda: time.time() + 90_000) == 2
    assert rows(store.read()) == rows(table(spark, 5)) and len(list((tmp_path / "data").iterdir())) == 1
    assert store.publish(table(spark, 6)).number == 2


def test_publishers_at_the_same_time_keep_both(spark, tmp_path, monkeypatch):
    one, two = Versions(spark, str(tmp_path)), Versions(spark, str(tmp_path))
    one.publish(table(spark, 1))
    stale = one.last()
    monkeypatch.setattr(two, "last", lambda: stale)  # what it saw before the other published
    one.publish(table(spark, 2))
    assert two.publish(table(spark, 3)).number == 3
    assert [v.statistics["rows"] for v in one.all()] == [1, 2, 3]
    assert not [p for p in (tmp_path / "versions").iterdir() if p.name.startswith("_")]


def test_chunks_in_versions(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# A\nx\n# B\ny", "a", "/d/a.md"), (2, "", "b", "/d/b.md")], "doc_id long, md_content string, file_title string, md_path string")
    chunks = split(docs)
    for _ in range(2):
        version = S.write_chunks(chunks, str(tmp_path / "c"))
        assert S.write_chunk_json(chunks, str(tmp_path / "j")).statistics == version.statistics
    assert version.number == 2 and version.statistics == {"rows": 2, "documents": 1, "sections": 2, "chars": 12, "least": 6, "mean": 6.0, "most": 6}
    assert rows(S.read_chunks(spark, str(tmp_path / "c"))) == rows(chunks) == rows(S.read_chunks(spark, str(tmp_path / "j"), 1))
    line = next(p for p in (tmp_path / "j/data").rglob("*.json") if p.stat().st_size).read_text().split("\n")[0]
    assert json.loads(line)["content"] in ("# A\n\nx", "# B\n\ny")


BAD = [b"\xff", b"a\x80", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf4\x90\x80\x80", b"\xe2\x82", b"\xf0\x9f\x98", b"x\xc3", b"\xf8\x88\x80\x80\x80"]
GOOD = [b"\n", b"a\r\nb\rc", "é 漢 😀 \u0000".encode(), b"\xef\xbb\xbfa", "￿\U0010ffff".encode()]


def test_only_utf8_is_read(spark, tmp_path):
    for i, raw in enumerate([*GOOD, *BAD]):
        (tmp_path / f"{i:02d}.md").write_bytes(raw)
    got = {r.md_path.rsplit("/", 1)[1]: (r.md_content, r.error_class) for r in S.read_markdown(spark, str(tmp_path)).collect()}
    for i, raw in enumerate([*GOOD, *BAD]):
        try:
            want = (raw.decode().replace("\r\n", "\n").replace("\r", "\n"), None)
        except UnicodeDecodeError:
            want = (None, "FileError")
        assert got[f"{i:02d}.md"] == want
