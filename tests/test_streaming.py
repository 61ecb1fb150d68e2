"""Files that come and change."""

import os
import time

from inkstone.config import SplitConfig
from inkstone.streaming import raw


def texts(df):
    return sorted((os.path.basename(r.path), r.content) for r in df.select("path", "content").collect())


def test_a_file_written_twice_has_the_chunks_of_its_last_version(spark, tmp_path):
    folder, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "check")
    (folder / "deep").mkdir(parents=True)
    (folder / "a.md").write_text("# A\none\n# B\ntwo")
    (folder / "deep/b.MD").write_text("b")
    (folder / "c.txt").write_text("no Markdown")
    (folder / "bad.md").write_bytes(b"\xff")

    def run():
        time.sleep(0.3)
        raw.replaced(raw.changed_files(spark, str(folder), grace=0.1), out, check, SplitConfig(12, 2, 0)).awaitTermination(120)

    run()
    assert texts(raw.current(spark, out)) == [("a.md", "# A\n\none"), ("a.md", "# B\n\ntwo"), ("b.MD", "b\n\nb")]
    assert [(os.path.basename(r.path), r.error_class) for r in raw.rejected(spark, out).collect()] == [("bad.md", "FileError")]
    (folder / "a.md").write_text("# A\nnew")
    os.utime(folder / "deep/b.MD")  # touched, not changed
    (folder / "d.md").write_text("d")
    run()
    batches = len(os.listdir(out))
    assert texts(raw.current(spark, out)) == [("a.md", "# A\n\nnew"), ("b.MD", "b\n\nb"), ("d.md", "d\n\nd")]
    (folder / "a.md").write_text("")  # no chunks any more
    (folder / "bad.md").write_text("good")
    run()
    assert texts(raw.current(spark, out)) == [("b.MD", "b\n\nb"), ("bad.md", "bad\n\ngood"), ("d.md", "d\n\nd")] and raw.rejected(spark, out).count() == 0
    version = raw.compacted(spark, out, str(tmp_path / "published"))
    assert version.statistics["rows"] == 3 and len(os.listdir(out)) > batches
    b = raw._seen(spark, out).filter("path like '%b.MD'").collect()
    assert len(b) == 1  # written by the first batch only


def test_the_last_of_a_batch_counts(spark, tmp_path):
    rows = [("/x.md", 3, bytearray(b"three")), ("/x.md", 5, bytearray(b"five")), ("/x.md", 4, bytearray(b"four")), ("/y.md", 1, bytearray(b"y"))]
    spark.createDataFrame(rows, raw.FILES).repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(raw.FILES).parquet(str(tmp_path / "in"))
    raw.replaced(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert texts(raw.current(spark, str(tmp_path / "out"))) == [("x.md", "x\n\nfive"), ("y.md", "y\n\ny")]
