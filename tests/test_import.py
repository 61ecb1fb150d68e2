"""The whole import: nothing is lost, services are asked once, failures are classified."""

from collections import Counter
from urllib.parse import urlsplit

import pytest
from pyspark.sql import functions as F

from inkstone.config import ImageConfig, SplitConfig
from inkstone.errors import ConfigError, ImportFailure, PdfError, enveloped, running
from inkstone.operators import images as I
from inkstone.plans import documents as D
from inkstone.plans import splitter
from inkstone.sources import connectors as X
from inkstone.sources import files as S
from inkstone.sources.answers import Ledger

PATHS = [(1, "/in/a.pdf"), (2, "/in/b.pdf"), (3, "/in/c.PDF"), (4, "/in/d.md"), (5, "/in/e.md"), (6, "/in/f.txt"), (7, None), (8, "/in/g.pdf"), (9, "/in/h.md")]


def kept(folder):
    """Tables written once and read back."""
    n = iter(range(1000))

    def written(df):
        at = f"{folder}/{next(n)}"
        df.write.parquet(at)
        return df.sparkSession.read.parquet(at)

    return written


@pytest.mark.parametrize("materialised", [True, False])
def test_every_file_has_chunks_or_is_rejected(spark, tmp_path, materialised):
    """A converter that leaves out a file, gives another kind of error, and gives no text; contents that lack a file and can't be decoded."""
    calls = spark.sparkContext.accumulator(0)
    answers = {1: ("# one", None), 3: (None, "StoreError"), 8: (None, None)}

    def convert(pdfs):
        def run(batches):
            for batch in batches:
                for doc in batch.column("doc_id").to_pylist():
                    calls.add(1)
                    if doc in answers:
                        yield D.pa.RecordBatch.from_pydict({"doc_id": [doc], "md_content": D.pa.array([answers[doc][0]], D.pa.string()), "error_class": D.pa.array([answers[doc][1]], D.pa.string()), "error_message": D.pa.array(["why"] if answers[doc][1] else [None], D.pa.string())})

        return pdfs.select("doc_id").mapInArrow(run, "doc_id long, md_content string, error_class string, error_message string")

    files = spark.createDataFrame(PATHS, "doc_id long, import_file_path string")
    contents = spark.createDataFrame([("/in/d.md", "# four", None, None), ("/in/h.md", None, "FileError", "the file is not UTF-8")], "md_path string, md_content string, error_class string, error_message string")
    found, rejected = D.imported_files(files, contents, convert, written=kept(tmp_path) if materialised else lambda df: df)
    assert {r.doc_id for r in found.collect()} == {1, 4}
    got = {r.doc_id: (r.error_class, r.stage) for r in rejected.collect()}
    assert got == {2: ("PdfError", "pdf"), 3: ("StoreError", "pdf"), 8: ("PdfError", "pdf"), 5: ("FileError", "images"), 9: ("FileError", "images"), 6: ("FieldError", "entry"), 7: ("FieldError", "entry")}
    if materialised:
        assert calls.value == 4 and found.count() == 2 and calls.value == 4


def test_services_are_asked_once_through_the_whole_import(spark, tmp_path):
    """Two PDFs of one content, and images; run twice with ledgers."""
    for name in ("p.png", "q.png"):
        (tmp_path / name).write_bytes(name.encode())
    files = spark.createDataFrame([(1, f"{tmp_path}/a.pdf"), (2, f"{tmp_path}/b.pdf")], "doc_id long, import_file_path string")
    log = tmp_path / "log"
    log.mkdir()

    def noted(kind, what):
        with open(log / kind, "a") as out:
            out.write(f"{what}\n")

    def convert(pdfs):
        def factory():
            def one(path, content):
                noted("pdf", path)
                return "# T\n![x](images/p.png)\n![y](q.png)\nwords"

            return one

        return X.convert_pdfs(pdfs.withColumn("content", F.lit(b"same")), factory, Ledger(str(tmp_path / "pdfs")))

    images = spark.createDataFrame([(d, n, f"{tmp_path}/{n}", f"data:{n}") for d in (1, 2) for n in ("p.png", "q.png")], "doc_id long, image_name string, path string, data_url string")
    config = ImageConfig(model="m", endpoint="store:1", bucket="b", secure=False)

    def describing(df):
        return X.describe_images(df, lambda: lambda prompt, url: noted("image", url) or f"a view of {url}", 1000, 2, Ledger(str(tmp_path / "seen")))

    def storing(df):
        return X.store_images(df, lambda: lambda key, path, kind: noted("store", key), Ledger(str(tmp_path / "stored")))

    for run in range(2):
        written = kept(tmp_path / f"run{run}")
        found, rejected = D.imported_files(files, S.read_markdown(spark, str(tmp_path)).filter("false"), convert, lambda docs: D.with_images(docs, images, describing, storing, written, config), image_files=images, written=written)
        texts = {r.doc_id: r.content for r in found.collect()}
        assert texts == {d: f"# T\n\n![a view of data:p.png](http://store:1/b/knowledge/{n}/p.png)\n![a view of data:q.png](http://store:1/b/knowledge/{n}/q.png)\nwords" for d, n in ((1, "a"), (2, "b"))}
        assert rejected.count() == 0
    lines = {kind: Counter((log / kind).read_text().split()) for kind in ("pdf", "image", "store")}
    assert sum(lines["pdf"].values()) == 1 and sum(lines["store"].values()) == 4
    assert sum(lines["image"].values()) == 4  # the titles, and so the prompts, differ


def test_rows_with_one_id_ask_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "![x](p.png)", "t"), (1, "![x](p.png)", "t")], "doc_id long, md_content string, file_title string")
    images = spark.createDataFrame([(1, "p.png", "/p.png", "u")], "doc_id long, image_name string, path string, data_url string")
    asked = []

    def describe(df):
        asked.append(df.count())
        return df.withColumn("summary", F.lit("s"))

    config = ImageConfig(model="m", endpoint="h", bucket="b", secure=False)
    out = D.with_images(docs, images, describe, lambda df: df.withColumn("url", F.lit("http://h/b/k")), kept(tmp_path), config)
    assert asked == [1] and [r.md_content for r in out.collect()] == ["![s](http://h/b/k)"] * 2


TARGETS = ["http://h/x", "//h", "//[x", "//x]", "http://[::1]/a", "http://[::1]:80/a", "http://u:p@[::1]/a", "//a[::1]", "//[::1]x", "//[1.2.3.4]", "//[v1.x]", "//[v.x]", "//[vG.x]", "//[1:2:3:4:5:6:7:8]", "//[1:2:3:4:5:6:7]", "//[1::8]", "//[1::2::3]", "//[::1.2.3.4]", "//[::1.2.3.256]", "//[12345::]", "//[::]", "//[]", "//[fe80::1%eth0]", "//[1:2:3:4:5:6:1.2.3.4]", "//[1:2:3:4:5:6:7:1.2.3.4]", "images/[x.png", "a]b.png", "", "x:[y", "//h/[x", "//h?[", "//h#]", "//]x[", "//[::1]:", "//[:::1]", "//[1:2:3:4:5:6:7::]", "//[1:2:3:4:5:6:7:8::]"]


def test_authorities_against_the_standard_library(spark):
    got = {r.t: r.bad for r in spark.createDataFrame([(t,) for t in TARGETS] + [(None,)], "t string").select("t", I.bad_authority(F.col("t")).alias("bad")).collect()}
    assert got.pop(None) is False
    # what stands beside the brackets is looked at by later releases of the standard library only
    assert all(got.pop(x) for x in ("//a[::1]", "//[::1]x", "//]x["))
    for target, bad in got.items():
        try:
            urlsplit(target)
            assert not bad, target
        except ValueError:
            assert bad, target


def test_documents_with_bad_authorities_are_rejected_where_there_are_images(spark):
    docs = spark.createDataFrame([(1, "![x](//[x)", "t"), (2, "![x](//[x)", "t"), (3, "![x](p.png)", "t"), (4, None, "t")], "doc_id long, md_content string, file_title string")
    images = spark.createDataFrame([(1, "p.png"), (1, "q.png"), (3, "p.png"), (4, "p.png"), (None, "p.png")], "doc_id long, image_name string")
    assert {(r.doc_id, r.error_class, r.stage) for r in D.checked_references(docs, images).collect()} == {(1, "ImportFailure", "images"), (2, None, None), (3, None, None), (4, None, None)}


def test_failing_rows_and_failing_jobs(spark, monkeypatch):
    with enveloped("x", False, PdfError) as failure:
        raise PdfError("no", "pdf")
    assert failure == {"error_class": "PdfError", "error_message": "no", "stage": "x"}
    with pytest.raises(ZeroDivisionError), enveloped("x", False, PdfError):
        1 / 0  # noqa: B018
    with enveloped("x", True) as failure:
        1 / 0  # noqa: B018
    assert failure == {"error_class": "ImportFailure", "error_message": "ZeroDivisionError: division by zero", "stage": "x"}

    real = splitter.chunks

    def broken(text, *rest):
        if text == "odd":
            raise KeyError("what")
        return real(text, *rest)

    class Broken:
        chunks = staticmethod(broken)

    monkeypatch.setattr(D, "splitter", Broken)
    docs = spark.createDataFrame([(1, "odd", "t", "p"), (2, "fine", "t", "p")], "doc_id long, md_content string, file_title string, md_path string")
    good = D.split(docs, SplitConfig(), errors=True).collect()
    assert {(r.doc_id, r.error_class, r.error_message) for r in good} == {(1, "ImportFailure", "KeyError: 'what'"), (2, None, None)}
    with pytest.raises(ImportFailure, match=r"\[split\] KeyError: 'what'") as e, running("split", docs):
        D.split(docs).count()
    assert e.value.cause is not None
    with pytest.raises(ConfigError), running("split", docs):
        raise ConfigError("bad")
    with running("split", docs):
        assert docs.count() == 2
