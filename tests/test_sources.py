"""Files, connectors and streams."""

import json

import pytest
from pyspark.sql import functions as F

from inkstone.config import ImageConfig
from inkstone.errors import ConfigError, FileError, ModelError, PdfError, StoreError
from inkstone.plans import documents as D
from inkstone.sources import connectors as X
from inkstone.sources import files as S
from inkstone.streaming import ingest


def test_markdown_and_images_from_files(spark, tmp_path):
    (tmp_path / "images").mkdir()
    (tmp_path / "a.md").write_bytes("﻿# A\r\nx".encode())
    (tmp_path / "b.txt").write_text("no")
    (tmp_path / "images" / "p.PNG").write_bytes(b"abc")
    (tmp_path / "images" / "q.bmp").write_bytes(b"abc")
    doc = S.read_markdown(spark, str(tmp_path)).collect()
    assert [r.md_content for r in doc] == ["﻿# A\nx"] and doc[0].image_dir.endswith("/images")
    (tmp_path / "images" / "below.png").mkdir()
    (tmp_path / "images" / "A.jpeg").write_bytes(b"")
    folders = spark.createDataFrame([(str(tmp_path / "images"),), (str(tmp_path / "images"),), (str(tmp_path / "none"),), (str(tmp_path / "a.md"),), (None,)], "image_dir string")
    images = S.list_images(folders, ImageConfig().extensions).collect()
    assert [(r.image_name, r.length) for r in images if r.image_name] == [("A.jpeg", 0), ("p.PNG", 3), ("q.bmp", 3)]
    assert [(r.image_dir.rsplit("/", 1)[1], r.error_class) for r in images if not r.image_name] == [("a.md", "ImageError")]
    (tmp_path / "images" / "A.jpeg").unlink()
    urls = {r.path.rsplit("/", 1)[1]: r.data_url for r in S.read_images(spark, str(tmp_path / "images")).collect()}
    assert urls == {"p.PNG": "data:image/png;base64,YWJj", "q.bmp": None}


def test_processed_documents_go_beside_their_sources(spark, tmp_path):
    """Files of one name in two folders, line ends as they are, an earlier run replaced, sources kept."""
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "x.md").write_text("source")
    rows = [(1, f"{tmp_path}/a/x.md", "one\r\nONE\n\n"), (2, f"file://{tmp_path}/b/x.md", "two é"), (3, f"{tmp_path}/b/y_NEW.markdown", "")]
    docs = spark.createDataFrame(rows, "doc_id long, md_path string, md_content string").repartition(3)
    for _ in range(2):
        assert S.write_markdown(docs) == 3
    got = {str(p.relative_to(tmp_path)): p.read_bytes().decode() for p in tmp_path.rglob("*") if p.is_file()}
    assert got == {"a/x.md": "source", "b/x.md": "source", "a/x_new.md": "one\r\nONE\n\n", "b/x_new.md": "two é", "b/y_NEW.markdown": ""}
    bad = spark.createDataFrame([(1, f"{tmp_path}/none/x.md", "t"), (2, None, "t"), (3, f"{tmp_path}/a/z.md", "written")], "doc_id long, md_path string, md_content string")
    with pytest.raises(FileError, match="2 documents"):
        S.write_markdown(bad)
    assert (tmp_path / "a/z_new.md").read_text() == "written"


def test_converters(spark, tmp_path):
    def factory():
        def convert(path, content):
            if path == "bad.pdf":
                raise PdfError("no PDF")
            return "# " + content.decode()

        return convert

    files = spark.createDataFrame([(1, "a.pdf", bytearray(b"x")), (2, "bad.pdf", bytearray(b""))], "doc_id long, pdf_path string, content binary")
    assert {(r.doc_id, r.md_content, r.error_class) for r in X.convert_pdfs(files, factory).collect()} == {(1, "# x", None), (2, None, "PdfError")}
    run = X.CommandConverter(["sh", "-c", "mkdir -p {out}/a/auto && echo hi > {out}/a/auto/a.md"], str(tmp_path))
    assert run("/x/a.pdf") == "hi\n"
    with pytest.raises(PdfError):
        X.CommandConverter(["sh", "-c", "exit 3"], str(tmp_path / "none"))("/x/a.pdf")


def test_services_that_fail(spark):
    def describer():
        def ask(prompt, url):
            if prompt == "boom":
                raise RuntimeError
            return "seen " + prompt

        return ask

    images = spark.createDataFrame([("p", "u"), ("boom", "u"), ("q", None)], "prompt string, data_url string")
    assert {(r.prompt, r.summary) for r in X.describe_images(images, describer, 100, 2).collect()} == {("p", "seen p"), ("boom", None), ("q", None)}

    def store():
        def put(key, path, kind):
            if key == "k2":
                raise StoreError("down")

        return put

    files = spark.createDataFrame([("/a", "k1", "t", "http://s/k1"), ("/b", "k2", "t", "http://s/k2")], "path string, object_key string, content_type string, object_url string")
    assert {r.url for r in X.store_images(files, store).collect()} == {"http://s/k1", "/b"}


def test_rate_limit():
    """No window of 60 seconds has more than three calls, and none waits without need."""
    now, calls = [0.0], []

    def sleep(s):
        now[0] += s

    limit = X.RateLimit(3, 60, lambda: now[0], sleep)
    for pause in (0, 10, 0, 0, 45, 100, 1, 1, 0, 0):
        now[0] += pause
        limit.call()
        calls.append(now[0])
    assert calls == [0, 10, 10, 60, 105, 205, 206, 207, 265, 266]
    assert all(b - a >= 60 for a, b in zip(calls, calls[3:], strict=False))


def test_no_more_workers_than_calls(spark):
    images = spark.createDataFrame([("p", "u")] * 4, "prompt string, data_url string")
    out = X.describe_images(images, lambda: lambda prompt, url: "seen", 2, 50)
    assert out.rdd.getNumPartitions() == 2


def test_vision_model():
    sent = []

    def send(answer):
        def post(request, timeout):
            sent.append(request)
            if isinstance(answer, Exception):
                raise answer
            return answer

        return post

    ask = lambda answer: X.VisionModel("http://h/v1/", "k", "m", send=send(answer))("what?", "data:image/png;base64,xx")
    assert ask(b'{"choices": [{"message": {"content": " a view "}}]}') == " a view "
    assert sent[0].full_url == "http://h/v1/chat/completions" and sent[0].get_header("Authorization") == "Bearer k"
    body = json.loads(sent[0].data)
    assert body["model"] == "m" and body["messages"][0]["content"][0]["text"] == "what?" and body["messages"][0]["content"][1]["image_url"]["url"].endswith("xx")
    for bad in (b"{}", b'{"choices": []}', b'{"choices": [{"message": {"content": " "}}]}', b"no json", OSError("down")):
        with pytest.raises(ModelError):
            ask(bad)
    with pytest.raises(ModelError):
        X.VisionModel("http://h", "k", "m")("p", None)
    with pytest.raises(ConfigError):
        X.VisionModel("http://h", " ", "m")


def test_s3_store(monkeypatch, tmp_path):
    """The client is made from the configuration; the bucket is made once."""
    from pyarrow.fs import LocalFileSystem, SubTreeFileSystem

    asked = []

    def client(**given):
        asked.append(given)
        return SubTreeFileSystem(str(tmp_path), LocalFileSystem())

    monkeypatch.setattr(X, "S3FileSystem", type("Made", (), {"__new__": lambda cls, **given: client(**given)}))
    config = ImageConfig(endpoint="https://host:9000", secure=False, bucket="pics")
    for _ in range(2):
        X.s3_store(config, "a", "s")
    assert (tmp_path / "pics").is_dir() and asked[0] == {"access_key": "a", "secret_key": "s", "endpoint_override": "host:9000", "scheme": "https", "allow_bucket_creation": True}
    for access, secret in (("", "s"), ("a", " ")):
        with pytest.raises(ConfigError):
            X.s3_store(config, access, secret)


def test_image_config():
    assert ImageConfig(endpoint="h:1/", bucket="b").checked().base_url() == "http://h:1"
    for bad in ({"endpoint": "h", "bucket": " "}, {"endpoint": " / ", "bucket": "b"}):
        with pytest.raises(ConfigError):
            ImageConfig(**bad).checked()


def test_stream_of_documents(spark, tmp_path):
    docs = spark.createDataFrame([(1, "# A\nx", "a", "a.md"), (2, "y", "b", "b.md")], ingest.DOCUMENTS)
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        ingest.chunk_stream(ingest.arriving(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    got = {(r.doc_id, r.content) for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id", "content").collect()}
    assert got == {(r.doc_id, r.content) for r in D.split(docs).select("doc_id", F.col("content")).collect()}


def test_conversion_service():
    sent = []

    def send(answer):
        def post(request, timeout):
            sent.append((request.full_url, request.data, timeout))
            return answer

        return post

    assert X.ApiConverter("http://h/", send=send(b'{"results": {"a": {"md_content": "# x"}}}'))("/d/a.PDF", b"bytes") == "# x"
    assert sent[0][0] == "http://h/file_parse" and b"bytes" in sent[0][1] and b'name="return_md"' in sent[0][1] and sent[0][2] == 3600.0
    for bad in (b"no json", b"[]", b'{"results": {}}', b'{"results": {"a": {}, "b": {}}}', b'{"results": {"a": {"md_content": 3}}}', b'{"results": {"a": null}}'):
        with pytest.raises(PdfError):
            X.ApiConverter(send=send(bad))("a.pdf", b"")
    with pytest.raises(PdfError):
        X.ApiConverter(send=send(b"{}"))("a.txt", b"")


def test_folder_store(tmp_path):
    (tmp_path / "p.png").write_bytes(b"x")
    put = X.folder_store(str(tmp_path / "s"), "bucket")
    put("knowledge/d/p.png", str(tmp_path / "p.png"), "image/png")
    assert (tmp_path / "s/bucket/knowledge/d/p.png").read_bytes() == b"x"
    with pytest.raises(StoreError):
        put("k", str(tmp_path / "none"), "t")


def test_stages_classify_errors(spark):
    from inkstone.errors import ImportFailure, stage

    @stage("demo")
    def fails(df, error):
        raise error

    with pytest.raises(ImportFailure, match=r"\[demo\] odd"):
        fails(spark.range(1), ValueError("odd"))
    with pytest.raises(ConfigError):
        fails(spark.range(1), ConfigError("bad"))
