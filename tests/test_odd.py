"""Queries beside their SQL on odd texts: none, empty and blank ones, and lines that are very long headings."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from inkstone.config import SplitConfig
from inkstone.errors import SplitError
from inkstone.oracles import ORACLES
from inkstone.plans import documents as D
from inkstone.plans import splitter as S
from inkstone.queries import QUERIES

LONG = "## " + "title words " * 60
TEXTS = [None, "", " ", "\n \n\n", "One. Two three.", f"{LONG}\nab c.\n\n# next\nmore", f"before\n{LONG}", f"{LONG}\n```\nx\n```\ny", LONG, "word " * 400, "x" * 500]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Each text at eight ids, so that its lines become headings, fences, images and so on."""
    at = tmp_path_factory.mktemp("odd")
    texts = [t for t in TEXTS for _ in range(8)]
    rows = {"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string()), "lang": ["en"] * len(texts), "source": ["web"] * len(texts), "n_chars": [len(t or "") for t in texts]}
    pq.write_table(pa.table(rows), at / "documents.parquet")
    return str(at)


@pytest.mark.parametrize("name", ["chunks", "split_stats", "chunk_bounds", "chunk_conservation", "recursive_split", "sql_recursive_split"])
def test_odd_texts_match_sql(spark, odd, name):
    db = duckdb.connect()
    db.execute(f"create view documents as from '{odd}/documents.parquet'")
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, odd).select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want.fetchall(), key=repr) and got


def test_text_below_a_long_title_is_kept_if_asked_for():
    text = "# A\nfirst\n# " + "t" * 18 + "\nab c\n# B\nlast"
    with pytest.raises(SplitError):
        S.chunks(text, "f", "f.md", SplitConfig(20, 5, 1))
    out = S.chunks(text, "f", "f.md", SplitConfig(20, 5, 1, keep_long_titles=True))
    assert [c["body"] for c in out] == ["first", "a", "b", "c", "last"] and [c["chunk_index"] for c in out] == list(range(5))


def test_chunks_of_a_long_title_are_sent_in_parts(spark, monkeypatch):
    """A document's chunks may be many times its text; they go on as they are made."""
    monkeypatch.setattr(D, "_CHARACTERS", 5000)
    docs = spark.createDataFrame([(1, f"{LONG}\n" + "ab" * 100, "f", "f.md"), (2, "text", "f", "f.md")], "doc_id long, md_content string, file_title string, md_path string")
    got = D.split(docs, SplitConfig(600, 150, 1, keep_long_titles=True)).collect()
    assert [(r.doc_id, r.chunk_index) for r in got] == [(1, n) for n in range(200)] + [(2, 0)]
    assert "".join(r.body for r in got[:200]) == "ab" * 100


@pytest.mark.parametrize("name", ["chunk_conservation", "recursive_split", "sql_recursive_split"])
def test_digests_keep_what_sql_calls_no_white_space(spark, tmp_path, name):
    """Blanks beyond ASCII within a line, at its ends, alone, and where texts are cut."""
    texts = ["One\xa0two three four. Five", "One two.\xa0\nNext\xa0", " a b\x0bc\x0b d 　 ", "\xa0", "　", " \xa0 x", "words 　 and\xa0 more " * 60, "\x85" * 400, "x\x1c y\x1f " * 90, "a\tb\fc\n"]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), tmp_path / "documents.parquet")
    db = duckdb.connect()
    db.execute(f"create view documents as from '{tmp_path}/documents.parquet'")
    want = db.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()]
    assert sorted(got) == sorted(want.fetchall()) and len(got) == len(texts)
