"""The pipeline on small tables, stage by stage, and the registry of queries."""

import random
import sys
from collections import Counter

import pytest

import __spark_entry__ as entry

from .test_operators import spaced_brute, tokens, waterfill
from .test_prefixes import groups


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(2)
    prose = lambda n: " ".join(f"w{rng.randrange(4000)}" for _ in range(n))
    items = [(i, prose(25)) for i in range(6)]
    rows, labels = [], []
    for i in range(300):
        text = prose(rng.randrange(30, 80))
        toxic = i % 5 == 0
        if toxic:
            text += " vile gross nasty vile"
        elif i % 31 == 1:
            text += " " + items[i % 6][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, rows[1][1] if i % 2 else rows[2][1] + " tail", "en", "s1", 5) for i in range(40)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s0", 0), rows[7], rows[7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


def test_stages(spark, tables):
    """Each stage against a brute-force version on what the one before it kept."""
    import corpus_pipeline as P
    from inkstone.llm import toxic

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    columns, kept = docs.columns, [docs.collect()]
    for name, stage in P.STAGES[:-1]:
        docs = P.keep(stage(spark, docs, tables), name)
        assert docs.columns == columns
        kept.append(docs.collect())
    every, clean, single, decent, mixed = kept
    # toxicity: what the trained model scores below its threshold; all toxic documents go, no other does
    scored = {r.doc_id: r.rejected for r in toxic.scored(spark.read.parquet(f"{tables}/documents.parquet"), spark.read.parquet(f"{tables}/labels.parquet")).collect()}
    assert Counter(map(tuple, clean)) == Counter(tuple(r) for r in every if not scored[r.doc_id])
    assert [i for i in range(300) if scored[i]] == list(range(0, 300, 5))
    # near duplicates: all pairs of shingle sets; of each group the row with the smallest doc_id
    of = groups([r.text for r in clean])
    lead = {g: min(r.doc_id for r, h in zip(clean, of, strict=True) if h == g) for g in of}
    assert Counter(r.doc_id for r in single) == Counter(lead.values()) and len(single) < len(clean) - 40
    # decontamination: every document laid against every item
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    held = {d for d, _, _, n in spaced_brute([(r.doc_id, r.text) for r in single], items) if n >= 5}
    assert Counter(map(tuple, decent)) == Counter(tuple(r) for r in single if r.doc_id not in held)
    assert {i for i in range(300) if i % 31 == 1 and i % 5} & {r.doc_id for r in single} <= held
    # mixing: 0 to 2 whole copies, each source within half of its largest document of its target
    size, took, copies = Counter(), Counter(), Counter(tuple(r) for r in mixed)
    for r in decent:
        size[r.source] += len(tokens(r.text))
        took[r.source] += copies[tuple(r)] * len(tokens(r.text))
    target = waterfill(dict(size))
    assert set(copies) <= {tuple(r) for r in decent} and max(copies.values()) <= 2
    for s in size:
        assert abs(took[s] - target[s]) <= max(len(tokens(r.text)) for r in decent if r.source == s) / 2 + 1e-6
    # sharding: all rows of the mix, gapless slots, sizes near equal
    out = P.STAGES[-1][1](spark, docs, tables).collect()
    assert Counter(r.doc_id for r in out) == Counter(r.doc_id for r in mixed)
    for s in range(P.SHARDS):
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert Counter((r.doc_id, r.size) for r in P.run(spark, tables).collect()) == Counter((r.doc_id, r.size) for r in out)


def test_near_duplicates_go_by_fingerprints_first_and_lose_no_link(spark, monkeypatch):
    """Some copies are within four bits of their fingerprints, others only similar; some texts within four bits aren't similar enough."""
    import corpus_pipeline as P
    from inkstone.llm import prefixes, simhash

    rng = random.Random(12)
    texts = []
    for k in range(12):
        text = [f"w{rng.randrange(3000)}" for _ in range(400)]
        texts.append(" ".join(text))
        for changed in (1, 2, 4, 8, 12):
            for i in rng.sample(range(400), changed):
                text[i] = f"x{k}"
            texts.append(" ".join(text))
    # one line many times, after openings of their own: alike in its votes, not in its set of shingles
    texts += [" ".join(f"{x}{i}" for i in range(30)) + " the same line again" * 300 for x in "pq"]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    asked, links = [], simhash.near_links
    monkeypatch.setattr(simhash, "near_links", lambda *a: asked.append(a) or links(*a))
    first, judged = [], prefixes._Judge.links
    monkeypatch.setattr(prefixes._Judge, "links", lambda self, pairs: first.append({(r.a, r.b) for r in pairs.collect()}) or judged(self, pairs))
    got = {r.doc_id for r in P.near_duplicates(spark, docs, "").collect()}
    of = groups(texts)
    assert got == {min(i for i, h in enumerate(of) if h == g) for g in of} and 14 <= len(got) < len(texts)
    # what the index of fingerprints brings together is compared first, and the join still has pairs of its own
    assert len(asked) == 1 and len(first[0]) >= 10 and any(p - first[0] for p in first[1:])


NAMES = "doc_id long, text string, lang string, source string, n_chars long, tag long, root long, key string, part int, size long, `_` int, `_tag` int, item long, seed long, shard int, `_of` int, n int, turn int"


def test_stages_without_rows_and_with_clashing_columns(spark, tables):
    import corpus_pipeline as P

    texts = ["word " * 30, "word " * 30, None, "", "x", "longer text of its own " * 4000]
    rows = [(i if i != 4 else None, t, [None, "en"][i % 2], [None, "s"][i % 2], None, *[7] * 2, "k", *[7] * 10) for i, t in enumerate(texts)]
    for given in (rows, rows + rows, []):
        docs = spark.createDataFrame(given, NAMES)
        for name, stage in P.STAGES[:-1]:
            docs = P.keep(stage(spark, docs, tables), name)
            assert docs.columns == spark.createDataFrame([], NAMES).columns
            if name == "near_dedup":
                # one of the equal texts, one of null and empty, the lone word without an id, the long text
                assert sorted((r.doc_id is None, r.doc_id or 0) for r in docs.collect()) == ([(False, 0), (False, 2), (False, 5), (True, 0)] if given else [])
        out = P.shards(spark, docs, tables)
        assert out.count() == docs.count()


def test_all_operators_are_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in entry.queries() if n.startswith("op") and n[2].isdigit())
    assert numbers == list(range(1, 14)) and "pipeline" in entry.queries()


def test_the_rest_works_without_this_subpackage(monkeypatch):
    monkeypatch.setitem(sys.modules, "inkstone.llm", None)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "chunks" in entry.queries() and not [n for n in entry.queries() if n.startswith("op1_")]
    assert set(entry.oracle_sql()) <= set(entry.queries())
