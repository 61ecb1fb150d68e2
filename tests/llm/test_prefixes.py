"""The similarity join, and the near-duplicate stage that uses it, against all pairs of texts."""

import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from inkstone.llm import prefixes
from inkstone.llm.batch import slices

from .test_operators import awkward
from .test_operators import DOCS as AWKWARD

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, n long, root long"


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


def alike(a, b):
    return a == b or 100 * len(a & b) >= 80 * len(a | b) > 0


def corpus():
    rng = random.Random(7)
    prose = lambda n: [f"w{rng.randrange(3000)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        base = prose(rng.randrange(60, 120))
        texts.append(base)
        at = rng.randrange(10, 50)
        texts.append(base[:at] + ["changed"] + base[at + 1 :])
        if rng.random() < 0.5:
            texts.append(texts[-1] + prose(rng.randrange(1, 12)))
    # a chain whose ends aren't similar, sets at and just below the limit, and passages shared by different texts
    chain = prose(100)
    for k in range(8):
        texts.append(chain[6 * k :] + prose(6 * k))
    line = prose(40)
    texts += [line[:24], line[:20], line[:19], line[4:24]]
    passage = prose(30)
    texts += [prose(n) + passage + prose(n) for n in (3, 5, 8, 12, 20, 40) for _ in range(4)]
    texts = [" ".join(t) for t in texts]
    texts += [texts[0].upper(), texts[1].replace(" ", "\n"), "one two three", "One two\tthree", "one two", "one", "", None, " \n", "a b c d e " * 300, "été É x y z", "été é x y z"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[9]), (5, texts[5]), (5, texts[5]), (None, texts[4]), (None, "alone " * 3), (-1, texts[30])]
    rng.shuffle(rows)
    return rows


def groups(texts):
    sets = [shingles(t) for t in texts]
    group = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if group[i] != group[j] and alike(sets[i], sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    return group


def test_similar(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3, 4) for i, t in rows], DOCS).repartition(5).cache()
    found, least = groups([t for _, t in rows]), {}
    for (i, _), g in zip(rows, found, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    got = prefixes.linked(docs)
    want = Counter((i, len(shingles(t)), least.get(g) if shingles(t) else i) for (i, t), g in zip(rows, found, strict=True))
    assert Counter(map(tuple, got.collect())) == want
    # the stage keeps the smallest doc_id of each group; near copies with one changed word are more than 4 bits away
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    lead = {g: min((i is None, i or 0) for (i, _), h in zip(rows, found, strict=True) if h == g) for g in found}
    assert Counter((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == Counter(lead.values())
    assert prefixes.linked(spark.createDataFrame([], DOCS)).count() == 0


def test_awkward_rows(spark):
    rows = [r[:2] for r in awkward()]
    found, least = groups([t for _, t in rows]), {}
    for (i, _), g in zip(rows, found, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    got = prefixes.linked(spark.createDataFrame(awkward(), AWKWARD).repartition(4))
    assert Counter(map(tuple, got.collect())) == Counter((i, len(shingles(t)), least.get(g) if shingles(t) else i) for (i, t), g in zip(rows, found, strict=True))


@pytest.mark.parametrize("piece", [2048, 7])
def test_links_of_later_passes(spark, monkeypatch, piece):
    """Members of one list are similar to each other but not to that which it is compared with first; lists go through in many pieces."""
    monkeypatch.setattr(prefixes, "PIECE", piece)
    rng = random.Random(11)
    base = [f"v{i}" for i in range(400)]
    rows = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(5, 395), rng.randrange(2, 12)):
            words[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    got = prefixes.linked(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = groups([t for _, t in rows])
    parts = lambda key: sorted(sorted(i for i in key if key[i] == k) for k in set(key.values()))
    assert parts({r.doc_id: r.component_id for r in got}) == parts(dict(zip((i for i, _ in rows), found, strict=True)))


def test_documents_of_common_blocks_make_few_pairs(spark):
    """Documents of 10 blocks out of 40: each block is in a quarter of them, and none are linked."""
    rng = random.Random(5)
    blocks = [" ".join(f"b{k}w{i}" for i in range(14)) for k in range(40)]
    made, real = [], prefixes._Judge.links

    def counted(judge, pairs):
        keep = prefixes.keep

        def spy(df, label):
            out = keep(df, label)
            if label == "prefix-pairs":
                made.append(out.count())
            return out

        prefixes.keep = spy
        try:
            return real(judge, pairs)
        finally:
            prefixes.keep = keep

    prefixes._Judge.links = counted
    try:
        for n in (300, 600):
            rows = [(i, " ".join(blocks[k] for k in rng.sample(range(40), 10))) for i in range(n)]
            got = prefixes.linked(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
            found = groups([t for _, t in rows])
            least = {g: min(i for (i, _), h in zip(rows, found, strict=True) if h == g) for g in found}
            assert {r.doc_id: r.component_id for r in got} == {i: least[g] for (i, _), g in zip(rows, found, strict=True)}
            assert sum(made) < n, made
            made.clear()
    finally:
        prefixes._Judge.links = real


def test_bounds_lose_no_link():
    """Any two linked sets share a shingle of their prefixes, at places that leave room for what they share, and their bitmaps don't differ more than they do."""
    rng = random.Random(3)
    linked = 0
    for _ in range(400):
        a = set(rng.sample(range(60), rng.randrange(1, 50)))
        b = set(rng.sample(sorted(a), rng.randrange((7 * len(a) + 9) // 10, len(a) + 1))) | set(rng.sample(range(60, 80), rng.randrange(0, 5)))
        sets = [np.array(sorted(x), np.uint64) * np.uint64(0x9E3779B97F4A7C15) for x in (a, b)]
        sets = [np.sort(x) for x in sets]
        offs = np.array([0, len(a), len(a) + len(b)])
        tally = np.array([rng.randrange(3) for _ in range(64)], np.uint16)[np.arange(1 << prefixes.CELLS) % 64]
        bits = prefixes.bitmaps(np.concatenate(sets), offs)
        differ = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
        assert differ <= len(a ^ b)
        same = len(a & b)
        if 100 * same < 80 * len(a | b):
            assert same < prefixes.needed(len(a), len(b))
            continue
        linked += 1
        assert same >= prefixes.needed(len(a), len(b)) and differ <= len(a) + len(b) - 2 * prefixes.needed(len(a), len(b))
        tokens, _, at = prefixes.prefixes(np.concatenate(sets), offs, tally)
        one, two = tokens[: at[1]].tolist(), tokens[at[1] :].tolist()
        first = next(t for t in one if t in two)
        assert min(len(a) - one.index(first), len(b) - two.index(first)) >= prefixes.needed(len(a), len(b))
    assert linked > 100


def test_shingle_sets():
    texts = ["A b C d e f", "a B c d e", "x y", "", None, "é É a b c d", "a a a a a a a a"]
    for part in slices(pa.array(texts), 12):
        every, offs = prefixes.shingle_sets(part)
        assert [len(shingles(t)) for t in texts[part.first : part.first + len(part)]] == np.diff(offs).tolist()
    whole, offs = prefixes.shingle_sets(next(slices(pa.array(texts))))
    sets = [set(whole[a:b].tolist()) for a, b in zip(offs, offs[1:], strict=False)]
    for (i, s), (j, t) in combinations(enumerate(texts), 2):
        assert len(sets[i] & sets[j]) == len(shingles(s) & shingles(t))
