"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from inkstone.llm import lexical

from .test_operators import DOCS, awkward

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def brute(docs, items, top=50):
    """Rows (item_id, rank, doc_id, score); rows of docs and of items each by itself."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, whole = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n // whole
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(found)[:top], 1):
            out.append((item, rank, None if none else i, -score))
    return out


ITEMS = "item_id long, text string, term long, weight long, doc_id long, item long"


def given(spark, items):
    return spark.createDataFrame([(*x, 1, 2, 3, 4) for x in items], ITEMS)


@pytest.mark.parametrize(("shard", "block", "short", "terms_at_once"), [(1024, 128, 32, 1 << 18), (16, 3, 2, 40), (7, 2, 1, 1 << 18)])
def test_search(spark, monkeypatch, shard, block, short, terms_at_once):
    """Small shards and blocks, several blocks of the query set, seeds searched first; nulls, ties, repeated rows, long texts."""
    for name, value in (("QUERY_TERMS", terms_at_once), ("SEEDS", 2)):
        monkeypatch.setattr(lexical, name, value)
    top = 5 if shard < 100 else 50
    rows = awkward()
    rng = random.Random(4)
    items = [(k, " ".join(rng.sample(terms(rows[rng.randrange(len(rows))][1]) or ["zeta"], 1) * 2 + [rng.choice(["the", "ZETA", "été", "x1", "and", "of"]) for _ in range(4)])) for k in range(12)]
    items += [(20, None), (21, ""), (22, "nowhere 12345678"), (None, "the zeta"), (3, "w-w x1 漢字 END"), (3, "w-w x1 漢字 END"), (23, rows[0][1])]
    got = lexical.ranked(spark.createDataFrame(rows, DOCS).repartition(3), given(spark, items), top, lexical.Sizes(shard, block, short))
    assert Counter(map(tuple, got.collect())) == Counter(brute([r[:2] for r in rows], items, top))


def test_nothing_to_search(spark):
    docs, none = spark.createDataFrame(awkward(), DOCS), spark.createDataFrame([], DOCS)
    items = given(spark, [(1, "the"), (2, None)])
    assert lexical.ranked(none, items).count() == 0
    assert lexical.ranked(docs, items.filter("false")).count() == 0
    assert lexical.ranked(docs, items.filter("item_id = 2")).count() == 0
    assert lexical.ranked(docs.filter("text is null"), items).count() == 0


def shards(rng, n, words):
    texts = [[f"t{min(int(rng.paretovariate(0.6)), words)}" for _ in range(rng.randrange(1, 60))] for _ in range(n)]
    counts = [Counter(t) for t in texts]
    hashes = {w: np.uint64(hash(("w", w)) & ((1 << 64) - 1)) for c in counts for w in c}
    flat = [(hashes[w], k) for c in counts for w, k in sorted(c.items(), key=lambda x: int(hashes[x[0]]))]
    starts = np.append(0, np.cumsum([len(c) for c in counts]))
    lengths = np.array([len(t) for t in texts])
    return lengths, np.array([x for x, _ in flat], np.uint64), np.array([k for _, k in flat], np.int32), starts, hashes


def test_bounds_are_bounds_and_blocks_are_skipped():
    """A block's maxima are never below what its documents add, by less than a step above the largest; a search scores fewer documents than there are."""
    rng = random.Random(8)
    lengths, hashes, counts, starts, names = shards(rng, 1000, 400)
    index = lexical.opened(lexical.packed(lexical.index_of(lengths, hashes, counts, starts, 1000, int(lengths.sum()))))
    assert sorted(index["members"].tolist()) == sorted(np.repeat(np.arange(1000), np.diff(starts)).tolist())
    for t in range(len(index["vocabulary"])):
        low, high = index["first_block"][t], index["first_block"][t + 1]
        members = index["members"][index["lists"][t] : index["lists"][t + 1]]
        assert (low == high) == (len(members) <= lexical.Sizes().short)
        begin = index["blocks"][low : high + 1] - index["blocks"][low]
        assert low == high or begin[-1] == len(members)
        for b in range(high - low):
            docs = members[begin[b] : begin[b + 1]]
            assert 0 < len(docs) <= lexical.Sizes().block
            most: dict = {}
            for d in docs.tolist():
                for at in range(starts[d], starts[d + 1]):
                    most[index["terms"][at]] = max(most.get(index["terms"][at], 0), index["adds"][at])
            at = slice(index["summaries"][low + b], index["summaries"][low + b + 1])
            kept = dict(zip(index["summary_terms"][at].tolist(), (index["summary_most"][at].astype(int) * lexical.STEP).tolist(), strict=True))
            assert kept.keys() == most.keys() and all(0 <= kept[x] - most[x] < lexical.STEP for x in most)
    df = Counter(w for w, h in names.items() for _ in range(int(np.diff(index["lists"])[np.searchsorted(index["vocabulary"], h)])))
    words = sorted(names, key=lambda w: df[w])
    query = np.array([names[w] for w in [*words[5:8], *words[-12:]]], np.uint64)
    weights = np.array([math.floor(1000 * math.log(2002 / (2 * df[w] + 1))) for w in [*words[5:8], *words[-12:]]])
    best = lexical.Best(np.ones(1, np.int64))
    scored = lexical.search(index, np.arange(1000), 0, query, weights, best)
    every = np.zeros(1000, np.int64)
    for h, w in zip(query, weights, strict=True):
        t = int(np.searchsorted(index["vocabulary"], h))
        for d in range(1000):
            at = np.flatnonzero(index["terms"][starts[d] : starts[d + 1]] == t)
            every[d] += w * index["adds"][starts[d] + at[0]] if len(at) else 0
    order = np.lexsort((np.arange(1000), -every))[: lexical.TOP]
    assert best.ids[0].tolist() == order.tolist() and best.scores[0].tolist() == every[order].tolist()
    assert scored < 1000
