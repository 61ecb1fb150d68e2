"""The manifest against trees built whole in plain Python."""

import hashlib
import zlib
from collections import Counter

import pytest

from inkstone.llm import merkle

from .test_operators import DOCS, awkward


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def coded(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, source, lang, n_chars, text):
    return sha("".join(map(coded, (doc_id, source, lang, n_chars, text))))


def tree(leaves):
    """The root, and of each leaf the siblings (before, after) on its way up."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 2])) for i in range(0, len(levels[-1]), 2)])
    paths = []
    for i in range(len(leaves)):
        path = []
        for level in levels[:-1]:
            run = level[i // 2 * 2 : i // 2 * 2 + 2]
            path.append(("" if i % 2 == 0 else run[0], run[1] if i % 2 == 0 and len(run) > 1 else ""))
            i //= 2
        paths.append(path)
    return levels[-1][0], paths


def brute(rows):
    """Rows (doc_id, text, lang, source, n_chars) -> expected results, repeats included."""
    by = {}
    for i, text, lang, source, n in rows:
        by.setdefault(lang, []).append((i, leaf(i, source, lang, n, text), leaf(i, source, lang, n if n is None else n + 1, text)))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = tree([x[1] for x in by[lang]])
    root, tops = tree([trees[x][0] for x in langs])
    out = []
    for lang, above in zip(langs, tops, strict=True):
        for (i, one, changed), path in zip(by[lang], trees[lang][1], strict=True):
            now = changed if i is not None and zlib.crc32(str(i).encode()) % 7 == 0 else one
            for before, after in path + above:
                now = sha(before + now + after)
            out.append((i, one, trees[lang][0], root, sha("".join(b + a for b, a in path + above)), now, now == root))
    return out


@pytest.mark.parametrize("step", [10, 1, 2, 3])
def test_manifest(spark, monkeypatch, step):
    """Whatever levels are written, with repeated rows, nulls, ties, long texts and clashing columns."""
    monkeypatch.setattr(merkle, "STEP", step)
    rows = [(*r[:4], None if (r[0] or 0) % 5 == 1 else r[4], *r[5:]) for r in awkward()]
    docs = spark.createDataFrame(rows, DOCS).repartition(4)
    assert Counter(map(tuple, merkle.audit(docs).collect())) == Counter(brute([r[:5] for r in rows]))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8])
def test_small_trees(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "STEP", 2)
    rows = [(7 * i, f"t{i}", "en" if i < 6 else None, "s", i) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter(map(tuple, merkle.audit(docs).collect()))
    assert got == Counter(brute(rows) if n else [])


def test_proofs_of_a_manifest(spark):
    """A proof shows its leaf, and no other one; a changed row has another root."""
    rows = [(i, f"text {i}", ["en", "fr", "de"][i % 3], "s", 5) for i in range(60)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    made = merkle.manifest(spark.createDataFrame(rows, schema))
    proofs = made.proofs().collect()
    for r in proofs:
        for digest, fits in ((r.leaf, True), (sha("other"), False)):
            for x in r.path:
                digest = sha(x.before + digest + x.after)
            assert (digest == made.root) is fits
    other = merkle.manifest(spark.createDataFrame([*rows[:-1], (59, "text 60", "de", "s", 5)], schema))
    assert other.root != made.root and made.root == brute(rows)[0][3]
    made.drop()
    other.drop()
