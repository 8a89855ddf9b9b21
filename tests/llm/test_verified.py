"""The pipeline's near-duplicates are held to a Jaccard similarity of 0.8, by comparing all pairs."""

import random

import numpy as np
from test_pipeline import shingles

from segmill.llm import simhash


def plain(texts):
    """The first of each component of pairs of 0.8 and more; also all similarities."""
    sets, root, seen = [shingles(t) for t in texts], list(range(len(texts))), []
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            seen.append(len(a & b) / len(a | b))
            if 5 * len(a & b) >= 4 * len(a | b) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    return sorted(set(root)), seen


def family(rnd, n, edits, copies):
    """A text and copies with so many words changed."""
    words = [f"w{rnd.randrange(5000)}" for _ in range(n)]
    out = [words]
    for _ in range(copies):
        s = list(rnd.choice(out))
        for k in rnd.sample(range(n), edits):
            s[k] = f"e{rnd.randrange(10**6)}"
        out.append(s)
    return [" ".join(s) for s in out]


def test_held_to_least(spark, monkeypatch):
    rnd = random.Random(4)
    texts = [t for edits in range(1, 12) for _ in range(5) for t in family(rnd, 150, edits, 4)]
    texts += ["one two three four five six seven eight", "one two three four five six seven eight nine", "a b", "a b c", " ".join(["x y z u v"] * 400 + ["p q r s t o"]), " ".join(["x y z u v"] * 400 + ["k l m n h g f e"])]
    rnd.shuffle(texts)
    want, seen = plain(texts)
    assert sum(0.7 <= x < 0.8 for x in seen) > 40 and sum(0.8 <= x < 0.9 for x in seen) > 40
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.filter_docs(df).collect()) == want
    monkeypatch.setattr(simhash, "PART_SHINGLES", 256)
    assert sorted(r.doc_id for r in simhash.filter_docs(df).collect()) == want


def test_similar():
    rnd = random.Random(6)
    texts = [t for edits in (1, 3, 5, 7) for t in family(rnd, 60, edits, 8)]
    sets = [simhash.shingle_set(t.encode(), 5) for t in texts]
    root = list(range(len(texts)))
    for i, j in simhash.similar(sets):
        assert 5 * len(np.intersect1d(sets[i], sets[j])) >= 4 * len(np.union1d(sets[i], sets[j])) and root[i] != root[j]
        root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert sorted(set(root)) == plain(texts)[0]
