import random
import re

import numpy as np
import xxhash

from segmill.llm import common, simhash


def plain_fp(text, width=4):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    p = list(range(len(fps)))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                p[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def texts(rnd, n):
    words = [f"w{i}É" for i in range(50)] + ["The", "of\x85x"]
    out = [None, "", "  \t\n", "one", "One", "one two", "a b c d", "x" * 5000, "long " * 5000]
    for _ in range(n):
        t = [rnd.choice(words) for _ in range(rnd.randrange(1, 120))]
        out.append(" ".join(t))
        for _ in range(rnd.randrange(3)):
            t[rnd.randrange(len(t))] = "edit"
            out.append("  ".join(t))
    return out


def test_fingerprints():
    for t in texts(random.Random(3), 40):
        assert simhash.fingerprint((t or "").encode(), 4).tolist() == [plain_fp(t)]
        assert int(simhash.fingerprint((t or "").encode(), 4, 3)[0]) == plain_fp(t)


def test_forest_connects_what_links_connect(monkeypatch):
    rnd = np.random.default_rng(0)
    monkeypatch.setattr(simhash, "_ROWS", 7)
    monkeypatch.setattr(simhash, "_COLS", 11)
    base = rnd.integers(0, 2**64, 40, np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rnd.integers(0, 64, (400, 4), np.uint64), axis=1)
    fps = np.unique(np.concatenate([base, rnd.choice(base, 400) ^ flips]))
    want = plain_components([int(x) for x in fps], 4)
    fps = fps[np.lexsort((fps, simhash._order(simhash.counts(fps))))]
    def links(a, b=None):
        u, v = simhash.forest(a[:, None], None if b is None else b[:, None], 4)
        nodes = a if b is None else np.concatenate([a, b])
        return nodes[u], nodes[v]

    a, b = fps[::2], fps[1::2]
    for edges in ([links(fps)], [links(a, b), links(a), links(b)]):
        root = {int(x): int(x) for x in fps}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for s, t in edges:
            for x, y in zip(s.tolist(), t.tolist(), strict=True):
                root[find(x)] = find(y)
        groups = {}
        for x in sorted(root):
            groups.setdefault(find(x), set()).add(x)
        again = {}
        for x, k in zip(np.unique(fps).tolist(), want, strict=True):
            again.setdefault(k, set()).add(x)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, again.values()))


def test_frames(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 16)
    monkeypatch.setattr(simhash, "TILE_MOST", 16)
    monkeypatch.setattr(common, "HOT_LEAST", 1)
    rows = [(i * 3 % 1009 if i % 37 else None, t, "x") for i, t in enumerate(texts(random.Random(5), 60))]
    rows += rows[:5]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()
    fps = [plain_fp(t) for _, t, _ in rows]
    comp = plain_components(fps, 4)
    least = {}
    for (i, _, _), c in zip(rows, comp, strict=True):
        least[c] = min([x for x in (least.get(c), i) if x is not None], default=None)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((i, f - 2**64 if f >> 63 else f, least[c]) for (i, _, _), f, c in zip(rows, fps, comp, strict=True)), key=key)
    assert sorted(map(tuple, out), key=key) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_filter_docs(spark):
    rnd = random.Random(8)
    words = [f"w{i}" for i in range(900)]
    rows, groups = [], []
    for g in range(60):
        t = [rnd.choice(words) for _ in range(rnd.randrange(150, 400))]
        for c in range(rnd.randrange(1, 4)):
            s = list(t)
            if c:
                s[rnd.randrange(len(s))] = "edit"
            rows.append((len(rows), " ".join(s), "x", 1))
            groups.append(g)
    first = {g: i for i, g in reversed(list(enumerate(groups)))}
    more = [(None, rows[0][1], "y", 2), rows[-1], (900, None, "e", 0), (901, "  ", "e", 0), (None, "only here " * 9, "z", 3)]
    df = spark.createDataFrame(rows + more, "doc_id long, text string, fp string, row int")
    out = simhash.filter_docs(df)
    assert out.schema == df.schema
    assert sorted((r.doc_id for r in out.collect()), key=str) == sorted([*first.values(), 900, None], key=str)
    assert simhash.filter_docs(df.limit(0)).count() == 0
