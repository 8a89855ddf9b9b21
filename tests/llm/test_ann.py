import math

import numpy as np
from pyspark.sql import functions as F

from segmill.llm import ann


def scaled(v):
    """A vector times a power of two, so that its squares are in range."""
    e = math.frexp(max(map(abs, v)))[1]
    return [math.ldexp(x, -e) for x in v]


def plain(rows, every, k):
    good = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            good.setdefault((i, tuple(v)), None)
    out = {}
    for q, a in good:
        if q % every:
            continue
        hits = []
        for c, b in good:
            if c != q and len(a) == len(b):
                a, b = scaled(a), scaled(b)
                dot = lambda x, y: sum(p * r for p, r in zip(x, y, strict=True))
                hits.append((-max(-1.0, min(1.0, dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)))), c))
        out.setdefault(q, []).extend(hits)
    return sorted((q, n + 1, c, -s) for q, hits in out.items() for n, (s, c) in enumerate(sorted(hits)[:k]))


def test_bounds_hold():
    rnd = np.random.default_rng(1)
    v = rnd.normal(size=(300, 16)) * rnd.lognormal(size=(300, 1))
    q = ann.quantise(v[:50])
    c = ann.quantise(v)
    i, j, low, high = ann.tile_survivors(q, c, 4)
    cos = (v[i] * v[j]).sum(1) / np.linalg.norm(v[i], axis=1) / np.linalg.norm(v[j], axis=1)
    assert (low <= cos).all() and (cos <= high).all()
    assert len(i) < 50 * 300 / 4


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(ann, "CANDIDATES", 40)
    monkeypatch.setattr(ann, "QUERIES", 8)
    rnd = np.random.default_rng(2)
    rows = [(int(i), [float(np.float32(x)) for x in rnd.normal(size=8)]) for i in rnd.permutation(200)]
    hot = rows[0][1]
    rows += [(i, hot) for i in range(300, 360)] + [(400, [2 * x for x in hot]), (410, [-x for x in hot])]
    rows += [(None, hot), (420, None), (430, [0.0] * 8), (440, [float("nan")] * 8), (450, [None, 1.0]), (460, [float("inf")] * 8), (470, []), (480, [1.0, 2.0, 3.0]), (300, hot)]
    tiny, huge = [x * 2.0**-830 for x in rows[3][1]], [x * 2.0**830 for x in rows[4][1]]
    rows += [(500, rows[1][1]), (500, rows[2][1]), (503, tiny), (510, tiny), (513, huge), (520, huge), (530, [5e-324] + [0.0] * 7), (533, [-5e-324] + [0.0] * 7)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, ann.nearest(df, F.col("vec_id") % 10 == 0).collect()))
    want = plain(rows, 10, 5)
    assert [(a, b, c) for a, b, c, _ in got] == [(a, b, c) for a, b, c, _ in want]
    assert np.allclose([x[3] for x in got], [x[3] for x in want], atol=1e-12, rtol=0)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0
