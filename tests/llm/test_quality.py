import math
import random
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from segmill.llm import quality


def corpus():
    rnd = random.Random(4)
    vocab = ["".join(rnd.choice("aeioutnrsl") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(600):
        words = [rnd.choice(vocab) for _ in range(rnd.randrange(20, 200))]
        bad = i % 7 == 0
        if bad:
            words = [w + "%%%" for w in words] if i % 2 else [words[0]] * len(words)
        rows.append((i, " ".join(words), "x"))
        if i % 2:
            labels.append((i, 0 if bad else 1, 0))
    return rows, labels


def chosen(rows, labels, ratio):
    """Ids that are kept, as it is defined: threshold, k, keys, the k largest."""
    weight = [float(np.mean(ratio[g])) if len(g := quality.ngrams(t or "")) else 0.0 for _, t, _ in rows]
    of = {}
    for (i, _, _), w in zip(rows, weight, strict=True):
        of[i] = max(w, of.get(i, w))
    good, bad = ([of[i] for i, q, _ in labels if q == k] for k in (1, 0))
    cuts = sorted(set(good + bad))
    errors = [sum(g < c for g in good) / len(good) + sum(b >= c for b in bad) / len(bad) for c in cuts]
    best = min(range(len(cuts)), key=lambda n: errors[n])
    cut = (cuts[best] + cuts[best - 1]) / 2 if best else cuts[0]
    keys = []
    for (i, t, _), w in zip(rows, weight, strict=True):
        u = ((xxhash.xxh64_intdigest(str(i) if i is not None else f"?{t or ''}", 0) >> 11) + 0.5) / 2**53
        keys.append((w / quality.TEMPERATURE - math.log(-math.log(u)), i))
    k = sum(w >= cut for w in weight)
    least = sorted((x for x, _ in keys), reverse=True)[k - 1]
    return [i for x, i in keys if x >= least - 1e-9]


def test_against_brute_force(spark):
    rows, labels = corpus()
    rows += [(None, "what a text", "x"), (None, None, "x"), (1000, "", "x"), rows[5], rows[5]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, log_weight string").repartition(3)
    marks = spark.createDataFrame(labels + [(None, 1, 0), (7, None, 0), (9999, 1, 0), labels[0]], "doc_id long, quality int, toxic int")
    ratio = quality.fit(docs, marks)
    raw, target, good = Counter(), Counter(), {i for i, q, _ in labels if q}
    for i, t, _ in rows:
        g = Counter(quality.ngrams(t or "").tolist())
        raw += g
        target += g if i in good else Counter()
    for part in (range(quality.WORD_BUCKETS), range(quality.WORD_BUCKETS, quality.BUCKETS)):
        nt, nr = sum(target[b] for b in part) + len(part), sum(raw[b] for b in part) + len(part)
        for b in [*part][::97] + [b for b in raw if b in part][:200]:
            assert math.isclose(ratio[b], math.log((target[b] + 1) / nt) - math.log((raw[b] + 1) / nr), abs_tol=1e-9)
    kept = quality.resample(docs, marks).collect()
    ids = Counter(r.doc_id for r in kept)
    bad = {i for i in range(0, 600, 7)}
    assert len(bad & set(ids)) <= 2 and len(set(range(600)) - bad - set(ids)) <= 5
    assert ids[5] in (0, 3)
    for r in kept:
        if r.doc_id is not None and r.doc_id < 600:
            assert abs(r.log_weight - float(np.mean(ratio[quality.ngrams(rows[r.doc_id][1])]))) < 1e-9
    assert ids == Counter(chosen(rows, labels, ratio))
    wide = docs.withColumns({"gumbel_key": F.lit("g"), "key_order": F.lit(None).cast("int"), "__id": F.lit(1.5), "__0": F.lit("0")})
    full = quality.filter_docs(spark, wide, marks)
    assert full.dtypes == wide.dtypes and Counter(r.doc_id for r in full.collect()) == ids
    assert {tuple(r)[2:] for r in full.collect()} <= {("x", "g", None, 1.5, "0")}


def test_noise_and_kth(spark):
    rows, labels = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string")
    w = quality.weigh(docs, np.zeros(quality.BUCKETS), ["doc_id"])
    keys = sorted(((r.key_order, r.gumbel_key) for r in w.collect()), reverse=True)
    assert [k for k, _ in keys] == sorted((k for k, _ in keys), reverse=True) and sorted((g for _, g in keys), reverse=True) == [g for _, g in keys]
    assert abs(np.mean([g for _, g in keys]) - 0.5772) < 0.2
    for k in (1, 2, 300, 600):
        assert quality.kth_largest(w, "key_order", k) == keys[k - 1][0]
    assert quality.kth_largest(w, "key_order", 601) is None


def test_without_rows_or_labels(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.resample(docs, none).count() == 2
    assert quality.resample(docs.limit(0), none.union(spark.createDataFrame([(1, 1)], none.schema))).count() == 0
    assert quality.filter_docs(spark, docs, none).where(F.col("doc_id") == 2).count() == 1


def test_all_labels_count(spark):
    """More labelled rows than were once sampled of a class, by broadcast and by a join."""
    rnd = random.Random(5)
    vocab = ["".join(rnd.choice("aeioutnrsl") for _ in range(rnd.randrange(2, 8))) for _ in range(300)]
    rows = [(i, " ".join(rnd.choice(vocab) for _ in range(3))) for i in range(24_000)] + [(None, "a text"), (None, None), (3, "one id, two texts")]
    labels = [(i, 0 if i % 50 == 0 else 1) for i in range(24_000)] + [(None, 1), (5, None), (1, 1), (99_999, 1)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int")
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for i, t in rows:
        c = np.bincount(quality.ngrams(t or ""), minlength=quality.BUCKETS)
        raw += c
        target += c if i is not None and i % 50 else 0
    words = slice(0, quality.WORD_BUCKETS)
    want = [np.log((x[words] + 1) / (x[words].sum() + quality.WORD_BUCKETS)) for x in (target, raw)]
    ratio = quality.fit(docs, marks)
    assert np.allclose(ratio[words], want[0] - want[1], rtol=0, atol=1e-12)
    assert (quality.fit(docs, marks, most=10) == ratio).all()


def test_threshold_of_all_labels(spark):
    """Weights whose best cut few rows decide, with ties, ids of two rows and zeros of both signs."""
    rnd = np.random.default_rng(3)
    for n, scale in ((60_000, 1), (700, 1), (700, 0.01)):
        label = rnd.random(n) < 0.7
        w = np.round(rnd.normal(label * 0.1, 1), 4) * scale
        rows = [(i, float(x)) for i, x in enumerate(w)] + [(0, 9.0), (1, -9.0), (None, 0.5), (n + 5, 0.0), (n + 6, -0.0)]
        labels = [(i, int(x)) for i, x in enumerate(label)] + [(n + 5, 1), (n + 6, 0), (7, 1), (7, 0), (-1, 1), (None, 0)]
        of = {}
        for i, x in rows:
            of[i] = max(x, of.get(i, x))
        good, bad = (np.sort([of[i] for i in {i for i, q in labels if q == k} if i in of and i is not None]) for k in (1, 0))
        cuts = np.unique(np.concatenate([good, bad]))
        best = int(np.argmin(np.searchsorted(good, cuts) * len(bad) - np.searchsorted(bad, cuts) * len(good)))
        frame, marks = spark.createDataFrame(rows, "doc_id long, log_weight double"), spark.createDataFrame(labels, "doc_id long, quality int")
        assert quality.threshold(frame, marks) == ((cuts[best] + cuts[best - 1]) / 2 if best else cuts[0])
    assert quality.threshold(frame, marks.where("quality = 1")) == float("-inf")
