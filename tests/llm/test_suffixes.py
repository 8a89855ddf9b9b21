import random

import numpy as np
import pyarrow as pa
import pytest

from segmill.llm import blocks, suffixes


def plain(rows, window):
    """rows in order of id: spans of each by a set of all earlier windows."""
    seen, out = set(), []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - window + 1):
            w = b[p : p + window]
            if w in seen:
                gone[p : p + window] = True
            seen.add(w)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append((i, len(b), [tuple(x) for x in edges.reshape(-1, 2).tolist()], bytes(np.frombuffer(b, np.uint8)[~gone])))
    return out


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randrange(10, 60))) for _ in range(12)]
    texts = ["", None, "x" * 1000, "ab" * 400, "short", "short", "x" * 99, "x" * 99, "é" * 300]
    for _ in range(120):
        t = " ".join(word() for _ in range(rnd.randrange(0, 120)))
        for _ in range(rnd.randrange(0, 4)):
            at, p = rnd.randrange(len(t) + 1), rnd.choice(passages)
            cut = rnd.randrange(len(p))
            t = t[:at] + (p if rnd.random() < 0.6 else p[cut : cut + 130]) + t[at:]
        texts.append(t)
        if rnd.random() < 0.15:
            texts.append(t)
    ids = rnd.sample(range(-50, 1000), len(texts))
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize(("block_bytes", "window", "hot"), [(2000, 100, 100_000), (300, 57, 100_000), (2000, 100, 2), (1 << 20, 130, 0)])
def test_equals_brute_force(spark, monkeypatch, block_bytes, window, hot):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", block_bytes)
    rows = corpus(block_bytes) + [(None, "n" * 250)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in suffixes.remove_repeats(df, window=window, hot=hot).collect()}
    want = plain(sorted(rows, key=lambda r: (r[0] is not None, r[0])), window)
    assert len(got) == len(rows) and sum(len(w[2]) for w in want) > 60
    assert [got[w[0]] for w in want] == want


def test_repeated_rows_and_none(spark):
    df = spark.createDataFrame([(1, "y" + "abc" * 50), (1, "y" + "abc" * 50), (2, "z")], "doc_id long, text string")
    got = sorted((r.doc_id, len(r.kept)) for r in suffixes.remove_repeats(df).collect())
    assert got == [(1, 0), (1, 4), (2, 1)]
    assert suffixes.remove_repeats(df.limit(0)).count() == 0


@pytest.mark.parametrize(("size", "hot", "part", "chunk"), [(3000, 100_000, 7, 333), (50_000, 1, 5, 1000), (700, 3, 64, 131072), (9000, 0, 3, 150)])
def test_blocks_answer_each_other(monkeypatch, size, hot, part, chunk):
    """What blocks send and are answered, without Spark, in the smallest pieces."""
    for name, x in (("_PART", part), ("_CHUNK", chunk)):
        monkeypatch.setattr(suffixes, name, x)
    monkeypatch.setattr(blocks, "_CHUNK", 700)
    rows = sorted(((i, t) for i, t in corpus(size) if i is not None), key=lambda r: r[0])
    held, bs = [], []
    for i, t in [*rows, (None, None)]:
        if held and (i is None or sum(len(x) for x in held) > size):
            bs.append(suffixes._Block(np.cumsum([len(x) for x in held]).astype(np.int64).tobytes(), b"".join(held), None, 100))
            held = []
        held.append((t or "").encode())
    counts = [b.counted(4) for b in bs]
    ties = [[] for _ in bs]
    for bucket in range(16):
        sent = [(k, c[0][c[0] >> np.uint64(32) == bucket].astype(np.uint32), c[1][c[0] >> np.uint64(32) == bucket]) for k, c in enumerate(counts)]
        sent = [(k, np.array(list(zip(h.tolist(), n.tolist(), strict=True)), suffixes._COUNT)) for k, h, n in sent if len(h)]
        for (k, _), f in zip(sent, suffixes.tied_beginnings([a for _, a in sent], hot) if sent else [], strict=True):
            if f is not None:
                ties[k].append({"bucket": bucket, "bits": np.packbits(f, bitorder="little").tobytes()})
    parts = [b.parts(4, 4, t) for b, t in zip(bs, ties, strict=True)]
    table = pa.Table.from_batches([r for k, p in enumerate(parts) for r in p.rows(k)])
    answers = [[] for _ in bs]
    for bucket in set(table.column("bucket").to_pylist()):
        for r in suffixes._later(100)(table.filter(pa.compute.equal(table.column("bucket"), bucket))).to_pylist():
            answers[r["block"]].append(r)
    seen = set()
    for b, p, a in zip(bs, parts, answers, strict=True):
        want = []
        for s, e in zip(b.s.tolist(), b.e.tolist(), strict=True):
            for i in range(s, e - 99):
                w = bytes(b.data[i : i + 100])
                if w in seen:
                    want.append(i)
                seen.add(w)
        assert p.gone(a).tolist() == want


@pytest.mark.parametrize("letters", ["a", "ab", "abcdefgh"])
def test_sample(monkeypatch, letters):
    """Each window within a document has one sample suffix, which it holds, and equal windows have it at the same shift."""
    monkeypatch.setattr(suffixes, "_CHUNK", 333)
    rnd = random.Random(8)
    piece = "".join(rnd.choice(letters) for _ in range(400))
    docs = [("x" * rnd.randrange(300) + piece[rnd.randrange(100) :] + "y" * rnd.randrange(9)).encode() for _ in range(12)] + [b"", b"short"]
    ends = np.cumsum([len(d) for d in docs])
    b = suffixes._Block(ends.astype(np.int64).tobytes(), b"".join(docs), None, 100)
    of = {}
    for at, lo, hi in zip(b.at.tolist(), b.lo.tolist(), b.hi.tolist(), strict=True):
        assert 0 <= lo <= hi < suffixes.SPAN
        for k in range(lo, hi + 1):
            assert of.setdefault(at - k, k) == k and (at - k, k) not in of
    starts = [s + p for s, d in zip(ends - [len(d) for d in docs], docs, strict=True) for p in range(len(d) - 99)]
    assert sorted(of) == starts
    shift = {}
    for p in starts:
        assert shift.setdefault(bytes(b.data[p : p + 100]), of[p]) == of[p]
