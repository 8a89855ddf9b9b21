import random
import re

import numpy as np
import pyarrow as pa
import pytest

from segmill.llm import blocks, lines


def plain(rows, least=1):
    """rows in order: (id, n_lines, removed, kept) by comparing each line with all before it."""
    seen, out = [], []
    for i, t in rows:
        ls, removed = (t or "").split("\n"), []
        for n, line in enumerate(ls):
            w = set(line.encode().lower().split())
            if len(w) < least:
                continue
            if any(5 * len(w & v) >= 4 * len(w | v) for v in seen):
                removed.append(n)
            seen.append(w)
        out.append((i, len(ls), removed, "\n".join(x for n, x in enumerate(ls) if n not in removed)))
    return out


def corpus(seed, n=150):
    rnd = random.Random(seed)
    common, rare = [f"c{i}" for i in range(8)], [f"Wé{i}" for i in range(500)]
    word = lambda: rnd.choice(common if rnd.random() < 0.5 else rare)
    pool = [[word() for _ in range(rnd.randrange(1, 40))] for _ in range(40)]
    texts = [None, "", "\n", "a b\nB a\na\n a b c\na b c d\na b c d e\na b c d e f", "\u65e5\u672c\u8a9e\nx\n\u65e5\u672c\u8a9e", "a b c d e\nd c b a", "a b c d e\n\na b c d e", "x" * 6000 + " p q r s", "X" * 6000 + " p q r s\n", " ".join(rare * 9)]
    for _ in range(n):
        ls = []
        for _ in range(rnd.randrange(1, 9)):
            line = list(rnd.choice(pool)) if rnd.random() < 0.5 else [word() for _ in range(rnd.randrange(0, 40))]
            for _ in range(rnd.randrange(0, 4)):
                if line:
                    line[rnd.randrange(len(line))] = word()
            rnd.shuffle(line)
            ls.append(rnd.choice([" ", "  ", "\t", "\r"]).join(line))
        texts.append("\n".join(ls))
    return list(zip(rnd.sample(range(-50, 1000), len(texts)), texts, strict=True))


@pytest.mark.parametrize(("block_bytes", "pivots", "least"), [(3000, 2, 1), (1 << 20, 32, 1), (3000, 32, 5)])
def test_equals_brute_force(spark, monkeypatch, block_bytes, pivots, least):
    monkeypatch.setattr(lines, "_FAN_IN", 2)
    monkeypatch.setattr(lines, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(blocks, "_CHUNK", 900)
    monkeypatch.setattr(lines, "PIVOTS", pivots)
    rows = corpus(block_bytes)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, kept string")
    got = {r.doc_id: tuple(r) for r in lines.remove_lines(df, min_words=least).collect()}
    want = plain(sorted(rows), least)
    assert len(got) == len(rows) and sum(len(w[2]) for w in want) > 100
    assert [got[w[0]] for w in want] == want


def test_nulls_repeats_none(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (1, "f e d c b A\nz"), (1, "f e d c b A\nz"), (2, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_lines, r.removed, r.kept) for r in lines.remove_lines(df).collect()), key=str)
    assert got == sorted([(None, 1, [], "a b c d e f"), (1, 2, [0], "z"), (1, 2, [0, 1], ""), (2, 1, [], "")], key=str)
    assert lines.remove_lines(df.limit(0)).count() == 0


@pytest.mark.parametrize("large", [3, 1000])
def test_filters_lose_nothing(monkeypatch, large):
    monkeypatch.setattr(lines, "LARGE", large)
    rnd = np.random.default_rng(5)
    sets = [set(rnd.choice(60, rnd.integers(5, 25), replace=False).tolist()) for _ in range(150)]
    sets += [s ^ {int(rnd.integers(60))} for s in sets]
    rows = []
    for n, s in enumerate(sets):
        o, size = sorted(s), len(s)
        sig = np.bitwise_xor.reduce(np.uint64(1) << np.array(o, np.uint64))
        rows += [(sig, 0, w, n, size, i) for i, w in enumerate(o[: size - (-(-4 * size // 5)) + 1])]
    rows = np.array(rows, lines._PREFIX)
    at, named = rows["line"].astype(np.int64), lambda a, b: list(zip(rows["line"][a].tolist(), rows["line"][b].tolist(), strict=True))
    a, b, _ = lines.candidates(rows, at, np.ones(len(rows), bool), 1, None)
    got = set(named(a, b))
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert want and want <= got
    # the first round: one pair a line, and what it does not see is cut short
    a, b, cut = lines.candidates(rows, at, None, 3, 2)
    near = named(a, b)
    assert np.bincount(a).max() <= 2 and set(near) <= got
    for nearest, seen in ((4, (2, 0)), (None, (4, 4))):
        mask = np.zeros(len(rows), bool)
        mask[cut] = True
        a, b, cut = lines.candidates(rows, at, mask, 3, nearest, seen)
        near += named(a, b)
    assert want <= set(near) <= got and not len(cut)


def test_rows_round_trip():
    rnd = np.random.default_rng(6)
    for n in (0, 1, 500):
        rows = np.zeros(n, lines._PREFIX)
        for name in rows.dtype.names:
            rows[name] = rnd.integers(0, 1 << 16, n)
        rows["sig2"][rows["n"] <= lines.LONG] = 0
        rows["line"] = np.sort(rnd.integers(0, 1 << 31, n)).astype(np.uint32)[::-1]
        assert (lines._decoded(lines._encoded(rows)) == rows).all()


def test_words_of_a_block():
    """Words by eights of bytes: texts that end in a word, words of all lengths, null bytes, empty texts."""
    rnd = random.Random(8)
    some = [b"a", b"A", b"Zz", b" ", b"\n", b"\t", b"\x0b", b"\x00", b"\x0e", b"\x08", b"[", b"@", "é".encode(), b"longerwordhere", b"x" * 255, b"y" * 300]
    for _ in range(200):
        texts = [b"".join(rnd.choice(some) for _ in range(rnd.randrange(0, 50))) for _ in range(rnd.randrange(1, 7))]
        ends = np.cumsum([len(x) for x in texts]).astype(np.int64).tobytes()
        uniq, line, word, has, first = lines._read(pa.scalar(ends, pa.binary()), pa.scalar(blocks._codec().compress(b"".join(texts), asbytes=True), pa.binary())).words()
        want = [set(re.sub(rb"[A-Z]", lambda m: m[0].lower(), x).split()) for t in texts for x in t.split(b"\n")]
        assert len(uniq) == len(set().union(*want)) == len(np.unique(uniq))
        assert has.tolist() == [n for n, w in enumerate(want) if w] and line[first].tolist() == has.tolist()
        got = {n: set(word[line == n].tolist()) for n in has.tolist()}
        assert all(len(got[n]) == len(want[n]) == (line == n).sum() for n in got)
        assert all(len(got[n] & got[m]) == len(want[n] & want[m]) for n in got for m in got)


def test_hashes_go_by_bytes_only():
    """The same words at other places and beside other bytes hash alike, words of other lengths or last bytes do not."""
    words = [b"a", b"a\x00", b"\x00a", b"abcdefgh", b"abcdefgh\x00", b"abcdefghabcdefgh", b"abcdefghabcdefgi", b"q" * 256, b"q" * 257, b"q" * 258]
    seen = []
    for shift in range(9):
        text = b"z" * shift + b"!".join(words)
        starts = shift + np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        low = np.zeros((len(text) + 23) // 8 * 8, np.uint8)
        low[: len(text)] = np.frombuffer(text, np.uint8)
        seen.append(lines._hashes(low, starts, starts + [len(w) for w in words]).tolist())
    assert all(x == seen[0] for x in seen) and len(set(seen[0])) == len(words)


def test_blocks_move_compressed(spark):
    """What the JVM and the disk hold of a block is compressed; the texts come back whole."""
    docs = spark.createDataFrame([(i, "the same words again and again " * 50) for i in range(40)] + [(41, None)], "doc_id long, text string")
    packed = blocks.pack(docs, "doc_id", "text", ["doc_id"], 1 << 14, squeezed=True).collect()
    assert all(len(r.data) < r["size"] / 10 for r in packed if r["size"])
    assert sum(len(blocks.unsqueezed(bytes(r.ends), pa.scalar(bytes(r.data), pa.binary()))) for r in packed) == 40 * 31 * 50
