import random

from pyspark.sql import functions as F

from segmill.llm import decontam


def plain_tiles(doc, item, size):
    """Greedy string tiling as it is defined: look for the longest match of unmarked words, mark it, again."""
    md, mi, out = set(), set(), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and i + n not in md and j + n not in mi:
                    n += 1
                if n >= size and (best is None or n > best[0]):
                    best = (n, j, i)
        if best is None:
            return out
        n, j, i = best
        md.update(range(i, i + n))
        mi.update(range(j, j + n))
        out.append((i, j, n))


def test_tiles_equal_definition():
    rnd = random.Random(6)
    for _ in range(300):
        letters = [b"a", b"b", b"c", b"d"][: rnd.randrange(2, 5)]
        doc, item = ([rnd.choice(letters) for _ in range(rnd.randrange(0, 40))] for _ in range(2))
        size = rnd.randrange(2, 5)
        assert sorted(decontam.tiles(doc, item, size)) == sorted(plain_tiles(doc, item, size))


def test_frames(spark):
    rnd = random.Random(7)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: [rnd.choice(vocab) for _ in range(n)]
    items = [(k, text(rnd.randrange(12, 40))) for k in range(30)] + [(90, text(3)), (91, []), (None, text(20))]
    docs = []
    for i in range(150):
        w = text(rnd.randrange(0, 200))
        for _, passage in rnd.sample(items, 2):
            cut = len(passage) // 2
            form = rnd.randrange(5)
            part = [passage, passage[cut:] + w[:3] + passage[:cut], passage[: cut - 2], passage[::2], [p.upper() + "," for p in passage]][form]
            at = rnd.randrange(len(w) + 1)
            w = w[:at] + part + w[at:]
        docs.append((i, " ".join(w), "x"))
    docs += [(None, None, "x"), (500, "", "x"), docs[0], (None, docs[1][1], "y"), (501, " ".join(items[0][1] * 3000), "z"), (502, " ".join(items[30][1]).upper() + "!", "z"), (503, " ".join(items[30][1][:2]), "z")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(k, " ".join(p)) for k, p in [*items, items[0]]] + [(95, None)], "item_id long, text string")
    key = lambda r: tuple(str(x) for x in r)
    got = sorted(((r.doc_id, r.item_id, r.matched_words, r.n_tiles) for r in decontam.leaks(df, bench).collect()), key=key)
    want = []
    for i, t, _ in docs:
        for k, p in items:
            tl = (plain_tiles if len(t or "") < 10_000 else decontam.tiles)(decontam.words_of(t), decontam.words_of(" ".join(p)), 4)
            n = sum(x[2] for x in tl)
            if 0 < len(p) < 4 and decontam.words_of(t) == decontam.words_of(" ".join(p)):
                n, tl = len(p), [0]
            if p and n / len(p) >= 0.5:
                want.append((i, k, n, len(tl)))
    assert len(want) > 100 and got == sorted(want, key=key)
    leaked = {(w[0]) for w in want}
    assert 502 in leaked and 503 not in leaked
    wide = df.withColumns({"__hash": F.lit("h"), "__id": F.col("doc_id"), "text_hash": F.lit(1.5), "bad": F.lit(None).cast("int"), "id": F.lit("i")})
    clean = decontam.filter_docs(wide, bench)
    assert clean.dtypes == wide.dtypes and {tuple(r)[3:] for r in clean.collect()} == {("h", i, 1.5, None, "i") for i in {r.doc_id for r in clean.collect()}}
    assert sorted((r.doc_id for r in clean.collect()), key=str) == sorted((d[0] for d in docs if d[0] is not None and d[0] not in leaked or d[0] is None and d[1] is None), key=str)
    assert decontam.leaks(df.limit(0), bench).count() == 0 and decontam.leaks(df, bench.limit(0)).count() == 0


def test_common_phrases(spark):
    """A phrase of all items and documents costs no pairs; whole passages are found beside it."""
    phrase = "what is the answer to the question "
    items = [(k, phrase + " ".join(f"i{k}x{n}" for n in range(12))) for k in range(40)]
    docs = [(k, phrase * 3 + (items[k][1] if k % 2 else "nothing else")) for k in range(40)]
    got = decontam.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, k) for k in range(1, 40, 2)]
