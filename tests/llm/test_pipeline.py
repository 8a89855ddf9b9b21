"""Each stage on what the one before it kept, against what brute force says."""

import random

import corpus_pipeline
from test_decontam import plain_tiles
from test_lines import plain as plain_lines

from segmill.llm import decontam
from segmill.llm.common import materialize


def tables(spark, path):
    rnd = random.Random(11)
    vocab = ["".join(rnd.choice("aeioutnrslm") for _ in range(rnd.randrange(2, 9))) for _ in range(1500)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(rnd.randrange(15, 30))) for k in range(12)]
    docs, labels = [], []
    for i in range(300):
        kind = i % 10
        lines = [text(rnd.randrange(8, 30)) + "." for _ in range(rnd.randrange(1, 8))]
        if kind == 1:
            lines = [" ".join(w + "%%%" for w in x.split()) for x in lines]
        if kind == 2:
            lines.append(items[i // 10 % 12][1])
        if kind == 3:
            lines = docs[-3][1].split("\n") + ["and then " + text(6)]
        if kind == 4:
            lines = docs[-4][1].split("\n")
        docs.append((i, "\n".join(lines), "en", f"src{i % 7}"))
        if i % 2 or kind in (2, 4):
            labels.append((i, 0 if kind == 1 else 1, 0))
    docs += [(900, "", "en", "s"), (901, None, None, None), (902, "only short line", "en", "s"), docs[7]]
    frame = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return {d[0] for i, d in enumerate(docs[:300]) if i % 10 == 1}, items


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, tmp_path):
    junk, items = tables(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names, seen = docs.columns, [sorted(docs.collect(), key=str)]
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = materialize(stage(spark, docs, str(tmp_path)), "test")
        assert n == 4 or docs.columns == names
        seen.append(sorted(docs.collect(), key=str))
    start, good, lines, near, clean, tokens = seen
    # quality: junk goes, all else stays as it was
    assert [r for r in start if r.doc_id not in junk] == good
    # lines: what stays of each text, by comparing all lines; emptied texts go
    want = plain_lines(sorted(((r.doc_id, r.text) for r in good), key=lambda x: x[0]))
    kept = sorted((i, t) for i, _, gone, t in want if not gone or t.strip())
    assert sorted((r.doc_id, r.text or "") for r in lines) == kept
    assert all(r.n_chars == len(r.text or "") for r in lines)
    # near-duplicates: one of each group stays, the smallest; what is not alike stays
    left = {r.doc_id for r in near}
    alike = lambda a, b: len(a & b) / len(a | b)
    sets = [(r.doc_id, shingles(r.text)) for r in lines]
    for i, a in sets:
        most = max((alike(a, b) for j, b in sets if j < i), default=0)
        assert (i not in left) if most >= 0.85 else most >= 0.5 or i in left
    # benchmark: no item over half covered
    leaked = {r.doc_id for r in near for _, p in items if sum(t[2] for t in plain_tiles(decontam.words_of(r.text), decontam.words_of(p), 4)) >= 0.5 * len(p.split())}
    assert leaked and {r.doc_id for r in clean} == left - leaked
    assert all(r.round_trip for r in tokens) and {r.doc_id for r in tokens} == {r.doc_id for r in clean}
    assert spark.read.parquet(f"{tmp_path}/documents.parquet").count() == len(start)


def test_run_equals_stages(spark, tmp_path):
    tables(spark, tmp_path)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and all(r.round_trip and r.n_tokens == len(r.token_ids) for r in out)
