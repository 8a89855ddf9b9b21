import json

from segmill.streaming import incremental


def test_batches(spark, tmp_path):
    memory = spark.createDataFrame([("a 1", "A 1", 1), ("b 2", "B", 2)], "src string, dst string, line_no int")
    (tmp_path / "in").mkdir()
    for n, rows in enumerate([[(0, "a 1"), (1, "b 2")], [(2, "zzz")]]):
        (tmp_path / f"in/{n}.json").write_text("".join(json.dumps({"segment_id": i, "source": s}) + "\n" for i, s in rows))
        incremental.run(spark, f"{tmp_path}/in", memory, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(60)
    got = {r.segment_id: (r.batch, r.translation, r.is_hit, r.is_valid, r.issues) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {0: (0, "A 1", True, True, 0), 1: (0, "B", True, True, 1), 2: (1, "zzz", False, True, 0)}
