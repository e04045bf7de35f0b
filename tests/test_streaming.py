"""Incremental indexing of file versions."""

from lodestone.streaming.incremental import latest_chunks, start

SCHEMA = "path string, length long, content binary, error string, version long"


def test_newest_versions_count(spark, tmp_path):
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def arrive(rows):
        spark.createDataFrame([(p, len(t), t.encode(), None, v) for p, t, v in rows], SCHEMA).coalesce(1).write.mode("append").parquet(source)
        query = start(spark.readStream.schema(SCHEMA).parquet(source), out, checkpoint, available_now=True)
        query.awaitTermination(120)
        assert query.exception() is None
        return {(r["file_path"], r["full_name"]) for r in latest_chunks(spark, out).collect()}

    assert arrive([("a.py", "def one():\n    pass\n", 1), ("a.py", "def two():\n    pass\n", 2), ("b.py", "def x():\n    pass\n", 1)]) == {("a.py", "two"), ("b.py", "x")}
    assert arrive([("b.py", "class Y:\n    pass\n", 2), ("c.go", "package p\n\nfunc F() {}\n", 1)]) == {("a.py", "two"), ("b.py", "Y"), ("c.go", "F")}
    assert arrive([("a.py", "def broken(:\n", 3)]) == {("b.py", "Y"), ("c.go", "F")}
