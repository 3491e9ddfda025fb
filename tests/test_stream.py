"""Paths that arrive as files are appended once."""

from braidgraph.streaming import ingest


def test_append_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.txt").write_text("P\tp1\t1+,2-\t*\nS\t1\tA\n")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "table"), str(tmp_path / "ck"))

    def run():
        q = ingest.append_stream(*args)
        q.processAllAvailable()
        q.stop()
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "table")).collect()))

    assert run() == [("p1", 0, 1), ("p1", 1, -2)]
    (tmp_path / "in/b.txt").write_text("P\tp1\t9+\t*\nP\tp2\t3+\t*\n")
    assert run() == [("p1", 0, 1), ("p1", 1, -2), ("p2", 0, 3)]
