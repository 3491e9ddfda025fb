"""The function interface and the store's options."""

import pytest

from braidgraph import api
from braidgraph.sources import storage

ONE = "S\ta\tACGT\nS\tb\tG\nP\tx\ta+,b-,a+,b-\t*\nW\ts\t1\tq\t*\t*\t>a<b\n"


def test_directory_and_lines(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in ("one.gfa", "two.gfa", "note.txt"):
        (tmp_path / "in" / n).write_text(ONE)
    stores = api.compress_directory(spark, str(tmp_path / "in"), str(tmp_path / "out"), rounds=1)
    assert [s.rsplit("/", 1)[1] for s in stores] == ["one", "two"]
    g = api.decompress(spark, stores[0])
    assert api.extract_path_line(g, "x") == "P\tx\t1+,2-,1+,2-\t*"
    assert api.extract_walk_line(g, "s", 1, "q") == "W\ts\t1\tq\t*\t*\t>1<2"
    assert api.extract_walk_lines_by_name(g, ["s"]) == ["W\ts\t1\tq\t*\t*\t>1<2"]
    assert [r.growth for r in api.growth(g).orderBy("k").collect()] == [2.0, 2.0]
    bed = spark.createDataFrame([(0, "x", 0, 4, "w")], "wid bigint, chrom string, start bigint, end bigint, name string")
    assert {r.grp: (r.num, r.den) for r in api.pav(spark, g, bed, "sample").collect()} == {"x": (4, 4), "s": (4, 4)}
    (tmp_path / "more.txt").write_text("P\ty\t2+\t*\n")
    more = api.add_haplotypes(spark, g, str(tmp_path / "more.txt"), strict=True)
    assert api.extract_path_lines(more, ["y", "x"])[0] == "P\ty\t2+\t*" and g.paths.count() == 1
    assert api.verify_round_trip(g, api.decompress(spark, stores[1])) and not api.verify_round_trip(g, more)
    (tmp_path / "far.txt").write_text("P\tz\t99+\t*\n")
    with pytest.raises(ValueError):
        api.add_haplotypes(spark, g, str(tmp_path / "far.txt"), strict=True)


def test_level(spark, tmp_path):
    (tmp_path / "g.gfa").write_text(ONE)
    g = api.parse_gfa(spark, str(tmp_path / "g.gfa"))
    with pytest.raises(ValueError):
        storage.save(g, str(tmp_path / "s"), level=23)
    storage.save(g, str(tmp_path / "s"), level=1)
    assert api.verify_round_trip(g, storage.load(spark, str(tmp_path / "s")))
