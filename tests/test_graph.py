"""Golden texts: reading, storing, extraction, appending, windows, through the command line and the functions."""

import io
import os

import pytest
from pyspark.sql import functions as F

from braidgraph import api, cli
from braidgraph.functions import render, staging
from braidgraph.model import SCHEMAS, PangenomeGraph
from braidgraph.operators import extract, pav, stats
from braidgraph.plans.catalogue import QUERIES
from braidgraph.sources import appendix, bed, gfa, storage

GFA = """H\tVN:Z:1.1
S\t1\tAC
S\t2\tG
S\t3\tTTT
S\t4\tC
L\t1\t+\t2\t+\t0M
L\t2\t+\t3\t+\t0M
L\t1\t+\t3\t-\t0M
L\t3\t-\t4\t+\t0M
P\tpathA\t1+,2+,3+\t2M,1M
P\tpathB\t1+,3-,4+\t*
W\tsampleA\t0\tchr1\t0\t6\t>1>2>3
W\tsampleB\t1\tchr2\t*\t*\t>1<3>4
"""
A, B = "P\tpathA\t1+,2+,3+\t2M,1M", "P\tpathB\t1+,3-,4+\t*"


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("graph")
    (d / "g.gfa").write_text(GFA)
    (d / "paths.txt").write_text("P\tpathC\t2+,4+,3-\t*\n")
    (d / "walks.txt").write_text("W\tsampleC\t0\tchr3\t*\t*\t>2>4>1\n")
    (d / "mixed.txt").write_text((d / "paths.txt").read_text() + (d / "walks.txt").read_text())
    (d / "w.bed").write_text("# windows\npathA\t0\t6\tpathA_all\npathB\t0\t6\tpathB_all\n\npathA\t0\t2\tfirst\npathB\t4\t6\ttail\n")
    (d / "walk.bed").write_text("sampleA#0#chr1:0-6\t0\t6\tsampleA_walk\nsampleB#1#chr2\t0\t6\tsampleB_walk\n")
    return d


@pytest.fixture(scope="module")
def store(spark, folder):
    api.compress(spark, str(folder / "g.gfa"), str(folder / "store"), rounds=2)
    return str(folder / "store")


def said(*argv):
    out = io.StringIO()
    assert cli.run([str(a) for a in argv], out) == 0
    return out.getvalue().splitlines()


def test_extract(spark, store):
    assert said("extract-path", store, "pathB", "pathA") == [B, A]
    assert said("extract-walk", store, "sampleB", 1, "chr2", "*", "*") == ["W\tsampleB\t1\tchr2\t*\t*\t>1<3>4"]
    assert said("extract-sample", store, "sampleA") == ["W\tsampleA\t0\tchr1\t0\t6\t>1>2>3"]
    with pytest.raises(extract.NotFound):
        said("extract-path", store, "pathX")


def test_append(spark, folder, store):
    said("add-haplotypes", store, folder / "paths.txt", folder / "more")
    assert said("extract-path", folder / "more", "pathA", "pathC") == [A, "P\tpathC\t2+,4+,3-\t*"]
    said("add-haplotypes", store, folder / "walks.txt", folder / "morew")
    assert said("extract-walk", folder / "morew", "sampleC", 0, "chr3", "*", "*") == ["W\tsampleC\t0\tchr3\t*\t*\t>2>4>1"]
    with pytest.raises(appendix.BadAppendix):
        said("add-haplotypes", store, folder / "mixed.txt", folder / "no")
    with pytest.raises(ValueError):
        said("add-haplotypes", folder / "more", folder / "paths.txt", folder / "no")


def test_pav_goldens(spark, folder, store):
    (folder / "two.bed").write_text("pathA 0 6 pathA_all\npathB 0 6 pathB_all\n")
    head = "chrom\tstart\tend\tname\tpathA\tpathB\tsampleA#0#chr1\tsampleB#1#chr2"
    assert said("pav", "-i", store, "-b", folder / "two.bed", "-M") == [head, "pathA\t0\t6\tpathA_all\t1\t0.83333\t1\t0.83333", "pathB\t0\t6\tpathB_all\t0.83333\t1\t0.83333\t1"]
    grouped = said("pav", "-i", store, "-b", folder / "w.bed", "-S", "-M")
    assert grouped[0] == "chrom\tstart\tend\tname\tpathA\tpathB\tsampleA\tsampleB"
    assert grouped[3:] == ["pathA\t0\t2\tfirst\t1\t1\t1\t1", "pathB\t4\t6\ttail\t0.75\t1\t0.75\t1"]
    assert said("pav", "-i", store, "-b", folder / "walk.bed", "-M")[1:] == ["sampleA#0#chr1:0-6\t0\t6\tsampleA_walk\t1\t0.83333\t1\t0.83333", "sampleB#1#chr2\t0\t6\tsampleB_walk\t0.83333\t1\t0.83333\t1"]
    assert said("pav", "-i", store, "-b", folder / "two.bed", "-B", "0.9")[1] == "pathA\t0\t6\tpathA_all\tpathA\t1"


def test_growth(spark, store):
    for mode in ("path", "sample"):
        assert said("growth", store, "-G", mode)[-4:] == ["1\t3.0000", "2\t3.6667", "3\t4.0000", "4\t4.0000"]


def test_round_trip(spark, folder, store):
    g = api.parse_gfa(spark, str(folder / "g.gfa"))
    assert api.verify_round_trip(g, api.decompress(spark, store))
    assert dict(map(tuple, stats.summary(g).collect())) == {"segments": 4, "steps": 12, "paths": 2, "walks": 2, "links": 4, "jumps": 0, "containments": 0, "header": 1}
    gfa.write_gfa(g, str(folder / "text"))
    text = "".join(p.read_text() for p in sorted((folder / "text").glob("part-*")))
    assert text == GFA
    assert api.verify_round_trip(g, api.parse_gfa(spark, str(folder / "text")))
    with pytest.raises(storage.BadContainer):
        (folder / "odd/_about").mkdir(parents=True)
        (folder / "odd/_about/a.json").write_text('{"format":"other","version":1}')
        storage.load(spark, str(folder / "odd"))


def test_odd_text(spark, folder):
    (folder / "odd.gfa").write_text(
        "H\tVN:Z:1\nH\tVN:Z:2\nS  a   ACG\tLN:i:3\tXF:f:1.50\nS\tb\t*\r\nS\ta\tTTTT\tLN:i:4\nL\ta\t+\tb\t-\t12M3I\nL\ta\t+\tzz\t-\t*\nJ\ta\t+\tb\t-\t*\tAA:i:1\nC\ta\t+\tb\t-\t7\t3M\tID:Z:q\n# note\nX\t1\nP\tp\ta+,zz-,b-\t*\n"
    )
    g = api.parse_gfa(spark, str(folder / "odd.gfa"))
    assert [(r.node_id, r.name, r.sequence, r.seq_len) for r in g.segments.orderBy("node_id").collect()] == [(1, "a", "ACG", 3), (2, "b", "*", 1)]
    assert [(r.overlap_num, r.overlap_op, r.overlap) for r in g.links.collect()] == [(12, "M", "12M3I")]
    lines = [r.line for r in gfa.gfa_lines(g, names=False).orderBy("section", "idx").collect()]
    assert lines == ["H\tVN:Z:2", "S\t1\tACG\tLN:i:3\tXF:f:1.5", "S\t2\t*", "L\t1\t+\t2\t-\t12M", "P\tp\t1+,2-\t*", "J\t1\t+\t2\t-\t*\tAA:i:1", "C\t1\t+\t2\t-\t7\t3M\tID:Z:q"]
    named = [r.line for r in gfa.gfa_lines(g).orderBy("section", "idx").collect()]
    assert named == ["H\tVN:Z:2", "S\ta\tACG\tLN:i:3\tXF:f:1.5", "S\tb\t*", "L\ta\t+\tb\t-\t12M", "P\tp\ta+,b-\t*", "J\ta\t+\tb\t-\t*\tAA:i:1", "C\ta\t+\tb\t-\t7\t3M\tID:Z:q"]
    gfa.write_gfa(g, str(folder / "named"))
    again = api.parse_gfa(spark, str(folder / "named"))  # numbers and overlaps are shortened, all else is the same
    assert [r.name for r in again.segments.orderBy("node_id").collect()] == ["a", "b"] and set(stats.same_graph(g, again)) <= {"segments", "links"}
    tag = spark.createDataFrame([("B", "f,1.50,2,0.3333333"), ("B", "i,+5,-007,3"), ("f", "12345.25"), ("Z", "1.50")], "k string, v string")
    assert [r[0] for r in tag.select(render.tag_text(F.lit("XX"), F.col("k"), F.col("v"))).collect()] == ["XX:B:f,1.5,2,0.333333", "XX:B:i,5,-7,3", "XX:f:12345.2", "XX:Z:1.50"]
    (folder / "bad.gfa").write_text("S\ta\tA\tXX:i:1\nS\tb\tA\tXX:Z:1\n")
    with pytest.raises(gfa.BadGfa):
        api.parse_gfa(spark, str(folder / "bad.gfa"))


@pytest.mark.parametrize("text", ["", "# only\n", "p 5 x\n", "p 5 3\n", "p -1 3\n", "p\n"])
def test_bad_bed(spark, tmp_path, text):
    (tmp_path / "x.bed").write_text(text)
    with pytest.raises(bed.BadBed):
        bed.read_bed(spark, str(tmp_path / "x.bed"))


def test_bed_default_name(spark, tmp_path):
    (tmp_path / "x.bed").write_text("p 5 9\nq\t1\t1\tn\textra\n")
    assert [tuple(r) for r in bed.read_bed(spark, str(tmp_path / "x.bed")).orderBy("wid").collect()] == [(0, "p", 5, 9, "p:5-9"), (1, "q", 1, 1, "n")]


def test_unknown_reference(spark, folder, store, tmp_path):
    (tmp_path / "x.bed").write_text("nowhere 0 5\n")
    with pytest.raises(Exception, match="reference path not found"):
        said("pav", "-i", store, "-b", tmp_path / "x.bed")


def test_written_lines(spark, folder, store, tmp_path):
    """What the executors write is what is printed."""
    (tmp_path / "w.bed").write_text("pathA 0 6 a\npathB 0 2 b\n")
    window = ["pav", "-i", store, "-b", tmp_path / "w.bed"]
    written = lambda d: "".join(p.read_text() for p in sorted(d.glob("part-*"))).splitlines()
    assert said("extract-path", store, "pathB", "pathA", "-o", tmp_path / "paths") == [] and written(tmp_path / "paths") == [B, A]
    assert said(*window, "-S", "-M", "-o", tmp_path / "table") == []
    assert written(tmp_path / "table") == ["chrom\tstart\tend\tname\tpathA\tpathB\tsampleA\tsampleB", "pathA\t0\t6\ta\t1\t0.83333\t1\t0.83333", "pathB\t0\t2\tb\t1\t1\t1\t1"]


def test_matrix_against_long(spark, monkeypatch):
    """The wide text and the join beyond the bound of what is sent agree with the long table."""
    segments = spark.range(1, 41).selectExpr("id as node_id", "string(id) as name", "repeat('A', int(id % 5)) as sequence", "id % 5 as seq_len", "map() as tags")
    steps = spark.range(0, 300).selectExpr("'P' as kind", "id div 15 as trav", "id % 15 as pos", "1 + (id * id + id div 15) % 40 as snode")
    g = PangenomeGraph(segments, steps, spark.range(20).selectExpr("id as trav", "concat('s', 37 * id % 20, '#1#c') as name", "'*' as overlaps"))
    windows = spark.createDataFrame([(i, f"s{37 * t % 20}#1#c", a, a + 7, f"w{i}") for i, (t, a) in enumerate((t, a) for t in range(20) for a in (0, 9, 500))], "wid bigint, chrom string, start bigint, end bigint, name string")
    long = {(r.wid, r.grp): r.pav for r in pav.pav(g, windows, "sample").collect()}
    assert len(long) == 60 * 20
    monkeypatch.setattr(pav, "SENT", 0)
    assert {(r.wid, r.grp): r.pav for r in pav.pav(g, windows, "sample").collect()} == long
    order = [f"s{37 * t % 20}" for t in range(20)]
    for threshold in (None, 0.0, 0.4):
        lines = [r.line for r in pav.output(g, windows, "sample", True, threshold).orderBy("wid", "place").collect()]
        assert lines[0].split("\t")[4:] == order and len(lines) == 61
        text = lambda x: "%.5g" % x if threshold is None else str(int(x >= threshold))  # noqa: B023
        assert [x.split("\t")[3:] for x in lines[1:]] == [[f"w{w}", *(text(long[w, o]) for o in order)] for w in range(60)]


def test_stats(spark, folder, tmp_path):
    lines = dict(x.split("\t", 1) for x in said("compress", folder / "g.gfa", tmp_path / "s", "-r", "1", "-s") if x.count("\t") == 1)
    assert int(lines["text_bytes"]) == len(GFA) and int(lines["stored_bytes"]) == storage.folder_bytes(spark, str(tmp_path / "s")) > 0 and {"ratio", "MiB_per_second", "seconds"} <= set(lines)
    columns = storage.column_bytes(spark, str(tmp_path / "s"))
    assert {("steps", "snode"), ("segments", "sequence"), ("rules", "rule_id")} <= {c[:2] for c in columns} and all(c[2] > 0 and c[3] > 0 for c in columns)
    assert "ratio" in dict(x.split("\t", 1) for x in said("decompress", tmp_path / "s", tmp_path / "back", "-s"))


def test_floats_and_lengths(spark, tmp_path):
    """Floating tags are read up to where they stop being a number; LN gives lengths only where asked."""
    (tmp_path / "g.gfa").write_text("S\ta\t*\tLN:i:12\tXF:f:1.5e1kb\nS\tb\t*\tLN:Z:7\nS\tc\tACG\tLN:i:9\n")
    lines = gfa.lines_of(spark, str(tmp_path / "g.gfa"))
    sizes = lambda told: [r.seq_len for r in gfa.parsed_segments(lines, told).orderBy("node_id").collect()]
    assert sizes(False) == [1, 1, 3] and sizes(True) == [12, 1, 3]
    g = PangenomeGraph(gfa.parsed_segments(lines), spark.createDataFrame([], SCHEMAS["steps"]))
    assert [r.line for r in gfa.gfa_lines(g).orderBy("idx").collect()][0] == "S\ta\t*\tLN:i:12\tXF:f:15"
    texts = ["1", "-2.50x", " +.5e2", "7.e-1", "1e", "inf", "-NaN", "infinity", "", "x1", "e5", "."]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(render.leading_float(F.col("t"))).collect()]
    assert str(got) == str([1.0, -2.5, 50.0, 0.7, 1.0, float("inf"), float("nan"), float("inf"), None, None, None, None])
    tags = [(t, {"XF": ("f", t)}) for t in ["x1", "1e39", "-3.5e38", "1e-46", "3.4e38", "0", "-inf", "1e-38", "5"]]
    table = spark.createDataFrame(tags, "t string, tags map<string,struct<type:string,value:string>>")
    assert [r.value for r in gfa.bad_floats(table).collect()] == ["x1", "1e39", "-3.5e38", "1e-46", "1e-38"]
    (tmp_path / "g.gfa").write_text("S\ta\tA\tXF:f:x1\n")
    with pytest.raises(gfa.BadGfa):
        api.parse_gfa(spark, str(tmp_path / "g.gfa"))


def small_graph(spark, groups=20, steps=15, longest=5):
    """Paths s0#1#c, s1#1#c, ... of some steps over 40 nodes, and three windows on each; the last is beyond its end."""
    segments = spark.range(1, 41).selectExpr("id as node_id", "string(id) as name", "'A' as sequence", f"id % {longest} as seq_len", "map() as tags")
    rows = spark.range(groups * steps).selectExpr("'P' as kind", f"id div {steps} as trav", f"id % {steps} as pos", f"1 + (id * id + id div {steps}) % 40 as snode")
    g = PangenomeGraph(segments, rows, spark.range(groups).selectExpr("id as trav", "concat('s', id, '#1#c') as name", "'*' as overlaps"))
    windows = [(3 * t + i, f"s{t}#1#c", a, a + 7 * longest // 5, f"w{t}.{i}") for t in range(groups) for i, a in enumerate((0, 2 * longest, 500 * longest))]
    return g, spark.createDataFrame(windows, "wid bigint, chrom string, start bigint, end bigint, name string")


def brute(g, windows):
    """(wid, group) to (num, den), by loops."""
    size = {r.node_id: r.seq_len for r in g.segments.collect()}
    walk, hold = {}, {}
    for r in g.steps.orderBy("trav", "pos").collect():
        walk.setdefault(f"s{r.trav}#1#c", []).append(r.snode)
        hold.setdefault(f"s{r.trav}", set()).add(r.snode)
    out = {}
    for w in windows.collect():
        at, nodes = 0, set()
        for v in walk[w.chrom]:
            if w.end > at and w.start < at + size[v]:
                nodes.add(v)
            at += size[v]
        out |= {(w.wid, x): (sum(size[v] for v in nodes & held), sum(size[v] for v in nodes)) for x, held in hold.items()}
    return out


@pytest.mark.parametrize(("groups", "longest", "few"), [(3, 5, 10), (70, 5, 10**6), (130, 5, 0), (20, 5000, 10**6)])
def test_shares_by_brute_force(spark, monkeypatch, groups, longest, few):
    """Fewer and more groups than a number has bits, windows in one bin and in several, tables sent and joined, several blocks."""
    monkeypatch.setattr(staging, "FEW", few)
    monkeypatch.setattr(pav, "BLOCK", 15 if groups > 100 else 7)
    g, windows = small_graph(spark, groups, longest=longest)
    want = brute(g, windows)
    assert {(r.wid, r.grp): (r.num, r.den) for r in pav.pav(g, windows, "sample").collect()} == want
    names = [f"s{groups - 1}", "unknown", "s0"]
    ratio = lambda w, x: want[w, x][0] / want[w, x][1] if want[w, x][1] else 0.0
    assert {r[0]: r[1:] for r in pav.matrix(g, windows, "sample", names).collect()} == {w: (ratio(w, names[0]), None, ratio(w, "s0")) for w in range(3 * groups)}
    head = {r.wid: f"{r.chrom}\t{r.start}\t{r.end}\t{r.name}" for r in windows.collect()}
    assert {(r.wid, r.grp): r.line for r in pav.pav_lines(g, windows, "sample").collect()} == {(w, x): f"{head[w]}\t{x}\t{ratio(w, x):.5g}" for w, x in want}


@pytest.mark.parametrize("name", ["pav_long", "pav_haplotype", "pav_binary", "pav_matrix", "pav_lines"])
def test_pairs_of_windows_and_groups_stay_where_they_are(spark, sf, name):
    """Whatever is exchanged is exchanged before the pairs of windows and groups are made: nothing of that size is written."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert not any("grp" in x for x in joins)
    executed = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    made = next(i for i, x in enumerate(executed) if "HashAggregate" in x or "SortAggregate" in x)
    assert not any("Exchange" in x for x in executed[:made])


@pytest.mark.parametrize("name", ["pav_long", "pav_haplotype", "pav_binary", "pav_matrix", "pav_lines"])
def test_windows_are_made_beside_the_steps(spark, sf, name):
    """Paths are exchanged, not their windows; and of a step only its path, place and node."""
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = [len(x) - len(x.lstrip(" :+-")) for x in plan]
    made = next(i for i, x in enumerate(plan) if "Generate explode(sequence(0" in x)
    above = [x for i, x in enumerate(plan[:made]) if depth[i] < min(depth[i + 1 : made + 1])]
    assert above and not any("Exchange" in x for x in above)
    assert not any("l_shipdate" in x or "l_suppkey" in x for x in plan)


@pytest.mark.parametrize("bin", [4_096, 3])
def test_tiles_by_brute_force(spark, monkeypatch, bin):
    """Windows made late are those given as rows, with all of their columns; an unknown reference raises or is left out."""
    monkeypatch.setattr(pav, "BIN", bin)
    g, _ = small_graph(spark)
    rows = spark.range(20).selectExpr("id as own", "concat('s', id, '#1#c') as chrom")
    made = lambda df: df.selectExpr("kind", "trav", "own", "chrom", "explode(sequence(0, 2)) as w").selectExpr("3 * own + w as wid", "kind", "trav", "chrom", "9L * w as start", "9L * w + 7 as end", "concat('w', w) as name")
    tiles = pav.Tiles(rows, made)
    windows = made(rows.selectExpr("*", "'P' as kind", "own as trav")).drop("kind", "trav")
    want, shown = brute(g, windows), {r.wid: (r.chrom, r.start, r.end, r.name) for r in windows.collect()}
    assert {(r.wid, r.grp): (r.chrom, r.start, r.end, r.name, r.num, r.den) for r in pav.pav(g, tiles, "sample").collect()} == {k: (*shown[k[0]], *v) for k, v in want.items()}
    line = lambda bed: sorted(r.line for r in pav.pav_lines(g, bed, "sample").collect())
    texts = sorted("\t".join(map(str, (*shown[w], x, "%.5g" % (a / b if b else 0)))) for (w, x), (a, b) in want.items())
    assert line(tiles) == line(windows) == texts
    monkeypatch.setattr(pav, "KNOWN", 5)  # shares from the table and others, in one run
    assert line(tiles) == texts
    odd = pav.Tiles(rows.unionByName(spark.sql("select 99L as own, 'x' as chrom")), made)
    with pytest.raises(pav.UnknownReference):
        pav.pav(g, odd, "sample")
    assert pav.pav(g, odd, "sample", strict=False).count() == len(want)


@pytest.mark.parametrize("groups", [20, 70])
def test_bits_in_passes(spark, monkeypatch, groups):
    """Many steps: each pass stages nodes of its own, and the passes' nodes are all nodes, once each."""
    parts, real = [], pav.staged

    def kept(df, name="part", *rest):
        parts.append((name, real(df, name, *rest)))
        return parts[-1][1]

    monkeypatch.setattr(pav, "MANY", groups)
    monkeypatch.setattr(pav, "staged", kept)
    g, windows = small_graph(spark, groups)
    assert {(r.wid, r.grp): (r.num, r.den) for r in pav.pav(g, windows, "sample").collect()} == brute(g, windows)
    seen = [{r.node_id for r in df.collect()} for name, df in parts if name == "bits"]
    assert len(seen) == pav.PASSES > 1 and all(seen)
    assert sum(map(len, seen)) == len(set().union(*seen)) == g.steps.select("snode").distinct().count()
    assert not os.path.exists(dict(parts)["places"]._braid_path)  # needed until the last pass


@pytest.mark.parametrize("name", ["pav_long", "pav_haplotype", "pav_binary", "pav_matrix", "pav_lines"])
def test_tiles_and_names_are_staged_one_after_the_other(spark, sf, monkeypatch, name):
    """The step that resolves tiles exchanges two lists, not what they are made of as well; they are gone afterwards."""
    parts, real = {}, pav.staged
    monkeypatch.setattr(pav, "staged", lambda df, name="part", *rest: parts.setdefault(name, (df, real(df, name, *rest)))[1])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        QUERIES[name](spark, sf)
        plan = parts["windows"][0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("Exchange ") == 2 and "lineitem" not in plan and "orders" not in plan
    assert not any(os.path.exists(parts[x][1]._braid_path) for x in ("tiles", "names"))


def sent_rows(df):
    """Rows of each table that was sent to all tasks when df was collected."""
    todo, out = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        x = todo.pop()
        kind = x.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(x.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(x.plan())
        elif kind == "BroadcastExchangeExec":
            out.append(x.metrics().apply("numOutputRows").value())
        todo += [x.children().apply(i) for i in range(x.children().size())]
    return out


@pytest.mark.parametrize("name", ["pav_long", "pav_haplotype", "pav_binary", "pav_matrix", "pav_lines"])
def test_tables_of_nodes_are_sent_in_packs(spark, sf, monkeypatch, name):
    """The driver collects and sends what has one row a node as a few rows of arrays; rows are those of tables sent as they are."""
    known = pav.known(spark, lambda c: c).count()
    want = sorted(map(str, QUERIES[name](spark, sf).collect()))
    monkeypatch.setattr(staging, "ROWS", 50)
    made = QUERIES[name](spark, sf)
    assert sorted(map(str, made.collect())) == want
    sent = [n for n in sent_rows(made) if n != known]
    assert len(sent) >= 2 and max(sent) <= 2  # sizes and bits of 200 nodes


@pytest.mark.parametrize("groups", [20, 70])
def test_packs_by_brute_force(spark, monkeypatch, groups):
    """Fewer and more groups than a number has bits, packs shorter than the nodes."""
    monkeypatch.setattr(staging, "ROWS", 0)
    monkeypatch.setattr(staging, "PACK", 8)
    g, windows = small_graph(spark, groups)
    assert {(r.wid, r.grp): (r.num, r.den) for r in pav.pav(g, windows, "sample").collect()} == brute(g, windows)


@pytest.mark.parametrize(("ids", "packed"), [("id", True), ("id - 40", True), ("3 * id", True), ("1000 * id", False), ("id div 2", False), ("if(id = 7, null, id)", True)])
def test_lookup(spark, monkeypatch, ids, packed):
    """Packed or not, a lookup is the join: of gaps, negative, far, repeated and null keys, and null values."""
    monkeypatch.setattr(staging, "ROWS", 0)
    monkeypatch.setattr(staging, "PACK", 16)
    monkeypatch.setattr(staging, "FEW", 400)
    table = spark.range(100).selectExpr(f"{ids} as k", "if(id % 9 = 0, null, id * id) as v", "0 as other")
    rows = spark.range(-60, 400).selectExpr("if(id = 5, null, id) as k", "string(id) as x")
    found = staging.Lookup.of(table, ["k"], "v")
    assert found.packed == packed
    for how in ("inner", "left"):
        want = rows.join(table.select("k", "v"), "k", how).select("k", "x", "v")
        key = lambda df: sorted(map(str, df.select("k", "x", "v").collect()))
        assert key(found.join(rows, how)) == key(want)
