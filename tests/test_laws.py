"""Laws: closed form against subsets, islands against a stack, deltas and rules undone, packing, number texts."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from braidgraph.functions import packing, render
from braidgraph.functions.staging import numbered, running_total
from braidgraph.model import PangenomeGraph
from braidgraph.operators import grammar, growth, pav, traversal


def steps_of(spark, rows):
    return spark.createDataFrame([(t, p, v) for t, vs in rows.items() for p, v in enumerate(vs)], "trav bigint, pos bigint, snode bigint")


def read(df):
    out = {}
    for r in df.orderBy("trav", "pos").collect():
        out.setdefault(r.trav, []).append(r.snode)
    return out


def test_growth_is_mean_over_subsets(spark):
    rnd = random.Random(3)
    n = 6
    paths = {t: [rnd.randint(1, 12) for _ in range(rnd.randint(1, 8))] for t in range(n)}
    g = PangenomeGraph(
        spark.range(1, 13).withColumnRenamed("id", "node_id"), steps_of(spark, paths).withColumn("kind", F.lit("P")),
        spark.createDataFrame([(t, f"s{t}", "") for t in range(n)], "trav bigint, name string, overlaps string"),
    )
    got = {r.k: r.growth for r in growth.growth(g).collect()}
    for k in range(1, n + 1):
        sets = [len(set().union(*(paths[t] for t in c))) for c in itertools.combinations(range(n), k)]
        assert got[k] == pytest.approx(sum(sets) / len(sets))
    assert sorted(got.values()) == [got[k] for k in range(1, n + 1)]


@pytest.mark.parametrize("n", [1, 40, 5000])
def test_growth_of_many_groups(spark, n):
    """The curve against whole-number binomials."""
    from fractions import Fraction
    from math import comb

    counts = {c: x for c, x in {0: 3, 1: 5, 4: 2, 9: 7, 40: 1, 3000: 2, 5000: 4}.items() if c <= n}
    hist = spark.createDataFrame([(c, counts.get(c, 0)) for c in range(n + 1)], "c bigint, n_nodes bigint")
    got = {r.k: r.growth for r in growth.growth_curve(hist).collect()}
    assert sorted(got) == list(range(1, n + 1))
    for k in {1, min(2, n), max(1, n // 2), max(1, n - 1), n}:
        want = sum(x * (1 - Fraction(comb(n - k, c), comb(n, c))) for c, x in counts.items() if c)
        assert got[k] == pytest.approx(float(want), rel=1e-9)
    assert growth.growth_curve(hist.where("c = 0")).count() == 0


def stack(seq, rules):
    out = []
    for x in seq:
        if out and out[-1][1] is False:
            a = out[-1][0]
            for pair, sign in (((a, x), 1), ((-x, -a), -1)):
                if pair in rules:
                    out[-1] = (sign * rules[pair], True)
                    break
            else:
                out.append((x, False))
        else:
            out.append((x, False))
    return [v for v, _ in out]


def test_islands_equal_a_stack(spark):
    rnd = random.Random(5)
    rows = {t: [rnd.choice([1, 2, 3, -1, -2]) for _ in range(rnd.randint(1, 30))] for t in range(60)}
    key = lambda a, b: min(((a << 32) | (b & packing.LOW), a, b), ((-b << 32) | (-a & packing.LOW), -b, -a))
    pairs = sorted({key(a, b) for s in rows.values() for a, b in itertools.pairwise(s)})
    chosen = {(a, b): 100 + i for i, (_, a, b) in enumerate(rnd.sample(pairs, len(pairs) // 2))}
    table = spark.createDataFrame([(key(*p)[0], r) for p, r in chosen.items()], "kmer bigint, rule bigint")
    for block in (3, 4, 1000):  # islands go on across blocks
        got = read(grammar.replaced(steps_of(spark, rows), ["trav"], table, block))
        # the pair and its reverse are one rule; a palindromic pair counts as forward
        assert got == {t: stack(s, chosen) for t, s in rows.items()}


@pytest.mark.parametrize("delta", [0, 1, 2])
def test_decode_undoes_encode(spark, delta):
    rnd = random.Random(delta)
    rows = {t: [rnd.choice([-1, 1]) * rnd.randint(1, 4) for _ in range(rnd.randint(1, 40))] for t in range(20)}
    coded, rules = grammar.encode(steps_of(spark, rows), ["trav"], 3, delta)
    assert rules.count() > 3 and (delta == 2 or rules.agg(F.max("round")).first()[0] > 1)
    assert coded.count() < sum(map(len, rows.values()))
    assert read(grammar.decode(coded, ["trav"], rules, delta)) == rows
    again = grammar.encode_with(steps_of(spark, rows), ["trav"], rules, delta)
    assert read(grammar.decode(again, ["trav"], rules, delta)) == rows


def test_rules_of_any_depth(spark):
    """A chain of 20 rules, each holding the one before, is written out; a circle is refused."""
    deep = spark.createDataFrame([(100 + i, 100 + i - 1 if i else 2, i) for i in range(20)], "rule_id bigint, first bigint, second bigint").coalesce(1)
    got = {r.rule_id: r.leaf for r in grammar.leaves(deep).where("rule_id in (100, 101, 119)").collect()}
    assert got[100] == [2, 0] and got[101] == [2, 0, 1] and got[119] == [2] + list(range(20))
    circle = spark.createDataFrame([(10, 11, 1), (11, 10, 2)], "rule_id bigint, first bigint, second bigint")
    with pytest.raises(grammar.BadRules):
        grammar.leaves(circle)


def test_blocks_do_not_matter(spark):
    rnd = random.Random(9)
    rows = {t: [rnd.choice([-1, 1]) * rnd.randint(1, 3) for _ in range(n)] for t, n in enumerate((1, 2, 7, 8, 9, 50))}
    steps = steps_of(spark, rows)
    for f in (lambda b: traversal.delta(steps, ["trav"], 2, block=b), lambda b: traversal.two_mers(steps, ["trav"], block=b), lambda b: grammar.compacted(steps.where("pos % 3 != 1"), ["trav"], b)):
        assert sorted(map(tuple, f(4).collect())) == sorted(map(tuple, f(1000).collect()))
    table = spark.createDataFrame([(10, 1, 2), (11, 10, -3)], "rule_id bigint, first bigint, second bigint")
    coded = steps_of(spark, {0: [1, 11, -11, 2, 10, -10, 3], 1: [11] * 9})
    assert read(grammar.expand(coded, ["trav"], table, 2)) == {0: [1, 1, 2, -3, 3, -2, -1, 2, 1, 2, -2, -1, 3], 1: [1, 2, -3] * 9}
    flat = spark.range(20).select("id", (F.col("id") * 7 % 11).alias("v"))
    assert sorted(map(tuple, traversal.flat_undelta(traversal.flat_delta(flat, ["id"], "v"), ["id"], "v").collect())) == sorted(map(tuple, flat.collect()))


def test_long_traversals_in_blocks(spark):
    rows = {1: list(range(1, 50)), 2: [7] * 5}
    d = traversal.delta(steps_of(spark, rows), ["trav"], 2)
    assert read(traversal.undelta(d, ["trav"], 2, block=4)) == rows
    seg = spark.range(1, 60).select(F.col("id").alias("node_id"), (F.col("id") % 5 + 1).alias("seq_len"))
    a, b = (sorted(map(tuple, pav.node_offsets(steps_of(spark, rows), seg, ["trav"], block).collect())) for block in (3, 1000))
    assert a == b


def test_zero_length_windows(spark):
    seg = spark.createDataFrame([(1, 5), (2, 5)], "node_id bigint, seq_len bigint")
    off = pav.node_offsets(steps_of(spark, {0: [1, 2]}), seg, ["trav"])
    bed = spark.createDataFrame([(0, 0, 3, 3), (1, 0, 5, 5), (2, 0, 4, 6), (3, 0, 0, 0), (4, 0, 100, 120)], "wid bigint, trav bigint, start bigint, end bigint")
    assert sorted(map(tuple, pav.overlaps(bed, off, ["trav"], width=2).collect())) == [(0, 1), (2, 1), (2, 2)]


def test_packing(spark):
    values = [0, 1, -1, 5, -7, 2**31 - 1, -(2**31)]
    df = spark.createDataFrame(list(itertools.product(values, values)), "a bigint, b bigint")
    k = packing.pack(F.col("a"), F.col("b"))
    for r in df.select("a", "b", packing.unpack_first(k).alias("x"), packing.unpack_second(k).alias("y")).collect():
        assert (r.a, r.b) == (r.x, r.y)
    z = spark.createDataFrame([(v,) for v in (0, -1, 1, -2, 63, 64, -65, 2**40)], "v bigint").select("v", packing.zigzag(F.col("v")).alias("z"), packing.varint_bytes(packing.zigzag(F.col("v"))).alias("n"))
    for r in z.collect():
        assert r.z == (2 * r.v if r.v >= 0 else -2 * r.v - 1)
        assert r.n == max(1, -(-r.z.bit_length() // 7))


def test_general_numbers(spark):
    values = [0.0, 1.0, 0.83333333, 0.75, 123456.789, 1234567.0, 0.0001234567, 0.00001234, 900.1, 1e-10, 2.5e20, 0.453125, 0.890625, 0.123455, 0.00390625, 0.0123455, 0.00012207, 13 / 32, 29 / 64, 0.999994, 1 / 3, 2 / 7 / 100, 100000.0, 999999.5, 0.1 + 0.2, 10.0, 12345.25, 12345.75, 100000.5, 100001.5, 10000.5, 1234565.0, 12345650.0, 2.675, 1.000005, 1.0000005, 8.5e-5, 1.2345650000000001e-7, 123456.5, 99999.95, 9.999995, 3e-308, 1.7e308, 0.30000000000000004, 1e22, 12345.35]
    rnd = random.Random(1)
    values += [round(rnd.uniform(0, 10**rnd.randint(-5, 7)), rnd.randint(0, 7)) for _ in range(300)] + [rnd.randint(1, 10**7) / 2 ** rnd.randint(0, 20) for _ in range(300)]
    values += [-v for v in values if v]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (5, 6):
        for r in df.select("v", render.general(F.col("v"), digits).alias("t")).collect():
            assert r.t == f"{r.v:.{digits}g}", r


def test_numbering(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x"), F.lit(2).alias("w"))
    rows = numbered(df, ["x"], "n", 5).collect()
    assert sorted((r.x, r.n) for r in rows) == [(i, i + 5) for i in range(1000)]
    assert sorted((r.x, r.t) for r in running_total(df, ["x"], "w", "t").collect()) == [(i, 2 * i) for i in range(1000)]
    assert numbered(df.where("x < 0"), ["x"], "n").count() == 0


def test_size_texts_as_in_c(spark):
    """Two decimals of the double itself: halves, carries, and numbers that no double holds."""
    values = [0, 1023, 1024, 1024 + 128, 1024 + 384, 3 * 1024 + 640, (1 << 20) - 1, 1 << 20, 5 * (1 << 17), 9 * (1 << 17), 11 * (1 << 17), (1 << 30) - 1, 9 * (1 << 27), 44320966934622372, 76848042016537313, (1 << 63) - 1]
    c = lambda n: f"{n} B" if n < 1 << 10 else next(f"{n / 2**p:.2f} {u}" for p, u in ((10, "KB"), (20, "MB"), (30, "GB")) if n < 1 << (p + 10) or p == 30)
    rows = spark.createDataFrame([(n,) for n in values], "n bigint").select("n", packing.size_text(F.col("n")).alias("text")).collect()
    assert {r.n: r.text for r in rows} == {n: c(n) for n in values}
    assert spark.sql("select cast(null as bigint) as n").select(packing.size_text(F.col("n"))).first()[0] is None
