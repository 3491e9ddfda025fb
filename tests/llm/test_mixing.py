import math
import re

import pytest
from pyspark.sql import functions as F

from braidgraph.llm import mixing
from braidgraph.llm._common import word_count


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def targets(sizes):
    """Brute force: shares by weight, what is above three times a source's size goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    out, rest, left = {}, float(sum(sizes.values())), set(order)
    while left:
        total = sum(w[s] for s in left)
        over = [s for s in left if rest * w[s] / total > 3 * sizes[s]]
        if not over:
            out |= {s: rest * w[s] / total for s in left}
            break
        for s in over:
            out[s] = 3.0 * sizes[s]
        rest -= sum(out[s] for s in over)
        left -= set(over)
    return out


def check(docs):
    rows = docs.select("doc_id", "text", "source").collect()
    sizes = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + words(r.text)
    want = targets(sizes)
    got = mixing.mix(docs).collect()
    assert sorted(((r.doc_id, r.size) for r in got), key=str) == sorted(((r.doc_id, words(r.text)) for r in rows), key=str)
    source = {(r.doc_id, words(r.text)): r.source for r in rows}
    taken, largest = {}, {}
    for r in got:
        s = source[r.doc_id, r.size]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], rel=1e-9)
        assert 0 <= r.copies <= 3 and r.taken == r.copies * r.size
        taken[s] = taken.get(s, 0) + r.taken
        largest[s] = max(largest.get(s, 0), r.size)
    return {s: (taken[s], want[s], largest[s]) for s in want}, got


def test_targets_and_taken(documents):
    by, got = check(documents)
    for taken, target, _ in by.values():
        assert abs(taken - target) <= 0.01 * target
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(documents.repartition(7)).collect()))


def test_odd(odd, none):
    by, _ = check(odd)
    for taken, target, largest in by.values():
        assert abs(taken - target) <= largest
    assert mixing.mix(none).count() == 0


def test_word_count(spark):
    texts = ["", " ", "a", " a", "a ", "a\tb\nc\x0bd\x0ce\rf", " x y", "a  b", "\n\n", None, "\x1fa"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select("i", word_count(F.col("text")).alias("n"))
    assert {r.i: r.n for r in df.collect()} == {i: words(t) for i, t in enumerate(texts)}


def test_tilt(documents):
    """Rates fall or rise with size by one multiplier a source, within the cap."""
    one = mixing.mix(documents.where("source = 'src1' or source = 'src2'")).where("size > 0 and rate < 2.999").collect()
    by = {}
    for r in one:
        by.setdefault(r.source_size, set()).add(round(math.log(r.rate) / r.size, 12))
    assert all(len(x) == 1 for x in by.values())


def plain_rates(counts, target, cap=3.0):
    """By size: the tilted rates that meet the target, by halving alone."""
    take = lambda t: sum(n * s * min(cap, math.exp(min(50.0, t * s))) for s, n in counts.items())
    low, high = -100.0, 100.0
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if take(mid) < target else (low, mid)
    return {s: min(cap, math.exp(min(50.0, low * s))) for s in counts}


def test_rates_and_copies_by_brute_force(spark):
    """Rates against halving, and who gets the extra copies: the smallest hashes of doc_id."""
    import random

    rnd = random.Random(4)
    rows = [(i, " ".join("w" * rnd.choice([1, 2, 5, 5, 9, 40, 300])), rnd.choice(["a", "b", "b", "c", "d", None])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    got = {r.doc_id: r for r in mixing.mix(docs).collect()}
    for source in ("a", "b", "c", "d", None):
        own = [i for i, _, s in rows if s == source]
        counts = {}
        for i in own:
            counts[got[i].size] = counts.get(got[i].size, 0) + 1
        target = got[own[0]].target
        want = {s: 3.0 for s in counts} if target >= 3 * got[own[0]].source_size * (1 - 1e-12) else plain_rates(counts, target)
        carry = 0.0
        for s in sorted(counts, reverse=True):
            same = sorted((i for i in own if got[i].size == s), key=hashes.get)
            assert all(got[i].rate == pytest.approx(want[s], rel=1e-9) for i in same)
            part = len(same) * (want[s] - int(want[s] + 1e-9))
            extra = min(len(same), max(0, round(part + carry / s))) if part > 1e-9 else 0
            carry += (part - extra) * s
            assert [got[i].copies - int(want[s] + 1e-9) for i in same] == [1] * extra + [0] * (len(same) - extra)


def test_one_id_for_all_rows(spark):
    """Rows that hashes can't tell apart still fill their source's target."""
    rows = [(7, "one two three", "a")] * 200 + [(8, "a b c d e f g", "b")] * 500 + [(9, "", "a"), (10, None, "c")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    by, got = check(docs)
    assert all(abs(taken - target) <= largest for taken, target, largest in by.values())
    assert sorted(r.copies for r in got if r.size == 0) == [1, 1]
    n = {r.doc_id: r["count"] for r in mixing.repeated(docs).groupBy("doc_id").count().collect()}
    assert n == {7: sum(r.copies for r in got if r.doc_id == 7), 8: sum(r.copies for r in got if r.doc_id == 8), 9: 1, 10: 1}


def test_many_sources_stop(spark):
    rows = [(i, "w " * (1 + i % 40) * (1 + i % 7), f"s{i % 50:02d}") for i in range(400)] + [(1000, "w " * 50_000, "z")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string, source string"))


def test_empty_tables_and_plans(none, documents):
    assert mixing.repeated(none).count() == 0 and mixing.repeated(none).columns == none.columns
    plan = mixing.repeated(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan  # texts are neither sorted for a rank nor exchanged


def test_many_decisions_meet_rows_by_exchange(odd, monkeypatch):
    want = sorted(map(str, mixing.repeated(odd).select("doc_id").collect()))
    monkeypatch.setattr(mixing, "SENT", 0)
    assert sorted(map(str, mixing.repeated(odd).select("doc_id").collect())) == want


def test_repeated(odd):
    mixed = {}
    for r in mixing.mix(odd).collect():
        mixed[r.doc_id] = mixed.get(r.doc_id, 0) + r.copies
    out = mixing.repeated(odd)
    assert out.columns == odd.columns
    n = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert n == {k: v for k, v in mixed.items() if v}
