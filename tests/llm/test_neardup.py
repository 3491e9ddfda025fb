import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from braidgraph.llm import neardup


def shingles(t):
    w = re.findall(r"[^\W_]+", (t or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else [])


def brute(rows, least=0.8):
    ids = [i for i, t in rows if t is not None]
    sets, texts, up = {i: shingles(t) for i, t in rows}, dict(rows), {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(ids), 2):
        x, y = sets[a], sets[b]
        if texts[a] == texts[b] or (x and y and len(x & y) >= least * len(x | y)):
            p, q = sorted((top(a), top(b)))
            up[q] = p
    return {i: top(i) for i, _ in rows}


def test_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("doc_id < 400")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = neardup.duplicate_classes(docs)
    assert {r.doc_id: r.class_id for r in got.collect()} == brute(rows)
    kept = neardup.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(rows).values())) and kept.columns == docs.columns


def test_chains_and_levels(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    rows, i = [], 0
    for _ in range(12):  # each changes one more word of a text of 120
        text = [word() for _ in range(120)]
        for _ in range(12):
            rows.append((i, " ".join(text)))
            i += 1
            text[rnd.randrange(120)] = word()
    common = [word() for _ in range(60)]
    for _ in range(60):  # texts that share a passage but are no copies
        rows.append((i, " ".join([word() for _ in range(60)] + common)))
        i += 1
    got = neardup.duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == brute(rows)


def test_weighted_similarity_is_estimated():
    rnd = np.random.default_rng(3)
    k = 4000
    element = np.arange(200, dtype=np.uint64)
    for _ in range(3):
        a, b = rnd.gamma(1.0, 2.0, 200) * (rnd.random(200) < 0.7), rnd.gamma(1.0, 2.0, 200) * (rnd.random(200) < 0.7)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        doc = np.repeat([0, 1], 200)
        w = np.concatenate([a, b])
        on = w > 0
        sig = neardup.dart_signatures(doc[on], np.concatenate([element, element])[on], w[on], 2, k)
        assert abs((sig[0] == sig[1]).mean() - true) < 4 * np.sqrt(true * (1 - true) / k) + 1e-3


@pytest.mark.parametrize("n", [1, 3, 50, 3000, 40000])
def test_signatures_do_not_depend_on_company(n):
    rnd = np.random.default_rng(n)
    e = rnd.integers(0, 1 << 52, n).astype(np.uint64)
    alone = neardup.dart_signatures(np.zeros(n, int), e, np.ones(n), 1, 64)
    f = rnd.integers(0, 1 << 52, 500).astype(np.uint64)
    both = neardup.dart_signatures(np.repeat([0, 1], [500, n]), np.concatenate([f, e]), np.ones(n + 500), 2, 64)
    assert (both[1] == alone[0]).all() and (alone != ~np.uint64(0)).all()


def test_odd(odd, none):
    rows = neardup.duplicate_classes(odd).collect()
    by = {r.doc_id: (r.class_id, r.class_size) for r in rows}
    assert len(rows) == odd.count()
    assert by[9] == by[1] == (1, 2) and by[5] == (5, 2) and by[2] == (2, 1) and by[None] == (None, 1) and by[3] == (3, 1)
    kept = neardup.keep_first(odd)
    assert kept.columns == odd.columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 1, 2, 3, 4, 5, 6, 7, 8, 10]
    assert neardup.duplicate_classes(none).count() == 0 and neardup.keep_first(none).count() == 0
    twice = odd.where("doc_id = 1").withColumn("doc_id", F.lit(None).cast("long"))
    assert neardup.keep_first(twice.union(twice)).count() == 1


def test_components_of_long_chains(spark):
    rnd = random.Random(5)
    links, want = [], {}
    for n in (1, 2, 500, 1500):
        for order in ("random", "rising"):
            ids = [x - (1 << 61) for x in rnd.sample(range(1 << 62), n + 1)]
            ids = ids if order == "random" else sorted(ids)
            links += zip(ids, ids[1:], strict=False)
            want |= dict.fromkeys(ids, min(ids))
    hub = rnd.sample(range(1 << 62), 300)
    links += [(hub[0], x) for x in hub[1:]] + [(hub[1], hub[0])]
    want |= dict.fromkeys(hub, min(hub))
    got = neardup.components(spark.createDataFrame(links, "a long, b long"))
    assert sorted((r.node, r.comp) for r in got.collect()) == sorted(want.items())


def test_copies_that_resemble_only_their_base(spark):
    rnd = np.random.default_rng(11)
    words = [f"w{i}" for i in range(600)]
    rows = []
    for _ in range(1200):  # about 0.84 like the base, about 0.72 like each other
        text = list(words)
        for k in rnd.choice(598, 11, replace=False):
            text[k] = f"x{rnd.integers(1 << 40)}"
        rows.append((len(rows) + 1, " ".join(text)))
    rows.insert(700, (0, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    base = shingles(rows[700][1])
    assert all(len(base & x) >= 0.8 * len(base | x) for x in (shingles(t) for _, t in rows))  # so all are one class
    assert {r.class_id for r in neardup.duplicate_classes(docs).collect()} == {0}
    few, alone = docs.where("doc_id <= 120"), docs.where("doc_id between 1 and 120")
    for part in (few, alone):
        got = neardup.duplicate_classes(part)
        assert {r.doc_id: r.class_id for r in got.collect()} == brute([r for r in rows if r[0] <= 120 and (r[0] or part is few)])


def test_pairs_in_crowded_buckets(spark):
    """A thousand pairs just above the limit, all of whose texts share a passage: no link may be lost."""
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abcdefghijkl") for _ in range(7))
    common, rows = [word() for _ in range(100)], []
    for _ in range(1000):
        own = [word() for _ in range(104)]
        rows.append((len(rows), " ".join(common + own)))
        rows.append((len(rows), " ".join(common + own[:84] + [word() for _ in range(20)])))
    sets = [shingles(t) for _, t in rows]
    assert all(len(a & b) >= 0.8 * len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True))
    got = neardup.duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == {i: i - i % 2 for i in range(2000)}


def test_equal_texts_of_one_task_and_many_short_ones(spark):
    rows = [(i, f"a text of some words with number {i // 3} at its end") for i in range(15_000)]
    got = neardup.duplicate_classes(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1))
    one = {r.doc_id: r.class_size for r in got.collect()}
    assert len(one) == 15_000 and all(n >= 3 for n in one.values())
    assert {i for i, _ in neardup.textfeat.chunks(["x"] * 10_000)} == {0, 4096, 8192}


def test_shared_elements():
    rnd = np.random.default_rng(2)
    x, y = ([np.unique(rnd.integers(0, top, n)).astype("<u8") for n in (0, 1, 50, 30_000)] for top in (20_000, 40_000))
    assert neardup.shared_elements(x, y).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]
