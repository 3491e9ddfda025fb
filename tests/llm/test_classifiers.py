import numpy as np
import pytest
from pyspark.sql import functions as F

from braidgraph.llm import langid, quality, textfeat, toxicity
from braidgraph.llm._common import fold


@pytest.fixture(scope="module")
def big(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def accuracy(scores, labels, column):
    both = scores.where("held_out").join(labels, "doc_id")
    return both.agg(F.avg((F.col("predicted") == F.col(column)).cast("int"))).first()[0]


def test_quality(big):
    assert accuracy(quality.quality_scores(*big), big[1], "quality") > 0.97


def test_toxicity(big):
    scores = toxicity.toxicity_scores(*big)
    assert accuracy(scores, big[1], "toxic") > 0.94
    both = scores.where("held_out").join(big[1], "doc_id").where("toxic = 1")
    assert both.agg(F.avg("predicted")).first()[0] > 0.85


def test_language(big):
    got = langid.language_of(big[0]).join(big[0].select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert got.agg(F.avg(F.col("rejected").cast("int"))).first()[0] < 0.005


def test_held_out_labels_do_not_matter(documents, labels):
    turned = labels.withColumn("quality", F.when(fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality"))).withColumn("toxic", F.when(fold(F.col("doc_id"), 5) == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        assert sorted(map(tuple, f(documents, labels).collect())) == sorted(map(tuple, f(documents, turned).collect()))


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (5, 1, None), (5, 0, 1), (None, 1, 1), (9, None, 1), (777, 0, 0)], "doc_id bigint, quality int, toxic int")
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        rows = f(odd, labels).collect()
        assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
        by = {r.doc_id: r.score for r in rows}
        assert by[2] == by[3]
        assert f(none, labels).count() == 0
        assert f(odd, labels.where("doc_id = 0")).count() == odd.count()
    rows = {r.doc_id: r for r in langid.language_of(odd).collect()}
    assert [rows[i].lang_pred for i in (2, 3, 6, 7)] == ["und"] * 4 and all(rows[i].rejected and rows[i].score == 0 for i in (2, 3, 6, 7))
    assert rows[1].lang_pred in {"en", "fr", "de", "xx"}
    assert langid.language_of(none).count() == 0
    assert {r.lang_pred for r in langid.language_of(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    kept = langid.keep_known(odd)
    assert kept.columns == odd.columns and 0 < kept.count() < odd.count()


def test_rejects_unknown_script(spark, documents):
    model = langid.fit(documents.select("doc_id", "text", "lang"))
    far = spark.createDataFrame([(1, "这是一个完全不同的语言的句子" * 5), (2, "Это предложение на совсем другом языке " * 5)], "doc_id bigint, text string")
    assert all(r.rejected for r in langid.predict(far, model, ["doc_id"]).collect())


def test_dual_descent_reaches_the_optimum():
    """The dual's optimum has the primal's value."""
    rnd = np.random.default_rng(1)
    x = rnd.normal(size=(60, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 1] + 0.3 * rnd.normal(size=60) > 0, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w = quality.dual_coordinate_descent(rows, y, np.full(60, 0.7), 5, 3000, 1)
    primal = lambda w: 0.5 * w @ w + 0.7 * np.maximum(0, 1 - y * (x @ w[:5] + w[5])).sum()
    best, v, step = None, np.zeros(6), 0.05
    for i in range(20000):
        bad = y * (x @ v[:5] + v[5]) < 1
        v = v - step / np.sqrt(1 + i) * (v - 0.7 * np.append((y[bad, None] * x[bad]).sum(0), y[bad].sum()))
        best = primal(v) if best is None else min(best, primal(v))
    assert primal(w) <= best + 1e-2


def test_non_negative_risk_on_toy_data():
    rnd = np.random.default_rng(2)
    word = lambda p: np.unique(np.concatenate([rnd.integers(100, 5000, 20), *([rnd.integers(0, 3, 2)] if p else [])]))
    pos, unl = [word(True) for _ in range(300)], [word(i % 10 == 0) for i in range(2000)]
    m = toxicity.risk_steps(pos, unl, 0.1)
    s = m(np.repeat(np.arange(2000), [len(u) for u in unl]), np.concatenate(unl), 2000)
    truth = np.arange(2000) % 10 == 0
    assert ((s >= 0.5) == truth).mean() > 0.99


def test_tokens_against_plain_python():
    import re

    texts = ["Hello, World!  x9 hello", "", "a--b hello", "ÄÖ ß\n\nhello"]
    h, doc = textfeat.tokens(texts)
    want = [(i, t) for i, s in enumerate(texts) for t in re.findall(r"\w+|[^\w\s]+", s.lower())]
    assert doc.tolist() == [i for i, _ in want]
    ids = {}
    for (_, t), v in zip(want, h.tolist(), strict=True):
        assert ids.setdefault(t, v) == v
    assert len(set(ids.values())) == len(ids)
    whole, _, stem, _ = textfeat.tokens(["abcdefg abcd abcdzzz"], stems=True)
    assert len(stem) == 4 and stem[0] == stem[1] and stem[2] != stem[3] and len(whole) == 3


M = (1 << 64) - 1


def mix(x):
    """The finaliser with plain whole numbers."""
    x = (x + 0x9E3779B97F4A7C15) & M
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M
    return x ^ (x >> 31)


def plain_indicators(text, pairs):
    import math

    # str.isspace and control characters end a token; letters and digits run together, other marks run together
    kind = lambda c: 1 if c.isalnum() or c.isnumeric() else 0 if c.isspace() or c < " " else 2
    runs, out = [], set()
    for c in text.lower():
        if kind(c) and runs and runs[-1][0] == kind(c):
            runs[-1][1] += c
        else:
            runs.append([kind(c), c if kind(c) else ""])
    words = [w for k, w in runs if k]
    value = lambda w: sum((ord(c) + 1) * pow(0x100000001B3, i, 1 << 64) for i, c in enumerate(w)) & M
    h = [mix(value(w)) for w in words]
    out |= {x >> 44 for x in h} | {mix((value(w[:n]) + n) & M) >> 44 for w in words for n in (4, 5) if len(w) > n}
    if pairs and len(h) > 1:
        both = [mix((a * 3 + b) & M) for a, b in zip(h, h[1:], strict=False)]
        again, fresh = sum(a == b for a, b in zip(h, h[1:], strict=False)), len(set(both))
        out |= {x >> 44 for x in both} | {mix(1000 + math.ceil(8 * again / len(both))) >> 44, mix(2000 + math.ceil(8 * (len(both) - fresh) / len(both))) >> 44}
    return out


def sigmoid(x):
    import math

    return 1 / (1 + math.exp(-x))


@pytest.fixture(scope="module")
def few(spark):
    d, la = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    return d, la, {r.doc_id: r.text for r in d.collect()}


def test_quality_scores_by_brute_force(few):
    """Features, margins and predictions with sets and loops; which rows are learnt from, and the ratios."""
    import math
    import zlib

    docs, labels, texts = few
    model = quality.fit(docs, labels.where(fold(F.col("doc_id"), 4) != 2))
    for r in quality.quality_scores(docs, labels).collect():
        f = plain_indicators(texts[r.doc_id] or "", True)
        want = sigmoid(model.slope * (sum(model.weights[i] for i in f) / math.sqrt(max(1, len(f))) + model.bias) + model.offset)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    x, y = [sorted(plain_indicators(t or "", True)) for t in list(texts.values())[:60]], np.arange(60) % 2
    ratio = quality.log_count_ratio([np.array(a, np.int64) for a in x], y)
    count = {s: {} for s in (0, 1)}
    for a, s in zip(x, y.tolist(), strict=True):
        for i in a:
            count[s][i] = count[s].get(i, 0) + 1
    whole = {s: sum(count[s].values()) + (1 << 20) for s in (0, 1)}
    for i in {*count[0], *count[1]}:
        assert ratio[i] == pytest.approx(math.log((count[1].get(i, 0) + 1) / whole[1]) - math.log((count[0].get(i, 0) + 1) / whole[0]))


def test_toxicity_scores_by_brute_force(few):
    import zlib

    docs, labels, texts = few
    seen = fold(F.col("doc_id"), 5) != 0
    model = toxicity.fit(docs.where(seen), labels.where(seen))
    for r in toxicity.toxicity_scores(docs, labels).collect():
        want = sigmoid(sum(model.weights[i] for i in plain_indicators(texts[r.doc_id] or "", False)) + model.bias)
        assert r.score == pytest.approx(want, abs=1e-9) and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_language_by_brute_force(few):
    """Vectors as dictionaries, cosines by loops, the nearest centroid and the rejection."""
    import math

    docs, _, texts = few
    model = langid.fit(docs.select("doc_id", "text", "lang").where(fold(F.col("doc_id"), 3) != 1))
    seeds = [0, 0x51ED270B7A3C1F4D, 0x2545F4914F6CDD1D, 0x6C62272E07BB0142]
    for r in langid.language_of(docs).collect():
        t = (texts[r.doc_id] or "").lower() + "\n"
        letters = sum(c.isalpha() for c in t)
        code = [ord(c) if c.isalpha() else 32 for i, c in enumerate(t) if c.isalpha() or i == 0 or t[i - 1].isalpha()]
        count = {}
        for n in (1, 2, 3):
            for i in range(len(code) - n + 1):
                h = 0
                for c in code[i : i + n]:
                    h = (h * 0x1000193 + c + 1) & M
                f = mix(h ^ seeds[n]) >> 51
                count[f] = count.get(f, 0) + 1
        v = {f: (1 + math.log(n)) * float(model.idf[f]) for f, n in count.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        cos = [sum(x * float(c[f]) for f, x in v.items()) / norm for c in model.centroids]
        assert r.score == pytest.approx(max(cos) if letters else 0.0, abs=1e-5)
        if letters:
            assert max(c for c, name in zip(cos, model.names, strict=True) if name == r.lang_pred) > max(cos) - 1e-5
            assert abs(max(cos) - model.least[min(int(math.log2(letters)), 23)]) < 1e-5 or r.rejected == (max(cos) < model.least[min(int(math.log2(letters)), 23)])


def test_bounds_of_the_samples(spark, documents, labels):
    """Many languages, one repeated id and long texts keep the fits within their documented bounds."""
    odd = spark.range(2000).selectExpr("id as doc_id", "concat('text of number ', id % 40, ' and more words') as text", "concat('l', lpad(id % 400, 3, '0')) as lang")
    model = langid.fit(odd, languages=7)
    assert sorted(set(model.names)) == [f"l{i:03d}" for i in range(7)]
    same = spark.range(3000).selectExpr("cast(1 as bigint) as doc_id", "'the very same text again' as text", "'en' as lang")
    assert set(langid.fit(same, per_language=50).names) == {"en"}
    n = quality.linear.learnt(documents.withColumn("y", F.lit(1)), ["y"], 1, lambda rows, x: (len(rows), sum(map(len, x))), most_features=50_000)
    assert 0 < n[0] < documents.count() and n[1] <= 50_000


def test_ties(spark, few):
    """Equal texts score alike; a text between two equal languages goes to the first by code point."""
    docs, labels, _ = few
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    for f in (quality.quality_scores, toxicity.toxicity_scores):
        by = {r.doc_id: r.score for r in f(twice, labels).collect()}
        assert all(by[i] == by[i + 1_000_000] for i in by if i < 1_000_000)
    rows = [(i, f"some words of a text with {w}", lang) for i, (w, lang) in enumerate((w, lang) for w in ("one", "two", "three") for lang in ("b", "a", "c"))]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    got = langid.predict(spark.createDataFrame([(1, "some words of a text with one")], "doc_id bigint, text string"), model, ["doc_id"]).first()
    assert got.lang_pred == "a"
