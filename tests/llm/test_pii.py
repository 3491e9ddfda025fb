import hashlib
import itertools
import re

import pytest
from pyspark.sql import functions as F

from braidgraph.llm import pii

T = """Mail anna.b-7@shop.example.com or bob@mail.test.org, call +1 (017) 555-7713 or (030) 1234 5678, card 4539 1488 0343 6467 and 9807915762804490,
ip 97.51.17.173, ssn 123-45-6789, IBAN DE89 3704 0044 0532 0130 00. Mrs Anna Keller met Herr Karl Muster; later Keller and Anna left. Версия 1.2 от г. Господин Иван Петров."""


def run(spark, texts, key="k"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r.text for r in pii.surrogate_report(df, key).orderBy("doc_id").collect()]


def luhn_ok(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def test_kinds(spark):
    df = spark.createDataFrame([(1, T)], "doc_id bigint, text string")
    found = {(r.kind, r.entity): r.surrogate for r in pii.entities(df, "k").collect()}
    kinds = sorted(k for k, _ in found)
    assert kinds == ["card", "email", "email", "iban", "ip", "name", "name", "name", "name", "name", "phone", "phone", "ssn"]
    for (kind, old), new in found.items():
        assert new != old
        if kind != "ip":
            assert re.sub(r"\w", "", old) == re.sub(r"\w", "", new) and len(old) == len(new) or kind == "name"
    assert luhn_ok(found["card", "4539 1488 0343 6467"]) and found["card", "4539 1488 0343 6467"][0] == "4"
    assert iban_ok(found["iban", "DE89 3704 0044 0532 0130 00"])
    assert found["phone", "+1 (017) 555-7713"].startswith("+1 (")
    assert all(0 <= int(o) < 256 for o in found["ip", "97.51.17.173"].split("."))
    assert found["email", "anna.b-7@shop.example.com"].endswith(".example.com")
    _, given, last = found["name", "Mrs Anna Keller"].split(" ")
    assert given in pii.GIVEN["female latin"] and found["name", "Anna"] == given and found["name", "Keller"] == last
    assert last[-1] == "r" and last not in sum(pii.GIVEN.values(), [])
    assert found["name", "Herr Karl Muster"].split(" ")[1] in pii.GIVEN["male latin"]
    name = found["name", "Господин Иван Петров"].split(" ")
    assert name[0] == "Господин" and name[1] in pii.GIVEN["male cyrillic"] and re.fullmatch("[А-Яа-яё]{6}", name[2])
    assert pii.conflicts(pii.entities(df, "k")).count() == 0


def test_only_entities_change(spark):
    out = run(spark, [T])[0]
    assert out != T
    for kept in ("Mail ", ", call ", ", ssn ", "; later ", " left. Версия 1.2 от г. "):
        assert kept in out
    for gone in ("anna.b", "555-7713", "97.51.17.173", "123-45-6789", "Keller", "Петров"):
        assert gone not in out
    clean = ["No data here, 12 apples at 3.50 on 2024-01-02, version 10.0.1 and code A1B2.", "Dr", "Mr", ""]
    assert run(spark, clean) == clean


def test_key_and_coreference(spark):
    a, b = run(spark, ["x bob@mail.test.org y", "bob@mail.test.org"])
    assert a == f"x {b} y"
    assert run(spark, ["bob@mail.test.org"], "other") != [b]
    same = run(spark, ["al@mail.test.org", "bo@mail.test.org"])
    assert same[0].split("@")[1] == same[1].split("@")[1]


@pytest.mark.parametrize("shape", [["0123456789"] * 3, ["aeiou", "aeiou", "aeiou", "0123456789"], ["BCD", "aeiou", "bcd"], ["0123456789"], ["-", "0123456789", "aeiou"]])
def test_permutation(spark, shape):
    """All strings of a shape go to strings of that shape, each to its own, none to itself."""
    full = [next((a for a in pii.ASCII if set(x) <= set(a)), x) for x in shape]
    words = ["".join(p) for p in itertools.product(*full)]
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", pii.permuted(F.col("w"), "k", F.lit("t")).alias("p"))
    got = {r.w: r.p for r in df.collect()}
    assert set(got.values()) == set(words) and all(a != b for a, b in got.items())
    assert got == {w: permuted(w, "k", "t", pii.ASCII) for w in words}


def sha(*parts):
    return hashlib.sha256("\x1f".join(parts).encode()).digest()


def moved(c, by, alphabets):
    own = next((a for a in alphabets if c in a), None)
    if own:
        return own[(own.index(c) + by) % len(own)]
    run = next(((a, b) for a, b in pii.RUNS if a <= ord(c) <= b), None) if alphabets is EVERY else None
    return chr(run[0] + (ord(c) - run[0] + by) % (run[1] - run[0] + 1)) if run else c


EVERY = [*pii.ALPHABETS, *pii.OTHER]


def permuted(text, key, tweak, alphabets):
    x, cut = list(text), len(text) // 2
    for r in [*range(1, 7), 0, *range(-6, 0)]:
        if r == 0:
            i = next((i for i, c in enumerate(x) if moved(c, 1, alphabets) != c), None)
            if i is not None:
                x[i] = moved(x[i], 1, alphabets)
            continue
        left, right = x[:cut], x[cut:]
        still, going = (left, right) if r % 2 else (right, left)
        d = sha(key, tweak, str(abs(r)), "".join(still))
        going = [moved(c, d[i % 32] * (1 if r > 0 else -1), alphabets) for i, c in enumerate(going)]
        x = left + going if r % 2 else going + right
    return "".join(x)


def fill(shape, new):
    it = iter(new)
    return re.sub("[0-9]", lambda _: next(it), shape)


def plain(kind, m, key):
    """The surrogates by their definition, without Spark."""
    num = re.sub("[^0-9]", "", m)
    if kind == "email":
        local, domain = m.split("@")
        tail = re.search(r"^[^.]+.*?((?:\.example)?\.[^.]+)$", domain, re.I)[1]
        head = domain[: -len(tail)]
        new = permuted(head.lower(), key, "domain", pii.ASCII)
        return permuted(local, key, "local" + domain.lower(), pii.ASCII) + "@" + "".join(b.upper() if a.isupper() else b for a, b in zip(head, new, strict=True)) + tail
    if kind == "ssn":
        return fill(m, permuted(num, key, "ssn", [pii.DIGITS]))
    if kind == "card":
        body = num[0] + permuted(num[1:-1], key, "card" + num[0], [pii.DIGITS])
        return fill(m, body + next(c for c in "0123456789" if luhn_ok(body + c)))
    if kind == "phone":
        code = re.match(pii.COUNTRY, num)[0] if m[0] == "+" else "1" if m.startswith("1-") else ""
        core = num[len(code) :].lstrip("0")
        new = permuted("ABCDEFGHI"[int(core[0]) - 1] + core[1:], key, "phone", [pii.DIGITS, "ABCDEFGHI"])
        return fill(m, num[: len(num) - len(core)] + str("ABCDEFGHI".index(new[0]) + 1) + new[1:])
    if kind == "ip":
        a, b, c, d = map(int, m.split("."))
        x = [a * 256 + b, c * 256 + d]
        for r in [*range(1, 7), 0, *range(-6, 0)]:
            if r == 0:
                x[0] = (x[0] + 1) % 65536
            else:
                i = 0 if r % 2 else 1
                x[i] = (x[i] + (1 if r > 0 else -1) * int(sha(key, "ip", str(abs(r)), str(x[1 - i])).hex()[:4], 16)) % 65536
        return f"{x[0] // 256}.{x[0] % 256}.{x[1] // 256}.{x[1] % 256}"
    raise AssertionError(kind)


def brute(text, key):
    """Detection with Python's expressions; the documents hold no names, IBANs or long addresses."""
    import regex

    found = []

    def new(m):
        m = m[0]
        kind = next(k for k, p in pii.KINDS.items() if regex.fullmatch(regex.sub(r"Is(Han)", r"\1", p), m, regex.A))
        if kind == "card" and not (luhn_ok(m) and m[0] in "23456"):
            return m
        found.append(kind)
        return plain(kind, m, key)

    out = regex.sub(regex.sub(r"Is(Han)", r"\1", pii.PATTERN), new, text, flags=regex.A)
    return out, [found.count(k) for k in pii.KINDS]


def test_documents_against_brute_force(documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in pii.surrogate_report(documents, "k").collect():
        assert tuple(r)[1:] == (brute(texts[r.doc_id], "k")[0], *brute(texts[r.doc_id], "k")[1])


def test_distinct_addresses(spark):
    cards = [c for i in range(12_000) if luhn_ok(c := f"4000 0000 {i:04d} {i * 7 % 10000:04d}")]
    ips = [f"10.{i % 7}.{i // 256}.{i % 256}" for i in range(1500)]
    out = run(spark, cards + ips)
    assert len(set(out)) == len(set(cards + ips)) and all(luhn_ok(x) for x in out[: len(cards)])


def test_forms_of_one_entity(spark):
    same = ["+49301234567", "+49 30 1234567", "030 1234567", "+49 (030) 1234567"]
    core = {re.sub(r"\D", "", t.removeprefix("+49")).lstrip("0") for t in run(spark, same)}
    assert len(core) == 1 and core != {"301234567"}
    us = run(spark, ["+1 (617) 555-7713", "(617) 555-7713", "1-617-555-7713", "617-555-7713", "617 555 7713"])
    assert len({re.sub(r"\D", "", t)[-10:] for t in us}) == 1 and us[0].startswith("+1 (") and us[2].startswith("1-")
    a, b, c = run(spark, ["Bob@MAIL.org", "Bob@mail.org", "bob@mail.org"])
    assert a != b and a.lower() == b.lower() != c.lower() and a.split("@")[1].removesuffix(".org").isupper()
    assert len({t.replace(" ", "") for t in run(spark, ["DE89 3704 0044 0532 0130 00", "DE89370400440532013000"])}) == 1


def test_names_of_all_scripts(spark):
    texts = ["Mr Łšžčřňťď came", "Mrs Şőøł Ñandú came", "Mr 王明 came", "Mr محمد came", "Dr Ἀλέξανδρος came", "Frau Ծովինար came", "John Smith lives here", "my name is Xenia Quux", "王小明先生", "Dr Li came, Li left"]
    out = run(spark, texts)
    for old, new in zip(texts, out, strict=True):
        kept = re.findall(r"Mr |Mrs |Dr |Frau | came| left| lives here|my name is |先生", old)
        assert all(k in new for k in kept) and old != new and len(re.sub("John|my name is ", "", old)) <= len(new) + 6
        words = [w for w in re.split(r"[ ,]+", old) if w not in ("Mr", "Mrs", "Dr", "Frau", "came", "left", "lives", "here", "my", "name", "is")]
        assert not any(w in re.split(r"[ ,]+", new) for w in words), (old, new)
    assert out[6].split(" ")[0] in pii.GIVEN["male latin"]
    clean = ["at 1700000000000 ms", "order 1234567890123456", "call std::vector or a::b at 12:30:45", "John went home. Paul", "version 1.2.3 of 100 200 300"]
    assert run(spark, clean) == clean


def test_conflicts_are_raised(spark, monkeypatch):
    rows = [("phone", "+49301234567", "+49301234568"), ("phone", "+49 30 1234567", "+49 30 1234569"), ("ssn", "1", "2"), ("ssn", "3", "2"), ("email", "a@B.c", "a@b.c")]
    bad = pii.conflicts(spark.createDataFrame(rows, "kind string, entity string, surrogate string")).collect()
    assert sorted(r.reason for r in bad) == ["changing", "kept", "shared"]
    monkeypatch.setitem(pii.MAKERS, "ssn", lambda m, k: F.lit("000-00-0000"))
    with pytest.raises(pii.Collision):
        run(spark, ["123-45-6789", "123-45-6780"])


def test_odd(odd, none):
    out = pii.with_surrogates(odd)
    assert out.columns == odd.columns
    assert sorted(map(str, out.collect())) == sorted(map(str, odd.withColumn("n_chars", F.length("text").cast("long")).collect()))
    assert pii.with_surrogates(none).count() == 0 and pii.surrogate_report(none).count() == 0
