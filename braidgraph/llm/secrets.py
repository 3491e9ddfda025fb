"""Secrets in texts, with DataFrame functions only.

Besides the fixed patterns (assignments to password-like names, access key ids, long hexadecimal runs), every long run of
key characters is a candidate: a window slides over it, and as one character enters and one leaves, the counts of its
characters (packed into whole numbers), of its character classes and the sum of c * log2(c) are brought up to date. A
window is dense if its Shannon entropy reaches the limit of its own character class and no allow-list pattern explains
it; overlapping dense windows make one span, and a candidate can hold several.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the base patterns
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]

SYMBOLS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_=-"
WINDOW = 20
CANDIDATE = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{WINDOW},}}"
#: Bits per character that a window must reach, by the first class that takes all of it: digits, hexadecimal digits in one case,
#: letters, digits with letters in one case, digits and letters, anything.
DIGITS, HEXES, LETTERS, ONE_CASE, WORDS, ANY = 9.0, 2.9, 4.0, 3.5, 3.7, 3.9
#: Identifiers of the 8-4-4-4-12 form are no secrets: blanks take their place.
IDENTIFIER = r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
#: What a window may not hold: placeholders, alphabets in order, long repeats; nor be a list of words.
ALLOW = [r"(?i)example|sample|placeholder|dummy|xxxx|your[_-]|changeme", r"(?i)abcdefghij|0123456789|qwertyuiop", r"(.)\1{7}", r"^[-_/=+]*[A-Za-z]+(?:[-_/=+]+[A-Za-z]+)+[-_/=+]*$"]
#: c * log2(c) for the counts that a window can hold, in millionths as whole numbers, so that sums have no rounding of their own.
SCALE = 1_000_000
TERM = [0, *(round(c * math.log2(c) * SCALE) for c in range(1, WINDOW + 1))]
#: Counts of a whole number, each with BITS bits.
PACK, BITS = 12, 5


def largest_sum(bits: float) -> int:
    """The sum of TERM up to which a window has at least so many bits per character."""
    return math.floor((math.log2(WINDOW) - bits) * WINDOW * SCALE + 0.5)


def spans(text: Column, pattern: str, gate: Column) -> Column:
    """(s, e, m): start, end in code points and text of the leftmost non-overlapping matches; none where gate is false.

    The places follow from the lengths of the matches and of the pieces between them.
    """
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    parts = F.transform(parts, lambda p: F.struct(F.length(p["gap"]).alias("g"), p["hit"].alias("m")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)").alias("out"))

    def add(acc: Column, p: Column) -> Column:
        s = acc["at"] + p["g"]
        e = s + F.length(p["m"])
        return F.struct(F.coalesce(e, acc["at"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), p["m"].alias("m")))).alias("out"))

    found = F.aggregate(parts, start, add, lambda acc: F.filter(acc["out"], lambda x: x["m"].isNotNull()))
    return F.when(gate, found).otherwise(F.expr("cast(array() as array<struct<s:int,e:int,m:string>>)"))


def pick(values: list[int], i: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), i + 1)


#: Which class counter a symbol belongs to: digits, a-f, g-z, A-F, G-Z, marks; each counter has 8 bits of one number.
CLASS_OF = [0 if c.isdigit() else 5 if not c.isalpha() else (1 if c in "abcdef" else 2) if c.islower() else (3 if c in "ABCDEF" else 4) for c in SYMBOLS]


def limit_of(k: Column) -> Column:
    """The largest sum of TERM of a dense window, from its class counters."""
    n = lambda i: F.shiftright(k, 8 * i).bitwiseAND(255)
    digits, low, high = n(0), n(1) + n(2), n(3) + n(4)
    full = lambda x: x == WINDOW
    cases = [(full(digits), DIGITS), (full(digits + n(1)) | full(digits + n(3)), HEXES), (full(low + high), LETTERS), (full(digits + high) | full(digits + low), ONE_CASE), (n(5) == 0, WORDS)]
    out = F.when(cases[0][0], largest_sum(cases[0][1]))
    for test, bits in cases[1:]:
        out = out.when(test, largest_sum(bits))
    return out.otherwise(largest_sum(ANY))


def allowed(m: Column) -> Column:
    out = F.lit(False)
    for pattern in ALLOW:
        out = out | m.rlike(pattern)
    return out


def dense_stretches(m: Column) -> Column:
    """(f, t): start and end of each run of overlapping dense windows of a candidate; blanks in it belong to no window."""
    codes = F.transform(F.filter(F.split(m, ""), lambda c: F.length(c) > 0), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    start = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0).cast("bigint"), -(-len(SYMBOLS) // PACK)).alias("n"), F.lit(0).cast("bigint").alias("k"),
        F.lit(0).alias("sum"), F.lit(0).alias("len"), F.expr("cast(array() as array<struct<f:int,t:int>>)").alias("out"),
    )
    one = F.lit(1).cast("bigint")
    place = lambda code: F.pmod(code, F.lit(PACK)) * BITS
    left = lambda x, by: F.call_function("shiftleft", x, by)
    right = lambda x, by: F.call_function("shiftright", x, by)
    count = lambda n, code: right(F.element_at(n, F.floor(code / PACK).cast("int") + 1), place(code)).bitwiseAND((1 << BITS) - 1).cast("int")
    bit = lambda code: left(one, pick(CLASS_OF, code) * 8)

    def changed(n: Column, code: Column, sign: int) -> Column:
        return F.transform(n, lambda v, j: F.when(j == F.floor(code / PACK), v + left(one, place(code)) * sign).otherwise(v))

    def slide(codes: Column) -> Column:
        def leave(acc: Column) -> Column:
            old = F.element_at(codes, acc["i"] - WINDOW + 1)
            c = count(acc["n"], old)
            gone = F.struct(acc["i"].alias("i"), changed(acc["n"], old, -1).alias("n"), (acc["k"] - bit(old)).alias("k"), (acc["sum"] + pick(TERM, c - 1) - pick(TERM, c)).alias("sum"), acc["len"].alias("len"), acc["out"].alias("out"))
            return F.when(acc["len"] == WINDOW, gone).otherwise(acc)

        def enter(acc: Column, new: Column) -> Column:
            c = count(acc["n"], new)
            more = F.struct(
                (acc["i"] + 1).alias("i"), changed(acc["n"], new, 1).alias("n"), (acc["k"] + bit(new)).alias("k"), (acc["sum"] + pick(TERM, c + 1) - pick(TERM, c)).alias("sum"),
                F.least(acc["len"] + 1, F.lit(WINDOW)).alias("len"), acc["out"].alias("out"),
            )
            # a blank empties the window
            none = F.struct((acc["i"] + 1).alias("i"), F.transform(acc["n"], lambda v: v * 0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).alias("sum"), F.lit(0).alias("len"), acc["out"].alias("out"))
            return F.when(new < 0, none).otherwise(more)

        def judge(acc: Column) -> Column:
            f = acc["i"] - WINDOW
            hit = (acc["len"] == WINDOW) & (acc["sum"] <= limit_of(acc["k"])) & ~allowed(F.substr(m, f + 1, F.lit(WINDOW)))
            joins = (F.size(acc["out"]) > 0) & (F.try_element_at(acc["out"], F.lit(-1))["t"] > f)
            begin = F.when(joins, F.try_element_at(acc["out"], F.lit(-1))["f"]).otherwise(f)
            kept = F.when(joins, F.slice(acc["out"], F.lit(1), F.size(acc["out"]) - 1)).otherwise(acc["out"])
            longer = F.concat(kept, F.array(F.struct(begin.alias("f"), acc["i"].alias("t"))))
            return F.struct(acc["i"].alias("i"), acc["n"].alias("n"), acc["k"].alias("k"), acc["sum"].alias("sum"), acc["len"].alias("len"), F.when(hit, longer).otherwise(acc["out"]).alias("out"))

        def step(acc: Column, new: Column) -> Column:
            # one-element arrays keep each part's result, so that it is computed once
            gone = F.transform(F.array(acc), leave)
            more = F.transform(gone, lambda a: enter(a, new))
            return F.element_at(F.transform(more, judge), 1)

        return F.aggregate(codes, start, step, lambda acc: acc["out"])

    return F.element_at(F.transform(F.array(codes), slide), 1)


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns keep and spans: array of (s, k, e, kind) by start, then kind; k is the kind's place in KINDS."""
    text = F.col("_text")
    d = docs.select(*keep, F.coalesce("text", F.lit("")).alias("_text"))
    # cheap tests first: most texts hold no candidate of a kind at all
    d = d.select(
        "*",
        spans(text, ASSIGN, text.rlike(ASSIGN)).alias("_assign"),
        spans(text, r"AKIA[A-Z0-9]{14,}", F.contains(text, F.lit("AKIA"))).alias("_access"),
        spans(text, r"[0-9a-f]{16,}", text.rlike(r"[0-9a-f]{16}")).alias("_hex"),
        spans(text, CANDIDATE, text.rlike(CANDIDATE)).alias("_long"),
    ).select(
        *keep,
        F.filter("_assign", lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 12).alias("_assign"), "_access", "_hex",
        F.transform("_long", lambda x: F.struct(x["s"].alias("s"), F.regexp_replace(x["m"], IDENTIFIER, " " * 36).alias("m"))).alias("_long"),
    )
    row = lambda kind: lambda x: F.struct(x["s"].alias("s"), F.lit(KINDS.index(kind)).alias("k"), x["e"].alias("e"), F.lit(kind).alias("kind"))
    base = F.concat(*(F.transform(f"_{kind}", row(kind)) for kind in KINDS[:3]))
    dense = F.flatten(F.transform("_long", lambda x: F.transform(dense_stretches(x["m"]), lambda d: F.struct((x["s"] + d["f"]).alias("s"), F.lit(3).alias("k"), (x["s"] + d["t"]).alias("e"), F.lit("entropy").alias("kind")))))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,kind:string>>)")
    d = d.select(*keep, base.alias("_base"), F.when(F.size("_long") > 0, dense).otherwise(none).alias("_dense"))
    # a stretch inside a base span tells nothing new
    more = F.filter("_dense", lambda x: ~F.exists("_base", lambda b: (b["s"] <= x["s"]) & (x["e"] <= b["e"])))
    return d.select(*keep, F.array_sort(F.concat("_base", more)).alias("spans"))


def listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document, plus n_entropy.

    Null texts count as empty: no spans. Very long texts are scanned whole. Spans with one start are listed by kind; a
    window just at its limit is dense. Repeated rows get a row each; extra columns are ignored; no rows give no rows.
    """
    out = scanned(docs.select("doc_id", "text"), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda x: x["k"] < 3)
    return out.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"), count("entropy"))
