"""Personal data replaced by surrogates, with DataFrame functions only.

Detected entities get keyed replacements of their own type, script and format: digits stay digits, vowels stay vowels of
the same alphabet and case, letters of other scripts stay in their script, case and block; punctuation, country codes,
titles and the first digit of a card stay; given names of the word lists become others of the same gender and script.
Every replacement is a keyed permutation of all strings of the same shape without a fixed point: the text is scrambled by
alternating rounds in which one half of the characters is shifted by a hash of the other, its first character moves one
place on in its alphabet, and the rounds are undone. So equal entities have equal surrogates in all documents, different
ones differ, and none stays, at any size and without a table of entities. A made name that meets the word lists is
permuted again until it doesn't, which keeps it a permutation. All this is checked on what the corpus really holds:
surrogates that two entities share, entities with two surrogates, and surrogates equal to their entity raise Collision.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import staged

# fixed values: titles and phrases that go before names, what follows names, and given names by gender and script
TITLES = ["Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Sr", "Sra", "Señor", "Señora", "Signor", "Signora", "Господин", "Госпожа", "Κύριος", "Κυρία"]
PHRASES = ["my name is", "mein Name ist", "ich heiße", "je m'appelle", "mi nombre es", "me llamo", "mi chiamo", "меня зовут", "με λένε"]
SUFFIXES = ["先生", "女士", "小姐", "さん", "様", "님", "씨"]
GIVEN = {
    "female latin": [
        "Alice", "Amelia", "Andrea", "Anna", "Barbara", "Beatrice", "Camille", "Carmen", "Caroline", "Charlotte", "Claire", "Clara", "Diana", "Elena", "Elizabeth", "Emily", "Emma", "Eva", "Greta", "Helen",
        "Ines", "Isabel", "Jennifer", "Julia", "Karen", "Laura", "Linda", "Lisa", "Lucia", "Maria", "Mary", "Nina", "Olivia", "Patricia", "Paula", "Rosa", "Sarah", "Sofia", "Susan", "Teresa",
    ],
    "male latin": [
        "Adam", "Alexander", "Anthony", "Antonio", "Carlos", "Charles", "Daniel", "David", "Diego", "Edward", "Felix", "Francisco", "George", "Hans", "Henry", "James", "John", "Jose", "Joseph", "Karl",
        "Lewis", "Louis", "Manuel", "Marc", "Martin", "Max", "Michael", "Miguel", "Oliver", "Otto", "Paul", "Pedro", "Peter", "Philipp", "Pierre", "Richard", "Robert", "Stefan", "Thomas", "William",
    ],
    "female cyrillic": ["Анна", "Вера", "Дарья", "Екатерина", "Елена", "Ирина", "Мария", "Наталья", "Нина", "Ольга", "Светлана", "Татьяна"],
    "male cyrillic": ["Александр", "Алексей", "Андрей", "Борис", "Владимир", "Дмитрий", "Иван", "Михаил", "Николай", "Олег", "Пётр", "Сергей"],
    "female greek": ["Αικατερίνη", "Βασιλική", "Γεωργία", "Ελένη", "Κωνσταντίνα", "Μαρία", "Σοφία"],
    "male greek": ["Βασίλειος", "Γεώργιος", "Δημήτριος", "Ιωάννης", "Κωνσταντίνος", "Νικόλαος", "Παναγιώτης"],
}
# fixed values: alphabets within which a character is replaced
DIGITS, HEX = "0123456789", "0123456789abcdef"
ASCII = [DIGITS, "aeiou", "bcdfghjklmnpqrstvwxyz", "AEIOU", "BCDFGHJKLMNPQRSTVWXYZ"]
ALPHABETS = [
    *ASCII, "áéíóúàèìòùâêîôûäëïöü", "ÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄËÏÖÜ", "ñçß", "ÑÇ",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "АЕЁИОУЫЭЮЯ", "БВГДЖЗЙКЛМНПРСТФХЦЧШЩ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "ΑΕΗΙΟΥΩ", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ",
]
ROUNDS = 6
# fixed values: country calling codes of one and two digits; all others have three
COUNTRY = r"^(?:[17]|2[07]|3[0123469]|4[013456789]|5[12345678]|6[0123456]|8[1246]|9[0123458]|\d{3})"


def other_letters() -> tuple[list[str], list[tuple[int, int]]]:
    """Alphabets of all letters outside ALPHABETS: those with case by script, case and block of 128 code points, as text;
    others as runs of code points (from, to) of one script."""
    known = set("".join(ALPHABETS))
    groups: dict[tuple, list[str]] = {}
    runs: list[list] = []
    for i in range(0x80, 0x33480):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind not in ("Lu", "Ll", "Lt", "Lo") or c in known:
            continue
        script = unicodedata.name(c, "?").split(" ")[0]
        if kind != "Lo":
            groups.setdefault((script, kind, i // 128), []).append(c)
        elif runs and runs[-1][1:] == [i - 1, script]:
            runs[-1][1] = i
        else:
            runs.append([i, i, script])
    for a, b, script in runs:
        if a == b:
            groups.setdefault((script, "Lo", 0), []).append(chr(a))
    out = {k: v for k, v in groups.items() if len(v) > 1}
    for k in sorted(groups):  # a single letter joins others of its script and case, or all such
        if len(groups[k]) == 1:
            out.setdefault(next((o for o in out if o[:2] == k[:2]), ("lone", k[1], 0)), []).extend(groups[k])
    return ["".join(v) for v in out.values() if len(v) > 1], [(a, b) for a, b, _ in runs if a < b]


OTHER, RUNS = other_letters()

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
H4 = "[0-9A-Fa-f]{1,4}"
CUE = rf"(?<![\p{{L}}\d])(?:(?:{'|'.join(TITLES)})\.?|(?i:{'|'.join(PHRASES)}))\x20{{1,2}}"
NAME_WORD = r"(?:\p{Lu}[\p{L}\p{M}'’-]+|\p{Lo}[\p{Lo}\p{M}]{1,11})"
LISTED = "|".join(n for names in GIVEN.values() for n in names)
#: By kind, in the order in which they are tried at a place.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\d)(?!\w)|(?<![\w:.])(?:(?:{H4}:){{7}}{H4}|(?:{H4}:){{2,6}}(?::{H4}){{1,5}})(?![\w:])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\w)|(?<![\w.-])(?:1-)?\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-])"
    r"|(?<![\w.,-])\d{3}\x20\d{3}\x20\d{4}(?![\w-])|(?<![\w.,-])0\d{1,4}[\x20/-]\d{3,4}\x20?\d{3,5}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<!\w)\d{4}(?:(?:[ -]?\d{4}){2}[ -]?\d{1,7}|[ -]\d{6}[ -]\d{4,5})(?!\w)",
    "name": rf"{CUE}{NAME_WORD}(?:\x20{NAME_WORD}){{0,2}}|(?<![\p{{L}}\d])(?:{LISTED})(?:\x20\p{{Lu}}[\p{{L}}\p{{M}}'’-]+){{1,2}}|\p{{IsHan}}{{2,4}}(?={'|'.join(SUFFIXES)})|\p{{IsHangul}}{{2,4}}(?=\x20?(?:{'|'.join(SUFFIXES)}))",
}
PATTERN = "|".join(KINDS.values())


class Collision(ValueError):
    """Surrogates of a corpus are not distinct, not the same everywhere, or no surrogates at all."""


def chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: F.length(c) > 0)


def hashed(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", *parts), 256)


def byte_at(digest: Column, i: Column) -> Column:
    return F.conv(F.substr(digest, F.pmod(i, F.lit(32)).cast("int") * 2 + 1, F.lit(2)), 16, 10).cast("int")


def letter(code: Column) -> Column:
    """The character of a code point."""
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def listed(values: list) -> Column:
    """An array of strings, as one constant."""
    return F.split(F.lit(",".join(map(str, values))), ",")


def mover(alphabets: list[str], wide: bool = False) -> Callable[[Column, Column], Column]:
    """A function of a character and a number: the character so many places on in its alphabet; others stay.

    All alphabets are one text, and for each of its places it is known where the alphabet begins and how long it is.
    wide: letters of RUNS as well.
    """
    text = F.lit("".join(alphabets))
    begins = listed([x for i, a in enumerate(alphabets) for x in [sum(map(len, alphabets[:i]))] * len(a)])
    sizes = listed([len(a) for a in alphabets for _ in a])

    def moved(c: Column, by: Column) -> Column:
        def within(at: Column) -> Column:
            begin, size = (F.element_at(x, at.cast("int")).cast("int") for x in (begins, sizes))
            out = F.when(at > 0, F.substr(text, (begin + F.pmod(at - 1 - begin + by, size) + 1).cast("int"), F.lit(1)))
            if wide:
                code, end = F.ascii(c), lambda run, i: F.split_part(run, F.lit("-"), F.lit(i)).cast("int")
                run = F.filter(listed([f"{a}-{b}" for a, b in RUNS]), lambda run: code.between(end(run, 1), end(run, 2)))
                inside = lambda run: F.when(run.isNull(), c).otherwise(letter(F.pmod(code - end(run, 1) + by, end(run, 2) - end(run, 1) + 1) + end(run, 1)))
                return F.when(at > 0, out).when(code < 128, c).otherwise(once(F.try_element_at(run, F.lit(1)), inside))
            return out.otherwise(c)

        return once(F.instr(text, c), within)

    return moved


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once: it travels in a one-element array."""
    return F.element_at(F.transform(F.array(value), use), 1)


def permuted(text: Column, key: str, tweak: Column, alphabets: list[str] = ASCII, wide: bool = False) -> Column:
    """A keyed permutation of the strings of the text's shape: same length, same alphabet at each place, no string kept."""
    moved = mover(alphabets, wide)

    def scrambled(x: Column, r: Column) -> Column:
        """Round r, or for negative r its inverse: one half of the characters moves by a hash of the other."""
        cut = F.floor(F.size(x) / 2).cast("int")
        left, right = F.slice(x, F.lit(1), cut), F.slice(x, cut + 1, F.size(x) - cut)
        odd = F.abs(r) % 2 == 1
        digest = hashed(F.lit(key), tweak, F.abs(r).cast("string"), F.array_join(F.when(odd, left).otherwise(right), ""))
        new = once(digest, lambda d: F.transform(F.when(odd, right).otherwise(left), lambda c, i: moved(c, byte_at(d, i) * F.signum(r).cast("int"))))
        return F.when(odd, F.concat(left, new)).otherwise(F.concat(new, right))

    def shifted(x: Column) -> Column:
        """The first character that can moves one place on."""
        return once(F.transform(x, lambda c: moved(c, F.lit(1))), lambda y: once(F.array_position(F.zip_with(x, y, lambda c, d: c != d), F.lit(True)), lambda first: F.transform(x, lambda c, i: F.when(i + 1 == first, F.element_at(y, i + 1)).otherwise(c))))

    turns = listed([*range(1, ROUNDS + 1), 0, *range(-ROUNDS, 0)])
    step = lambda x, r: F.when(r == 0, shifted(x)).otherwise(scrambled(x, r))
    return F.array_join(F.aggregate(F.transform(turns, lambda r: r.cast("int")), chars(text), step), "")


def digits(s: Column) -> Column:
    return F.transform(chars(F.regexp_replace(s, "[^0-9]", "")), lambda c: c.cast("int"))


def refilled(shape: Column, new: Column, what: str = "[0-9]") -> Column:
    """shape with its digits (or what else) replaced, in order, by the characters of the string new."""
    cut = F.split(shape, what, -1)
    return F.concat_ws("", F.flatten(F.zip_with(cut, chars(new), lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))))


def luhn(d: Column) -> Column:
    """The check digit that belongs after the digits d."""

    def add(acc: Column, x: Column) -> Column:
        twice = x * 2
        value = F.when(acc["odd"], F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)
        return F.struct((acc["s"] + value).alias("s"), (~acc["odd"]).alias("odd"))

    total = F.aggregate(F.reverse(d), F.struct(F.lit(0).alias("s"), F.lit(True).alias("odd")), add)["s"]
    return F.pmod(F.lit(10) - total % 10, F.lit(10))


def is_card(m: Column) -> Column:
    """13 to 19 digits, the first one that of a payment card, with the right check digit."""
    plain = F.regexp_replace(m, "[^0-9]", "")
    return plain.rlike("^[2-6][0-9]{12,18}$") & (luhn(digits(F.substr(plain, F.lit(1), F.length(plain) - 1))) == F.right(plain, F.lit(1)).cast("int"))


def card(m: Column, key: str) -> Column:
    """The first digit stays and the last one is the right check digit again."""
    plain = F.regexp_replace(m, "[^0-9]", "")
    first = F.left(plain, F.lit(1))
    body = permuted(F.substr(plain, F.lit(2), F.length(plain) - 2), key, F.concat(F.lit("card"), first), [DIGITS])
    return once(F.concat(first, body), lambda new: refilled(m, F.concat(new, luhn(digits(new)).cast("string"))))


def ip4(m: Column, key: str) -> Column:
    o = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))

    def turn(sign: int) -> Callable[[Column, Column], Column]:
        def once(acc: Column, r: Column) -> Column:
            f = lambda x: F.conv(F.substr(hashed(F.lit(key), F.lit("ip"), r.cast("string"), x.cast("string")), F.lit(1), F.lit(4)), 16, 10).cast("int") * sign
            low, high = F.pmod(acc["a"] + f(acc["b"]), F.lit(65536)), F.pmod(acc["b"] + f(acc["a"]), F.lit(65536))
            return F.when(r % 2 == 1, F.struct(low.alias("a"), acc["b"].alias("b"))).otherwise(F.struct(acc["a"].alias("a"), high.alias("b")))

        return once

    start = F.struct((o[0] * 256 + o[1]).alias("a"), (o[2] * 256 + o[3]).alias("b"))
    scrambled = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, turn(1))
    undone = F.transform(F.array(scrambled), lambda x: F.aggregate(F.sequence(F.lit(ROUNDS), F.lit(1)), F.struct(F.pmod(x["a"] + 1, F.lit(65536)).alias("a"), x["b"].alias("b")), turn(-1)))
    byte = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), F.pmod(x, F.lit(256)).cast("string"))
    return F.element_at(F.transform(undone, lambda x: F.concat_ws(".", byte(x["a"]), byte(x["b"]))), 1)


def ip(m: Column, key: str) -> Column:
    """Four numbers, or groups of hexadecimal digits that keep their lengths and the address its case."""
    six = permuted(F.lower(m), key, F.lit("ip6"), [HEX])
    return F.when(F.instr(m, ":") == 0, ip4(m, key)).when(m.rlike("[A-F]"), F.upper(six)).otherwise(six)


def with_case(shape: Column, new: Column) -> Column:
    """new with capitals where shape has them."""
    return F.concat_ws("", F.zip_with(chars(shape), chars(new), lambda a, b: F.when(a.rlike("[A-Z]"), F.upper(b)).otherwise(b)))


def email(m: Column, key: str) -> Column:
    """Local part and domain apart, so that a domain keeps its own surrogate, whatever its case; its end (and example.*) stays."""
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    tail = F.regexp_extract(domain, r"(?i)^[^.]+.*?((?:\.example)?\.[^.]+)$", 1)
    head = F.substr(domain, F.lit(1), F.length(domain) - F.length(tail))
    return F.concat(permuted(local, key, F.concat(F.lit("local"), F.lower(domain))), F.lit("@"), with_case(head, permuted(F.lower(head), key, F.lit("domain"))), tail)


#: The first digit of a number as a letter, so that it stays above 0.
FIRST, AS_LETTER = "123456789", "ABCDEFGHI"


def phone_parts(m: Column) -> Column:
    """(code, zeros, core): country code, if written; zeros before the number; the number, one for all its forms."""
    plain = F.regexp_replace(m, "[^0-9]", "")
    code = F.when(m.startswith("+"), F.regexp_extract(plain, COUNTRY, 0)).when(m.startswith("1-"), F.lit("1")).otherwise("")
    rest = F.substr(plain, F.length(code) + 1, F.length(plain))
    core = F.regexp_replace(rest, "^0+", "")
    return F.struct(code.alias("code"), F.substr(rest, F.lit(1), F.length(rest) - F.length(core)).alias("zeros"), core.alias("core"))


def phone(m: Column, key: str) -> Column:
    """Country code, zeros before the number and punctuation stay; the number is permuted, the same with and without a code."""

    def made(p: Column) -> Column:
        coded = F.concat(F.translate(F.left(p["core"], F.lit(1)), FIRST, AS_LETTER), F.substr(p["core"], F.lit(2), F.length(p["core"])))
        new = permuted(coded, key, F.lit("phone"), [DIGITS, AS_LETTER])
        return refilled(m, F.concat(p["code"], p["zeros"], F.translate(new, AS_LETTER, FIRST)))

    return once(phone_parts(m), made)


def iban_rest(s: Column) -> Column:
    """The number whose remainder by 97 is 1 for a right IBAN: country and check digits last, letters as 10 to 35."""
    turned = F.concat(F.substr(s, F.lit(5), F.length(s)), F.substr(s, F.lit(1), F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(chars(turned), F.lit(0), lambda acc, c: F.pmod(acc * F.when(value(c) > 9, 100).otherwise(10) + value(c), F.lit(97)))


def iban(m: Column, key: str) -> Column:
    plain = F.regexp_replace(m, " ", "")
    country = F.substr(plain, F.lit(1), F.lit(2))
    body = permuted(F.substr(plain, F.lit(5), F.length(plain)), key, F.concat(F.lit("iban"), country))

    def built(new: Column) -> Column:
        right = F.lpad((98 - iban_rest(F.concat(country, F.lit("00"), new))).cast("string"), 2, "0")
        check = F.when(iban_rest(plain) == 1, right).otherwise(F.substr(plain, F.lit(3), F.lit(2)))
        return refilled(m, F.concat(country, check, new), "[A-Z0-9]")

    return once(body, built)


#: More given names of one length than this there are not: so many steps lead from a listed name to an unlisted one at most.
WALK = max(Counter(len(n) for names in GIVEN.values() for n in names).values()) + 1


def name_word(w: Column, key: str) -> Column:
    """Given names become others of their list; other names keep shape and, in scripts with case, their last letter, and
    never become a listed one: a permutation of the unlisted names of a shape."""
    known, follows = [n for names in GIVEN.values() for n in names], {}
    for kind, names in GIVEN.items():  # one place on in the keyed order: a permutation of the list without fixed names
        order = sorted(names, key=lambda n: hashlib.sha256("\x1f".join((key, kind, n)).encode()).digest())
        follows |= dict(zip(order, order[1:] + order[:1], strict=True))
    last = lambda x: F.right(x, F.when((F.length(x) > 2) & (F.lower(F.right(x, F.lit(1))) != F.upper(F.right(x, F.lit(1)))), 1).otherwise(0))

    def made(x: Column) -> Column:
        return once(last(x), lambda z: F.concat(permuted(F.substr(x, F.lit(1), F.length(x) - F.length(z)), key, F.concat(F.lit("name"), z), [*ALPHABETS, *OTHER], True), z))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), w, lambda acc, r: F.when((r == 1) | F.array_contains(listed(known), acc), made(acc)).otherwise(acc))
    return once(F.array_position(listed(known), w), lambda at: F.when(at > 0, F.element_at(listed([follows[n] for n in known]), at.cast("int"))).otherwise(walk))


def name(m: Column, key: str) -> Column:
    cue = F.regexp_extract(m, f"^{CUE}", 0)
    return F.concat(cue, F.array_join(F.transform(F.split(F.substr(m, F.length(cue) + 1, F.length(m)), " "), lambda w: name_word(w, key)), " "))


MAKERS: dict[str, Callable[[Column, str], Column]] = {"email": email, "ip": ip, "ssn": lambda m, k: refilled(m, permuted(F.regexp_replace(m, "[^0-9]", ""), k, F.lit("ssn"), [DIGITS])), "phone": phone, "iban": iban, "card": card, "name": name}


def kind_of(m: Column) -> Column:
    """The kind whose pattern takes the whole match; words of names found earlier in the text are names too. Long numbers
    that are no cards are of no kind: null."""
    out = F.when(F.instr(m, "@") > 0, "email")
    for kind in ("ip", "ssn", "phone", "iban"):
        out = out.when(m.rlike(f"^(?:{KINDS[kind]})$"), kind)
    return out.when(m.rlike(f"^(?:{KINDS['card']})$"), F.when(is_card(m), "card")).otherwise("name")


def surrogate(m: Column, kind: Column, key: str) -> Column:
    out = None
    for k, maker in MAKERS.items():
        out = F.when(kind == k, maker(m, key)) if out is None else out.when(kind == k, maker(m, key))
    return out.otherwise(m)


def again_of(words: Column) -> Column:
    """The pattern of a text with named persons: later mentions of them without a title count as well."""
    quoted = F.transform(words, lambda w: F.concat(F.lit(r"\Q"), w, F.lit(r"\E")))
    return F.concat(F.lit(PATTERN + r"|(?<![\p{L}\d])(?:"), F.array_join(quoted, "|"), F.lit(r")(?![\p{L}\d])"))


FOUND = "array<struct<kind:string,entity:string,surrogate:string>>"


def analysed(docs: DataFrame, key: str) -> DataFrame:
    """The columns of docs but text, as the struct `row`, with `found` (array of kind, entity, surrogate in the order of the
    text) and `clean`, the text with surrogates; checked, and kept in the shared folder for whatever follows."""
    others = [c for c in docs.columns if c != "text"]
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in others)).alias("row"), F.col("text"))
    # all kinds but names hold a digit or an at sign, so most texts need two cheap tests only
    maybe = F.col("text").rlike("[0-9@]") | F.col("text").rlike(KINDS["name"])
    first = rows.withColumn("hits", F.when(maybe, F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>")))
    named = f"^(?:{KINDS['name']}|.*[{''.join(SUFFIXES)}])"
    names = F.filter("hits", lambda m: m.rlike(named) | m.rlike(r"^[\p{IsHan}\p{IsHangul}]{2,4}$"))
    words = F.array_distinct(F.filter(F.flatten(F.transform(names, lambda m: F.split(F.regexp_replace(m, f"^{CUE}", ""), " "))), lambda w: (F.length(w) > 1) & ~w.rlike(r"\\E")))
    some = first.withColumn("words", F.when(F.size("hits") > 0, words).otherwise(F.array().cast("array<string>")))
    some = some.withColumn("pattern", F.when(F.size("words") > 0, again_of(F.col("words"))).otherwise(F.lit(PATTERN)))
    hits = F.when(F.size("words") > 0, F.regexp_extract_all("text", F.col("pattern"), F.lit(0))).otherwise(F.col("hits"))
    some = some.withColumn("hits", hits)
    typed = F.transform("hits", lambda m: F.struct(kind_of(m).alias("kind"), m.alias("entity")))
    some = some.withColumn("typed", typed)
    made = F.transform("typed", lambda t: F.struct(t["kind"].alias("kind"), t["entity"].alias("entity"), surrogate(t["entity"], t["kind"], key).alias("surrogate")))
    some = some.withColumn("made", F.when(F.size("hits") > 0, made))
    pieces = F.zip_with(F.split("text", F.col("pattern"), -1), "made", lambda a, f: F.concat(a, F.coalesce(f["surrogate"], F.lit(""))))
    found = F.coalesce(F.filter("made", lambda f: f["kind"].isNotNull()), F.expr(f"cast(array() as {FOUND})"))
    out = staged(some.select("row", found.alias("found"), F.when(F.size("hits") > 0, F.array_join(pieces, "")).otherwise(F.col("text")).alias("clean")), "surrogates")
    bad = conflicts(out.select(F.explode("found").alias("f")).select("f.*")).limit(3).collect()
    if bad:
        raise Collision(str([r.asDict() for r in bad]))
    return out


def plain_form(kind: Column, x: Column) -> Column:
    """What two ways to write one entity have in common."""
    p = phone_parts(x)
    domain = F.substring_index(x, "@", -1)
    return (
        F.when(kind == "phone", F.concat_ws("/", p["code"], p["core"])).when(kind.isin("card", "ssn", "iban"), F.regexp_replace(x, "[ -]", ""))
        .when(kind == "email", F.concat(F.substring_index(x, "@", 1), F.lit("@"), F.lower(domain))).when((kind == "ip") & (F.instr(x, ":") == 0), F.regexp_replace(x, r"\b0+(?=\d)", "")).when(kind == "ip", F.lower(x)).otherwise(x)
    )


def conflicts(found: DataFrame) -> DataFrame:
    """reason, kind, value of found (kind, entity, surrogate): surrogates that two entities share, entities with two, and kept ones."""
    pairs = found.select("kind", plain_form(F.col("kind"), F.col("entity")).alias("entity"), plain_form(F.col("kind"), F.col("surrogate")).alias("surrogate"))

    def several(by: str, of: str, reason: str) -> DataFrame:
        return pairs.groupBy("kind", by).agg(F.min(of).alias("a"), F.max(of).alias("b")).where("a != b").select(F.lit(reason).alias("reason"), "kind", F.col(by).alias("value"))

    kept = pairs.where("entity = surrogate").select(F.lit("kept").alias("reason"), "kind", F.col("entity").alias("value"))
    return several("surrogate", "entity", "shared").unionByName(several("entity", "surrogate", "changing")).unionByName(kept)


def with_surrogates(docs: DataFrame, key: str = "corpus") -> DataFrame:
    """docs with personal data in text replaced, and n_chars, where there is such a column, brought up to date.

    All other columns stay as they are, whatever their names; null and empty texts stay; very long texts are searched
    whole; equal texts, repeated rows among them, change alike; no rows give no rows.
    """
    out = analysed(docs, key)
    new = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*(new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns))


def surrogate_report(docs: DataFrame, key: str = "corpus") -> DataFrame:
    """doc_id, text (with surrogates), n_<kind> for each kind, for every document.

    Null texts stay null with counts of 0, empty ones empty; very long texts are searched whole. Where two kinds match at
    one place the first of KINDS counts. Repeated rows get a row each; extra columns are ignored; no rows give no rows.
    """
    out = analysed(docs.select("doc_id", "text"), key)

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in KINDS]
    return out.select("row.doc_id", F.col("clean").alias("text"), *counts)


def entities(docs: DataFrame, key: str = "corpus") -> DataFrame:
    """kind, entity, surrogate of all distinct entities of the corpus."""
    one = analysed(docs.select("doc_id", "text"), key).select(F.explode("found").alias("f")).select("f.*")
    return one.distinct()
