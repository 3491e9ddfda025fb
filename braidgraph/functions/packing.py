"""2-mers as 64-bit keys, and the sizes that byte codes would take."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW = (1 << 32) - 1


def pack(a: Column, b: Column) -> Column:
    """Two signed 32-bit symbols as one key: the first in the high half."""
    return F.shiftleft(a.cast("long"), 32).bitwiseOR(b.cast("long").bitwiseAND(F.lit(LOW)))


def unpack_first(key: Column) -> Column:
    return F.shiftright(key, 32)


def unpack_second(key: Column) -> Column:
    low = key.bitwiseAND(F.lit(LOW))
    return F.when(low > (1 << 31) - 1, low - (1 << 32)).otherwise(low)


def canonical(a: Column, b: Column) -> Column:
    """The smaller key of a pair and its reverse (-b, -a)."""
    return F.least(pack(a, b), pack(-b, -a))


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2, ... as 0, 1, 2, 3, ..."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def varint_bytes(u: Column) -> Column:
    """Bytes of a value in groups of seven bits; the value is taken as unsigned."""
    return sum((F.when((u < 0) | (u >= (1 << bits)), 1).otherwise(0) for bits in range(7, 63, 7)), F.lit(1)) + F.when(u < 0, 1).otherwise(0)


def size_text(n: Column) -> Column:
    """Bytes with a unit: B as they are, else two decimals, rounded as C rounds the double n / 2^p: by the number itself, not
    by its shortest decimal; exact halves go to the even digit."""
    whole = n.cast("double").cast("bigint")  # beyond 2^53 the nearest double, as C divides it

    def unit(p: int, u: str) -> Column:
        part = whole.bitwiseAND(F.lit((1 << p) - 1)) * 100
        digits, rest, half = F.shiftright(part, p), part.bitwiseAND(F.lit((1 << p) - 1)), 1 << (p - 1)
        near = digits + F.when((rest > half) | ((rest == half) & (digits % 2 == 1)), 1).otherwise(0)
        units = F.shiftright(whole, p) + F.when(near == 100, 1).otherwise(0)
        return F.concat(units.cast("string"), F.lit("."), F.lpad((near % 100).cast("string"), 2, "0"), F.lit(f" {u}"))

    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(10, "KB")).when(n < 1 << 30, unit(20, "MB")).otherwise(unit(30, "GB"))
