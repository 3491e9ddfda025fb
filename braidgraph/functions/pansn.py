"""PanSN names (sample#haplotype#sequence) and the group keys of both analyses, which differ on purpose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import Grouping

COORDINATES = r"^(.+):([0-9]+)-([0-9]+)$"


def stripped(name: Column) -> Column:
    """name without a final :start-end."""
    return F.regexp_replace(name, COORDINATES, "$1")


def growth_parts(name: Column) -> Column:
    """sample, hap, seq (null: absent) as growth reads them: an empty haplotype hides the sequence as well."""
    rest = F.regexp_extract(name, r"^[^#]*#(.*)$", 1)
    one = F.instr(name, "#") == 0
    two = ~rest.contains("#")
    hap = F.regexp_extract(rest, r"^([^#]*)", 1)
    seq = F.regexp_extract(rest, r"^[^#]*#(.*)$", 1)
    no_seq = two | (seq == "") | seq.startswith("#")
    return F.struct(
        F.when(one, stripped(name)).otherwise(F.substring_index(name, "#", 1)).alias("sample"),
        F.when(~one & (hap != ""), F.when(no_seq, stripped(hap)).otherwise(hap)).alias("hap"),
        F.when(~one & (hap != "") & ~no_seq, stripped(seq)).alias("seq"),
    )


def pav_parts(name: Column) -> Column:
    """sample, hap, seq (null: absent) as presence/absence reads them: whatever stands between the marks."""
    one = F.instr(name, "#") == 0
    rest = F.regexp_extract(name, r"^[^#]*#(.*)$", 1)
    two = ~rest.contains("#")
    hap = F.when(two, stripped(rest)).otherwise(F.regexp_extract(rest, r"^([^#]*)", 1))
    seq = F.when(~two, stripped(F.regexp_extract(rest, r"^[^#]*#(.*)$", 1)))
    return F.struct(
        F.when(one, stripped(name)).otherwise(F.substring_index(name, "#", 1)).alias("sample"),
        F.when(~one & (F.when(two, rest).otherwise(hap) != ""), hap).alias("hap"),
        F.when(~one & (seq != ""), seq).alias("seq"),
    )


def growth_path_key(name: Column, mode: Grouping) -> Column:
    p = growth_parts(name)
    if mode is Grouping.PATH:
        return name
    if mode is Grouping.SAMPLE:
        return p["sample"]
    if mode is Grouping.SAMPLE_HAP:
        return F.concat(p["sample"], F.lit("#"), F.coalesce(p["hap"], F.lit("")))
    return F.concat_ws("#", p["sample"], p["hap"], p["seq"])


def pav_path_key(name: Column, mode: Grouping) -> Column:
    p = pav_parts(name)
    if mode is Grouping.PATH:
        return name
    if mode is Grouping.SAMPLE:
        return p["sample"]
    if mode is Grouping.SAMPLE_HAP:
        return F.concat_ws("#", p["sample"], p["hap"])
    return F.when(p["hap"].isNotNull(), F.concat_ws("#", p["sample"], p["hap"], p["seq"])).otherwise(p["sample"])


def walk_key(sample: Column, hap: Column, seq: Column, mode: Grouping) -> Column:
    """Of a walk in both analyses; growth by path keeps walks apart by their line instead."""
    parts = {Grouping.SAMPLE: [sample], Grouping.SAMPLE_HAP: [sample, hap.cast("string")]}.get(mode, [sample, hap.cast("string"), seq])
    return F.concat_ws("#", *parts)


def walk_name(sample: Column, hap: Column, seq: Column, start: Column, end: Column) -> Column:
    """sample#hap#seq, and :start-end where either is known (an unknown one is -1)."""
    whole = F.concat_ws("#", sample, hap.cast("string"), seq)
    one = lambda c: F.coalesce(c, F.lit(-1)).cast("string")
    return F.when(start.isNull() & end.isNull(), whole).otherwise(F.concat(whole, F.lit(":"), one(start), F.lit("-"), one(end)))
