"""Graphical Fragment Assembly text: reading into tables, writing from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import render
from ..functions.staging import numbered, staged
from ..model import PangenomeGraph
from ..operators.extract import joined_steps
from ..operators.grammar import compacted

ORDER = ["_f", "_b", "_m"]  #: file, block and row: the order of lines in the files
GAP = "[ \t]+"
TAG = r"^(..):(.):(.*)$"
#: Tag types that have a meaning; others are refused.
TAG_TYPES = "AifZJHB"


class BadGfa(ValueError):
    """Text that is no graph."""


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their order; carriage returns are dropped. Files are read in parallel splits."""
    raw = spark.read.text(path)
    at = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"), F.monotonically_increasing_id().alias("_m")]
    return raw.select(*at, F.regexp_replace("value", "\r+$", "").alias("value"))


def fields(value: Column) -> Column:
    """Runs of blanks and tabs separate fields."""
    return F.split(F.regexp_replace(value, "^[ \t]+|[ \t]+$", ""), GAP)


def field(f: Column, i: int, default: str = "") -> Column:
    return F.coalesce(F.get(f, F.lit(i)), F.lit(default))


def rest_of(f: Column, i: int) -> Column:
    """All fields from the i-th on, joined by tabs."""
    return F.array_join(F.slice(f, F.lit(i + 1), F.greatest(F.size(f) - i, F.lit(0))), "\t")


def leading_int(s: Column) -> Column:
    return F.regexp_extract(s, r"^(-?[0-9]+)", 1).try_cast("bigint")


def parsed_tags(f: Column, first: int) -> Column:
    """Optional fields TG:T:value from the given place on as a map; others are ignored, of repeated tags the last counts."""
    named = F.filter(F.slice(f, F.lit(first + 1), F.greatest(F.size(f) - first, F.lit(0))), lambda t: t.rlike(TAG))
    entries = F.transform(named, lambda t: F.struct(F.regexp_extract(t, TAG, 1).alias("k"), F.struct(F.regexp_extract(t, TAG, 2).alias("type"), F.regexp_extract(t, TAG, 3).alias("value")).alias("v")))
    kept = F.filter(entries, lambda e: e["v"]["value"] != "")
    last = F.filter(F.transform(kept, lambda e, i: F.struct(e["k"].alias("k"), e["v"].alias("v"), i.alias("i"))), lambda e: ~F.exists(F.slice(kept, e["i"] + 2, F.size(kept)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["k"], e["v"])))


def overlap_parts(o: Column) -> tuple[Column, Column]:
    """Number and operation of the first part of a CIGAR; * and nothing are 0 and null."""
    none = o.isin("*", "")
    num = F.when(none, 0).otherwise(F.coalesce(F.regexp_extract(o, "^([0-9]*)", 1).try_cast("bigint"), F.lit(0)))
    op = F.regexp_extract(o, "^[0-9]*(.?)", 1)
    return num, F.when(none | (op == ""), F.lit(None).cast("string")).otherwise(op)


def parsed_segments(lines: DataFrame, use_ln_tag: bool = False) -> DataFrame:
    """Segments with ids from 1 in the order in which their names first occur; of repeated names the first counts.

    A segment without sequence (*) is one base long, or with use_ln_tag as long as its tag LN:i says.
    """
    f = fields(F.col("value"))
    s = lines.where("value like 'S%'").select(F.struct(*ORDER).alias("_at"), field(f, 1).alias("name"), field(f, 2).alias("sequence"), parsed_tags(f, 3).alias("tags"))
    first = s.groupBy("name").agg(F.min(F.struct("_at", "sequence", F.map_entries("tags").alias("t"))).alias("r"))
    rows = first.select(F.col("r._at._f").alias("_f"), F.col("r._at._b").alias("_b"), F.col("r._at._m").alias("_m"), "name", F.col("r.sequence").alias("sequence"), F.map_from_entries("r.t").alias("tags"))
    size = F.length("sequence").cast("bigint")
    if use_ln_tag:
        told = F.try_element_at("tags", F.lit("LN"))
        size = F.when((F.col("sequence") == "*") & (told["type"] == "i"), F.coalesce(leading_int(told["value"]), size)).otherwise(size)
    return numbered(rows, ORDER, "node_id", 1).select("node_id", "name", "sequence", size.alias("seq_len"), "tags")


def tag_conflicts(table: DataFrame) -> DataFrame:
    """tag, types of tags that occur with more than one type or with one that is unknown."""
    seen = table.select(F.explode(F.map_entries("tags")).alias("e")).select(F.col("e.key").alias("tag"), F.col("e.value.type").alias("type"))
    return seen.groupBy("tag").agg(F.sort_array(F.collect_set("type")).alias("types")).where((F.size("types") > 1) | ~F.get("types", F.lit(0)).isin(*TAG_TYPES))


def bad_floats(table: DataFrame) -> DataFrame:
    """tag, value of floating tags that begin with no number or with one that single precision can't hold."""
    seen = table.select(F.explode(F.map_entries("tags")).alias("e")).where("e.value.type = 'f'").select(F.col("e.key").alias("tag"), F.col("e.value.value").alias("value"))
    number = render.leading_float(F.col("value"))
    size = F.abs(number)
    # fixed values: the largest number that rounds to a finite one, and the least that has full precision
    beyond = (size < float("inf")) & ((size >= 3.4028235677973366e38) | ((size > 0) & (size < 1.1754943508222875e-38)))
    return seen.where(number.isNull() | beyond)


def resolve(df: DataFrame, ids: DataFrame, name: str, out: str) -> DataFrame:
    """df with the node id of the column name; rows without one go."""
    return df.join(ids.select(F.col("name").alias(name), F.col("node_id").alias(out)), name)


def signed(node: Column, reverse: Column) -> Column:
    return F.when(reverse, -node).otherwise(node)


#: A record's own columns, by kind.
RECORD = {"P": ["name", "overlaps"], "W": ["sample_id", "hap_index", "seq_id", "seq_start", "seq_end"]}


def parsed_records(lines: DataFrame, kind: str) -> DataFrame:
    """Order columns, the record's own columns, and tokens (array of its steps' texts) of each path or walk line."""
    f = fields(F.col("value"))
    if kind == "P":
        tail = F.regexp_extract("value", r"^[ \t]*\S+[ \t]+\S+[ \t]+\S+[ \t]*(.*)$", 1)
        return lines.where("value like 'P%'").select(*ORDER, field(f, 1).alias("name"), tail.alias("overlaps"), F.split(field(f, 2), ",").alias("tokens"))
    star = lambda c: F.when(c.isin("*", ""), F.lit(None).cast("bigint")).otherwise(leading_int(c))
    meta = [field(f, 1).alias("sample_id"), F.coalesce(leading_int(field(f, 2)), F.lit(0)).alias("hap_index"), field(f, 3).alias("seq_id"), star(field(f, 4)).alias("seq_start"), star(field(f, 5)).alias("seq_end")]
    return lines.where("value like 'W%'").select(*ORDER, *meta, F.regexp_extract_all(field(f, 6), F.lit("[><][^><]+"), F.lit(0)).alias("tokens"))


def exploded(records: DataFrame, kind: str, keep: list[str]) -> DataFrame:
    """Columns keep, pos, step (a name) and reverse of each step of parsed_records()."""
    rows = records.select(*keep, F.posexplode("tokens").alias("pos", "tok"))
    if kind == "P":
        return rows.select(*keep, "pos", F.expr("substr(tok, 1, length(tok) - 1)").alias("step"), (F.right("tok", F.lit(1)) == "-").alias("reverse"))
    return rows.select(*keep, "pos", F.expr("substr(tok, 2)").alias("step"), (F.left("tok", F.lit(1)) == "<").alias("reverse"))


def parsed_steps(lines: DataFrame, kind: str) -> DataFrame:
    """Order columns, the record's key columns (all but overlaps), pos, name and reverse of each step."""
    return exploded(parsed_records(lines, kind), kind, [*ORDER, *(c for c in RECORD[kind] if c != "overlaps")])


def parsed_links(lines: DataFrame, ids: DataFrame) -> DataFrame:
    f = fields(F.col("value"))
    num, op = overlap_parts(F.col("overlap"))
    o = lambda c: F.when(c == "", "+").otherwise(c)
    rows = lines.where("value like 'L%'").select(*ORDER, field(f, 1).alias("a"), o(field(f, 2)).alias("from_orient"), field(f, 3).alias("b"), o(field(f, 4)).alias("to_orient"), field(f, 5).alias("overlap"), parsed_tags(f, 6).alias("tags"))
    known = resolve(resolve(rows, ids, "a", "from_id"), ids, "b", "to_id")
    return numbered(known.select("*", num.alias("overlap_num"), op.alias("overlap_op")), ORDER, "link_idx").select("link_idx", "from_id", "from_orient", "to_id", "to_orient", "overlap_num", "overlap_op", "overlap", "tags")


def parsed_jumps(lines: DataFrame, ids: DataFrame) -> DataFrame:
    f = fields(F.col("value"))
    rows = lines.where("value like 'J%'").select(*ORDER, field(f, 1).alias("a"), field(f, 2, "+").alias("from_orient"), field(f, 3).alias("b"), field(f, 4, "+").alias("to_orient"), field(f, 5, "*").alias("distance"), rest_of(f, 6).alias("rest"))
    known = resolve(resolve(rows, ids, "a", "from_id"), ids, "b", "to_id")
    return numbered(known, ORDER, "jump_idx").select("jump_idx", "from_id", "from_orient", "to_id", "to_orient", "distance", "rest")


def parsed_containments(lines: DataFrame, ids: DataFrame) -> DataFrame:
    f = fields(F.col("value"))
    rows = lines.where("value like 'C%'").select(*ORDER, field(f, 1).alias("a"), field(f, 2, "+").alias("container_orient"), field(f, 3).alias("b"), field(f, 4, "+").alias("contained_orient"), F.coalesce(leading_int(field(f, 5)), F.lit(0)).alias("pos"), field(f, 6, "*").alias("overlap"), rest_of(f, 7).alias("rest"))
    known = resolve(resolve(rows, ids, "a", "container_id"), ids, "b", "contained_id")
    return numbered(known, ORDER, "containment_idx").select("containment_idx", "container_id", "container_orient", "contained_id", "contained_orient", "pos", "overlap", "rest")


def parsed_header(lines: DataFrame) -> DataFrame:
    """The last header line, whole; no row if there is none."""
    return lines.where("value like 'H%'").agg(F.max_by("value", F.struct(*ORDER)).alias("line")).where("line is not null")


def graph_of(lines: DataFrame, strict: bool = True, use_ln_tag: bool = False) -> PangenomeGraph:
    """The graph in lines (_f, _b, _m, value). Steps, links and the like that name no segment are dropped.

    With strict, tags of several types or of unknown ones, and floating tags without a number or beyond single precision,
    raise BadGfa. Lines of other kinds are ignored.
    """
    lines = staged(lines, "lines")
    segments = staged(parsed_segments(lines, use_ln_tag), "segments")
    ids = segments.select("name", "node_id")
    links = staged(parsed_links(lines, ids), "links")
    if strict:
        for table in (segments, links):
            bad = tag_conflicts(table).limit(1).collect()
            if bad:
                raise BadGfa(f"tag {bad[0]['tag']} has types {bad[0]['types']}")
            odd = bad_floats(table).limit(1).collect()
            if odd:
                raise BadGfa(f"tag {odd[0]['tag']} has no number of single precision: {odd[0]['value']}")
    tables, steps = {}, []
    for kind, columns in RECORD.items():
        # the records are numbered without their steps, and steps carry the number alone
        records = parsed_records(lines, kind)
        tables[kind] = numbered(records.select(*ORDER, *columns), ORDER, "trav")
        at = exploded(records.join(tables[kind].select(*ORDER, "trav"), ORDER), kind, ["trav"])
        own = resolve(at, ids, "step", "node_id").select(F.lit(kind).alias("kind"), "trav", F.col("pos").cast("bigint").alias("pos"), signed(F.col("node_id"), F.col("reverse")).alias("snode"))
        # positions have no gaps: where steps are dropped the others move up
        steps.append(compacted(own, ["kind", "trav"]) if at.join(ids, F.col("step") == F.col("name"), "left_anti").limit(1).count() else own)
        tables[kind] = tables[kind].select("trav", *columns)
    return PangenomeGraph(segments, steps[0].unionByName(steps[1]), tables["P"], tables["W"], links, parsed_jumps(lines, ids), parsed_containments(lines, ids), parsed_header(lines))


def read_gfa(spark: SparkSession, path: str, strict: bool = True, use_ln_tag: bool = False) -> PangenomeGraph:
    """A graph from one or more text files."""
    return graph_of(lines_of(spark, path), strict, use_ln_tag)


SECTIONS = {"stored": "HSLPWJC", "streamed": "HSLJCPW"}


def gfa_lines(g: PangenomeGraph, layout: str = "stored", names: bool = True) -> DataFrame:
    """section, idx, line of all records. names: stored segment names, in all records; else their numbers."""
    place = {c: i for i, c in enumerate(SECTIONS[layout])}
    out = []

    def add(kind: str, df: DataFrame | None, idx: Column, line: Column) -> None:
        if df is not None:
            out.append(df.select(F.lit(place[kind]).alias("section"), idx.cast("bigint").alias("idx"), line.alias("line")))

    number = lambda c: F.col(c).cast("string")
    label = F.coalesce("name", number("node_id")) if names else number("node_id")
    known = g.segments.select("node_id", label.alias("name")) if names else None

    def ends(df: DataFrame | None, *ids: str) -> DataFrame | None:
        """df with the ids' texts as _0, _1."""
        for i, c in enumerate(ids if df is not None else ()):
            if names:
                df = df.join(known.select(F.col("node_id").alias(f"_id{i}"), F.col("name").alias(f"_n{i}")), F.col(c) == F.col(f"_id{i}"), "left")
            df = df.withColumn(f"_{i}", F.coalesce(f"_n{i}", number(c)) if names else number(c))
        return df

    add("H", g.header, F.lit(0), F.col("line"))
    add("S", g.segments, F.col("node_id"), F.concat(F.concat_ws("\t", F.lit("S"), label, "sequence"), render.tags_text(F.col("tags"))))
    add("L", ends(g.links, "from_id", "to_id"), F.col("link_idx"), F.concat(F.concat_ws("\t", F.lit("L"), "_0", "from_orient", "_1", "to_orient", render.overlap_text(F.col("overlap_num"), F.col("overlap_op"))), render.tags_text(F.col("tags"))))
    if g.paths is not None:
        p = g.paths.join(joined_steps(g.steps.where("kind = 'P'"), "P", names=known), "trav", "left")
        add("P", p, F.col("trav"), render.path_line(F.col("name"), F.coalesce("text", F.lit("")), F.col("overlaps")))
    if g.walks is not None:
        w = g.walks.join(joined_steps(g.steps.where("kind = 'W'"), "W", names=known), "trav", "left")
        add("W", w, F.col("trav"), render.walk_line(F.col("sample_id"), F.col("hap_index"), F.col("seq_id"), F.col("seq_start"), F.col("seq_end"), F.coalesce("text", F.lit(""))))
    tail = lambda: F.when(F.col("rest") == "", "").otherwise(F.concat(F.lit("\t"), F.col("rest")))
    add("J", ends(g.jumps, "from_id", "to_id"), F.col("jump_idx"), F.concat(F.concat_ws("\t", F.lit("J"), "_0", "from_orient", "_1", "to_orient", "distance"), tail()))
    add("C", ends(g.containments, "container_id", "contained_id"), F.col("containment_idx"), F.concat(F.concat_ws("\t", F.lit("C"), "_0", "container_orient", "_1", "contained_orient", number("pos"), "overlap"), tail()))
    all_ = out[0]
    for o in out[1:]:
        all_ = all_.unionByName(o)
    return all_


def write_gfa(g: PangenomeGraph, path: str, layout: str = "stored") -> None:
    """The graph as text files whose concatenation in name order is the file; lines are sorted by ranges.

    The stored layout has the segments' names, the streamed one their numbers.
    """
    gfa_lines(g, layout, names=layout == "stored").sort("section", "idx").select("line").write.text(path)
