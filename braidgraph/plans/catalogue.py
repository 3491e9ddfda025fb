"""The query catalogue: name -> query, name -> DuckDB SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import packing, pansn, render
from ..functions.staging import staged, work_dir
from ..model import Grouping, PangenomeGraph
from ..operators import append, extract, grammar, growth, pav, stats, traversal
from ..sources import appendix, bed, gfa, storage
from . import oracle
from .project import Star

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL = oracle.SQL
NATIONS = [f"N{i}" for i in range(25)]
MODES = [Grouping.SAMPLE, Grouping.SAMPLE_HAP, Grouping.SAMPLE_HAP_SEQ]


def query(f: Callable[[Star], DataFrame]) -> Callable[[Star], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Star(spark, sf_dir))
    return f


def rounded(df: DataFrame, column: str, digits: int) -> DataFrame:
    return df.withColumn(column, F.round(column, digits))


# coverage and growth


def samples(s: Star, mode: Grouping = Grouping.SAMPLE) -> tuple[DataFrame, DataFrame]:
    g = s.path_graph()
    groups = growth.slice_groups(g, mode)
    return groups, growth.group_nodes(g, groups)


@query
def node_coverage(s: Star) -> DataFrame:
    return growth.node_coverage(s.segments(), samples(s)[1])


@query
def coverage_hist(s: Star) -> DataFrame:
    groups, members = samples(s)
    return growth.coverage_histogram(growth.node_coverage(s.segments(), members), groups)


@query
def growth_sample(s: Star) -> DataFrame:
    return rounded(growth.growth(s.path_graph(), Grouping.SAMPLE), "growth", 4)


@query
def growth_sample_hap(s: Star) -> DataFrame:
    return rounded(growth.growth(s.path_graph(), Grouping.SAMPLE_HAP), "growth", 4)


@query
def growth_sample_hap_seq(s: Star) -> DataFrame:
    return rounded(growth.growth(s.walk_graph(), Grouping.SAMPLE_HAP_SEQ), "growth", 4)


@query
def growth_path(s: Star) -> DataFrame:
    return rounded(growth.growth(s.walk_graph(), Grouping.PATH), "growth", 4)


@query
def growth_lines(s: Star) -> DataFrame:
    return growth.growth_lines(growth.growth(s.path_graph(), Grouping.SAMPLE))


@query
def growth_summary(s: Star) -> DataFrame:
    nodes = s.segments().agg(F.count("*").alias("num_nodes"))
    parts = [growth.slice_groups(s.path_graph(), m).agg(F.count_distinct("grp").alias("num_haplotypes")).select(F.lit(m.value).alias("mode"), "num_haplotypes") for m in MODES]
    return parts[0].union(parts[1]).union(parts[2]).join(F.broadcast(nodes), F.lit(True))


@query
def haplotype_groups(s: Star) -> DataFrame:
    name = F.col("name")
    return s.paths().select("trav", *(growth.pansn.growth_path_key(name, m).alias(m.value.replace("-", "_")) for m in MODES))


@query
def slice_nodes(s: Star) -> DataFrame:
    return s.path_steps().select("trav", F.abs("snode").alias("node_id")).distinct()


@query
def group_nodes(s: Star) -> DataFrame:
    return samples(s)[1]


@query
def node_groups(s: Star) -> DataFrame:
    return growth.node_groups(samples(s)[1]).select("node_id", F.array_join("grps", ",").alias("grps"))


@query
def all_slices(s: Star) -> DataFrame:
    both = s.path_steps().unionByName(s.walk_steps().withColumn("trav", F.col("trav")))
    count = both.groupBy("kind", "trav").agg(F.count("*").alias("n_steps"))
    named = s.paths().select(F.lit("P").alias("kind"), "trav", "name").unionByName(s.walks().select(F.lit("W").alias("kind"), "trav", F.concat_ws("#", "sample_id", F.col("hap_index").cast("string"), "seq_id").alias("name")))
    return count.join(named, ["kind", "trav"]).select("kind", "name", "n_steps")


def odd_names(s: Star) -> DataFrame:
    """trav, name: one of eight forms of names for each order."""
    n = F.concat(F.lit("N"), (F.col("o_custkey") % 25).cast("string"))
    k = F.col("o_orderkey").cast("string")
    forms = [n, F.concat(n, F.lit("#1")), F.concat(n, F.lit("#1#ord"), k, F.lit(":0-100")), F.concat(n, F.lit("#")), F.concat(n, F.lit("##q"), k), F.concat(n, F.lit("#1#")), F.concat(n, F.lit(":3-9")), F.concat(n, F.lit("#2:4-8"))]
    name = forms[0]
    for i, form in enumerate(forms[1:], 1):
        name = F.when(F.col("o_orderkey") % 8 == i, form).otherwise(name)
    return s.table("orders").select(F.col("o_orderkey").alias("trav"), name.alias("name"))


def parsed(s: Star, parts: Callable[[Column], Column], key: Callable[[Column, Grouping], Column]) -> DataFrame:
    p = odd_names(s).withColumn("p", parts(F.col("name")))
    return p.select("trav", "name", "p.sample", "p.hap", "p.seq", *(key(F.col("name"), m).alias(m.value.replace("-", "_")) for m in MODES[1:]))


@query
def pansn_parse(s: Star) -> DataFrame:
    return parsed(s, pansn.growth_parts, pansn.growth_path_key)


@query
def pansn_parse_pav(s: Star) -> DataFrame:
    return parsed(s, pansn.pav_parts, pansn.pav_path_key)


# presence and absence


@query
def node_offsets(s: Star) -> DataFrame:
    return pav.node_offsets(s.path_steps(), s.segments()).drop("kind")


@query
def bed_tiles(s: Star) -> DataFrame:
    return s.bed()


@query
def bed_resolve(s: Star) -> DataFrame:
    return pav.resolved(s.bed(), pav.reference_names(s.path_graph())).select("wid", "chrom", "trav")


@query
def interval_overlap(s: Star) -> DataFrame:
    at = staged(pav.resolved(s.bed(), pav.reference_names(s.path_graph())), "windows")
    steps = s.path_steps().join(at.select("trav").distinct(), "trav", "left_semi")
    return pav.overlaps(at, pav.node_offsets(steps, s.segments()))


def shares(s: Star, mode: Grouping) -> DataFrame:
    return pav.pav(s.node_graph(), s.tiles(), mode, strict=False, keep=["wid"])  # the tiles are made from the paths themselves


@query
def pav_long(s: Star) -> DataFrame:
    return rounded(shares(s, Grouping.SAMPLE).select("wid", "grp", "num", "den", "pav"), "pav", 6)


@query
def pav_haplotype(s: Star) -> DataFrame:
    return rounded(shares(s, Grouping.SAMPLE_HAP).select("wid", "grp", "num", "den", "pav"), "pav", 6)


@query
def pav_binary(s: Star) -> DataFrame:
    return pav.binary(shares(s, Grouping.SAMPLE), 0.5).select("wid", "grp", "pav")


@query
def pav_matrix(s: Star) -> DataFrame:
    return pav.matrix(s.node_graph(), s.tiles(), Grouping.SAMPLE, NATIONS, strict=False, digits=6)


@query
def pav_groups(s: Star) -> DataFrame:
    return s.paths().select("trav", *(pansn.pav_path_key(F.col("name"), m).alias(m.value.replace("-", "_")) for m in MODES))


@query
def walk_names(s: Star) -> DataFrame:
    cols = [F.col(c) for c in extract.WALK_KEY]
    return s.walks().select("sample_id", "seq_id", pansn.walk_name(*cols).alias("name"))


# extraction


@query
def extract_path(s: Star) -> DataFrame:
    one = s.paths().agg(F.min("name").alias("name")).select(F.lit(0).cast("bigint").alias("req_idx"), "name")
    return extract.path_lines(one, s.paths(), s.path_steps())


@query
def extract_path_batch(s: Star) -> DataFrame:
    """All paths, the last one first."""
    asked = s.paths().select((F.lit(0) - F.col("trav")).alias("req_idx"), "name")
    return extract.path_lines(asked, s.paths(), s.path_steps())


def walk_requests(s: Star, where: str) -> DataFrame:
    return s.walks().where(where).select(F.col("trav").alias("req_idx"), *extract.WALK_KEY)


@query
def extract_walk(s: Star) -> DataFrame:
    asked = walk_requests(s, "true")
    return extract.walk_lines(asked, s.walks(), s.walk_steps()).select("line")


@query
def extract_walk_by_name(s: Star) -> DataFrame:
    """Walks of one sequence: there each sample has one."""
    asked = walk_requests(s, "seq_id = 'click'")
    return extract.walk_lines(asked, s.walks(), s.walk_steps()).select("line")


@query
def duplicate_names(s: Star) -> DataFrame:
    return extract.duplicated(s.segments(), "name")


@query
def sample_names(s: Star) -> DataFrame:
    return s.paths().select("name", F.md5(F.concat(F.lit("7:"), "name").cast("binary")).alias("h")).orderBy("h").limit(20)


# traversal transforms


def without_kind(df: DataFrame) -> DataFrame:
    return df.select("trav", "pos", "snode")


@query
def delta_encode(s: Star) -> DataFrame:
    return traversal.delta(without_kind(s.path_steps()), ["trav"])


@query
def delta_encode_2(s: Star) -> DataFrame:
    return traversal.delta(without_kind(s.path_steps()), ["trav"], 2)


@query
def delta_roundtrip(s: Star) -> DataFrame:
    return traversal.undelta(traversal.delta(without_kind(s.path_steps()), ["trav"], 2), ["trav"], 2).select("trav", "pos", "snode")


@query
def max_abs_symbol(s: Star) -> DataFrame:
    return traversal.max_symbol(traversal.delta(without_kind(s.path_steps()), ["trav"]))


def keyed(s: Star) -> DataFrame:
    """Walk steps with readable keys."""
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return s.events().select("user_id", "event_type", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.col("node_id").alias("snode"))


WALK = ["user_id", "event_type"]


@query
def two_mers(s: Star) -> DataFrame:
    return traversal.two_mers(keyed(s), WALK)


@query
def repeated_2mers(s: Star) -> DataFrame:
    return traversal.repeated(traversal.two_mers(keyed(s), WALK))


@query
def flatten_lengths(s: Star) -> DataFrame:
    lengths = s.path_steps().groupBy("trav").agg(F.count("*").alias("len"))
    return traversal.offsets(lengths, ["trav"])


@query
def strings_reconstruct(s: Star) -> DataFrame:
    rows = s.table("part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))).alias("r"))
    flat = rows.select("p_brand", "p_type", F.array_join(F.transform("r", lambda x: x["p_name"]), "").alias("text"), F.transform("r", lambda x: F.length(x["p_name"]).cast("bigint")).alias("lengths"))
    return traversal.sliced(flat, "text", "lengths").withColumn("idx", F.col("idx").cast("bigint"))


# grammar


def one_round(s: Star) -> tuple[DataFrame, DataFrame]:
    return grammar.round_of(keyed(s), WALK, s.events().agg(F.max("node_id")).first()[0])


@query
def grammar_round(s: Star) -> DataFrame:
    return one_round(s)[0]


@query
def rule_column_delta(s: Star) -> DataFrame:
    rules = one_round(s)[1]
    # the rulebook is numbered densely: the row before is the one with the id before
    before = rules.select((F.col("rule_id") + 1).alias("rule_id"), F.col("first").alias("f0"), F.col("second").alias("s0"))
    return rules.join(before, "rule_id", "left").select("rule_id", (F.col("first") - F.coalesce("f0", F.lit(0))).alias("first"), (F.col("second") - F.coalesce("s0", F.lit(0))).alias("second"))


@query
def grammar_expand(s: Star) -> DataFrame:
    steps, rules = one_round(s)
    return grammar.expand(steps, WALK, rules)


@query
def grammar_multi_round(s: Star) -> DataFrame:
    """Decoding what three rounds over deltas encode gives the walks back."""
    steps, rules = grammar.encode(keyed(s), WALK, rounds=3, delta=1)
    return grammar.decode(steps, WALK, rules, 1)


@query
def grammar_reduction(s: Star) -> DataFrame:
    steps, rules = one_round(s)
    before, after, n = (d.agg(F.count("*").alias(c)) for d, c in ((keyed(s), "n_before"), (steps, "n_after"), (rules, "n_rules")))
    return before.join(F.broadcast(after), F.lit(True)).join(F.broadcast(n), F.lit(True)).withColumn("share", F.round(F.col("n_after") / F.col("n_before"), 6))


@query
def append_encode(s: Star) -> DataFrame:
    """Walks of purchases, coded with the rules that all other walks give."""
    own = keyed(s)
    old, new = own.where("event_type <> 'purchase'"), own.where("event_type = 'purchase'")
    base = s.events().agg(F.max("node_id")).first()[0]
    rules = grammar.round_of(old, WALK, base)[1].withColumn("round", F.lit(1))
    return grammar.encode_with(new, WALK, rules, delta=0)


# appending and sets


def known_ends() -> list[Column]:
    """A walk's ends with -1 for unknown ones."""
    return [F.coalesce(c, F.lit(-1).cast("bigint")).alias(c) for c in ("seq_start", "seq_end")]


@query
def append_paths(s: Star) -> DataFrame:
    """Paths of first haplotypes, and those of second ones appended under new numbers."""
    all_ = s.paths().select("trav", "name", "overlaps")
    stored, new = all_.where("name like '%#1#%'"), all_.where("name like '%#2#%'").select("name", "overlaps")
    return append.appended(stored, new, ["name"]).select("trav", "name")


@query
def append_walks(s: Star) -> DataFrame:
    """Walks of purchases appended to all others."""
    w = s.walks().withColumn("u", F.expr("cast(substr(sample_id, 2) as bigint)"))
    stored = w.where("seq_id <> 'purchase'").select(F.expr("u * 100").alias("trav"), *extract.WALK_KEY)
    new = w.where("seq_id = 'purchase'").select(*extract.WALK_KEY)
    return append.appended(stored, new, ["sample_id", "seq_id"]).select("trav", "sample_id", "hap_index", "seq_id", *known_ends())


@query
def append_conflicts(s: Star) -> DataFrame:
    """Part names are not unique: those of long parts appended to those of short ones."""
    new, stored = s.segments().where("seq_len > 25"), s.segments().where("seq_len <= 25")
    return append.path_conflicts(new, stored)


@query
def tail_split(s: Star) -> DataFrame:
    rest, last = stats.split_tail(s.paths().select(F.col("trav").alias("line_no"), F.col("name").alias("line")), 10)
    return rest.select("line_no", "line", F.lit("head").alias("part")).unionByName(last.select("line_no", "line", F.lit("tail").alias("part")))


@query
def dangling_filter(s: Star) -> DataFrame:
    """Links whose ends are both among the short parts."""
    known = s.segments().where("seq_len <= 25").select("node_id")
    a, b = known.withColumnRenamed("node_id", "na"), known.withColumnRenamed("node_id", "nb")
    return s.links().join(a, F.abs("a") == F.col("na"), "left_semi").join(b, F.abs("b") == F.col("nb"), "left_semi")


# text


def part_graph(s: Star) -> PangenomeGraph:
    """Segments with tags, links between successive parts, and paths."""
    segments = s.segments().join(s.tags(), "node_id").select("node_id", F.col("node_id").cast("string").alias("name"), F.expr("repeat('A', cast(seq_len as int))").alias("sequence"), "seq_len", "tags")
    links = s.links().select((F.col("a") * 1000003 + F.col("b")).alias("link_idx"), F.abs("a").alias("from_id"), render.orient(F.col("a")).alias("from_orient"), F.abs("b").alias("to_id"), render.orient(F.col("b")).alias("to_orient"), F.lit(0).cast("bigint").alias("overlap_num"), F.lit("M").alias("overlap_op"), F.lit("0M").alias("overlap"), F.create_map().cast("map<string,struct<type:string,value:string>>").alias("tags"))
    return PangenomeGraph(segments, s.path_steps(), s.paths(), None, links)


def as_lines(g: PangenomeGraph) -> DataFrame:
    """The graph's text as numbered lines, as a reader would see them."""
    return gfa.gfa_lines(g).select(F.lit("").alias("_f"), F.col("section").cast("bigint").alias("_b"), F.col("idx").alias("_m"), F.col("line").alias("value"))


@query
def render_gfa_lines(s: Star) -> DataFrame:
    """Segments named apart from their numbers: all records carry the names."""
    g = part_graph(s)
    named = g.segments.withColumn("name", F.concat(F.lit("n"), "name"))
    return gfa.gfa_lines(replace(g, segments=named)).select("line")


@query
def scan_gfa_roundtrip(s: Star) -> DataFrame:
    """Text written and read again: name, position and signed node of all path steps."""
    g = gfa.graph_of(as_lines(part_graph(s)))
    return g.steps.where("kind = 'P'").join(g.paths, "trav").select("name", "pos", "snode")


@query
def path_parse_explode(s: Star) -> DataFrame:
    """Steps read from the text of the paths; the names are numbers here, so no dictionary is needed."""
    rows = gfa.parsed_steps(as_lines(part_graph(s)).where("value like 'P%'"), "P")
    return rows.where("step <> ''").select("name", F.col("pos").cast("bigint").alias("pos"), F.col("step").cast("bigint").alias("node_id"), "reverse")


@query
def walk_parse_explode(s: Star) -> DataFrame:
    text = gfa.gfa_lines(PangenomeGraph(s.segments().withColumn("sequence", F.lit("*")).withColumn("tags", F.create_map().cast("map<string,struct<type:string,value:string>>")), s.walk_steps(), None, s.walks()), names=False)
    rows = gfa.parsed_steps(text.where("line like 'W%'").select(F.lit("").alias("_f"), F.lit(0).alias("_b"), F.col("idx").alias("_m"), F.col("line").alias("value")), "W")
    return rows.select("sample_id", "seq_id", *known_ends(), F.col("pos").cast("bigint").alias("pos"), F.col("step").cast("bigint").alias("node_id"), "reverse")


@query
def link_parse(s: Star) -> DataFrame:
    """Overlap texts of several forms, read as number and operation."""
    o = s.table("orders").select("o_orderkey", F.element_at(F.array(*[F.lit(x) for x in ("*", "", "5", "12M", "3M2I", "M", "0M", "7=")]), (F.col("o_orderkey") % 8 + 1).cast("int")).alias("overlap"))
    num, op = gfa.overlap_parts(F.col("overlap"))
    return o.select("o_orderkey", "overlap", num.cast("bigint").alias("overlap_num"), op.alias("overlap_op"))


@query
def seg_dictionary(s: Star) -> DataFrame:
    """Part names in order of first occurrence, numbered from 1; of repeated names the first counts."""
    lines = s.table("part").select(F.lit("").alias("_f"), F.lit(0).alias("_b"), F.col("p_partkey").alias("_m"), F.concat_ws("\t", F.lit("S"), F.regexp_replace("p_name", " ", "_"), F.expr("repeat('A', p_size)")).alias("value"))
    return gfa.parsed_segments(lines).select("node_id", "name", "seq_len")


@query
def tag_pivot(s: Star) -> DataFrame:
    lines = s.table("part").select("p_partkey", F.concat_ws("\t", F.lit("S"), F.col("p_partkey").cast("string"), F.lit("*"), F.concat(F.lit("BZ:Z:"), "p_brand"), F.concat(F.lit("SZ:i:"), F.col("p_size").cast("string")), F.lit("bad"), F.concat(F.lit("TY:Z:"), "p_type")).alias("value"))
    tags = lines.select("p_partkey", gfa.parsed_tags(gfa.fields(F.col("value")), 3).alias("t"))
    return tags.select("p_partkey", F.col("t")["BZ"]["value"].alias("bz"), F.col("t")["SZ"]["value"].cast("bigint").alias("sz"), F.col("t")["TY"]["value"].alias("ty"))


@query
def tag_render(s: Star) -> DataFrame:
    """Tags as text; prices with six significant digits."""
    part = s.table("part").select("p_partkey", F.round(F.col("p_retailprice") * 100).cast("bigint").alias("cents"), "p_brand", "p_size")
    price = render.general(F.col("cents") / 100.0, 6)
    return part.select("p_partkey", F.concat(F.concat_ws(":", F.lit("BZ"), F.lit("Z"), "p_brand"), F.lit("\t"), F.concat_ws(":", F.lit("PR"), F.lit("f"), price), F.lit("\t"), F.concat_ws(":", F.lit("SZ"), F.lit("i"), F.col("p_size").cast("string"))).alias("tags"))


# counts and comparisons


@query
def graph_summary(s: Star) -> DataFrame:
    g = PangenomeGraph(s.segments(), s.path_steps().unionByName(s.walk_steps()), s.paths(), s.walks(), s.links())
    return stats.summary(g)


@query
def dense_name_stats(s: Star) -> DataFrame:
    """Names that equal the ordinal: long parts keep their names."""
    seg = s.segments().withColumn("name", F.when(F.col("seq_len") > 25, F.col("name")).otherwise(F.col("node_id").cast("string")))
    return rounded(stats.dense_names(seg), "share", 6)


@query
def column_size_stats(s: Star) -> DataFrame:
    parts = [stats.column_sizes(s.segments(), "segments"), stats.column_sizes(s.path_steps().drop("kind"), "steps"), stats.column_sizes(s.paths(), "paths")]
    return parts[0].union(parts[1]).union(parts[2])


@query
def orient_bitpack(s: Star) -> DataFrame:
    return stats.packed_orientations(s.path_steps(), ["trav"])


@query
def varint_sizes(s: Star) -> DataFrame:
    return stats.varint_sizes(traversal.delta(without_kind(s.path_steps()), ["trav"]), ["trav"])


@query
def verify_equal(s: Star) -> DataFrame:
    """Rows in which the paths and a copy with other names for second haplotypes differ."""
    a = s.paths().select("trav", "name")
    b = a.withColumn("name", F.when(F.col("name").like("%#2#%"), F.concat("name", F.lit("x"))).otherwise(F.col("name")))
    return stats.differences(a, b)




# records and texts of other kinds


def order_lines(s: Star, *fields: Column) -> DataFrame:
    """A line for each order, fields joined by tabs, in order of the keys."""
    return s.table("orders").select(F.lit("").alias("_f"), F.lit(0).alias("_b"), F.col("o_orderkey").alias("_m"), F.concat_ws("\t", *fields).alias("value"))


def number(c: Column) -> Column:
    return c.cast("string")


def long_parts(s: Star) -> DataFrame:
    """name, node_id of long parts: the segments that jumps and containments can name."""
    return s.segments().where("seq_len > 25").select(number(F.col("node_id")).alias("name"), "node_id")


def order() -> Column:
    return F.col("o_orderkey")


@query
def header_scan(s: Star) -> DataFrame:
    return gfa.parsed_header(order_lines(s, F.lit("H"), F.concat(F.lit("VN:Z:"), number(order()))))


@query
def jump_parse(s: Star) -> DataFrame:
    distance = F.when(order() % 3 == 0, "*").otherwise(number(order()))
    lines = order_lines(s, F.lit("J"), number(order() % 50 + 1), F.lit("+"), number(order() % 7 + 1), F.lit("-"), distance, F.lit("SC:i:1"), F.lit("XX:Z:y"))
    return gfa.parsed_jumps(lines, long_parts(s))


@query
def containment_parse(s: Star) -> DataFrame:
    lines = order_lines(s, F.lit("C"), number(order() % 50 + 1), F.lit("+"), number(order() % 7 + 1), F.lit("-"), F.concat(number(order()), F.lit("x")), F.lit("5M"), F.lit("ID:Z:q"))
    return gfa.parsed_containments(lines, long_parts(s))


@query
def bed_parse(s: Star) -> DataFrame:
    """Windows as text of six forms: whole, without a name, commented, blank, reversed, malformed."""
    k = number(order())
    forms = [F.concat(F.lit("c"), k, F.lit("\t5\t9\tn"), k), F.concat(F.lit("c"), k, F.lit("  7 8")), F.lit("# note"), F.lit(""), F.concat(F.lit("c"), k, F.lit(" 9 5 r")), F.concat(F.lit("c"), k, F.lit(" -1 5"))]
    text = F.element_at(F.array(*forms), (order() % 6 + 1).cast("int"))
    return bed.parsed_bed(order_lines(s, text)).select(F.col("_m").alias("line_no"), "chrom", F.coalesce("start", F.lit(-1).cast("bigint")).alias("start"), F.coalesce("end", F.lit(-1).cast("bigint")).alias("end"), F.coalesce("name", F.lit("")).alias("name"), "ok")


@query
def appendix_check(s: Star) -> DataFrame:
    """Which lines could be appended as paths or as walks."""
    k = number(order() + 1)
    forms = [F.concat(F.lit("P\tp"), k, F.lit("\t1+,2-\t*")), F.concat(F.lit("P\tp"), k, F.lit("\t1+,0-\t*")), F.concat(F.lit("P\tp"), k, F.lit("\t1+,x-")), F.concat(F.lit("W\ts\t0\tq\t*\t*\t>"), k, F.lit("<3")), F.lit("W\ts\tx\tq\t*\t*\t>1"), F.lit("W\ts\t0\tq\t0\t5\t1>2")]
    line = F.element_at(F.array(*forms), (order() % 6 + 1).cast("int"))
    return s.table("orders").select("o_orderkey", line.rlike(appendix.PATH).alias("is_path"), line.rlike(appendix.WALK).alias("is_walk"))


@query
def number_prefix(s: Star) -> DataFrame:
    k = number(order())
    text = F.element_at(F.array(k, F.concat(k, F.lit("abc")), F.concat(F.lit("-"), k), F.concat(F.lit("x"), k)), (order() % 4 + 1).cast("int"))
    return s.table("orders").select("o_orderkey", F.coalesce(gfa.leading_int(text), F.lit(-999).cast("bigint")).alias("n"))


@query
def tag_conflicts(s: Star) -> DataFrame:
    """Tags of which some records have another type than the rest, or one that is unknown."""
    part = s.table("part").select(F.create_map(F.lit("AA"), F.struct(F.when(F.col("p_size") > 10, "i").otherwise("Z").alias("type"), F.lit("1").alias("value")), F.lit("BB"), F.struct(F.lit("Z").alias("type"), F.lit("1").alias("value")), F.lit("CC"), F.struct(F.lit("q").alias("type"), F.lit("1").alias("value"))).alias("tags"))
    return gfa.tag_conflicts(part).select("tag", F.array_join("types", ",").alias("types"))


@query
def render_streamed(s: Star) -> DataFrame:
    """Lines in the order of the streamed layout: links before paths."""
    return gfa.gfa_lines(part_graph(s), "streamed", names=False).select("section", "line")


@query
def pav_lines(s: Star) -> DataFrame:
    return pav.pav_lines(s.node_graph(), s.tiles(), Grouping.SAMPLE, strict=False).select("line")


@query
def walk_groups(s: Star) -> DataFrame:
    return s.walks().select("sample_id", "seq_id", *(pansn.walk_key(F.col("sample_id"), F.col("hap_index"), F.col("seq_id"), m).alias(m.value.replace("-", "_")) for m in MODES))


@query
def flat_delta(s: Star) -> DataFrame:
    """Differences across the whole table of part sizes, in order of the keys."""
    return traversal.flat_delta(s.segments().select("node_id", "seq_len"), ["node_id"], "seq_len")


@query
def largest_symbols(s: Star) -> DataFrame:
    return traversal.largest_symbols(without_kind(s.path_steps()), ["trav"], 3)


@query
def zigzag_values(s: Star) -> DataFrame:
    d = traversal.delta(without_kind(s.path_steps()), ["trav"])
    return d.select("trav", "pos", packing.zigzag(F.col("snode")).alias("z"), packing.varint_bytes(packing.zigzag(F.col("snode"))).cast("bigint").alias("n"))


@query
def unpacked_2mers(s: Star) -> DataFrame:
    mers = traversal.two_mers(keyed(s), WALK)
    key = packing.pack(F.col("a"), -F.col("b"))
    return mers.select("user_id", "event_type", "pos", packing.unpack_first(key).alias("first"), packing.unpack_second(key).alias("second"))


@query
def used_rules(s: Star) -> DataFrame:
    """Rules that a round of replacement used, in the order of their numbers."""
    return one_round(s)[1].select("rule_id", "kmer", "first", "second")


@query
def rule_leaves(s: Star) -> DataFrame:
    """Each rule written out: as many leaves as it stands for."""
    table = grammar.leaves(one_round(s)[1])
    return table.select("rule_id", F.size("leaf").cast("bigint").alias("n"), F.array_join(F.transform("leaf", lambda x: x.cast("string")), ",").alias("leaf"))


@query
def size_texts(s: Star) -> DataFrame:
    n = order() * order() * 977
    return s.table("orders").select("o_orderkey", packing.size_text(n).alias("size"))


@query
def store_roundtrip(s: Star) -> DataFrame:
    """The graph stored with coded traversals and read back."""
    where = f"{work_dir(s.spark)}/{uuid.uuid4().hex}/store"
    storage.save(part_graph(s), where, rounds=2, delta=1)
    g = storage.load(s.spark, where)
    return g.steps.where("kind = 'P'").join(g.paths, "trav").select("name", "pos", "snode")
