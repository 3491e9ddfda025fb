"""The driver's star schema seen as a graph: parts are segments, orders are paths over parts, event chains are walks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.staging import Lookup
from ..model import PangenomeGraph
from ..operators.pav import Tiles

#: Width of the windows on reference paths.
TILE = 25


class Star:
    """The tables of one scale, and their projections."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def segments(self) -> DataFrame:
        """node_id, name, seq_len."""
        return self.table("part").select((F.col("p_partkey") + 1).alias("node_id"), F.col("p_name").alias("name"), F.col("p_size").cast("bigint").alias("seq_len"))

    def tags(self) -> DataFrame:
        """node_id and the tags BZ (brand), TY (type), PR (price)."""
        tag = lambda t, v: F.struct(F.lit(t).alias("type"), v.cast("string").alias("value"))
        return self.table("part").select((F.col("p_partkey") + 1).alias("node_id"), F.create_map(F.lit("BZ"), tag("Z", F.col("p_brand")), F.lit("TY"), tag("Z", F.col("p_type")), F.lit("PR"), tag("f", F.col("p_retailprice"))).alias("tags"))

    def path_steps(self) -> DataFrame:
        """kind, trav, pos, snode."""
        node = F.col("l_partkey") + 1
        order = ["l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate"]
        # renamed before the window, so that what follows along a traversal finds the rows partitioned already; parts
        # travel as nodes only, whose order is theirs
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("trav"), F.when(F.col("l_returnflag") == "R", -node).otherwise(node).alias("snode"), *order)
        w = Window.partitionBy("trav").orderBy("l_linenumber", F.abs("snode"), *order[1:])
        return lines.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).select(F.lit("P").alias("kind"), "trav", "pos", "snode")

    def node_steps(self) -> DataFrame:
        """path_steps() with all nodes forward: steps that only differ by what breaks ties after the node, or by direction,
        are alike here, so that less is exchanged."""
        lines = self.table("lineitem").select(F.col("l_orderkey").alias("trav"), (F.col("l_partkey") + 1).alias("snode"), "l_linenumber")
        w = Window.partitionBy("trav").orderBy("l_linenumber", "snode")
        return lines.withColumn("pos", (F.row_number().over(w) - 1).cast("bigint")).select(F.lit("P").alias("kind"), "trav", "pos", "snode")

    def paths(self) -> DataFrame:
        """trav, name, overlaps."""
        o = self.table("orders").join(self.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        name = F.concat(F.lit("N"), F.col("c_nationkey").cast("string"), F.lit("#"), (F.col("o_custkey") % 2 + 1).cast("string"), F.lit("#ord"), F.col("o_orderkey").cast("string"))
        return o.select(F.col("o_orderkey").alias("trav"), name.alias("name"), F.lit("").alias("overlaps"))

    def events(self) -> DataFrame:
        """trav (a 64-bit hash of user and type), event_id, user_id, event_type, node_id."""
        k = F.get_json_object("props", "$.k").cast("bigint") + 1
        return self.table("events").select(F.xxhash64("user_id", "event_type").alias("trav"), "event_id", "user_id", "event_type", k.alias("node_id"))

    def walk_steps(self) -> DataFrame:
        """kind, trav, pos, snode."""
        w = Window.partitionBy("trav").orderBy("event_id")
        return self.events().select(F.lit("W").alias("kind"), "trav", (F.row_number().over(w) - 1).cast("bigint").alias("pos"), F.col("node_id").alias("snode"))

    def walks(self) -> DataFrame:
        """trav, sample_id, hap_index, seq_id, seq_start, seq_end; ends are unknown for every fifth user."""
        known = F.col("user_id") % 5 != 0
        sized = self.events().join(self.segments(), "node_id").groupBy("trav", "user_id", "event_type").agg(F.sum("seq_len").alias("total"))
        return sized.select("trav", F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("sample_id"), F.lit(0).cast("bigint").alias("hap_index"), F.col("event_type").alias("seq_id"), F.when(known, F.lit(0).cast("bigint")).alias("seq_start"), F.when(known, F.col("total")).alias("seq_end"))

    def path_graph(self) -> PangenomeGraph:
        return PangenomeGraph(self.segments(), self.path_steps(), self.paths())

    def node_graph(self) -> PangenomeGraph:
        """path_graph() without directions."""
        return PangenomeGraph(self.segments(), self.node_steps(), self.paths())

    def walk_graph(self) -> PangenomeGraph:
        return PangenomeGraph(self.segments(), self.walk_steps(), None, self.walks())

    def links(self) -> DataFrame:
        """a, b: adjacent steps of paths, distinct."""
        w = Window.partitionBy("trav").orderBy("pos")
        return self.path_steps().select(F.col("snode").alias("a"), F.lead("snode").over(w).alias("b")).where("b is not null").distinct()

    def references(self) -> DataFrame:
        """trav, name, total of every path."""
        sizes = Lookup.of(self.segments(), ["node_id"], "seq_len").join(self.node_steps().select("trav", F.col("snode").alias("node_id"))).groupBy("trav").agg(F.sum("seq_len").alias("total"))
        return sizes.join(self.paths(), "trav").select("trav", "name", "total")

    def tiles(self) -> Tiles:
        """Tiles over all paths; 32 bits of a window's number are its place on the path."""
        rows = self.references().select(F.col("trav").alias("path"), F.col("name").alias("chrom"), "total")

        def made(df: DataFrame) -> DataFrame:
            start = F.col("w") * TILE
            each = df.withColumn("w", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("total") - 1) / TILE))))
            windows = {"wid": F.col("path") * (1 << 32) + F.col("w"), "start": start, "end": start + TILE, "name": F.concat_ws(":", "chrom", F.col("w").cast("string"))}
            return each.withColumns(windows).drop("path", "total", "w")

        return Tiles(rows, made)

    def bed(self) -> DataFrame:
        """wid, chrom, start, end, name: the tiles as rows."""
        return self.tiles().windows().select("wid", "chrom", "start", "end", "name")
