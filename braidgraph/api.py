"""One function for each task, for programs: texts and folders in, tables and lines out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .model import Grouping, PangenomeGraph
from .operators import append, extract, stats
from .operators import growth as growth_of
from .operators import pav as pav_of
from .sources import appendix, bed, gfa, storage

#: Defaults of compress().
DEFAULT_ROUNDS, DEFAULT_DELTA, DEFAULT_THRESHOLD, DEFAULT_LEVEL = 8, 1, 2, 9


def parse_gfa(spark: SparkSession, path: str, use_ln_tag: bool = False) -> PangenomeGraph:
    """use_ln_tag: segments without a sequence have the length that their LN tag gives, else one base."""
    return gfa.read_gfa(spark, path, use_ln_tag=use_ln_tag)


def compress(spark: SparkSession, path: str, store: str, rounds: int = DEFAULT_ROUNDS, delta: int = DEFAULT_DELTA, threshold: int = DEFAULT_THRESHOLD, level: int = DEFAULT_LEVEL) -> None:
    """Text to a stored graph with coded traversals. threshold: how often a pair occurs to get a rule; level: of Zstd."""
    storage.save(gfa.read_gfa(spark, path), store, rounds, delta, level, threshold)


def serialize(g: PangenomeGraph, store: str, rounds: int = DEFAULT_ROUNDS, delta: int = DEFAULT_DELTA, threshold: int = DEFAULT_THRESHOLD, level: int = DEFAULT_LEVEL) -> None:
    """A graph to a folder."""
    storage.save(g, store, rounds, delta, level, threshold)


def deserialize(spark: SparkSession, store: str) -> PangenomeGraph:
    """The graph in a folder."""
    return storage.load(spark, store)


def compress_directory(spark: SparkSession, folder: str, out: str, rounds: int = DEFAULT_ROUNDS, delta: int = DEFAULT_DELTA) -> list[str]:
    """Store every .gfa file of a folder (of any file system that Spark reads) under out; returns the stores."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().endswith(".gfa"))
    for n in names:
        compress(spark, f"{folder}/{n}", f"{out}/{n.removesuffix('.gfa')}", rounds, delta)
    return [f"{out}/{n.removesuffix('.gfa')}" for n in names]


def decompress(spark: SparkSession, store: str) -> PangenomeGraph:
    return storage.load(spark, store)


def write_gfa(g: PangenomeGraph, path: str, layout: str = "stored") -> None:
    gfa.write_gfa(g, path, layout)


def verify_round_trip(a: PangenomeGraph, b: PangenomeGraph) -> bool:
    """Whether two graphs are equal in everything but segment names."""
    return not stats.same_graph(a, b)


def extract_path_line(g: PangenomeGraph, name: str) -> str:
    return extract_path_lines(g, [name])[0]


def extract_path_lines(g: PangenomeGraph, names: list[str]) -> list[str]:
    return [r["line"] for r in extract.extract_paths(names, g.paths, g.steps).collect()]


def extract_walk_lines(g: PangenomeGraph, keys: list[tuple]) -> list[str]:
    """keys: sample, haplotype, sequence, start, end (None: *)."""
    return [r["line"] for r in extract.extract_walks(keys, g.walks, g.steps).collect()]


def extract_walk_line(g: PangenomeGraph, sample: str, hap: int = 0, seq: str = "", start: int | None = None, end: int | None = None) -> str:
    return extract_walk_lines(g, [(sample, hap, seq, start, end)])[0]


def extract_walk_line_by_name(g: PangenomeGraph, sample: str) -> str:
    return extract_walk_lines_by_name(g, [sample])[0]


def extract_walk_lines_by_name(g: PangenomeGraph, samples: list[str]) -> list[str]:
    return [r["line"] for r in extract.extract_walks_by_sample(samples, g.walks, g.steps).collect()]


def add_haplotypes(spark: SparkSession, g: PangenomeGraph, path: str, strict: bool = False) -> PangenomeGraph:
    """A graph with the paths or walks of a file appended; g stays as it is."""
    return append.add_haplotypes(g, *appendix.read_appendix(spark, path), strict)


def growth(g: PangenomeGraph, mode: Grouping | str = Grouping.PATH) -> DataFrame:
    return growth_of.growth(g, mode)


def pav(spark: SparkSession, g: PangenomeGraph, windows: str | DataFrame, mode: Grouping | str = Grouping.PATH) -> DataFrame:
    return pav_of.pav(g, bed.read_bed(spark, windows) if isinstance(windows, str) else windows, mode)
