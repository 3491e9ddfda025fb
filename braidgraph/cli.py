"""Command line: python -m braidgraph <verb> ..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession

from .model import Grouping
from .operators import append, extract, growth, pav, stats
from .sources import appendix, bed, gfa, storage


def session(threads: int) -> SparkSession:
    """A session; a master set in the environment or by spark-submit is kept."""
    builder = SparkSession.builder.appName("braidgraph")
    if threads:
        builder = builder.master(f"local[{threads}]")
    return builder.config("spark.sql.adaptive.enabled", "true").getOrCreate()


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="braidgraph")
    p.add_argument("-j", "--threads", type=int, default=0, help="local threads; 0: the session's own master")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *args: tuple, **more: object) -> argparse.ArgumentParser:
        v = verbs.add_parser(name, **more)
        for a in args:
            v.add_argument(a)
        if name in ("pav", "growth") or name.startswith("extract"):
            v.add_argument("-o", "--out", help="folder for the lines, written by the executors; else they are printed")
        return v

    v = verb("compress", "gfa", "store")
    v.add_argument("-r", "--rounds", type=int, default=8)
    v.add_argument("-d", "--delta", type=int, default=1)
    v.add_argument("-t", "--threshold", type=int, default=2, help="how often a pair must occur to get a rule")
    v.add_argument("-z", "--level", type=int, default=9, help="Zstd level")
    v.add_argument("-s", "--stats", action="store_true", help="counts, seconds, bytes, and bytes of each stored column")
    v.add_argument("--ln", action="store_true", help="segments without a sequence have the length that their LN tag gives")
    v = verb("decompress", "store", "gfa")
    v.add_argument("-s", "--stats", action="store_true")
    v.add_argument("-l", "--layout", choices=sorted(gfa.SECTIONS), default="streamed")
    v = verb("extract-path", "store")
    v.add_argument("names", nargs="+")
    v = verb("extract-walk", "store")
    v.add_argument("keys", nargs="+", help="five fields a walk: sample, haplotype, sequence, start, end (* if unknown)")
    v = verb("extract-sample", "store")
    v.add_argument("names", nargs="+")
    v = verb("add-haplotypes", "store", "lines", "out")
    v.add_argument("--strict", action="store_true", help="steps must name known segments")
    v = verb("growth", "store")
    v.add_argument("-G", "--group-by", default="path")
    v = verb("pav")
    v.add_argument("-i", "--store", required=True)
    v.add_argument("-b", "--bed", required=True)
    g = v.add_mutually_exclusive_group()
    g.add_argument("-S", "--sample", action="store_true")
    g.add_argument("-H", "--haplotype", action="store_true")
    v.add_argument("-M", "--matrix", action="store_true")
    v.add_argument("-B", "--binary", type=float)
    verb("summary", "store")
    return p


def walk_keys(fields: list[str]) -> list[tuple]:
    if not fields or len(fields) % 5:
        raise SystemExit("extract-walk takes five fields for each walk")
    end = lambda x: None if x == "*" else int(x)
    return [(s, int(h), q, end(a), end(b)) for s, h, q, a, b in zip(*(fields[i::5] for i in range(5)), strict=True)]


def sizes(spark: SparkSession, text: str, store: str, seconds: float) -> list[str]:
    """Bytes of the text and of the store, their ratio, and how much of the text was worked on in a second."""
    plain, stored = storage.folder_bytes(spark, text), storage.folder_bytes(spark, store)
    out = [f"seconds\t{seconds:.2f}", f"text_bytes\t{plain}", f"stored_bytes\t{stored}"]
    return out + [f"ratio\t{plain / max(stored, 1):.2f}", f"MiB_per_second\t{plain / (1 << 20) / max(seconds, 1e-9):.2f}"]


def run(argv: list[str] | None = None, out=sys.stdout) -> int:
    args = parser().parse_args(argv)
    spark = session(args.threads)
    say = lambda x: print(x, file=out)

    def emit(lines: DataFrame) -> None:
        """Print lines in their order, a partition at a time, or have the executors write them."""
        if args.out:
            lines.select("line").write.text(args.out)
        else:
            for r in lines.select("line").toLocalIterator():
                say(r["line"])

    if args.verb == "compress":
        began, g = time.time(), gfa.read_gfa(spark, args.gfa, use_ln_tag=args.ln)
        storage.save(g, args.store, args.rounds, args.delta, args.level, args.threshold)
        if args.stats:
            for r in stats.summary(g).collect():
                say(f"{r['record']}\t{r['n']}")
            for line in sizes(spark, args.gfa, args.store, time.time() - began):
                say(line)
            for r in storage.column_bytes(spark, args.store):
                say("\t".join(map(str, r)))
        return 0
    if args.verb == "pav":
        mode = Grouping.SAMPLE if args.sample else Grouping.SAMPLE_HAP if args.haplotype else Grouping.PATH
        g = storage.load(spark, args.store, ["paths", "walks"])
        emit(pav.output(g, bed.read_bed(spark, args.bed), mode, args.matrix, args.binary).sort("wid", "place"))
        return 0
    g = storage.load(spark, args.store)
    if args.verb == "decompress":
        began = time.time()
        gfa.write_gfa(g, args.gfa, args.layout)
        if args.stats:
            for line in sizes(spark, args.gfa, args.store, time.time() - began):
                say(line)
    elif args.verb == "extract-path":
        emit(extract.extract_paths(args.names, g.paths, g.steps))
    elif args.verb == "extract-walk":
        emit(extract.extract_walks(walk_keys(args.keys), g.walks, g.steps))
    elif args.verb == "extract-sample":
        emit(extract.extract_walks_by_sample(args.names, g.walks, g.steps))
    elif args.verb == "add-haplotypes":
        kind, meta, steps = appendix.read_appendix(spark, args.lines)
        how = storage.about(spark, args.store)
        storage.save(append.add_haplotypes(g, kind, meta, steps, args.strict), args.out, how["rounds"], how["delta"])
    elif args.verb == "growth":
        mode = Grouping.of(args.group_by)
        emit(growth.output(g, mode).sort("k"))
    elif args.verb == "summary":
        for r in stats.summary(g).collect():
            say(f"{r['record']}\t{r['n']}")
    return 0
