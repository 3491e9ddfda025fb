"""Near duplicates by DartMinHash signatures and banded joining.

A text is the set of its runs of five words, each with a weight. Darts are thrown by hashing over the plane (weight,
rank) of every element, at one per unit of area and alike in every text; those under the element's weight count. Each
dart falls to one of k coordinates, and a coordinate keeps its earliest dart (Christiani, 2020: DartMinHash). Two texts
agree in a coordinate with a probability equal to their weighted Jaccard similarity. Texts that agree in a whole band of
coordinates become candidates, which are checked exactly on their sets, and links are joined into classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from . import textfeat
from ._common import ready, staged, unstage
from .textfeat import mix64

WORDS = 5
BANDS, ROWS = 40, 6  #: 240 coordinates; at similarity 0.8 a pair shares no band in 5 of a million cases
#: Rank from which the first cell of darts doubles: fine enough for texts of some hundred thousand words.
FINEST = 6
ELEMENT_BITS = 52
#: Cells of darts that are looked at together, and digests of texts that a task remembers.
BLOCK, REMEMBERED = 100_000, 200_000
_UNIT = 1 / float(1 << 53)
_STEP = np.uint64(0xD6E8FEB86659FD93)


def unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(np.float64) * _UNIT


def shingles(texts: list[str], weigh: str = "set") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, element, weight) of the distinct runs of five words, lower case, marks ignored; sorted.

    A text of one to four words has them all as its only element. weigh: 'set' gives weight 1, 'count' the number of
    times the run occurs. The text index takes the bits beside the element: chunks() keeps it small enough.
    """
    if len(texts) > 1 << (64 - ELEMENT_BITS):
        raise ValueError("too many texts in one call")
    h, doc = textfeat.tokens(texts, words_only=True)
    n = np.bincount(doc, minlength=len(texts)) if len(h) else np.zeros(len(texts), int)
    run = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for j in range(WORDS):
        run = run * np.uint64(0x9E3779B97F4A7C15) + h[j : len(run) + j]
    same = doc[: len(run)] == doc[WORDS - 1 :] if len(run) else np.zeros(0, bool)
    run, of = mix64(run[same]), doc[: len(run)][same]
    short = np.flatnonzero((n > 0) & (n < WORDS))
    if len(short):
        start = np.concatenate([[0], np.cumsum(n)])
        few = np.zeros(len(short), np.uint64)
        for j in range(WORDS - 1):
            more = n[short] > j
            few[more] = mix64(few[more] * np.uint64(31) + h[start[short[more]] + j])
        run, of = np.concatenate([run, few]), np.concatenate([of, short])
    key, count = np.unique((of.astype(np.uint64) << np.uint64(ELEMENT_BITS)) | (run >> np.uint64(64 - ELEMENT_BITS)), return_counts=True)
    weight = count.astype(float) if weigh == "count" else np.ones(len(key))
    return (key >> np.uint64(ELEMENT_BITS)).astype(np.int64), key & np.uint64((1 << ELEMENT_BITS) - 1), weight


def poisson(u: np.ndarray, area: float) -> np.ndarray:
    """Poisson counts with mean area, from uniform numbers."""
    p, total, limits = np.exp(-area), 0.0, []
    for i in range(1, 24):
        total += p
        limits.append(total)
        p *= area / i
    return np.searchsorted(np.array(limits), u, side="right")


def dart_signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int, reach: float = 4.0) -> np.ndarray:
    """n x k earliest darts (as 64-bit values: rank, then dart); texts without elements have the largest value throughout.

    Every text gets k * (ln k + reach) darts in expectation; the few that leave a coordinate empty are thrown for again
    with a larger reach, which adds later darts and changes none.
    """
    total = np.bincount(doc, weight, minlength=n)
    limit = np.where(total > 0, k * (np.log(k) + reach) / np.maximum(total, 1e-300), 0.0)
    best = np.full(n * k, ~np.uint64(0), np.uint64)
    # one entry for each started unit of weight, with how much of it is covered
    units = np.ceil(weight).astype(np.int64)
    at = np.repeat(np.arange(len(doc)), units)
    level = np.arange(len(at)) - np.repeat(np.cumsum(units) - units, units)
    seed = mix64(element[at] + level.astype(np.uint64) * _STEP)
    covered, of = weight[at] - level, doc[at]

    def throw(i: np.ndarray, h: np.ndarray, low: np.ndarray | float, width: float) -> None:
        """Darts in the cells (unit i, ranks low to low + width); h: the cells' hashes."""
        count = poisson(unit(h), width)
        hit = np.flatnonzero(count)
        times = count[hit]
        cell = np.repeat(hit, times)
        serial = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
        dart = mix64(h[cell] + (serial.astype(np.uint64) + np.uint64(1)) * _STEP)
        rank = (low[cell] if isinstance(low, np.ndarray) else low) + width * unit(mix64(dart ^ np.uint64(1)))
        under = unit(mix64(dart ^ np.uint64(2))) < covered[i[cell]]
        cell, dart, rank = cell[under], dart[under], rank[under]
        value = (np.minimum(rank * (1 << 16), float((1 << 32) - 1)).astype(np.uint64) << np.uint64(32)) | (dart & np.uint64(0xFFFFFFFF))
        np.minimum.at(best, of[i[cell]] * k + ((dart >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value)

    edges = [0.0, *(2.0**-j for j in range(FINEST, -1, -1))]
    for j in range(len(edges) - 1):
        i = np.flatnonzero(limit[of] > edges[j])
        if len(i):
            throw(i, mix64(seed[i] ^ np.uint64(j + 1)), edges[j], edges[j + 1] - edges[j])
    more = np.maximum(np.ceil(limit[of]).astype(np.int64) - 1, 0)  # beyond rank 1 every cell is one unit wide
    cells = np.cumsum(more)
    cut = np.searchsorted(cells, np.arange(0, max(1, cells[-1]) if len(cells) else 1, BLOCK), side="right")
    for a, b in zip(cut, [*cut[1:], len(of)], strict=True):  # about BLOCK cells at a time
        m = more[a:b]
        i = np.repeat(np.arange(a, b), m)
        if len(i):
            rank = 1 + np.arange(len(i)) - np.repeat(np.cumsum(m) - m, m)
            throw(i, mix64(seed[i] + rank.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)), rank.astype(float), 1.0)
    out = best.reshape(n, k)
    short = np.flatnonzero((total > 0) & (out == ~np.uint64(0)).any(1))
    if len(short):
        own = np.isin(doc, short)
        out[short] = dart_signatures(np.searchsorted(short, doc[own]), element[own], weight[own], len(short), k, 2 * reach + 4)
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit value for each band of each signature."""
    s = sig.reshape(len(sig), bands, rows)
    h = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), s.shape[:2]).copy()
    for j in range(rows):
        h = mix64(h ^ s[:, :, j])
    return h.view(np.int64)


def text_node(text: Column, salt: int) -> Column:
    """A 64-bit id of the exact text; null for null."""
    return F.when(text.isNotNull(), F.xxhash64(F.md5(text.cast("binary")), F.lit(salt)))


def banded(docs: DataFrame, weigh: str, bands: int, rows: int) -> DataFrame:
    """doc_id, full (the text's 128-bit digest), size (number of elements) and bands; null texts left out.

    A text that a task has met already comes without size and bands.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for b in batches:
            full = b.column("full").to_pylist()
            new = []
            for i, f in enumerate(full):
                if f not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(f)
                    new.append(i)
            sizes, lists = [None] * len(full), [None] * len(full)
            at = iter(new)
            for _, part in textfeat.chunks(b.column("text").take(pa.array(new, pa.int64())).to_pylist()):
                doc, element, weight = shingles(part, weigh)
                n = np.bincount(doc, minlength=len(part))
                h = band_hashes(dart_signatures(doc, element, weight, len(part), bands * rows), bands, rows)
                for x, m in zip(h.tolist(), n.tolist(), strict=True):
                    i = next(at)
                    sizes[i], lists[i] = m, x if m else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("full"), pa.array(sizes, pa.int32()), pa.array(lists, pa.list_(pa.int64()))], names=["doc_id", "full", "size", "bands"])

    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType)]).add("full", "string").add("size", "integer").add("bands", ArrayType(LongType()))
    return docs.where("text is not null").select("doc_id", F.md5(F.col("text").cast("binary")).alias("full"), "text").mapInArrow(run, schema)


#: Bits of the filter that is sent to all tasks to skip texts without candidates: 16 for each candidate, within these limits (powers
#: of two; 32 MB at most). Beyond 16 million candidates more false hits pass it, at worst every text once; the join drops them.
FILTER_BITS = (16, 28)


def bit_filter(nodes: DataFrame) -> np.ndarray:
    """A bit for each node, by its low bits, in words of 64: at most 2^22 of them reach the driver."""
    wanted = int(np.ceil(np.log2(16 * max(1, nodes.count()))))
    low = (1 << min(max(wanted, FILTER_BITS[0]), FILTER_BITS[1])) - 1
    place = F.col("node").bitwiseAND(low)
    words = nodes.select(F.shiftright(place, 6).alias("w"), F.expr("shiftleft(1L, cast(node & 63 as int))").alias("b")).groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros((low + 1) >> 6, np.uint64)
    out[words["w"].to_numpy()] = words["b"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def element_sets(docs: DataFrame, nodes: DataFrame, salt: int) -> DataFrame:
    """node and its elements (sorted 64-bit integers) for the given nodes, one row each."""
    ready(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(nodes))  # bounded by FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = b.column("node").to_numpy()
            low = node & (64 * len(shared.value) - 1)
            hit = np.flatnonzero((shared.value[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1))
            if not len(hit):
                continue
            b = b.take(pa.array(hit))
            sets = []
            for _, part in textfeat.chunks(b.column("text").to_pylist()):
                doc, element, _ = shingles(part)
                cut = np.searchsorted(doc, np.arange(len(part) + 1))
                sets += [element[cut[i] : cut[i + 1]].astype("<u8").tobytes() for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "x"])

    rows = docs.where("text is not null").select(text_node(F.col("text"), salt).alias("node"), "text").mapInArrow(run, "node long, x binary")
    # equal texts have equal sets: they are brought together before the exchange, then the filter's false hits go
    return rows.groupBy("node").agg(F.min("x").alias("x")).join(nodes.select("node").distinct(), "node", "left_semi")


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of at least `least`."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("x").alias("xa")), "a").join(sets.select(F.col("node").alias("b"), F.col("x").alias("xb")), "b")
    # the smaller set cannot share more than itself
    small, large = F.least(F.length("xa"), F.length("xb")), F.greatest(F.length("xa"), F.length("xb"))
    both = both.where(small >= large * least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            keep = []
            for i, (x, y) in enumerate(zip(t.column("xa").to_pylist(), t.column("xb").to_pylist(), strict=True)):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                z = np.sort(np.concatenate([x, y]), kind="stable")
                common = int((z[1:] == z[:-1]).sum())
                if common >= least * (len(x) + len(y) - common) - 1e-9:
                    keep.append(i)
            yield t.take(pa.array(keep, pa.int64())).select(["a", "b"])

    return both.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """node and comp (the smallest node reached) for every node of links (a, b), however long the ways are.

    Each round hooks every node to the smallest of itself and its neighbours and contracts the links to the hooks, until
    no link is left. The order is the nodes' own at first and a new random one in each later round, so that chains of any
    numbering shrink by a constant factor: rounds grow with the logarithm of a class's size.
    """
    ways = staged(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "ways")
    hooks = []
    while True:
        if hooks:
            place = lambda c: F.struct(F.xxhash64(c, F.lit(len(hooks))).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
            low = F.least(F.min(place("b")), F.first(place("a")))["x"]
        else:
            low = F.least(F.min("b"), F.first("a"))
        hook = staged(ways.groupBy(F.col("a").alias("node")).agg(low.alias("comp")), "hook")
        hooks.append(hook)
        ends = ways.join(hook.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(hook.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
        rest = staged(ends.where("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct(), "ways")
        unstage(ways)
        ways = rest
        if not ways.limit(1).count():
            break
    unstage(ways)
    if len(hooks) == 1:
        return hooks[0]
    label = hooks[-1]
    for hook in reversed(hooks[:-1]):  # the later, the fewer nodes
        label = hook.join(label.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    label = staged(label, "label")
    least = label.groupBy("comp").agg(F.min("node").alias("least"))
    out = staged(label.join(least, "comp").select("node", F.col("least").alias("comp")), "label")
    unstage(label, *hooks)
    return out


#: Members of a block and elements of all of them together, about; pairs of two blocks are looked at in one go. Elements at a time.
BLOCK_MEMBERS, BLOCK_SUM, BLOCK_ELEMENTS = 256, 2_000_000, 8192


def shared_elements(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """len(x) x len(y) sizes of the intersections of sets (arrays of distinct numbers)."""
    out = np.zeros((len(x), len(y)), np.float64)
    flat = [np.concatenate(sets) for sets in (x, y)]
    row = [np.repeat(np.arange(len(sets)), [len(e) for e in sets]) for sets in (x, y)]
    both = np.intersect1d(*flat)
    place = [np.minimum(np.searchsorted(both, e), max(0, len(both) - 1)) for e in flat]
    order = []
    for i in range(2):
        known = both[place[i]] == flat[i] if len(both) else np.zeros(0, bool)
        at, of = place[i][: len(known)][known], row[i][: len(known)][known]
        by = np.argsort(at, kind="stable")
        order.append((at[by], of[by]))
    for low in range(0, len(both), BLOCK_ELEMENTS):
        hot = []
        for (at, of), n in zip(order, out.shape, strict=True):
            part = slice(*np.searchsorted(at, [low, low + BLOCK_ELEMENTS]))
            m = np.zeros((n, BLOCK_ELEMENTS), np.float32)
            m[of[part], at[part] - low] = 1
            hot.append(m)
        out += hot[0] @ hot[1].T
    return out


def crowded(open_: DataFrame, nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The links (a, b) among all pairs of members of different classes in each bucket: open_ has band, node and comp.

    A bucket's members are dealt into blocks, and every two blocks meet in a group of their own. A pair that shares several
    buckets is compared in the first of its bands only.
    """
    sized = open_.join(nodes.select("node", "bands", "size"), "node")
    blocks = F.col("blocks")
    need = sized.groupBy("band").agg(F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum("size") / BLOCK_SUM)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node", F.lit(7)), blocks).cast("int")
    full = sized.join(need, "band").join(sets.select("node", "x"), "node")
    other = full.select("*", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("with"))
    met = other.select("band", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "comp", "bands", "x")

    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        band, i, j = (k.as_py() for k in key)
        own = t.column("own").to_numpy()
        sides = [np.flatnonzero(own == i), np.flatnonzero(own == j)]
        node, comp = t.column("node").to_numpy(), t.column("comp").to_numpy()
        bands = np.array(t.column("bands").to_pylist(), np.int64)
        a, b = [], []
        if len(sides[0]) and len(sides[1]) and comp.min() != comp.max():
            wanted = comp[sides[0]][:, None] != comp[sides[1]][None, :]
            if i == j:
                wanted &= node[sides[0]][:, None] < node[sides[1]][None, :]
            for k in range(int(np.flatnonzero(bands[0] == band)[0])):  # met in an earlier band
                wanted &= bands[sides[0], k][:, None] != bands[sides[1], k][None, :]
            if wanted.any():
                x = [[np.frombuffer(e, "<u8") for e in t.column("x").take(pa.array(side)).to_pylist()] for side in sides]
                common = shared_elements(*x)
                size = [np.array([len(e) for e in side]) for side in x]
                hit = wanted & (common >= least * (size[0][:, None] + size[1][None, :] - common) - 1e-9)
                p, q = np.nonzero(hit)
                a, b = node[sides[0]][p], node[sides[1]][q]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return met.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (node, comp) after more links: only the classes that these touch are worked on."""
    of = lambda x, c: comp.select(F.col("node").alias(x), F.col("comp").alias(c))
    ends = links.join(of("a", "ca"), "a", "left").join(of("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    more = components(ends.where("a != b"))
    old = comp.join(more.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return staged(old.unionByName(more.join(comp.select("node"), "node", "left_anti").select("node", "comp")), "comp")


def classes(docs: DataFrame, least: float = 0.8, weigh: str = "set", bands: int = BANDS, rows: int = ROWS, small: int = 16) -> tuple[DataFrame, int]:
    """Table of node, comp (its class), class_id (smallest doc_id of the class), class_size; and the salt that makes nodes of texts.

    Members of a bucket are first compared with one of them, the same for all buckets of a class. Where a bucket then
    still holds several classes, up to `small` members are all compared with one another, and more of them with the
    member that has most links. What is mixed even then compares all its members of different classes, in blocks. So
    every two texts that share a bucket end in one class or have been compared, whatever the sizes of buckets.
    """
    ready(docs.sparkSession)
    signed = staged(banded(docs, weigh, bands, rows).groupBy("full").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("size", True).alias("size"), F.first("bands", True).alias("bands")), "signed")
    salt = 0
    while signed.groupBy(F.xxhash64("full", F.lit(salt))).count().where("count > 1").limit(1).count():
        salt += 1  # two texts with one id: take other ids
    nodes = signed.select(F.xxhash64("full", F.lit(salt)).alias("node"), "first", "copies", "size", "bands")
    bucket = nodes.select("node", F.explode("bands").alias("band"))
    several = bucket.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    multi = staged(bucket.join(several, "band"), "multi")
    sets = staged(element_sets(docs, multi.select("node").distinct(), salt), "sets")
    pair = lambda df, x, y: df.where(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    tried = staged(pair(multi, "node", "hub"), "tried")
    links = staged(verified(tried, sets, least), "links")
    comp = components(links)

    def mixed(hub: Column, extra: DataFrame | None = None) -> DataFrame:
        """Members with their present class, of the buckets that hold more than one; and a hub for each."""
        now = multi.join(comp, "node", "left").select("band", "node", "n", F.col("hub").alias("hub0"), F.coalesce("comp", "node").alias("comp"))
        now = now if extra is None else now.join(extra, "node", "left")
        several = now.groupBy("band").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), hub.alias("hub")).where("c0 != c1").select("band", "hub")
        return staged(now.select("band", "node", "n", "comp").join(several, "band"), "open")

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    rank = F.struct(F.col("node") == F.col("hub0"), -F.coalesce("d", F.lit(0)), "node")
    open_ = mixed(F.min_by("node", rank), degree)
    few = open_.where(F.col("n") <= small)
    other = few.select("band", F.col("node").alias("hub2"), F.col("comp").alias("comp2"))
    close = pair(few.join(other, "band").where("node < hub2 and comp != comp2"), "node", "hub2")
    wide = pair(open_.where(F.col("n") > small), "node", "hub")
    found = staged(verified(close.union(wide).distinct().join(tried, ["a", "b"], "left_anti"), sets, least), "found")
    if found.limit(1).count():
        comp = joined(comp, found)
    left = mixed(F.min("node")).where(F.col("n") > small)
    if left.limit(1).count():
        more = staged(crowded(left, nodes, sets, least), "found")
        if more.limit(1).count():
            comp = joined(comp, more)
    of = nodes.join(comp, "node", "left").select("node", "first", "copies", F.coalesce("comp", "node").alias("comp"))
    named = of.groupBy("comp").agg(F.min("first").alias("class_id"), F.sum("copies").alias("class_size"))
    out = staged(of.join(named, "comp").select("node", "comp", "class_id", "class_size"), "classes")
    unstage(signed, multi, sets, tried, links, open_, found, left)
    return out, salt


def duplicate_classes(docs: DataFrame, **settings: object) -> DataFrame:
    """doc_id, class_id (smallest doc_id of its class), class_size of every document.

    Equal texts share a class, and so do texts linked by similar ones. Null texts are classes of their own; texts
    without a word, the empty one among them, join equal texts only; very long texts are taken whole. Rows with a null
    doc_id count as members but name a class only if all are null. A similarity of exactly 0.8 counts. Repeated rows get
    a row each; an empty table gives an empty result; extra columns are ignored.
    """
    d = docs.select("doc_id", "text")
    table, salt = classes(d, **settings)
    named = d.select("doc_id", text_node(F.col("text"), salt).alias("node")).join(table, "node", "left")
    return named.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def keep_first(docs: DataFrame, **settings: object) -> DataFrame:
    """The rows of docs, unchanged: of each class the one with the smallest doc_id, and all null texts.

    Where ids repeat or are null, so that the smallest is no single row, any one row of the class stays. Empty and
    wordless texts are classes of equal texts; all columns come back, whatever their names; no rows give no rows.
    """
    table, salt = classes(docs.select("doc_id", "text"), **settings)
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").alias("_id"), text_node(F.col("text"), salt).alias("node"))
    kept = rows.join(table, "node", "left").where(F.col("node").isNull() | F.col("_id").eqNullSafe(F.col("class_id")))
    unclear = docs.where("text is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if unclear:  # repeated or null ids: one row of each class by its content
        own = kept.where("node is null").select("row")
        kept = own.union(kept.where("node is not null").dropDuplicates(["comp"]).select("row"))
    return kept.select("row.*")
