"""Exact encoding and decoding with a SentencePiece merge-type (BPE) model, without the library's encoder.

A text is cut where no vocabulary piece can span, and each part is encoded by backtracking: take the longest piece at
the position (Aho-Corasick matches), accept it if merging the two neighbouring tokens' characters again keeps their
border, else try its next shorter prefix, and step back when nothing fits; a bitfield remembers positions from which
no encoding goes on. Merges of equal score (runs of blanks) go by place, the left one first, in the pair checks as well.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ._common import ready

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # piece types, fixed by the model format
#: Encoded parts that a worker keeps in each of two generations, and a third of the token pairs that it keeps.
CACHE = 100_000


@dataclass
class Tables:
    """What a worker needs of a model; made once, on the driver."""

    pieces: list[str]
    kinds: list[int]
    scores: list[float]
    dummy_prefix: bool
    bos: int
    eos: int
    unk: int
    splits: dict[int, tuple[str, str]] = field(default_factory=dict)  #: last merge of each piece that merging can make
    joiners: str = ""  #: word characters that a piece can have before a mark


def load(path: str) -> Tables:
    """Read a model file. Only BPE models with an identity normaliser and byte fallback are supported."""
    from sentencepiece import sentencepiece_model_pb2 as model_pb2

    proto = model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    norm, spec = proto.normalizer_spec, proto.trainer_spec
    kinds = [p.type for p in proto.pieces]
    if spec.model_type != 2 or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or spec.treat_whitespace_as_suffix or {*kinds} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
        raise ValueError("only BPE models with byte fallback, an identity normaliser and no own symbols are supported")
    t = Tables([p.piece for p in proto.pieces], kinds, [p.score for p in proto.pieces], norm.add_dummy_prefix, spec.bos_id, spec.eos_id, spec.unk_id)
    rank = ranks(t)
    for piece, i in rank.items():
        if len(piece) > 1:
            last: list[tuple[str, str]] = []
            if merged(piece, t, rank, last) == [piece]:
                t.splits[i] = last[-1]
    seen = {(a, b) for p in rank for a, b in zip(p, p[1:], strict=False)}
    if any(a != SPACE and b == SPACE for a, b in seen):
        raise ValueError("a piece with a blank after another character")
    t.joiners = "".join(sorted({a for a, b in seen if re.match(r"\w", a) and not re.match(r"\w", b)}))
    return t


def ranks(t: Tables) -> dict[str, int]:
    return {p: i for i, (p, k) in enumerate(zip(t.pieces, t.kinds, strict=True)) if k == NORMAL}


def merged(text: str, t: Tables, ids: dict[str, int], log: list[tuple[str, str]] | None = None) -> list[str]:
    """Symbols left when adjacent ones whose union is a piece are merged, best score first, then leftmost."""
    part, after, before = list(text), list(range(1, len(text) + 1)), list(range(-1, len(text) - 1))
    heap: list[tuple[float, int, str, str]] = []

    def offer(i: int) -> None:
        j = after[i]
        if j < len(part) and (k := ids.get(part[i] + part[j])) is not None:
            heapq.heappush(heap, (-t.scores[k], i, part[i], part[j]))

    for i in range(len(part) - 1):
        offer(i)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if part[i] != a or j >= len(part) or part[j] != b:
            continue
        part[i], part[j], after[i] = a + b, "", after[j]
        if after[j] < len(part):
            before[after[j]] = i
        if log is not None:
            log.append((a, b))
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return [p for p in part if p]


class Coder:
    """Encodes and decodes whole texts; keeps a bounded memory of parts and token pairs."""

    def __init__(self, t: Tables) -> None:
        self.t, self.ids = t, ranks(t)
        self.byte = {int(p[1:-1], 16): i for i, (p, k) in enumerate(zip(t.pieces, t.kinds, strict=True)) if k == BYTE}
        self.find = ahocorasick.Automaton()
        self.reach = {p: i for p, i in self.ids.items() if len(p) == 1 or i in t.splits}
        for p, i in self.reach.items():
            self.find.add_word(p, (len(p), i))
        self.find.make_automaton()
        self.length = [len(p) for p in t.pieces]
        self.shorter: dict[int, int] = {}
        for p, i in self.reach.items():
            for n in range(len(p) - 1, 0, -1):
                if (k := self.reach.get(p[:n])) is not None:
                    self.shorter[i] = k
                    break
        self.right: dict[int, list] = {}
        self.left: dict[int, list] = {}
        self.alphabet = frozenset(p for p in self.ids if len(p) == 1)
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        # blanks, marks, then word characters: no piece spans the end of such a part, nor a line end that is no piece
        join = re.escape(t.joiners)
        line = "" if "\n" in self.ids else r"\n"
        marks = rf"(?:[^\w{SPACE}{line}]" + (rf"|[{join}])*" if join else ")*")
        self.cut = re.compile(rf"{SPACE}*{marks}[^\W{join}]*" + (r"|\n" if line else ""))
        self.text = [("" if k == CONTROL else p.replace(SPACE, " ")) for p, k in zip(t.pieces, t.kinds, strict=True)]
        self.high = np.zeros(len(t.pieces), bool)
        for b, i in self.byte.items():
            self.text[i] = chr(b)
            self.high[i] = b >= 128
        if t.unk >= 0:
            self.text[t.unk] = " ⁇ "
        self.value = {i: b for b, i in self.byte.items()}

    def spine(self, token: int, side: int) -> list[tuple[str, float]]:
        """The symbols that stand at the token's right (1) or left (0) end as it is merged, and when each is used up."""
        known = (self.left, self.right)[side]
        if token not in known:
            out, now, used = [], token, float("inf")
            while True:
                out.append((self.t.pieces[now], used))
                if now not in self.t.splits:
                    break
                used = -self.t.scores[now]
                now = self.ids[self.t.splits[now][side]]
            known[token] = out[::-1]
        return known[token]

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the characters of tokens a and b again leaves exactly a and b.

        Symbols x of a and y of b meet at the border. Their union is merged if its turn comes before x and before y are
        used up inside their tokens; of equal scores the left place goes first: a's own merge before the border's, and
        the border's before b's.
        """
        key = a * len(self.length) + b
        known = self.pairs.get(key)
        if known is None:
            r, n, i, j, known = self.spine(a, 1), self.spine(b, 0), 0, 0, True
            while True:
                (x, until_x), (y, until_y) = r[i], n[j]
                k = self.ids.get(x + y)
                if k is not None and -self.t.scores[k] < until_x and -self.t.scores[k] <= until_y:
                    known = False
                    break
                if i + 1 == len(r) and j + 1 == len(n):
                    break
                if until_x <= until_y:
                    i += 1
                else:
                    j += 1
            if len(self.pairs) >= 3 * CACHE:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def backtrack(self, s: str) -> list[int]:
        """Tokens of s, all of whose characters are pieces."""
        size, length, shorter, pairs, base = len(s), self.length, self.shorter, self.pairs, len(self.length)
        longest = [0] * size
        for end, (n, i) in self.find.iter(s):
            longest[end - n + 1] = i
        out: list[int] = []
        failed, at, token, last = 0, 0, longest[0], -1
        while True:
            end = at + length[token]
            good = not failed >> end & 1
            if good and last >= 0:
                good = pairs.get(last * base + token)
                if good is None:
                    good = self.fits(last, token)
            if good:
                out.append(token)
                if end == size:
                    return out
                at, last, token = end, token, longest[end]
            elif token in shorter:
                token = shorter[token]
            else:
                failed |= 1 << at
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def part(self, s: str) -> bytes:
        if self.alphabet.issuperset(s):
            return array("I", self.backtrack(s)).tobytes()
        out: list[int] = []
        at = 0
        for i, c in enumerate(s):
            if c not in self.ids:
                if at < i:
                    out += self.backtrack(s[at:i])
                out += [self.byte[b] for b in c.encode()]
                at = i + 1
        if at < len(s):
            out += self.backtrack(s[at:])
        return array("I", out).tobytes()

    def encode(self, text: str) -> np.ndarray:
        """Token ids of the whole text with the begin and end ids."""
        s = text.replace(" ", SPACE)
        if s and self.t.dummy_prefix:
            s = SPACE + s
        units = self.cut.findall(s)
        parts = self.parts
        try:
            body = b"".join([parts[u] for u in units])
        except KeyError:
            if len(parts) >= CACHE:  # what was used since stays, the rest goes the next time
                self.older, self.parts = parts, {}
                parts, older = self.parts, self.older
            else:
                older = self.older
            for u in units:
                if u not in parts:
                    code = older.get(u)
                    parts[u] = (self.part(u) if u else b"") if code is None else code
            body = b"".join([parts[u] for u in units])
        return np.concatenate([[self.t.bos], np.frombuffer(body, "<u4"), [self.t.eos]]).astype("<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of any ids: control ids vanish, bytes that are no UTF-8 become U+FFFD one by one."""
        if not self.high[ids].any():
            out = "".join([self.text[i] for i in ids.tolist()])
        else:
            done, run = [], bytearray()
            for i in ids.tolist():
                if i in self.value:
                    run.append(self.value[i])
                else:
                    if run:
                        done.append(utf8(run))
                        run = bytearray()
                    done.append(self.text[i])
            out = "".join([*done, utf8(run)])
        first = next((i for i in ids.tolist() if self.t.kinds[i] != CONTROL), None)
        if self.t.dummy_prefix and first is not None and self.t.kinds[first] == NORMAL and self.t.pieces[first].startswith(SPACE):
            out = out[1:]
        return out


def utf8(run: bytearray) -> str:
    out, at = [], 0
    while at < len(run):
        for n in (1, 2, 3, 4):
            try:
                out.append(run[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


_CODERS: dict[str, Coder] = {}


def coder(t: Tables, key: str) -> Coder:
    """The worker's coder for a model, kept from task to task."""
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(t)
    return _CODERS[key]


def tokenised(docs: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """Columns keep, ids (array of token ids), decoded. Null texts count as empty: begin and end ids, and ''."""
    spark = docs.sparkSession
    ready(spark)
    t = load(model)
    key = hashlib.sha256(repr((t.pieces, t.scores)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(t)  # the vocabulary: its size does not depend on the input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value, key)
        for b in batches:
            ids = [c.encode(x or "") for x in b.column("text").to_pylist()]
            text = [c.decode(x) for x in ids]
            flat = np.concatenate([np.zeros(0, "<i4"), *ids]).astype("<i4")
            cut = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype("<i4")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat)), pa.array(text, pa.string())], names=[*keep, "ids", "decoded"])

    schema = StructType([StructField(k, docs.schema[k].dataType) for k in keep]).add("ids", ArrayType(IntegerType())).add("decoded", "string")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def digests(docs: DataFrame, model: str, keep: list[str]) -> DataFrame:
    """Columns keep, n_tokens, ids_sha256, decoded_sha256: what tokenised() gives, as digests, without moving the ids."""
    spark = docs.sparkSession
    ready(spark)
    t = load(model)
    key = hashlib.sha256(repr((t.pieces, t.scores)).encode()).hexdigest()
    shared = spark.sparkContext.broadcast(t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = coder(shared.value, key)
        for b in batches:
            n, a, d = [], [], []
            for x in b.column("text").to_pylist():
                ids = c.encode(x or "")
                n.append(len(ids))
                a.append(hashlib.sha256(ids.tobytes()).hexdigest())
                d.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = StructType([StructField(k, docs.schema[k].dataType) for k in keep]).add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def token_digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document.

    Null texts count as empty: begin and end ids, and the empty text. Very long texts are encoded whole, part by part.
    Merges of equal score go by place, so ties have one result. Repeated rows get a row each; extra columns are ignored;
    no rows give no rows.
    """
    return digests(docs.select(F.col("doc_id"), F.col("text")), model, ["doc_id"])
