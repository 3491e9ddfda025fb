"""Whole texts as numpy arrays: tokens, hashes and n-grams of many texts at once."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

#: Characters and texts handled in one go; a longer text is a chunk of its own.
CHUNK_CHARS, CHUNK_TEXTS = 600_000, 4096
_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = np.array([0, 0x51ED270B7A3C1F4D, 0x2545F4914F6CDD1D, 0x6C62272E07BB0142], np.uint64)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x + _MUL
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def classes() -> np.ndarray:
    """By code point: 0 blank or control, 1 letter, 2 digit, 3 anything else."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x110000):
        c = chr(i)
        out[i] = 1 if c.isalpha() else 2 if c.isdigit() or c.isnumeric() else 0 if c.isspace() or i < 32 else 3
    return out


def chunks(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """(first index, texts) of about CHUNK_CHARS and at most CHUNK_TEXTS each; null becomes the empty text."""
    first, size, part = 0, 0, []
    for i, t in enumerate(texts):
        t = t or ""
        if part and (size + len(t) > CHUNK_CHARS or len(part) == CHUNK_TEXTS):
            yield first, part
            first, size, part = i, 0, []
        part.append(t)
        size += len(t) + 1
    if part:
        yield first, part


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case, each followed by a blank, and where each ends."""
    low = [t.lower() for t in texts]
    ends = np.cumsum([len(t) + 1 for t in low])
    return np.frombuffer(("\n".join(low) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32), ends


#: Lengths of word beginnings that count as features of their own.
STEMS = (4, 5)


def tokens(texts: list[str], words_only: bool = False, stems: bool = False) -> tuple[np.ndarray, ...]:
    """Hash and text index of each token, in order: runs of letters and digits, and (unless words_only) of other marks.

    With stems also the hashes and text indices of the tokens' beginnings.
    """
    code, ends = joined(texts)
    kind = classes()[code]
    kind[kind == 2] = 1
    if words_only:
        kind[kind == 3] = 0
    edge = np.flatnonzero(np.diff(kind, prepend=np.uint8(0)) != 0)
    if not len(edge):
        none = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        return (*none, *none) if stems else none
    first = edge[0]
    length = np.diff(edge, append=len(code))
    at = np.arange(first, len(code)) - np.repeat(edge, length)
    power = np.full(int(length.max()) + 1, np.uint64(0x100000001B3), np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    value = (code[first:].astype(np.uint64) + np.uint64(1)) * power[at]
    whole = np.add.reduceat(value, edge - first)
    keep = kind[edge] != 0
    doc = np.searchsorted(ends, edge[keep], side="right")
    if not stems:
        return mix64(whole[keep]), doc
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    begin, h, d = edge[keep] - first, [], []
    for n in STEMS:
        long = length[keep] > n
        h.append(mix64(total[begin[long] + n] - total[begin[long]] + np.uint64(n)))
        d.append(doc[long])
    return mix64(whole[keep]), doc, np.concatenate(h), np.concatenate(d)


def indicators(texts: list[str], bits: int, pairs: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(text index, feature) of the distinct hashed tokens and word beginnings of each text, sorted.

    With pairs also those of token pairs, and of how large a share of the tokens repeats the one before and of the
    pairs occurred before in the text, in eighths.
    """
    h, doc, stem, stem_doc = tokens(texts, stems=True)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    shift = np.uint64(64 - bits)
    docs, feats = [doc, stem_doc], [h >> shift, stem >> shift]
    if pairs:
        same = doc[1:] == doc[:-1]
        pair, pair_doc = mix64(h[:-1] * np.uint64(3) + h[1:])[same], doc[1:][same]
        again = np.bincount(pair_doc, (h[1:] == h[:-1])[same], minlength=len(texts))
        order = np.lexsort((pair, pair_doc))
        fresh = np.diff(pair[order], prepend=pair[order[:1]] + np.uint64(1)) != 0
        new = np.bincount(pair_doc[order], fresh | (np.diff(pair_doc[order], prepend=-1) != 0), minlength=len(texts))
        n = np.bincount(pair_doc, minlength=len(texts))
        some = np.flatnonzero(n)
        docs += [pair_doc, some, some]
        feats += [pair >> shift] + [mix64(np.uint64(seed) + np.ceil(8 * share[some] / n[some]).astype(np.uint64)) >> shift for seed, share in ((1000, again), (2000, n - new))]
    key = np.unique((np.concatenate(docs) << bits) | np.concatenate(feats).astype(np.int64))
    return key >> bits, key & ((1 << bits) - 1)


def letter_grams(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, feature) of the hashed runs of 1 to 3 letters, blanks at word ends counted, and each text's letters."""
    code, ends = joined(texts)
    letter = classes()[code] == 1
    keep = letter | np.concatenate([[True], letter[:-1]])
    doc = np.searchsorted(ends, np.flatnonzero(keep), side="right")
    c = np.where(letter, code, np.uint32(32))[keep].astype(np.uint64)
    n_letters = np.bincount(np.searchsorted(ends, np.flatnonzero(letter), side="right"), minlength=len(texts))
    docs, feats, shift = [], [], np.uint64(64 - bits)
    for n in (1, 2, 3):
        if len(c) < n:
            continue
        h = np.zeros(len(c) - n + 1, np.uint64)
        for j in range(n):
            h = h * np.uint64(0x1000193) + c[j : len(c) - n + 1 + j] + np.uint64(1)
        ok = doc[: len(h)] == doc[n - 1 :]
        docs.append(doc[: len(h)][ok])
        feats.append((mix64(h[ok] ^ _SEEDS[n]) >> shift).astype(np.int64))
    return np.concatenate(docs or [doc]), np.concatenate(feats or [doc]), n_letters
