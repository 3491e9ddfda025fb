import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from braidgraph.llm import sp_encode

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return sp_encode.Coder(sp_encode.load(PATH)), sentencepiece.SentencePieceProcessor(model_file=PATH)


def same(both, text):
    ours, lib = both
    ids = lib.encode(text, add_bos=True, add_eos=True)
    assert ours.encode(text).tolist() == ids, text[:80]
    assert ours.decode(np.array(ids)) == lib.decode(ids), text[:80]


def test_odd_texts(both):
    for t in ["", " ", "  ", "   a   b", "a\nb\t", "　x ñ", "…\x00😀", "▁a ▁▁ b▁", "\r\n\r\n", "é", "ab" * 4000, " " * 9000 + "x", "a" * 9000, "l'été can't 1,234.5 http://x.y/z_a?b=c", "²._+", "�​"]:
        same(both, t)


def test_random_texts(both):
    rnd = random.Random(11)
    pieces = both[0].t.pieces
    for _ in range(1500):
        same(both, "".join(rnd.choice("abcdefghi  \n.,'\"()[]{}<>/_-=+*&^%$#@!0123éñ漢字😀tion theing") for _ in range(rnd.randint(1, 60))))
        same(both, "".join(rnd.choice(pieces[259:]) for _ in range(rnd.randint(1, 8))).replace("▁", rnd.choice([" ", "▁"])))


def test_runs_of_blanks(both):
    """Blank pieces have equal scores, so their merges go by place."""
    for n in [*range(70), 1000, 50_001]:
        same(both, " " * n)
        same(both, "x" + " " * n + "the")
    rnd = random.Random(14)
    for _ in range(3000):
        same(both, "".join(rnd.choice(["a", "the", "x", ".", "\n", "=", "é", "😀", " " * rnd.randint(1, 40), " "]) for _ in range(rnd.randint(1, 25))))


def test_any_ids_decode(both):
    rnd = random.Random(12)
    for _ in range(1500):
        ids = [rnd.randrange(32000) if rnd.random() < 0.5 else rnd.randrange(3, 259) for _ in range(rnd.randint(1, 12))]
        assert both[0].decode(np.array(ids)) == both[1].decode(ids)


def test_documents(both, documents):
    texts = {r.doc_id: r.text for r in documents.collect()}
    for r in sp_encode.token_digests(documents, PATH).collect():
        ids = both[1].encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(both[1].decode(ids).encode()).hexdigest()


def test_pair_check_is_remerging(both):
    """Two tokens fit exactly if merging their characters gives them back."""
    ours = both[0]
    rnd = random.Random(13)
    usable = [*ours.reach.values()]
    for _ in range(3000):
        a, b = rnd.choice(usable), rnd.choice(usable)
        x, y = ours.t.pieces[a], ours.t.pieces[b]
        assert ours.fits(a, b) == (sp_encode.merged(x + y, ours.t, ours.ids) == [x, y]), (x, y)
    blanks = [i for p, i in ours.reach.items() if "▁▁" in p]
    for a in blanks:
        for b in [*blanks, *rnd.sample(usable, 200)]:
            x, y = ours.t.pieces[a], ours.t.pieces[b]
            assert ours.fits(a, b) == (sp_encode.merged(x + y, ours.t, ours.ids) == [x, y]), (x, y)


def test_odd(odd, none):
    rows = {r.doc_id: r for r in sp_encode.tokenised(odd, PATH, ["doc_id"]).collect()}
    assert rows[2].ids == rows[3].ids == [1, 2] and rows[2].decoded == ""
    assert rows[8].decoded == "x" and len(rows[4].ids) > 30_000
    assert sp_encode.token_digests(odd, PATH).count() == odd.count() and sp_encode.token_digests(none, PATH).count() == 0
