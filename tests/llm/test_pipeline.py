import hashlib
import os

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from braidgraph.llm import langid, mixing, neardup, pii
from braidgraph.llm._common import work_dir


def test_stages_and_run(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    kept = corpus_pipeline.language(spark, docs, sf)
    assert kept.columns == names and kept.count() == langid.language_of(docs).where("not rejected").count()
    first = corpus_pipeline.near_duplicates(spark, kept, sf)
    assert first.columns == names and first.count() == neardup.duplicate_classes(kept).select("class_id").distinct().count()
    clean = corpus_pipeline.personal_data(spark, first, sf)
    assert clean.columns == names and clean.count() == first.count()
    mixed = corpus_pipeline.mixing_weights(spark, clean, sf)
    assert mixed.columns == names and mixed.count() == mixing.mix(clean).agg(F.sum("copies")).first()[0]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for r in mixed.collect():
        ids = lib.encode(r.text, add_bos=True, add_eos=True)
        want.append((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()))
    got = [(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()]
    assert sorted(got) == sorted(want)


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{i}_" for i in range(1, 11)} <= {n[: n.index("_") + 1] for n in names if n.startswith("op")} and "pipeline" in names
    assert pii.KINDS and [s for s, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "personal_data", "mixing", "tokens"]


def test_odd(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == odd.columns
    assert corpus_pipeline.tokens(spark, docs, "").count() == docs.count()


def files(path):
    return sum(len(names) for _, _, names in os.walk(path))


def test_empty_tables(spark, none, tmp_path):
    docs = none
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == none.columns and docs.count() == 0
    assert corpus_pipeline.tokens(spark, docs, "").count() == 0
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_odd_rows_leaves_one_table(spark, odd, tmp_path):
    """Nulls, repeated rows and clashing names through run(); of what it wrote, only the last stage's input stays."""
    odd.withColumnRenamed("a b", "ab").write.parquet(f"{tmp_path}/documents.parquet")
    work = work_dir(spark)
    before = set(os.listdir(work))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids_sha256", "decoded_sha256"] and got.count() > 0
    left = [f"{work}/{x}" for x in set(os.listdir(work)) - before if files(f"{work}/{x}")]
    assert len(left) == 1 and os.listdir(left[0]) == ["mixing"]
