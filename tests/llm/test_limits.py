"""Very long texts, bounded memories, and the pipeline on odd tables."""

from __future__ import annotations

import hashlib
import random
import tracemalloc
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, normalizers

import corpus_pipeline
from tamis import shared
from tamis.llm import bpe, near_dup, quality, secret_scan, shingles, token_count
from tests.llm.conftest import prose

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def test_encoder_forgets_but_never_errs():
    with open(RANKS, "rb") as file:
        vocabulary = bpe.Vocabulary(file.read(), public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(4000)}q{rng.choice('xyz')}" for _ in range(200)) for _ in range(60)]
    exact = bpe.Encoder(vocabulary).encode(texts)
    small = bpe.Encoder(vocabulary, most_bytes=20_000)
    for text, ids in zip(texts, exact, strict=True):
        assert small.encode([text]) == [ids]
        assert len(small.young) + len(small.old) < 600
    small.forget()
    assert not small.young and not small.old and small.held == 0
    assert vocabulary.decode(exact[0]).decode() == texts[0]


def test_counter_forgets_but_never_errs():
    pieces = token_count.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    exact, small = token_count.Counter(pieces), token_count.Counter(pieces, most_bytes=10_000)
    for i in range(50):
        text = prose(80, i) + f" odd{i}word"
        assert small.count(text) == exact.count(text) and len(small.solved) < 200
    with pytest.raises(ValueError, match="no ▁"):
        token_count.Counter([("a", -1.0), ("<unk>", 0.0)])


def test_token_counts_of_a_very_long_text(spark):
    pieces = token_count.read_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    exact = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=True))
    exact.normalizer = normalizers.Sequence([normalizers.Prepend("▁"), normalizers.Replace(" ", "▁")])
    texts = [prose(60_000, 1), "x" * 20_000, " " * 20_000 + "é" * 5000]
    found = {r.doc_id: r.n_tokens for r in token_count.token_counts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), pieces).collect()}
    assert found == {i: len(exact.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_word_hashes_follow_words_not_bytes():
    text = b"a lengthy passage of plain words " * 200_000  # 6.6 MB
    shingles.word_hashes([text[:1000]])
    tracemalloc.start()
    shingles.word_hashes([text])
    _, most = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert most < 20 * len(text)
    whole, of = shingles.word_hashes([text[: 1 << 18], b"x" * 200_000, b"word"])
    parts = [shingles.word_hashes([t])[0] for t in (text[: 1 << 18], b"x" * 200_000, b"word")]
    assert [len(p) for p in parts] == [int((of == i).sum()) for i in range(3)] and whole.tolist() == [h for p in parts for h in p.tolist()]


def test_shared_folder_is_asked_for_off_local_masters():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = {}

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        shared.shared_dir(Session())


def test_near_duplicates_leave_nothing_but_their_result(spark, known_docs):
    kept = []
    plain, near_dup.materialise = near_dup.materialise, lambda df, label: kept.append(plain(df, label)) or kept[-1]
    try:
        out = near_dup.near_duplicates(known_docs)
    finally:
        near_dup.materialise = plain
    sc = spark.sparkContext
    there = [df.tamis_path for df in kept if sc._jvm.org.apache.hadoop.fs.Path(df.tamis_path).getFileSystem(sc._jsc.hadoopConfiguration()).exists(sc._jvm.org.apache.hadoop.fs.Path(df.tamis_path))]
    assert there == [out.tamis_path]


def test_anti_join_beyond_the_broadcast(known_docs, monkeypatch):
    wanted = sorted(r.doc_id for r in near_dup.keep_firsts(known_docs).collect())
    monkeypatch.setattr(near_dup, "MOST_BROADCAST", 0)
    assert sorted(r.doc_id for r in near_dup.keep_firsts(known_docs).collect()) == wanted


# -- pipeline -------------------------------------------------------------------


def _written(docs, folder):
    docs.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_pipeline_on_odd_rows_and_clashing_columns(spark, edge_docs, tmp_path):
    extra = {c: F.lit(7) for c in ("gone", "id", "hash", "times", "time", "n_tokens", "ids", "kept", "range")}
    long_ = spark.createDataFrame([(500 + i, prose(40_000, 50 + i), "en", "b") for i in range(2)], "doc_id long, text string, lang string, source string")
    many = spark.createDataFrame([(600 + i, prose(150, 70 + i % 9) + f" end{i}", None, None) for i in range(40)], "doc_id long, text string, lang string, source string")
    columns = ["doc_id", "text", "lang", "source"]
    docs = edge_docs.select(columns).unionByName(long_).unionByName(many).withColumn("n_chars", F.length("text").cast("long")).withColumns(extra)
    out = corpus_pipeline.run(spark, _written(docs, str(tmp_path))).collect()
    assert out and len(out[0].ids) == out[0].n_tokens
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    good = {(r.doc_id, hashlib.sha256(secret_scan.masked(r.text).encode()).hexdigest()) for r in quality.keep_good(frame).collect()}
    assert {(r.doc_id, r.decoded_sha256) for r in out} <= good
    assert max(Counter((r.doc_id, r.decoded_sha256) for r in out).values()) <= 3 * 4  # four rows without an id may share a text
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, frame, str(tmp_path)).columns == frame.columns, name


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.run(spark, _written(docs, str(tmp_path / "none"))).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None), (1, "", None, None, 0), (1, "", None, None, 0)], docs.schema)
    assert corpus_pipeline.run(spark, _written(nulls, str(tmp_path / "nulls"))).count() == 0
