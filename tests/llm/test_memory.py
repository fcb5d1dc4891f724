"""What bounds the memory of the pipeline's tasks and of its driver."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from watchloom.llm import language, mixing, near_dedup, textops


@pytest.mark.parametrize("stage", ["language", "near_dedup", "decontaminate", "packing"])
def test_batches_of_the_pipeline_are_bounded_by_bytes(spark, sf_dir, stage):
    import corpus_pipeline as P

    def nbytes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], names=["n"])

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    docs = spark.range(0, 200, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 10_000).alias("text"), F.lit("en").alias("lang"))
    try:
        dict(P.STAGES)[stage](spark, docs.limit(3), sf_dir)
        most = docs.mapInArrow(nbytes, "n long").agg(F.max("n")).first()[0]
    finally:
        spark.conf.unset(key)
    assert most <= textops.BATCH_BYTES + 200_000 < 20_000_000


def test_language_keeps_its_sample_packed_in_the_driver(spark):
    r = random.Random(3)
    letters = [chr(i) for i in range(0x100, 0x240) if chr(i).islower()]
    texts = ["".join(r.choices(letters, k=20_000)) for _ in range(200)]
    docs = spark.createDataFrame([(i, "ab"[i % 2], t) for i, t in enumerate(texts)], "doc_id long, lang string, text string").repartition(4)
    grams = sum(len(language.term_counts(t)[0]) for t in texts)
    tracemalloc.start()
    try:
        language.fit(docs)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert most < 8 * grams, f"{most / grams:.1f} bytes for each n-gram of the sample"


def test_language_unpacks_what_it_packed():
    for text in ["a", "Ein kurzer Text.", "x" * 70_000, "".join(chr(i) for i in range(0x61, 0x3000))]:
        at, n = language.term_counts(text)
        got = language.unpacked_terms(language.packed_terms(at, n))
        assert got[0].tolist() == at.tolist() and got[1].tolist() == n.tolist()


def test_near_dedup_searches_confirms_and_links_in_queries_of_their_own(spark, sf_dir, monkeypatch):
    plans, saved = [], near_dedup.saved

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return saved(df)

    monkeypatch.setattr(near_dedup, "saved", noted)
    near_dedup.near_duplicates(textops.documents(spark, sf_dir))
    assert any("bit_count(" in p for p in plans) and any("array_intersect(" in p for p in plans)
    assert not [p for p in plans if "bit_count(" in p and "array_intersect(" in p]
    # the links are joined to their components once, not once for each direction
    assert not [p for p in plans if "Union" in p]


@pytest.fixture(scope="module")
def long_range():
    r = random.Random(5)
    keys = sorted({mixing.coded("".join(r.choices("abcdefgh", k=r.randint(1, 18))).encode()) for _ in range(60_000)})
    return keys, np.array([r.randint(0, 9) for _ in keys])


def test_lm_lays_a_range_in_blocks_of_its_bytes(spark, long_range, monkeypatch):
    keys, n = long_range
    held = []

    class Here:
        shared = type("Shared", (), {"value": {}})

        def each(self, f, schema):
            table = pa.table({"word": pa.array([k[:-1] for k in keys], pa.binary()), "n": pa.array(n, pa.int64()), "seen": pa.array(n, pa.int64())})
            tracemalloc.start()
            rows = 0
            for got in f(0, [], keys, table):
                rows += got.num_rows
                held.append(tracemalloc.get_traced_memory()[1])
            assert rows == len(keys)

    monkeypatch.setattr(mixing, "saved", lambda df: df)
    try:
        mixing.laid(Here())
    finally:
        tracemalloc.stop()
    size = sum(map(len, keys))
    assert size > 3 * mixing.BLOCK_BYTES
    # a range at once took some 250 bytes for each of its own
    assert max(held) < 40_000_000 + 24 * len(keys), f"{max(held) / size:.0f} bytes for each of the range"


@pytest.mark.parametrize("most", [1, 700, 1 << 16])
def test_lm_blocks_count_as_the_whole_range_does(long_range, most):
    keys, n = (x[20_000 : 20_000 + min(len(long_range[0]), 30 * most)] for x in long_range)
    for shared in ({}, mixing.end_counts(keys, n * 3, 3, 2)):
        blocks = list(mixing.block_counts(keys, n, shared, most))
        assert [a for a, _, _ in blocks] == [0, *(b for _, b, _ in blocks[:-1])] and blocks[-1][1] == len(keys) and len(blocks) > 1
        assert np.array_equal(np.concatenate([c for _, _, c in blocks]), mixing.prefix_counts(keys, n, shared))


def test_lm_works_on_long_words_by_their_bytes():
    words = [b"x" * 5000 + str(i).encode() for i in range(400)]
    batch = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(range(400), pa.int64())], names=["word", "n"])
    got = list(mixing.word_pieces(batch))
    assert max(sum(map(len, mixing.utf8(p.column(0)))) for p in got) <= mixing.BLOCK_BYTES
    assert [x for p in got for x in mixing.utf8(p.column(0))] == words
    assert [p.num_rows for p in mixing.word_pieces(batch.slice(0, 3), word_bytes=10)] == [1, 1, 1]


def test_lm_bounds_the_batches_of_texts(spark, sf_dir):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    try:
        mixing.scores(textops.documents(spark, sf_dir).limit(20))
        assert int(spark.conf.get(key)) == textops.BATCH_BYTES
    finally:
        spark.conf.unset(key)
