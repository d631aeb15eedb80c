"""A shard of the decontamination holds numbers, not words."""

import random
import tracemalloc

from tillbridge.llm import common, decontaminate, pieces

ITEM = " ".join(f"item{k}" for k in range(14))


def test_shard_keeps_a_few_bytes_of_each_word():
    rng = random.Random(4)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(20_000)) for _ in range(40)]
    block = decontaminate.compile_queries([(1, decontaminate.words(ITEM))])
    tracemalloc.start()
    try:
        shard = decontaminate.Shard([block])
        for text in texts:
            shard.add(text)
        held, most = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert shard.size == 800_000
    assert held < 8 * shard.size and most < 16 * shard.size  # words as strings took 45 bytes each


def test_words_are_whole_where_a_text_is_cut(monkeypatch):
    text = "Ab,c  déf\n\x00" * 7 + "é" * 30 + " last"
    for size in (1, 3, 8, 1000):
        monkeypatch.setattr(decontaminate, "PIECE_BYTES", size)
        assert [w for piece in decontaminate.pieces_of(text) for w in piece] == decontaminate.words(text)
    assert not list(decontaminate.pieces_of(None)) + list(decontaminate.pieces_of(""))


def test_matches_in_texts_of_many_pieces_and_shards(spark, monkeypatch):
    filler = "plain words here " * 40_000  # several pieces
    docs = spark.createDataFrame([(1, filler + ITEM + " " + filler), (2, filler), (3, None), (4, ITEM), (4, ITEM), (None, ITEM[:-7])], "doc_id long, text string")
    benchmark = spark.createDataFrame([(10, ITEM), (11, "words here plain"), (12, None)], "item_id long, text string")
    for block_words in (decontaminate.BLOCK_WORDS, 5):
        rows = decontaminate.find(docs.coalesce(1), benchmark, block_words=block_words).collect()
        got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["n_items"], r["longest_match"], r["longest_item"], r["longest_at"]) for r in rows)
        assert got == [
            (0, 13, 13, 1, 13, "10", 0),
            (1, 240_014, 2 * 119_997 + 14, 2, 14, "10", 120_000),
            (2, 120_000, 119_997, 1, 3, "11", 1),
            (3, 0, 0, 0, 0, None, None),
            (4, 14, 14, 1, 14, "10", 0),
            (4, 14, 14, 1, 14, "10", 0),
        ]


def test_operators_that_make_objects_of_words_take_small_batches(spark):
    docs = spark.createDataFrame([(1, "some text")], "doc_id long, text string")
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    for build in (lambda: decontaminate.find(docs, spark.createDataFrame([(1, ITEM)], "item_id long, text string")), lambda: pieces.round_trip(docs)):
        common.bound_batches(spark)
        build()
        assert int(spark.conf.get(key)) == common.SMALL_BATCH_BYTES < common.BATCH_BYTES
