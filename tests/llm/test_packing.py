"""Packing: token pieces against the tokenizer, sequences without gaps, and how few they are."""

import zlib
from collections import defaultdict
from types import SimpleNamespace

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clientele.llm import packing as p
from clientele.llm.frames import documents
from clientele.llm.queries import QUERIES
from tests.conftest import SF_DIR

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def plain_pieces(text, length=2048):
    ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 0]
    return [(k, s, len(ids[s : s + length]), zlib.crc32(np.array(ids[s : s + length], dtype="<u4").tobytes())) for k, s in enumerate(range(0, len(ids), length))]


def check_places(rows, length):
    """Each sequence is gapless from 0 and no longer than allowed; the number of sequences."""
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for parts in places.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(places)


def test_given_documents(spark):
    rows = QUERIES["op12_packing"](spark, SF_DIR).collect()
    want = {(r.doc_id, *piece) for r in documents(spark, SF_DIR, "doc_id", "text").collect() for piece in plain_pieces(r.text)}
    assert len(rows) == len(want) and {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    sizes = np.array([r.length for r in rows])
    first_fit = p.best_fit(sizes, np.full(len(sizes), -1), np.argsort(-sizes, kind="stable"), 2048).max() + 1
    assert -(-sizes.sum() // 2048) <= check_places(rows, 2048) <= first_fit


@pytest.mark.parametrize("text", [
    "It's  the\x1ccat's house, isn't it?! we'll", "x<|endoftext|>y z<|startoftext|>", "ΑΣ ΑΣ, İstanbul Straße", "áb é ́x",
    "...,,,!!! ab.cd ab.. ab!? AB 12ab3 ab12", "\t\n\x0b\x0c\r ", "", None, "x" * 5000, "日本語 のテキスト。😀 test", "don't DON'T 's s' 'sx", "Éan ÉAN, été? Straße!! ×÷ naïve×2 é... ÀÉ. ſ ŉ ǰ,", "e\u0301t e\u0301, \u0301. a\u0301",
])
def test_words_encoded_one_by_one_give_the_ids_of_the_whole(spark, text, monkeypatch):
    rows = spark.createDataFrame([(text,), (text,)], "text string")
    pieces = p.token_pieces(rows, 16).select("piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, pieces)) == sorted(2 * plain_pieces(text, 16))


def test_long_texts_are_read_in_parts(spark, monkeypatch):
    monkeypatch.setattr(p, "GROUP_BYTES", 100)
    monkeypatch.setattr(p, "CACHE_WORDS", 10)
    texts = [" ".join(f"word{k} and, more{j}!" for j in range(60)) for k in range(4)] + ["short", None, "y" * 500]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string").coalesce(1)
    got = p.token_pieces(rows, 64).select("row.doc_id", "piece", "start", "length", "ids_crc32").collect()
    assert sorted(map(tuple, got)) == sorted((k, *x) for k, t in enumerate(texts) for x in plain_pieces(t, 64))


def test_best_fit_takes_the_tightest_bin():
    sizes = np.array([60, 50, 45, 40, 30, 5])
    bins = p.best_fit(sizes, np.full(6, -1), np.arange(6), 100)
    assert bins.tolist() == [0, 1, 1, 0, 2, 1]


def test_evolution_finds_what_best_fit_misses(monkeypatch):
    # Triples that fill a bin exactly; best fit decreasing breaks some of them.
    random = np.random.default_rng(3)
    a = random.integers(500, 800, 60)
    b = random.integers(500, 800, 60)
    sizes = np.concatenate([a, b, 2048 - a - b])
    start = p._first_population(sizes, np.full(len(sizes), -1), 2048, random)
    monkeypatch.setattr(p, "PATIENCE", 400)
    best = p.evolve(start, random, generations=400)[0]
    assert len(best.fill) < len(start[0].fill) and best.fill.max() <= 2048
    assert np.array_equal(np.bincount(best.bins, weights=sizes).astype(int), best.fill)


def test_crossover_keeps_every_piece_once_and_injects_whole_bins():
    random = np.random.default_rng(5)
    sizes = random.integers(1, 900, 300)
    parents = [p.Packing(sizes, p.best_fit(sizes, np.full(300, -1), random.permutation(300), 2048), 2048) for _ in range(2)]
    for _ in range(20):
        child = p.mutated(p.crossover(*parents, random), random)
        assert child.fill.max() <= 2048 and child.fill.sum() == sizes.sum() and (child.bins >= 0).all()


def test_shards_islands_and_rounds(spark):
    random = np.random.default_rng(1)
    sizes = random.integers(1, 2000, 1500).tolist()
    pieces = spark.createDataFrame(list(enumerate(sizes)), "uid bigint, length bigint")
    rows = p.pack_sizes(pieces, shard_pieces=500, islands=3, epochs=2).collect()
    assert sorted((r.uid, r.length) for r in rows) == list(enumerate(sizes))
    best = p.best_fit(np.array(sizes), np.full(1500, -1), np.argsort(-np.array(sizes), kind="stable"), 2048).max() + 1
    assert check_places(rows, 2048) <= 1.01 * best


def test_sequences_hold_the_ids(spark):
    texts = ["alpha beta", "gamma", None, "delta " * 30]
    packed = p.pack(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id int, text string"), 16, with_ids=True)
    packed.cache()
    whole = {r.sequence_id: r.ids for r in p.sequences(packed).collect()}
    for r in packed.collect():
        assert whole[r.sequence_id][r.offset : r.offset + r.length] == r.ids
    assert sum(map(len, whole.values())) == sum(piece[2] for t in texts for piece in plain_pieces(t, 16))
    packed.unpersist()


def test_nulls_repeated_rows_clashing_columns_and_the_empty_table(spark):
    rows = [(None, "a b", 1, 2), (1, None, 1, 2), (1, None, 1, 2), (1, "", None, None), (2, "x y " * 5000, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length int, uid int")
    got = p.pack(docs).select("row.doc_id", "row.length", F.col("length").alias("size"), "piece", "sequence_id", "offset")
    got = got.withColumnRenamed("length", "own").withColumnRenamed("size", "length").collect()
    check_places(got, 2048)
    assert sorted((r.doc_id or 0, r.piece, r.length) for r in got) == sorted((r[0] or 0, x[0], x[2]) for r in rows for x in plain_pieces(r[1]))
    assert p.pack(docs.limit(0)).count() == 0


def test_encoders_of_one_process_parse_the_tokenizer_once():
    text = p.tokenizer_text()
    first, second = p.Encoder(text), p.Encoder(str(text.encode(), "utf-8"))
    assert first._tokenizer is second._tokenizer and first._bare is second._bare
    assert first.encode([b"One word, \xc3\xa9t\xc3\xa9"])[0].tolist() == second.encode([b"One word, \xc3\xa9t\xc3\xa9"])[0].tolist()
    assert first._words is not second._words


def test_a_worker_learns_a_word_once(monkeypatch):
    """Two tasks, one after the other: the second looks up what the first has learned, and gives the same pieces."""
    learned, encoded = [], p.Encoder._encoded
    monkeypatch.setattr(p.Encoder, "_encoded", lambda self, parts: learned.extend(parts) or encoded(self, parts))
    p._encoder.cache_clear()
    sent = SimpleNamespace(value=p.tokenizer_text())
    batch = pa.RecordBatch.from_pydict({"row": pa.array([0, 1]), "text": pa.array(["One two, three. Café x-1", None], pa.string()).cast(pa.binary())})
    first, second = (pa.Table.from_batches(p._cut(sent, 4, True)(iter([batch]))) for _ in range(2))
    assert first == second and first.num_rows > 2
    assert sorted(learned) == sorted(set(learned))
