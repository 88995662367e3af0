"""Collocations: summaries, exact counts, scores and ranks, against a plain count of everything."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from checks.compare import connect
from clientele.llm import collocations as c
from clientele.llm.frames import documents
from clientele.llm.oracle_sql import ORACLE_SQL
from tests.conftest import SF_DIR

COLUMNS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def plain(rows, threshold=30, top=2000):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    total, found = Counter(), defaultdict(Counter)
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                for k in range(len(words) - size + 1):
                    found[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, counts in found.items():
        frequent = {p: f for p, f in counts.items() if f >= threshold}
        ranked = []
        for phrase, a in frequent.items():
            if len(phrase) < 2:
                continue
            longer = [f for p, f in frequent.items() if len(p) > len(phrase) and any(p[k : k + len(phrase)] == phrase for k in range(len(p)))]
            if any(100 * f >= 80 * a for f in longer):
                continue
            cuts = [(2_000_000 * a // (counts[phrase[:k]] + counts[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            ranked.append((-score, -a, " ".join(phrase).encode(), counts[phrase[:k]], counts[phrase[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def result(docs, **options):
    return sorted(tuple(r[x] for x in COLUMNS) for r in c.collocations(docs, **options).collect())


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(1, 5)), min_size=1, max_size=200), st.integers(1, 12), st.integers(1, 9))
@settings(max_examples=150, deadline=None)
def test_summaries_lose_less_than_their_share(rows, capacity, parts):
    keys, counts, lost = np.empty(0, np.uint32), np.empty(0, np.int64), 0
    for k in range(0, len(rows), parts):
        more = np.array(rows[k : k + parts])
        keys, counts, cut = c.merged(
            np.concatenate([keys, more[:, 0].astype(np.uint32)]), np.concatenate([counts, more[:, 1]]), capacity
        )
        lost += cut
        assert len(keys) <= capacity
    exact = Counter()
    for key, count in rows:
        exact[key] += count
    assert lost * (capacity + 1) <= sum(exact.values())
    held = dict(zip(keys.tolist(), counts.tolist()))
    for key, count in exact.items():
        assert count - lost <= held.get(key, 0) <= count


@given(st.dictionaries(st.integers(0, 2**32 - 1), st.integers(1, 10**6), max_size=50))
@settings(max_examples=50, deadline=None)
def test_packed_summaries_come_back(counts):
    keys = np.array(sorted(counts), dtype=np.uint32)
    values = np.array([counts[k] for k in keys.tolist()], dtype=np.int64)
    back = c.unpacked(c.packed(keys, values))
    assert np.array_equal(back[0], keys) and np.array_equal(back[1], values)


def test_given_documents_equal_the_plain_count(spark):
    docs = documents(spark, SF_DIR, "lang", "text")
    assert result(docs, threshold=8) == plain([tuple(r) for r in docs.collect()], threshold=8)


def test_given_documents_equal_the_sql(spark):
    rows = connect(SF_DIR).execute(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL['op11_collocations']})").fetchall()
    assert result(documents(spark, SF_DIR, "lang", "text")) == sorted(rows) != []


@pytest.fixture
def small(monkeypatch):
    """Many partitions, slices, buffers and rounds also for short texts."""
    monkeypatch.setattr(c, "PARTITION_MASS", 500)
    monkeypatch.setattr(c, "BUFFER", 300)
    monkeypatch.setattr(c, "EXACT_BUFFER", 200)
    monkeypatch.setattr(c, "TOKENS", 40)
    monkeypatch.setattr(c, "SLICE_BYTES", 64)
    monkeypatch.setattr(c, "WORDS_AT_MOST", 12)
    monkeypatch.setattr(c, "FILTER_BITS", 256)


def test_small_buffers_slices_and_rounds_give_the_same(spark, small):
    text = "Alpha beta gamma, delta alpha\tbeta GAMMA. epsilon alpha beta zeta\neta alpha beta gamma theta iota kappa "
    rows = [("en", text * 9), (None, "x y z " * 40), ("und", "x y! z"), ("de", "Ä b " * 31 + "ä b"), ("en", None), ("fr", ""), ("en", text * 9)]
    got = result(spark.createDataFrame(rows, "lang string, text string"), threshold=5)
    assert got == plain(rows, threshold=5) and {r[0] for r in got} == {"en", "und", "de"}


def test_one_language_and_one_phrase_may_hold_nearly_all(spark):
    rows = [("en", "hot phrase here " * 400)] * 20 + [("de", "kalt und warm")] * 30
    got = result(spark.createDataFrame(rows, "lang string, text string"))
    assert got == plain(rows)


def test_top_cuts_ties_by_bytes(spark):
    rows = [("en", "\n".join(f"{w} {v}" for w in "abc" for v in ("é", "z", "Z!", "~")))] * 30
    got = result(spark.createDataFrame(rows, "lang string, text string"), top=5)
    assert got == plain(rows, top=5) and len(got) == 5


def test_scores_are_exact_beyond_64_bits(spark):
    big = 9_000_000_000_000_000_000
    phrases = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big - 7), ("en", 2, "a b", big - 9), ("en", 3, "a b c", big - 10), ("en", 1, "c", big), ("en", 2, "b c", big - 8)],
        "lang string, size int, phrase string, f bigint",
    )
    scores = {r.phrase: r.score for r in c.scored(phrases).collect()}
    assert scores["a b"] == 2_000_000 * (big - 9) // (2 * big - 7)
    assert scores["a b c"] == min(2_000_000 * (big - 10) // (big + big - 8), 2_000_000 * (big - 10) // (big - 9 + big))


def test_empty_table_and_clashing_columns(spark):
    assert result(spark.createDataFrame([], "lang string, text string")) == []
    rows = [("en", "one two " * 40, 1, "x", 2)]
    docs = spark.createDataFrame(rows, "lang string, text string, phrase int, word string, n int")
    assert result(docs) == plain([r[:2] for r in rows])
