"""Spelling variants: words, near words, forms and roots against plain code."""

import re
import zlib
from collections import Counter, defaultdict

import pytest

from clientele.llm import spelling as s
from clientele.llm.frames import documents
from clientele.llm.queries import QUERIES
from tests.conftest import SF_DIR

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, least_length=6, least_count=5, every=199):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= least_length and n >= least_count}


def plain_groups(words):
    """Words that share a form with one letter struck out or one blotted out are the only ones at one edit."""
    blotted, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            blotted[w[:k] + "\0" + w[k + 1 :]].add(w)
            if (v := w[:k] + w[k + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
    for family in blotted.values():
        for w in family:
            near[w] |= family - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        if best is not None and words[best] >= 5 * n:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def rows_of(df):
    return {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


def test_given_documents(spark):
    words = plain_words([tuple(r) for r in documents(spark, SF_DIR, "doc_id", "text").collect()])
    got = QUERIES["op13_spelling"](spark, SF_DIR)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(got) == plain_groups(words) and len(words) > 500


def groups(spark, words):
    return rows_of(s.variant_groups(spark.createDataFrame(list(words.items()), "word string, n bigint")))


@pytest.mark.parametrize("sent", [500_000, 0])
def test_all_kinds_of_edits(spark, monkeypatch, sent):
    monkeypatch.setattr(s, "SENT_EDGES", sent)
    words = {
        "tokens": 700, "token": 100, "tokenss": 20, "toknes": 7, "tokans": 30, "ttokens": 6, "okens": 5, "aab": 50, "ab": 9, "abb": 260,
        "a": 3, "b": 20, "é": 4, "è": 90, "naïve": 40, "naive": 41, "naiv": 8, "×÷": 2, "tokensx" * 2: 6, "tokensx" * 2 + "y": 31,
        "tokensxtokenzx": 5, "same": 25, "samf": 25, "samg": 5,
    }
    assert groups(spark, words) == plain_groups(words)


def test_chains_end_at_the_last_form_and_ties_at_the_first_word(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "zzzzzz": 1, "zzzzzy": 5, "zzzzzx": 5}
    got = groups(spark, words)
    assert got == plain_groups(words)
    assert {r[0]: r[2] for r in got}["aaaaaa"] == "abbbbb" and {r[0]: r[1] for r in got}["zzzzzz"] == "zzzzzx"


def test_deleted_letters_long_texts_and_letters_outside_ascii(spark, monkeypatch):
    monkeypatch.setattr(s, "SLICE", 50)
    rows = [(k, "Grüße ÀÉÎ×÷ Straßenbahn мир naïveté×x ſharp l'été " * 40 + "x" * 300) for k in range(30)] + [(None, "Straßenbahn Grüßen"), (5, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.word: r.n for r in s.vocabulary(docs, 3, 2, every=5).collect()}
    assert got == plain_words(rows, 3, 2, every=5) and "àéî" not in got


def test_one_word_may_hold_nearly_all_rows(spark):
    rows = [(k, "tokenization " * 300 + "segmentation") for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert rows_of(s.spelling_variants(docs)) == plain_groups(plain_words(rows))


def test_empty_table_clashing_columns_and_repeated_rows(spark):
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert s.spelling_variants(empty).collect() == []
    docs = spark.createDataFrame([(1, "wordone wordtwo", "x", 1, 2)] * 6, "doc_id bigint, text string, word string, n int, node int")
    assert rows_of(s.spelling_variants(docs)) == plain_groups(plain_words([(1, "wordone wordtwo")] * 6))
