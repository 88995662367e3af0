"""The bigram model against a plain dictionary version."""

import math
import zlib
from collections import Counter, defaultdict

import pytest

from clientele.llm import ngrams
from tests.conftest import SF_DIR


def tokens_of(text):
    return [*"".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split(), None]


def plain_scores(rows):
    training = [tokens_of(t) for d, t in rows if zlib.crc32(str("" if d is None else d).encode()) % 7 != 2]
    uses = Counter(w for doc in training for w in doc)
    n, v = sum(uses.values()), len(uses)
    pairs = Counter(p for doc in training for p in zip(["<s>", *doc], doc))
    before, followers = Counter(w for _, w in pairs), defaultdict(list)
    for (first, _), c in pairs.items():
        followers[first].append(c)

    def tally(counts):
        t = Counter(counts)
        return [t[k] for k in (1, 2, 3, 4)]

    d, dw = [0, *ngrams.discounts(tally(pairs.values()))], [0, *ngrams.discounts(tally(before.values()))]
    taken = sum(dw[min(c, 3)] for c in before.values())

    def word(w):
        return max(before[w] - dw[min(before[w], 3)], 0) / len(pairs) + taken / len(pairs) / (v + 1)

    def pair(first, w):
        if first not in followers:
            return word(w)
        c, all_c = pairs[first, w], followers[first]
        return max(c - d[min(c, 3)], 0) / sum(all_c) + sum(d[min(x, 3)] for x in all_c) / sum(all_c) * word(w)

    result = []
    for doc_id, text in rows:
        doc = tokens_of(text)
        base = sum(math.log10((uses[w] + 1) / (n + v + 1)) for w in doc)
        score = sum(math.log10(pair(p, w)) for p, w in zip(["<s>", *doc], doc)) if pairs else None
        result.append((doc_id, len(doc), sum(w in uses for w in doc), n, base, score))
    total = sum(pair(training[0][0], w) for w in uses) + pair(training[0][0], "unseen") if training else 1
    assert abs(total - 1) < 1e-9
    return result


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = sorted(map(tuple, ngrams.bigram_scores(docs).drop("perplexity", "held_out").collect()), key=str)
    expected = sorted(plain_scores(rows), key=str)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    for g, e in zip(got, expected):
        assert g[4:] == pytest.approx(e[4:], rel=1e-9)


def test_documents_in_many_shards(spark, monkeypatch):
    monkeypatch.setattr(ngrams, "WORDS_PER_SHARD", 5000)
    monkeypatch.setattr(ngrams, "PAIRS_PER_SHARD", 3000)
    check(spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text"))


def test_held_out_texts_gain_from_the_model(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    held = ngrams.bigram_scores(docs).filter("held_out").selectExpr("sum(score) score", "sum(base_score) base").first()
    assert held.score > held.base


def test_nulls_repeats_frequent_pairs_and_empty(spark):
    text = "To be or not to BE " * 200
    rows = [(k, text) for k in range(12)] + [(3, "to be"), (3, "to be"), (None, None), (50, ""), (51, "x" * 60_000), (None, "be be\x1fbe é É")]
    check(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert ngrams.bigram_scores(spark.createDataFrame([], "doc_id bigint, text string")).collect() == []
