"""Repeated passages against a plain version."""

import random

import numpy as np
import pytest

from clientele.llm import repeats


def plain(rows):
    docs = sorted({(d is None, d or 0, t or "") for d, t in rows})
    seen, kept = set(), {}
    for null, d, text in docs:
        words = text.encode().split()
        gone = set()
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                gone.update(range(k, k + 20))
            seen.add(window)
        kept[null, d, text] = (len(words), len(gone), b" ".join(w for k, w in enumerate(words) if k not in gone).decode())
    return sorted(((d, *kept[d is None, d or 0, t or ""]) for d, t in rows), key=str)


def result(docs):
    out = repeats.without_repeats(docs).select("doc_id", "n_words", "n_removed", "kept_text", "spans").collect()
    for r in out:
        covered = {k for s in r.spans for k in range(s.start, s.start + s.n_words)}
        assert len(covered) == r.n_removed and all(s.n_words >= 20 for s in r.spans)
    return sorted((tuple(r)[:4] for r in out), key=str)


@pytest.mark.parametrize("held, group", [(1_500_000, 1_000_000), (300, 50)])
def test_shared_passages(spark, monkeypatch, held, group):
    # Small limits: several pieces per task, several groups, and prefixes that are too frequent for one.
    monkeypatch.setattr(repeats, "HELD_ENTRIES", held)
    monkeypatch.setattr(repeats, "GROUP_ENTRIES", group)
    rng = random.Random(2)
    passages = [[f"p{k}w{rng.randrange(30)}" for _ in range(rng.randrange(18, 60))] for k in range(6)]
    rows = []
    for d in range(160):
        words = []
        for _ in range(rng.randrange(4)):
            words += [f"own{rng.randrange(10**6)}" for _ in range(rng.randrange(30))] + rng.choice(passages)
        rows.append((d * 3, ("\n " if d % 2 else " ").join(words)))
    rows += [(5, "hey " * 45), (1000, " ".join(passages[0] * 3)), (1001, "stop " * 19)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert result(docs) == plain(rows)


def test_nulls_repeats_and_order(spark):
    text = " ".join(f"w{k}" for k in range(40))
    rows = [(7, text), (7, text), (3, "x " + text), (None, text + " y"), (None, None), (1, None), (2, ""), (4, "a \x1c b"), (9, "z " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(docs) == plain(rows)
    assert repeats.without_repeats(docs.limit(0)).collect() == []


@pytest.mark.parametrize("width", [1, 2, 3, 7, 13])
def test_sliding(width):
    values = np.random.default_rng(1).integers(0, 50, 40)
    assert repeats.sliding(values, width, np.minimum).tolist() == [values[k : k + width].min() for k in range(41 - width)]
    assert len(repeats.sliding(values[: width - 1], width, np.minimum)) == 0


def test_spans_are_runs_of_windows_that_stand_earlier(spark):
    """Against all windows; two passages side by side are two spans, as the words across their border stand nowhere earlier."""
    rng = random.Random(6)
    a, b, c = ([f"{name}{rng.randrange(1000)}" for _ in range(30)] for name in "abc")
    rows = [(1, " ".join(a)), (2, "x " + " ".join(b)), (3, " ".join([*c, "y", *a[:25]])), (4, " ".join(["z", *a, *b, *c[:19], "v", *c])), (5, " ".join(a + b))]
    got = {r.doc_id: [(s.start, s.n_words) for s in r.spans] for r in repeats.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    seen, expected = set(), {}
    for d, text in rows:
        words = text.split()
        starts = []
        for k in range(len(words) - 19):
            window = tuple(words[k : k + 20])
            if window in seen:
                starts.append(k)
            seen.add(window)
        spans = []
        for k in starts:
            if spans and spans[-1][0] + spans[-1][1] - 19 == k:
                spans[-1][1] += 1
            else:
                spans.append([k, 20])
        expected[d] = [tuple(x) for x in spans]
    assert got == expected and got[4] == [(1, 30), (31, 30), (81, 30)] and got[5] == [(0, 60)]
