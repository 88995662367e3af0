"""Decontamination against a plain version that lays every window over every document."""

import random
import re
from collections import Counter

import pytest

from clientele.llm import contamination


def shingles(words):
    step = min(5, len(words))
    return [tuple(words[k : k + step]) for k in range(len(words) - step + 1)]


def plain_pairs(docs, items):
    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {i: words(t) for i, t in items if i is not None and words(t)}
    owners = Counter(s for w in items.values() for s in set(shingles(w)))
    pairs = {}
    for doc_id, text in docs:
        own = words(text)
        for item, w in items.items():
            c = Counter(shingles(w))
            step, size = min(5, len(w)), min(len(w), len(own))
            for start in range(len(own) - size + 1):
                part = own[start : start + size]
                d = Counter(tuple(part[k : k + step]) for k in range(len(part) - step + 1))
                both = sum(min(c[s], d[s]) / owners[s] for s in c)
                either = sum(max(c[s], d[s]) / owners[s] for s in c) + sum(n for s, n in d.items() if s not in c)
                if both and both / either >= 0.8:
                    pairs[doc_id, item] = max(pairs.get((doc_id, item), 0), round(both / either, 9))
    return pairs


def cases():
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(12, 50)))) for k in range(25)]
    items += [(30, items[0][1]), (31, "three word item"), (32, "Solo"), (33, ""), (34, None), (None, "no id here at all")]
    docs = []
    for k in range(120):
        words = [word() for _ in range(rng.randrange(5, 120))]
        if k % 3 == 0:
            own = rng.choice(items[:25])[1].split()
            if k % 2:
                own[rng.randrange(len(own))] = "changed"
            place = rng.randrange(len(words))
            words[place:place] = [w.upper() + "," for w in own]
        docs.append((k, " ".join(words)))
    docs += [(200, "a THREE-word item!"), (201, "x solo y"), (202, None), (203, ""), (204, items[3][1]), (205, items[4][1][: len(items[4][1]) // 3])]
    return docs, items


@pytest.mark.parametrize("few", [500_000, 0])
def test_pairs(spark, monkeypatch, few):
    monkeypatch.setattr(contamination, "BROADCAST_ROWS", few)
    docs, items = cases()
    expected = plain_pairs(docs, items)
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    rows = contamination.contaminated(frame, benchmark).collect()
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in rows}
    assert len(rows) == len(got) and all(got[p] == expected[p] for p in got)
    # The radius decides beside the similarity: whole copies are always within it, changed ones nearly always.
    missed = set(expected) - set(got)
    assert all(expected[p] < 1 for p in missed) and len(missed) <= 0.1 * len(expected)


def test_repeated_items_and_templates_drop_no_similar_window(spark):
    rng = random.Random(11)
    text = lambda prefix, n: [f"{prefix}{k}x{rng.randrange(1000)}" for k in range(n)]
    items, docs = [], []
    for m, size in ((1, 60), (2, 60), (3, 60), (5, 60), (5, 100)):
        own = text(f"m{m}s{size}", size)
        items += [(len(items) + k, " ".join(own)) for k in range(m)]
        own[30] = "changed"
        docs.append((len(docs), " ".join([*text("before", 9), *own, *text("after", 9)])))
    form = text("form", 60)
    for k in range(6):
        # Half an item is its own, and the change lies there.
        own = form[:30] + text(f"own{k}", 50) + form[30:]
        items.append((100 + k, " ".join(own)))
        own[50] = "changed"
        docs.append((len(docs), " ".join([*text("before", 9), *own])))
    expected = {}
    for doc_id, words in docs:
        for item, own in items:
            c, size = set(shingles(own.split())), len(own.split())
            for start in range(len(words.split()) - size + 1):
                d = set(shingles(words.split()[start : start + size]))
                if len(c & d) >= 0.8 * len(c | d):
                    expected[doc_id, item] = max(expected.get((doc_id, item), 0), len(c & d) / len(c | d))
    assert len(expected) == 1 + 2 + 3 + 5 + 5 + 6 and expected[1, 1] == 51 / 61
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in contamination.contaminated(frame, benchmark).collect()}
    assert set(expected) <= set(got) and all(got[p] >= expected[p] - 1e-9 for p in expected)
    assert contamination.decontaminated(frame, benchmark).count() == 0


def test_all_fingerprints_within_the_radius_meet(spark):
    fps = [0x0123456789ABCDEF]
    for k in range(1, 20):
        fps.append(fps[0] ^ sum(1 << b for b in random.Random(k).sample(range(64), k)))
    few = set(contamination._flips(spark).first().flips)
    for fp in fps:
        blocks = [(fp >> 16 * k & 0xFFFF) ^ (fps[0] >> 16 * k & 0xFFFF) for k in range(4)]
        assert any(b in few for b in blocks) or (fp ^ fps[0]).bit_count() > contamination.RADIUS


def test_edges(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(1, item, "a"), (1, item, "b"), (None, item + " more", "c"), (3, None, "d"), (4, "clean words only", "e")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, extra string").withColumnRenamed("extra", "key")
    benchmark = spark.createDataFrame([(1, item), (1, item)], "item_id bigint, text string")
    assert sorted(map(tuple, contamination.contaminated(docs, benchmark).select("doc_id", "item_id").collect()), key=str) == [(1, 1), (None, 1)]
    left = contamination.decontaminated(docs, benchmark)
    assert left.columns == docs.columns and sorted(r.key for r in left.collect()) == ["d", "e"]
    assert contamination.contaminated(docs.limit(0), benchmark).collect() == []
    assert contamination.contaminated(docs, benchmark.limit(0)).collect() == []
    assert contamination.decontaminated(docs, benchmark.limit(0)).count() == 5
