"""SimHash near-duplicates against a brute-force version."""

import random

import numpy as np
import pytest
import xxhash

from clientele.llm import simhash
from clientele.llm.components import components, forest
from tests.conftest import SF_DIR


def plain_fingerprint(text, size=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance=3):
    """Component label per place, by comparing all pairs."""
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


TEXTS = ["", None, " \t\n", "one", "One two", "a b c", "A b C d e f g", "ünï  cöde wörds \x1c here", "w " * 5000, "x" * 100_000]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, distance):
    rng = random.Random(distance)
    prints = {0, 2**64 - 1}
    for _ in range(60):
        fp = rng.getrandbits(64)
        prints.add(fp)
        for _ in range(rng.randrange(6)):
            for bit in rng.sample(range(64), rng.randrange(1, 5)):
                fp ^= 1 << bit
            prints.add(fp)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in prints], "fp bigint")
    roots = dict(map(tuple, components(simhash.close_links(df, distance)).collect()))
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    labels = [roots.get(p, p) for p in signed]
    expected = plain_groups(prints, distance)
    assert len(set(expected)) < len(prints) or distance == 0
    assert len(set(zip(labels, expected))) == len(set(labels)) == len(set(expected))


def test_whole_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    prints = [plain_fingerprint(t) for _, t in rows]
    groups = plain_groups(prints)
    assert got == {d: (f"{p:016x}", rows[g][0]) for (d, _), p, g in zip(rows, prints, groups)}


def test_nulls_copies_and_clashing_columns(spark):
    rows = [
        (1, "", "a"), (2, None, "b"), (3, "one two three four five", "c"), (3, "one two three four five", "d"),
        (4, "One two three four FIVE", "e"), (None, "one two three four five", "f"), (None, None, "g"), (7, "quite another text it is", "h"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, fp string").withColumnRenamed("fp", "group")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 1), (0, 3), (1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (7, 7)]
    left = simhash.near_dedup(docs)
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.group) for r in left.collect()) in ([(1, "a"), (3, "c"), (7, "h")], [(1, "a"), (3, "d"), (7, "h")])
    assert simhash.near_duplicates(docs.limit(0)).collect() == [] and simhash.near_dedup(docs.limit(0)).collect() == []


@pytest.mark.parametrize("most", [10**6, 0])
def test_components_of_long_chains_and_hubs(spark, monkeypatch, most):
    monkeypatch.setattr("clientele.llm.components.ONE_TASK_LINKS", most)
    chain = [(k, k + 1) for k in range(300)]
    hub = [(1000, 2000 + k) for k in range(500)] + [(999, 2100)]
    random.Random(1).shuffle(chain)
    links = spark.createDataFrame(chain + hub + [(5, 5)], "a bigint, b bigint")
    got = dict(map(tuple, components(links).collect()))
    assert got == {k: 0 for k in range(1, 301)} | {1000: 999} | {2000 + k: 999 for k in range(500)}


def test_forest_connects_alike():
    a, b = np.array([5, 3, 9, 9], dtype=np.uint64), np.array([3, 1, 8, 9], dtype=np.uint64)
    assert sorted(zip(*map(list, forest(a, b)))) == [(1, 3), (1, 5), (8, 9)]
