"""Pareto mixing: targets, copies and the rows of the mix."""

import pytest
from pyspark.sql import functions as F

from checks.compare import connect
from clientele.llm import mixing
from clientele.llm.oracle_sql import OP5
from tests.conftest import SF_DIR


def plain_targets(sizes):
    """Water filling by rounds: sources above twice their size stop, the others share what is left."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    stopped, total = {}, 1.5 * sum(sizes.values())
    while True:
        left, free = total - sum(stopped.values()), [s for s in names if s not in stopped]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return stopped | share
        stopped |= {s: 2.0 * sizes[s] for s in over}


def check(docs):
    rows = mixing.mix_report(docs).collect()
    sizes, taken, longest = {}, {}, {}
    by_id = {}
    for r in docs.collect():
        n = len((r.text or "").encode().split())
        sizes[r.source] = sizes.get(r.source, 0) + n
        by_id.setdefault(r.doc_id, []).append((r.source, n))
    targets = plain_targets(sizes)
    for r in rows:
        source, n = next(x for x in by_id[r.doc_id] if x[1] == r.size and sizes[x[0]] == r.source_size)
        assert r.target == pytest.approx(targets[source]) and r.taken in (0, n, 2 * n)
        taken[source] = taken.get(source, 0) + r.taken
    assert len(rows) == docs.count()
    return sizes, targets, taken


def test_documents_come_near_their_targets(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "source", "text")
    sizes, targets, taken = check(docs)
    rows = docs.join(mixing.mix_report(docs), "doc_id").filter("size > 0").collect()
    for source in sizes:
        # No document that got no copy more would fit into what is missing.
        certain = int(targets[source] // sizes[source])
        passed = [r.size for r in rows if r.source == source and r.taken == certain * r.size]
        assert 0 <= targets[source] - taken[source] < min(passed, default=1)
    again = mixing.mix_report(docs.repartition(7))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, mixing.mix_report(docs).collect()))


def test_several_ranges_agree_with_sql(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANGE_ROWS", 4)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    theirs = connect(SF_DIR).execute(OP5).fetchall()
    assert sorted(map(tuple, mixing.mix_report(docs).collect())) == sorted(theirs)


def test_nulls_empties_and_hot_source(spark):
    rows = [(k, "hot", "a b c " * (1 + k % 7)) for k in range(300)]
    rows += [(1000 + k, None, "x y " * (k + 1)) for k in range(5)] + [(2000, "empty", None), (2001, "empty", ""), (None, "z", "one two"), (None, "z", None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    sizes, targets, taken = check(docs)
    assert taken["empty"] == 0 and targets["empty"] == 0
    assert abs(taken["hot"] - targets["hot"]) <= 30
    assert mixing.mix_report(docs.limit(0)).collect() == []


def test_mix_repeats_rows_with_all_columns(spark):
    rows = [(k, f"s{k % 3}", "a b c d " * (1 + k % 5), k) for k in range(60)] + [(7, "s1", "a b c d " * 3, 700)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, copies int").withColumnRenamed("copies", "n")
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    report = mixing.mix_report(docs.select("doc_id", "source", "text"))
    words = sum(len(r.text.split()) for r in mixed.collect())
    assert words == report.groupBy().sum("taken").first()[0] > 0
    assert mixing.mix(docs.limit(0)).collect() == []


@pytest.mark.parametrize("seed", [f"seed{k}" for k in range(5)])
def test_a_very_long_document_leaves_no_source_short(spark, seed):
    """A document longer than what is left is passed over; those behind it fill the target, also in later ranges."""
    sizes = spark.range(12_001).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") < 5000, "a").otherwise("b").alias("source"),
        F.when(F.col("id") == 12_000, "w " * 100_000).otherwise("w " * 30).alias("text"),
    )
    report = mixing.mix_report(sizes, seed).groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"))
    for r in report.collect():
        assert 0 <= r.target - r.taken <= 30


def test_the_order_is_filled_document_by_document(spark, monkeypatch):
    """Ranges of a few documents against a walk through each source's whole order."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 3)
    docs = [(k, f"s{k % 2}", "w " * (1 + (k * 7919) % 97 ** (1 + k % 2))) for k in range(150)]
    frame = spark.createDataFrame(docs, "doc_id bigint, source string, text string")
    sized = mixing.kept(mixing.with_sizes(frame, "mix"), "sizes")
    order = sorted(sized.collect(), key=lambda r: r.u)
    rows = {r.doc_id: r for r in mixing.mix_report(frame).collect()}
    for source in ("s0", "s1"):
        own = [r for r in order if r.source == source]
        first = rows[own[0].doc_id]
        certain = min(2, int(first.target // first.source_size))
        left = int(first.target - certain * first.source_size)
        for r in own:
            fits = r.size <= left
            left -= r.size * fits
            assert rows[r.doc_id].taken == r.size * (certain + fits)
