"""Quality measures and verdicts against plain Python."""

import math

from pyspark.sql import functions as F

from checks.compare import connect
from clientele.llm.oracle_sql import OP10

from clientele.llm import quality
from tests.conftest import SF_DIR


def plain_counts(text):
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.encode().split()]
    windows = {}
    for k in range(len(words) - 7):
        windows.setdefault(tuple(words[k : k + 8]), []).append(k)
    covered = {k + j for places in windows.values() if len(places) > 1 for k in places for j in range(8)}
    return (
        len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text),
        len(lines) - len(set(lines)), len(covered), len(lines),
    )


def plain_verdicts(rows):
    """From all values of a group, its language or all, in steps of the sketch."""
    counted = [(d, (lang, source), plain_counts(t)) for d, lang, source, t in rows]
    failed = [c[0] < 20 or 100 * c[4] > 30 * c[0] for _, _, c in counted]
    shares = [(c[2] / max(c[0], 1), c[3] / max(c[5], 1), c[1] / max(c[0], 1)) for _, _, c in counted]
    groups = {}
    for (_, group, _), bad, share in zip(counted, failed, shares):
        if not bad:
            for key in (group, group[:1], ()):
                groups.setdefault(key, []).append(share)

    def rank(values, q):
        return sorted(min(v, quality.LARGEST) * quality.STEPS // 1 for v in values)[math.ceil(len(values) * q) - 1] / quality.STEPS

    out = []
    for (d, group, c), bad, share in zip(counted, failed, shares):
        good = not bad
        usual = next((groups[k] for k in (group, group[:1]) if len(groups.get(k, [])) >= quality.LEAST_GROUP), groups.get(()))
        for k, (name, least) in enumerate(quality.LEAST_SPAN.items()):
            if good:
                values = [s[k] for s in usual]
                mid, high, low = rank(values, 0.5), rank(values, quality.USUAL), rank(values, 1 - quality.USUAL)
                good = share[k] <= mid + quality.SPANS * max(high - mid, least)
                if name in quality.TWO_SIDED:
                    good = good and share[k] >= mid - quality.SPANS * max(mid - low, least)
        out.append((d, *c[:5], bad, good))
    return sorted(out, key=str)


def verdicts(docs):
    return sorted(map(tuple, quality.quality_verdicts(docs).collect()), key=str)


def test_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "source", "text")
    expected = plain_verdicts(list(map(tuple, docs.collect())))
    assert 0 < sum(r[-1] for r in expected) < len(expected)
    assert verdicts(docs) == expected


def test_nulls_long_texts_and_repeats(spark):
    rows = [
        (1, "en", "a", None), (2, "en", "a", ""), (3, None, None, "a b c d e f g h " * 2), (3, None, None, "a b c d e f g h " * 2),
        (None, "en", None, "One line\nOne line\n\n \t \nOne  line\n" + " ".join(f"w{k}" for k in range(30))),
        (5, "en", "a", "# * $ % & | < > é ü 😀 " * 3 + " ".join(f"w{k}" for k in range(40))), (6, "xx", "b", "x" * 200_000),
        (7, "en", "a", " ".join(f"v{k}" for k in range(50_000))), (8, "en", "a", "same " * 9 + " ".join(f"u{k}" for k in range(90))),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string")
    assert verdicts(docs) == plain_verdicts(rows)
    assert quality.quality_verdicts(docs.limit(0)).collect() == []


def test_filter_keeps_columns_that_clash(spark):
    rows = [(k, "en", "a", " ".join(f"w{k}x{j}" for j in range(30)), k) for k in range(20)] + [(99, "en", "a", "short", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, source string, text string, kept int")
    left = quality.quality_filter(docs.withColumnRenamed("kept", "q"))
    assert left.columns == ["doc_id", "lang", "source", "text", "q"]
    assert sorted((r.doc_id, r.q) for r in left.collect()) == [(k, k) for k in range(20)]


def test_a_symbol_heavy_document_is_rejected_only_where_it_is_unusual(spark):
    plain = [(k, "en", "prose", " ".join(f"w{k}x{j}" for j in range(30)), 0) for k in range(40)]
    tables = [(100 + k, "en", "tables", " | ".join(f"t{k}x{j}" for j in range(30)), 0) for k in range(40)]
    odd = [(200, "en", "prose", " | ".join(f"o{j}" for j in range(30)), 0)]
    docs = spark.createDataFrame(plain + tables + odd, "doc_id bigint, lang string, source string, text string, n int")
    kept = {r.doc_id for r in quality.quality_filter(docs).collect()}
    assert kept == {r[0] for r in plain + tables}


def test_documents_agree_with_sql(spark):
    rows = connect(SF_DIR).execute(
        f"SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM ({OP10})"
    ).fetchall()
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "lang", "source", "text")
    assert verdicts(docs) == sorted(rows, key=str)


def test_a_lone_document_does_not_set_its_own_fence(spark):
    plain = [(k, "en", "prose", " ".join(f"w{k}x{j}" for j in range(30))) for k in range(40)]
    lone = [(100, "en", "lone", "# " * 290 + " ".join(f"o{j}" for j in range(120))), (101, "xx", "far", "# " * 290 + " ".join(f"o{j}" for j in range(120)))]
    docs = spark.createDataFrame(plain + lone, "doc_id bigint, lang string, source string, text string")
    assert {r.doc_id for r in quality.quality_filter(docs).collect()} == set(range(40))


def test_fences_of_a_large_group_are_the_same_in_every_run(spark):
    """100,000 documents of one group, in two orders and partitionings."""
    q = F.struct(
        F.lit(1000).cast("bigint").alias("n_words"), (F.hash("id") % 3000 + 5000).cast("bigint").alias("word_chars"),
        F.pmod(F.hash("id", F.lit(1)), F.lit(400)).cast("bigint").alias("n_symbols"), F.lit(0).cast("bigint").alias("n_dup_lines"),
        F.lit(0).cast("bigint").alias("n_repeat_words"), F.lit(10).cast("bigint").alias("n_lines"),
    ).alias("q")
    rows = spark.range(100_000).select(F.lit("en").alias("lang"), F.lit("a").alias("source"), q)
    first, again = (quality.fences(x).collect() for x in (rows.repartition(3), rows.orderBy(F.rand(3)).repartition(11)))
    assert first == again and abs(first[0].symbol_share_high - (0.2 + 3 * 0.14)) < 0.02
