"""The toxicity classifier: held-out accuracy and defined results at the edges."""

import numpy as np

from clientele.llm import toxicity


def test_held_out_documents(spark):
    sf_dir = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    scored = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels))
    rows = scored.join(labels, "doc_id").filter("held_out").select("score", "predicted", "toxic").collect()
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic for r in rows])
    above = (score[toxic == 1][:, None] > score[toxic == 0][None, :]).mean()
    assert above > 0.95 and np.mean([r.predicted == r.toxic for r in rows]) > 0.95
    assert scored.count() == docs.count() and scored.filter("score < 0 OR score > 1 OR predicted <> int(score >= 0.5)").isEmpty()


def small(spark, toxic):
    rows = [(k, "en" if k % 2 else None, f"{'you moron ' if k % 4 == 0 else ''}some plain words {k} " * (k % 5 + 1)) for k in range(200)]
    rows += [(500, "en", None), (501, "en", ""), (None, None, "you moron"), (502, "xx", "plain " * 50_000), (502, "xx", "plain " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(k, 1, toxic(k)) for k in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id bigint, quality int, toxic int")
    return docs, labels


def test_nulls_long_texts_and_languages(spark):
    docs, labels = small(spark, lambda k: int(k % 4 == 0))
    out = toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()
    assert len(out) == docs.count()
    by_id = {r.doc_id: r for r in out}
    assert all(by_id[k].predicted == int(k % 4 == 0) for k in range(200))
    assert by_id[500].score == by_id[501].score < 0.5 and by_id[502].predicted == 0 and by_id[None].predicted == 1


def test_thresholds_cover_labels_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_PER_CLASS", 20)
    kinds = spark.range(600).selectExpr("id", "xxhash64(id) AS h", "crc32(string(id)) % 5 = 0 AS held").orderBy("h", "id").collect()
    usable = [r.id for r in kinds if not r.held]
    toxic = {k: int(k % 2) for k in range(600)}
    # The first 20 of each label by hash are the sample; a rare language comes only after them, and is noisy.
    later = [k for t in (0, 1) for k in [i for i in usable if toxic[i] == t][20:]]
    rare = set(sorted(later)[::3])
    text = lambda k: f"{'you moron ' if (toxic[k] if k not in rare or k % 10 else 1 - toxic[k]) else ''}some plain words {k}"
    docs = spark.createDataFrame([(k, "yy" if k in rare else "en", text(k)) for k in range(600)], "doc_id bigint, lang string, text string")
    labels = spark.createDataFrame([(k, 1, toxic[k]) for k in range(600)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, labels)
    assert set(model.thresholds) == {"en", "yy"}
    rows = [r for r in toxicity.score_toxicity(docs, model).collect() if r.doc_id in rare]
    f1 = lambda limit: 2 * sum(r.score >= limit and toxic[r.doc_id] for r in rows) / (sum(r.score >= limit for r in rows) + sum(toxic[r.doc_id] for r in rows))
    assert f1(model.thresholds["yy"]) >= max(f1(r.score) for r in rows) - 0.02


def test_one_label_only_and_empty_tables(spark):
    docs, labels = small(spark, lambda k: 0)
    assert {r.score for r in toxicity.score_toxicity(docs, toxicity.fit_toxicity(docs, labels)).collect()} == {0.0}
    model = toxicity.fit_toxicity(docs, labels.limit(0))
    assert {r.score for r in toxicity.score_toxicity(docs, model).collect()} == {0.0}
    assert toxicity.score_toxicity(docs.limit(0), model).collect() == []
