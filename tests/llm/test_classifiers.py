"""Toxicity and language identification: kernels, held-out accuracy, odd rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loglattice.llm import langid, toxicity


def test_cumulative_link_orders_grades():
    rng = np.random.default_rng(0)
    rows = [np.flatnonzero(rng.random(6) < 0.5).astype(np.int32) for _ in range(900)]
    grades = np.array([min(3, (0 in r) + (1 in r) + (2 in r)) for r in rows])
    row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    weights, cuts = toxicity.fit_cumulative(row, column, grades, 6, 3, 400)
    assert (np.diff(cuts) > 0).all() and weights[:3].min() > 3 * np.abs(weights[3:]).max()
    model = toxicity.Model({str(j): w for j, w in enumerate(weights)}, cuts.tolist())
    found = [model.severity(sum(weights[j] for j in r))[1] for r in rows]
    assert np.mean(np.array(found) == grades) > 0.97


def likelihood(weights, cuts, rows, grades, ridge, lasso):
    """The penalised log-likelihood, row by row."""
    total = -ridge / 2 * float(weights @ weights) - lasso * float(np.abs(weights).sum())
    for row, grade in zip(rows, grades, strict=True):
        passed = [1.0, *(1 / (1 + np.exp(c - weights[row].sum())) for c in cuts), 0.0]
        total += np.log(passed[grade] - passed[grade + 1])
    return total


def test_cumulative_link_is_the_most_likely():
    """No step away from the fit is more likely, in any weight or threshold."""
    rng = np.random.default_rng(7)
    rows = [np.flatnonzero(rng.random(5) < 0.4).astype(np.int32) for _ in range(300)]
    score = np.array([1.5 * (0 in r) + 0.7 * (1 in r) for r in rows]) + rng.logistic(size=300)
    grades = np.array([int(s > 0.5) + int(s > 1.5) + int(s > 2.5) for s in score])
    row, column = np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate(rows)
    weights, cuts = toxicity.fit_cumulative(row, column, grades, 5, 3, 4000, ridge=0.5, lasso=0.0, free=np.ones(5, bool))
    best = likelihood(weights, cuts, rows, grades, 0.5, 0.0)
    for k in range(5):
        for step in (-0.05, 0.05):
            assert likelihood(weights + step * np.eye(5)[k], cuts, rows, grades, 0.5, 0.0) < best + 1e-3
    for k in range(3):
        for step in (-0.05, 0.05):
            assert likelihood(weights, cuts + step * np.eye(3)[k], rows, grades, 0.5, 0.0) < best + 1e-3


def test_severity_by_hand(spark):
    """Scores of a stated model, from the words and their beginnings."""
    model = toxicity.Model({"awful": 2.0, "awf*": 0.5, "#2": -0.25, "#1": 0.125}, [1.0, 2.0, 3.0])
    texts = [(1, "Awful day"), (2, "awfully bad day"), (3, "nice"), (4, None), (5, "awful awful\tAWFUL")]
    found = {r.doc_id: r for r in toxicity.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    scores = {1: 2.0 + 0.5 - 0.25, 2: 0.5 - 0.25, 3: 0.125, 5: 2.0 + 0.5 + 0.125}
    for k, score in scores.items():
        passed = [1 / (1 + np.exp(c - score)) for c in (1.0, 2.0, 3.0)]
        assert found[k].expected_severity == pytest.approx(sum(passed)) and found[k].grade == sum(p >= 0.5 for p in passed)
    assert found[4].expected_severity == 0.0 and found[1].toxic and not found[3].toxic


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.col("doc_id") % 4 == 3
    model = toxicity.fit(docs, labels.where(~held))
    scored = toxicity.predict(docs, model).withColumnRenamed("toxic", "flag").join(labels.where(held), "doc_id").select("toxic", "flag", "expected_severity", "grade").toPandas()
    assert scored[scored.toxic == 1].flag.mean() > 0.9 and scored[scored.toxic == 0].flag.mean() < 0.002
    assert scored.expected_severity.between(0, 3).all() and (scored[scored.flag].grade >= 0).all()


def test_toxicity_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (6, 0), (7, 1), (None, 1), (9, None), (999, 1)], "doc_id long, toxic int")
    model = toxicity.fit(odd_docs, labels)
    found = toxicity.predict(odd_docs, model).collect()
    assert len(found) == 13 and all(0 <= r.expected_severity <= 3 for r in found)
    assert {(r.expected_severity, r.grade) for r in found if r.doc_id in (3, 4, 5)} == {(0.0, 0)}
    empty = toxicity.fit(odd_docs, labels.limit(0))
    assert not any(r.toxic for r in toxicity.predict(odd_docs, empty).collect()) and toxicity.predict(no_docs, empty).count() == 0
    kept = toxicity.keep_civil(odd_docs, empty)
    assert kept.schema == odd_docs.schema and kept.count() == 13


def brute_force(emitted, step):
    """Chances of each word by summing over all labellings."""
    n, width = emitted.shape
    out = np.zeros((n, width))
    for labels in itertools.product(range(width), repeat=n):
        p = (step[:, labels[0]].sum() / width) * np.exp(emitted[0, labels[0]])
        for k in range(1, n):
            p *= step[labels[k - 1], labels[k]] * np.exp(emitted[k, labels[k]])
        for k, label in enumerate(labels):
            out[k, label] += p
    return out / out.sum(axis=1, keepdims=True)


def test_forward_backward(monkeypatch):
    rng = np.random.default_rng(1)
    monkeypatch.setattr(langid, "BLOCK", 3)
    step = np.exp(rng.normal(size=(3, 3)))
    texts = [rng.normal(size=(n, 3)).astype(np.float32) for n in (1, 7, 3, 2, 6)]
    for found, one in zip(langid.chances_of(texts, step), texts, strict=True):
        assert np.allclose(found, brute_force(one, step), atol=1e-6)
    mean, sure = langid.mean_chances(texts, step)
    assert np.allclose(mean[1], brute_force(texts[1], step).mean(axis=0), atol=1e-6)
    assert sure[1] == pytest.approx(brute_force(texts[1], step).max(axis=1).mean(), abs=1e-6)
    chance, pairs = langid.expectations(np.stack([texts[1]]).astype(float), step)
    assert np.allclose(chance[0], brute_force(texts[1], step), atol=1e-9) and pairs.sum() == pytest.approx(6)


def test_language_held_out_and_switching(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs)
    found = langid.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(found) > 200 and (found.lang == found.lang_pred).mean() > 0.98 and found.score.between(0, 1).all()
    one, two = (docs.where((F.col("lang") == lang) & (F.col("n_chars") > 1500)).orderBy("doc_id").first().text for lang in ("en", "de"))
    first, second = ([w for w in text.split() if langid.letters(w)][:30] for text in (one, two))
    mixed = " ".join(first + second)
    words = langid.Labeller(model).words(mixed)
    assert sum(k == "en" for _, k in words[:30]) >= 25 and sum(k == "de" for _, k in words[-30:]) >= 25
    three = "\t".join([*first[:18], *second[:14], *[w for w in docs.where("lang = 'fr' and n_chars > 1500").orderBy("doc_id").first().text.split() if langid.letters(w)][:8]])
    assert langid.keep_identified(spark.createDataFrame([(1, three, "x"), (2, "4711 ???", "x")], "doc_id long, text string, lang string"), model).collect()[0].doc_id == 1
    assert langid.Labeller(model).label([three])[0][1] < 0.5 < langid.Labeller(model).label([three])[0][2]
    sample = langid.training_texts(docs, per_language=5, languages=2, chars=100)
    assert sample == langid.training_texts(docs.repartition(7), per_language=5, languages=2, chars=100)
    assert len(sample) == 10 and len({lang for lang, _ in sample}) == 2 and max(len(t) for _, t in sample) <= 100


def test_held_out_rule(spark):
    import zlib

    df = spark.range(200).select(F.col("id").alias("doc_id")).withColumn("h", langid.held_out())
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.collect())


def test_language_odd_rows(spark, odd_docs, no_docs):
    model = langid.fit(odd_docs)
    assert set(model.languages) <= {"en", "de", "ja"}
    found = {r.doc_id: r for r in langid.predict(odd_docs, model).collect()}
    assert [found[k].lang_pred for k in (3, 4, 5, -5)] == ["und"] * 4 and found[3].score == 0 and found[None].held_out is False
    assert langid.predict(no_docs, model).count() == 0 and langid.fit(no_docs).languages == []
    assert {r.lang_pred for r in langid.predict(odd_docs, langid.fit(no_docs)).collect()} == {"und"}
    assert langid.keep_identified(odd_docs, langid.fit(no_docs)).count() == 13
    kept = langid.keep_identified(odd_docs, model)
    assert kept.schema == odd_docs.schema and kept.where("doc_id in (3, 4, 5)").count() == 0
