import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfgauge.llm import quality_model as qm


def test_isotonic_regression_pools_violators():
    rows = [(1, 1, 0.0), (2, 1, 1.0), (3, 2, 0.0), (4, 1, 1.0), (5, 1, 0.5)]
    assert qm.rising(rows) == [(1, 0.0), (2, 1 / 3), (3, 1 / 3), (4, 0.75), (5, 0.75)]


def test_features_approximate_the_kernel():
    x = np.random.default_rng(0).normal(size=(40, len(qm.NAMES)))
    z = qm.fourier(x, np.zeros(x.shape[1]), np.ones(x.shape[1]))[:, :-1]
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / (2 * qm.WIDTH**2))
    assert np.abs(z @ z.T - exact).max() < 0.35 and np.abs(z @ z.T - exact).mean() < 0.07


def test_summed_equations_equal_one_fit(spark):
    draw = np.random.default_rng(1)
    x = draw.normal(size=(300, len(qm.NAMES)))
    y = (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "x array<double>, y double").repartition(4)
    model = qm.Model(np.zeros(x.shape[1]), np.ones(x.shape[1]))
    qm._fit_ridge(model, rows)
    z = model.features(x.tolist())
    ridge = qm.RIDGE * len(x) * np.eye(z.shape[1]) / qm.FEATURES
    ridge[-1, -1] = 0
    assert np.allclose(z @ model.weights, z @ np.linalg.solve(z.T @ z + ridge, z.T @ y), atol=1e-6)


@pytest.fixture(scope="module")
def scored(spark, folder=None):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return qm.score_quality(docs, labels).join(labels, "doc_id").collect()


def plain_statistics(text):
    raw = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n = len(words) or 1
    count = lambda rule: len(re.findall(rule, raw))
    solid = sum(len(w) for w in words) or 1
    return [
        np.log(1 + len(words)),
        min(30.0, solid / n),
        len(set(words)) / n,
        sum(words[i] == words[i - 1] for i in range(1, len(words))) / n,
        count(rb"[A-Z]") / (count(rb"[A-Za-z]") or 1),
        count(rb"[0-9]") / solid,
        count(rb"[.,;:?]") / n,
        count(rb"[#*$%&<>@^~_=+\\{}\[\]]") / n,
        raw.count(b"|") / n,
        raw.count(b"!") / n,
        count(rb"[\x80-\xff]") / solid,
        np.log(1 + len(raw) / (raw.count(b"\n") + 1)),
    ]


def plain_scores(docs, labels):
    """Fit, calibration and scores by least squares and the min-max formula, all rows at once."""
    marks = {r.doc_id: r.quality for r in labels}
    x = np.array([plain_statistics(r.text) for r in docs])
    part = np.array([brute.fold(r.doc_id) for r in docs])
    y = np.array([marks.get(r.doc_id, np.nan) for r in docs], float)
    fit = ~np.isnan(y) & (part >= 1) & (part <= 3)
    scale = x[fit].std(axis=0)
    x = np.clip((x - x[fit].mean(axis=0)) / np.where(scale > 1e-9, scale, 1), -10, 10)
    directions, phases = qm.projection(x.shape[1])
    z = np.cos(x @ directions + phases) * np.sqrt(2 / qm.FEATURES)
    z = np.column_stack([z, np.ones(len(z))])
    penalty = np.sqrt(qm.RIDGE * fit.sum() / qm.FEATURES) * np.eye(z.shape[1])[:-1]
    weights = np.linalg.lstsq(np.vstack([z[fit], penalty]), np.append(y[fit], np.zeros(len(penalty))))[0]
    bins = np.clip(np.floor((z @ weights + 0.5) / 2 * qm.BINS), 0, qm.BINS - 1)
    check = ~np.isnan(y) & (part == 4)
    known = np.unique(bins[check])
    mean = lambda low, high: y[check & (bins >= low) & (bins <= high)].mean()
    steps = [max(min(mean(a, b) for b in known if b >= k) for a in known if a <= k) for k in known]
    return np.interp(bins, known, steps)


def test_whole_query_equals_a_plain_reading(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in rows), plain_scores(rows, labels.collect())))
    got = {r.doc_id: r for r in qm.score_quality(docs, labels).collect()}
    assert got.keys() == want.keys() and len(got) == len(rows)
    assert max(abs(got[i].score - want[i]) for i in want) < 1e-9
    assert all(got[i].predicted == (want[i] >= 0.3) for i in want)


def test_held_out_documents_are_ranked_right(scored):
    held = [r for r in scored if r.held_out]
    assert all(r.held_out == (brute.fold(r.doc_id) == 0) for r in scored)
    good, bad = ([r.score for r in held if r.quality == q] for q in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert area > 0.97
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)


def test_held_out_labels_and_other_columns_have_no_influence(spark):
    docs = spark.createDataFrame(
        [(i, ("good words here. " if i % 3 else "bad|bad|!! ") * (5 + i % 7), "l", "s") for i in range(400)],
        "doc_id long, text string, lang string, source string",
    ).repartition(1)
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 3 != 0, 1).otherwise(0).alias("quality"))
    held = qm.fold("doc_id") == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    changed = docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit(None).cast("string"))
    score = lambda d, l: {r.doc_id: round(r.score, 6) for r in qm.score_quality(d, l).collect()}
    assert score(docs, labels) == score(changed, flipped)


def test_nulls_repeats_and_no_labels(docs_of, spark):
    docs = docs_of((1, "a"), (1, "a"), (None, "a"), (2, None), (3, "b " * 50_000))
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = qm.score_quality(docs, none).collect()
    assert len(rows) == 5 and {r.score for r in rows} == {0.5}
    assert [r.held_out for r in rows if r.doc_id is None] == [False]
    odd = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1)], "doc_id long, quality int")
    assert len(qm.score_quality(docs, odd).collect()) == 5


def test_empty(docs_of, spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert qm.score_quality(docs_of("a").where("false"), labels).collect() == []
