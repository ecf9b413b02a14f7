import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmill.llm import quality
from leafmill.llm.queries import op6_quality
from tests.llm.cases import HARD, empty, hard

LARGER = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    got = op6_quality(spark, LARGER).join(labels, "doc_id", "left").collect()
    held = [(r["score"], r["predicted"], r["quality"]) for r in got if r["held_out"] and r["quality"] is not None]
    assert len(held) > 80 and all(0 <= s <= 1 and p == (s >= 0.5) for s, p, _ in held)
    assert sum(p == q for _, p, q in held) / len(held) >= 0.9
    good, bad = ([s for s, _, q in held if q == k] for k in (1, 0))
    assert np.mean([[a > b for b in bad] for a in good]) >= 0.95


def test_risk_is_kept_from_below_zero():
    """With positives that are all of the unlabelled rows' good part, the fit finds the bad ones without a label of theirs."""
    rng = np.random.default_rng(4)
    good, bad = rng.normal(1, 1, (400, 5)).astype(np.float32), rng.normal(-1, 1, (600, 5)).astype(np.float32)
    w, b = quality.pu_fit(good[:200], np.concatenate([good[200:], bad]), 200 / 800)
    f = np.concatenate([good[200:], bad]) @ w + b
    assert np.isfinite(f).all() and np.mean((f > 0) == (np.arange(800) < 200)) > 0.9


def test_calibration_puts_half_between_the_classes():
    f, good = np.array([-3.0, -1.0, 4.0, 6.0]), np.array([False, False, True, True])
    scale, shift = quality.calibrated(f, good)
    assert (((f * scale + shift) > 0) == good).all() and quality.calibrated(f, np.ones(4, bool)) == (1.0, 0.0)


def test_features_do_not_depend_on_neighbours():
    texts = ["One TEXT here here.", "", "x", "ÄB 12\n\nc c c"]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    together = quality.features(buf, at)
    for t, x in zip(texts, together):
        alone = quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
        assert x == pytest.approx(alone)


def test_hard_cases(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (7, 1), (None, 1), (8, None)], "doc_id long, quality int")
    model = quality.fit(hard(spark), labels)
    got = quality.scores(hard(spark), model).collect()
    assert len(got) == len(HARD) and all(0 <= r["score"] <= 1 for r in got) and len({r["score"] for r in got if r["doc_id"] in (2, 3)}) == 1
    kept = quality.accepted(hard(spark), model)
    assert kept.columns == hard(spark).columns and kept.count() == sum(r["predicted"] for r in got)
    for none in (quality.fit(empty(spark), labels), quality.fit(hard(spark), labels.limit(0)), quality.fit(hard(spark), labels.withColumn("quality", F.lit(0)))):
        assert {r["score"] for r in quality.scores(hard(spark), none).collect()} == {0.5}
    assert quality.scores(empty(spark), model).count() == quality.accepted(empty(spark), model).count() == 0
