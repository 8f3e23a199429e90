"""Shares, caps, balance of the sampling; token counts."""

import numpy as np
import pytest

from skein.llm import mixing as m

DOCS = "doc_id bigint, source string, text string, share double"
TARGETS = "source string, target_share double, max_repeats int, extra int"


def documents(spark, sizes):
    rows = [(k, s, None if n is None else "word " * n, 0.5) for k, (s, n) in enumerate(sizes)]
    return spark.createDataFrame(rows, DOCS)


def test_shares_and_caps(spark):
    rng = np.random.default_rng(0)
    docs = documents(spark, [("a", int(x)) for x in rng.integers(1, 60, 400)] + [("b", int(x)) for x in rng.integers(1, 60, 60)] + [("c", 5)] * 9 + [(None, 4), ("b", None), ("b", 0), ("z", 7)])
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.4, 3, 0), ("none", 0.1, 2, 0), ("c", 0.0, 5, 0), (None, 0.1, 1, 0)], TARGETS)
    sizes = m.document_sizes(docs)
    plan = m.mix_plan(sizes, targets)
    mix = m.balanced_mix(sizes, plan, block=50)
    assert mix.where("copies > 3 or (source = 'a' and copies > 1)").count() == 0
    report = {r.source: r for r in m.share_report(mix, plan).collect()}
    assert abs(report["a"].actual_share - 5 / 9) < 0.01 and abs(report["b"].actual_share - 4 / 9) < 0.01
    assert report["none"].actual_share == 0 and report["none"].target_share == 0.1 and report["z"].used_documents == 0 and report[None].documents == 1
    assert mix.groupBy("doc_id").count().where("count > 1").count() == 0
    again = m.balanced_mix(sizes, plan, block=50)
    assert sorted(map(tuple, mix.collect())) == sorted(map(tuple, again.collect()))
    small = m.share_report(m.balanced_mix(sizes, m.mix_plan(sizes, targets, 900)), m.mix_plan(sizes, targets, 900))
    assert abs(sum(r.mix_tokens for r in small.collect()) - 900) < 60


def test_many_rounds(spark):
    docs = documents(spark, [("a", 1 + k % 37) for k in range(3000)] + [("b", 40)] * 30)
    targets = spark.createDataFrame([("a", 0.8, 1, 0), ("b", 0.2, 4, 0)], TARGETS)
    sizes = m.document_sizes(docs)
    plan = m.mix_plan(sizes, targets)
    report = {r.source: r for r in m.share_report(m.balanced_mix(sizes, plan, block=20), plan).collect()}
    assert abs(report["a"].actual_share - 0.8) < 0.005


def test_long_documents_land_near(spark):
    """A source far smaller than the largest is landed in its own round, so that a long document does no harm."""
    rng = np.random.default_rng(5)
    sizes = [("big", int(x)) for x in rng.integers(5, 60, 600)] + [("small", int(x)) for x in rng.integers(5, 60, 80)] + [("small", 900), ("big", 900)]
    targets = spark.createDataFrame([("big", 0.8, 1, 0), ("small", 0.2, 1, 0)], TARGETS)
    sizes = m.document_sizes(documents(spark, sizes))
    plan = m.mix_plan(sizes, targets, 9_000)
    report = {r.source: r for r in m.share_report(m.balanced_mix(sizes, plan, block=200), plan).collect()}
    assert abs(report["small"].mix_tokens - 1800) <= 5 and abs(report["big"].mix_tokens - 7200) <= 40


def test_empty(spark):
    none, targets = documents(spark, []), spark.createDataFrame([("a", 1.0, 1, 0)], TARGETS)
    for docs, t in ((none, targets), (documents(spark, [("a", 3)]), targets.limit(0)), (documents(spark, [("b", 3)]), targets), (documents(spark, [("a", 0)]), targets)):
        sizes = m.document_sizes(docs)
        plan = m.mix_plan(sizes, t)
        mix = m.balanced_mix(sizes, plan)
        assert mix.count() == 0
        assert all(r.actual_share == 0 for r in m.share_report(mix, plan).collect())


@pytest.mark.parametrize("seed", range(5))
def test_flight_keeps_totals(seed):
    rng = np.random.default_rng(seed)
    size, p = rng.integers(1, 9, 200).astype(float), rng.random(200)
    p[:20] = rng.integers(0, 2, 20)
    out = m.flight(p, size, rng)
    assert np.isclose(out.sum(), p.sum()) and np.isclose((out * size).sum(), (p * size).sum())
    assert ((out > 0) & (out < 1)).sum() <= 2 and (out[:20] == p[:20]).all()
    landed = m.land(out, size, float((out * size)[(out > 0) & (out < 1)].sum()))
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - (p * size).sum()) < 1.001


def test_inclusion_rates():
    """Over many draws each unit is included as often as its probability says."""
    size, p = np.arange(1.0, 13.0), np.full(12, 0.25)
    hits = np.mean([m.flight(p, size, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(hits - 0.25).max() < 0.035


def test_tokens(spark):
    df = spark.createDataFrame([("Hello world, hello again.",), ("",), (None,), ("<|endoftext|>",), ("é" * 5000,)], "t string")
    n = [r[0] for r in df.select(m.count_tokens(df["t"])).collect()]
    assert n[0] == 6 and n[1] == n[2] == 0 and n[3] > 1 and n[4] > 0
