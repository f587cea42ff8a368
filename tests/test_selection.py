"""Quantiles by selection and densities by moments, against plain computation."""

import math
import random

import numpy as np
import pytest

from planwise.operators import marks

SCHEMA = "g string, v double"


def _rows(seed=5):
    rng = random.Random(seed)
    rows = [(None, rng.choice([-1, 1]) * 10.0 ** rng.uniform(-320, 307)) for _ in range(400)]
    rows += [("close", 1.7e9 + rng.random()) for _ in range(700)]
    rows += [("ties", float(rng.randint(-2, 2))) for _ in range(900)]
    return rows + [("one", -0.0), ("zero", 0.0), ("zero", -0.0), ("gap", None), ("gap", float("nan")), ("gap", 7.0)]


@pytest.mark.parametrize("few", [0, 50, 200_000])
def test_selection_equals_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(marks, "FEW_ROWS", few)
    monkeypatch.setattr(marks, "SELECT_BINS", 16 if few else 4096)
    rows, probs = _rows(), (0.0, 0.1, 0.25, 0.5, 0.77, 1.0)
    got = {r["g"]: r for r in marks.exact_quantiles(spark.createDataFrame(rows, SCHEMA), "g", "v", probs).collect()}
    assert set(got) == {None, "close", "ties", "one", "zero", "gap"}
    for g, r in got.items():
        values = sorted(v for k, v in rows if k == g and v is not None and v == v)
        assert r["n"] == len(values)
        for i, p in enumerate(probs):
            at = p * (len(values) - 1)
            lo, hi = values[math.floor(at)], values[math.ceil(at)]
            assert r[f"q{i}"] == pytest.approx(lo if lo == hi else lo + (hi - lo) * (at - math.floor(at)), rel=1e-12, abs=0)


def test_selection_with_infinite_values_and_none(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", -inf), ("a", 1.0), ("a", inf), ("a", inf), ("a", inf), ("b", None)], SCHEMA)
    r = marks.exact_quantiles(df, "g", "v", (0.0, 0.25, 0.5, 1.0)).collect()
    assert [(x["g"], x["n"], x["q0"], x["q1"], x["q2"], x["q3"]) for x in r] == [("a", 5, -inf, 1.0, inf, inf)]
    assert marks.exact_quantiles(df.limit(0), "g", "v").count() == 0
    assert [(x["g"], x["x"], x["density"], x["flat"]) for x in marks.violin_density(df, "g", "v").collect()] == [("a", -inf, None, True)]


def test_box_runs_without_python_or_range_sort(spark):
    plan = marks.box_stats(spark.createDataFrame(_rows(), SCHEMA).selectExpr("g", "v"), "g", "v")._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan and "Python" not in plan and "rangepartitioning" not in plan.lower()


def test_violin_equals_the_sum_over_all_values(spark):
    rng = random.Random(6)
    rows = [("wide", rng.gauss(0, 1)) for _ in range(500)] + [("wide", v) for v in (1e3, 1e4, -5e4)]
    rows += [("two", 1.0), ("two", 1e6), (None, 3.0), (None, 3.5), (None, 3.5)]
    got = marks.violin_density(spark.createDataFrame(rows, SCHEMA), "g", "v", points=40).collect()
    assert len(got) == 120 and not any(r["flat"] for r in got)
    for g in ("wide", "two", None):
        v = np.array([x for k, x in rows if k == g])
        bw = v.std(ddof=1) * len(v) ** -0.2
        points = sorted((r["idx"], r["x"], r["density"]) for r in got if r["g"] == g)
        for _, x, density in points:
            exact = np.exp(-0.5 * ((x - v) / bw) ** 2).sum() / (len(v) * bw * math.sqrt(2 * math.pi))
            assert density == pytest.approx(exact, rel=1e-9, abs=1e-14 / bw)
