import math
import random

import numpy as np
import pytest

from recallgrid.llm import spectral, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string, width string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "clash", "clash", "clash") for i, v in rows], SCHEMA)


def by_hand(rows, k=16):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in kept], object)
    fit = np.array(sorted({tuple(r) for r in x}), object)
    n, total = len(fit), fit.sum(axis=0)
    moved = (n * fit - total).astype(float) / n
    covariance = moved.T @ moved / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    whitened = (n * x - total).astype(float) / n @ axes / np.sqrt(values)
    deviation = ((n * x - total) ** 2).sum(axis=1)
    return [i for i, _ in kept], n, deviation, whitened, values / np.trace(covariance)


def test_whitening_equals_an_eigenvalue_solver(llm_spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(20, 20)) * np.linspace(0.05, 1, 20)
    rows = [(i, [float(c) for c in rng.normal(size=20) @ mix * 0.3]) for i in range(400)]
    rows += [(1000 + i, rows[i][1]) for i in range(30)] + [(5, rows[5][1]), (None, rows[7][1])]
    rows += [(2000, None), (2001, [1.0] * 19 + [None]), (2002, [float("nan")] * 20), (2003, [float("inf")] * 20)]
    ids, n, deviation, whitened, explained = by_hand(rows)
    made = whitening.by_component(whitening.whiten(table(llm_spark, rows).repartition(5))).collect()
    assert len(made) == len(ids) * 16
    known = {}
    for i, d, w in zip(ids, deviation, whitened, strict=True):
        known.setdefault(i, []).append((d, w))
    signs = {}
    for r in made:
        d, w = known[r.vec_id][0]
        value = w[r.component - 1]
        if abs(value) > 1e-3:
            signs.setdefault(r.component, set()).add(math.copysign(1, value * r.whitened))
        assert abs(abs(r.whitened) - abs(value)) < 1e-9
        assert (r.n, r.deviation) == (n, d)
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-10
        assert r.identity_error < 1e-9
    assert all(len(s) == 1 for s in signs.values())


def test_edges(llm_spark):
    assert whitening.whiten(table(llm_spark, [])).collect() == []
    one = whitening.by_component(whitening.whiten(table(llm_spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]))).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 0, None, 0.0)] * 4
    # Vectors of other lengths are fitted apart, and an empty one has no component.
    rows = [(1, []), (2, [1.0]), (3, [3.0]), (4, [0.0, 0.0]), (5, [1.0, 0.0]), (6, [0.0, 2.0])]
    made = whitening.by_component(whitening.whiten(table(llm_spark, rows))).collect()
    assert sorted((r.vec_id, r.n) for r in made) == sorted([(2, 2), (3, 2)] + [(i, 3) for i in (4, 5, 6)] * 2)
    # Flat directions have no whitened value; far means cost no digits.
    flat = [(i, [1000.0, float(i % 7), 5.0]) for i in range(50)]
    made = whitening.by_component(whitening.whiten(table(llm_spark, flat))).collect()
    assert {r.component: r.whitened is None for r in made} == {1: False, 2: True, 3: True}
    # Deviations are exact beyond floating point, and null beyond 64 bits.
    large = [(1, [2.0**30]), (2, [0.0]), (3, [-1.0])]
    made = {r.vec_id: r.deviation for r in whitening.whiten(table(llm_spark, large)).collect()}
    total = 2**36 - 64
    assert made[3] == (3 * -64 - total) ** 2 if (3 * -64 - total) ** 2 < 2**63 else made[3] is None


@pytest.mark.parametrize("kind", ["random", "equal", "low", "close", "zero"])
def test_leading_pairs(kind):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = {
        "random": rng.random(40),
        "equal": np.repeat([3.0, 2.0, 1.0, 0.5], 10),
        "low": np.r_[np.arange(5) + 1.0, np.zeros(35)],
        "close": 1 + np.arange(40) * 1e-9,
        "zero": np.zeros(40),
    }[kind]
    a = q * values @ q.T
    a = (a + a.T) / 2
    for wanted in (1, 16, 40):
        found, vectors = spectral.leading(a, wanted)
        np.testing.assert_allclose(found, np.sort(values)[::-1][:wanted], atol=1e-13)
        np.testing.assert_allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-12)
        np.testing.assert_allclose(a @ vectors, vectors * found, atol=1e-12)


def test_polar_factor_is_the_sign():
    rng = random.Random(5)
    q = np.linalg.qr(np.random.default_rng(5).normal(size=(12, 12)))[0]
    values = np.array([rng.choice([-1, 1]) * 10.0 ** -rng.randrange(12) for _ in range(12)])
    a = q * values @ q.T
    np.testing.assert_allclose(spectral.polar_factor((a + a.T) / 2), q * np.sign(values) @ q.T, atol=1e-3)
