"""The packing solver against enumeration, and a token that nests too deep."""

import base64
import itertools

import numpy as np
import pytest

from variantlake.llm import cutting_stock, secret_scan


def test_best_pattern_is_the_best():
    rng = np.random.default_rng(1)
    for _ in range(30):
        values, capacity = rng.normal(0.3, 0.4, 5), 9
        best = 0.0
        for counts in itertools.product(range(10), repeat=5):
            if sum(n * (c + 1) for c, n in enumerate(counts)) <= capacity:
                best = max(best, float(np.dot(counts, values)))
        worth, pattern = cutting_stock.best_pattern(values, capacity)
        assert worth == pytest.approx(best) == pytest.approx(float(pattern @ values))
        assert (pattern * np.arange(1, 6)).sum() <= capacity


def test_inverse():
    rng = np.random.default_rng(2)
    for n in (1, 2, 50, 128):
        m = rng.integers(0, 4, (n, n)) + 3 * np.eye(n)
        assert np.allclose((m[:, :, None] * cutting_stock.inverted(m)[None]).sum(axis=1), np.eye(n), atol=1e-6)


@pytest.mark.parametrize("seed", range(4))
def test_plans_meet_demand_near_the_bound(seed):
    rng = np.random.default_rng(seed)
    demand, capacity = rng.integers(0, 3000, 128), 128
    relaxed = cutting_stock.solve(demand, capacity)
    assert np.allclose(sum(p * x for p, x in relaxed), demand, atol=1e-3 * demand.max())
    plan = cutting_stock.integral(demand, capacity)
    assert (sum(p * n for p, n in plan) == demand).all()
    sizes = np.arange(1, 129)
    assert all((p * sizes).sum() <= capacity for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.05 * (demand * sizes).sum() / capacity + 130
    assert cutting_stock.integral(np.zeros(128, int), capacity) == []


def test_a_token_that_nests_too_deep_is_none():
    deep = base64.urlsafe_b64encode(b'{"a":' + b"[" * 200_000).decode().rstrip("=")
    good = base64.urlsafe_b64encode(b'{"a":1}').decode().rstrip("=")
    kinds = lambda text: [k for k, _, _ in secret_scan.scan(text) if k == "webtoken"]
    assert kinds(f"{deep}.{good}.{'x' * 20}") == [] and kinds(f"{good}.{good}.{'x' * 20}") == ["webtoken"]
