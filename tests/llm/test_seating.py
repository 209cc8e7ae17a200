"""Table counts against their exact law and against single-customer Gibbs moves."""

import random

import numpy as np
import pytest

from perimeter.llm import seating


def exact(n, a, d, most):
    """Mean tables by the recursion of the weights S(m, t) * a^t, scaled as it goes."""
    w = np.zeros(most + 1)
    w[1] = 1.0
    t = np.arange(most + 1)
    for m in range(1, n):
        w = w * (m - d * t).clip(0) + a * np.concatenate(([0.0], w[:-1]))
        w /= w.sum()
    return (w * t).sum(), np.sqrt((w * t * t).sum() - (w * t).sum() ** 2)


@pytest.mark.parametrize("d", [0.3, 0.6, 0.85])
@pytest.mark.parametrize("n,a", [(2, 0.5), (10, 0.1), (10, 3.0), (90, 5.0), (200, 1.0), (1000, 0.01), (1000, 2.0), (1000, 60.0), (20_000, 0.01), (20_000, 1.0), (20_000, 500.0)])
def test_mean_tables(n, a, d):
    mean, sd = exact(n, a, d, min(n, 12_000))
    law, many = seating.law(d), 4000
    got = law.draw(np.full(many, n), np.full(many, np.log(a)), seating.mix(np.arange(many, dtype=np.uint64)), 3)
    assert got.min() >= 1 and got.max() <= n
    assert abs(got.mean() - mean) < 5 * sd / many ** 0.5 + 0.02 * mean
    assert abs(got.std() - sd) < 0.1 * sd + 0.05


def test_against_gibbs_moves():
    """A long chain of single customers that leave and sit down again has the same mean."""
    rng, n, a, d = random.Random(4), 40, 1.5, 0.5
    tables, total, moves = [n], 0, 60_000
    for _ in range(moves):
        i = rng.choices(range(len(tables)), tables)[0]
        tables[i] -= 1
        if not tables[i]:
            tables.pop(i)
        i = rng.choices(range(len(tables) + 1), [x - d for x in tables] + [a])[0]
        if i == len(tables):
            tables.append(0)
        tables[i] += 1
        total += len(tables)
    got = seating.law(d).draw(np.full(8000, n), np.full(8000, np.log(a)), seating.mix(np.arange(8000, dtype=np.uint64)), 0)
    assert abs(got.mean() - total / moves) < 0.05 * got.mean()


def test_gamma():
    h = seating.mix(np.arange(50_000, dtype=np.uint64))
    for k in (0.3, 1.0, 7.5, 400.0):
        x = seating.gamma(np.full(len(h), k), h, 5)
        assert abs(x.mean() / k - 1) < 0.04 and abs(x.var() / k - 1) < 0.1
