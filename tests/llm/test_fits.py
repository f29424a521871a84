"""Fitted models against their definitions: expectation-maximisation, discounts, patterns."""

import math
import random

import numpy as np
import pytest

from tonespan.llm import katz, packing, quality


def test_posteriors_equal_a_sequential_expectation_maximisation():
    """Document by document, from the definition: hidden class, votes independent given it."""
    rng = random.Random(1)
    rules, bad = len(quality.RULES), len(quality.BAD_RULES)
    docs = []
    for _ in range(400):
        good = rng.random() < 0.7
        votes = [quality.BAD if k < bad and rng.random() < (0.05 if good else 0.45) else quality.GOOD if k >= bad and rng.random() < (0.7 if good else 0.1) else quality.ABSTAIN for k in range(rules)]
        docs.append((good, votes))
    p = []
    for _, v in docs:
        p.append(0.1 if quality.BAD in v else 0.9 if quality.GOOD in v else 0.5)
    for _ in range(300):
        g, b = sum(p), len(p) - sum(p)
        rate = []
        for k in range(rules):
            spoke = [v[k] != quality.ABSTAIN for _, v in docs]
            own_bad = k < bad
            on_good = (sum(x for x, s in zip(p, spoke, strict=True) if s) + (0.04 if own_bad else 1.0)) / (g + 2)
            on_bad = (sum(1 - x for x, s in zip(p, spoke, strict=True) if s) + (1.0 if own_bad else 0.04)) / (b + 2)
            rate.append((on_good, on_bad))
        share = (g + 1) / (len(p) + 2)
        new = []
        for _, v in docs:
            a, z = share, 1 - share
            for (on_good, on_bad), vote in zip(rate, v, strict=True):
                a *= on_good if vote != quality.ABSTAIN else 1 - on_good
                z *= on_bad if vote != quality.ABSTAIN else 1 - on_bad
            new.append(a / (a + z))
        p = new
    votes = np.array([v for _, v in docs])
    codes = quality.pattern_codes(votes)
    distinct, weight = np.unique(codes, return_counts=True)
    found = dict(zip(distinct.tolist(), quality.fit(quality.pattern_votes(distinct), weight.astype(float)).tolist(), strict=True))
    assert np.allclose([found[c] for c in codes.tolist()], p, atol=1e-6)
    # and what it finds is the class that made the votes
    assert np.mean([(found[c] >= 0.5) == good for c, (good, _) in zip(codes.tolist(), docs, strict=True)]) > 0.93


def test_discounts_follow_from_the_counts_of_counts():
    n = np.array([0, 5000, 1800, 900, 560, 390, 290, 4000])  # of counts 1 to 6, and larger
    found = katz.discounts(n, 40_000)
    k = katz.GOOD_TURING
    rest = (k + 1) * n[k + 1] / n[1]
    for r in range(1, k + 1):
        turing = (r + 1) * n[r + 1] / n[r]  # the count that r stands for
        assert found.factor[r] == pytest.approx((turing / r - rest) / (1 - rest)) and 0 < found.factor[r] < 1
    # what small counts lose is what unseen ones are due: n1 occurrences
    assert sum(n[r] * (1 - found.factor[r]) * r for r in range(1, k + 1)) == pytest.approx(n[1])
    counts = np.array([0, 1, 3, 6, 100])
    assert np.allclose(found.of(counts)[1:] * counts[1:], [found.factor[1], 3 * found.factor[3], 5.5, 99.5])
    assert found.types == n.sum() and found.unknown == pytest.approx((n[1] + 0.5 * (n[6] + n[7])) / 40_000)
    few = katz.discounts(np.array([0, 3, 0, 0, 0, 0, 0, 1]), 10)
    assert all(0 < f < 1 for f in few.factor[1:])


@pytest.mark.parametrize("seed", range(4))
def test_pattern_counts_meet_the_conditions_of_a_least_squares_minimum(seed):
    """Whatever the solver: no count is negative, and no change of one count makes the
    distance smaller."""
    rng = np.random.default_rng(seed)
    rows = 40
    pattern = np.repeat(np.arange(60), 3)
    length = rng.integers(0, rows, len(pattern))
    target = rng.poisson(30, rows).astype(float)
    x = packing.nnls(pattern, length, target)
    a = np.zeros((rows, 60))
    np.add.at(a, (length, pattern), 1)
    slope = a.T @ (a @ x - target)
    size = np.linalg.norm(target)
    assert (x >= 0).all() and (slope > -1e-3 * size).all() and np.abs(slope[x > 1e-6]).max() < 1e-3 * size
    best = np.linalg.norm(a @ x - target)
    for _ in range(200):
        other = np.maximum(0, x + rng.normal(0, 0.5, 60))
        assert np.linalg.norm(a @ other - target) >= best - 1e-6 * size
    assert math.isfinite(best)
