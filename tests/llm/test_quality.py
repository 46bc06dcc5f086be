"""Boosting: every split against all splits tried on every row."""

import numpy as np
import pytest

from veilmark.llm import quality


def checked(model, x, y, depth, bins, rate, l2, least):
    """Every split of ``model`` gains as much as the best of all splits of its rows, every leaf is the second-order step, and
    the scores are the sums of the leaves. How many nodes were split."""
    cuts = [sorted({float(np.quantile(column, k / bins)) for k in range(1, bins)}) for column in x.T]
    total, n = np.full(len(y), model.base), 0
    for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, np.maximum(p * (1 - p), 1e-9)
        value = lambda part: g[part].sum() ** 2 / (h[part].sum() + l2) if len(part) else 0.0  # noqa: B023, E731
        nodes = [(0, np.arange(len(y)))]
        for node, rows in nodes:
            if node >= len(feature):  # a leaf
                step = -rate * g[rows].sum() / (h[rows].sum() + l2) if len(rows) else 0.0
                assert leaf[node - len(feature)] == pytest.approx(step, abs=1e-12)
                total[rows] += step
                continue
            tried = [0.0]
            for f, column in enumerate(cuts):
                for cut in column:
                    left, right = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if min(len(left), len(right)) >= least:
                        tried.append(value(left) + value(right) - value(rows))
            low = x[rows, feature[node]] <= threshold[node]
            if np.isfinite(threshold[node]):
                n += 1
                assert threshold[node] in cuts[feature[node]] and min(low.sum(), (~low).sum()) >= least
                assert value(rows[low]) + value(rows[~low]) - value(rows) == pytest.approx(max(tried), abs=1e-9)
            else:
                assert max(tried) <= 1e-6 + 1e-9 and low.all()
            nodes += [(2 * node + 1, rows[low]), (2 * node + 2, rows[~low])]
    assert model.score(x) == pytest.approx(1 / (1 + np.exp(-total)), abs=1e-9)
    return n


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("options", [{"trees": 4, "depth": 2, "bins": 8, "rate": 0.3, "l2": 1.0, "least": 5}, {"trees": 3, "depth": 3, "bins": 16, "rate": 0.15, "l2": 0.1, "least": 1}])
def test_trees_are_those_of_an_exhaustive_search(seed, options):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(70, 3))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(scale=0.5, size=70) > 0.3).astype(float)
    model = quality.train(x, y, **options)
    assert model.base == pytest.approx(np.log((y.sum() + 0.5) / (len(y) + 0.5 - y.sum())))
    trees = options["trees"]
    assert len(model.feature) == trees and checked(model, x, y, **{k: v for k, v in options.items() if k != "trees"}) > trees


def test_a_constant_feature_and_too_few_rows_split_nothing():
    y = np.array([0.0, 1.0] * 10)
    model = quality.train(np.ones((20, 2)), y, trees=3)
    assert set(model.score(np.ones((20, 2))).round(12)) == {0.5}
    assert len(set(quality.train(np.arange(20.0).reshape(-1, 1), y, trees=2, least=11).score(np.arange(20.0).reshape(-1, 1)).round(12))) == 1
