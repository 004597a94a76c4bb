"""Recall of the pivot index where a third of all vectors lies in one dense group."""

import math

import numpy as np
import pytest

from ridgeline.llm import pivots


def one_group(total: int, dim: int, cosine: float = 0.957) -> np.ndarray:
    rng = np.random.default_rng(dim)
    points = rng.normal(size=(total, dim))
    centre = rng.normal(size=dim)
    points[: total // 3] = centre / np.linalg.norm(centre) + math.sqrt((1 / cosine - 1) / dim) * rng.normal(size=(total // 3, dim))
    return points / np.linalg.norm(points, axis=1, keepdims=True)


def test_links_of_a_group_of_a_third(spark):
    points = one_group(30_000, 32)
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(points)], "vec_id long, embedding array<double>").repartition(8)
    got = {r["vec_id"]: r["n_links"] for r in pivots.link(table).collect()}
    sample = np.arange(0, 10_000, 25)
    exact = (points[sample] @ points.T >= 0.95).sum(axis=1) - 1
    found = np.asarray([got[k] for k in sample.tolist()])
    assert exact.mean() > 7000 and (found <= exact).all() and found.sum() >= 0.9 * exact.sum()


@pytest.mark.parametrize("dim", [32, 64, 128])
def test_members_of_a_larger_group_meet(dim):
    points = one_group(100_000, dim)
    rng = np.random.default_rng(1)
    sample = points[rng.permutation(len(points))[: 2 * math.isqrt(len(points))]]
    chosen = points[rng.permutation(len(points) // 3)[:1000]]
    reference = pivots.thinned(sample, 0.95)
    listed = np.zeros((len(chosen), len(reference)), np.float32)
    for k, lists in enumerate(pivots.posts(chosen, reference, 0.95)):
        listed[k, lists] = 1
    linked = chosen @ chosen.T >= 0.95
    assert (linked & (listed @ listed.T > 0)).sum() >= 0.9 * linked.sum()
