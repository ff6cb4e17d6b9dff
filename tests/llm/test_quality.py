"""The robust estimate of the quality rules beside a slow one."""

from __future__ import annotations

import numpy as np
import pytest

from kilnworks.llm import quality

DIMS = len(quality.STATS)
NAMES = list(quality.STATS)
FLOORS = np.diag([(quality.SCALE * least) ** 2 for least in quality.STATS.values()])


def covariance(rows: np.ndarray) -> np.ndarray:
    return quality.CONSISTENCY * np.cov(rows.T, bias=True) + FLOORS


def slow_determinant(rows: np.ndarray, starts: int = 300, seed: int = 5) -> tuple[float, np.ndarray]:
    """Least log determinant of exact cores of 3 / 4, from many random small sets."""
    random, size = np.random.default_rng(seed), int(quality.CORE * len(rows))
    best, centre = np.inf, np.zeros(DIMS)
    for _ in range(starts):
        core = rows[random.choice(len(rows), DIMS + 1, replace=False)]
        last = np.inf
        while True:
            inverse = np.linalg.inv(covariance(core))
            off = rows - core.mean(0)
            core = rows[np.argsort(np.einsum("ij,jk,ik->i", off, inverse, off), kind="stable")[:size]]
            now = np.linalg.slogdet(covariance(core))[1]
            if now > last - 1e-9:
                break
            last = now
        if last < best:
            best, centre = last, core.mean(0)
    return best, centre


def mixture(seed: int, far: float) -> np.ndarray:
    """Correlated rows, and a tight knot of others off their axis."""
    random = np.random.default_rng(seed)
    mixing = random.normal(size=(DIMS, DIMS)) * 900
    good = random.normal(size=(1600, DIMS)) @ mixing
    axis = np.linalg.svd(mixing)[2][-1]
    knot = random.normal(size=(400, DIMS)) * 150 + axis * far
    return np.round(np.concatenate([good, knot]) + 5000).astype(int)


def table(spark, groups: dict[str, np.ndarray]):
    rows = [(name, *map(int, row)) for name, values in groups.items() for row in values]
    return spark.createDataFrame(rows, ["_group", *NAMES]).repartition(7)


def test_estimates_reach_the_determinant_of_many_random_starts(spark):
    groups = {f"g{seed}": mixture(seed, far) for seed, far in ((1, 4000), (2, 9000), (3, 15000))}
    found, n_groups = quality.estimates(table(spark, groups))
    assert n_groups == 3
    for row in found.collect():
        least, centre = slow_determinant(groups[row["_group"]], 60)
        assert row["_logdet"] <= least + 0.05
        spread = np.sqrt(np.diag(covariance(groups[row["_group"]][:1600])))
        assert np.all(np.abs([row[f"_m{i}"] for i in range(DIMS)] - centre) < 0.15 * spread)


def test_estimates_do_not_depend_on_the_partitions(spark):
    rows = table(spark, {"a": mixture(4, 9000), "b": mixture(5, 5000)})
    one, other = (
        {r["_group"]: tuple(r) for r in quality.estimates(rows.repartition(n))[0].collect()} for n in (1, 13)
    )
    assert one == other


def test_rows_that_break_a_correlation_alone_are_far(spark):
    random = np.random.default_rng(8)
    along = random.normal(size=(600, 1)) * 3000
    rows = 5000 + along * np.ones(DIMS) + random.normal(size=(600, DIMS)) * 20
    rows[:20, 1] = 5000 - along[:20, 0]  # no component of theirs is unusual
    rows[:20, 1] += np.where(np.abs(along[:20, 0]) < 2500, 9000, 0)
    data = table(spark, {"g": np.round(rows).astype(int)})
    estimate, n = quality.estimates(data)
    judged = quality._with_distance(data, estimate, n)
    assert judged.where(judged["_d2"] > quality.FARTHEST).count() == 20


@pytest.mark.parametrize("values", [[], [[7] * DIMS], [[7] * DIMS] * 300])
def test_groups_without_any_spread(spark, values):
    data = table(spark, {"g": np.array(values)}) if values else spark.createDataFrame(
        [], "_group string, " + ", ".join(f"{c} long" for c in NAMES)
    )
    found = quality.estimates(data)[0].collect()
    assert len(found) == bool(values)
    for row in found:
        assert [row[f"_m{i}"] for i in range(DIMS)] == pytest.approx([7.0] * DIMS)
        assert row["_logdet"] == pytest.approx(np.linalg.slogdet(FLOORS)[1])
