"""The sample that toxicity is learnt from, and the fit beside one by finite differences."""

from __future__ import annotations

import numpy as np

from kilnworks.llm import toxicity


def loss(bias: float, theta: np.ndarray, rows, labels, weights) -> float:
    total = 0.0
    for hit, label, weight in zip(rows, labels, weights):
        y = bias + sum(theta[i, 0] for i in hit)
        for at, i in enumerate(hit):
            for j in hit[:at]:
                y += float(theta[i, 1:] @ theta[j, 1:])
        y = y if label else -y
        total += weight * np.log1p(np.exp(-y))
    return total / sum(weights)


def test_fit_ends_where_the_loss_is_lower_in_no_direction():
    random = np.random.default_rng(3)
    rows = [np.flatnonzero(random.random(6) < 0.4) for _ in range(80)]
    labels = np.array([float({0, 1} <= set(r) or random.random() < 0.1) for r in rows])
    weights = np.where(labels > 0, 2.0, 1.0)
    bias, theta = toxicity.fit(rows, labels, weights, 6)

    def cost(b: float, t: np.ndarray) -> float:
        return loss(b, t, rows, labels, weights) + toxicity.DECAY / 2 * float((t**2).sum())

    assert cost(bias, theta) < 0.7 * cost(0.0, np.zeros_like(theta))
    step, slopes = 1e-5, []
    for at in np.ndindex(theta.shape):
        up, down = theta.copy(), theta.copy()
        up[at] += step
        down[at] -= step
        slopes.append((cost(bias, up) - cost(bias, down)) / (2 * step))
    slopes.append((cost(bias + step, theta) - cost(bias - step, theta)) / (2 * step))
    assert np.abs(slopes).max() < 5e-3


def test_an_id_of_many_rows_is_one_row_of_the_sample(spark):
    texts = [(i, f"you dreadful person {i % 7}" if i % 3 == 0 else f"a calm walk {i % 11}", i % 3) for i in range(300)]
    docs = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(k == 0)) for i, _, k in texts], "doc_id long, toxic int")
    hot = spark.range(3000).selectExpr("7L AS doc_id", "'a calm walk 7' AS text")
    plain, repeated = toxicity.train(docs, labels), toxicity.train(docs.union(hot), labels)
    assert plain.place == repeated.place and plain.bias == repeated.bias
    assert np.array_equal(plain.theta, repeated.theta)
    # Rows of one id that differ: the text of the least hash stands, in any order.
    other = spark.createDataFrame([(7, None), (7, ""), (7, "you dreadful person")], "doc_id long, text string")
    one, two = toxicity.train(docs.union(other), labels), toxicity.train(other.union(docs).repartition(5), labels)
    assert one.place == two.place and np.array_equal(one.theta, two.theta)
