"""Factors of new users against stored items."""

import numpy as np
import pytest

from earshot.operators.half_step import gram, half_step, solve_nonnegative
from earshot.operators.training import Params

P = Params(rank=4, regParam=0.1, alpha=3.0)


def by_hand(ratings, items, reg, alpha, nonnegative):
    """Slow coordinate descent on the whole objective, over all items."""
    ids = sorted(items)
    vecs = np.array([np.float32(items[i]) for i in ids], dtype=np.float64)
    seen = np.array([ratings.get(i, 0.0) for i in ids])
    weight = 1 + alpha * np.abs(seen)
    a = (vecs * weight[:, None]).T @ vecs + reg * (seen > 0).sum() * np.eye(vecs.shape[1])
    b = (weight * (seen > 0)) @ vecs
    if not nonnegative:
        return np.linalg.solve(a, b)
    x = np.zeros(len(b))
    for _ in range(20_000):
        for j in range(len(b)):
            x[j] = max(0.0, x[j] + (b[j] - a[j] @ x) / a[j, j])
    return x


def test_nonnegative_solutions_meet_the_optimality_conditions():
    rng = np.random.default_rng(2)
    for n in (1, 2, 7, 64):
        for _ in range(30):
            m = rng.normal(size=(n + 2, n))
            a, b = m.T @ m + 1e-3 * np.eye(n), rng.normal(size=n)
            x = solve_nonnegative(a, b)
            slope = a @ x - b
            assert (x >= 0).all() and (slope >= -1e-8).all() and np.abs(x * slope).max() < 1e-6


@pytest.mark.parametrize(("nonnegative", "chunk"), [(True, 4096), (True, 3), (False, 3)])
def test_half_step_equals_the_whole_objective(spark, nonnegative, chunk):
    rng = np.random.default_rng(5)
    items = {f"t{i}": [float(v) for v in rng.uniform(0, 1, 4)] for i in range(30)}
    rated = {"hot": {f"t{i}": float(1 + i % 3) for i in range(25)}, "u": {"t1": 0.5}, "v": {"t2": 2.0, "t9": -1.0}}
    rows = [(u, i, r) for u, own in rated.items() for i, r in own.items()]
    # A pair in two rows, an id without a factor, a null rating, and a user with nothing known.
    rows += [("u", "t3", 1.0), ("u", "t3", 0.25), ("u", "ghost", 9.0), ("v", "t4", None), ("w", "ghost", 1.0), (None, "t1", 1.0)]
    rated["u"]["t3"] = 1.25
    ratings = spark.createDataFrame(rows, "user_id string, id string, rating double")
    table = spark.createDataFrame(list(items.items()), "id string, embedding array<float>")
    got = {r["user_id"]: r["vector"] for r in half_step(ratings, table, P, nonnegative, chunk).collect()}
    assert got.keys() == rated.keys()
    for user, own in rated.items():
        assert got[user] == pytest.approx(by_hand(own, items, 0.1, 3.0, nonnegative), abs=1e-4)


def test_gram_and_empty_tables(spark):
    none = spark.createDataFrame([], "id string, embedding array<float>")
    assert not gram(none, 4).any()
    ratings = spark.createDataFrame([], "user_id string, id string, rating double")
    assert half_step(ratings, none, P).count() == 0
    wrong = spark.createDataFrame([("a", [1.0])], "id string, embedding array<float>")
    with pytest.raises(Exception, match="not of length 4"):
        gram(wrong, 4)


def test_training_of_very_loud_ratings_gives_no_zero_factors(spark):
    """The trainer's solver gives zeros for such systems; before, these were the factors."""
    from earshot.operators import training

    rows = [(u, i, 1e7 * (1 + (u + i) % 3)) for u in range(12) for i in range(8) if (u * i) % 3 != 1]
    triples = spark.createDataFrame(rows, "user_index int, item_index int, rating float")
    params = training.Params(rank=4, maxIter=3)
    model = training.train_als(triples, params, seed=3, blocks=2)
    users = {r["id"]: r["features"] for r in model.userFactors.collect()}
    items = {r["id"]: r["features"] for r in model.itemFactors.collect()}
    assert set(users) == {r[0] for r in rows} and set(items) == {r[1] for r in rows}
    assert all(min(v) >= 0 and max(v) > 0 for v in [*users.values(), *items.values()])
    off = [abs(1 - sum(a * b for a, b in zip(users[u], items[i]))) for u, i, _ in rows]
    assert sum(off) / len(off) < 0.2
