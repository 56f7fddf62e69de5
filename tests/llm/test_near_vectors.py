import math

import numpy as np
import pytest

from arcframe.llm import near_vectors as nv

SCHEMA = "vec_id long, embedding array<float>, label int, unit string, id long, n long"


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 0, "x", 1, 2) for i, v in zip(ids, vectors, strict=True)], SCHEMA)


def clusters(seed, n=400, dimension=32, families=30, noise=0.02):
    rng = np.random.default_rng(seed)
    out = list(rng.standard_normal((n, dimension)))
    for _ in range(families):
        base = rng.standard_normal(dimension)
        out += [base * rng.uniform(0.1, 10) + noise * rng.uniform(1, 8) * rng.standard_normal(dimension) for _ in range(rng.integers(2, 25))]
        out += [base] * int(rng.integers(0, 4))
    rng.shuffle(out)
    return np.array(out).astype(np.float32)


def links(vectors, threshold):
    x = np.asarray(vectors, np.float64)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    return near


def lowest(near):
    label = np.arange(len(near))
    while True:
        new = np.minimum(label, np.where(near, label[None, :], len(near)).min(1))
        if (new == label).all():
            return label
        label = new


@pytest.mark.parametrize(("seed", "threshold", "block"), [(1, 0.95, 2048), (2, 0.95, 16), (3, 0.9, 2048), (4, 0.99, 7)])
def test_against_all_pairs(spark, monkeypatch, seed, threshold, block):
    monkeypatch.setattr(nv, "BLOCK", block)
    monkeypatch.setattr(nv, "LINK_BLOCK", block)
    monkeypatch.setattr(nv, "GROWTH", 0)
    vectors = clusters(seed)
    rows = {r.vec_id: r for r in nv.near_vectors(table(spark, vectors), threshold).collect()}
    near = links(vectors, threshold)
    n = np.array([rows[i].n_links for i in range(len(vectors))])
    assert len(rows) == len(vectors) and (n <= near.sum(1)).all()
    assert n.sum() >= 0.99 * near.sum() and near.sum() > 500
    got = np.array([rows[i].component_id for i in range(len(vectors))])
    assert (got == lowest(near)).mean() > 0.99
    assert all(r.kept == (r.component_id == i) for i, r in rows.items())


def test_reruns_and_partitions_agree(spark):
    rows = table(spark, clusters(5))
    first = sorted(map(tuple, nv.near_vectors(rows).collect()))
    assert sorted(map(tuple, nv.near_vectors(rows.repartition(7)).collect())) == first


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [None, [], [0, 0], [1, nan], [inf, 1], [1, None], [1, 2], [2, 4], [1, 2, 0], [-1, -2], [1e-30, 2e-30], [1e30, 2e30], [1, 2]]
    rows = {r.vec_id: r for r in nv.near_vectors(table(spark, vectors)).collect()}
    assert [rows[i].n_links for i in range(13)] == [0, 0, 0, 0, 0, 0, 4, 4, 0, 0, 4, 4, 4]
    assert [rows[i].component_id for i in range(13)] == [0, 1, 2, 3, 4, 5, 6, 6, 8, 9, 6, 6, 6]


def test_odd_ids(spark):
    rows = nv.near_vectors(table(spark, [[1, 0], [1, 0], [1, 0], [0, 1]], [None, 4, 4, 2])).collect()
    assert sorted(map(tuple, rows), key=str) == sorted([(None, 0, None, True), (4, 1, 4, True), (4, 1, 4, True), (2, 0, 2, True)], key=str)
    assert nv.near_vectors(table(spark, [])).count() == 0


@pytest.mark.parametrize("distance", [0.1, 0.3162, 1.4])
def test_chance_of_a_cell(distance):
    rng = np.random.default_rng(1)
    at, apart = rng.random(200_000) * 1.5, rng.standard_normal(200_000) * distance
    assert np.mean(np.floor(at / 1.5) == np.floor((at + apart) / 1.5)) == pytest.approx(nv.same_cell(distance, 1.5), abs=0.005)


def test_calibration_reaches_its_recall():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((3000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    across = rng.standard_normal((3000, 64))
    across -= (across * x).sum(1)[:, None] * x
    across /= np.linalg.norm(across, axis=1)[:, None]
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * across  # pairs right at the threshold
    plan = nv.calibrate(50_000, 64, 0.95, np.full(100, 1.41))
    meet = (plan.cells(x) == plan.cells(y)).any(1)
    enough = (np.abs(plan.projections(x) - plan.projections(y)) <= plan.window).sum(1) >= plan.least
    assert (meet & enough).mean() > 0.98 and plan.lines > 3
    far = (plan.cells(x) == plan.cells(np.roll(x, 1, 0))).any(1)
    assert far.mean() < 0.1


@pytest.mark.parametrize("threshold", [0.5, 0.9, 0.95, 0.99])
@pytest.mark.parametrize("cosine", [0.0, 0.4, 0.7, 0.78])
@pytest.mark.parametrize("n", [10**3, 10**6, 10**7, 10**8, 10**10])
def test_recall_holds_at_every_size_and_spread(n, cosine, threshold):
    plan = nv.calibrate(n, 64, threshold, np.full(100, math.sqrt(2 - 2 * cosine)))
    meet = nv.same_cell(math.sqrt(2 - 2 * threshold), nv.CELL) ** plan.lines
    assert 1 - (1 - meet) ** plan.tables >= 0.998
    assert plan.tables <= nv.MOST_TABLES


def test_pairs_meet_where_unrelated_vectors_are_alike():
    rng = np.random.default_rng(4)
    x, across = (rng.standard_normal((2000, 64)) for _ in range(2))
    x[:, 0] += 12  # a cosine of about 0.7 between any two
    x /= np.linalg.norm(x, axis=1)[:, None]
    across -= (across * x).sum(1)[:, None] * x
    across /= np.linalg.norm(across, axis=1)[:, None]
    y = 0.95 * x + math.sqrt(1 - 0.95**2) * across
    plan = nv.calibrate(10**7, 64, 0.95, np.sqrt(np.maximum(0, 2 - 2 * (x[:500] @ x[:500].T)))[np.triu_indices(500, 1)])
    assert (plan.cells(x) == plan.cells(y)).any(1).mean() > 0.99


def test_sketches_lose_no_pair_that_places_have():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((600, 24))
    x = np.concatenate([x, x[:300] + 0.08 * rng.standard_normal((300, 24))])
    x /= np.linalg.norm(x, axis=1)[:, None]
    plan = nv.calibrate(1000, 24, 0.95, np.full(10, 1.41))
    every = np.arange(len(x))
    half = (every[::2], every[1::2])
    for left, right, same in ((every, every, True), (*half, False)):
        pairs = [(i, j) for a, b in nv.colliding(plan.projections(x), plan.window, nv._reach(0.95), plan.least, left, right, same) for i, j in zip(a, b, strict=True)]
        partner = nv.with_partner(plan, plan.sketches(x), left, right, same)
        assert pairs and all(partner[i] and partner[j] for i, j in pairs) and partner.mean() < 0.9


@pytest.mark.parametrize("offset", [5.5, 16.0])
def test_measured_recall_where_unrelated_vectors_are_alike(spark, offset):
    """Ids divisible by 50 against all rows; a pair of unrelated vectors has a cosine of about 0.3 and 0.8."""
    rng = np.random.default_rng(int(offset))
    base = rng.standard_normal((20_000, 64)) + np.eye(64)[0] * offset
    near = base[:10_000] + 0.2 * np.linalg.norm(base[:10_000], axis=1)[:, None] / 8 * rng.standard_normal((10_000, 64)) * rng.uniform(0.5, 1.5, (10_000, 1))
    x = np.concatenate([base, near]).astype(np.float32)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in nv.near_vectors(frame).collect()}
    unit = x.astype(np.float64)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    asked = np.arange(0, len(x), 50)
    want = (unit[asked] @ unit.T >= 0.95).sum(1) - 1
    found = np.array([got[i] for i in asked.tolist()])
    assert want.sum() > 100 and (found <= want).all() and found.sum() >= 0.99 * want.sum()


def test_a_recall_that_is_not_reached_is_an_error(monkeypatch):
    plan = nv.calibrate(10**9, 64, 0.95, np.full(100, 1.41))
    assert plan.recall() > 0.997
    weak = nv.Plan(64, 0.95, 17, 3, plan.lines, plan.window, plan.least)
    assert weak.recall() < 0.7
    monkeypatch.setattr(nv.Plan, "recall", lambda _: 0.9)
    with pytest.raises(ValueError):
        nv.calibrate(10**6, 64, 0.95, np.full(100, 1.41))
