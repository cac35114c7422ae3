"""Near-duplicate vectors and whitening against brute force."""

import math

import numpy as np
import pytest

from modelwatch.llm import pq_dedup, whitening

NAN, INF = float("nan"), float("inf")


def brute_links(rows, cosine):
    """(links, smallest id reachable) of rows (id, label, vector)."""

    def usable(label, v):
        return label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)

    width = max((len(v) for _, _, v in rows if v), default=0)
    linked = [set() for _ in rows]
    for i, (_, la, va) in enumerate(rows):
        for j, (_, lb, vb) in enumerate(rows[:i]):
            if la == lb and usable(la, va) and usable(lb, vb):
                a, b = (np.array(v + [0.0] * (width - len(v))) for v in (va, vb))
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= cosine:
                    linked[i].add(j)
                    linked[j].add(i)
    out = []
    for i, (name, _, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            todo += (new := linked[todo.pop()] - seen)
            seen |= new
        names = [rows[k][0] for k in seen if rows[k][0] is not None]
        low = min(names, default=None)
        out.append((name, len(linked[i]), low, name == low))
    return sorted(out, key=str)


def clustered(rng, n, width, labels):
    """Random vectors, chains of near copies, exact copies and scaled copies."""
    rows, i = [], 0
    while len(rows) < n:
        v = rng.normal(size=width)
        label = int(rng.integers(labels))
        for _ in range(int(rng.choice([1, 1, 2, 5, 20]))):
            rows.append((i, label, [float(np.float32(x)) for x in v]))
            i += 1
            step = rng.choice([0.0, 0.02, 0.15])
            v = v * float(rng.choice([1.0, 3.0])) if step == 0 else v + step * np.linalg.norm(v) * rng.normal(size=width) / width**0.5
    return rows[:n]


@pytest.mark.parametrize("block_rows", [4096, 256])
def test_near_vectors_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(pq_dedup, "BLOCK_ROWS", block_rows)
    rows = clustered(np.random.default_rng(3), 700, 12, 3)
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>")
    got = pq_dedup.near_vectors(df.repartition(4), 0.93).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_links(rows, 0.93)


def test_near_vectors_odd_rows(spark):
    rows = [
        (1, "a", [1.0, 0.0]),
        (2, "a", [2.0, 0.0, 0.0]),
        (3, "b", [1.0, 0.0]),
        (4, None, [1.0, 0.0]),
        (5, "a", None),
        (6, "a", [0.0, 0.0]),
        (7, "a", [NAN, 1.0]),
        (8, "a", [INF, 1.0]),
        (9, "a", [None, 1.0]),
        (10, "a", []),
        (1, "a", [1.0, 0.0]),
        (None, "a", [1e200, 1e190]),
        (None, "c", [1.0, 1.0]),
        (11, "b", [0.0, -1.0]),
        (12, "b", [-0.0, -1.0]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, label string, embedding array<double>")
    df = df.selectExpr("*", "1 AS node", "2 AS k1", "3 AS copies", "4 AS low_id", "5 AS vec", "6 AS _salt")
    got = sorted((tuple(r) for r in pq_dedup.near_vectors(df, 0.93).collect()), key=str)
    want = brute_links([(a, b, [x / 1e150 if x and abs(x) > 1e100 and math.isfinite(x) else x for x in v] if v else v) for a, b, v in rows], 0.93)
    assert got == [(a, n, low, kept or a is None and low is None) for a, n, low, kept in want]
    assert pq_dedup.near_vectors(df.limit(0)).count() == 0


def test_bounds_leave_out_no_pair():
    """Probes and table distances of a coarse index, fitted on few vectors, keep every pair."""
    rng = np.random.default_rng(5)
    u = pq_dedup.unit(np.repeat(rng.normal(size=(150, 16)), 4, axis=0) + 0.08 * rng.normal(size=(600, 16)))
    q = pq_dedup.fit_quantiser(u[::3][:64], 40_000)
    assert len(q.centres) == 4
    near, radius = q.lists(u).argmin(1), math.sqrt(2 - 2 * 0.93)
    codes = q.codes(u - q.centres[near])
    decoded = q.centres[near] + q.decoded(codes)
    error = np.linalg.norm(u - decoded, axis=1)
    pairs = np.argwhere(u @ u.T >= 0.93)
    assert len(pairs) > 1000
    assert pq_dedup.probed(q, u, radius)[pairs[:, 0], near[pairs[:, 1]]].all()
    table = np.linalg.norm(u[pairs[:, 0]] - decoded[pairs[:, 1]], axis=1)
    assert (table - error[pairs[:, 1]] <= radius + pq_dedup.SLACK).all()


def plain_whitening(vectors, components, weights=None):
    x = np.floor(256 * np.array(vectors))
    u, n = np.unique(x, axis=0, return_counts=True)
    w = n if weights else np.ones(len(u))
    mean = (w[:, None] * u).sum(0) / w.sum()
    e, v = np.linalg.eigh(((u - mean).T * w) @ (u - mean) / w.sum())
    e, v = e[::-1][:components], v[:, ::-1][:, :components]
    return x, (x - mean) @ v / np.sqrt(e), e / np.trace((u - mean).T * w @ (u - mean) / w.sum()), u


@pytest.mark.parametrize("weigh", [False, True])
def test_whitening_equals_numpy(spark, weigh):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(200, 6)) @ rng.normal(size=(6, 6))
    rows = [(i, [float(x) for x in base[k]]) for i, k in enumerate([*range(200), *[7] * 150, *range(40)])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").selectExpr("*", "1 AS x", "2 AS k1", "3 AS copies")
    out, model, error = whitening.whiten(df.repartition(5), 4, weigh)
    got = {r.vec_id: r for r in out.collect()}
    x, white, explained, distinct = plain_whitening([v for _, v in rows], 4, weigh)
    assert len(got) == len(rows) and error < 1e-9
    assert np.allclose(model.explained, explained, rtol=1e-9)
    mine = np.array([got[i].whitened for i, _ in rows])
    assert np.allclose(np.abs(mine), np.abs(white), atol=1e-8)
    if not weigh:
        n, s = len(distinct), distinct.sum(0).astype(int).tolist()
        assert model.n == n and list(model.sums) == s
        want = [sum((n * int(a) - b) ** 2 for a, b in zip(row, s, strict=True)) for row in x]
        assert [got[i].deviation for i, _ in rows] == want


def test_whitening_odd_rows(spark):
    rows = [
        (1, [0.5, 1.0]),
        (2, [0.5, 2.0]),
        (2, [0.5, 2.0]),
        (3, None),
        (4, [None, 1.0]),
        (5, [NAN, 1.0]),
        (6, [INF, 1.0]),
        (None, [0.5]),
        (8, []),
        (9, [0.501, 1.001]),
    ]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    out, model, error = whitening.whiten(df, 4)
    got = out.collect()
    # [0.5] and [] are vectors of their own; 9 has the same x as 1.
    assert sorted(str(r.vec_id) for r in got) == sorted(["1", "2", "2", "None", "8", "9"])
    assert model.n == 4 and len(model.eigenvalues) == 2 and error < 1e-9
    assert {r.copies for r in got if r.vec_id in (1, 2, 9)} == {2}
    single = whitening.whiten(df.filter("vec_id = 1"), 4)[0].collect()
    assert [(r.deviation, r.whitened) for r in single] == [(0, [None, None])]
    assert whitening.whiten(df.filter("vec_id = 3"), 4)[0].count() == 0
    assert whitening.whiten(df.limit(0), 4)[0].count() == 0


def test_deviations_beyond_a_long():
    x = np.array([[1 << 40, 0], [3, 4]])
    exact = [sum((int(v) * 1000 - s) ** 2 for v, s in zip(row, (5, 6), strict=True)) for row in x.tolist()]
    assert whitening._deviations(x, 1000, (5, 6)) == [v if v < 1 << 63 else None for v in exact]
