from __future__ import annotations

import numpy as np
import pytest

from crawlgrain.llm import pivot_index as P

SCHEMA = "vec_id long, embedding array<float>, label int, node long, near string, work int, k1 int, component string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, None, None, None, None, None) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.95):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.asarray(v, dtype=np.float32).astype(np.float64)
            good[i] = x / np.sqrt((x * x).sum())
    n, root = dict.fromkeys([i for i, _ in rows], 0), {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(good)
    for a in ids:
        for b in ids:
            if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= threshold:
                n[a] += 1
                n[b] += 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in n}


def clusters(seed, n, d=32, spread=0.02):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, d))
    x = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(size=(n, d)) * rng.integers(0, 12, (n, 1))
    return [(int(k), x[k].astype(np.float32)) for k in rng.permutation(n)]


@pytest.mark.parametrize("p", [P.PivotIndex(), P.PivotIndex(pivots=24, nearest=6, block=7)])
def test_recall_and_no_false_link(spark, p):
    rows = clusters(1, 600)
    got = {x.vec_id: x for x in P.near_duplicates(table(spark, rows), p).collect()}
    want = brute(rows)
    assert {*got} == {*want}
    assert all(got[i].n_links <= want[i][0] for i in want)
    assert sum(x.n_links for x in got.values()) >= 0.9 * sum(n for n, _, _ in want.values())
    assert sum(got[i].component_id == want[i][1] for i in want) >= 0.95 * len(want)


def test_invalid_equal_and_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(10, [1, 0, 0]), (4, [2, 0, 0]), (7, [1, 0, 0]), (8, [1, 0.01, 0]), (1, None), (2, [0, 0, 0]), (3, [nan, 1, 0]), (5, [inf, 1, 0]), (6, [None, 1, 0]), (11, []), (12, [1, 0]), (13, [1, 0]), (14, [-1, 0, 0])]
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in P.near_duplicates(table(spark, rows)).collect()}
    assert got == brute(rows)
    assert got[10] == (3, 4, False) and got[13] == (1, 12, False) and got[3] == (0, 3, True)


def test_null_ids_repeats_and_empty_tables(spark):
    got = P.near_duplicates(table(spark, [(None, [1, 0]), (3, [1, 0]), (3, [1, 0])])).collect()
    assert sorted((x.vec_id is None, x.vec_id, x.kept) for x in got) == [(False, 3, True), (False, 3, True), (True, None, False)]
    assert P.near_duplicates(table(spark, [])).collect() == []
    assert [x.n_links for x in P.near_duplicates(table(spark, [(1, None), (2, [0, 0])])).collect()] == [0, 0]


def test_shared_counts_are_those_of_the_permutations():
    rng = np.random.default_rng(4)
    a = np.stack([rng.permutation(14)[:8] for _ in range(40)])
    one = P._incidence(a)
    for i, x in enumerate(a):
        places = {int(v): k for k, v in enumerate(x)}
        assert [int(n) for n in one[i] @ one.T] == [len({*x.tolist()} & {*y.tolist()}) for y in a]
        near = [sum(int(v) in places and abs(places[int(v)] - k) <= 4 for k, v in enumerate(y)) for y in a]
        assert P.shared_near(np.repeat(x[None], len(a), axis=0), a, 4).tolist() == near


@pytest.mark.parametrize("d", [16, 64, 256])
def test_recall_of_random_pairs_at_the_threshold(spark, d):
    rng = np.random.default_rng(d)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    x = unit(rng.normal(size=(700, d)))
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(axis=1)[:, None] * x)
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * z
    rows = [(k, v) for k, v in enumerate(np.concatenate([x, y]))]
    got = P.near_duplicates(table(spark, rows)).collect()
    want = brute(rows)
    assert sum(r.n_links for r in got) >= 0.97 * sum(n for n, _, _ in want.values()) > 0


def test_doubles_stay_doubles(spark):
    """Two vectors whose cosine is under the limit in double precision, and not in single."""
    c = 0.95 - 1e-9
    rows = [(1, [1.0, 0.0]), (2, [c, float(np.sqrt(1 - c * c))])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [x.n_links for x in P.near_duplicates(df).collect()] == [0, 0]


def test_lists_stay_short_as_tables_grow():
    p = P.PivotIndex()
    for n in (10**4, 10**6, 10**7):
        q = p.sized(n)
        assert 15 * n / (q.pivots**2 / 2) < 200
