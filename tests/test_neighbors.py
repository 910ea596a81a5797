"""Neighbour joins and density clustering against brute force."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from millrace.operators import density, neighbors


def frame(spark, x, **extra):
    rows = [(i, [float(v) for v in p], *[e[i] for e in extra.values()]) for i, p in enumerate(x)]
    fields = ", ".join(["row_id bigint", "vec array<double>", *[f"{k} string" for k in extra]])
    return spark.createDataFrame(rows, fields)


def brute(x, y, k, same=None, not_self=True):
    out = {}
    for i, p in enumerate(x):
        d = np.sqrt(((y - p) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((np.arange(len(y)), d)) if not (not_self and i == j) and (same is None or same[i] == same[j])]
        out[i] = [(int(j), float(d[j])) for j in order[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("row_id", "rank").collect():
        out.setdefault(r.row_id, []).append((r.neighbor_id, r.distance))
    return out


def same(got, want):
    assert set(got) == {i for i, v in want.items() if v}
    for i in got:
        assert [j for j, _ in got[i]] == [j for j, _ in want[i]]
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]])


@pytest.fixture
def cells(monkeypatch):
    """Many small cells and blocks, as on a large table."""
    monkeypatch.setattr(neighbors, "CELL_ROWS", 25)
    monkeypatch.setattr(neighbors, "CHUNK_CELLS", 500)
    monkeypatch.setattr(neighbors, "OUTPUT_ROWS", 13)
    return {"query_block": 8, "point_block": 11}


def clumps(seed, n=240, d=3):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.3, size=(n // 3, d)) for c in (0.0, 4.0, 9.0)])
    x[: n // 3] = np.round(x[: n // 3], 0)  # many exact copies
    return x


@pytest.mark.parametrize("k", [1, 4])
def test_knn(spark, cells, k):
    x = clumps(0)
    df = frame(spark, x)
    same(found(neighbors.knn(df, df, k, exclude_self=True, **cells)), brute(x, x, k))


def test_knn_of_one_hot_vector(spark, cells):
    # a third of the rows are copies of one row, far from zero
    x = clumps(1) + 1e6
    x[::3] = x[0]
    df = frame(spark, x)
    same(found(neighbors.knn(df, df, 3, exclude_self=True, **cells)), brute(x, x, 3))


def test_knn_within_groups(spark, cells):
    x = clumps(2)
    labels = ["big" if i % 3 else f"s{i % 2}" for i in range(len(x))]
    labels[7] = "alone"
    df = frame(spark, x, label=labels)
    got = neighbors.knn(df, df, 5, group="label", exclude_self=True, carry="label", **cells)
    same(found(got), brute(x, x, 5, same=labels))
    assert all(labels[r.row_id] == r.label for r in got.collect())


def test_knn_between_tables(spark, cells):
    x, y = clumps(3), clumps(4, n=90)
    got = neighbors.knn(frame(spark, x), frame(spark, y), 100, **cells)
    same(found(got), brute(x, y, 100, not_self=False))


def test_knn_carries_vectors(spark):
    x = clumps(5, n=30)
    df = frame(spark, x)
    for r in neighbors.knn(df, df, 2, exclude_self=True, carry="vec").collect():
        assert r.vec == pytest.approx(list(x[r.neighbor_id]))


def test_knn_prunes_far_cells(spark, cells):
    """Reference rows of far clumps do not travel."""
    x = clumps(6, n=300, d=2)
    met = []
    original = neighbors._layout

    def spy(visitors, cells, *blocks):
        met.append(neighbors._work(visitors, cells))
        return original(visitors, cells, *blocks)

    neighbors._layout = spy
    try:
        df = frame(spark, x)
        got = found(neighbors.knn(df, df, 2, exclude_self=True, query_block=1_000, point_block=1_000))
    finally:
        neighbors._layout = original
    same(got, brute(x, x, 2))
    assert met[-1] < 0.5 * 300 * 300


@given(
    st.lists(st.tuples(st.integers(-3, 3), st.integers(-3, 3)), min_size=2, max_size=40),
    st.integers(1, 5),
)
@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
def test_knn_any_points(spark, points, k):
    x = np.array(points, float)
    df = frame(spark, x)
    same(found(neighbors.knn(df, df, k, exclude_self=True, query_block=5, point_block=6)), brute(x, x, k))


def brute_dbscan(x, eps, min_samples):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) <= eps
    core = d.sum(axis=1) >= min_samples
    label = np.full(len(x), -1)
    k = 0
    for i in range(len(x)):
        if label[i] != -1 or not core[i]:
            continue
        label[i], stack = k, [i]
        while stack:
            j = stack.pop()
            if core[j]:
                for n in np.nonzero(d[j] & (label == -1))[0]:
                    label[n] = k
                    stack.append(n)
        k += 1
    return label, core


@pytest.mark.parametrize("eps,min_samples", [(0.35, 4), (0.6, 6), (5.0, 3), (0.01, 2)])
def test_dbscan(spark, cells, monkeypatch, eps, min_samples):
    x = clumps(7, n=150, d=2)
    original = neighbors.block_join
    monkeypatch.setattr(density, "block_join", lambda *a, **k: original(*a, **{**k, **cells}))
    got = sorted(density.dbscan(frame(spark, x), eps, min_samples).collect())
    label, core = brute_dbscan(x, eps, min_samples)
    assert [r.cluster for r in got] == list(label)
    assert [r.is_core for r in got] == list(core)


def test_dbscan_long_chain(spark, cells, monkeypatch):
    x = np.array([[float(i), 0.0] for i in np.random.default_rng(0).permutation(120)])
    original = neighbors.block_join
    monkeypatch.setattr(density, "block_join", lambda *a, **k: original(*a, **{**k, **cells}))
    assert {r.cluster for r in density.dbscan(frame(spark, x), 1.0, 2).collect()} == {0}


def on_a_lattice():
    """Rows whose distances are multiples of the radius, on the rims of the grid's cells."""
    rng = np.random.default_rng(11)
    return rng.integers(0, 12, (160, 2)) * 0.25


def far_out():
    """Clumps near the origin and beyond the reach of the grid, with copies."""
    x = clumps(13, n=60, d=3)
    return np.vstack([x, x + 1e9, x[:20], np.round(x[:30] * 4) / 4])


@pytest.mark.parametrize(
    "make,eps,min_samples",
    [(on_a_lattice, 0.25, 4), (on_a_lattice, 0.5, 5), (far_out, 0.6, 4), (far_out, 0.0, 2), (lambda: clumps(5, n=90, d=7), 1.2, 5), (on_a_lattice, 0.3, 1)],
)
def test_dbscan_grid(spark, make, eps, min_samples):
    x = make()
    got = sorted(density.dbscan(frame(spark, x), eps, min_samples).collect())
    label, core = brute_dbscan(x, eps, min_samples)
    assert [r.cluster for r in got] == list(label)
    assert [r.is_core for r in got] == list(core)


def test_dbscan_places_rows_once_and_counts_only_around_sparse_cells(spark, monkeypatch):
    x = np.vstack([np.zeros((1, 2)) + np.random.default_rng(3).uniform(0.01, 0.2, (80, 2)), [[9.0, 9.0], [5.0, 5.0]]])
    asked, placed = [], []
    join, place = neighbors.block_join, neighbors._place
    monkeypatch.setattr(density, "block_join", lambda q, *a, **k: asked.append(q.count()) or join(q, *a, **k))
    monkeypatch.setattr(neighbors, "_choose_pivots", lambda *a: np.array([[0.0, 0.0], [7.0, 7.0]]))
    monkeypatch.setattr(neighbors, "_place", lambda df, pivots: placed.append(pivots.shape[1]) or place(df, pivots))
    clusters = [r.cluster for r in sorted(density.dbscan(frame(spark, x), 1.0, 3).collect())]
    assert clusters == [0] * 80 + [-1, -1]
    # 80 rows of one cell are core without a distance; the two others are counted around, and asked for cores again
    assert asked == [2, 80, 2] and placed.count(2) == 1


def brute_mean_shift(x, bandwidth):
    modes = []
    for p in x:
        for _ in range(300):
            new = x[np.sqrt(((x - p) ** 2).sum(axis=1)) <= bandwidth]
            step = np.sqrt(((new.mean(axis=0) - p) ** 2).sum())
            p = new.mean(axis=0)
            if step < 1e-3 * bandwidth:
                break
        modes.append((len(new), tuple(p)))
    kept = []
    for _, m in sorted(modes, reverse=True):
        if all(np.sqrt(((np.array(m) - np.array(o)) ** 2).sum()) > bandwidth for o in kept):
            kept.append(m)
    label = [int(np.argmin([((p - np.array(m)) ** 2).sum() for m in kept])) for p in x]
    return label, kept


def test_mean_shift(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.5, size=(s, 2)) for c, s in ((0.0, 30), (5.0, 20), (11.0, 12))])
    clusters, modes = density.mean_shift(frame(spark, x), 2.0)
    label, kept = brute_mean_shift(x, 2.0)
    assert [r.cluster for r in clusters.orderBy("row_id").collect()] == label
    assert len(kept) == modes.count()
    seeded, _ = density.mean_shift(frame(spark, x), 2.0, bin_seeding=True)
    assert [r.cluster for r in seeded.orderBy("row_id").collect()] == label


def test_nearest_distance_curve(spark):
    x = np.array([[0.0], [1.0], [1.0], [5.0]])
    got = [(r.row_id, r.distance) for r in neighbors.nearest_distance_curve(frame(spark, x)).collect()]
    assert got == [(1, 0.0), (2, 0.0), (0, 1.0), (3, 4.0)]


def test_a_block_is_compared_in_little_memory():
    rng = np.random.default_rng(0)
    q = pd.DataFrame({"row_id": np.arange(260), "vec": list(rng.normal(size=(260, 8)))})
    p = pd.DataFrame({"row_id": np.arange(neighbors.POINT_BLOCK), "vec": list(rng.normal(size=(neighbors.POINT_BLOCK, 8)))})
    tracemalloc.start()
    try:
        assert len(neighbors.nearest_of_block(q, p, 5, False)) == 5 * 260
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()


def test_tasks_are_dealt_out_by_the_pairs_they_compare(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "PARTITION_PAIRS", 1_000)
    x = frame(spark, np.random.default_rng(4).normal(size=(160, 2)))
    out, _ = neighbors.block_join(x, x, lambda q, p: q[["row_id"]], "row_id bigint", query_block=20, point_block=20)
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true" and out.rdd.getNumPartitions() == 26


@pytest.mark.parametrize("make,eps,min_samples", [(on_a_lattice, 0.25, 4), (far_out, 0.6, 4), (lambda: clumps(7, n=150, d=2), 0.35, 4)])
def test_dbscan_links_cells_by_their_first_rows_and_the_rest(spark, monkeypatch, make, eps, min_samples):
    monkeypatch.setattr(density, "LINK_ROWS", 0)
    x = make()
    got = sorted(density.dbscan(frame(spark, x), eps, min_samples).collect())
    label, core = brute_dbscan(x, eps, min_samples)
    assert [r.cluster for r in got] == list(label)
    assert [r.is_core for r in got] == list(core)


def test_dbscan_compares_no_rows_of_cells_linked_already(spark, monkeypatch):
    monkeypatch.setattr(density, "LINK_ROWS", 0)
    rng = np.random.default_rng(5)
    x = np.vstack([rng.uniform(0, 1, (200, 2)), rng.uniform(9, 9.1, (5, 2))])
    asked, join = [], neighbors.block_join
    monkeypatch.setattr(density, "block_join", lambda q, *a, **k: asked.append(q.count()) or join(q, *a, **k))
    got = [r.cluster for r in sorted(density.dbscan(frame(spark, x), 0.5, 3).collect())]
    assert got == [0] * 200 + [1] * 5
    # of the linking joins the first takes one row a cell, the second what is not in the largest component
    assert asked[1] < 20 and asked[2] == 5


def test_far_rows_of_a_wide_cell_do_not_draw_queries_from_other_cells():
    rng = np.random.default_rng(6)
    x = np.vstack([rng.uniform(0, 1, (2_000, 2)), rng.uniform(-40, 40, (40, 2))])
    pivots = x[rng.permutation(2_000)[:50]]
    d2 = ((x[:, None, :] - pivots[None, :, :]) ** 2).sum(axis=2)
    cell = d2.argmin(axis=1)
    radius = np.array([np.sqrt(d2[cell == c, c].max(initial=0.0)) for c in range(50)])
    made = neighbors.Cells(pivots, {"": np.bincount(cell, minlength=50)}, {"": radius})
    theta = np.sort(np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)), axis=1)[:, 5]
    seen = made.visits("", x, theta, 0)
    for i in range(0, len(x), 7):
        inside = np.sqrt(((x - x[i]) ** 2).sum(axis=1)) <= theta[i]
        assert seen[i, cell[inside]].all()
    assert seen[:2_000].sum(axis=1).mean() < 6


def test_a_block_hands_back_nothing_beyond_the_known_bound():
    x = pd.DataFrame({"row_id": range(30), "vec": [np.array([float(i), 0.0]) for i in range(30)]})
    out = neighbors.nearest_of_block(x.assign(theta=[2.0] * 29 + [np.inf]), x, 10, False)
    assert out.groupby("row_id").size().tolist() == [3, 4, *[5] * 26, 4, 10]
    assert out[out["row_id"] == 4]["neighbor_id"].tolist() == [4, 3, 5, 2, 6]


def test_neighbours_bring_their_vectors_along_without_a_second_copy(spark, cells, monkeypatch):
    x, sent, join = clumps(3), [], neighbors.block_join
    monkeypatch.setattr(neighbors, "block_join", lambda q, p, *a, **k: sent.append((p.columns, k["point_extra"])) or join(q, p, *a, **k))
    got = neighbors.knn(frame(spark, x), frame(spark, x), 3, exclude_self=True, carry="vec", **cells)
    assert sent == [(["row_id", "vec"], None)]
    rows = got.collect()
    assert len(rows) == 3 * len(x) and all(r.vec == list(x[r.neighbor_id]) for r in rows)
