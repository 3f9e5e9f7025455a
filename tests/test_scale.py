"""What larger tables need: work that is done once, many rows at a time, and bounded state."""

from __future__ import annotations

import numpy as np
from tessella.functions import distance as D
from tessella.operators import ann, hlc, vectors
from tessella.plans import queries
from tessella.streaming import views


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def of_lengths(n: int, dim: int = 16, seed: int = 4) -> np.ndarray:
    """Directions of seven lengths: the short ones are near to all, the long ones to nobody."""
    x = np.random.default_rng(seed).normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None] * (1 + np.arange(n) % 7)[:, None]


def test_snapshots_are_copies_of_one_build(spark, sf, monkeypatch):
    plans, write = [], ann.snapshot_all
    monkeypatch.setattr(ann, "snapshot_all", lambda all_, *a: (plans.extend(map(plan, all_.values())), write(all_, *a))[1])
    assert queries.QUERIES["graph_snapshots"](spark, sf).first()[:] == (2, 1, 500)
    assert len(plans) == 3 and not any("FlatMapGroups" in p for p in plans)


def test_graphs_grow_many_nodes_at_a_time(monkeypatch):
    calls, matrix = [], D.matrix
    monkeypatch.setattr(D, "matrix", lambda *a: (calls.append(1), matrix(*a))[1])
    g = ann.Graph(16)
    g.add(list(range(1000)), of_lengths(1000))
    assert 0 < len(calls) < 100


def vector_rows(spark, x: np.ndarray):
    return spark.createDataFrame([(i, v.astype(float).tolist()) for i, v in enumerate(x)], "id long, vec array<float>")


def test_all_cells_are_one_scan_without_pairs(spark):
    base = vector_rows(spark, np.repeat(np.random.default_rng(1).integers(0, 3, (150, 4)), 2, axis=0))  # copies and ties
    asked = base.filter("id % 7 = 0").withColumnRenamed("id", "qid")
    for metric in (D.L2, D.COSINE, D.INNER):
        found = ann.ivf_search(base, asked, 5, cells=6, probes=6, metric=metric)
        assert "Join" not in plan(found)
        assert sorted(found.collect()) == sorted(vectors.knn_batch(base, asked, 5, metric).collect())


def test_cells_that_are_not_probed_stay_out(spark):
    x = np.random.default_rng(2).normal(size=(400, 8)).astype(np.float32).astype(np.float64)
    base = vector_rows(spark, x)
    c = ann.fit_cells(base, 8)
    cell, near = D.matrix(D.L2, x, c).argmin(1), D.matrix(D.L2, x, c).argsort(1, kind="stable")[:, :2]
    found = ann.ivf_search(base, base.filter("id % 40 = 0").withColumnRenamed("id", "qid"), 5, cells=8, probes=2)
    assert "Join" not in plan(found)
    want = {q: sorted((((x[i] - x[q]) ** 2).sum(), i) for i in np.flatnonzero(np.isin(cell, near[q])))[:5] for q in range(0, 400, 40)}
    got: dict = {}
    for r in sorted(found.collect()):
        got.setdefault(r.qid, []).append(r.id)
    assert got == {q: [i for _, i in w] for q, w in want.items()}


def test_a_sweep_finds_the_truth_once(spark, sf, monkeypatch):
    asked, search = [], vectors._knn_block
    monkeypatch.setattr(vectors, "_knn_block", lambda *a: (asked.append(1), search(*a))[1])
    table = queries.QUERIES["sweep_table"](spark, sf)
    assert len(asked) == 1 and plan(table).split("== Physical Plan ==")[1].count("MapInArrow") == 3


def recalls(g: ann.Graph, x: np.ndarray, beams: list[int]) -> list[float]:
    q = x[::25]
    truth = D.matrix(D.L2, q, x).argsort(1)[:, :10].tolist()
    found = [[[i for _, i in g.search(v, 10, ef)] for v in q] for ef in beams]
    return [float(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(truth, f)])) for f in found]


def test_narrow_beams_find_most_of_rows_far_from_all(spark):
    x = of_lengths(2000, 32)
    g = ann.Graph(32, m=8, ef_construct=40)
    g.add(list(range(2000)), x)
    narrow, wide = recalls(g, x, [10, 40])
    assert narrow > 0.65 and wide > 0.85


def test_every_node_leads_to_every_other():
    for x in (of_lengths(1200, 32), np.zeros((400, 4)), np.repeat(np.random.default_rng(3).normal(size=(6, 4)), 80, axis=0)):
        g = ann.Graph(x.shape[1], m=4, ef_construct=20)
        g.add(list(range(len(x) // 2)), x[: len(x) // 2])
        g.add(list(range(len(x) // 2, len(x))), x[len(x) // 2 :])
        assert all(len(g.search(v, len(x), len(x))) == len(x) for v in x[::200])
        back = ann.Graph.load(g.rows(), m=4)
        assert back.search(x[0], 5, 30) == g.search(x[0], 5, 30) and (back.parent == g.parent).all()


def test_a_full_beam_breaks_ties_as_exact_search(spark):
    base = vector_rows(spark, np.random.default_rng(6).integers(0, 3, (300, 4)))
    asked = base.filter("id % 7 = 0").withColumnRenamed("id", "qid")
    assert sorted(ann.hnsw_search(base, asked, 5, ef_search=300).collect()) == sorted(vectors.knn_batch(base, asked, 5).collect())


def test_beams_of_a_hundred_find_nine_tenths():
    x = of_lengths(2000, 32)
    g = ann.Graph(32, m=8, ef_construct=40)
    g.add(list(range(2000)), x)
    g.remove(set(range(0, 2000, 13)))
    q, left = x[::25], np.flatnonzero(np.arange(2000) % 13)
    truth = left[D.matrix(D.L2, q, x[left]).argsort(1)[:, :10]]
    r, i, _ = g.search_many(q, 10, 100)
    assert np.mean([len(set(t) & set(i[r == n])) / 10 for n, t in enumerate(truth.tolist())]) >= 0.95


def test_exact_search_holds_little_however_many_ask():
    import tracemalloc

    x, peaks = of_lengths(4096, 64), []
    for n in (512, 4096):
        best = vectors.Nearest(x[:n], 10, D.L2)
        tracemalloc.start()
        best.offer(np.arange(4096), x)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert (best.i[:, 0] == np.arange(n)).all()
    assert peaks[1] < 2 * peaks[0] < 2 * vectors.MATRIX_BYTES * 2


def test_clocks_fold_many_events_as_one_by_one():
    rng = np.random.default_rng(7)
    for spread in (3, 1000, 2**50):
        physical, wall = rng.integers(1, 60, 400), rng.integers(1, 90, 400)
        remote, logical, state, want = rng.random(400) < 0.6, rng.integers(0, spread, 400), (20, 5), []
        for p, r, w, t in zip(physical.tolist(), remote.tolist(), wall.tolist(), logical.tolist()):
            state, ok = hlc.step(state, p, (w, t) if r else None, 20)
            want.append((*state, ok))
        half = [hlc.steps((20, 5), physical[:150], remote[:150], wall[:150], logical[:150], 20)]
        half.append(hlc.steps((int(half[0][0][-1]), int(half[0][1][-1])), physical[150:], remote[150:], wall[150:], logical[150:], 20))
        assert list(zip(*(np.concatenate(z).tolist() for z in zip(*half)))) == want


def test_clock_batches_are_bounded(spark, sf, monkeypatch):
    whole = sorted(queries.QUERIES["stream_hlc_receive"](spark, sf).collect())
    monkeypatch.setattr(views, "SLICE", 300)
    batches, drain = [], views.drain
    monkeypatch.setattr(views, "drain", lambda *a: (batches.append(drain(*a)), batches[-1])[1])
    assert sorted(queries.QUERIES["stream_hlc_receive"](spark, sf).collect()) == whole
    sizes = [r["count"] for r in batches[0].groupBy("batch").count().collect()]
    assert len(sizes) == 4 and sum(sizes) == 1000 and max(sizes) < 600


def test_hints_expire_without_a_call_a_key(spark, sf, monkeypatch):
    whole = sorted(queries.QUERIES["stream_hint_expiry"](spark, sf).collect())
    plans, expiry = [], views.hint_expiry
    monkeypatch.setattr(views, "SLICE", 100)
    monkeypatch.setattr(views, "hint_expiry", lambda *a: (plans.append(expiry(*a)), plans[-1])[1])
    assert whole and sorted(queries.QUERIES["stream_hint_expiry"](spark, sf).collect()) == whole
    assert "Pandas" not in plan(plans[0])
