"""Vector codes against brute force in Python's integers, the trees' own promises, and defined cases."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import rows_of

from strataframe.llm import metric_trees, oracles, queries
from test_operators import DATA

TABLE = "vec_id long, embedding array<float>, label int, code string, error string, row string"


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) as Python sees floats. Codes, errors and codebooks by all distances."""
    fine = [(i, v, k) for i, v, k in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    fine.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(fine[0][1]) if fine else 0
    each = -(-width // parts)
    whole = [[math.floor(256 * x) for x in v] + [0] * (parts * each - width) for _, v, _ in fine if len(v) == width]
    cut = [[v[p * each : (p + 1) * each] for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        owned = [defaultdict(list) for _ in range(parts)]
        for v in cut:
            for p in range(parts):
                owned[p][near(p, v[p])[1]].append(v[p])
        for p in range(parts):
            for k, xs in owned[p].items():
                books[p][k] = [sum(c) // len(xs) for c in zip(*xs)]
    out, at = [], 0
    for i, v, k in fine:
        if len(v) != width:
            out.append((i, None, None))
            continue
        found = [near(p, cut[at][p]) for p in range(parts)]
        at += 1
        out.append((i, "".join(f"{e:02x}" for _, e in found), min(sum(d for d, _ in found), 2**63 - 1)))
    text = ",".join(str(x) for p in books for e in p for x in e)
    return Counter(out), hashlib.sha256(text.encode()).hexdigest()


def clusters(rng, n, width=64, spread=0.05):
    centres = rng.normal(size=(12, width))
    return (centres[rng.integers(12, size=n)] + spread * rng.normal(size=(n, width))).astype(np.float32)


def table_of(spark, rows):
    return spark.createDataFrame([(i, v, k, "x", "y", "z") for i, v, k in rows], TABLE)


def check(spark, rows, **how):
    found, books = metric_trees.compressed(table_of(spark, rows), **how)
    wanted, sha = brute(rows, **how)
    assert Counter((r.vec_id, r.code, r.error) for r in found.collect()) == wanted and books.sha256() == sha
    assert "row" in found.columns and found.columns.count("code") == 1


def as_rows(matrix, first=0):
    return [(first + k, [float(x) for x in v], k % 3) for k, v in enumerate(matrix)]


@pytest.mark.parametrize("block", [7, 4096])
def test_codes(spark, monkeypatch, block):
    monkeypatch.setattr(metric_trees, "BLOCK", block)
    rng = np.random.default_rng(1)
    check(spark, as_rows(clusters(rng, 400, 32)))


def test_ties_copies_and_few_vectors(spark):
    rng = np.random.default_rng(2)
    grid = rng.integers(-2, 3, size=(150, 16)).astype(np.float32) / 256
    rows = as_rows(grid) + as_rows(grid[:40], 200) + [(5, [0.0] * 16, None), (None, [1.0] * 16, None)]
    check(spark, rows)
    check(spark, rows[:10])
    check(spark, rows, parts=4, entries=5, rounds=3)


def test_defined_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = as_rows(np.random.default_rng(3).normal(size=(90, 20)).astype(np.float32), 10)  # 16 doesn't divide 20
    rows += [(1, None, 1), (2, [nan] * 20, 1), (3, [inf] + [0.0] * 19, 1), (4, [None] + [0.0] * 19, None), (200, [1.0, 2.0], 1), (201, [], None)]
    check(spark, rows)
    check(spark, [(k, [], 0) for k in range(3)])
    check(spark, [])
    check(spark, [(1, None, 1)])


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(4)
    wild = (rng.normal(size=(80, 16)) * 10.0 ** rng.integers(-3, 38, size=(80, 16))).astype(np.float32)
    check(spark, as_rows(np.clip(wild, -3e38, 3e38).astype(np.float32)))


@pytest.mark.parametrize("seed", range(6))
def test_trees(seed):
    """Each ball holds its points and caches their sum and count; a walk equals all distances and takes fewer."""
    rng = np.random.default_rng(seed)
    points = metric_trees.exact(clusters(rng, 1500, 4, 0.02) if seed % 2 else rng.normal(size=(700, 3)).astype(np.float32))
    tree = metric_trees.Tree(points).written()
    assert sorted(tree["order"]) == list(range(len(points)))
    for k, (left, right, a, b) in enumerate(tree["links"].T.tolist()):
        own = points[tree["order"][a:b]]
        assert (own.sum(axis=0) == tree["sums"][k]).all() and (np.sqrt(((own - tree["centre"][k]) ** 2).sum(axis=1)) <= tree["reach"][k] + 1e-9).all()
        assert left < 0 or (tree["links"][2, left], tree["links"][3, right]) == (a, b)
    entries = points[rng.choice(len(points), 64)]
    walk = metric_trees.Walk(tree, points, entries)
    distances = ((points[:, None] - entries[None]) ** 2).sum(axis=-1)
    assert (walk.codes == distances.argmin(axis=1)).all() and (walk.counts == np.bincount(walk.codes, minlength=64)).all()
    assert all((walk.sums[e] == points[walk.codes == e].sum(axis=0)).all() for e in range(64))
    assert walk.seen < distances.size / (4 if seed % 2 else 1.2)


def test_same_rows_as_sql(spark, duck):
    found = queries.op12_metric_tree_codes(spark, DATA)
    cursor = duck.execute(oracles.VECTOR_CODES)
    assert rows_of(found.columns, [tuple(r) for r in found.collect()]) == rows_of([c[0] for c in cursor.description], cursor.fetchall())
