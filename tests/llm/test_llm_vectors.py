"""Centroid clustering and hard negatives against plain loops, and their edge cases."""

import hashlib
import math

import numpy as np
import pytest

from lumenlog.llm import clustering, hard_negatives
from lumenlog.llm.clustering import cluster_vectors
from lumenlog.llm.hard_negatives import hard_negatives as mine

VECTORS = "vec_id long, embedding array<float>"


def brute_clusters(rows, clusters, rounds, dims, scale):
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    starts = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:clusters]
    centroids = [v for _, v in starts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        found = assign()
        for k in range(len(centroids)):
            own = [v for (_, v), (_, c) in zip(kept, found, strict=True) if c == k]
            if own:
                centroids[k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign()
    inertia = [sum(d for d, c in found if c == k) for k in range(len(centroids))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia), sha[k]) for (i, _), (d, k) in zip(kept, found, strict=True)), key=str)


@pytest.mark.parametrize("clusters", [1, 5, 40])
def test_clusters_equal_plain_loops(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(6, 8))
    v = (centres[rng.integers(0, 6, 300)] + rng.normal(size=(300, 8)) / 5).astype(np.float32)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(7, v[7].tolist())] * 3  # repeated rows
    rows += [(None, v[3].tolist()), (900, None), (901, [1.0] * 7), (902, [*v[0][:7].tolist(), None]), (903, [math.nan] * 8), (904, [math.inf] * 8), (905, [0.0] * 8)]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS + ", cluster string")
    got = cluster_vectors(docs, clusters=clusters, dims=8, lead=3)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == brute_clusters(rows, clusters, 3, 8, 64)


def test_clusters_of_few_and_no_vectors(spark):
    assert cluster_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    one = cluster_vectors(spark.createDataFrame([(4, [0.5] * 64), (5, [1e30] * 64)], VECTORS)).collect()
    assert [(r.vec_id, r.cluster, r.distance) for r in one] == [(4, 0, 0)]  # beyond 64 bits nothing is counted
    assert cluster_vectors(spark.createDataFrame([(None, [0.5] * 64)], VECTORS)).count() == 0  # no row starts a centroid


def test_bounds_leave_few_centroids():
    rng = np.random.default_rng(3)
    centres = rng.integers(-900, 900, (16, 64))
    v = centres[rng.integers(0, 16, 4000)] + rng.integers(-60, 60, (4000, 64))
    mean = v.mean(0)
    axes = np.linalg.eigh(np.cov((v - mean).T))[1][:, ::-1][:, :16]
    cluster, distance, verified = clustering.nearest(v, *clustering.rotated(v, mean, axes), centres, *clustering.rotated(centres, mean, axes))
    every = ((v[:, None, :] - centres[None]) ** 2).sum(2)
    assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
    assert verified < 1.1 * len(v)  # of 16 a vector


def brute_negatives(rows, k, n):
    own = []
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=True))
    out = []
    for a, (i, label, v) in enumerate(own):
        if i % 100:
            continue
        scored = sorted((-dot(v, w), j, other == label) for b, (j, other, w) in enumerate(own) if a != b)
        for s, p, _ in [x for x in scored if x[2]][:k]:
            fits = [(x, j) for x, j, alike in scored if not alike and -30 * s <= -100 * x <= -90 * s][:n]
            out += [(i, p, r + 1, j, -s, -x) for r, (x, j) in enumerate(fits)]
    return sorted(out)


LABEL = "if(vec_id % 7 = 0, (label + 1) % 10, label)"


@pytest.mark.parametrize("block, spread", [(8000, 0.3), (40, 0.3), (60, 3.0)])
def test_negatives_equal_plain_loops(spark, monkeypatch, block, spread):
    monkeypatch.setattr(hard_negatives, "LEAF", 8)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(8, 6))
    v = (centres[rng.integers(0, 8, 420)] + spread * rng.normal(size=(420, 6))).astype(np.float32)
    rows = [(k, x.tolist(), int(rng.integers(0, 4))) for k, x in enumerate(v)]
    rows += [(k, rows[5][1], k % 3) for k in range(500, 640)]  # a third of all rows is one vector
    rows += [rows[100], (700, v[0].tolist(), None), (701, None, 1), (702, [None] * 6, 1), (703, [math.inf] * 6, 1), (None, v[1].tolist(), 1), (800, [0.0] * 6, 2)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], VECTORS + ", label int, rank string")
    got = sorted(map(tuple, mine(frame, label=LABEL, block_rows=block, query_bytes=1 << (20 if block > 50 else 6)).collect()))
    want = brute_negatives(rows, 5, 10)
    assert got == want and len(want) > 50


def test_negatives_of_few_and_no_rows(spark):
    assert mine(spark.createDataFrame([], VECTORS + ", label int"), label=LABEL).count() == 0
    few = spark.createDataFrame([(100, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.5, 0.0], 2), (3, [1.0], 2)], VECTORS + ", label int")
    assert [tuple(r) for r in mine(few, label=LABEL).collect()] == [(100, 1, 1, 2, 65536, 32768)]
    assert mine(few.where("label = 1"), label=LABEL).count() == 0


def test_trees_cover_and_skip():
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 64)) * 200
    v = np.floor(centres[rng.integers(0, 40, 6000)] + 8 * rng.normal(size=(6000, 64))).astype(np.int64)
    most = int((v**2).sum(1).max())
    labels = rng.integers(0, 5, len(v))
    order, centre, radius, table, _ = hard_negatives.cover_tree(v, labels, most)
    assert sorted(order) == list(range(len(v)))
    points = hard_negatives.augmented(v[order].astype(float), most)
    for c, r, (first, last, child, n) in zip(centre, radius, table, strict=True):
        assert np.sqrt(((points[first:last] - points[c]) ** 2).sum(1)).max() <= r + 1e-6
        if n:
            assert table[child][0] == first and table[child + n - 1][1] == last  # children share out their node
    batch = next(hard_negatives.planted(most)(iter([block_of(v, labels)])))
    tree = hard_negatives.Tree(batch, 0, most)
    q = tree.v[17]
    visited, best = 0, -np.inf
    for at, s in tree.leaves(q, float(q @ q), 0, False, lambda: best, np.inf):
        visited += at.stop - at.start
        best = max(best, float(s.max()))
    assert best == float((tree.v @ q)[tree.labels != 0].max()) or best == float((tree.v @ q).max())
    assert visited < len(v) / 4


def block_of(v, labels):
    import pyarrow as pa

    members = [{"row": k, "vec_id": k, "label": int(c), "v": x} for k, (x, c) in enumerate(zip(v.tolist(), labels, strict=True))]
    kind = pa.list_(pa.struct([("row", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("v", pa.list_(pa.int32()))]))
    return pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), pa.array([members], kind)], ["cell", "members"])
