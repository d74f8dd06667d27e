"""Centroid clustering in integers, with PCA-rotated filtering.

A vector's components become integers, ``floor(scale * x)``; centroids are integers too, so distances are exact and a
run's result does not depend on how rows are dealt.  The covariance of all vectors gives a rotation.  Each vector is
stored once with its ``lead`` leading rotated coordinates and the norm of the residual, what they leave out.  For a
vector x and a centroid c

    |x - c|^2  >=  |lead(x) - lead(c)|^2 + (residual(x) - residual(c))^2,

so a round takes the centroid of the smallest bound, its exact distance, and then verifies only the centroids whose
bound is not above it, in integers.  The bounds are lowered by more than floating point can be wrong.

Scale: a round is one scan of the stored vectors and a map-side sum; ``clusters`` rows of sums reach the driver, and as
many centroids go out.  The covariance takes ``dims ** 2`` numbers a task.  No row is shuffled.

Defined results: vectors that are null, of another length, or that hold a null or non-finite component take no part, nor
do those with a scaled component beyond 2 ** 27, whose distances would not fit 64 bits; a row without an id is
clustered, but never starts a centroid; rows that repeat are rows of their own, and start centroids of their own, in the
order of their components; with fewer vectors than ``clusters`` there are fewer centroids; an empty centroid stays;
equal distances go to the smaller number; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

LARGEST = 1 << 27
#: Pairs of a vector and a centroid that are verified at once.
VERIFIED = 1 << 14
#: Bounds are lowered by this share of the squared norms; 64-bit floats are wrong by far less.
SLACK = 1e-9


def integer_vectors(vectors: DataFrame, vec_id: str, embedding: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, v): the vectors that take part, as arrays of ints."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x"))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST / scale)
    kept = rows.where((F.size("x") == dims) & F.forall("x", fits))
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("int")).alias("v"))


def matrix(column: pa.Array, n: int, kind: str):
    """The rows of an Arrow list column, all of one length, as a matrix."""
    import numpy as np

    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1).astype(np.dtype(kind), copy=False)


def covariance(vectors: DataFrame, dims: int):
    """Mean and covariance of the column v, from one row of sums a task and cell."""
    import numpy as np

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims + 1, dims + 1))
        for batch in batches:
            v = matrix(batch.column(0), batch.num_rows, "f8")
            v = np.hstack([v, np.ones((len(v), 1))])
            total += v.T @ v
        if total[-1, -1]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["cell", "part"])

    rows = vectors.select("v").mapInArrow(sums, "cell long, part double").groupBy("cell").agg(F.sum("part").alias("s")).collect()
    total = np.zeros((dims + 1) ** 2)
    for r in rows:
        total[r.cell] = r.s
    total = total.reshape(dims + 1, dims + 1)
    n = max(total[-1, -1], 1)
    mean = total[-1, :-1] / n
    return mean, total[:-1, :-1] / n - np.outer(mean, mean)


def rotated(v, mean, axes):
    """Leading coordinates and residual norms of the rows of ``v``."""
    import numpy as np

    y = v - mean
    lead = y @ axes
    return lead, np.sqrt(((y - lead @ axes.T) ** 2).sum(1))


def indexed(vectors: DataFrame, mean, axes) -> DataFrame:
    """(vec_id, v, lead, rest): the vectors with their rotated form."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, rest = rotated(matrix(batch.column(1), batch.num_rows, "f8"), mean, axes)
            rows = pa.FixedSizeListArray.from_arrays(pa.array(lead.ravel()), axes.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), rows, pa.array(rest)], ["vec_id", "v", "lead", "rest"])

    return vectors.select("vec_id", "v").mapInArrow(rotate, "vec_id long, v array<int>, lead array<double>, rest double")


def nearest(v, lead, rest, centroids, c_lead, c_rest):
    """(cluster, distance) of each row, and how many distances were verified; exact, ties to the smaller number."""
    import numpy as np

    n, k = len(v), len(centroids)
    own, other = (lead**2).sum(1), (c_lead**2).sum(1)
    bound = own[:, None] + other - 2 * (lead @ c_lead.T) + (rest[:, None] - c_rest) ** 2
    bound -= SLACK * ((own + rest**2)[:, None] + (other + c_rest**2) + 1)
    distance = np.full((n, k), np.iinfo(np.int64).max)

    def verify(i, j) -> None:
        for a in range(0, len(i), VERIFIED):
            x, y = i[a : a + VERIFIED], j[a : a + VERIFIED]
            distance[x, y] = ((v[x].astype(np.int64) - centroids[y]) ** 2).sum(1)

    row, first = np.arange(n), bound.argmin(1)
    verify(row, first)
    left = bound <= distance[row, first][:, None]
    left[row, first] = False
    verify(*np.nonzero(left))
    cluster = distance.argmin(1)
    return cluster, distance[row, cluster], n + int(left.sum())


def assignments(held):
    """Batches of (vec_id, v, lead, rest) with each row's cluster and distance; ``held`` broadcasts rotation and centroids."""

    def run(batches: Iterator[pa.RecordBatch]):
        mean, axes, centroids = held.value
        c_lead, c_rest = rotated(centroids.astype(float), mean, axes)
        for batch in batches:
            n = batch.num_rows
            v = matrix(batch.column(1), n, "i8")
            cluster, distance, _ = nearest(v, matrix(batch.column(2), n, "f8"), batch.column(3).to_numpy(), centroids, c_lead, c_rest)
            yield batch.column(0), v, cluster, distance

    return run


def means(rows: DataFrame, held, dims: int) -> dict[int, list[int]]:
    """The componentwise floor of the mean of each cluster that has vectors."""
    each = assignments(held)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros((len(held.value[2]), dims + 1), np.int64)  # the last column counts
        for _, v, cluster, _ in each(batches):
            for k in np.unique(cluster):
                own = v[cluster == k]
                total[k, :-1] += own.sum(0)
                total[k, -1] += len(own)
        k, i = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(i), pa.array(total[k, i])], ["k", "i", "part"])

    parts = rows.mapInArrow(sums, "k long, i long, part long")
    found: dict[int, list[int]] = {}
    for r in parts.groupBy("k", "i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("s")).collect():
        found.setdefault(r.k, [0] * (dims + 1))[r.i] = int(r.s)
    return {k: [s // total[-1] for s in total[:-1]] for k, total in found.items()}


def cluster_vectors(
    vectors: DataFrame,
    *,
    clusters: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    lead: int = 16,
    seed: int = 1,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector that takes part."""
    import numpy as np

    spark = vectors.sparkSession
    rows = integer_vectors(vectors, vec_id, embedding, dims, scale)
    mean, spread = covariance(rows, dims)
    axes = np.linalg.eigh(spread)[1][:, ::-1][:, :lead].copy()
    rows = materialize(indexed(rows, mean, axes), "rotated")
    starts = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    centroids = np.array([r.v for r in starts.orderBy("h", "v").limit(clusters).collect()], np.int64).reshape(-1, dims)
    if not len(centroids):
        rows, centroids = rows.where("false"), np.zeros((1, dims), np.int64)
    share = lambda: spark.sparkContext.broadcast((mean, axes, centroids))
    for _ in range(rounds):
        moved = means(rows, share(), dims)
        centroids = np.array([moved.get(k, own) for k, own in enumerate(centroids.tolist())], np.int64)
    each = assignments(share())

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, _, cluster, distance in each(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster.astype("i4")), pa.array(distance)], ["vec_id", "cluster", "distance"])

    assigned = materialize(rows.mapInArrow(last, "vec_id long, cluster int, distance long"), "assigned")
    inertia = {r.cluster: r.s for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(k, int(s), int(sum(inertia.values())), sha[k]) for k, s in sorted(inertia.items())]
    facts = spark.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
