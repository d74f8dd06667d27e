"""Approximate nearest neighbours by collision counting over single-projection sorted arrays.

Vectors are dealt into blocks of bounded size by a hash of their values, so equal vectors share a block and
count once there.  In a block each of ``projections`` random directions keeps the vectors sorted by their
projection.  A query opens a window around its own projection in every array and widens all windows step by
step (virtual rehashing: a wider window is the next coarser hash, without a new table).  A vector collides in each
array whose window holds it.  Those that reach the collision threshold are verified: their exact distance is computed
on the original vectors.  A window is wide enough for vectors at distance d at ``reach`` times d: then those collide in
over the threshold's share of the arrays.  So widening ends once the window is ``reach`` times the distance of the
``k``-th nearest verified, which takes few verifications where near vectors are much nearer than others.
Blocks work alone; a window over all blocks' best gives each query its nearest.

Every vector is indexed; nothing is sampled.  Each block is stored once, as one row, and is read once for each
broadcast of queries; those hold ``query_bytes`` at most.

Defined results: vectors that are null, zero, of another length than most, or that
hold null or non-finite components take no part as query or candidate; equal distances go to the smaller id;
a query with fewer than ``k`` candidates gets all; rows that share an id are queries and candidates of their own, and
only the query's own row is left out; null ids take no part; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import materialize

FOUND = "query_row long, query_id long, vec_id long, score double"


def valid_vectors(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, of the most frequent length."""
    v = F.col("v")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).where(
        v.isNotNull()
        & F.col("vec_id").isNotNull()
        & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists(v, lambda x: x != 0)
    )
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


class Block:
    """The sorted arrays of one block of vectors."""

    def __init__(self, ids, rows, vectors, directions):
        import numpy as np

        self.vectors, where = np.unique(vectors, axis=0, return_inverse=True)
        where = where.ravel()
        order = np.lexsort((rows, ids, where))
        self.ids, self.rows, own = ids[order], rows[order], where[order]
        self.first = np.searchsorted(own, np.arange(len(self.vectors) + 1))  # where the ids of each distinct vector stand
        self.copies = np.diff(self.first)
        p = directions @ self.vectors.T
        self.order = np.argsort(p, axis=1, kind="stable")
        self.sorted = np.take_along_axis(p, self.order, 1)
        # all arrays in one, each in a range of its own, so that one search finds all ends of the windows
        self.span = 4 * float(np.abs(p).max()) + 1
        self.base = np.arange(len(p)) * self.span
        self.flat = (self.sorted + self.base[:, None]).ravel()
        self.start = np.median(np.abs(p - np.median(p, axis=1, keepdims=True))) / 2 or 1e-12  # unlike vectors do not reach the threshold yet

    def ends(self, at, side: str):
        import numpy as np

        m, n = self.sorted.shape
        at = np.clip(at, -self.span / 3, self.span / 3)  # beyond all projections is as good as at their end
        return np.clip(np.searchsorted(self.flat, at + self.base, side) - np.arange(m) * n, 0, n)

    def nearest(self, query_id: int, query_row: int, query, at, threshold: int, reach: float, k: int) -> tuple[list[tuple], int]:
        """The best ``k`` candidates of a query with its projections ``at``, and how many vectors were verified."""
        import numpy as np

        m, n = self.sorted.shape
        counts, distance = np.zeros(n, np.int16), np.full(n, np.inf)
        lo = self.ends(at, "left")
        hi = lo.copy()
        width, verified, enough = self.start, np.zeros(0, np.int64), np.inf
        while True:
            a, b = np.minimum(self.ends(at - width, "left"), lo), np.maximum(self.ends(at + width, "right"), hi)
            new = [self.order[j, a[j] : lo[j]] for j in range(m)] + [self.order[j, hi[j] : b[j]] for j in range(m)]
            counts += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)  # a vector stands in an array once
            lo, hi = a, b
            found = np.flatnonzero((counts >= threshold) & (distance == np.inf))
            if len(found):
                distance[found] = np.sqrt(((self.vectors[found] - query) ** 2).sum(1))
                verified = np.concatenate([verified, found])
                verified = verified[np.argsort(distance[verified], kind="stable")]
                # the query's own row is among the copies of a vector at distance 0
                place = int(np.searchsorted(np.cumsum(self.copies[verified]), k + 1))
                enough = reach * distance[verified[place]] if place < len(verified) else np.inf
            if width >= enough or (hi - lo).min() == n:
                break
            width = min(width * 1.3, max(enough, width * 1.02))
        out = []
        for i in verified.tolist():
            if len(out) >= k and distance[i] > out[-1][0]:
                break
            own = slice(self.first[i], self.first[i + 1])
            ids = self.ids[own][self.rows[own] != query_row][:k]
            out += [(float(distance[i]), int(v)) for v in ids]
        return [(query_row, query_id, v, x) for x, v in sorted(out)[:k]], len(verified)


def search_blocks(held, projections: int, threshold: int, reach: float, k: int, seed: int):
    """Searches stored blocks, one in each row, for the queries of a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows, ids, vectors = held.value
        for batch in batches:
            for members in batch.column(0):
                own = members.values
                flat = own.field("v").flatten().to_numpy(zero_copy_only=False)
                directions = np.random.default_rng(seed).normal(size=(projections, len(flat) // len(own)))
                block = Block(own.field("vec_id").to_numpy(), own.field("row").to_numpy(), flat.reshape(len(own), -1), directions)
                out: list[tuple] = []
                for row, query_id, v, at in zip(rows.tolist(), ids.tolist(), vectors, vectors @ directions.T, strict=True):
                    out += block.nearest(query_id, row, v, at, threshold, reach, k)[0]
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["query_row", "query_id", "vec_id", "score"])

    return run


def stored_blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """One row a block: an array of (vec_id, row, v)."""
    blocks = max(1, -(-rows.count() // block_rows))
    # equal vectors go to one block unless they are so many that they would crowd it: then their rows are dealt
    copies = rows.groupBy(F.xxhash64("v").alias("h")).count().where(F.col("count") > block_rows // 8)
    hot = materialize(copies.select("h", F.ceil(F.col("count") / (block_rows // 8)).alias("parts")), "hot-vectors")
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(0)
    dealt = rows.withColumn("h", F.xxhash64("v")).join(hot, "h", "left")
    dealt = dealt.select("vec_id", "row", "v", F.pmod(F.xxhash64("h", part), F.lit(blocks)).alias("block"))
    return materialize(dealt.groupBy("block").agg(F.collect_list(F.struct("vec_id", "row", "v")).alias("members")).select("members"), "blocks")


def nearest_neighbours(
    vectors: DataFrame,
    *,
    is_query: str = "vec_id % 100 = 0",
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    projections: int = 128,
    threshold: int = 90,
    reach: float = 1.15,
    block_rows: int = 8_000,
    query_bytes: int = 32 << 20,
    seed: int = 17,
) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest found for every row that ``is_query`` names."""
    spark = vectors.sparkSession
    rows = materialize(valid_vectors(vectors, vec_id, embedding).withColumn("row", F.monotonically_increasing_id()), "vectors")
    first = rows.select(F.size("v").alias("n")).first()
    size = 8 * first["n"] if first else 8
    blocks = stored_blocks(rows, max(1, min(block_rows, (64 << 20) // size)))
    asked = rows.where(is_query)
    batches = max(1, -(-asked.count() * size // query_bytes))
    rank = F.row_number().over(W.partitionBy("query_row").orderBy("score", "vec_id"))
    best = None
    for b in range(batches):
        own = asked if batches == 1 else asked.where(F.pmod(F.xxhash64("row", F.lit("batch")), F.lit(batches)) == b)
        got = own.select("row", "vec_id", "v").toArrow()
        flat = got["v"].combine_chunks().flatten().to_numpy()
        held = spark.sparkContext.broadcast((got["row"].to_numpy(), got["vec_id"].to_numpy(), flat.reshape(got.num_rows, -1) if got.num_rows else flat.reshape(0, size // 8)))
        part = blocks.mapInArrow(search_blocks(held, projections, threshold, reach, k, seed), FOUND)
        part = part.withColumn("rank", rank).where(F.col("rank") <= k)
        if batches > 1:
            part = materialize(part, "found")
        best = part if best is None else best.unionByName(part)
    return best.select("query_id", "rank", "vec_id", "score")
