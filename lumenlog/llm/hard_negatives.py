"""Hard-negative mining with cover trees over norm-augmented candidates.

Components become integers, ``floor(scale * x)``, so scores, the inner products, are exact.  A candidate x gets one more
coordinate, ``sqrt(M^2 - |x|^2)`` for the largest norm M, and an anchor q a zero: then
``q.x = (|q|^2 + M^2 - distance^2) / 2``, and what a ball around a tree's node covers bounds the inner products of all
that hangs below it, from above and below.

1. The top level is a net of centres, taken farthest first from a bounded sample; every row goes to its nearest centre.
   The rows of a centre make blocks of about ``block_rows``.
2. Each block becomes a cover tree, stored as one row: a node's children are a net of its members at half its covering
   radius, each with the radius that covers its own members.  Where no small net covers them (vectors without
   structure), children are spread members.  Nodes of ``LEAF`` members or fewer are leaves.
3. Anchors are broadcast in batches of ``query_bytes``.  They descend best first in the blocks of their own centre, which
   gives the score that another row must reach to be a positive, and then in all blocks whose balls can reach it.
4. With the positives known, an anchor's windows of negative scores are searched in one descent a block.  Nodes that no
   window meets are skipped, as are those below the scores a task has found enough of; leaves are verified exactly.

Every row is indexed, and the bounds only skip what cannot be in the result, so the result is exact.  Work grows as
anchors x blocks for the roots' balls, which is one product a block, and as the blocks that balls reach for the rest.  In
vectors without structure that is all of them.

Defined results: rows with a null id or label, a null vector, a null or non-finite component, or of another length than
most take no part, nor do those with a scaled component beyond 2 ** 26; rows that share an id are rows of their own, and
only an anchor's own row is left out; equal scores go to the smaller id; a positive score below zero has no window;
fewer rows than asked for are all returned; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize

LARGEST = 1 << 26
LEAF = 96
TREE = (
    "cell long, ids array<long>, own_rows array<long>, labels array<long>, v array<int>, "
    "centre array<int>, radius array<double>, first array<int>, last array<int>, child array<int>, children array<int>, label array<long>"
)
POSITIVE = "anchor_row long, anchor_id long, vec_id long, score long"
NEGATIVE = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, vec_id long, score long"


def valid_rows(vectors: DataFrame, vec_id: str, embedding: str, label: str, scale: int) -> DataFrame:
    """(row, vec_id, label, v): the rows that take part, with integer components."""
    x = F.col("x")
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.expr(label).cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("x"))
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST / scale)
    rows = rows.where(x.isNotNull() & F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, fits))
    size = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size(x) == (size["n"] if size else 1))
    return rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", F.transform(x, lambda x: F.floor(x * scale).cast("int")).alias("v"))


def augmented(v, most: int):
    """Rows of ``v`` with the coordinate that gives all the norm ``sqrt(most)``."""
    import numpy as np

    return np.hstack([v, np.sqrt(np.maximum(most - (v**2).sum(1, keepdims=True), 0))])


def farthest_first(points, start: int, most: int, radius: float):
    """Centres, taken farthest first until ``radius`` covers all points or there are ``most``, with each point's nearest one
    and its distance."""
    import numpy as np

    centres = [start]
    far = np.sqrt(((points - points[start]) ** 2).sum(1))
    near = np.zeros(len(points), np.int64)
    while len(centres) < most:
        at = int(far.argmax())
        if far[at] <= radius:
            break
        d = np.sqrt(((points - points[at]) ** 2).sum(1))
        closer = d < far
        near[closer], far[closer] = len(centres), d[closer]
        centres.append(at)
    return centres, near, far


def cover_tree(v, labels, most: int):
    """The members' order and the nodes of a block's cover tree, parents before children."""
    import numpy as np

    points = augmented(v.astype(float), most)
    nodes: list[list] = []  # centre, radius, first, last, child, children
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    todo = [(np.arange(len(v)), start, 0)]
    order = np.empty(len(v), np.int64)
    k = 0
    while k < len(todo):  # level by level, so the children of a node stand together
        members, centre, first = todo[k]
        own = points[members]
        radius = float(np.sqrt(((own - points[centre]) ** 2).sum(1)).max())
        order[first : first + len(members)] = members
        node = [centre, radius, first, first + len(members), len(todo), 0]
        if len(members) > LEAF and radius > 0:
            net = max(4, len(members) // LEAF)
            centres, near, far = farthest_first(own, int(np.flatnonzero(members == centre)[0]), net, radius / 2)
            if far.max() > radius / 2 and len(centres) == net:
                centres = np.linspace(0, len(own) - 1, net).astype(np.int64).tolist()
                near = np.stack([((own - own[c]) ** 2).sum(1) for c in centres]).argmin(0)
            at = first
            for j, c in enumerate(centres):
                child = members[near == j]
                if 0 < len(child) < len(members):
                    todo.append((child, int(members[c]), at))
                    at += len(child)
                    node[5] += 1
            if at != first + len(members):  # equal points only
                del todo[node[4] :]
                node[5] = 0
        nodes.append(node)
        k += 1
    seat = np.empty(len(v), np.int64)
    seat[order] = np.arange(len(v))
    table = np.array([n[2:] for n in nodes], np.int64)
    label = labels[order]
    same = [int(label[a]) if (label[a:b] == label[a]).all() else None for a, b in table[:, :2]]
    return order, seat[[n[0] for n in nodes]], np.array([n[1] for n in nodes]), table, same


def planted(most: int):
    """Stored blocks, one in each row, to stored trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), *[pa.list_(pa.int32())] * 4, pa.list_(pa.int64())]
        names = [c.split()[0] for c in TREE.split(", ")]
        for batch in batches:
            for cell, members in zip(batch.column(0), batch.column(1), strict=True):
                own = members.values
                ids, rows, labels = (own.field(c).to_numpy() for c in ("vec_id", "row", "label"))
                v = own.field("v").flatten().to_numpy(zero_copy_only=False).reshape(len(own), -1)
                order, centre, radius, table, same = cover_tree(v, labels, most)
                out = [cell.as_py(), ids[order], rows[order], labels[order], v[order].ravel(), centre.astype("i4"), radius, *table.astype("i4").T, same]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, kinds, strict=True)], names)

    return run


class Tree:
    """A stored block.  Products are taken in 64-bit floats where all of them fit 53 bits, which is exact, else in integers."""

    def __init__(self, batch: pa.RecordBatch, k: int, most: int):
        import numpy as np

        get = lambda name: batch.column(name)[k].values.to_numpy(zero_copy_only=False)
        self.kind = np.float64 if most < 1 << 52 else np.int64
        self.cell = batch.column("cell")[k].as_py()
        self.ids, self.rows, self.labels = get("ids"), get("own_rows"), get("labels")
        self.v = get("v").reshape(len(self.ids), -1).astype(self.kind)
        self.radius, self.first, self.last, self.child, self.children = (get(c) for c in ("radius", "first", "last", "child", "children"))
        self.centres = self.v[get("centre")]
        self.label = batch.column("label")[k].as_py()
        self.most = most

    def bounds(self, dots, q2, radius):
        """Least and greatest inner product with what the balls of ``radius`` hold, given those with their centres."""
        import numpy as np

        both = q2 + self.most
        d = np.sqrt(np.maximum(both - 2.0 * dots, 0))
        slack = 1e-7 * both + 1
        return (both - (d + radius) ** 2) / 2 - slack, (both - np.maximum(d - radius, 0) ** 2) / 2 + slack

    def leaves(self, q, q2: float, label: int, alike: bool, reach, top: float):
        """Leaves, best first, that can hold a score from ``reach()`` to ``top`` of a row of the ``label`` (if ``alike``, else
        of another), with their rows' scores.  ``reach`` is asked again before each node."""
        lo, hi = self.bounds(self.centres[:1] @ q, q2, self.radius[:1])
        heap = [(-min(float(hi[0]), top), 0)] if lo[0] <= top else []
        while heap:
            best, k = heapq.heappop(heap)
            if -best < reach():
                return
            if self.label[k] is not None and (self.label[k] == label) != alike:
                continue
            n = int(self.children[k])
            if not n:
                own = slice(int(self.first[k]), int(self.last[k]))
                yield own, self.v[own] @ q
                continue
            a = int(self.child[k])
            lo, hi = self.bounds(self.centres[a : a + n] @ q, q2, self.radius[a : a + n])
            for j in ((lo <= top) & (hi >= reach())).nonzero()[0].tolist():
                heapq.heappush(heap, (-min(float(hi[j]), top), a + j))


def kept_best(held: list, scores, ids, k: int) -> list:
    """The ``k`` best of what is held and new scores, as (-score, id)."""
    return sorted([*held, *zip((-scores).tolist(), ids.tolist(), strict=True)])[:k]


def search_positives(held, most: int, k: int, home: bool):
    """Best rows of the anchors' own labels in the blocks of their own centre (``home``) or in all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows, ids, labels, cells, q, least = held.value
        found: dict[int, list] = {}
        for batch in batches:
            for b in range(batch.num_rows):
                tree = Tree(batch, b, most)
                own = q.astype(tree.kind)
                q2 = (own**2).sum(1).astype(float)
                _, hi = tree.bounds(own @ tree.centres[0], q2, tree.radius[0])
                for i in np.flatnonzero(((cells == tree.cell) == home) & (hi >= least)).tolist():
                    reach = lambda i=i: max(least[i], -found[i][-1][0] if len(found.get(i, ())) == k else -np.inf)
                    for at, s in tree.leaves(own[i], q2[i], labels[i], True, reach, np.inf):
                        fits = (tree.labels[at] == labels[i]) & (s >= reach()) & (tree.rows[at] != rows[i])
                        if fits.any():
                            found[i] = kept_best(found.get(i, []), s[fits], tree.ids[at][fits], k)
        out = [(rows[i], ids[i], x, int(-s)) for i, best in found.items() for s, x in best]
        yield as_batch(out, POSITIVE)

    return run


def search_negatives(held, most: int, k: int, low: tuple[int, int], high: tuple[int, int]):
    """Best rows of other labels in the windows of the anchors' positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        rows, ids, labels, q, positives = held.value
        windows = []  # of each anchor: least and greatest scores
        for own in positives:
            s = np.array([score for _, score in own], np.int64).reshape(-1)
            windows.append((-((-low[0] * s) // low[1]), (high[0] * s) // high[1]))
        bottom = np.array([a[a <= b].min() if (a <= b).any() else np.inf for a, b in windows], float)
        top = np.array([b[a <= b].max() if (a <= b).any() else -np.inf for a, b in windows], float)
        found: dict[tuple[int, int], list] = {}
        for batch in batches:
            for t in range(batch.num_rows):
                tree = Tree(batch, t, most)
                own = q.astype(tree.kind)
                q2 = (own**2).sum(1).astype(float)
                lo, hi = tree.bounds(own @ tree.centres[0], q2, tree.radius[0])
                for i in np.flatnonzero((hi >= bottom) & (lo <= top)).tolist():
                    a, b = windows[i]
                    open_ = [p for p in range(len(a)) if a[p] <= b[p]]
                    floor = {p: max(float(a[p]), -found[i, p][-1][0] if len(found.get((i, p), ())) == k else -np.inf) for p in open_}
                    for at, s in tree.leaves(own[i], q2[i], labels[i], False, lambda f=floor: min(f.values()), float(top[i])):
                        other = (tree.labels[at] != labels[i]) & (s >= min(floor.values())) & (s <= top[i])
                        if not other.any():
                            continue
                        s, x = s[other], tree.ids[at][other]
                        for p in open_:
                            fits = (s >= floor[p]) & (s <= b[p])
                            if fits.any():
                                found[i, p] = best = kept_best(found.get((i, p), []), s[fits], x[fits], k)
                                if len(best) == k:
                                    floor[p] = max(floor[p], float(-best[-1][0]))
        out = [(rows[i], ids[i], p, *positives[i][p], x, int(-s)) for (i, p), best in found.items() for s, x in best]
        yield as_batch(out, NEGATIVE)

    return run


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [c.split() for c in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if t == "int" else pa.int64()) for c, (_, t) in zip(cols, names, strict=True)], [n for n, _ in names])


def to_cells(centres, most: int):
    """Rows with the number of their nearest centre."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            v = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            points = augmented(v.astype(float), most)
            near = (points @ (-2 * centres.T) + (centres**2).sum(1)).argmin(1) if len(points) else np.zeros(0, np.int64)
            yield batch.append_column("cell", pa.array(near))

    return run


def planted_blocks(rows: DataFrame, n: int, most: int, block_rows: int, sample_rows: int, most_cells: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their cells, and the trees of all blocks."""
    import numpy as np

    share = min(1.0, sample_rows / max(n, 1))
    sample = rows.where(F.pmod(F.xxhash64("row", F.lit("net")), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).select("v").limit(2 * sample_rows).toArrow()["v"]
    if not len(sample):  # few rows
        sample = rows.select("v").limit(1).toArrow()["v"]
    points = augmented(sample.combine_chunks().flatten().to_numpy().reshape(len(sample), -1).astype(float), most)
    cells = max(1, min(most_cells, n // block_rows))
    centres = points[farthest_first(points, 0, cells, 0.0)[0]]
    rows = materialize(rows.mapInArrow(to_cells(centres, most), "row long, vec_id long, label long, v array<int>, cell long"), "cells")
    parts = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("parts"))
    dealt = rows.join(F.broadcast(parts), "cell")  # most_cells rows at most
    dealt = dealt.groupBy("cell", F.pmod(F.xxhash64("row", F.lit("part")), F.col("parts")).alias("part")).agg(F.collect_list(F.struct("row", "vec_id", "label", "v")).alias("members"))
    return rows, materialize(dealt.select("cell", "members").mapInArrow(planted(most), TREE), "trees")


def hard_negatives(
    vectors: DataFrame,
    *,
    label: str,
    is_anchor: str = "vec_id % 100 = 0",
    positives: int = 5,
    negatives: int = 10,
    low: tuple[int, int] = (30, 100),
    high: tuple[int, int] = (90, 100),
    scale: int = 256,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    block_rows: int = 8_000,
    sample_rows: int = 4_096,
    most_cells: int = 256,
    query_bytes: int = 16 << 20,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    ``label`` and ``is_anchor`` are SQL expressions.  Of each row that ``is_anchor`` names the ``positives`` best other rows of its label, and for each of them the
    ``negatives`` best rows of other labels with ``low * positive_score <= score <= high * positive_score``; ``low`` and
    ``high`` are fractions.
    """
    import numpy as np

    spark = vectors.sparkSession
    rows = materialize(valid_rows(vectors, vec_id, embedding, label, scale), "valid")
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)).alias("most"), F.max(F.size("v")).alias("dims")).first()
    if not facts["n"]:
        empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
        return spark.createDataFrame([], empty)
    most, width = facts["most"], 4 * facts["dims"]
    block_rows = max(1, min(block_rows, (64 << 20) // (2 * width)))
    rows, trees = planted_blocks(rows, facts["n"], most, block_rows, sample_rows, most_cells)
    asked = rows.where(is_anchor)
    batches = max(1, -(-asked.count() * width // query_bytes))
    best = lambda *key: F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "vec_id"))
    out = None
    for b in range(batches):
        own = asked if batches == 1 else asked.where(F.pmod(F.xxhash64("row", F.lit("batch")), F.lit(batches)) == b)
        got = own.toArrow().sort_by("row")
        ids, numbers, labels, cells = (got[c].to_numpy() for c in ("vec_id", "row", "label", "cell"))
        q = got["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        least = np.full(len(ids), -np.inf)
        share = spark.sparkContext.broadcast
        near = materialize(trees.mapInArrow(search_positives(share((numbers, ids, labels, cells, q, least)), most, positives, True), POSITIVE), "near")
        place = {int(x): k for k, x in enumerate(numbers)}
        enough = near.withColumn("rank", best("anchor_row")).where(F.col("rank") == positives).select("anchor_row", "score")
        for r in enough.toLocalIterator():
            least[place[r.anchor_row]] = r.score
        rest = trees.mapInArrow(search_positives(share((numbers, ids, labels, cells, q, least)), most, positives, False), POSITIVE)
        chosen = near.unionByName(rest).withColumn("rank", best("anchor_row")).where(F.col("rank") <= positives)
        held: list[list] = [[] for _ in ids]
        for r in sorted(chosen.collect(), key=lambda r: r["rank"]):  # a few numbers for each anchor of the batch
            held[place[r.anchor_row]].append((r.vec_id, r.score))
        part = trees.mapInArrow(search_negatives(share((numbers, ids, labels, q, held)), most, negatives, low, high), NEGATIVE)
        part = part.withColumn("rank", best("anchor_row", "place")).where(F.col("rank") <= negatives)
        if batches > 1:
            part = materialize(part, "mined")
        out = part if out is None else out.unionByName(part)
    return out.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
