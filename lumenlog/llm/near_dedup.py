"""MinHash near-dedup by a chosen-path set similarity join.

A document's set holds the hashes of its distinct shingles of ``WORDS`` words (A-Z lower-cased, cut at ASCII white
space); one of fewer words is a single shingle.  Documents of equal sets are one class.  From then on:

1. Each class gets ``POSITIONS`` minwise tokens.  At the root of every tree one of them is chosen; classes that
   agree on it go to the same child node, so all trees together make ``ROOTS`` nodes a class.
2. A node of at most ``node_limit`` classes is compared exhaustively, by the share of equal minwise tokens.  A
   larger one branches again, and again, by two more tokens, chosen by the node's own hash.  A child that keeps over half
   of its node is a family of near copies, which branching does not part: it is compared in blocks (4), like what is
   still too large at the last of ``LEVELS``, so no node is skipped or capped.
3. Pairs that look alike enough join classes into candidate groups.  Inside a group all pairs that could
   matter are compared on their full sets; only these exact comparisons make links.
4. A group too large for one task meets in random blocks first, twice, each joined by the few members that look most
   like all others, and what is confirmed there becomes one part.  Only if a group is then still in several parts do
   the smaller parts meet every block.  A family of near copies is thus compared in linear time, however large it is;
   what costs more are large groups whose members look alike and are not.
5. Links make components; the smallest (id, hash of the text) of each stands for it.

Recall: a pair of similarity 0.75 shares none of the 10 root nodes with a probability of 1e-6, and looks too
unlike to be a candidate with one of 4e-4; both fall quickly with similarity and with further links.

Scale: texts are read twice (signatures, then the sets of candidates).  Every group that meets in a task is
bounded: nodes by ``node_limit`` classes, candidate groups by ``group_limit`` classes and ``group_shingles``
shingles.  Copies collapse into classes before they meet, of rows equal in id and text one is read, and the few classes of very many copies go back to
their rows by a broadcast, whose size is bound by their number.

Defined results: null and wordless texts have 0 shingles and are linked with nothing; so are rows with a null
id, whose component is null and which are kept; rows that share an id are each judged by their own text, and
rows equal in id and text alike; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import LOWER_FOLD, binary_values, materialize
from .components import connected_components

WORDS = 5
POSITIONS = 64
ROOTS = 10
LEVELS = 6
#: Equal minwise tokens, of POSITIONS, that make a pair a candidate.
ALIKE = 36
SIGNATURE = "struct<fp:binary,n:bigint,sig:binary,tokens:array<bigint>>"


class WordHashes(dict):
    """64-bit hashes of words; bounded, as it starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_set(raw: bytes | None, hashes: WordHashes):
    """The sorted distinct shingle hashes of a text, as uint64."""
    import numpy as np

    words = (raw or b"").translate(LOWER_FOLD).split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(h))
    s = np.full(len(h) - size + 1, size, np.uint64)
    for j in range(size):
        s = s * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - size + 1 + j]
        s ^= s >> np.uint64(29)
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    s = (s ^ (s >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return np.unique(s ^ (s >> np.uint64(32)))


def multipliers():
    import numpy as np

    return np.random.default_rng(20).integers(1, 1 << 63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(shingles, odd):
    """The least value of the set under each of the multiplicative orders; exact for sets of any size."""
    import numpy as np

    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        np.minimum(least, np.multiply.outer(odd, shingles[k : k + 2048]).min(1), out=least)
    return least


def signature(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    import numpy as np
    import xxhash

    odd, hashes = multipliers(), WordHashes()
    kind = pa.struct([("fp", pa.binary()), ("n", pa.int64()), ("sig", pa.binary()), ("tokens", pa.list_(pa.int64()))])
    for batch in batches:
        out = []
        for raw in binary_values(batch):
            s = shingle_set(raw, hashes)
            if len(s):
                least = minwise(s, odd)
                short = ((least * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)).astype("<u4")
                out.append({"fp": xxhash.xxh3_128_digest(s.tobytes()), "n": len(s), "sig": short.tobytes(), "tokens": least[:ROOTS].view(np.int64)})
            else:
                out.append({"fp": None, "n": 0, "sig": None, "tokens": None})
        yield pa.array(out, kind)


def full_set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    hashes = WordHashes()
    for batch in batches:
        yield pa.array([shingle_set(raw, hashes).tobytes() for raw in binary_values(batch)], pa.binary())


def sorted_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole groups, from batches sorted by their first column, ``g``."""
    import numpy as np

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        g = batch.column(0).to_numpy()
        cut = int(np.searchsorted(g, g[-1]) if g[0] <= g[-1] and (np.diff(g) >= 0).all() else np.flatnonzero(np.diff(g))[-1] + 1)
        if held and (cut or held[0].column(0)[0].as_py() != g[0]):
            if held[0].column(0)[0].as_py() != g[0]:
                yield pa.Table.from_batches(held)
                held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def stars(alike) -> list[tuple[int, int]]:
    """An edge from the first member of each connected part of the graph, given as a boolean matrix, to every other one."""
    import numpy as np

    n = len(alike)
    unseen, out = np.ones(n, bool), []
    for start in range(n):
        if not unseen[start]:
            continue
        unseen[start] = False
        todo = [start]
        while todo:
            near = np.flatnonzero(alike[todo.pop()] & unseen)
            unseen[near] = False
            out += [(start, v) for v in near.tolist()]
            todo += near.tolist()
    return out


def alike_in_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(g, rep, known, sig) rows sorted by node g to candidate edges (a, b)."""
    import numpy as np

    for table in sorted_groups(batches):
        table = table.combine_chunks()
        g, rep = table.column(0).to_numpy(), table.column(1).to_numpy()
        sig = np.frombuffer(b"".join(table.column(3).to_pylist()), "<u4").reshape(len(g), POSITIONS)
        start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        size = np.diff(np.concatenate((start, [len(g)])))
        two = start[size == 2]
        two = two[(sig[two] == sig[two + 1]).sum(1) >= ALIKE]
        a, b = [rep[two]], [rep[two + 1]]
        for s, n in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            at = s + np.argsort(rep[s : s + n], kind="stable")  # the first is the least, so edges go to the least
            own = sig[at]
            alike = np.zeros((n, n), bool)
            rows = max(1, (1 << 20) // (n * POSITIONS) * 4)
            for k in range(0, n, rows):
                alike[k : k + rows] = (own[k : k + rows, None, :] == own[None, :, :]).sum(2, dtype=np.uint8) >= ALIKE
            if edges := stars(alike):
                e = np.array(edges)
                a.append(rep[at[e[:, 0]]])
                b.append(rep[at[e[:, 1]]])
        a, b = np.concatenate(a), np.concatenate(b)
        real = a != b
        yield pa.RecordBatch.from_arrays([pa.array(a[real]), pa.array(b[real])], ["a", "b"])


def linked_in_group(reps, known, sets, numerator: int, denominator: int) -> list[tuple[int, int]]:
    """Edges (class, class) that connect the group as its exact links do; classes of equal ``known`` are connected already."""
    import numpy as np

    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    mask = np.zeros(int(ids.max()) + 1, np.int32)
    part = np.unique(known, return_inverse=True)[1]
    by_part = np.argsort(part, kind="stable")
    edge = np.searchsorted(part[by_part], np.arange(part.max() + 2))
    together = lambda i: by_part[edge[part[i]] : edge[part[i] + 1]]
    unseen, out = np.ones(len(sets), bool), []
    for first in np.argsort(reps, kind="stable").tolist():
        if not unseen[first]:
            continue
        todo = together(first).tolist()
        unseen[todo] = False
        while todo:
            u = todo.pop()
            n = size[u]
            left = np.flatnonzero(unseen & (denominator * np.minimum(size, n) >= numerator * np.maximum(size, n)))
            if not len(left):
                continue
            own = ids[start[u] : start[u] + n]
            mask[own] = 1
            sizes = size[left]
            begin = np.cumsum(sizes) - sizes
            spot = np.arange(int(sizes.sum())) + np.repeat(start[left] - begin, sizes)
            both = np.add.reduceat(mask[ids[spot]], begin)
            mask[own] = 0
            near = left[denominator * both >= numerator * (sizes + n - both)]
            for v in near.tolist():
                out.append((int(reps[first]), int(reps[v])))
                if unseen[v]:
                    more = together(v)
                    unseen[more] = False
                    todo += more.tolist()
    return out


def links_of_groups(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for table in sorted_groups(batches):
            table = table.combine_chunks()
            g, rep, known = (table.column(k).to_numpy() for k in range(3))
            sets = [np.frombuffer(s, np.uint64) for s in table.column(3).to_pylist()]
            start = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))).tolist()
            found = []
            for a, b in zip(start, [*start[1:], len(g)], strict=True):
                if b - a > 1:
                    found += linked_in_group(rep[a:b], known[a:b], sets[a:b], numerator, denominator)
            cols = list(zip(*found, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["a", "b"])

    return run


def met(rows: DataFrame, key: Column, payload: str, compare) -> DataFrame:
    """Edges that ``compare`` finds among the rows of equal key."""
    dealt = rows.select(key.alias("g"), "rep", "known", payload).repartition("g").sortWithinPartitions("g")
    return materialize(dealt.mapInArrow(compare, "a long, b long").where("a <> b").distinct(), "edges")


def central_members(members: DataFrame, group: str, *, most: int = 16, positions: int = 16) -> DataFrame:
    """(group, rep) of the members (group, rep, sig) of each group that share most minwise tokens with the others."""
    tokens = F.array(*(F.substring("sig", 4 * p + 1, 4) for p in range(positions)))
    rows = members.select(group, "rep", F.posexplode(tokens).alias("p", "token"))
    common = rows.groupBy(group, "p", "token").agg(F.count(F.lit(1)).alias("n")).groupBy(group, "p").agg(F.max_by("token", F.struct("n", "token")).alias("token"))
    score = rows.join(common, [group, "p", "token"]).groupBy(group, "rep").agg(F.count(F.lit(1)).alias("score"))
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc("score"), "rep"))
    return score.withColumn("rank", rank).where(F.col("rank") <= most).select(group, "rep")


def connected_in_groups(
    members: DataFrame, group: str, parts: Column, payload: str, compare, *, edges: DataFrame | None = None, signed: DataFrame | None = None, rounds: int = 2
) -> DataFrame:
    """(vertex, component) of the members (group, rep, payload), connected as a comparison of all pairs of each group would.

    ``parts`` says how many blocks a group fills.  Those of one are compared at once.  Larger ones meet in random blocks
    ``rounds`` times; with ``signed``, the (rep, sig) of all members, each block also holds the central members.  Then
    those outside the largest connected part of their group meet all others, block by block.  ``edges`` are known before.
    """
    rows = members.select(group, "rep", payload, parts.cast("long").alias("parts"), F.col("rep").alias("known"))
    large = rows.where("parts > 1")
    some = bool(large.head(1))
    dealt = rows.where("parts = 1").withColumns({"block": F.lit(0).cast("long"), "round": F.lit(-1)})
    if some:
        both = large.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
        dealt = dealt.unionByName(both.withColumn("block", F.pmod(F.xxhash64("rep", "round"), F.col("parts"))))
        if signed is not None:
            hubs = materialize(central_members(large.select(group, "rep").join(signed, "rep"), group), "central")
            dealt = dealt.unionByName(both.join(hubs, [group, "rep"]).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))))
    found = met(dealt, F.xxhash64(group, "block", "round"), payload, compare)
    found = connected_components(found if edges is None else found.unionByName(edges))
    if not some:
        return found
    known = found.withColumnsRenamed({"vertex": "rep", "component": "known"})
    parted = large.select(group, "rep", "parts").join(known, "rep", "left")
    parted = materialize(parted.withColumn("known", F.coalesce("known", "rep")), "parted")  # least member of the part that the edges make
    size = parted.groupBy(group, "known").agg(F.count(F.lit(1)).alias("n"), F.max("parts").alias("parts"))
    load = size.groupBy(group).agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("all"), F.max("n").alias("most"), F.max_by("known", "n").alias("main"), F.max("parts").alias("parts"))
    # blocks for the largest part and for the rest, in proportion to their members
    blocks = lambda n: F.ceil(F.col("parts") * n / F.col("all")).cast("long")
    load = load.where("pieces > 1").select(group, "main", blocks(F.col("most")).alias("mains"), blocks(F.col("all") - F.col("most")).alias("rests"))
    load = materialize(load, "open-groups")
    if not load.head(1):
        return found
    rest = F.col("known") != F.col("main")
    ranks = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    at = F.pmod(F.xxhash64("rep", F.lit("rest")), F.when(rest, F.col("rests")).otherwise(F.col("mains")))
    # a pair of blocks is (rest, rest), lower number first, or (rest, main), whose number is negative
    pair = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    meets = F.when(rest, F.concat(F.transform(ranks(F.col("rests")), lambda j: pair(at, j)), F.transform(ranks(F.col("mains")), lambda j: pair(at, -1 - j)))).otherwise(
        F.transform(ranks(F.col("rests")), lambda j: pair(j, -1 - at))
    )
    spread = parted.join(load, group).select(group, "rep", "known", F.explode(meets).alias("pair"))
    sent = spread.join(large.select("rep", group, payload), ["rep", group])
    more = met(sent, F.xxhash64(group, "pair"), payload, compare)
    if not more.head(1):
        return found
    return connected_components(more.unionByName(found.select(F.col("component").alias("a"), F.col("vertex").alias("b"))))


def candidate_groups(reps: DataFrame, node_limit: int) -> DataFrame:
    """(vertex, component) of the classes that look alike in some node of some tree."""
    roots = reps.select("rep", F.posexplode("tokens").alias("k", "token"))
    nodes = roots.select(F.xxhash64("k", "token").alias("node"), "rep", F.lit(None).cast("long").alias("before"))
    size, compared = F.col("size"), None
    for level in range(LEVELS):
        sizes = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("before").alias("before")).where("size > 1")
        # a child that keeps over half of its node is a family, which more branching would only copy
        ends = (size <= node_limit) | (2 * size > F.col("before")) if level < LEVELS - 1 else F.lit(True)
        sizes = materialize(sizes.withColumn("ends", F.coalesce(ends, F.lit(False))), "nodes")
        members = materialize(nodes.select("node", "rep").join(sizes, "node").select("node", "rep", "size", "ends"), "members")
        own = members.where("ends").select("node", "rep", "size")
        compared = own if compared is None else compared.unionByName(own)
        if not sizes.where("not ends").head(1):
            break
        pick = F.explode(F.transform(F.array(F.lit(1), F.lit(2)), lambda b: F.pmod(F.xxhash64("node", b), F.lit(POSITIONS - ROOTS)) + ROOTS))
        large = members.where("not ends").join(reps.select("rep", "sig"), "rep").select("node", "rep", "sig", "size", pick.alias("p"))
        child = F.xxhash64("node", "p", F.expr("substring(sig, cast(4 * p + 1 as int), 4)"))
        nodes = materialize(large.select(child.alias("node"), "rep", F.col("size").alias("before")).distinct(), "children")
    members = compared.join(reps.select("rep", "sig"), "rep")
    return connected_in_groups(members, "node", F.ceil(size / node_limit), "sig", alike_in_nodes)


def one_of_equal_rows(own: DataFrame, signed: DataFrame) -> DataFrame:
    """``own`` with one of the rows that are equal in id and text."""
    key = ["doc_id", "text_hash"]
    again = materialize(signed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    if not again.head(1):
        return own
    once = own.join(again, key, "left_semi").groupBy(key).agg(F.first("text").alias("text"))
    return own.join(again, key, "left_anti").unionByName(once)


def near_duplicates(
    docs: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: tuple[int, int] = (3, 4),
    node_limit: int = 2048,
    group_limit: int = 1024,
    group_shingles: int = 1_000_000,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_hash and first of every row; ``similarity`` is the least Jaccard as
    a fraction.  ``kept`` says that the row has its component's id, ``first`` that it has its text too."""
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = materialize(own.withColumn("s", arrow_udf(SIGNATURE)(signature).asNondeterministic()("text")).select("doc_id", "text_hash", "s.*"), "signatures")
    whole = F.col("fp").isNotNull() & F.col("doc_id").isNotNull()
    classes = signed.where(whole).groupBy("fp").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("at"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("tokens").alias("tokens")
    )
    reps = materialize(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a class's number is what is stored
    groups = candidate_groups(reps, node_limit)
    every = groups.select(F.col("vertex").alias("rep"), "component").unionByName(groups.select(F.col("component").alias("rep"), "component").distinct())
    members = materialize(every.join(reps.select("rep", "n", "at"), "rep"), "members")
    load = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("load"))
    parts = F.greatest(F.ceil(F.col("size") / group_limit), F.ceil(F.col("load") / group_shingles))
    load = materialize(load.select("component", parts.cast("long").alias("parts")), "groups")
    dealt = members.join(load, "component").select("rep", "component", "parts", F.col("at.doc_id").alias("doc_id"), F.col("at.text_hash").alias("text_hash"))
    sets = one_of_equal_rows(own, signed.where(whole)).join(dealt, ["doc_id", "text_hash"]).select("rep", "component", "parts", arrow_udf("binary")(full_set).asNondeterministic()("text").alias("s"))
    joined = connected_in_groups(materialize(sets, "sets"), "component", F.col("parts"), "s", links_of_groups(*similarity), signed=reps.select("rep", "sig"))
    parted = joined.select(F.col("vertex").alias("rep"), "component").unionByName(joined.select(F.col("component").alias("rep"), "component").distinct())
    parted = materialize(parted.join(reps.select("rep", "at"), "rep"), "parts")
    best = parted.join(parted.groupBy("component").agg(F.min("at").alias("best")), "component").select("rep", "best")
    found = materialize(reps.select("fp", "rep", "at", "copies").join(best, "rep", "left").select("fp", "copies", F.coalesce("best", "at").alias("best")), "components")
    # classes with over a ten-thousandth of all rows are ten thousand at most
    hot = F.broadcast(found.where(F.col("copies") > max(1000, signed.count() // 10_000)).select("fp", "best"))
    real = signed.where(whole)
    out = real.join(hot, "fp").unionByName(real.join(hot, "fp", "left_anti").join(found.select("fp", "best"), "fp"))
    alone = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_hash"))
    out = out.unionByName(signed.where(~whole).withColumn("best", alone))
    id_, first = F.col("best.doc_id"), (F.col("best.doc_id").eqNullSafe(F.col("doc_id"))) & (F.col("best.text_hash") == F.col("text_hash"))
    return out.select(
        "doc_id", F.col("n").alias("n_shingles"), id_.alias("component_id"), F.col("doc_id").eqNullSafe(id_).alias("kept"), "text_hash", F.coalesce(first, F.lit(True)).alias("first")
    )
