"""Near-dedup, packing, neighbours and the two classifiers against brute force, and their edge cases."""

import array
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import ann, near_dedup, packing, quality, toxicity
from lumenlog.llm.ann import nearest_neighbours
from lumenlog.llm.components import connected_components
from lumenlog.llm.near_dedup import near_duplicates
from lumenlog.llm.packing import TokenCache, best_fit, improve, pack

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(docs):
    sets = {i: shingles(t) for i, t in docs}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def copies(rng, n, words=60):
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(0, 4)):
            own[rng.randrange(len(own))] = f"v{rng.randrange(99)}"
        yield " ".join(own)


@pytest.mark.parametrize("limits", [(2048, 2048, 2_000_000), (3, 4, 300)])
def test_near_duplicates_equal_brute_force(spark, limits):
    rng = random.Random(11)
    texts = [t for n in (1, 2, 5, 30) for t in copies(rng, n)] + ["A b c", "a B  c", "a b", "", None, "one two three four five", "One two three four FIVE"]
    texts += [texts[0]] * 3 + [" ".join(f"u{k}" for k in range(30000))]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, component_id string")
    node, group, load = limits
    rows = near_duplicates(frame, node_limit=node, group_limit=group, group_shingles=load).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(docs)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)


def test_near_duplicates_edges(spark):
    frame = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (3, "z y x w v u"), (4, "z y x w v u")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.text or "", r.component_id or -1, r.kept, r.first) for r in near_duplicates(frame).join(frame.selectExpr("text", "xxhash64(text) as text_hash").distinct(), "text_hash").collect())
    assert got == [(-1, "a b c d e f", -1, True, True), (3, "z y x w v u", 3, True, True), (4, "a b c d e f", 4, True, True), (4, "a b c d e f", 4, True, True), (4, "z y x w v u", 3, False, False), (9, "", 9, True, True)]
    assert near_duplicates(frame.where("false")).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.vertex: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 41)} | {k: 100 for k in range(101, 160)} | {201: 200}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    with pytest.raises(RuntimeError):
        connected_components(spark.createDataFrame(links, "a long, b long"), rounds=2)


def test_large_groups_meet_block_by_block(spark):
    rng = random.Random(5)
    # numbers on a line: those closer than 3 are linked; groups of different density, from one part to many
    rows = [(g, g * 10_000 + k, rng.randrange(0, spread)) for g, (n, spread) in enumerate([(5, 9), (60, 30), (80, 2000), (50, 120), (1, 5)]) for k in range(n)]
    rows = [(g, r, x) for g, r, x in rows]
    frame = spark.createDataFrame(rows, "grp long, rep long, x long")

    def compare(batches):
        import pyarrow as pa

        for table in near_dedup.sorted_groups(batches):
            by = {}
            for g, r, _, x in zip(*(table.column(k).to_pylist() for k in range(4)), strict=True):
                by.setdefault(g, []).append((r, x))
            assert max(map(len, by.values())) < 50
            edges = [(a, b) for own in by.values() for a, x in own for b, y in own if a < b and abs(x - y) < 3]
            cols = list(zip(*edges, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64())], ["a", "b"])

    sizes = frame.groupBy("grp").agg(F.count("*").alias("n"))
    found = near_dedup.connected_in_groups(frame.join(sizes, "grp"), "grp", F.ceil(F.col("n") / 8), "x", compare)
    got = {r.vertex: r.component for r in found.collect()}
    want = {}
    for g in {g for g, _, _ in rows}:
        own, part = sorted((x, r) for h, r, x in rows if h == g), []
        for k, (x, r) in enumerate(own):
            if k and x - own[k - 1][0] >= 3:
                want |= {v: min(part) for v in part if v != min(part)}
                part = []
            part.append(r)
        want |= {v: min(part) for v in part if v != min(part)}
    assert got == want


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_cached_tokens_equal_the_tokenizers(tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    rng = random.Random(1)
    parts = ["Hello", "don't", "it's_ok", "3.14", "日本語", "İSTANBUL", "ΣΑΣ", "½²", "é", "́x", "<|endoftext|>", "a<|endoftext|>'s", "<|ENDOFTEXT|>", "é<|startoftext|>B", "<|endof text|>", "a\x1cb", "c\x85d", "naïve,", "***", "we'll", "O'Neill's", "x" * 50, " "]
    texts = [" ".join(rng.choice(parts) for _ in range(40)) for _ in range(30)] + ["", " ", "\n\t"]
    cache = TokenCache(tokenizer, chunks=12, words=10)
    for text, ids in zip(texts, cache.ids([t.encode() for t in texts]), strict=True):
        assert list(array.array("I", ids)) == plain.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_read_texts_whole(tokenizer):
    from pathlib import Path

    from tokenizers import Tokenizer

    path = str(Path(tokenizer).parent / "byte_bpe_50k.json")
    cache, plain = TokenCache(path), Tokenizer.from_file(path)
    assert not cache.by_chunk and TokenCache(tokenizer).by_chunk
    for text, ids in zip(texts := ["Two  words", " a\nb", "<|endoftext|>"], cache.ids([t.encode() for t in texts]), strict=True):
        assert list(array.array("I", ids)) == plain.encode(text, add_special_tokens=False).ids


def test_repeated_rows_fill_no_group(spark, tokenizer, monkeypatch):
    def group_size_as_sequence(capacity, level):
        def run(key, rows):
            import pyarrow as pa

            n = rows.num_rows
            rows = rows.drop_columns("__group").append_column("sequence_id", pa.array([key[0].as_py()] * n, pa.int64()))
            return rows.append_column("offset", pa.array([0] * n, pa.int64())).append_column("light", pa.array([False] * n, pa.bool_()))

        return run

    monkeypatch.setattr(packing, "group_packer", group_size_as_sequence)
    frame = spark.range(10_000).selectExpr("cast(null as long) as doc_id", "'same text' as text")
    sizes = [r["count"] for r in pack(frame, tokenizer, group_size=1000).groupBy("sequence_id").count().collect()]
    assert sum(sizes) == 10_000 and len(sizes) == 10 and max(sizes) < 1200


def test_packing_round_trip(spark, tokenizer):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer)
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["alpha", "Beta!", "7", "ünï"]) for _ in range(rng.choice([0, 1, 5, 20, 33]))) for _ in range(80)] + [None, "", "q " * 500]
    frame = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, row string")
    rows = pack(frame, tokenizer, capacity=32, group_size=20).collect()
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    seen = {}
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.start == 32 * r.piece
        assert zlib.crc32(array.array("I", own).tobytes()) == r.ids_crc32
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == {i: len(x) for i, x in ids.items()}
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= 32  # noqa: B905
    assert len(by) <= 1.1 * sum(map(len, ids.values())) / 32 + 2
    assert pack(frame.where("false"), tokenizer).count() == 0
    twice = frame.where("doc_id < 3").union(frame.where("doc_id < 3"))
    assert pack(twice, tokenizer).count() == 6


def test_local_search_empties_bins():
    rng = random.Random(4)
    lengths = []
    while len(lengths) < 300:  # triples that fill a bin exactly, which greedy packing breaks up
        a, b = rng.randint(513, 1023), rng.randint(513, 1023)
        if 512 < 2048 - a - b < 1024:
            lengths += [a, b, 2048 - a - b]
    first = best_fit(lengths, 2048)
    better = improve(first, lengths, 2048)
    assert sorted(i for b in better for i in b) == list(range(300))
    assert all(sum(lengths[i] for i in b) <= 2048 for b in better)
    fill = lambda bins: sum(sum(lengths[i] for i in b) ** 2 for b in bins)
    assert fill(better) > fill(first) and len(better) <= len(first) - 5
    assert not steps_left(better, lengths, 2048)


def steps_left(bins, lengths, capacity):
    """By brute force: can a fuller bin gain from a lighter one by a move, or by exchanging one for one or two for one?"""
    from itertools import combinations, permutations

    parts = lambda b: [c for k in range(3) for c in combinations([lengths[i] for i in b], k)]
    fill = [sum(lengths[i] for i in b) for b in bins]
    for a, b in permutations([k for k in range(len(bins)) if fill[k] < capacity], 2):
        for x in parts(bins[a]) if fill[a] <= fill[b] else ():
            for y in parts(bins[b]):
                if x and len(x) + len(y) <= 3 and 0 < sum(x) - sum(y) <= capacity - fill[b]:
                    return True
    return False


@pytest.mark.parametrize("low, high", [(1, 60), (20, 50), (34, 66), (51, 99)])
def test_local_search_ends_in_a_local_optimum(low, high):
    rng = random.Random(low)
    lengths = [rng.randint(low, high) for _ in range(60)]
    better = improve(best_fit(lengths, 100), lengths, 100)
    assert sorted(i for b in better for i in b) == list(range(60))
    assert len(better) == -(-sum(lengths) // 100) or not steps_left(better, lengths, 100)


def brute_nearest(rows, queries, k):
    out = set()
    for q, v in queries:
        near = sorted((float(np.sqrt(((np.array(x) - np.array(v)) ** 2).sum())), i) for i, x in rows if i != q)[:k]
        out |= {(q, n + 1, i) for n, (_, i) in enumerate(near)}
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(6, 16)) * 3
    rows = [(i, (centres[i % 6] + rng.normal(size=16)).tolist()) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(1000, 1030)]  # copies of one vector: ties by id
    odd = [(2000, None), (2100, [0.0] * 16), (2200, [float("nan")] * 16), (2300, [1.0] * 15 + [None]), (2400, [1.0]), (None, rows[1][1])]
    frame = spark.createDataFrame([(i, v, "clash") for i, v in rows + odd], "vec_id long, embedding array<float>, score string")
    exact = [(i, np.array(v, np.float32).astype(float).tolist()) for i, v in rows]
    queries = [(i, v) for i, v in exact if i % 100 == 0]
    got = nearest_neighbours(frame, block_rows=200, query_bytes=600).collect()
    found = {(r.query_id, r.rank, r.vec_id) for r in got}
    want = brute_nearest(exact, queries, 10)
    assert {q for q, _, _ in found} == {q for q, _ in queries}
    ids = lambda s: {(q, i) for q, _, i in s}
    assert len(ids(found) & ids(want)) >= 0.9 * len(want)
    assert {x for x in found if x[0] == 0} == {x for x in want if x[0] == 0}  # the copies, smallest ids first
    where = dict(exact)
    for r in got:
        assert r.score == pytest.approx(float(np.linalg.norm(np.array(where[r.query_id]) - np.array(where[r.vec_id]))), abs=1e-9)
    few = nearest_neighbours(frame.where("vec_id in (0, 1, 2)")).collect()
    assert sorted((r.query_id, r.vec_id) for r in few) == [(0, 1), (0, 2)]
    assert nearest_neighbours(frame.where("false")).count() == 0
    twice = spark.createDataFrame([(100, [1.0, 0.0]), (100, [1.0, 0.5]), (7, [3.0, 0.0])], "vec_id long, embedding array<double>")
    assert sorted((r.rank, r.vec_id, r.score) for r in nearest_neighbours(twice).collect()) == [(1, 100, 0.5), (1, 100, 0.5), (2, 7, 2.0), (2, 7, pytest.approx(4.25**0.5))]


def test_near_vectors_are_found_with_few_verified():
    rng = np.random.default_rng(4)
    near = np.repeat(rng.normal(size=(200, 32)), 15, axis=0) + 0.02 * rng.normal(size=(3000, 32))  # families of 15
    far = rng.normal(size=(3000, 32))  # no structure at all
    directions = rng.normal(size=(160, 32))
    for vectors, most in ((near, 0.02), (far, 0.5)):
        ids = np.arange(3000)
        block = ann.Block(ids, ids, vectors, directions)
        hits = verified = 0
        for q in range(0, 3000, 100):
            found, n = block.nearest(q, q, vectors[q], directions @ vectors[q], 112, 1.15, 10)
            d = np.linalg.norm(vectors - vectors[q], axis=1)
            d[q] = np.inf
            hits += len({v for _, _, v, _ in found} & set(np.argsort(d)[:10].tolist()))
            verified += n
        assert hits >= 0.9 * 300 and verified <= most * 30 * 3000


def corpus(n=400):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in ("ta", "re", "mi", "lo", "su") for b in ("ne", "ka", "vo", "di", "pu", "za")]
    rows = []
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        toxic, good = i % 4 == 0, i % 5 != 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            own[rng.randrange(len(own))] = rng.choice(["idiot", "vraxo" + rng.choice(words), "scum"])
        text = " ".join(own) + "." if good else " ### ".join(own) + " $$$"
        rows.append((i, text, int(good), int(toxic)))
    return rows


def test_quality_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in rows] + [(9001, None, ""), (9002, "", ""), (0, rows[0][1], "")], "doc_id long, text string, label string")
    labels = spark.createDataFrame([(i, q) for i, _, q, _ in rows if i < 300] + [(1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    model = quality.learn(docs, labels)
    got = {r.doc_id: r.quality_score for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values()) and {9001, 9002} <= set(got)
    assert sum((got[i] >= 0.3) == bool(q) for i, _, q, _ in rows[300:]) >= 97
    idx, val = np.array([1, 5, 9]), np.array([0.5, 1.0, 2.0], np.float32)
    pairs = sum(float(model["v"][idx[a]] @ model["v"][idx[b]]) * val[a] * val[b] for a in range(3) for b in range(a))
    assert quality.margin(model, idx, val) == pytest.approx(model["w0"] + float(model["w"][idx] @ val) + pairs, abs=1e-4)
    none = quality.learn(docs, labels.where("quality = 1"))
    assert {r.quality_score for r in quality.score(docs, none).collect()} == {1.0}
    assert quality.score(docs.where("false"), model).count() == 0


def test_toxicity_on_held_out_rows(spark):
    rows = corpus()
    docs = spark.createDataFrame([(i, t, "clash") for i, t, _, _ in rows] + [(9001, None, ""), (9002, "", ""), (9003, "ta ne " * 30000, "")], "doc_id long, text string, toxic string")
    labels = spark.createDataFrame([(i, x) for i, _, _, x in rows if i < 300] + [(1, 0), (None, 1), (2, None)], "doc_id long, toxic int")
    model = toxicity.learn(docs, labels)
    got = {r.doc_id: r.toxicity_score for r in toxicity.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == bool(x) for i, _, _, x in rows[300:]) >= 95
    assert max(got[9001], got[9002], got[9003]) < 0.3
    none = toxicity.learn(docs, labels.where("false"))
    assert max(r.toxicity_score for r in toxicity.score(docs, none).collect()) < 0.01
    assert toxicity.score(docs.where("false"), model).count() == 0


def test_label_model_finds_accurate_voters():
    rng = np.random.default_rng(3)
    y = (rng.random(2000) < 0.3).astype(float)
    votes = np.stack([np.where(y == 1, rng.random(2000) < a, rng.random(2000) < b) for a, b in ((0.8, 0.02), (0.7, 0.05), (0.5, 0.5))], 1).astype(float)
    given = np.where(rng.random(2000) < 0.15, 1 - y, y)  # labels that are often wrong
    p, (t1, t0) = toxicity.label_model(votes, given, np.ones(2000))
    assert ((p > 0.5) == y).mean() > (given == y).mean()
    assert 0.75 < t1 < 0.97 and 0.02 < t0 < 0.25  # the labels' accuracy is found, not assumed


def test_label_model_equals_plain_loops():
    """The same estimation, text by text and voter by voter."""
    rng = random.Random(2)
    n, m = 60, 5
    y = [float(rng.random() < 0.4) for _ in range(n)]
    votes = [[float(rng.random() < (0.7 if y[i] else 0.1)) for _ in range(m)] for i in range(n)]
    for row in votes:
        row[1] = row[0] if rng.random() < 0.9 else row[1]  # two that agree
    weights = [1.0 if y[i] else 2.0 for i in range(n)]
    share = [w * n / sum(weights) for w in weights]
    prior = sum(a * b for a, b in zip(y, share, strict=True)) / sum(share)
    p = [0.9 if x else 0.1 for x in y]
    for _ in range(40):
        s1, s0 = sum(p[i] * share[i] for i in range(n)), sum((1 - p[i]) * share[i] for i in range(n))
        a1 = [(sum(votes[i][j] * p[i] * share[i] for i in range(n)) + 0.05) / (s1 + 1) for j in range(m)]
        a0 = [(sum(votes[i][j] * (1 - p[i]) * share[i] for i in range(n)) + 0.05) / (s0 + 1) for j in range(m)]
        t1 = (sum(y[i] * p[i] * share[i] for i in range(n)) + 1) / (s1 + 2)
        t0 = (sum(y[i] * (1 - p[i]) * share[i] for i in range(n)) + 1) / (s0 + 2)
        own = []
        for j in range(m):
            total = 1.0
            for k in range(m):
                cov = sum(votes[i][j] * votes[i][k] * p[i] * share[i] for i in range(n)) / s1 - a1[j] * a1[k]
                r = min(max(cov / (a1[j] * (1 - a1[j]) * a1[k] * (1 - a1[k])) ** 0.5, 0), 1)
                total += r if j != k and r >= max(0.1, 3 / max(sum(p), 1) ** 0.5) else 0
            own.append(1 / total)
        new = []
        for i in range(n):
            z = np.log(prior / (1 - prior)) + (np.log(t1 / t0) if y[i] else np.log((1 - t1) / (1 - t0)))
            z += sum(own[j] * (np.log(a1[j] / a0[j]) if votes[i][j] else np.log((1 - a1[j]) / (1 - a0[j]))) for j in range(m))
            new.append(1 / (1 + np.exp(-z)))
        p = new
    got, _ = toxicity.label_model(np.array(votes), np.array(y), np.array(weights), still=0, rounds=40)
    assert got == pytest.approx(np.array(p), abs=1e-6)


def test_equal_voters_share_their_weight():
    rng = np.random.default_rng(5)
    y = (rng.random(400) < 0.5).astype(float)
    one = np.where(y == 1, rng.random(400) < 0.8, rng.random(400) < 0.05)
    other = np.where(y == 1, rng.random(400) < 0.6, rng.random(400) < 0.1)
    b, w = toxicity.fit(np.stack([one, other], 1), y, np.ones(400))
    b3, w3 = toxicity.fit(np.stack([one, other, one, one], 1), y, np.ones(400))
    assert b3 == pytest.approx(b, abs=1e-4) and w3 == pytest.approx([w[0] / 3, w[1], w[0] / 3, w[0] / 3], abs=1e-4)


def test_samples_are_bounded_in_rows_and_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000) for i in range(50)] * 3 + [(60, "y" * 90_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(61)], "doc_id long, quality int")
    sample, n = quality.labelled_sample(docs, labels, "quality", 10, sample_bytes=12_000)
    rows = sample.collect()
    assert n == {0: 31, 1: 30} and len({r.i for r in rows}) == len(rows)
    assert all(sum(len(r.text) for r in rows if r.label == k) <= 6000 for k in (0, 1)) and len(rows) >= 6


def test_a_huge_text_drops_only_itself_from_a_sample(spark):
    def at(i):  # where the sample meets the id
        return spark.range(1).select(F.xxhash64(F.lit(i).cast("long"), F.lit("bytes"))).first()[0]

    ids = sorted(range(40), key=at)
    huge = ids[:2]  # first in the order of the hash
    docs = spark.createDataFrame([(i, ("h" * 20_000 if i in huge else "x" * 100) + str(i)) for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, k % 2) for k, i in enumerate(ids)] * 3, "doc_id long, quality int")
    sample, n = quality.labelled_sample(docs, labels, "quality", 100, sample_bytes=12_000)
    assert n == {0: 20, 1: 20} and {r.i for r in sample.collect()} == set(ids) - set(huge)


def test_vote_shares_in_blocks():
    rng = np.random.default_rng(5)
    votes = (rng.random((300, 70)) < 0.2).astype(np.float32)
    votes[:, 40:50] = votes[:, :10]
    weights, mean = rng.random(300), None
    mean = votes.T @ weights / weights.sum()
    whole = toxicity.vote_shares(votes, weights, mean, 0.3, block=1000)
    assert np.allclose(whole, toxicity.vote_shares(votes, weights, mean, 0.3, block=7), atol=1e-5)
    assert np.allclose(whole[:10], 0.5, atol=1e-3) and np.allclose(whole[10:40], 1)


def test_equal_rows_are_read_once(spark):
    text = " ".join(f"w{k}" for k in range(80))
    rows = [(1, text)] * 3000 + [(2, text + " more"), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    own = docs.withColumn("text_hash", F.xxhash64("text"))
    assert near_dedup.one_of_equal_rows(own.where("text is not null"), own.where("text is not null")).count() == 2
    got = near_duplicates(docs).collect()
    assert len(got) == 3003 and {(r.doc_id, r.component_id, r.kept) for r in got} == {(1, 1, True), (2, 1, False), (3, 3, True)}


def test_large_nodes_branch_until_they_are_small(spark, monkeypatch):
    rng, n = np.random.default_rng(6), 4000
    sig = rng.integers(0, 6, (n, near_dedup.POSITIONS)).astype("<u4")
    sig[1::400] = sig[::400]  # ten pairs that look alike
    tokens = np.arange(n * near_dedup.ROOTS).reshape(n, -1)
    tokens[:, 0] = -1  # one root node holds all
    reps = spark.createDataFrame([(k, t.tolist(), bytearray(s.tobytes())) for k, (t, s) in enumerate(zip(tokens, sig, strict=True))], "rep long, tokens array<long>, sig binary")
    names, store = [], near_dedup.materialize
    monkeypatch.setattr(near_dedup, "materialize", lambda df, name: names.append(name) or store(df, name))
    found = {(r.component, r.vertex) for r in near_dedup.candidate_groups(reps, 60).collect()}
    assert found == {(k, k + 1) for k in range(0, n, 400)} and names.count("children") >= 2


def test_pieces_are_ints(spark, tokenizer):
    packed = pack(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), tokenizer)
    assert dict(packed.dtypes)["piece"] == "int"
