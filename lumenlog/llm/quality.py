"""Quality classifier: a factorisation machine over hashed words, structure statistics and size.

A text's features are its words, hashed into ``2 ** WORD_BITS`` buckets and valued by log(1 + count), and one
bin out of ``BINS`` for each statistic of its structure and size.  Both kinds are scaled to a fixed length.
The score is the logistic of ``w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j``; the pairs are summed in linear
time as half of ``(sum v x)^2 - sum (v x)^2`` by factor.

Training reads at most ``rows_per_label`` labelled rows of each label and ``sample_bytes`` of their texts
(documented bounds), weighted back to the labels' shares; scoring reads every whole text and is a projection without
a shuffle.

Defined results: null and empty texts have no words and score as their structure does; a null label teaches
nothing; of rows that share an id in the labels or documents one is used; without labels of both kinds the score is
the share of label 1 (0.5 without any); repeated rows score alike; an empty table gives no rows; other columns pass
through, but one named as ``into`` is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from .common import WORD_FOLD, binary_values
from .language_id import sample_by_key

WORD_BITS = 15
BINS = 12
FACTORS = 8
#: Lower-case letters, capitals, digits, blanks, line ends, usual punctuation, other ASCII, non-ASCII.
CLASSES = bytes(
    97 if 97 <= b <= 122 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in (32, 9, 13) else 10 if b == 10
    else 46 if b in b".,;:!?'\"()-" else 200 if b >= 128 else 35 for b in range(256)
)
STATISTICS = (
    "bytes", "words", "symbols", "punctuation", "digits", "capitals", "non_ascii", "word_length", "distinct", "lines",
    "equal_lines", "top_word", "bars", "long_words", "sentence_ends", "symbol_words",
)


def structure(raw: bytes, words: list[bytes], counts: Counter) -> list[float]:
    n, m = len(raw), len(words)
    kinds = raw.translate(CLASSES)
    lower, upper, digits, symbols = kinds.count(b"a"), kinds.count(b"A"), kinds.count(b"0"), kinds.count(b"#")
    lines = raw.split(b"\n")
    return [
        float(n.bit_length()) + n / (1 << n.bit_length()),
        float(m.bit_length()) + m / (1 << m.bit_length()),
        symbols / max(n, 1),
        kinds.count(b".") / max(m, 1),
        digits / max(n, 1),
        upper / max(upper + lower, 1),
        kinds.count(b"\xc8") / max(n, 1),
        sum(map(len, words)) / max(m, 1),
        len(counts) / max(m, 1),
        len(lines) / max(m, 1),
        1 - len(set(lines)) / len(lines),
        max(counts.values(), default=0) / max(m, 1),
        raw.count(b"|") / max(m, 1),
        sum(len(w) > 20 for w in counts) / max(len(counts), 1),
        (raw.count(b". ") + raw.count(b".\n") + raw.endswith(b".")) / max(m, 1),
        (raw.count(b"# ") + raw.count(b"* ") + raw.count(b"% ") + raw.count(b"$ ") + raw.count(b"& ")) / max(m, 1),
    ]


class Buckets(dict):
    """Bucket of a word; bounded, as it starts anew when it is full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = k = zlib.crc32(word) >> (32 - WORD_BITS)
        return k


def features(raw: bytes | None, buckets: Buckets):
    """Buckets and values of a text's words, and its statistics."""
    import numpy as np

    raw = raw or b""
    words = raw.translate(WORD_FOLD).split()
    counts = Counter(words)
    idx = np.fromiter(map(buckets.__getitem__, counts), np.int64, len(counts))
    val = np.log1p(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(val):
        val /= np.sqrt(val @ val)
    return idx, val.astype(np.float32), structure(raw, words, counts)


def with_bins(idx, val, stats, edges):
    """The word features followed by the statistics' bins."""
    import numpy as np

    bins = [(1 << WORD_BITS) + k * BINS + int(np.searchsorted(e, x, "right")) for k, (x, e) in enumerate(zip(stats, edges, strict=True))]
    share = np.float32(len(STATISTICS) ** -0.5)
    return np.concatenate([idx, np.array(bins, np.int64)]), np.concatenate([val, np.full(len(bins), share, np.float32)])


def margin(model: dict, idx, val) -> float:
    """The machine's sum for one text, in time linear in its features."""
    vx = model["v"][idx] * val[:, None]
    total = vx.sum(0)
    return float(model["w0"] + model["w"][idx] @ val + 0.5 * (total @ total - (vx * vx).sum()))


def train(rows: list[tuple], labels, weights, *, epochs: int = 8, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> dict:
    """Adam on the weighted logistic loss; ``rows`` are (idx, val)."""
    import numpy as np

    rng = np.random.default_rng(seed)
    size = (1 << WORD_BITS) + BINS * len(STATISTICS)
    theta = [np.zeros(1, np.float32), np.zeros(size, np.float32), rng.normal(0, 0.05, (size, FACTORS)).astype(np.float32)]
    theta[0][0] = np.log((labels * weights).sum() / ((1 - labels) * weights).sum())
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            own = order[k : k + batch]
            idx = np.concatenate([rows[i][0] for i in own])
            val = np.concatenate([rows[i][1] for i in own])
            sizes = np.array([len(rows[i][0]) for i in own])
            starts = np.cumsum(sizes) - sizes
            vx = theta[2][idx] * val[:, None]
            total = np.add.reduceat(vx, starts, axis=0)
            z = theta[0][0] + np.add.reduceat(theta[1][idx] * val, starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            d = ((1 / (1 + np.exp(-z)) - labels[own]) * weights[own] / len(own)).astype(np.float32)
            each = np.repeat(d, sizes)
            used, where = np.unique(idx, return_inverse=True)
            gw = np.bincount(where, each * val, len(used)).astype(np.float32)
            part = (each * val)[:, None] * (np.repeat(total, sizes, axis=0) - vx)
            gv = np.stack([np.bincount(where, part[:, f], len(used)) for f in range(FACTORS)], 1).astype(np.float32)
            step += 1
            for t, m, s, at, g in ((theta[0], first[0], second[0], slice(None), d.sum(keepdims=True)), (theta[1], first[1], second[1], used, gw), (theta[2], first[2], second[2], used, gv)):
                g = g + decay * t[at]
                m[at] = 0.9 * m[at] + 0.1 * g
                s[at] = 0.99 * s[at] + 0.01 * g * g
                t[at] -= rate * (m[at] / (1 - 0.9**step)) / (np.sqrt(s[at] / (1 - 0.99**step)) + 1e-7)
    return {"w0": float(theta[0][0]), "w": theta[1], "v": theta[2]}


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows_per_label: int, *, doc_id: str = "doc_id", text: str = "text", sample_bytes: int = 64 << 20
) -> tuple[DataFrame, dict[int, int]]:
    """(i, label, text) of at most ``rows_per_label`` labelled ids a label, and how many ids have each label.

    The texts of a label hold half of ``sample_bytes`` at most: they are taken in the order of a hash of the id, and one
    that does not fit is left out by itself, so a huge text costs no other row its place.  Of rows that share an id the one
    with the smallest text is used, and of the labels of an id the smallest.
    """
    own = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("int").alias("label")).where("i is not null and label in (0, 1)")
    own = own.groupBy("i").agg(F.min("label").alias("label"))
    n = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    chosen = sample_by_key(own, "label", "i", rows_per_label)
    texts = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("text")).where("text is not null")
    found = texts.join(F.broadcast(chosen), "i").groupBy("i", "label").agg(F.min("text").alias("text"))  # 2 * rows_per_label rows at most are broadcast
    sizes = found.select("i", "label", F.octet_length("text").alias("size"), F.xxhash64("i", F.lit("bytes")).alias("h")).collect()  # as many rows
    left, fits = {0: sample_bytes // 2, 1: sample_bytes // 2}, []
    for r in sorted(sizes, key=lambda r: (r["h"], r["i"])):
        if r["size"] <= left[r["label"]]:
            left[r["label"]] -= r["size"]
            fits.append((r["i"],))
    if len(fits) < len(sizes):
        kept = docs.sparkSession.createDataFrame(fits, T.StructType([T.StructField("i", chosen.schema["i"].dataType)]))
        found = found.join(F.broadcast(kept), "i")
    return found, n


def learn(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows_per_label: int = 2500, doc_id: str = "doc_id", text: str = "text") -> dict:
    """The trained machine; ``labels`` must hold training rows only."""
    import numpy as np

    sample, n = labelled_sample(docs, labels, label, rows_per_label, doc_id=doc_id, text=text)
    total = sum(n.values())
    model = {"w0": None, "base": n.get(1, 0) / total if total else 0.5}

    @arrow_udf("struct<idx:array<bigint>,val:array<float>,stats:array<double>>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        buckets = Buckets()
        kind = pa.struct([("idx", pa.list_(pa.int64())), ("val", pa.list_(pa.float32())), ("stats", pa.list_(pa.float64()))])
        for batch in batches:
            yield pa.array([dict(zip(("idx", "val", "stats"), features(raw, buckets), strict=True)) for raw in binary_values(batch)], kind)

    got = sample.select("i", "label", extract.asNondeterministic()("text").alias("f")).select("i", "label", "f.*").toArrow().sort_by("i")
    y = np.array(got["label"].to_pylist(), np.float32)
    if len(set(y.tolist())) < 2:
        return model
    stats = np.array(got["stats"].to_pylist())
    edges = [np.unique(np.quantile(stats[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(len(STATISTICS))]
    rows = [
        with_bins(np.array(i.values), np.array(v.values), s, edges)
        for i, v, s in zip(got["idx"].combine_chunks(), got["val"].combine_chunks(), stats, strict=True)
    ]
    share = {k: (n[k] / total) / float((y == k).mean()) for k in (0, 1)}
    return model | train(rows, y, np.array([share[int(k)] for k in y], np.float32)) | {"edges": edges}


def score(docs: DataFrame, model: dict, *, text: str = "text", into: str = "quality_score") -> DataFrame:
    """``docs`` with a double column ``into``: how likely label 1 is."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        own, buckets = held.value, Buckets()
        for batch in batches:
            if own["w0"] is None:
                yield pa.array([own["base"]] * len(batch), pa.float64())
                continue
            z = np.array([margin(own, *with_bins(*features(raw, buckets), own["edges"])) for raw in binary_values(batch)])
            yield pa.array(1 / (1 + np.exp(-np.clip(z, -60, 60))), pa.float64())

    return docs.withColumn(into, run.asNondeterministic()(F.col(text)))
