"""Toxicity by weak supervision: many voters, a generative label model, and a linear classifier.

Voters are lists of insults, shouting patterns, and patterns mined from the labelled sample: a word or the
first 4 to 7 bytes of one, if it stands in toxic texts at least ``LIFT`` times as often and more often than
chance makes any of all the features tried.  Copies in the sample count once, or every word of a toxic text
with many copies would look like a voter.  Voters that fire on the same texts are one.

The label model takes a text's true label as hidden.  Expectation maximisation estimates, to convergence, how
often each voter fires on either label, and in every round the correlations between voters given the label: voters
that say the same share one vote between them.  The given label is one more voter, whose accuracy is estimated
like that of any other.  A logistic regression is then fitted to the posterior labels, over the lists, patterns,
words and word beginnings that voted, and scores every whole text as a projection without a shuffle.

Training takes at most ``rows_per_label`` labelled rows of each label (a documented bound), weighted back.

Defined results: null and empty texts hold no feature and score the intercept; null labels teach nothing;
of rows that share an id in the labels or documents one is used; without labels of both kinds the score is the share
of label 1 (0 without any); repeated rows score alike; an empty table gives no rows; other columns pass through,
but one named as ``into`` is replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import WORD_FOLD, binary_values, materialize
from .near_dedup import ROOTS, SIGNATURE, signature
from .quality import labelled_sample

BITS = 22
LIFT = 8.0
LEXICONS = {
    "insults_en": ("idiot", "moron", "loser", "stupid", "dumb", "fool", "imbecile", "clown", "jerk", "dimwit", "dumbass", "retard"),
    "contempt_en": ("trash", "scum", "worthless", "pathetic", "disgusting", "garbage", "filth", "vermin", "despicable", "useless"),
    "abuse_en": ("bitch", "bastard", "asshole", "whore", "slut", "shit", "fuck", "fucking", "crap", "damn", "dick", "prick", "hate", "kill"),
    "insults_de": ("idiot", "dummkopf", "arschloch", "trottel", "depp", "abschaum", "wichser", "schlampe", "hurensohn", "scheisse"),
    "insults_fr": ("imbécile", "connard", "salaud", "crétin", "merde", "pute", "abruti", "ordure", "débile", "salope"),
    "insults_es": ("idiota", "imbécil", "estúpido", "basura", "mierda", "cabrón", "puta", "pendejo", "gilipollas", "escoria"),
}
#: Features 0 to 15 are kept for these and the patterns; hashed ones follow.
FIXED = {w.encode(): k for k, (_, words) in enumerate(LEXICONS.items()) for w in words}
SHOUT, CAPITALS, RESERVED = 14, 15, 16


class Features(dict):
    """Feature numbers of a word: its own, those of its beginnings, and its lists'; bounded."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        parts = {b"=" + word} | {b"%d" % k + word[:k] for k in (4, 5, 6, 7) if len(word) >= k}
        found = tuple(sorted(RESERVED + (zlib.crc32(p) >> (32 - BITS)) for p in parts))
        fixed = FIXED.get(word)
        self[word] = found = found if fixed is None else (fixed, *found)
        return found


def patterns(raw: bytes) -> list[int]:
    letters = sum(raw.count(c) for c in (b"E", b"T", b"A", b"O", b"I", b"N"))
    return [SHOUT] * (b"!!" in raw) + [CAPITALS] * (letters > 20 and letters * 8 > len(raw))


def text_features(raw: bytes | None, known: Features) -> set[int]:
    raw = raw or b""
    return set(patterns(raw)).union(*map(known.__getitem__, set(raw.translate(WORD_FOLD).split())))


def vote_shares(votes, weights, mean, least: float, block: int = 256):
    """Of each voter the share of the vote that it has in common with others: one over the sum of its correlations from
    ``least`` on (less is no more than chance), its own being 1.

    Correlations are taken for ``block`` voters at a time, so memory grows with the voters and not with their square.
    """
    import numpy as np

    sd, total = np.sqrt(mean * (1 - mean)), max(weights.sum(), 1e-9)
    out = np.empty(votes.shape[1])
    for k in range(0, votes.shape[1], block):
        own = slice(k, k + block)
        cov = (votes[:, own] * weights[:, None].astype(votes.dtype)).T @ votes / total - np.outer(mean[own], mean)
        together = np.clip(cov / np.outer(sd[own], sd), 0, 1)
        together[together < least] = 0
        together[np.arange(len(together)), np.arange(k, k + len(together))] = 1
        out[own] = 1 / together.sum(1)
    return out


def label_model(votes, given, weights, *, trust: float = 0.9, still: float = 1e-4, rounds: int = 1000):
    """Posterior of label 1 for each text, and how often the given label is 1 on either label.

    ``votes``: texts by voters, 0 or 1; ``given``: labels.  ``trust`` in the labels is where the estimation starts.  It ends
    when no posterior moves by ``still``, or after ``rounds``.
    """
    import numpy as np

    share = weights * (len(given) / weights.sum())
    prior = float((given * share).sum() / share.sum())
    p = np.where(given == 1, trust, 1 - trust)
    for _ in range(rounds):
        w1, w0 = p * share, (1 - p) * share
        a1 = (votes.T @ w1 + 0.05) / (w1.sum() + 1)  # how often each voter fires on toxic texts
        a0 = (votes.T @ w0 + 0.05) / (w0.sum() + 1)
        t1, t0 = ((given @ w + 1) / (w.sum() + 2) for w in (w1, w0))
        own = vote_shares(votes, w1, a1, max(0.1, 3 / np.sqrt(max(p.sum(), 1))))
        z = np.log(prior / (1 - prior)) + np.where(given == 1, np.log(t1 / t0), np.log((1 - t1) / (1 - t0)))
        z = z + votes @ (own * np.log(a1 / a0)) + (1 - votes) @ (own * np.log((1 - a1) / (1 - a0)))
        before, p = p, 1 / (1 + np.exp(-np.clip(z, -40, 40)))
        if np.abs(p - before).max() < still:
            break
    return p, (t1, t0)


def significant(n1, n0, total1: int, total0: int, tried: int):
    """Which features stand in toxic texts ``LIFT`` times as often, beyond what chance gives ``tried`` features.

    ``n1`` and ``n0`` count the texts of either label that hold a feature; the test is the likelihood ratio.
    """
    import numpy as np

    n, share = n1 + n0, total1 / (total1 + total0)
    e1, e0 = n * share, n * (1 - share)
    g = n1 * np.log(np.maximum(n1, 1e-9) / e1) + np.where(n0 > 0, n0 * np.log(np.maximum(n0, 1e-9) / e0), 0.0)
    lift = (n1 / total1) / ((n0 + 0.5) / (total0 + 0.5))
    return (lift >= LIFT) & (n1 >= 3) & (g >= np.log(max(tried, 1)) + 3)


def fit(votes, given, weights, *, steps: int = 400, rate: float = 0.1, ridge: float = 1e-4):
    """Runs the label model over the votes and fits the classifier to its posterior: bias and weights."""
    import numpy as np

    # voters that fire on the same texts are one voter, whose weight they share
    _, first, one, shared = np.unique(np.packbits(votes.astype(bool), axis=0), axis=1, return_index=True, return_inverse=True, return_counts=True)
    votes = votes[:, first].astype(np.float32)
    p, _ = label_model(votes, given, weights)
    share = weights / weights.sum()
    mean = float(p @ share)
    w, b = np.zeros(votes.shape[1]), float(np.log(mean / (1 - mean)))
    moment, square = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        e = (1 / (1 + np.exp(-np.clip(votes @ w.astype(np.float32) + b, -40, 40))) - p) * share
        g = np.append(votes.T @ e.astype(np.float32) + ridge * w / max(len(w), 1), e.sum())
        moment, square = 0.9 * moment + 0.1 * g, 0.99 * square + 0.01 * g * g
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return b, (w / shared)[one.ravel()]


def without_copies(sample: DataFrame) -> DataFrame:
    """Rows (i, label, text) whose minwise shingle tokens are mostly not those of rows with smaller ids."""
    tokens = sample.select("i", arrow_udf(SIGNATURE)(signature).asNondeterministic()("text").alias("s")).select("i", F.posexplode("s.tokens").alias("k", "token"))
    tokens = materialize(tokens, "tokens")
    first = tokens.groupBy("k", "token").agg(F.min("i").alias("first"))
    copies = tokens.join(first, ["k", "token"]).where("first < i").groupBy("i").count().where(F.col("count") >= ROOTS // 2)
    return sample.join(copies.select("i"), "i", "left_anti")


def learn(
    docs: DataFrame, labels: DataFrame, *, label: str = "toxic", rows_per_label: int = 4000, doc_id: str = "doc_id", text: str = "text"
) -> dict:
    """The classifier; ``labels`` must hold training rows only."""
    import numpy as np

    sample, n = labelled_sample(docs, labels, label, rows_per_label, doc_id=doc_id, text=text)
    total = sum(n.values())

    @arrow_udf("array<int>")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Features()
        for batch in batches:
            yield pa.array([sorted(text_features(raw, known)) for raw in binary_values(batch)], pa.list_(pa.int32()))

    own = materialize(without_copies(materialize(sample, "sample")).select("i", "label", extract.asNondeterministic()("text").alias("f")), "features")
    size = {r[0]: r[1] for r in own.groupBy("label").count().collect()}
    if len(size) < 2:
        base = n.get(1, 0) / total if total else 0.0
        return {"bias": float(np.log((base + 1e-9) / (1 - base + 1e-9))), "weights": {}}
    counts = own.select("label", F.explode("f").alias("f")).groupBy("f").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    counts = materialize(counts, "counts")
    tried = counts.count()
    got = counts.where(f"n1 >= 3 or f < {RESERVED}").toArrow().sort_by("f")
    f, n1, n0 = (got[c].to_numpy() for c in ("f", "n1", "n0"))
    voters = f[(f < RESERVED) | significant(n1.astype(float), n0.astype(float), size[1], size[0], tried)].tolist()
    held = docs.sparkSession.sparkContext.broadcast(np.array(voters, np.int32))  # so few features pass the test; ids go out, no plan literals

    @arrow_udf("array<int>")
    def of_voters(column: pa.Array) -> pa.Array:
        f = column.flatten().to_numpy()
        kept = np.isin(f, held.value)
        ends = np.concatenate(([0], np.cumsum(kept)))[column.offsets.to_numpy() - column.offsets[0].as_py()]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(f[kept], pa.int32()))

    chosen = own.select("i", "label", of_voters("f").alias("f")).toArrow().sort_by("i")
    y = chosen["label"].to_numpy()
    place = {x: k for k, x in enumerate(voters)}
    votes = np.zeros((len(y), len(voters)), np.uint8)
    for k, own_f in enumerate(chosen["f"].to_pylist()):
        votes[k, [place[x] for x in own_f]] = 1
    weights = np.where(y == 1, n[1] / total / (y == 1).mean(), n[0] / total / (y == 0).mean())
    b, w = fit(votes, y.astype(float), weights)
    return {"bias": b, "weights": dict(zip(voters, w.tolist(), strict=True))}


def score(docs: DataFrame, model: dict, *, text: str = "text", into: str = "toxicity_score") -> DataFrame:
    """``docs`` with a double column ``into``: how likely label 1 is."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        bias, weights = held.value["bias"], held.value["weights"]

        class Weighed(Features):  # keeps of a word only the features that weigh
            def __missing__(self, word: bytes) -> tuple[int, ...]:
                found = super().__missing__(word)
                self[word] = found = tuple(f for f in found if f in weights)
                return found

        known = Weighed()
        for batch in batches:
            z = []
            for raw in binary_values(batch):
                z.append(bias + sum(weights.get(f, 0.0) for f in text_features(raw, known)))
            yield pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -60, 60))), pa.float64())

    return docs.withColumn(into, run.asNondeterministic()(F.col(text)))
