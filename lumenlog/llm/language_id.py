"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a tree of byte contexts of 0 to ``order`` bytes with the counts of what followed them.  A
byte's code length is -log2 of its probability after the longest context: seen ``c`` times among ``n``
followers of ``q`` kinds it has c / (n + q), and an unseen one pays the escape q / (n + q) and is coded after the
context one byte shorter, and in the end as one of 256 (escape method C).  A context that the language never
saw costs nothing to leave.  Statistics are frozen after training, so a text's code length is a sum of
table look-ups, done for all languages at once in numpy.  The language with the shortest code wins.

Training takes the texts of at most ``rows_per_lang`` labelled rows a language, those with the smallest
hash of the id (a documented bound of the model); the predictions read every whole text.

Defined results: null texts and texts without a letter give ``und`` with score 0, and so does every text if
there is nothing to learn from; ties go to the language that sorts first; repeated rows are judged alike; very long
texts are coded piece by piece, with the context of the piece before; an empty table gives no rows; other columns pass
through, but one named as ``into`` is replaced.  Code lengths are kept as 32-bit numbers and summed as 64-bit ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.functions import arrow_udf

from .common import LOWER_FOLD, binary_values

ORDER = 3
#: Bytes that are coded at a time; what a context needs of the bytes before is carried over.
CHUNK = 1 << 20


def sample_by_key(rows: DataFrame, key: str, doc_id: str, most: int) -> DataFrame:
    """At most ``most`` rows of each key, those with the smallest hash of the id.  A first cut at twice the share
    that is needed leaves the ranking little to sort, also where one key has most of the rows."""
    n = {r[0]: r[1] for r in rows.groupBy(key).count().collect()}
    if not n:
        return rows
    share = F.create_map(*(F.lit(x) for k, c in n.items() for x in (k, min(1.0, (2 * most + 20) / c))))
    point = F.xxhash64(F.col(doc_id), F.lit("sample"))
    kept = rows.where(F.pmod(point, F.lit(1 << 30)) <= F.element_at(share, F.col(key)) * (1 << 30))
    rank = F.row_number().over(W.partitionBy(key).orderBy(point, F.col(doc_id)))
    return kept.withColumn("__rank", rank).where(F.col("__rank") <= most).drop("__rank")


def count_grams(order: int):
    """(lang, text) rows to (lang, k, gram, n): how often each gram of k bytes ends somewhere in the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, raw in zip(batch.column(0).to_pylist(), binary_values(batch.column(1)), strict=True):
                by.setdefault(lang, []).append(raw)
            for lang, raws in by.items():
                text = np.frombuffer(b"".join(b" " * order + raw.translate(LOWER_FOLD) for raw in raws), np.uint8).astype(np.int64)
                place = np.concatenate([np.arange(-order, len(raw)) for raw in raws])  # of a byte in its text
                gram = np.zeros(len(text), np.int64)
                for k in range(1, order + 2):
                    gram[k - 1 :] |= text[: len(text) - k + 1] << (8 * (k - 1))
                    keys, n = np.unique(gram[place >= k - 1], return_counts=True)
                    size = len(keys)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size), pa.array([k] * size, pa.int32()), pa.array(keys), pa.array(n.astype(np.int64))],
                        ["lang", "k", "gram", "n"],
                    )

    return run


def freeze(grams: list[tuple[str, int, int, int]], order: int) -> dict:
    """Code lengths by gram and escape lengths by context, for all languages side by side.

    A gram's key holds its last byte lowest; ``grams[k]`` are the sorted keys of length k, ``cost[k]`` their code
    lengths, and ``escape[k]`` what leaving the context costs that such a gram is.
    """
    import numpy as np

    langs = sorted({g[0] for g in grams})
    column = {lang: i for i, lang in enumerate(langs)}
    keys, cost, escape = {}, {}, {}
    for k in range(1, order + 2):
        own = [g for g in grams if g[1] == k]
        keys[k], at = np.unique(np.array([g[2] for g in own], np.int64), return_inverse=True)
        c = np.zeros((len(keys[k]), len(langs)))
        np.add.at(c, (at, [column[g[0]] for g in own]), [g[3] for g in own])
        context, where = np.unique(keys[k] >> 8, return_inverse=True)
        n, q = np.zeros((len(context), len(langs))), np.zeros((len(context), len(langs)))
        np.add.at(n, where, c)
        np.add.at(q, where, c > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = np.where(n > 0, -np.log2(q / (n + q)), 0.0)
            code = -np.log2(c / (n + q)[where])
        if k == 1:
            shorter = np.full_like(c, 8.0)
            escape[0] = leave[0]
        else:
            shorter = cost[k - 1][np.searchsorted(keys[k - 1], keys[k] & ((1 << 8 * (k - 1)) - 1))]
            escape[k - 1] = np.zeros((len(keys[k - 1]), len(langs)))
            escape[k - 1][np.searchsorted(keys[k - 1], context)] = leave
        cost[k] = np.where(c > 0, code, leave[where] + shorter)
    return {"langs": langs, "order": order, "grams": keys, "cost": cost, "escape": escape}


class Coder:
    """The frozen trees as dense tables: ``child[k][id of a gram of k bytes, next byte]`` is the id of the longer gram; 0 is none."""

    def __init__(self, model: dict):
        import numpy as np

        self.order, self.langs = model["order"], model["langs"]
        width = len(self.langs)
        grams = model["grams"]
        used = np.unique(grams[1] & 255)
        self.symbol = np.zeros(256, np.int64)  # 0: a byte never seen
        self.symbol[used] = np.arange(1, len(used) + 1)
        self.size = len(used) + 1
        none = np.zeros((1, width), np.float32)
        one = np.full((1, width), 8.0) + model["escape"][0]
        self.cost = [None, np.concatenate([one, model["cost"][1]]).astype(np.float32)]
        self.escape = [None]
        self.child = [None]
        for k in range(2, self.order + 2):
            parent = np.searchsorted(grams[k - 1], grams[k] >> 8)
            table = np.zeros((len(grams[k - 1]) + 1, self.size), np.int32)
            table[parent + 1, self.symbol[grams[k] & 255]] = np.arange(1, len(parent) + 1)
            self.child.append(table.ravel())
            self.cost.append(np.concatenate([none, model["cost"][k]]).astype(np.float32))
            self.escape.append(np.concatenate([none, model["escape"][k - 1]]).astype(np.float32))

    def rows(self, codes):
        """Code lengths of each byte in each language; ``codes`` are symbols, the first bytes have no context."""
        import numpy as np

        ids = [None, codes]
        for k in range(2, self.order + 2):
            longer = np.zeros_like(codes)
            longer[1:] = self.child[k - 1][ids[k - 1][:-1].astype(np.int64) * self.size + codes[1:]]
            ids.append(longer)
        top = self.order + 1
        out = np.take(self.cost[top], ids[top], axis=0) if top > 1 else self.cost[1][codes]
        open_ = np.flatnonzero(ids[top] == 0) if top > 1 else np.zeros(0, np.int64)
        for k in range(top - 1, 0, -1):  # where nothing longer was found
            if not len(open_):
                break
            out[open_] += self.escape[k][np.where(open_ > 0, ids[k][open_ - 1], 0)]
            out[open_] += self.cost[k][ids[k][open_]]
            open_ = open_[ids[k][open_] == 0] if k > 1 else open_[:0]
        return out

    def bits(self, raws: list[bytes]):
        """Total code length of each text in each language."""
        import numpy as np

        pad = np.zeros(self.order, np.int64)  # no context reaches over the start of a text
        total = np.zeros((len(raws), len(self.langs)))
        at = 0
        while at < len(raws):
            end, held = at, 0
            while end < len(raws) and (held == 0 or held + len(raws[end]) <= CHUNK):
                held += len(raws[end])
                end += 1
            if end == at + 1:  # a long text goes through in pieces
                text = np.frombuffer(raws[at].translate(LOWER_FOLD), np.uint8)
                for k in range(0, len(text), CHUNK):
                    part = np.concatenate([pad, self.symbol[text[max(0, k - self.order) : k + CHUNK]]])[min(k, self.order) :]
                    total[at] += self.rows(part)[self.order :].sum(0, dtype=np.float64)
            else:
                gap = b" " * self.order
                text = np.frombuffer(b"".join(gap + raw.translate(LOWER_FOLD) for raw in raws[at:end]), np.uint8)
                sizes = np.array([len(raw) + self.order for raw in raws[at:end]])
                starts = np.cumsum(sizes) - sizes
                codes = self.symbol[text]
                for j in range(self.order):
                    codes[starts + j] = 0
                rows = self.rows(codes)
                for j in range(self.order):
                    rows[starts + j] = 0
                total[at:end] = np.add.reduceat(rows, starts, axis=0, dtype=np.float64)
            at = end
        return total


def learn(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 400, order: int = ORDER) -> dict:
    """The frozen model of the labelled ``docs``; its size is bound by the sample, not by the corpus."""
    rows = docs.select(F.col(doc_id).alias("i"), F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null and i is not null")
    chosen = sample_by_key(rows, "lang", "i", rows_per_lang)
    counted = chosen.select("lang", "text").mapInArrow(count_grams(order), "lang string, k int, gram long, n long")
    grams = counted.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n"))
    got = grams.toArrow()
    if not got.num_rows:
        return {"langs": [], "order": order, "grams": {}, "cost": {}, "escape": {}}
    return freeze(list(zip(*(got.column(c).to_pylist() for c in ("lang", "k", "gram", "n")), strict=True)), order)


def predict(docs: DataFrame, model: dict, *, text: str = "text", into: str = "language") -> DataFrame:
    """``docs`` with a struct column ``into``: lang, score (posterior of the winner for 64 bytes of such text at
    most), and bits (its code length in bits a byte; null for ``und``)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("struct<lang:string,score:double,bits:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import numpy as np

        coder = Coder(held.value) if held.value["langs"] else None
        kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits", pa.float64())])
        for batch in batches:
            raws = binary_values(batch)
            out: list = [{"lang": "und", "score": 0.0, "bits": None}] * len(raws)
            real = [i for i, raw in enumerate(raws) if raw]
            if coder and real:
                bits = coder.bits([raws[i] for i in real])
                size = np.array([len(raws[i]) for i in real], np.float64)
                each = bits / size[:, None]
                odds = np.exp2(-(each - each.min(1, keepdims=True)) * np.minimum(size, 64)[:, None])
                score = odds.max(1) / odds.sum(1)
                for i, b, s, e in zip(real, bits.argmin(1).tolist(), score.tolist(), each.min(1).tolist(), strict=True):
                    out[i] = {"lang": coder.langs[b], "score": s, "bits": e}
            yield pa.array(out, kind)

    lettered = F.when(has_letter(F.col(text)), F.col(text))
    return docs.withColumn(into, run.asNondeterministic()(lettered))


def has_letter(text: Column) -> Column:
    return text.rlike(r"\p{L}")
