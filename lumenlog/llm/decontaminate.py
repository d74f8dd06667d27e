"""Benchmark decontamination with one Aho-Corasick automaton.

Words are runs of digits, ASCII letters and non-ASCII characters, with A-Z lower-cased.  A window is
``window`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window.
All distinct windows go into one automaton, in which a word is its number, written in two or three digits: that keeps
it small (about 40 bytes a state, two or three states a word of a window) and each state's branches few.  It reads
each text's words once, and hits are placed in the original text.  A document word inside any occurrence is hit.

Defined results: null or wordless texts give zero counts and no items; null items and items without
words have no windows; items that share an id count as one; repeated documents are scanned each on their own;
an empty benchmark hits nothing; other columns pass through, but one named as ``into`` is replaced, and names
that start with ``__dc_`` are the operator's own.  Rows stay where they are: the scan is a projection and
shuffles nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import LOWER_FOLD, WORD_FOLD, binary_values, materialize

RESULT = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>>"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
WORD_SQL = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(win, size, items): each distinct window as words with blanks between, and the sorted items that hold it."""
    words = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORD_SQL), F.lit(0))
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where("item is not null and size(w) > 0")
    size = F.least(F.lit(window), F.size("w"))
    cut = F.transform(F.sequence(F.lit(1), F.size("w") - size + 1), lambda i: F.array_join(F.slice("w", i, size), " "))
    each = items.select("item", size.alias("size"), F.explode(F.array_distinct(cut)).alias("win"))
    return each.groupBy("win", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


#: A digit of a word's number has so many values.  Each place has digits of its own, so a match starts and ends with a word.
DIGITS = 128


class Words:
    """The automaton over word numbers; a pattern's value is its place in ``sizes`` and ``items``."""

    def __init__(self, windows: list[tuple[str, int, list[str]]]):
        import ahocorasick

        cut = [win.encode().split(b" ") for win, _, _ in windows]
        words = sorted({w for own in cut for w in own})
        self.width = 2 if len(words) <= DIGITS**2 else 3 if len(words) <= DIGITS**3 else 4
        self.code = {w: "".join(chr(1 + j * DIGITS + k // DIGITS**j % DIGITS) for j in reversed(range(self.width))) for k, w in enumerate(words)}
        self.other = "\0" * self.width  # any other word
        self.sizes, self.items = [n for _, n, _ in windows], [items for _, _, items in windows]
        self.auto = ahocorasick.Automaton(ahocorasick.STORE_INTS) if windows else None
        for k, own in enumerate(cut):
            self.auto.add_word("".join(map(self.code.__getitem__, own)), k)
        if windows:
            self.auto.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(place of the last word, pattern) of every occurrence."""
        if not self.auto:
            return []
        return [(end // self.width, k) for end, k in self.auto.iter("".join(map(self.code.get, words, repeat(self.other))))]


def scan_text(auto: Words, raw: bytes | None) -> dict:
    """Counts, items and character spans of hit words of one text."""
    import numpy as np

    words = (raw or b"").translate(WORD_FOLD).split()
    out = {"n_words": len(words), "n_hit": 0, "items": [], "spans": []}
    hits = auto.hits(words) if words else []
    if not hits:
        return out
    edge = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for last, k in hits:
        edge[last - auto.sizes[k] + 1] += 1
        edge[last + 1] -= 1
        items.update(auto.items[k])
    hit = np.cumsum(edge[:-1]) > 0
    places = [m.span() for m in WORD.finditer(raw.translate(LOWER_FOLD).decode("utf-8", "replace"))]
    step = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
    spans = [{"start": places[a][0], "end": places[b - 1][1]} for a, b in zip(step[::2], step[1::2], strict=True)]
    return out | {"n_hit": int(hit.sum()), "items": sorted(items), "spans": spans}


def automaton_of(held) -> Words:
    """The automaton of a broadcast list of windows.  A worker process builds it once and keeps it beside the list."""
    built = getattr(held, "automaton", None)
    if built is None:
        built = held.automaton = Words(held.value)
    return built


def scanner(held):
    """The scan as a column function; ``held`` is a broadcast list of windows."""

    @arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct(
            [
                ("n_words", pa.int64()),
                ("n_hit", pa.int64()),
                ("items", pa.list_(pa.string())),
                ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ]
        )
        auto = automaton_of(held)
        for batch in batches:
            yield pa.array([scan_text(auto, raw) for raw in binary_values(batch)], kind)

    return scan.asNondeterministic()  # evaluated once, however often its fields are used


def merged(a: Column, b: Column) -> Column:
    """Two sorted lists of spans as one; spans that touch or overlap become one."""
    joined = F.array_sort(F.concat(a, b))
    return F.aggregate(
        joined,
        F.slice(joined, 1, 0),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(
                    F.struct(
                        F.element_at(acc, -1)["start"].alias("start"),
                        F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"),
                    )
                ),
            ),
        ).otherwise(F.concat(acc, F.array(x))),
    )


def scan_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    window: int = 10,
    text: str = "text",
    into: str = "contamination",
    max_states: int = 6_000_000,
) -> DataFrame:
    """``docs`` with a struct column ``into``: n_words, n_hit, items, and spans of hit words in the original text.

    The automaton's states are bounded before anything is sent: up to ``max_states`` (about 240 MB a worker) all
    windows go into one.  More of them are dealt by window into parts below that number, each scanned in turn over
    the stored result of the one before, and spans and items of all parts are merged.
    """
    spark = docs.sparkSession
    windows = materialize(benchmark_windows(benchmark, window), "windows")
    parts = max(1, -(-3 * (windows.agg(F.sum("size")).first()[0] or 0) // max_states))

    def part(k: int):
        chosen = windows if parts == 1 else windows.where(F.pmod(F.xxhash64("win"), F.lit(parts)) == k)
        return scanner(spark.sparkContext.broadcast([tuple(r) for r in chosen.collect()]))(F.col(text))

    out = docs.withColumn(into, part(0))
    for k in range(1, parts):
        out = materialize(out, "contamination").withColumn("__dc_more", part(k))
        a, b = F.col(into), F.col("__dc_more")
        words = F.regexp_extract_all(F.translate("__dc_hit", UPPER, LOWER), F.lit(WORD_SQL), F.lit(0))
        out = out.withColumn("__dc_spans", merged(a["spans"], b["spans"]))
        out = out.withColumn(
            "__dc_hit",
            F.array_join(F.transform("__dc_spans", lambda s: F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"])), " "),
        )
        out = out.withColumn(
            into,
            F.struct(
                a["n_words"].alias("n_words"),
                F.size(words).cast("bigint").alias("n_hit"),
                F.array_sort(F.array_union(a["items"], b["items"])).alias("items"),
                F.col("__dc_spans").alias("spans"),
            ),
        ).drop("__dc_more", "__dc_spans", "__dc_hit")
    return out
