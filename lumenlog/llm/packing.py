"""Best-fit packing of tokenised documents by swap-based local search.

A document is its tokens and an end token.  Only one longer than ``capacity`` is cut, into full pieces and a
last shorter one.  Pieces keep whole; a full piece is a sequence of its own.  The others are dealt at random
into groups of about ``group_size`` pieces.  In a group each piece, longest first, goes to the fullest bin
that still holds it; then a local search works on the bins that are not full: it moves a piece, exchanges
one for one or two for one between two bins wherever that raises the sum of squared fills, so that the
light bins run empty.  It ends when no bin has such a step left, or when no fewer bins can hold the group.
What is in bins that stay light is dealt again, over as many fewer groups, while that shrinks what is left, so
light sequences remain in the last groups only.

Scale: texts are read once and never shuffled; what is shuffled is a few numbers a piece.  A group has a
bounded number of pieces, drawn by a number of the stored row, so no key and no repeated row can fill one.

Defined results: a null text counts as empty and is one end token; a very long one is cut like any other above
``capacity``; repeated rows, and rows with a null id, are packed each on their own (a pair of doc_id and piece
may then occur twice); an empty table gives no rows; other columns do not matter.

Token ids are those of the plain tokenizer, also for texts that hold its special strings.  They are cached by
white-space-delimited chunk, and by the tokenizer's own word within a chunk.  That needs a tokenizer that drops
white space and cuts words by a known pattern; any other one reads its texts whole.
"""

from __future__ import annotations

import array
import bisect
import json
import os
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import binary_values, materialize

PIECES = "struct<n_tokens:bigint,crcs:array<bigint>>"
PACKED = "doc_id long, piece long, start long, length long, ids_crc32 long, row long, sequence_id long, offset long"
LEVELS = 8
#: A chunk of these characters only, printable ASCII and Latin-1 letters, may be cut into words by PRE_TOKEN; any
#: other goes to the tokenizer whole.  None of them changes under NFC, and all have a single lower case.
SIMPLE = re.compile(rb"(?:[!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
SIMPLE_LINES = re.compile(rb"(?:[\n!-~]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
PRE_TOKEN = re.compile(rb"\n|'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+|[0-9]|[^\sa-z0-9\x80-\xff]+")
#: The character by which byte-level models write a byte that is not printable by itself.
BYTE_CHARACTERS = {b: 256 + k for k, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
#: Stands for a line end between chunks; no ids below 2 ** 24 hold these four bytes in a row.
BREAK = b"\xff\xff\xff\xff"
#: How a tokenizer has to treat texts for chunks and words to be cached: these steps are what the patterns above restate.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
CUTS = [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
]


def cacheable(config: dict) -> bool:
    """Whether a tokenizer, given as its file's content, works chunk by chunk and word by word as the patterns above say."""
    steps = (config.get("normalizer") or {}).get("normalizers"), (config.get("pre_tokenizer") or {}).get("pretokenizers")
    added = config.get("added_tokens") or []
    plain = all(t["content"].isascii() and t["content"].split() == [t["content"]] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
    return steps == (NORMALIZERS, CUTS) and plain and config["model"]["type"] == "BPE" and not config.get("truncation") and not config.get("padding")


class TokenCache:
    """Token ids of a text as little-endian unsigned 32-bit numbers, with bounded caches."""

    def __init__(self, path: str, chunks: int = 900_000, words: int = 900_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            self.by_chunk = cacheable(json.load(f))
        self.special = re.compile(b"|".join(re.escape(t.content.encode()) for t in self.tokenizer.get_added_tokens_decoder().values()) or b"(?!)")
        self.chunks: dict[bytes, bytes] = {}
        self.words: dict[bytes, bytes] = {b"\n": BREAK}
        self.most = chunks, words
        self.model = self.tokenizer.model

    def encode(self, raws: list[bytes]) -> list[bytes]:
        texts = [raw.decode("utf-8", "replace") for raw in raws]
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array.array("I", x.ids).tobytes() for x in found]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Ids of single words, straight from the tokenizer's model: they are normalised and cut already."""
        ids = self.model.tokenize
        texts = (w.decode() if w.isascii() else w.decode("latin-1").translate(BYTE_CHARACTERS) for w in words)
        return [array.array("I", [t.id for t in ids(text)]).tobytes() for text in texts]

    def learn(self, missing: set[bytes]) -> None:
        """Adds the chunks to the cache.  They are cut into words as the lines of one text, and only new words are coded."""
        if len(self.chunks) + len(missing) > self.most[0]:
            self.chunks.clear()
        if len(self.words) > self.most[1]:
            self.words = {b"\n": BREAK}
        simple, rest = list(missing), []
        joined = b"\n".join(simple)
        if self.special.search(joined) or not SIMPLE_LINES.fullmatch(joined):
            alone = {c for c in missing if self.special.search(c) or not SIMPLE.fullmatch(c)}
            simple, rest = list(missing - alone), list(alone)
        words = PRE_TOKEN.findall(b"\n".join(simple).decode().lower().encode())
        new = [w for w in set(words) if w not in self.words]
        self.words.update(zip(new, self.encode_words(new), strict=True))
        if simple:
            self.chunks.update(zip(simple, b"".join(map(self.words.__getitem__, words)).split(BREAK), strict=True))
        self.chunks.update(zip(rest, self.encode(rest), strict=True))

    def ids(self, raws: list[bytes]) -> Iterator[bytes]:
        for k in range(0, len(raws), 64):
            if not self.by_chunk:
                yield from self.encode(raws[k : k + 64])
                continue
            cut = [raw.split() for raw in raws[k : k + 64]]
            found = [list(map(self.chunks.get, chunks)) for chunks in cut]
            gaps = [[i for i, x in enumerate(own) if x is None] if None in own else [] for own in found]
            if missing := {chunks[i] for chunks, at in zip(cut, gaps, strict=True) for i in at}:
                self.learn(missing)
            for chunks, own, at in zip(cut, found, gaps, strict=True):
                for i in at:
                    own[i] = self.chunks[chunks[i]]
                yield b"".join(own)


def tokens_of(path: str, capacity: int, end_id: int):
    """Column function: how many tokens a text has, its end token included, and the crc32 of each piece."""
    end = array.array("I", [end_id]).tobytes()

    @arrow_udf(PIECES)
    def tokens(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        cache = TokenCache(path)
        kind = pa.struct([("n_tokens", pa.int64()), ("crcs", pa.list_(pa.int64()))])
        width = 4 * capacity
        for batch in batches:
            raws = [raw or b"" for raw in binary_values(batch)]
            out = []
            for ids in cache.ids(raws):
                ids += end
                out.append({"n_tokens": len(ids) // 4, "crcs": [zlib.crc32(ids[i : i + width]) for i in range(0, len(ids), width)]})
            yield pa.array(out, kind)

    return tokens.asNondeterministic()


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Bins of indexes: each piece, longest first, into the fullest bin that holds it."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by what they still hold
    open_rooms: list[int] = []  # sorted
    bins: list[list[int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = bisect.bisect_left(open_rooms, lengths[i])
        if at == len(open_rooms):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left = open_rooms[at]
            b = room[left].pop()
            if not room[left]:
                del open_rooms[at]
        bins[b].append(i)
        left -= lengths[i]
        if left:
            if not room[left]:
                bisect.insort(open_rooms, left)
            room[left].append(b)
    return bins


def totals(lengths: list[int]) -> tuple[list[int], dict[int, tuple[int, int]]]:
    """The distinct lengths in a bin, and what two of its pieces add up to, with the two lengths.  A bin of ``capacity``
    tokens has few distinct lengths, however many pieces it holds."""
    count = Counter(lengths)
    ones = sorted(count)
    twos = {a + b: (a, b) for k, b in enumerate(ones) for a in ones[: k + 1] if a != b or count[a] > 1}
    return ones, twos


class Search:
    """Bins under local search.  A step gives one or two pieces of a lighter bin to a fuller one, for none, one or (against
    one) two of its own; it raises the sum of squared fills if the fuller bin gains."""

    def __init__(self, bins: list[list[int]], lengths: list[int], capacity: int):
        import numpy as np

        self.lengths, self.capacity = lengths, capacity
        self.bins = [list(b) for b in bins]
        self.gap = np.array([capacity - sum(lengths[i] for i in b) for b in self.bins])
        self.own = [totals([lengths[i] for i in b]) for b in self.bins]
        self.stale = True

    def open_bins(self) -> list[int]:
        """Bins that are neither full nor empty, lightest first."""
        return sorted((k for k, b in enumerate(self.bins) if b and self.gap[k]), key=lambda k: -self.gap[k])

    def options(self) -> None:
        """What the open bins could give back: totals of none or one piece, and of two, with their bins."""
        import numpy as np

        at = self.open_bins()
        self.one = np.array([x for k in at for x in (0, *self.own[k][0])], np.int64)
        self.one_bin = np.repeat(at, [1 + len(self.own[k][0]) for k in at])
        self.two = np.array([x for k in at for x in self.own[k][1]], np.int64)
        self.two_bin = np.repeat(at, [len(self.own[k][1]) for k in at])
        self.stale = False

    def step(self, light: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The step that moves most tokens out of ``light``: the other bin, the lengths given and the lengths taken."""
        import numpy as np

        if self.stale:
            self.options()

        def reach(total, where):
            """By total, the largest gap of a fuller bin that could give it back."""
            gap = self.gap[where]
            fits = (gap <= self.gap[light]) & (where != light)
            out = np.zeros(self.capacity + 1, np.int64)
            np.maximum.at(out, total[fits], gap[fits])
            return out

        one, two = reach(self.one, self.one_bin), reach(self.two, self.two_bin)
        ones, twos = self.own[light]
        give = np.array([*ones, *twos], np.int64)
        gain = give[:, None] - np.arange(self.capacity + 1)
        most = np.where((np.arange(len(give)) < len(ones))[:, None], np.maximum(one, two), one)  # two pieces are given for one at most
        gain[(gain > most) | (gain < 0)] = 0
        at, back = np.unravel_index(int(gain.argmax()), gain.shape)
        moved = int(gain[at, back])
        if not moved:
            return None
        given = (ones[at],) if at < len(ones) else twos[int(give[at])]
        for total, where, single in ((self.one, self.one_bin, True), (self.two, self.two_bin, False)):
            if single or at < len(ones):
                gap = self.gap[where]
                fits = np.flatnonzero((total == back) & (gap >= moved) & (gap <= self.gap[light]) & (where != light))
                if len(fits):
                    other = int(where[fits[gap[fits].argmin()]])
                    return other, given, ((int(back),) if back else ()) if single else self.own[other][1][int(back)]
        return None

    def apply(self, light: int, other: int, given: tuple[int, ...], taken: tuple[int, ...]) -> None:
        def out_of(k: int, sizes: tuple[int, ...]) -> list[int]:
            picked = []
            for n in sizes:
                i = next(i for i in self.bins[k] if self.lengths[i] == n)
                self.bins[k].remove(i)
                picked.append(i)
            return picked

        there, back = out_of(light, given), out_of(other, taken)
        self.bins[other] += there
        self.bins[light] += back
        for k in (light, other):
            self.own[k] = totals([self.lengths[i] for i in self.bins[k]])
            self.gap[k] = self.capacity - sum(self.lengths[i] for i in self.bins[k])
        self.stale = True


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search: passes over all bins that are not full, lightest first, until a pass finds no step in any of them, or
    no fewer bins could hold the pieces."""
    search, least = Search(bins, lengths, capacity), -(-sum(lengths) // capacity)
    moving = True
    while moving:
        moving = False
        for k in search.open_bins():
            while search.bins[k] and search.gap[k] and (step := search.step(k)):
                search.apply(k, *step)
                moving = True
            if sum(map(bool, search.bins)) <= least:
                return [b for b in search.bins if b]
    return [b for b in search.bins if b]


def pack_group(lengths: list[int], capacity: int) -> list[list[int]]:
    bins = best_fit(lengths, capacity)
    return bins if len(bins) == -(-sum(lengths) // capacity) else improve(bins, lengths, capacity)


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = 2048,
    end_id: int = 0,
    group_size: int = 5_000,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece: doc_id, piece (an int), start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = docs.select(F.col(doc_id).alias("doc_id"), tokens_of(tokenizer, capacity, end_id)(F.col(text)).alias("t"))
    pieces = materialize(
        cut.select("doc_id", "t.n_tokens", F.posexplode("t.crcs").alias("piece", "ids_crc32")).select(
            "doc_id",
            F.col("piece").cast("long").alias("piece"),
            (F.col("piece").cast("long") * capacity).alias("start"),
            F.least(F.lit(capacity), F.col("n_tokens") - F.col("piece").cast("long") * capacity).cast("long").alias("length"),
            "ids_crc32",
            F.monotonically_increasing_id().alias("row"),  # stored, so that a rerun deals a piece to the same group
        ),
        "pieces",
    )
    full = pieces.where(F.col("length") == capacity).select(
        "*", (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    out, left = full, pieces.where(F.col("length") < capacity)
    todo, before = left.count(), None
    for level in range(LEVELS):
        groups = max(1, -(-todo // group_size))
        last = groups == 1 or level == LEVELS - 1 or before is not None and todo > before * 0.6
        key = F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups))
        packed = materialize(
            left.withColumn("__group", key).groupBy("__group").applyInArrow(group_packer(capacity, level), PACKED + ", light boolean"),
            "packed",
        )
        out = out.unionByName((packed if last else packed.where("not light")).drop("light"))
        if last:
            break
        left = packed.where("light").drop("light", "sequence_id", "offset")
        todo, before = left.count(), todo
    return out.drop("row").withColumn("piece", F.col("piece").cast("int"))


def group_packer(capacity: int, level: int):
    """Packs one group; a sequence's number holds its level, its group and its place there."""

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.drop_columns("__group").sort_by([("length", "ascending"), ("row", "ascending")])
        lengths = rows["length"].to_pylist()
        n = len(lengths)
        sequence, offset, light = [0] * n, [0] * n, [False] * n
        for k, members in enumerate(pack_group(lengths, capacity)):
            at = 0
            thin = sum(lengths[i] for i in members) < capacity - capacity // 64
            for i in members:
                sequence[i], offset[i], light[i] = ((level << 36 | key[0].as_py()) << 22) | k, at, thin
                at += lengths[i]
        for name, values, kind in (("sequence_id", sequence, pa.int64()), ("offset", offset, pa.int64()), ("light", light, pa.bool_())):
            rows = rows.append_column(name, pa.array(values, kind))
        return rows

    return run
