"""Token files: ids of whole documents, coded by a static range asymmetric numeral system.

A set of token files is a folder with two Parquet tables, which Spark commits, so a lost executor leaves no half of one:

``table``   (symbol, freq): one shared frequency table, counted over the ids of all documents and scaled to a power of two.
``blocks``  (part, at, n_tokens, doc_ids, lengths, payload): runs of whole documents of about ``block_tokens`` ids, in
            ascending order of the ids of documents.  A block starts ``at`` ids into its part; parts follow each other.

A payload can be read with nothing but the table.  All numbers in it are little endian:

    b"RANS"  lanes u32  bits u32  stride u32  segments u32  tokens u64  words u64
    segments x (word offset u64, crc32 of the segment's ids as u32)
    segments x lanes x state u64
    words x u32
    crc32 of all before it, u32

Token t belongs to lane t mod lanes, so all lanes of a step are coded at once.  States are 64-bit, with 32-bit words moved
out and in.  Every ``stride`` steps there is a checkpoint: the lanes' states and the place among the words.  A reader can
start at any of them, so the segments between are decoded side by side, or one alone.  What a segment leaves behind has
to be the next one's checkpoint, and its ids have to have its checksum; anything else is an error.

Scale: texts are shuffled once, by ranges of (id, row), so one id on very many rows is no hot key; ids are stored once,
counted by task, and coded block by block.  The table has no more rows than the tokenizer has ids, and is broadcast.

Defined results: a null text counts as empty and is one end id; rows without an id come first; rows that share an id, or
repeat, stand one after the other in the order of the input, each with a start of its own; a very long text is
tokenised in stretches and makes one long block; an empty table gives an empty table of blocks; other columns do not
matter.  Ids are those of the plain tokenizer, also for texts that hold its special strings.
"""

from __future__ import annotations

import array
import codecs
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cached_property

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import new_folder
from .common import materialize

#: White space of Unicode as UTF-8, but for the blank itself.
ODD = rb"[\t-\r\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80"
#: A blank that white space or the end follows, as RE2 has it; blanks before anything else begin a word of a byte-level
#: tokenizer.
WIDE_RE2 = r"\x20(?:\z|[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}])"
CUT = re.compile(rb"\x20(?!\x20|\Z|" + ODD + rb")")
#: Words of these are cut by the model alone: letters, then punctuation.  An apostrophe may begin a word of its own.
LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
PUNCTUATION = b".,;:!?()-"
#: The characters by which byte-level models write the bytes; those that are not printable by themselves follow 255.
CHARACTERS = "".join(
    chr(b) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174 else chr(256 + sum(not (33 <= x <= 126 or 161 <= x <= 172 or x >= 174) for x in range(b)))
    for b in range(256)
)
BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
#: Texts of more bytes are tokenised in stretches of about so many.
STRETCH = 4 << 20
#: Bytes of texts whose words are numbered together.
SLICE = 8 << 20

MAGIC = b"RANS"
HEADER = "<4sIIIIQQ"
LOWEST = 1 << 31
BLOCKS = "part int, at long, n_tokens long, doc_ids array<long>, lengths array<long>, payload binary"


class ByteTokens:
    """Ids of texts, with a bounded cache of words, for byte-level tokenizers; other ones read their texts whole.

    Such a tokenizer cuts a text before every blank that something other than white space follows, whatever stands
    around it, so what stands between two such cuts can be kept with its ids.  A batch's words are numbered by Arrow,
    only new ones are looked at, and the ids of all are put together by number.
    """

    def __init__(self, path: str, most: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, "rb") as f:
            config = json.load(f)
        cut, model, added = config.get("pre_tokenizer") or {}, config["model"], config.get("added_tokens") or []
        plain = all(t["content"].split() == [t["content"]] and not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in added)
        usual = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback"))
        self.by_word = plain and usual and BYTE_LEVEL.items() <= cut.items() and not any(config.get(k) for k in ("normalizer", "truncation", "padding"))
        self.special = "|".join(re.escape(t["content"]) for t in added)
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.model = self.tokenizer.model
        self.words: dict[bytes, bytes] = {}  # a word that a blank precedes
        self.tails: dict[bytes, bytes] = {b"": b""}
        self.most = most

    def plain(self, texts: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [array.array(self.code, x.ids).tobytes() for x in found]

    def of_model(self, word: bytes) -> bytes:
        """Ids of a single word as the tokenizer cuts them, straight from its model."""
        return array.array(self.code, [t.id for t in self.model.tokenize(codecs.charmap_decode(word, "strict", CHARACTERS)[0])]).tobytes()

    def learn(self, missing: list[bytes]) -> None:
        """Adds words to the cache.  Letters and the punctuation after them are two words of the model; all else is cut by the tokenizer."""
        if len(self.words) + len(missing) > self.most:
            self.words.clear()
        rest, words, tails = [], self.words, self.tails
        for w in missing:
            core = w.rstrip(PUNCTUATION)
            if not (core.isalpha() or LETTERS.fullmatch(core)):
                rest.append(w)
                continue
            ids = words.get(core)
            if ids is None:
                words[core] = ids = self.of_model(b" " + core)
            if len(core) < len(w):
                tail = w[len(core) :]
                if tail not in tails:
                    if len(tails) > 10_000:
                        tails.clear()
                    tails[tail] = self.of_model(tail)
                words[w] = ids + tails[tail]
        words.update(zip(rest, self.plain([b" " + w for w in rest]), strict=True))

    def by_numbers(self, texts: pa.Array, end: bytes) -> tuple:
        """Ids of short texts without odd blanks, an end id after each, as (all ids, number of ids of each text)."""
        import numpy as np
        import pyarrow.compute as pc

        cut = pc.split_pattern(texts, " ")
        ends = cut.offsets.to_numpy()[1:] - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        number = coded.indices.to_numpy()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        found = list(map(self.words.get, names))
        starts = np.append(0, ends[:-1])
        plenty = np.ones(len(names), bool)
        inner = np.ones(len(number), bool)
        inner[starts] = False
        plenty[number[inner]] = False  # what only begins texts is not preceded by a blank
        missing = [w for w, ids, skip in zip(names, found, plenty.tolist(), strict=True) if ids is None and not skip]
        if missing:
            self.learn(missing)
            new = self.words
            found = [ids if ids is not None else new.get(w, b"") for w, ids in zip(names, found, strict=True)]
        heads = self.plain([names[k] for k in number[starts]])
        every = [*(ids or b"" for ids in found), *heads, end]
        # texts start with their heads and end with the end id
        number = number.astype(np.int64)
        number[starts] = len(names) + np.arange(len(starts))
        number = np.insert(number, ends, len(every) - 1)
        flat = np.frombuffer(b"".join(every), self.code)
        sizes = np.fromiter(map(len, every), np.int64, len(every)) // flat.itemsize
        place = np.cumsum(sizes) - sizes
        each = sizes[number]
        after = np.cumsum(each)
        ids = flat[np.repeat(place[number] - (after - each), each) + np.arange(after[-1])]
        last = after[ends + np.arange(len(ends))]
        return ids, np.diff(last, prepend=0)

    def ids(self, texts: pa.Array, end_id: int) -> list[bytes]:
        """The ids of each text, ``end_id`` after them, as bytes."""
        import numpy as np
        import pyarrow.compute as pc

        end = array.array(self.code, [end_id]).tobytes()
        texts = pc.fill_null(texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts, "")
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        odd = np.ones(len(texts), bool)
        if self.by_word:
            odd = pc.match_substring_regex(texts, WIDE_RE2 + (f"|{self.special}" if self.special else "")).to_numpy(zero_copy_only=False) | (sizes > STRETCH)
        out: list = [None] * len(texts)
        usual = np.flatnonzero(~odd)
        for own in np.split(usual, np.flatnonzero(np.diff(np.cumsum(sizes[usual]) // SLICE)) + 1) if len(usual) else []:
            ids, n = self.by_numbers(texts.take(pa.array(own)), end)
            held, after = memoryview(ids.tobytes()), np.cumsum(n) * ids.itemsize
            for k, a, b in zip(own.tolist(), (after - n * ids.itemsize).tolist(), after.tolist(), strict=True):
                out[k] = bytes(held[a:b])
        special = re.compile(self.special.encode() or b"(?!)")
        for k in np.flatnonzero(odd).tolist():
            raw = texts[k].as_buffer().to_pybytes()
            out[k] = (b"".join(map(self.cut, stretches(raw))) if self.by_word and not special.search(raw) else self.plain([raw])[0]) + end
        return out

    def cut(self, raw: bytes) -> bytes:
        """Ids of a text with any white space."""
        head, *words = CUT.split(raw)
        known = {w: self.words.get(w) for w in words}
        if missing := [w for w, ids in known.items() if ids is None]:
            self.learn(missing)
            known |= {w: self.words[w] for w in missing}
        return self.plain([head])[0] + b"".join(map(known.__getitem__, words))


def stretches(text: bytes) -> Iterator[bytes]:
    """Parts of a text that can be tokenised one by one."""
    start = 0
    while start < len(text):
        cut = CUT.search(text, start + STRETCH)
        end = cut.start() if cut else len(text)
        yield text[start:end]
        start = end


def scaled(counts, bits: int):
    """Frequencies that add up to ``2 ** bits``, at least 1 each, by largest remainders."""
    import numpy as np

    total, room = int(counts.sum()), (1 << bits) - len(counts)
    exact = [int(c) * room for c in counts.tolist()]  # beyond 64 bits for large corpora
    freq = np.array([1 + x // total for x in exact], np.int64)
    left = (1 << bits) - int(freq.sum())
    rest = np.array([x % total / total for x in exact])
    freq[np.lexsort((np.arange(len(freq)), -rest))[:left]] += 1
    return freq


class Table:
    """The shared frequency table; ``symbols`` ascend."""

    def __init__(self, symbols, freq):
        import numpy as np

        self.symbols, freq = np.asarray(symbols, np.uint32), np.asarray(freq, np.uint64)
        self.bits = int(freq.sum()).bit_length() - 1
        if int(freq.sum()) != 1 << self.bits:
            raise ValueError("the frequencies do not add up to a power of two")
        self.freq, self.start = freq, np.cumsum(freq) - freq
        self.common = int(freq.argmax())

    @cached_property
    def place(self):
        """Of each id its place in the table."""
        import numpy as np

        place = np.full(int(self.symbols[-1]) + 1, len(self.symbols), np.uint32)  # an id that the table lacks is an error
        place[self.symbols] = np.arange(len(self.symbols))
        return place

    @cached_property
    def at_slot(self):
        import numpy as np

        return np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))

    def encode(self, ids, *, lanes: int = 1024, stride: int = 512) -> bytes:
        """A payload of the ids; short ones have fewer lanes, down to one."""
        import numpy as np

        n = len(ids)
        place = self.place[ids]
        lanes = max(1, min(lanes, n // 64))
        steps = -(-n // lanes)
        place = np.concatenate([place, np.full(steps * lanes - n, self.common)]).reshape(steps, lanes)
        bits, low, half = np.uint64(self.bits), np.uint64(0xFFFFFFFF), np.uint64(32)
        freq, start = self.freq[place], self.start[place]
        limit = freq << np.uint64(63 - self.bits)  # states from here on move a word out first
        x = np.full(lanes, LOWEST, np.uint64)
        words, states, passed, out = [], [], [], 0
        for t in range(steps - 1, -1, -1):
            f = freq[t]
            full = np.flatnonzero(x >= limit[t])
            if len(full):
                moved = x[full]
                words.append((moved & low).astype("<u4"))
                x[full] = moved >> half
                out += len(full)
            high = x // f
            x = (high << bits) + (x - high * f) + start[t]
            if t % stride == 0:
                states.append(x.copy())
                passed.append(out)
        segments = len(states)
        raw = np.asarray(ids, "<u4")
        parts = [struct.pack(HEADER, MAGIC, lanes, self.bits, stride, segments, n, out)]
        for s in range(segments):
            crc = zlib.crc32(raw[s * stride * lanes : (s + 1) * stride * lanes].tobytes())
            parts.append(struct.pack("<QI", out - passed[segments - 1 - s], crc))
        parts += [np.array(x, "<u8").tobytes() for x in reversed(states)]
        parts += [w.tobytes() for w in reversed(words)]
        payload = b"".join(parts)
        return payload + struct.pack("<I", zlib.crc32(payload))

    def decode(self, payload: bytes, segments: range | None = None):
        """The ids of a payload, or those of some of its segments, as 32-bit numbers; an error if a checksum does not hold."""
        import numpy as np

        magic, lanes, bits, stride, count, n, size = struct.unpack_from(HEADER, payload)
        if magic != MAGIC or bits != self.bits or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
            raise ValueError("this is not an undamaged block of this table")
        index = [struct.unpack_from("<QI", payload, struct.calcsize(HEADER) + 12 * s) for s in range(count)]
        at = struct.calcsize(HEADER) + 12 * count
        states = np.frombuffer(payload, "<u8", count * lanes, at).reshape(count, lanes)
        words = np.append(np.frombuffer(payload, "<u4", size, at + states.nbytes), np.uint32(0)).astype(np.uint64)
        own = list(range(count) if segments is None else segments)
        steps = -(-n // lanes) if n else 0
        each = [min(stride, steps - s * stride) for s in own]
        x = states[own].copy()
        spot = np.array([index[s][0] for s in own], np.int64)
        out = np.empty((len(own), max(each, default=0), lanes), np.uint32)
        mask, shift, half = np.uint64((1 << bits) - 1), np.uint64(bits), np.uint64(32)
        final: dict[int, tuple] = {}
        for t in range(out.shape[1]):
            slot = x & mask
            p = self.at_slot[slot]
            out[:, t] = self.symbols[p]
            x = self.freq[p] * (x >> shift) + slot - self.start[p]
            need = x < LOWEST
            taken = need.cumsum(1)
            where = np.minimum((spot[:, None] + taken - 1)[need], size)
            x[need] = (x[need] << half) | words[where]
            spot = spot + taken[:, -1]
            for k in (k for k, e in enumerate(each) if e == t + 1):
                final[k] = x[k].copy(), int(spot[k])
        found = []
        for k, s in enumerate(own):
            ids = out[k, : each[k]].ravel()[: n - s * stride * lanes]
            expected = (states[s + 1], index[s + 1][0]) if s + 1 < count else (np.full(lanes, LOWEST, np.uint64), size)
            if not (final[k][0] == expected[0]).all() or final[k][1] != expected[1] or zlib.crc32(ids.astype("<u4").tobytes()) != index[s][1]:
                raise ValueError(f"segment {s} is damaged")
            found.append(ids)
        return np.concatenate(found) if found else np.zeros(0, np.uint32)


def tokenised(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """(part, at, doc_id, n, ids): stored ids in ascending order of doc_id; ``part`` is a range of it and ``at`` counts from its start."""
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("row")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    held = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = getattr(held, "tokens", None)
        if tokens is None:  # a worker process keeps its cache from task to task
            tokens = held.tokens = ByteTokens(held.value)
        part, at, width = TaskContext.get().partitionId(), 0, array.array(tokens.code).itemsize
        for batch in batches:
            ids = tokens.ids(batch.column(2), end_id)
            n = [len(own) // width for own in ids]
            starts = [at := at + k for k in n]
            cols = [pa.array([part] * len(n), pa.int32()), pa.array([e - k for e, k in zip(starts, n, strict=True)], pa.int64()), batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["part", "at", "doc_id", "n", "ids"])

    return materialize(rows.mapInArrow(run, "part int, at long, doc_id long, n long, ids binary"), "token-ids")


def counted(ids: DataFrame, code: str) -> DataFrame:
    """(symbol, n) of all stored ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        total = np.zeros(0, np.int64)
        for batch in batches:
            got = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), code), minlength=len(total))
            got[: len(total)] += total
            total = got
        symbols = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(symbols), pa.array(total[symbols])], ["symbol", "n"])

    return ids.select("ids").mapInArrow(run, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n"))


def blocks_of(held, code: str, block_tokens: int):
    """Stored ids to blocks; ``held`` broadcasts the frequency table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        table = Table(*held.value) if len(held.value[0]) else None  # no ids, no blocks
        doc_ids: list = []
        lengths: list[int] = []
        parts: list[bytes] = []
        part, first, after = -1, 0, 0

        def block() -> pa.RecordBatch:
            payload = table.encode(np.frombuffer(b"".join(parts), code))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary())
            cols = [pa.array([x], kind) for x, kind in zip((part, first, after - first, doc_ids, lengths, payload), kinds, strict=True)]
            return pa.RecordBatch.from_arrays(cols, ["part", "at", "n_tokens", "doc_ids", "lengths", "payload"])

        for batch in batches:
            for p, at, doc_id, n, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and ((p, at) != (part, after) or after - first >= block_tokens):
                    yield block()
                    doc_ids, lengths, parts = [], [], []
                if not parts:
                    part, first = p, at
                after = at + n
                doc_ids.append(doc_id)
                lengths.append(n)
                parts.append(ids)
        if parts:
            yield block()

    return run


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, *, end_id: int = 0, block_tokens: int = 1 << 21, doc_id: str = "doc_id", text: str = "text"
) -> None:
    """Writes the ids of all documents, an end id after each, to the folder ``path``, which has to be new."""
    import numpy as np

    spark = docs.sparkSession
    ids = tokenised(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), tokenizer, end_id)
    code = ByteTokens(tokenizer).code
    counts = counted(ids, code).toArrow().sort_by("symbol")
    symbols, n = counts["symbol"].to_numpy(), counts["n"].to_numpy()
    freq = scaled(n, max(12, (len(n) - 1).bit_length() + 4)) if len(n) else np.zeros(0, np.int64)
    spark.createDataFrame(pa.table({"symbol": symbols, "freq": freq})).coalesce(1).write.parquet(f"{path}/table")
    held = spark.sparkContext.broadcast((symbols, freq))
    ids.mapInArrow(blocks_of(held, code, block_tokens), BLOCKS).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_blocks(spark: SparkSession, path: str, schema: str, row) -> DataFrame:
    """(doc_id, start) and what ``row`` makes of each document's ids, from token files; ``schema`` names the latter."""
    table = spark.read.parquet(f"{path}/table").toArrow().sort_by("symbol")
    held = spark.sparkContext.broadcast((table["symbol"].to_numpy(), table["freq"].to_numpy()))
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codes = Table(*held.value) if len(held.value[0]) else None
        for batch in batches:
            for part, at, _, doc_ids, lengths, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = codes.decode(payload)
                ends = np.cumsum(lengths)
                starts = ends - lengths
                own = row(ids, starts.tolist(), ends.tolist())
                cols = [pa.array([part] * len(ends), pa.int32()), pa.array(starts + at), pa.array(doc_ids, pa.int64()), *own]
                yield pa.RecordBatch.from_arrays(cols, ["part", "at", "doc_id", *(c.split()[0] for c in schema.split(", "))])

    sizes = blocks.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each part
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before")
    found = blocks.mapInArrow(run, f"part int, at long, doc_id long, {schema}").join(F.broadcast(sizes.select("part", before)), "part")
    return found.select("doc_id", (F.col("before") + F.col("at")).alias("start"), *(c.split()[0] for c in schema.split(", ")))


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in token files; ``start`` counts the ids of all documents before it."""

    def row(ids, starts, ends):
        return [pa.ListArray.from_arrays(pa.array([*starts, ends[-1]], pa.int32()), pa.array(ids.astype("i4")))]

    return read_blocks(spark, path, "ids array<int>", row)


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in token files, from its decoded ids."""

    def row(ids, starts, ends):
        raw = memoryview(ids.astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts, ends, strict=True)]
        return [pa.array([b - a for a, b in zip(starts, ends, strict=True)], pa.int64()), pa.array(crc, pa.int64())]

    return read_blocks(spark, path, "n_tokens long, ids_crc32 long", row)


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the folder that the cluster shares."""
    return new_folder(spark, "token-files")
