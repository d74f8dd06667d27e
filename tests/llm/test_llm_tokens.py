"""Token files: the coder's round trip, damage, ids against the plain tokenizer, and files read back."""

import array
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from lumenlog.llm import token_files
from lumenlog.llm.token_files import ByteTokens, Table, read_token_files, scaled, token_digests, token_folder, write_token_files


@pytest.fixture(scope="module")
def tokenizer():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def table_of(ids):
    symbols, n = np.unique(ids, return_counts=True)
    return Table(symbols, scaled(n, max(12, (len(n) - 1).bit_length() + 4)))


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 5000, 70_000])
@pytest.mark.parametrize("shape", ["one", "flat", "steep"])
def test_ids_come_back(n, shape):
    rng = np.random.default_rng(n)
    ids = {"one": np.full(n, 7), "flat": rng.integers(0, 50_257, n), "steep": np.minimum(rng.exponential(30, n).astype(np.int64), 50_256)}[shape]
    table = table_of(ids)
    for lanes, stride in ((1024, 512), (8, 16), (1, 1 << 20)):
        payload = table.encode(ids, lanes=lanes, stride=stride)
        assert (table.decode(payload) == ids).all()
        _, own, _, step, count, tokens, _ = token_files.struct.unpack_from(token_files.HEADER, payload)
        assert tokens == n
        k = count // 2  # a segment alone
        assert (table.decode(payload, range(k, k + 1)) == ids[k * step * own : (k + 1) * step * own]).all()


def test_coded_size_is_near_the_entropy():
    ids = np.minimum(np.random.default_rng(1).exponential(500, 1_000_000).astype(np.int64), 50_256)
    _, n = np.unique(ids, return_counts=True)
    entropy = -(n / len(ids) * np.log2(n / len(ids))).sum() * len(ids) / 8
    assert len(table_of(ids).encode(ids)) < 1.03 * entropy


def test_damage_is_found():
    ids = np.random.default_rng(2).integers(0, 300, 40_000)
    table = table_of(ids)
    payload = table.encode(ids, lanes=16, stride=100)
    for at in (0, 9, 60, len(payload) // 2, len(payload) - 1):
        bad = bytearray(payload)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            table.decode(bytes(bad))
        body = bytes(bad[:-4])
        if 60 < at < len(payload) - 4:  # also behind a checksum that fits: the checkpoints and the segments have theirs
            with pytest.raises(ValueError):
                table.decode(body + token_files.struct.pack("<I", zlib.crc32(body)))


def test_frequencies_add_up():
    for n in ([1], [5, 1, 1], [10**15, 1, 1, 3], list(range(1, 3000))):
        freq = scaled(np.array(n), 14)
        assert freq.sum() == 1 << 14 and freq.min() >= 1


PARTS = [" ", "  ", "\n", "\t", "\r\n", "a", "Bc", "é", "é", "1", "23", ",", "'s", "'ll", "!", "<|endoftext|>", " ", " ", "\x1c", "世界", "😀", " it", " don't", " (x)", " ß-", " --", "\u0085"]


def test_cached_ids_equal_the_tokenizers(tokenizer, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 40))) for _ in range(1500)] + ["", None, " ", "x", " x", "x "]
    tokens = ByteTokens(tokenizer, most=50)
    want = [array.array("H", [*x.ids, 0]).tobytes() for x in tokens.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert tokens.by_word and tokens.ids(pa.array(texts), 0) == want
    monkeypatch.setattr(token_files, "STRETCH", 10)
    monkeypatch.setattr(token_files, "SLICE", 30)
    assert ByteTokens(tokenizer).ids(pa.array(texts), 0) == want


def test_files_round_trip(spark, tokenizer):
    from tokenizers import Tokenizer

    rng = random.Random(5)
    rows = [(rng.randrange(60), "".join(rng.choice(PARTS) for _ in range(rng.randrange(0, 60)))) for _ in range(80)]
    rows += [(7, None), (None, "no id"), (9, "")] + [(30, "one and the same")] * 200 + [(61, "long words " * 3000)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, start int")
    folder = token_folder(spark)
    write_token_files(docs, folder, tokenizer, block_tokens=500)
    assert spark.read.parquet(f"{folder}/blocks").count() > 5
    plain = Tokenizer.from_file(tokenizer)
    want = sorted(((-1 if i is None else i, (*plain.encode(t or "", add_special_tokens=False).ids, 0)) for i, t in rows), key=str)
    got = sorted(read_token_files(spark, folder).collect(), key=lambda r: r.start)
    assert sorted(((-1 if r.doc_id is None else r.doc_id, tuple(r.ids)) for r in got), key=str) == want
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids)
    at = 0
    for r in got:
        assert r.start == at
        at += len(r.ids)
    digests = {(r.start, r.n_tokens, r.ids_crc32) for r in token_digests(spark, folder).collect()}
    assert digests == {(r.start, len(r.ids), zlib.crc32(array.array("I", r.ids).tobytes())) for r in got}


def test_empty_table(spark, tokenizer):
    folder = token_folder(spark)
    write_token_files(spark.createDataFrame([], "doc_id long, text string"), folder, tokenizer)
    assert token_digests(spark, folder).count() == 0
