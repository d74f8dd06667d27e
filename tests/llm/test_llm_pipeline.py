"""The pipeline's stages on a small corpus: what each drops and keeps."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

PASSAGE = " ".join(f"alpha{k} beta{k} gamma{k}" for k in range(30))
ITEM = "what is the capital of that far country in the north of the old map"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    clean = [(i, f"this is clean text number {i} about matters {i * 7} and {i * 13}\nwith a second line {i}\nand a third one {i}", "en") for i in range(20)]
    near = [(100, PASSAGE, "en"), (101, PASSAGE + " tail", "en"), (102, PASSAGE.upper(), "en")]
    odd = [(200, None, "en"), (201, "12345 !!!", "en"), (202, "", None), (203, "before " + ITEM + " after", "en"), (204, clean[3][1], "en"), (205, clean[4][1] + "\nmore text of its own", "en")]
    same_id = [(300, "an unrelated text about rivers and the boats on them today", "en"), (300, PASSAGE + " end", "en")]
    again = [(301, "this row stands here two times with equal text and id", "en")] * 2
    noise = [(302, "".join(chr(33 + (k * k * 31 + k * 17) % 94) for k in range(400)) + "\u00a9\u2603" * 40, None)]
    long = [(303, " ".join(f"the number {k} of the long text" for k in range(20_000)), "en")]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or ""), "clash") for i, t, x in clean + near + odd + same_id + again + noise + long], "doc_id long, text string, lang string, source string, n_chars long, text_hash string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    out, docs = {}, spark.read.parquet(f"{at}/documents.parquet").select(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, at), name)
        out[name] = docs
    return at, out


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_stages(kept):
    _, out = kept
    clean = set(range(20)) | {300, 301, 303}
    assert ids(out["language_id"]) == clean | {100, 101, 102, 203, 204, 205}  # 302 is no text of a learned language
    assert ids(out["line_dedup"]) == clean | {100, 101, 102, 203, 205}
    assert [sum(r.doc_id == i for r in out["line_dedup"].collect()) for i in (300, 301)] == [2, 2]
    assert [sum(r.doc_id == i for r in out["near_dedup"].collect()) for i in (300, 301)] == [1, 1]
    assert next(r.text for r in out["near_dedup"].collect() if r.doc_id == 300).startswith("an unrelated text")
    assert {r.doc_id: r.text for r in out["line_dedup"].collect()}[205] == "more text of its own"
    assert ids(out["near_dedup"]) == clean | {100, 203, 205}
    assert ids(out["decontamination"]) == clean | {100, 205}
    assert ids(out["packing"]) == clean | {100, 205}
    for name in ("language_id", "line_dedup", "near_dedup", "decontamination"):
        assert out[name].columns == corpus_pipeline.COLUMNS
        assert all(r.n_chars == len(r.text) for r in out[name].collect())


def test_run_equals_the_stages(spark, kept):
    at, out = kept
    key = lambda df: sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, at)) == key(out["packing"])


def test_empty_table(spark, kept, tmp_path):
    at, _ = kept
    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{at}/{name}.parquet").where("false").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
