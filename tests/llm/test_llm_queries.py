"""The registered corpus queries: their columns and types, and equality with their SQL."""

import os

import pytest

import __spark_entry__ as entry
from lumenlog.llm import queries as corpus

SF_DIR = os.environ.get("LUMENLOG_TEST_SF", "/root/testdata/sf0.001")
COLUMNS = {
    "op1_decontaminate": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2_language_id": "doc_id bigint, held_out boolean, lang_pred string, score double",
    "op3_url_filter": "page_id bigint, host string, path string, rule string, verdict string",
    "op4_secrets": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6_near_dedup": "doc_id bigint, n_shingles bigint, component_id bigint, kept boolean",
    "op7_quality": "doc_id bigint, held_out boolean, score double, predicted int",
    "op8_best_fit_packing": "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    "op9_nearest_neighbours": "query_id bigint, rank int, vec_id bigint, score double",
    "op10_toxicity": "doc_id bigint, held_out boolean, score double, predicted int",
    "op11_token_files": "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint",
    "op12_centroid_clustering": "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    "op13_hard_negatives": "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint",
}


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return con


def test_all_are_registered():
    assert set(corpus.QUERIES) <= set(entry.queries()) and set(corpus.ORACLES) <= set(corpus.QUERIES)
    assert {int(name[2:].split("_")[0]) for name in corpus.QUERIES} == set(range(1, 14))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables")
    kinds = dict(entry.queries()[name](spark, SF_DIR).dtypes)
    for column in COLUMNS[name].split(", "):
        key, kind = column.split()
        assert kinds[key] == kind, (key, kinds[key])


@pytest.mark.parametrize("name", sorted(corpus.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    ran = duck.execute(entry.oracle_sql()[name])
    columns = sorted(c[0] for c in ran.description)
    assert sorted(df.columns) == columns
    order = [[c[0] for c in ran.description].index(c) for c in columns]
    want = sorted(tuple(str(r[k]) for k in order) for r in ran.fetchall())
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == want and want
