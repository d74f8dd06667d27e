"""The registered queries of the corpus operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language_id, quality, toxicity
from .ann import nearest_neighbours
from .clustering import cluster_vectors
from .common import fold_of, table
from .decontaminate import scan_contamination
from .hard_negatives import hard_negatives
from .line_dedup import dedup_lines
from .near_dedup import near_duplicates
from .packing import pack
from .secrets import find_secrets, frequent_words
from .token_files import token_digests, token_folder, write_token_files
from .url_filter import LIMIT, RULES, SOFT, STRICT, filter_urls


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan_contamination(docs, table(spark, sf_dir, "benchmark"), into="c")
    return found.select(
        "doc_id",
        "c.n_words",
        "c.n_hit",
        F.size("c.items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("c.items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("c.n_hit") > 0).alias("contaminated"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    model = language_id.learn(docs.where(~held_out))
    found = language_id.predict(docs.select("doc_id", "text"), model, into="p")
    return found.select("doc_id", held_out.alias("held_out"), F.col("p.lang").alias("lang_pred"), "p.score")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, into="f").select("page_id", "f.host", "f.path", "f.rule", "f.verdict")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = F.array_join(F.transform("s.spans", lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return find_secrets(docs, words=frequent_words(docs), into="s").select(
        "doc_id", "s.n_assign", "s.n_access", "s.n_hex", "s.base_sha256", joined.alias("spans")
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, into="r").select(
        "doc_id", "r.n_lines", "r.n_removed", F.sha2(F.col("r.text").cast("binary"), 256).alias("text_sha256")
    )


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    model = quality.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = quality.score(docs, model, into="score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), path("word_bpe_49k.json"))


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False))
    model = toxicity.learn(docs, table(spark, sf_dir, "labels").where(~held_out))
    found = toxicity.score(docs, model, into="score")
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    folder = token_folder(spark)
    write_token_files(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, path("byte_bpe_50k.json"))
    return token_digests(spark, folder)


def op12_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = "if(vec_id % 7 = 0, (label + 1) % 10, label)"
    return hard_negatives(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), label=label)


QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_language_id": op2_language_id,
    "op3_url_filter": op3_url_filter,
    "op4_secrets": op4_secrets,
    "op5_line_dedup": op5_line_dedup,
    "op6_near_dedup": op6_near_dedup,
    "op7_quality": op7_quality,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_toxicity": op10_toxicity,
    "op11_token_files": op11_token_files,
    "op12_centroid_clustering": op12_centroid_clustering,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES = {
    "op1_decontaminate": r"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
spot AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM doc),
cut AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM spot, (SELECT DISTINCT n FROM win) WHERE i + n - 1 <= len(w)),
hit AS (SELECT doc_id, i, n, item_id FROM cut JOIN win USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
    "op5_line_dedup": r"""
WITH doc AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS l FROM documents),
bare AS (SELECT doc_id, list_transform(l, lambda x: rtrim(x, ' ' || chr(9) || chr(13))) AS l FROM doc),
win AS (
  SELECT doc_id, p, l[p] AS a, l[p + 1] AS b, l[p + 2] AS c
  FROM (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS p FROM bare WHERE len(l) >= 3)
  WHERE NOT (l[p] = '' AND l[p + 1] = '' AND l[p + 2] = '')),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS r FROM win),
cut AS (SELECT doc_id, list(DISTINCT q) AS cut FROM (SELECT doc_id, unnest([p, p + 1, p + 2]) AS q FROM ranked WHERE r > 1) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(len(cut), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN cut IS NULL THEN text ELSE array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(cut, i)), lambda i: l[i]), chr(10)) END) AS text_sha256
FROM doc LEFT JOIN cut USING (doc_id)
""",
}


def _url_sql() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    alone = lambda term: f"regexp_matches(u, '(^|[^a-z0-9]){term}([^a-z0-9]|$)')"
    ordered = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fit = [(v, h, p, f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')") for v, h, p in ordered]
    rule = " ".join(f"WHEN {c} THEN '{h}{p}'" for _, h, p, c in fit)
    said = " ".join(f"WHEN {c} THEN '{v}'" for v, _, _, c in fit)
    strict = " OR ".join(map(alone, STRICT))
    soft = " + ".join(f"CASE WHEN {alone(t)} THEN {w} ELSE 0 END" for t, w in SOFT.items())
    return f"""
WITH cut AS (SELECT page_id, {host} AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, {low} AS u FROM pages)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {said} WHEN {strict} OR ({soft}) >= {LIMIT} THEN 'block' ELSE 'allow' END AS verdict
FROM cut
"""


ORACLES["op3_url_filter"] = _url_sql()


def _cluster_sql(clusters: int = 16, rounds: int = 3) -> str:
    finite = "embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)) OR abs(CAST(x AS DOUBLE)) > 2097152)) = 0"
    far = "list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    parts = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings WHERE {finite})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || vec_id) AS h, v FROM kept WHERE vec_id IS NOT NULL ORDER BY h, v LIMIT {clusters}))",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, vec_id, v.v, k, {far} AS d FROM kept v, c{t} c QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1)")
        if t < rounds:
            parts.append(
                f"m{t} AS (SELECT k, i, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{t}) GROUP BY k, i), "
                f"c{t + 1} AS MATERIALIZED (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{t} GROUP BY k UNION ALL SELECT k, v FROM c{t} WHERE k NOT IN (SELECT k FROM a{t}))"
            )
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.k AS INT) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.k = c.k
"""


ORACLES["op12_centroid_clustering"] = _cluster_sql()
ORACLES["op13_hard_negatives"] = """
WITH own AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)) OR abs(CAST(x AS DOUBLE)) > 262144)) = 0),
kept AS MATERIALIZED (SELECT * FROM own WHERE len(v) = (SELECT len(v) FROM own GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
scored AS MATERIALIZED (
  SELECT a.r AS a, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS alike, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS s
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.r <> b.r),
positive AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, vec_id) AS p FROM scored WHERE alike QUALIFY p <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.vec_id) AS INT) AS rank,
       n.vec_id AS negative_id, CAST(p.s AS BIGINT) AS positive_score, CAST(n.s AS BIGINT) AS negative_score
FROM positive p JOIN scored n ON p.a = n.a AND NOT n.alike AND 30 * p.s <= 100 * n.s AND 100 * n.s <= 90 * p.s
QUALIFY rank <= 10
"""
