"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir), where ``docs`` is what the stage before kept, read back from
Parquet.  All but the last return the columns of ``documents``.  ``run`` applies them to the whole table.

Rows that share an id are documents of their own, told apart by their texts; of rows equal in both, one leaves the
near-dedup stage.  Other columns than those of ``documents`` are left out at the start, so no name clashes.
Each stage reads whole texts, however long, and an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm import language_id
from lumenlog.llm.common import materialize, table
from lumenlog.llm.decontaminate import scan_contamination
from lumenlog.llm.line_dedup import dedup_lines
from lumenlog.llm.near_dedup import near_duplicates
from lumenlog.llm.packing import pack

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Texts that take more bits a byte than this in every learned language are not text in any of them.
MOST_BITS = 6.0


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null or without letters, or that no learned language compresses.

    Rows with a null language teach nothing and are judged like all others; without any language to learn
    from nothing is known, and all go.  Repeated rows are judged alike.
    """
    found = language_id.predict(docs, language_id.learn(docs), into="__language")
    return found.where(f"__language.lang <> 'und' and __language.bits <= {MOST_BITS}").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes later occurrences of three-line windows; a document that loses all its lines goes.

    Null texts stay null.  Among equal windows the one of the smallest (id, hash of the text, line) stays, a null id
    first; rows equal in id and text come out alike.
    """
    found = dedup_lines(docs, into="__dedup").where("__dedup.n_removed = 0 or __dedup.n_removed < __dedup.n_lines")
    text = F.col("__dedup.text")
    return found.select("doc_id", text.alias("text"), "lang", "source", F.char_length(text).cast("bigint").alias("n_chars"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest (id, hash of the text), and all that have none.

    Of rows equal in id and text one stays.  Null and wordless texts, and rows without an id, have no near copies.
    """
    found = materialize(near_duplicates(docs).select("doc_id", "text_hash", "first"), "judged")
    others = found.where("not first").select("doc_id", "text_hash").distinct()
    kept = docs.withColumn("text_hash", F.xxhash64("text")).join(others, ["doc_id", "text_hash"], "left_anti")
    again = found.where("doc_id is not null").groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id", "text_hash")
    if again.head(1):
        one = kept.join(again, ["doc_id", "text_hash"], "left_semi").dropDuplicates(["doc_id", "text_hash"])
        kept = kept.join(again, ["doc_id", "text_hash"], "left_anti").unionByName(one)
    return kept.select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs.  Null texts hold none; repeated rows are judged alike."""
    found = scan_contamination(docs, table(spark, sf_dir, "benchmark"), into="__hits")
    return found.where("__hits.n_hit = 0").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of all documents into sequences of 2048.  A null text is one end token; repeated rows are packed each."""
    from public_tokenizers import path

    return pack(docs, path("word_bpe_49k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL expresses neither the language model nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(COLUMNS)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
