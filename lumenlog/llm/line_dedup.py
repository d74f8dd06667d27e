"""Line dedup by overlapping windows of three lines, in DataFrame expressions only.

A text is cut at newlines; trailing blanks and carriage returns do not count in comparisons.  Every three
consecutive lines that are not all blank make a window, known by a 128-bit hash.  Of the windows that are
equal anywhere in the corpus the first, by (doc_id, hash of the text, line), stays; the lines of every later one
are covered and go.  A removed line always has an earlier equal line, so the first copy of every line stays.

How it scales: the one wide step is ``min((doc_id, text, line))`` by window hash, which combines on the map side,
so a passage that a third of all documents share reaches the reducer as one row per map task.  The owners go
back to their documents by id and text, not by window, so neither a common window nor a common id is a hot key.

Defined results: null texts stay null and have no lines; texts of fewer than three lines stay whole; rows
that share an id are documents of their own, in the order of a hash of their texts, and a null id is an id too,
before all others; rows equal in id and text are one document and come out alike; very long texts are read
whole; other columns pass through untouched, but a column named as ``into`` is replaced, and names that start
with ``__ld_`` are the operator's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3


def bare(line):
    """The line without blanks, tabs and carriage returns at its end."""
    return F.rtrim(line, F.lit(" \t\r"))


def line_hashes(text: str):
    """An array of (h, g) per line: two independent 64-bit hashes of the line without trailing blanks."""
    return F.transform(
        F.split(F.col(text), "\n", -1),
        lambda x: F.struct(
            F.xxhash64(bare(x)).alias("h"),
            F.xxhash64(F.lit("second"), bare(x)).alias("g"),
            (bare(x) == "").alias("blank"),
        ),
    )


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", into: str = "line_dedup") -> DataFrame:
    """``docs`` with a struct column ``into``: n_lines, n_removed, and the text that is left (null if it was null)."""
    windows = (
        docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("t"), line_hashes(text).alias("l"))
        .where(F.size("l") >= WINDOW)
        .select("d", "t", "l", F.explode(F.sequence(F.lit(0), F.size("l") - WINDOW)).alias("p"))
        .select("d", "t", "p", *(F.get("l", F.col("p") + i).alias(f"l{i}") for i in range(WINDOW)))
        .where(~(F.col("l0.blank") & F.col("l1.blank") & F.col("l2.blank")))
        .select(
            "d",
            "t",
            "p",
            F.xxhash64("l0.h", "l1.h", "l2.h").alias("h"),
            F.xxhash64("l0.g", "l1.g", "l2.g").alias("g"),
        )
    )
    owners = (
        windows.groupBy("h", "g")
        .agg(F.min(F.struct("d", "t", "p")).alias("first"))
        .groupBy(F.col("first.d").alias("__ld_id"), F.col("first.t").alias("__ld_text"))
        .agg(F.collect_list("first.p").alias("__ld_first"))
    )
    lines = F.split(F.col(text), "\n", -1)
    blank = F.transform(lines, lambda x: bare(x) == "")
    starts = F.filter(
        F.sequence(F.lit(0), F.size("__ld_lines") - WINDOW),
        lambda p: ~(F.get("__ld_blank", p) & F.get("__ld_blank", p + 1) & F.get("__ld_blank", p + 2)),
    )
    later = F.array_except(starts, F.coalesce(F.col("__ld_first"), F.array().cast("array<int>")))
    covered = F.array_distinct(F.flatten(F.transform(later, lambda p: F.array(p, p + 1, p + 2))))
    same = F.col(doc_id).eqNullSafe(F.col("__ld_id")) & (F.xxhash64(F.col(text)) == F.col("__ld_text"))
    out = docs.join(owners, same, "left").drop("__ld_id", "__ld_text")
    out = out.withColumns({"__ld_lines": lines, "__ld_blank": blank})
    # a document that owns a window at every line has nothing to lose: no need to look at its lines
    changed = F.coalesce(F.size("__ld_first"), F.lit(0)) < F.size("__ld_lines") - (WINDOW - 1)
    out = out.withColumn("__ld_cut", F.when(changed, covered).otherwise(F.array().cast("array<int>")))
    left = F.when(F.size("__ld_cut") == 0, F.col(text)).otherwise(
        F.array_join(
            F.transform(
                F.array_except(F.sequence(F.lit(0), F.size("__ld_lines") - 1), F.col("__ld_cut")),
                lambda i: F.get("__ld_lines", i),
            ),
            "\n",
        )
    )
    return out.withColumn(
        into,
        F.struct(
            F.coalesce(F.size("__ld_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
            F.when(F.col(text).isNull(), 0).otherwise(F.size("__ld_cut")).cast("bigint").alias("n_removed"),
            left.alias("text"),
        ),
    ).drop("__ld_first", "__ld_lines", "__ld_blank", "__ld_cut")
