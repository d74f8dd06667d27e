"""Lines to multi-line events.

A line with a time stamp that is no stack or cause line opens a block.  A blank line after a stack or cause
line closes the block and is dropped.  Blocks before a file's first time stamp are dropped.  All three are
running maxima and sums over the lines of a file in order, so they are windows, and they are associative,
so a big file need not meet in one task: every chunk of a file is summed up by itself, the summaries (one
row a chunk) are combined in order, and each chunk's lines then start from what was carried in.

Lines are dealt by chunk once, before any pattern is tried, and everything up to the blocks keeps that dealing; the
summaries read the same shuffle.  Only the blocks' texts are shuffled once more, as a block may cross chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.time import parse_ts

CHUNK = ("file", "block")
BEFORE = (W.unboundedPreceding, -1)


def number_lines(lines: DataFrame) -> DataFrame:
    """(file, block, pos, line) to (file, block, line_no, line): numbers from 1 in file order."""
    prior = W.partitionBy("file").orderBy("block").rowsBetween(*BEFORE)  # one row a chunk
    chunks = lines.groupBy(*CHUNK).agg(F.count(F.lit(1)).alias("n"))
    chunks = chunks.select(*CHUNK, F.coalesce(F.sum("n").over(prior), F.lit(0)).alias("n_before"))
    own = F.row_number().over(W.partitionBy(*CHUNK).orderBy("pos"))
    out = lines.join(chunks, list(CHUNK))
    return out.withColumn("line_no", (own + F.col("n_before")).cast("long")).drop("pos", "n_before")


def line_cap(lines: DataFrame, most: int) -> DataFrame:
    """The first ``most`` lines of each file."""
    return lines.where(F.col("line_no") <= most)


def order_of(lines: DataFrame) -> list[str]:
    """What sorts the lines of a file: their number, or their chunk and place."""
    return ["line_no"] if "line_no" in lines.columns else ["block", "pos"]


def assign_blocks(lines: DataFrame) -> DataFrame:
    """(file, block, pos or line_no, line) to these with ts, gid and first_gid: ``gid`` counts a file's blocks, ``first_gid`` is the
    first block with a time stamp; dropped lines are gone.

    Of a chunk's past only one bit matters, whether a stack is open, so a chunk is summed up for both: its
    boundaries if none is open, and whether an open one would make one more, at a blank line that comes first.
    """
    line, place = F.col("line"), order_of(lines)[-1]
    order = W.partitionBy(*CHUNK).orderBy(place)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    marked = lines.select(*CHUNK, place, "line").repartition(*CHUNK)
    marked = marked.withColumn("ts", T.extract_ts(line)).withColumn(
        "kind", F.when(T.is_stack_line(line) | T.is_cause_line(line), "k").when(F.col("ts").isNotNull(), "a").when(line.rlike(r"^\s*$"), "b")
    )
    marked = marked.withColumn("last", F.last("kind", ignorenulls=True).over(order.rowsBetween(*BEFORE)))
    blank = F.col("kind") == "b"
    marked = marked.withColumns(
        {
            "close": F.coalesce(blank & (F.col("last") == "k"), F.lit(False)),
            "first": F.coalesce(blank & F.col("last").isNull(), F.lit(False)),
            "open": F.coalesce(F.col("kind") == "a", F.lit(False)),
        }
    )
    marked = marked.withColumns({"own": F.count_if(F.col("open") | F.col("close")).over(upto), "firsts": F.count_if("first").over(upto)})
    chunks = marked.groupBy(*CHUNK).agg(
        F.max_by("kind", F.when(F.col("kind").isNotNull(), F.col(place))).alias("ends"),
        F.max("own").alias("n"),
        F.max("firsts").alias("more"),
        F.min(F.when(F.col("ts").isNotNull(), F.col("own"))).alias("stamped"),
    )
    prior = W.partitionBy("file").orderBy("block").rowsBetween(*BEFORE)  # one row a chunk
    chunks = chunks.withColumn("stack", F.coalesce(F.last("ends", ignorenulls=True).over(prior) == "k", F.lit(False)))
    chunks = chunks.withColumn("more", F.when(F.col("stack"), F.col("more")).otherwise(0))
    chunks = chunks.withColumn("n_before", F.coalesce(F.sum(F.col("n") + F.col("more")).over(prior), F.lit(0)))
    first = F.min(F.col("n_before") + F.col("stamped") + F.col("more")).over(W.partitionBy("file"))
    chunks = chunks.select(*CHUNK, "stack", "n_before", first.alias("first_gid"))
    gid = F.col("own") + F.col("n_before") + F.when(F.col("stack"), F.col("firsts")).otherwise(0)
    joined = marked.join(chunks, list(CHUNK)).where(~(F.col("close") | (F.col("first") & F.col("stack"))))
    return joined.select(*CHUNK, place, "line", "ts", gid.cast("long").alias("gid"), "first_gid")


def drop_preamble(blocks: DataFrame) -> DataFrame:
    """Without the blocks before the first that holds a time stamp; files without any are gone."""
    return blocks.where("gid >= first_gid").drop("first_gid")


def join_blocks(blocks: DataFrame) -> DataFrame:
    """One row per block: (file, event_seq, ts, text)."""
    order = order_of(blocks)
    lines = F.array_sort(F.collect_list(F.struct(*order, "line")))
    return blocks.groupBy("file", F.col("gid").alias("event_seq")).agg(
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.struct(*order))).alias("ts"),
        F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("text"),
    )


def classify(blocks: DataFrame) -> DataFrame:
    """Redacts each block's text first and takes every field from the redacted text."""
    text = F.col("text")
    out = blocks.withColumn("text", T.redact(text))
    return out.select(
        "file",
        "event_seq",
        "ts",
        parse_ts(F.col("ts")).alias("ts_dt"),
        T.level(text).alias("level"),
        T.thread_id(text).alias("thread_id"),
        T.message_code(text).alias("code"),
        T.exception(text).alias("exception"),
        T.root_cause(text).alias("root_cause"),
        T.signal_tags(text).alias("tags"),
        "text",
    )


def events(lines: DataFrame) -> DataFrame:
    """Lines (file, block, pos or line_no, line) to the typed events table."""
    return classify(join_blocks(drop_preamble(assign_blocks(lines))))
