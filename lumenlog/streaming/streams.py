"""Streams of log lines.

The line source reads whole new files of a folder (rotated segments); ``tail`` follows appends.  State is kept by file in a
RocksDB store, which the stateful functions here choose for the session: the last lines of a file, or its one block that
is still open and what came too early.

Sinks write each batch below its own number, so a batch that is run again replaces what it wrote, and ``latest_versions``
reads what the newest batch says of each key: nothing that is written is written again.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import patterns as P
from ..functions import text as T
from ..functions.time import parse_ts
from ..operators.assembly import classify

BLOCK = "file string, event_seq long, ts string, text string"
#: Blocks that a task hands on at a time.
BLOCKS_OUT = 10_000
#: Lines of a segment that follow each other, with what is known of each; ``ends`` says that the last one ends the segment.
RUN = "seg long, pos long, ends boolean, lines array<string>, ts array<string>, kinds array<string>"
LAST = "file string, seg long, pos long, line string"
STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Spark lists folders and files by a task each, up to 10,000; with fewer tasks each takes many.
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "256"


def stream_lines(spark: SparkSession, folder: str, *, files_per_trigger: int | None = None, name: str = r"([^/]+?)(?:\.(\d+))?\.(?:log|txt|out)(?:\.gz)?$") -> DataFrame:
    """(file, seg, pos, line, ends) of rotated segments such as ``a.1.log``; ``name`` finds file and number in a path, and
    ``ends`` marks a segment's last line.

    A stream has no row numbers, so a segment is read whole, to know its lines' places; its size is what the
    rotation allows.  Segments are many small files, so the session's tasks that list them are made fewer.
    """
    spark.conf.set(*LISTING)
    reader = spark.readStream.schema("value string").option("wholetext", "true").option("recursiveFileLookup", "true")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = F.col("_metadata.file_path")
    lines = F.split(F.regexp_replace("value", r"(\r\n|\r|\n)\z", ""), r"\r\n|\r|\n", -1)
    cut = reader.format("text").load(folder).select(
        F.regexp_extract(path, name, 1).alias("file"), F.coalesce(F.regexp_extract(path, name, 2).try_cast("long"), F.lit(0)).alias("seg"), lines.alias("lines")
    )
    return cut.select("file", "seg", F.size("lines").alias("n"), F.posexplode("lines").alias("pos", "line")).select("file", "seg", "pos", "line", (F.col("pos") == F.col("n") - 1).alias("ends"))


def versions_writer(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: an upsert sink, of which ``latest_versions`` reads the newest rows of each key."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def latest_versions(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The rows that the newest batch to say something of their key wrote; keys may be null."""
    rows = spark.read.parquet(path)
    newest = F.max("batch").over(W.partitionBy(*keys))
    return rows.withColumn("newest", newest).where("batch = newest").drop("batch", "newest")


class LastLines(StatefulProcessor):
    """The last lines of a file that are not blank, in a list of bounded length."""

    def __init__(self, most: int):
        self.most = most

    def init(self, handle) -> None:
        self.held = handle.getListState("held", "seg long, pos long, line string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        before = held = [tuple(x) for x in self.held.get()]
        for frame in rows:
            held = sorted({*held, *((int(s), int(p), x) for s, p, x in zip(frame["seg"], frame["pos"], frame["line"], strict=True) if x and x.strip())})[-self.most :]
        if held != before:
            self.held.put(held)
            yield pd.DataFrame([(key[0], *x) for x in held], columns=["file", "seg", "pos", "line"])

    def close(self) -> None:
        pass


def stream_last_lines(lines: DataFrame, most: int = 300) -> DataFrame:
    """(file, seg, pos, line): of each file that has new lines its last ``most`` ones, in update mode.

    Lines may come in any order, and again.  Read what ``versions_writer`` keeps of it by ``file``.
    """
    lines.sparkSession.conf.set(*STORE)
    return lines.groupBy("file").transformWithStateInPandas(LastLines(most), LAST, "update", "none")


def marks(lines: Iterable[str | None]) -> Iterator[tuple[str | None, str | None]]:
    """The time stamp and kind of each line, as ``marked_lines`` finds them in tables."""
    stamps = [re.compile(P.TS_CLASSIC, re.A), re.compile(P.TS_ISO, re.A)]
    stack_line, cause_line = re.compile(P.STACK_LINE, re.A), re.compile(P.CAUSED_BY, re.A)
    for line in lines:
        if line is None:
            yield None, None
            continue
        stamp = next((m[1] for m in (p.search(line) for p in stamps) if m), None)
        yield stamp, "k" if stack_line.match(line) or cause_line.match(line) else None if line.strip() else "b"


def marked_lines(lines: DataFrame) -> DataFrame:
    """Adds ``ts``, the time stamp of a line, and ``kind``: k of stack and cause lines, b of blank ones."""
    line = F.col("line")
    kind = F.when(T.is_stack_line(line) | T.is_cause_line(line), "k").when(line.rlike(r"^\s*$"), "b")
    return lines.withColumns({"ts": T.extract_ts(line), "kind": kind})


def runs_of_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, seg, pos, ends, line, ts, kind) to one row for lines that follow each other here, so what goes on are few rows."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        file, seg, pos, ends, *fields = batch.columns
        ends = ends.fill_null(False)
        code, s, p = (x.to_numpy(zero_copy_only=False) for x in (file.dictionary_encode().indices.fill_null(-1), seg, pos))
        opens = np.ones(n, bool)
        opens[1:] = (code[1:] != code[:-1]) | (s[1:] != s[:-1]) | (p[1:] != p[:-1] + 1) | ends.to_numpy(zero_copy_only=False)[:-1]
        bounds = np.append(np.flatnonzero(opens), n).astype(np.int32)
        first, last = pa.array(bounds[:-1]), pa.array(bounds[1:] - 1)
        lists = [pa.ListArray.from_arrays(pa.array(bounds), x) for x in fields]
        yield pa.RecordBatch.from_arrays([file.take(first), seg.take(first), pos.take(first), ends.take(last), *lists], ["file", *(x.split()[0] for x in RUN.split(", "))])


def fold_lines(file: str, lines: Iterable[str | None], state: tuple | None, marked: Iterable[tuple] | None = None) -> tuple[list[tuple], tuple]:
    """Closed blocks of a file's next lines, and what stays open: (seq, seen, stack, ts, lines).  None closes the open block."""
    seq, seen, stack, ts, held = state or (0, False, False, None, [])
    held, out = list(held), []

    def close() -> None:
        nonlocal seq, stack, ts, held
        if held and seen:
            out.append((file, seq, ts, "\n".join(held)))
            seq += 1
        stack, ts, held = False, None, []

    for line, (stamp, kind) in zip(lines, marks(lines) if marked is None else marked, strict=True):
        if line is None:
            close()
            continue
        if stamp and kind != "k":
            close()
        if stamp:
            seen, ts = True, ts or stamp
        if stack and kind == "b":
            close()
            continue
        held.append(line)
        stack = stack or kind == "k"
    return out, (seq, seen, stack, ts, held)


class Assembly(StatefulProcessor):
    """Folds a file's runs of lines, in the order of their segments, into blocks.

    Runs whose turn has not come wait in the state, each under its own key, so a task holds one of them at a time.  With
    ``timeout_ms`` a timer closes the open block of a file that stays silent; a row without a line closes it at once.
    """

    def __init__(self, first: int | None, timeout_ms: int | None):
        self.first, self.timeout_ms = first, timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "seg long, pos long, seq long, seen boolean, stack boolean, ts string")
        self.lines = handle.getListState("lines", "line string")
        self.early = handle.getMapState("runs", "seg long, pos long, n long", "ends boolean, lines array<string>, ts array<string>, kinds array<string>")

    def folded(self) -> tuple:
        """Whose turn it is, and the open block."""
        seg, pos, *block = self.place.get() if self.place.exists() else (self.first, 0, 0, False, False, None)
        return seg, pos, (*block, [x[0] for x in self.lines.get()])

    def hold(self, seg: int | None, pos: int, block: tuple) -> None:
        *fields, lines = block
        self.place.update((seg, pos, *fields))
        self.lines.put([(x,) for x in lines]) if lines else self.lines.clear()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seg, pos, block = self.folded()
        early = [tuple(int(x) for x in k) for k in self.early.keys()]
        known, out = set(early), []
        heapq.heapify(early)

        def fold(s: int, p: int, ends: bool, lines: list, ts: list, kinds: list) -> None:
            nonlocal seg, pos, block
            k = pos - p if s == seg else len(lines)  # what is smaller came again
            if k < len(lines):
                found, block = fold_lines(key[0], lines[k:], block, zip(ts[k:], kinds[k:], strict=True))
                out.extend(found)
                seg, pos = (seg + 1, 0) if ends else (seg, p + len(lines))

        def waiting() -> Iterator[None]:
            while early and early[0][:2] <= (seg, pos):
                s, p, n = at = heapq.heappop(early)
                known.remove(at)
                ends, *run = self.early.getValue(at)
                self.early.removeKey(at)
                fold(s, p, ends, *run)
                yield

        def frames(most: int) -> Iterator[pd.DataFrame]:
            if len(out) >= most:
                yield pd.DataFrame(out, columns=["file", "event_seq", "ts", "text"])
                out.clear()

        for f in rows:
            for s, p, ends, *run in zip(*(f[c] for c in ("seg", "pos", "ends", "lines", "ts", "kinds")), strict=True):
                s, p, ends, run = int(s), int(p), bool(ends), [list(x) for x in run]
                if seg is not None and (s, p) <= (seg, pos):
                    fold(s, p, ends, *run)
                    for _ in waiting():
                        yield from frames(BLOCKS_OUT)
                elif (at := (s, p, len(run[0]))) not in known:
                    self.early.updateValue(at, (ends, *run))
                    heapq.heappush(early, at)
                    known.add(at)
                yield from frames(BLOCKS_OUT)
        if seg is None and early:
            seg = early[0][0]
        for _ in waiting():
            yield from frames(BLOCKS_OUT)
        self.hold(seg, pos, block)
        if self.timeout_ms:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.timeout_ms)
        yield pd.DataFrame(out, columns=["file", "event_seq", "ts", "text"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        seg, pos, block = self.folded()
        out, block = fold_lines(key[0], [None], block, [(None, None)])
        self.hold(seg, pos, block)
        yield pd.DataFrame(out, columns=["file", "event_seq", "ts", "text"])

    def close(self) -> None:
        pass


def stream_events(lines: DataFrame, *, first: int | None = None, timeout_ms: int | None = None) -> DataFrame:
    """The typed events of a stream of lines (file, seg, pos, line, ends), in append mode.

    Segments of a file are numbered without gaps from ``first`` on (by default from the least number of the file's first
    batch) and may come in any order; places count from 0 in each.  A block is emitted when the next one opens, at a row
    without a line, and with ``timeout_ms`` also when its file stays silent that long.

    Patterns run where the lines are read, and on blocks that are dealt anew: only the folding goes file by file, over rows
    that hold as many lines as came together.
    """
    lines.sparkSession.conf.set(*STORE)
    mode = "processingTime" if timeout_ms else "none"
    place = [F.col(c).cast("long") for c in ("seg", "pos")]
    runs = marked_lines(lines).select("file", *place, "ends", "line", "ts", "kind").mapInArrow(runs_of_lines, "file string, " + RUN)
    blocks = runs.groupBy("file").transformWithStateInPandas(Assembly(first, timeout_ms), BLOCK, "append", mode)
    return classify(blocks.repartition("file", "event_seq"))


def stamped(lines: DataFrame, delay: str) -> DataFrame:
    """Lines with a parsed time stamp, under a watermark."""
    at = parse_ts(T.extract_ts(F.col("line"))).cast("timestamp")
    return lines.withColumn("at", at).where("at is not null").withWatermark("at", delay)


def stream_histogram(lines: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, total, errors) of time-stamped lines by window; rows later than the watermark drop."""
    error = T.is_error(T.level(F.col("line")))
    out = stamped(lines, delay).groupBy(F.window("at", width).alias("w")).agg(F.count(F.lit(1)).alias("total"), F.count_if(error).alias("errors"))
    return out.select(F.col("w.start").alias("start"), "total", "errors")


def stream_counts(lines: DataFrame, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """(start, thread_id, errors, hung) by window and thread."""
    line = F.col("line")
    out = stamped(lines, delay).groupBy(F.window("at", width).alias("w"), T.thread_id(line).alias("thread_id")).agg(
        F.count_if(T.is_error(T.level(line))).alias("errors"), F.count_if(T.is_hung(line)).alias("hung")
    )
    return out.select(F.col("w.start").alias("start"), "thread_id", "errors", "hung")


def error_bursts(lines: DataFrame, gap: int = 600, delay: str = "10 minutes") -> DataFrame:
    """(file, start, end, cnt): errors of a file with no pause longer than ``gap`` seconds, as session windows, which grow
    together when a late error falls between them.  Time stamps have milliseconds."""
    errors = stamped(lines.where(T.is_error(T.level(F.col("line")))), delay)
    out = errors.groupBy("file", F.session_window("at", f"{1000 * gap + 1} milliseconds").alias("w"))
    return out.agg(F.min("at").alias("start"), F.max("at").alias("end"), F.count(F.lit(1)).alias("cnt")).drop("w")


def histogram_writer(path: str, width: int, delay: int) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` over lines: each batch's rows by window of ``width`` seconds, on time or late.

    A row is late if its window had ended ``delay`` seconds before the greatest time stamp of all batches before.  What a
    batch writes stands below its number and is added up by ``counted_histogram``, so no row is lost: late ones count as such.
    """

    def keep(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        at = F.unix_micros(parse_ts(T.extract_ts(F.col("line"))).cast("timestamp"))
        start = F.floor(F.col("at") / (width * 1_000_000)).cast("long") * width
        rows = batch.select(at.alias("at"), T.is_error(T.level(F.col("line"))).alias("error")).where("at is not null").select("at", "error", start.alias("start"))
        seen = None
        if number > 0:
            seen = spark.read.schema("batch long, seen long").parquet(path).where(F.col("batch") < number).agg(F.max("seen")).first()[0]
        late = F.lit(False) if seen is None else (F.col("start") + width + delay) * 1_000_000 <= seen
        out = rows.groupBy("start", late.alias("late")).agg(F.count(F.lit(1)).alias("total"), F.count_if("error").alias("errors"), F.max("at").alias("seen"))
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return keep


def counted_histogram(spark: SparkSession, path: str) -> DataFrame:
    """(start, total, errors, late) by window: rows and errors that were on time, and rows that were not."""
    rows = spark.read.parquet(path)
    on_time = lambda c: F.sum(F.when(~F.col("late"), F.col(c)).otherwise(0))
    out = rows.groupBy("start").agg(on_time("total").alias("total"), on_time("errors").alias("errors"), F.sum(F.when(F.col("late"), F.col("total")).otherwise(0)).alias("late"))
    return out.withColumn("start", F.timestamp_seconds("start"))
