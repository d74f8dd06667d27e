"""Log files as tables of lines, and what is written back."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.assembly import events as assembled_events
from ..operators.assembly import number_lines
from ..storage import store

EXTENSIONS = (".log", ".gz", ".txt", ".out")
#: Roots that are never read, nor anything below them.
BLOCKED = ("/etc", "/private/etc", "/var/run", "/proc", "/sys", "/dev")
#: Bytes of a file that a task holds at a time.
PIECE = 1 << 20
REPORT = "path string, bytes long, readable boolean, inflated long, offset long, reason string"
SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def bare_path(path: Column) -> Column:
    """The path without its scheme and authority."""
    return F.regexp_replace(path, SCHEME, "")


def path_allowed(path: Column, extensions: Sequence[str] = EXTENSIONS, blocked: Sequence[str] = BLOCKED) -> Column:
    """Whether a path has an allowed extension and is no blocked root, nor below one."""
    own = bare_path(path)
    ok = F.lower(path).rlike(r"(" + "|".join(x.replace(".", r"\.") for x in extensions) + r")$")
    for root in blocked:
        ok = ok & (own != root.rstrip("/")) & ~own.startswith(root.rstrip("/") + "/")
    return ok


def file_manifest(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, bytes, file_ord) of the files at and below ``paths``; missing and hidden ones are left out, and so are those without a byte.

    Spark's own listing, which takes many folders in parallel; no file is opened.
    """
    there = [p for p in paths if something_at(spark, p)]
    if not there:
        return spark.createDataFrame([], "file string, bytes long, file_ord long")
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true")
    return with_file_order(reader.load(there).select(F.col("path").alias("file"), F.col("length").alias("bytes")), paths)


def something_at(spark: SparkSession, path: str) -> bool:
    """Whether something matches one of the paths that were given."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return len(at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(at) or []) > 0


def opened(path: str):
    """The bytes of a file, as a stream: mounted ones as they are, others by Arrow's file systems."""
    own = re.sub(r"^file:/+", "/", path)
    if not re.match(SCHEME, own):
        return open(own, "rb")
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path)
    return system.open_input_stream(name, compression=None)


def inflate(stream) -> tuple[bool, int, int | None, str | None]:
    """(readable, inflated, offset, reason) of a gzip stream of one or more members, read ``PIECE`` bytes at a time.

    ``inflated`` counts the bytes that come out before the end or the break, ``offset`` says where in the file it breaks.
    """
    at, inflated, member, fresh = 0, 0, zlib.decompressobj(31), True
    while piece := stream.read(PIECE):
        while piece:
            try:
                inflated += len(member.decompress(piece, PIECE))
            except zlib.error as error:
                return False, inflated, at, "not gzip" if fresh and not inflated else str(error)
            left = member.unused_data if member.eof else member.unconsumed_tail
            at, fresh = at + len(piece) - len(left), False
            if member.eof:
                left = left.lstrip(b"\0")  # padding between and after members
                member, fresh = zlib.decompressobj(31), True
            piece = left
        while not member.eof and (more := member.decompress(b"", PIECE)):
            inflated += len(more)
    return (True, inflated, None, None) if fresh else (False, inflated, at, "truncated")


def inspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes) of gzip names to what their streams hold."""
    for batch in batches:
        rows = []
        for path, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            try:
                with opened(path) as stream:
                    rows.append((path, size, *inflate(stream)))
            except (OSError, pa.ArrowException) as error:
                rows.append((path, size, False, 0, 0, str(error)))
        kinds = (pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in REPORT.split(", ")])


def not_gzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of gzip names those without gzip's first two bytes."""
    for batch in batches:
        found = []
        for path in batch.column(0).to_pylist():
            try:
                with opened(path) as stream:
                    found += [path] * (stream.read(2) != b"\x1f\x8b")
            except (OSError, pa.ArrowException):
                pass  # the reader meets it too
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["file"])


def plain_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of files that are read as text whatever their names say, ``PIECE`` bytes at a time."""
    for batch in batches:
        for path in batch.column(0).to_pylist():
            with opened(path) as stream:
                pos, held = 0, b""
                while True:
                    piece = stream.read(PIECE)
                    text = held + piece
                    if piece and text.endswith(b"\r"):  # perhaps half of a line end
                        text, held = text[:-1], b"\r"
                    else:
                        held = b""
                    lines = re.split(rb"\r\n|\r|\n", text)
                    if piece:
                        held = lines.pop() + held
                    elif not lines[-1]:
                        lines.pop()
                    own = pa.array([x.decode("utf-8", "ignore") for x in lines], pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(own), pa.string()), pa.array([0] * len(own), pa.int64()), pa.array(range(pos, pos + len(own)), pa.int64()), own], ["file", "block", "pos", "line"])
                    pos += len(own)
                    if not piece:
                        break


def by_executors(files: DataFrame) -> DataFrame:
    """Files dealt to tasks: opening them is work, however few bytes their rows have."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file")


def read_lines(spark: SparkSession, paths: Sequence[str], *, blocked: Sequence[str] = BLOCKED, skip_corrupt: bool = True) -> DataFrame:
    """(file, block, pos, line) of text and gzip files at and below ``paths``.  A block is one split of a file, so a big plain
    file is many; a gzip file is read by one task.

    Bad bytes are dropped and missing paths skipped.  A file that is named as gzip and is none is read as text, piece by
    piece.  With ``skip_corrupt`` a broken gzip file gives the lines before the break, and ``ingest_report`` says where it is.
    """
    manifest = file_manifest(spark, paths).where(path_allowed(F.col("file"), blocked=blocked))
    there = [p for p in paths if something_at(spark, p)]
    if not there:
        return spark.createDataFrame([], "file string, block long, pos long, line string")
    meta = F.col("_metadata")
    clean = lambda x: F.replace(F.make_valid_utf8(x), F.lit("\ufffd"), F.lit(""))
    reader = spark.read.option("ignoreMissingFiles", "true").option("ignoreCorruptFiles", str(skip_corrupt).lower()).option("recursiveFileLookup", "true")
    lines = reader.text(there).select(
        meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("pos"), clean(F.col("value")).alias("line")
    )
    zipped = manifest.where(F.lower("file").endswith(".gz")).select("file")
    if zipped.head(1):
        odd = store(by_executors(zipped).mapInArrow(not_gzip, "file string"), "misnamed")
        if odd.head(1):
            whole = by_executors(odd).mapInArrow(plain_lines, "file string, block long, pos long, line string")
            name = bare_path(F.col("file"))
            lines = lines.withColumn("bare", name).join(odd.select(name.alias("bare")), "bare", "left_anti").drop("bare").unionByName(whole)
    return lines.where(path_allowed(F.col("file"), blocked=blocked))


def read_numbered(spark: SparkSession, paths: Sequence[str], **more) -> DataFrame:
    return number_lines(read_lines(spark, paths, **more))


def with_file_order(lines: DataFrame, paths: Sequence[str]) -> DataFrame:
    """Adds ``file_ord``, the place among the given paths of the first that is a file's own or a folder above it."""
    own = bare_path(F.col("file"))
    place = F.lit(None).cast("long")
    for i, path in reversed(list(enumerate(paths))):
        root = re.sub(SCHEME, "", path).rstrip("/")
        place = F.when((own == root) | own.startswith(root + "/"), F.lit(i).cast("long")).otherwise(place)
    return lines.withColumn("file_ord", place)


def ordered_events(events: DataFrame, manifest: DataFrame) -> DataFrame:
    """Events with the place of their files among the paths that were given, which then comes before all else in their order."""
    name = bare_path(F.col("file"))
    own = manifest.select(name.alias("bare"), "file_ord")
    return events.withColumn("bare", name).join(own, "bare", "left").drop("bare")


def read_events(spark: SparkSession, paths: Sequence[str], **more) -> DataFrame:
    """The typed events of the files at and below ``paths``, in the order in which these are given."""
    return ordered_events(assembled_events(read_lines(spark, paths, **more)), file_manifest(spark, paths))


def ingest_report(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, bytes, readable, inflated, offset, reason): every file found.

    Executors inflate what is named as gzip, whole and piece by piece: one that is no gzip, is damaged or ends too early
    is not readable, and ``offset`` and ``reason`` say where and why.  Of other files nothing is read.
    """
    found = file_manifest(spark, paths).select("file", "bytes")
    zipped = F.lower("file").endswith(".gz")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("inflated", "long"), ("offset", "long"), ("reason", "string"))]
    plain = found.where(~zipped).select(F.col("file").alias("path"), "bytes", F.lit(True).alias("readable"), *none)
    return plain.unionByName(by_executors(found.where(zipped)).mapInArrow(inspected, REPORT))


def write_events(events: DataFrame, path: str) -> None:
    """The events table by day, so later reads prune by date."""
    day = F.coalesce(F.to_date("ts_dt").cast("string"), F.lit("unknown"))
    events.withColumn("event_date", day).repartition("event_date", F.pmod(F.xxhash64("file", "event_seq"), F.lit(32))).write.mode("overwrite").partitionBy("event_date").parquet(path)


def write_json_report(report: DataFrame, path: str) -> None:
    report.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
