"""Queries over rendered log lines: sources, assembly and classification."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.time import parse_ts, ts_parts
from ..operators import assembly
from ..sources.files import path_allowed
from ..sources.rendered import rendered_lines
from ..storage import new_folder
from . import sql as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines without numbers, as a file source gives them.  Events are dealt to tasks first: a file of many makes far more text."""
    own = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    return rendered_lines(own.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "event_id"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.number_lines(raw_lines(spark, sf_dir))


#: Tables that several queries read, stored once an application and state of their input: (application, folder, state,
#: name) to a path and a schema.
KEPT: dict[tuple, tuple] = {}


def state_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """How many files a table has, and a hash of their names, lengths and times, from Spark's listing; nothing is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    row = found.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(path, length, modificationTime))")).first()
    return tuple(row)


def kept(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """What ``build`` makes of the events table, stored by the first query that asks for it and read by all until the table's
    files change.  So building a query lists these files, and the first one runs the job that stores."""
    key = (spark.sparkContext.applicationId, sf_dir, state_of(spark, f"{sf_dir}/events.parquet"), name)
    if key in KEPT:
        path, schema = KEPT[key]
        try:
            return spark.read.schema(schema).parquet(path)
        except AnalysisException:  # the shared folder was cleared since
            del KEPT[key]
    df = build()
    path = new_folder(spark, name)
    df.write.parquet(path)
    KEPT[key] = path, df.schema
    return spark.read.schema(df.schema).parquet(path)


def assembled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assembly.join_blocks(assembly.drop_preamble(assembly.assign_blocks(raw_lines(spark, sf_dir))))


def text_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events before redaction and classification."""
    return kept(spark, sf_dir, "text-events", lambda: assembled(spark, sf_dir))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept(spark, sf_dir, "events", lambda: assembly.classify(text_events(spark, sf_dir)))


@query(S.WITH_LINES + "SELECT file, line_no, line FROM lines")
def number_lines(spark, sf_dir):
    return lines(spark, sf_dir).select("file", "line_no", "line")


@query(S.WITH_LINES + "SELECT file, line_no, line FROM lines WHERE line_no <= 100")
def line_cap(spark, sf_dir):
    return assembly.line_cap(lines(spark, sf_dir), 100).select("file", "line_no", "line")


@query(
    "SELECT page_id, url FROM (SELECT page_id, url, regexp_replace(url, '[?#].*$', '') AS p FROM pages), LATERAL (SELECT regexp_replace(p, '^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?', '') AS q) "
    "WHERE regexp_matches(lower(p), '(\\.html|\\.txt|\\.log)$') AND q <> '/es' AND NOT starts_with(q, '/es/')"
)
def path_filter(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.where(path_allowed(F.regexp_replace("url", "[?#].*$", ""), (".html", ".txt", ".log"), ("/es/",)))


@query(S.WITH_LINES + f"SELECT file, line_no, {S.extract_ts('line')} AS ts FROM lines")
def extract_ts(spark, sf_dir):
    return lines(spark, sf_dir).select("file", "line_no", T.extract_ts(F.col("line")).alias("ts"))


@query(S.WITH_LINES + f"SELECT file, line_no, {S.matches('line', P.STACK_LINE)} AS is_stack, {S.matches('line', P.CAUSED_BY)} AS is_cause FROM lines")
def stack_lines(spark, sf_dir):
    line = F.col("line")
    return lines(spark, sf_dir).select("file", "line_no", T.is_stack_line(line).alias("is_stack"), T.is_cause_line(line).alias("is_cause"))


@query(S.WITH_BLOCKS + "SELECT file, line_no, gid, ts FROM blocks")
def assign_blocks(spark, sf_dir):
    return assembly.assign_blocks(lines(spark, sf_dir)).select("file", "line_no", "gid", "ts")


@query(S.WITH_BLOCKS + "," + S.KEPT + "SELECT file, gid, count(*) AS n_lines FROM kept GROUP BY ALL")
def drop_preamble(spark, sf_dir):
    own = assembly.drop_preamble(assembly.assign_blocks(raw_lines(spark, sf_dir)))
    return own.groupBy("file", "gid").agg(F.count("*").alias("n_lines"))


@query(S.WITH_BLOCKS + "," + S.KEPT + "," + S.JOINED + "SELECT file, event_seq, ts, raw_text AS text FROM joined")
def assemble_events(spark, sf_dir):
    return assembled(spark, sf_dir)


@query(S.WITH_EVENTS + "SELECT file, event_seq, ts, ts_dt, level, thread_id, code, exception, root_cause, array_to_string(tags, ',') AS tags, text FROM ev")
def events_table(spark, sf_dir):
    return events(spark, sf_dir).withColumn("tags", F.array_join("tags", ","))


def _classified(name: str, column, expression: str):
    """One query per extracted column, each over the redacted text."""

    def run(spark, sf_dir):
        text = T.redact(F.col("text"))
        return text_events(spark, sf_dir).select("file", "event_seq", text.alias("text")).select("file", "event_seq", column(F.col("text")).alias("value"))

    run.__name__ = name
    query(S.WITH_BLOCKS + "," + S.KEPT + "," + S.JOINED + f"SELECT file, event_seq, {expression} AS value FROM redacted")(run)


def _joined(column):
    return lambda text: F.array_join(column(text), "\n")


_stack_line = f"({S.matches('x', P.STACK_LINE)} OR {S.matches('x', P.CAUSED_BY)})"
_classified("classify_level", T.level, S.level("text"))
_classified("classify_thread", T.thread_id, S.found("text", P.THREAD))
_classified("classify_code", T.message_code, S.found("text", P.CODE))
_classified("classify_exception", T.exception, S.found("text", P.EXCEPTION))
_classified("root_cause", T.root_cause, S.root_cause("text"))
_classified("signal_tags", lambda t: F.array_join(T.signal_tags(t), ","), f"array_to_string({S.tags('text')}, ',')")
_classified("redact", lambda t: t, "text")
_classified("hung_thread_name", T.hung_thread_name, "coalesce(" + ", ".join(S.found("text", P.HUNG_NAME, i) for i in (1, 2, 3, 4)) + ")")
_classified(
    "stack_sample",
    _joined(T.stack_sample),
    f"array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda x: {_stack_line})[1:5], lambda x: trim(x, ' ' || chr(9))), chr(10))",
)
_classified("sample_text", lambda t: T.sample_text(t, 60), "substring(text, 1, 60)")
_classified(
    "truncate_lines",
    lambda t: T.truncate_lines(t, 3),
    "CASE WHEN len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) <= 3 THEN text ELSE "
    "array_to_string(string_split(regexp_replace(text, '\\n$', ''), chr(10))[1:3], chr(10)) || chr(10) || '...[truncated]...' END",
)
_classified("short_exception", lambda t: T.short_exception(T.exception(t)), f"regexp_extract({S.found('text', P.EXCEPTION)}, '[^.]*$', 0)")
_classified("code_prefix", lambda t: T.code_prefix(T.message_code(t)), f"nullif(regexp_extract({S.found('text', P.CODE)}, '^[A-Z]+', 0), '')")
_classified(
    "sanitize_text",
    T.sanitize,
    f"replace(replace(replace(regexp_replace(text, {S.lit(P.DELIMITER_TAGS)}, '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')",
)
_classified(
    "event_label",
    lambda t: T.event_label(T.level(t), T.message_code(t), T.exception(t)),
    f"trim(coalesce({S.level('text')}, '') || ' ' || coalesce({S.found('text', P.CODE)}, '') || ' ' || coalesce(regexp_extract({S.found('text', P.EXCEPTION)}, '[^.]*$', 0), ''))",
)


@query(S.WITH_EVENTS + "SELECT file, event_seq, ts_dt FROM ev")
def parse_time(spark, sf_dir):
    return text_events(spark, sf_dir).select("file", "event_seq", parse_ts(F.col("ts")).alias("ts_dt"))


@query(
    S.WITH_EVENTS + "SELECT file, event_seq, CASE WHEN contains(ts, 'T') THEN split_part(ts, 'T', 1) ELSE split_part(ts, ' ', 1) END AS date_part, "
    "CAST(regexp_extract(ts, '(\\d{2}):(\\d{2})', 1) AS INT) AS hour, CAST(regexp_extract(ts, '(\\d{2}):(\\d{2})', 2) AS INT) AS minute FROM ev WHERE ts IS NOT NULL"
)
def time_parts(spark, sf_dir):
    date, hour, minute = ts_parts(F.col("ts"))
    return text_events(spark, sf_dir).where("ts is not null").select("file", "event_seq", date.alias("date_part"), hour.alias("hour"), minute.alias("minute"))
