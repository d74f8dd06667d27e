"""Queries over the analyses, and streams run once over the rendered lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import assembly
from ..operators import recipes as R
from ..operators.summary import incident_window, pick_samples, summary
from ..sources import files
from ..sources.rendered import rendered_lines
from ..storage import new_folder, store
from ..streaming import streams
from . import sql as S
from .events_queries import events, table
from .summary_queries import SCORE

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ERROR = "coalesce(level IN ('ERROR', 'SEVERE', 'FATAL'), false)"
SEC = "(epoch_us(ts_dt) / 1e6)"


def add(name: str, f, oracle: str | None = None) -> None:
    QUERIES[name] = f
    if oracle:
        ORACLES[name] = S.WITH_EVENTS + oracle


_message = "regexp_replace(text, " + S.lit(r"^(?:\[[^\]]*\]\s+[0-9a-f]+|" + P.TS_ISO + r")\s+") + ", '')"
add(
    "noise_candidates",
    lambda s, d: R.noise_candidates(events(s, d), 20).select("code", "cnt", "errors"),
    f", n AS (SELECT code, count(*) AS cnt, count(*) FILTER ({ERROR}) AS errors, count(DISTINCT {_message}) AS texts FROM ev WHERE code IS NOT NULL GROUP BY code) "
    "SELECT code, cnt, errors FROM n WHERE cnt > 20 AND errors = 0 AND texts = 1",
)
add(
    "without_noise",
    lambda s, d: R.without_noise(events(s, d), ["TCPC0001I"], ["SRVE", "CWWK"]).select("file", "event_seq"),
    f"SELECT file, event_seq FROM ev WHERE {ERROR} OR NOT coalesce(code = 'TCPC0001I' OR starts_with(code, 'SRVE') OR starts_with(code, 'CWWK'), false)",
)
add(
    "regular_messages",
    lambda s, d: R.regular_messages(events(s, d)).select("code", "file", "cnt", F.round("gap", 3).alias("gap")),
    f", g AS (SELECT code, file, {SEC} - lag({SEC}) OVER (PARTITION BY file, code ORDER BY ts_dt, event_seq) AS gap FROM ev WHERE ts_dt IS NOT NULL AND code IS NOT NULL) "
    "SELECT code, file, count(gap) AS cnt, round(avg(gap), 3) AS gap FROM g GROUP BY ALL HAVING count(gap) >= 5 AND stddev_pop(gap) <= avg(gap)",
)
add(
    "context_rows",
    lambda s, d: R.context_rows(events(s, d)).select("file", "event_seq"),
    f"SELECT file, event_seq FROM ev WHERE level IN ('INFO', 'AUDIT') AND EXISTS (SELECT 1 FROM ev AS e WHERE e.level IN ('ERROR', 'SEVERE', 'FATAL') AND abs(epoch_us(e.ts_dt) - epoch_us(ev.ts_dt)) <= 300000000)",
)
_own = f"list_filter(string_split(text, chr(10)), lambda x: {S.matches('x', P.STACK_LINE)} AND NOT {S.matches('x', R.FRAMEWORK)})"
add(
    "stack_clusters",
    lambda s, d: R.stack_clusters(events(s, d)),
    f", k AS (SELECT file, event_seq, array_to_string(list_transform({_own}, lambda x: regexp_replace(trim(x, ' ' || chr(9)), ':\\d+\\)$', ')')), chr(10)) AS k FROM ev) "
    "SELECT sha256(k) AS fingerprint, count(*) AS cnt, (min((file, event_seq))).file AS file, (min((file, event_seq))).event_seq AS event_seq FROM (SELECT k, {'file': file, 'event_seq': event_seq} AS o, file, event_seq FROM k) WHERE k <> '' GROUP BY k".replace(
        "(min((file, event_seq))).file", "min(o).file"
    ).replace("(min((file, event_seq))).event_seq", "min(o).event_seq"),
)
add(
    "gaps",
    lambda s, d: R.gaps(events(s, d), 600).select("file", "event_seq", F.round("gap_seconds", 3).alias("gap_seconds")),
    f", g AS (SELECT file, event_seq, {SEC} - lag({SEC}) OVER (PARTITION BY file ORDER BY event_seq) AS gap FROM ev WHERE ts_dt IS NOT NULL) SELECT file, event_seq, round(gap, 3) AS gap_seconds FROM g WHERE gap > 600",
)
add(
    "code_spikes",
    lambda s, d: R.code_spikes(events(s, d), 60, 2),
    f"SELECT CAST(floor({SEC} / 3600) * 3600 AS BIGINT) AS start, code, count(*) AS cnt FROM ev WHERE {ERROR} AND ts_dt IS NOT NULL AND code IS NOT NULL GROUP BY ALL HAVING count(*) >= 2",
)
add(
    "file_code_matrix",
    lambda s, d: R.file_code_matrix(events(s, d), ["SRVE0293E", "WSVR0605W"]),
    "SELECT file, count(*) FILTER (code = 'SRVE0293E') AS SRVE0293E, count(*) FILTER (code = 'WSVR0605W') AS WSVR0605W FROM ev GROUP BY file",
)
add(
    "hourly_anomalies",
    lambda s, d: R.hourly_anomalies(events(s, d)).select("hour", "cnt"),
    f", c AS (SELECT CAST(floor({SEC} / 3600) AS BIGINT) AS hour, count(*) AS cnt FROM ev WHERE ts_dt IS NOT NULL GROUP BY 1), "
    "w AS (SELECT hour, cnt, avg(cnt) OVER r + 2 * stddev_pop(cnt) OVER r AS most FROM c WINDOW r AS (ORDER BY hour RANGE BETWEEN 24 PRECEDING AND 1 PRECEDING)) SELECT hour, cnt FROM w WHERE cnt > most",
)
DEPLOY = "2024-01-02 00:00:00"
LATE = "com.acme.pay.LateError"


def with_late_errors(ev: DataFrame) -> DataFrame:
    """Events of which some after the deploy, without an exception of their own, have one that is not seen before it."""
    late = F.coalesce((F.col("ts_dt") >= F.lit(DEPLOY).cast("timestamp_ntz")) & F.col("exception").isNull() & (F.col("event_seq") % 50 == 0), F.lit(False))
    return ev.withColumn("exception", F.when(late, LATE).otherwise(F.col("exception")))


_late = f", o AS (SELECT * REPLACE (CASE WHEN ts_dt >= timestamp '{DEPLOY}' AND exception IS NULL AND event_seq % 50 = 0 THEN '{LATE}' ELSE exception END AS exception) FROM ev) "
add(
    "regressions",
    lambda s, d: R.regressions(with_late_errors(events(s, d)), DEPLOY),
    _late + f"SELECT exception, count(*) AS cnt FROM o WHERE ts_dt >= timestamp '{DEPLOY}' AND exception IS NOT NULL "
    f"AND exception NOT IN (SELECT exception FROM o WHERE ts_dt < timestamp '{DEPLOY}' AND exception IS NOT NULL) GROUP BY exception",
)
add(
    "shared_top_frames",
    lambda s, d: R.shared_top_frames(events(s, d)),
    f", f AS (SELECT regexp_replace(trim(list_filter(string_split(text, chr(10)), lambda x: {S.matches('x', P.STACK_LINE)})[1], ' ' || chr(9)), '\\([^)]*\\)$', '') AS frame, thread_id FROM ev) "
    "SELECT frame, count(DISTINCT thread_id) AS threads, count(*) AS cnt FROM f WHERE frame IS NOT NULL GROUP BY frame HAVING count(DISTINCT thread_id) >= 2",
)
add(
    "error_bursts",
    lambda s, d: R.error_bursts(events(s, d), 3600),
    f", e AS (SELECT file, event_seq, ts_dt, coalesce(abs({SEC} - lag({SEC}) OVER w) > 3600, true) AS opens FROM ev WHERE {ERROR} AND ts_dt IS NOT NULL WINDOW w AS (PARTITION BY file ORDER BY event_seq)), "
    "b AS (SELECT file, ts_dt, count(*) FILTER (opens) OVER (PARTITION BY file ORDER BY event_seq) AS burst FROM e), "
    'g AS (SELECT file, burst, min(ts_dt) AS start, max(ts_dt) AS "end", count(*) AS cnt FROM b GROUP BY file, burst) '
    "SELECT *, row_number() OVER (PARTITION BY file ORDER BY cnt DESC, burst) = 1 AS largest FROM g",
)
_sum = "SELECT dim, key, count(*) AS cnt FROM (SELECT 'level' AS dim, coalesce(level, 'UNKNOWN') AS key FROM o UNION ALL SELECT 'code', code FROM o WHERE code IS NOT NULL UNION ALL SELECT 'exception', exception FROM o WHERE exception IS NOT NULL UNION ALL SELECT 'tag', unnest(tags) FROM o) GROUP BY ALL"


def summary_diff(s, d):
    own = events(s, d)
    return R.summary_diff(summary(own.where("file < 'node4'"), None), summary(own.where("file >= 'node4'"), None))


add(
    "summary_diff",
    summary_diff,
    f", a AS ({_sum.replace(' FROM o', chr(32) + 'FROM (SELECT * FROM ev WHERE file < ' + chr(39) + 'node4' + chr(39) + ')')}), b AS ({_sum.replace(' FROM o', chr(32) + 'FROM (SELECT * FROM ev WHERE file >= ' + chr(39) + 'node4' + chr(39) + ')')}) "
    "SELECT dim, key, coalesce(a.cnt, 0) AS old_cnt, coalesce(b.cnt, 0) AS new_cnt, coalesce(b.cnt, 0) - coalesce(a.cnt, 0) AS change FROM a FULL JOIN b USING (dim, key)",
)
add(
    "failures_per_minute",
    lambda s, d: R.failures_per_minute(events(s, d), "REDACTED", 1),
    f"SELECT CAST(floor({SEC} / 60) AS BIGINT) AS minute, file, count(*) AS cnt FROM ev WHERE ts_dt IS NOT NULL AND contains(text, 'REDACTED') GROUP BY ALL",
)
RUNS = f"r AS (SELECT *, count(*) FILTER (code = 'ARFM5007I') OVER (PARTITION BY file ORDER BY event_seq) AS run FROM ev)"
add(
    "restarts",
    lambda s, d: R.restarts(events(s, d), "ARFM5007I", "CWWKZ0001I"),
    f", {RUNS}, g AS (SELECT file, run, count(*) AS events, count(*) FILTER ({ERROR}) AS errors, min(event_seq) AS first_seq, "
    f"max(event_seq) FILTER ({ERROR}) > min(event_seq) FILTER (code = 'CWWKZ0001I') AS broken FROM r GROUP BY file, run) "
    "SELECT file, run, events, errors, first_seq, coalesce(lag(coalesce(broken, false)) OVER (PARTITION BY file ORDER BY run), false) AS unexpected FROM g",
)
add(
    "startups",
    lambda s, d: R.startups(events(s, d), "ARFM5007I", "CWWKZ0001I", 600).withColumn("seconds", F.round("seconds", 3)),
    f", {RUNS}, g AS (SELECT file, run, arg_min(ts_dt, event_seq) FILTER (code = 'ARFM5007I') AS start, arg_min(ts_dt, event_seq) FILTER (code = 'CWWKZ0001I') AS ready FROM r WHERE run > 0 GROUP BY file, run) "
    "SELECT file, run, start, ready, round((epoch_us(ready) - epoch_us(start)) / 1e6, 3) AS seconds, coalesce((epoch_us(ready) - epoch_us(start)) / 1e6 > 600, false) AS slow FROM g",
)
add(
    "hourly_hung",
    lambda s, d: R.hourly_hung(events(s, d)),
    f"SELECT CAST(floor({SEC} / 3600) * 3600 AS BIGINT) AS hour, count(*) AS hung FROM ev WHERE ts_dt IS NOT NULL AND list_contains(tags, 'HungThreads') GROUP BY 1",
)
add(
    "pool_errors",
    lambda s, d: R.pool_errors(events(s, d)),
    f"SELECT CAST(floor({SEC} / 600) * 600 AS BIGINT) AS start, count(*) AS pool FROM ev WHERE ts_dt IS NOT NULL AND list_contains(tags, 'DB/Pool') GROUP BY 1",
)
add(
    "error_rates",
    lambda s, d: R.error_rates(events(s, d), DEPLOY).select("events_before", "errors_before", "events_after", "errors_after", *(F.round(c, 6).alias(c) for c in ("rate_before", "rate_after", "ratio"))),
    f", n AS (SELECT count(*) FILTER (NOT late) AS events_before, count(*) FILTER (NOT late AND e) AS errors_before, count(*) FILTER (late) AS events_after, count(*) FILTER (late AND e) AS errors_after "
    f"FROM (SELECT ts_dt >= timestamp '{DEPLOY}' AS late, {ERROR} AS e FROM ev WHERE ts_dt IS NOT NULL)), "
    "q AS (SELECT *, errors_before / nullif(events_before, 0) AS b, errors_after / nullif(events_after, 0) AS a FROM n) "
    "SELECT events_before, errors_before, events_after, errors_after, round(b, 6) AS rate_before, round(a, 6) AS rate_after, round(a / nullif(b, 0), 6) AS ratio FROM q",
)
add(
    "lockouts",
    lambda s, d: R.lockouts(events(s, d), "REDACTED", "(?i)stuck thread", 3600),
    f", k AS (SELECT file, event_seq, ts_dt, CASE WHEN regexp_matches(text, '(?i)stuck thread') THEN 'lockout' WHEN contains(text, 'REDACTED') THEN 'failure' END AS kind FROM ev WHERE ts_dt IS NOT NULL), "
    f"p AS (SELECT *, {SEC} AS s, lag(kind) OVER w AS before, lag({SEC}) OVER w AS then_s, lag(event_seq) OVER w AS failed_seq FROM k WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY file ORDER BY event_seq)) "
    "SELECT file, event_seq, failed_seq FROM p WHERE kind = 'lockout' AND before = 'failure' AND s - then_s <= 3600",
)
add(
    "thread_timeline",
    lambda s, d: R.thread_timeline(events(s, d), 600).select("file", "event_seq", "hung_seq", F.round("seconds", 3).alias("seconds")),
    f", t AS (SELECT file, event_seq, thread_id, {SEC} AS s, list_contains(tags, 'HungThreads') AS hung FROM ev WHERE ts_dt IS NOT NULL AND thread_id IS NOT NULL) "
    "SELECT t.file, t.event_seq, h.event_seq AS hung_seq, round(h.s - t.s, 3) AS seconds FROM t JOIN t AS h ON h.hung AND t.file = h.file AND t.thread_id = h.thread_id AND t.event_seq < h.event_seq AND h.s - t.s BETWEEN 0 AND 36000 "
    "QUALIFY row_number() OVER (PARTITION BY t.file, t.event_seq ORDER BY h.event_seq) = 1",
)


def json_lines(spark, sf_dir):
    """The events of the rendered logs as JSON server logs, read back into the events schema; some have no id of their own."""
    own = events(spark, sf_dir)
    when = F.date_format("ts_dt", "yyyy-MM-dd'T'HH:mm:ss.SSS")
    row = F.struct(
        F.lit("liberty_message").alias("type"), F.concat(when, F.lit("+0000")).alias("ibm_datetime"), F.when(F.col("event_seq") % 3 > 0, F.col("code")).alias("ibm_messageId"),
        F.col("level").alias("loglevel"), F.substring_index("text", "\n", 1).alias("message"), F.upper("thread_id").alias("ibm_threadId"),
        F.when(F.col("text").contains("\n"), F.substring(F.col("text"), F.length(F.substring_index("text", "\n", 1)) + 2, F.length("text"))).alias("ibm_stackTrace"),
    )
    got = R.json_lines(own.select("file", F.col("event_seq").alias("line_no"), F.to_json(row).alias("line")))
    return got.withColumn("tags", F.array_join("tags", ","))


add(
    "json_lines",
    json_lines,
    "SELECT file, event_seq, strftime(ts_dt, '%Y-%m-%dT%H:%M:%S.%g') AS ts, ts_dt, level, thread_id, code, exception, root_cause, array_to_string(tags, ',') AS tags, text FROM ev",
)


def folder(spark: SparkSession) -> str:
    """A new folder that the cluster shares, for the segments and state of a stream that is run once."""
    return new_folder(spark, "stream")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered lines as a stream of rows, in two segments."""
    at = folder(spark)
    own = rendered_lines(table(spark, sf_dir, "events")).withColumn("seg", F.lit(0).cast("long"))
    own.select("file", "seg", "pos", "line").where("block % 2 = 0").write.parquet(f"{at}/in")
    own.select("file", F.lit(1).cast("long").alias("seg"), "pos", "line").where("block % 2 = 1").write.mode("append").parquet(f"{at}/in")
    return spark.readStream.schema("file string, seg long, pos long, line string").parquet(f"{at}/in")


def run_once(stream: DataFrame, mode: str) -> DataFrame:
    """All that is there now, through the stream, into a table in the shared folder."""
    spark = stream.sparkSession
    at = folder(spark)
    if mode == "complete":
        name = f"{at}/out"
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(name)).start().awaitTermination()
    else:
        stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").format("parquet").start(f"{at}/out").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")


def stream_histogram(spark, sf_dir):
    return run_once(streams.stream_histogram(segments(spark, sf_dir), "60 minutes", "30 days"), "complete").withColumn("start", F.col("start").cast("timestamp_ntz"))


def in_two_runs(rows: DataFrame, first: Column, start) -> str:
    """Streams the rows in two runs, of which the second goes on from the first's checkpoint; ``start`` gets a stream of them and a
    new folder, and says which writer to run.  The folder."""
    spark = rows.sparkSession
    at = folder(spark)
    for own in (rows.where(first), rows.where(~first)):
        own.write.mode("append").parquet(f"{at}/in")
        writer = start(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), at)
        writer.trigger(availableNow=True).option("checkpointLocation", f"{at}/state").start().awaitTermination()
    return at


def stream_counts(spark, sf_dir):
    """In update mode, in two runs, into a sink of versions."""
    rows = rendered_lines(table(spark, sf_dir, "events")).select("file", "block", "pos", "line")
    at = in_two_runs(
        rows,
        F.col("block") % 2 == 0,
        lambda stream, at: streams.stream_counts(stream, "1 day", "30 days").writeStream.outputMode("update").foreachBatch(streams.versions_writer(f"{at}/out")),
    )
    return streams.latest_versions(spark, f"{at}/out", ["start", "thread_id"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


def late_rows(spark, sf_dir):
    """A histogram by the hour with its late rows: odd blocks come first, so even ones are late by up to all of their time."""
    rows = rendered_lines(table(spark, sf_dir, "events")).select("file", "block", "pos", "line")
    at = in_two_runs(rows, F.col("block") % 2 == 1, lambda stream, at: stream.writeStream.foreachBatch(streams.histogram_writer(f"{at}/out", 3600, 86_400)))
    return streams.counted_histogram(spark, f"{at}/out").withColumn("start", F.col("start").cast("timestamp_ntz"))


def stream_error_bursts(spark, sf_dir):
    out = run_once(streams.error_bursts(segments(spark, sf_dir), 600, "30 days"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


_line_ts = S.parse_ts(S.extract_ts("line"))
QUERIES["stream_histogram"] = stream_histogram
ORACLES["stream_histogram"] = S.WITH_LINES + (
    f", t AS (SELECT {_line_ts} AS t, {S.level('line')} AS level FROM lines) SELECT date_trunc('hour', t) AS start, count(*) AS total, count(*) FILTER ({ERROR}) AS errors FROM t WHERE t IS NOT NULL GROUP BY 1"
)
QUERIES["stream_counts"] = stream_counts
ORACLES["stream_counts"] = S.WITH_LINES + (
    f", t AS (SELECT {_line_ts} AS t, {S.level('line')} AS level, {S.found('line', P.THREAD)} AS thread_id, {S.matches('line', P.TAGS['HungThreads'])} AS hung FROM lines) "
    f"SELECT CAST(date_trunc('day', t) AS TIMESTAMP) AS start, thread_id, count(*) FILTER ({ERROR}) AS errors, count(*) FILTER (hung) AS hung FROM t WHERE t IS NOT NULL GROUP BY 1, 2"
)


def stream_lines(spark, sf_dir):
    """The rendered lines as rotated text segments, a folder for each log and segment, read with the stream source."""
    at = folder(spark)
    own = rendered_lines(table(spark, sf_dir, "events")).withColumn("seg", F.col("block")).repartition("file", "seg").sortWithinPartitions("file", "seg", "pos")
    own.select("file", "seg", F.col("line").alias("value")).write.partitionBy("file", "seg").text(f"{at}/logs")
    got = run_once(streams.stream_lines(spark, f"{at}/logs", name=r"/file=([^/]+)/seg=(\d+)/"), "append")
    return got.groupBy("file").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if("ends").alias("n_segments"), F.sum(F.length("line")).alias("n_chars"))


def tail(spark, sf_dir):
    """The rendered lines as log files that are followed from their start, by stretches of 64 KB; the folder is mounted."""
    from ..streaming.tail import TailSource

    spark.dataSource.register(TailSource)
    root = written(spark, sf_dir)
    at = folder(spark)
    stream = spark.readStream.format("tail").option("path", re.sub(r"^file:/+", "/", root)).option("from", "start").load()
    query = stream.writeStream.option("checkpointLocation", f"{at}/state").format("parquet").start(f"{at}/out")
    query.processAllAvailable()
    query.stop()
    got = spark.read.schema(stream.schema).parquet(f"{at}/out").groupBy(F.regexp_extract("file", "/file=([^/]+)/", 1).alias("file"))
    return got.agg(F.count(F.lit(1)).alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


QUERIES["stream_tail"] = tail
ORACLES["stream_tail"] = S.WITH_LINES + "SELECT file, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines WHERE NOT regexp_matches(line, '^\\s*$') GROUP BY file"
QUERIES["stream_lines"] = stream_lines
ORACLES["stream_lines"] = S.WITH_LINES + "SELECT file, count(*) AS n_lines, count(DISTINCT event_id // 2000) AS n_segments, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM spread WHERE line IS NOT NULL GROUP BY file"
QUERIES["stream_late_rows"] = late_rows
ORACLES["stream_late_rows"] = S.WITH_LINES + (
    f", t AS (SELECT {_line_ts} AS t, {S.level('line')} AS level, event_id // 2000 % 2 = 1 AS first FROM spread WHERE line IS NOT NULL), "
    "seen AS (SELECT max(t) AS seen FROM t WHERE first), "
    "r AS (SELECT date_trunc('hour', t) AS start, level, NOT first AND seen IS NOT NULL AND date_trunc('hour', t) + INTERVAL 25 HOURS <= seen AS late FROM t, seen WHERE t IS NOT NULL) "
    f"SELECT start, count(*) FILTER (NOT late) AS total, count(*) FILTER (NOT late AND {ERROR}) AS errors, count(*) FILTER (late) AS late FROM r GROUP BY 1"
)
QUERIES["stream_error_bursts"] = stream_error_bursts
ORACLES["stream_error_bursts"] = S.WITH_LINES + (
    f", t AS (SELECT file, {_line_ts} AS t FROM lines WHERE {S.level('line')} IN ('ERROR', 'SEVERE', 'FATAL')), "
    "g AS (SELECT file, t, coalesce(epoch_us(t) - lag(epoch_us(t)) OVER (PARTITION BY file ORDER BY t) > 600000000, true) AS opens FROM t WHERE t IS NOT NULL), "
    "b AS (SELECT file, t, count(*) FILTER (opens) OVER (PARTITION BY file ORDER BY t ROWS UNBOUNDED PRECEDING) AS b FROM g) "
    'SELECT file, min(t) AS start, max(t) AS "end", count(*) AS cnt FROM b GROUP BY file, b'
)


def written(spark: SparkSession, sf_dir: str) -> str:
    """The rendered lines as text files, a folder for each log; tasks take ranges of blocks, so the names of a log's files sort as
    their blocks do."""
    at = folder(spark)
    own = rendered_lines(table(spark, sf_dir, "events")).repartitionByRange("file", "block").sortWithinPartitions("file", "block", "pos")
    own.select("file", F.col("line").alias("value")).write.partitionBy("file").text(f"{at}/logs")
    return f"{at}/logs"


def read_lines(spark, sf_dir):
    got = files.read_lines(spark, [written(spark, sf_dir)])
    name = F.regexp_extract("file", "/file=([^/]+)/", 1)
    return got.groupBy(name.alias("file")).agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line") == "").alias("n_blank"), F.sum(F.length("line")).alias("n_chars"))


def ingest_report(spark, sf_dir):
    got = files.ingest_report(spark, [written(spark, sf_dir)])
    name = F.regexp_extract("path", "/file=([^/]+)/", 1)
    return got.groupBy(name.alias("file")).agg(F.sum("bytes").alias("bytes"), F.bool_and("readable").alias("readable"))


def ingest_gzip(spark, sf_dir):
    """The rendered lines as gzip files, inflated whole by the executors."""
    at = folder(spark)
    own = rendered_lines(table(spark, sf_dir, "events")).repartition("file", "block").sortWithinPartitions("file", "block", "pos")
    own.select("file", F.col("line").alias("value")).write.partitionBy("file").option("compression", "gzip").text(f"{at}/logs")
    got = files.ingest_report(spark, [f"{at}/logs"]).groupBy(F.regexp_extract("path", "/file=([^/]+)/", 1).alias("file"))
    return got.agg(F.sum("inflated").alias("inflated"), F.bool_and("readable").alias("readable"), F.count("reason").alias("reasons"))


def stream_events(spark, sf_dir):
    """Streamed assembly of segments of which every other one comes early; a last row without a line closes each file."""
    place = F.row_number().over(W.partitionBy("file", "block").orderBy("pos"))
    last = F.lead("pos").over(W.partitionBy("file", "block").orderBy("pos")).isNull()
    own = rendered_lines(table(spark, sf_dir, "events")).select("file", F.col("block").alias("seg"), (place - 1).cast("long").alias("pos"), "line", last.alias("ends"))
    own = store(own, "segments")
    # of each log, segments are numbered without gaps
    numbers = own.select("file", "seg").distinct().withColumn("no", F.row_number().over(W.partitionBy("file").orderBy("seg")).cast("long"))
    numbers = store(numbers, "numbers")
    lines = own.join(F.broadcast(numbers), ["file", "seg"]).select("file", F.col("no").alias("seg"), "pos", "line", "ends")
    ends = numbers.groupBy("file").agg((F.max("no") + 1).alias("seg")).select("file", "seg", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("line"), F.lit(True).alias("ends"))
    at = in_two_runs(
        lines.unionByName(ends),
        F.col("seg") % 2 == 0,  # half of the segments are early
        lambda stream, at: streams.stream_events(stream, first=1).writeStream.outputMode("append").foreachBatch(streams.versions_writer(f"{at}/out")),
    )
    return spark.read.parquet(f"{at}/out").select("file", "event_seq", "ts", "level", "code", "exception", "text")


def stream_last_lines(spark, sf_dir):
    """Last lines kept in state, in two runs, the later segments first."""
    rows = rendered_lines(table(spark, sf_dir, "events")).select("file", F.col("block").alias("seg"), "pos", "line")
    at = in_two_runs(
        rows, F.col("seg") % 2 == 1, lambda stream, at: streams.stream_last_lines(stream, 50).writeStream.outputMode("update").foreachBatch(streams.versions_writer(f"{at}/out"))
    )
    return streams.latest_versions(spark, f"{at}/out", ["file"]).select("file", "line")


def multi_file_union(spark, sf_dir):
    """Real files by folder, in the order given, of which one is missing."""
    root = written(spark, sf_dir)
    paths = [f"{root}/missing.log", *(f"{root}/file=node{k}.log" for k in (4, 5, 6, 7, 0, 1, 2, 3))]
    own = files.with_file_order(files.read_lines(spark, paths), paths)
    return own.groupBy("file_ord", F.regexp_extract("file", "/file=([^/]+)/", 1).alias("file")).agg(F.count(F.lit(1)).alias("n_lines"))


#: The order in which the log files are given: not that of their names.
GIVEN = (4, 5, 6, 7, 0, 1, 2, 3)


def given_events(spark, sf_dir):
    """Events of real files in the order given, of which one is missing; a log is named by its folder."""
    root = written(spark, sf_dir)
    paths = [f"{root}/missing.log", *(f"{root}/file=node{k}.log" for k in GIVEN)]
    name = F.regexp_extract("file", "/file=([^/]+)/", 1)
    lines = files.read_lines(spark, paths).withColumns({"block": F.concat_ws("/", "file", F.format_string("%020d", "block")), "file": name})
    manifest = files.file_manifest(spark, paths).select(name.alias("file"), "file_ord").distinct()
    return files.ordered_events(assembly.events(lines), manifest)


QUERIES["multi_file_events"] = lambda s, d: given_events(s, d).select("file_ord", "file", "event_seq", "ts", "level", "code")
QUERIES["incident_by_argument_order"] = lambda s, d: incident_window(given_events(s, d), 3600).select("file_ord", "file", "event_seq", "offset_seconds", "is_trigger")
QUERIES["samples_by_argument_order"] = lambda s, d: pick_samples(given_events(s, d), 5).select("rank", "file", "event_seq", "score")
QUERIES["multi_file_union"] = multi_file_union
ORACLES["multi_file_union"] = S.WITH_LINES + "SELECT CAST((CAST(substr(file, 5, 1) AS INT) + 4) % 8 + 1 AS BIGINT) AS file_ord, file, count(*) AS n_lines FROM lines GROUP BY ALL"


_given = ", g AS MATERIALIZED (SELECT *, CAST((CAST(substr(file, 5, 1) AS INT) + 4) % 8 + 1 AS BIGINT) AS file_ord FROM ev)"
ORACLES["multi_file_events"] = S.WITH_EVENTS + _given + " SELECT file_ord, file, event_seq, ts, level, code FROM g"
ORACLES["incident_by_argument_order"] = (
    S.WITH_EVENTS + _given + f", trigger AS (SELECT file AS f, event_seq AS s, ts_dt AS t FROM g WHERE {ERROR} AND ts_dt IS NOT NULL ORDER BY file_ord, event_seq LIMIT 1) "
    "SELECT file_ord, file, event_seq, (epoch_us(ts_dt) - epoch_us(t)) / 1e6 AS offset_seconds, file = f AND event_seq = s AS is_trigger "
    "FROM g, trigger WHERE ts_dt IS NOT NULL AND abs(epoch_us(ts_dt) - epoch_us(t)) <= 3600000000"
)
ORACLES["samples_by_argument_order"] = (
    S.WITH_EVENTS + _given + f", u AS (SELECT *, {SCORE} AS score FROM g QUALIFY row_number() OVER (PARTITION BY level, code, exception ORDER BY file_ord, event_seq) = 1) "
    "SELECT CAST(row_number() OVER (ORDER BY score DESC, file_ord, event_seq) AS INT) AS rank, file, event_seq, score FROM u QUALIFY rank <= 5"
)
QUERIES |= {"read_lines": read_lines, "ingest_report": ingest_report, "ingest_gzip": ingest_gzip, "stream_events": stream_events, "stream_last_lines": stream_last_lines}
ORACLES |= {
    "read_lines": S.WITH_LINES + "SELECT file, count(*) AS n_lines, count(*) FILTER (line = '') AS n_blank, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM lines GROUP BY file",
    "ingest_report": S.WITH_LINES + "SELECT file, CAST(sum(strlen(line) + 1) AS BIGINT) AS bytes, true AS readable FROM lines GROUP BY file",
    "ingest_gzip": S.WITH_LINES + "SELECT file, CAST(sum(strlen(line) + 1) AS BIGINT) AS inflated, true AS readable, CAST(0 AS BIGINT) AS reasons FROM lines GROUP BY file",
    "stream_events": S.WITH_EVENTS + "SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_seq) - 1 AS event_seq, ts, level, code, exception, text FROM ev",
    "stream_last_lines": S.WITH_LINES + "SELECT file, line FROM lines WHERE NOT regexp_matches(line, '^\\s*$') QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no DESC) <= 50",
}
