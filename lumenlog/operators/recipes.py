"""Analyses over the events table that operators of logs ask for: noise, clusters, gaps, bursts, spikes.

Where a time window pairs rows, both sides are first dealt to buckets as wide as the window, so the join is
an equi join on buckets and neighbours, never a scan of all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.time import parse_ts
from .summary import order

NEVER_NOISE = ("ERROR", "SEVERE", "FATAL")
FRAMEWORK = r"^\s*at (java|javax|sun|com\.ibm\.ws)\."


def seconds(ts) -> F.Column:
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def noise_candidates(events: DataFrame, least: int = 1000) -> DataFrame:
    """Codes seen more than ``least`` times with one distinct message and never at an error level."""
    message = F.regexp_replace("text", r"^(?:\[[^\]]*\]\s+[0-9a-f]+|" + P.TS_ISO + r")\s+", "")
    out = events.where("code is not null").groupBy("code").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.count_distinct(F.xxhash64(message)).alias("texts"),
        F.count_if(F.col("level").isin(*NEVER_NOISE)).alias("errors"),
    )
    return out.where((F.col("cnt") > least) & (F.col("texts") == 1) & (F.col("errors") == 0))


def without_noise(events: DataFrame, codes: list[str], prefixes: list[str]) -> DataFrame:
    """Events but those whose code is listed or starts with a listed prefix; errors always stay."""
    noisy = F.col("code").isin(*codes) if codes else F.lit(False)
    for p in prefixes:
        noisy = noisy | F.col("code").startswith(p)
    return events.where(~F.coalesce(noisy, F.lit(False)) | T.is_error(F.col("level")))


#: Seconds of time in which a code's times in a file are ordered together; with milliseconds that bounds them.
STRETCH = 3600


def regular_messages(events: DataFrame, least: int = 5, spread: float = 1.0) -> DataFrame:
    """(code, file, cnt, gap, deviation) of codes that come at regular intervals in a file.

    Equal times count once, with their number of events, and each stretch of time is ordered by itself: only its first time
    looks back, to the last one of the stretch before, which is one row.  So no task holds all events of a code.
    """
    key = ["file", "code"]
    rows = events.where("ts_dt is not null and code is not null").select(*key, F.unix_micros(F.col("ts_dt").cast("timestamp")).alias("t"))
    times = rows.groupBy(*key, F.floor(F.col("t") / (STRETCH * 1_000_000)).alias("part"), "t").agg(F.count(F.lit(1)).alias("n"))
    own = F.lag("t").over(W.partitionBy(*key, "part").orderBy("t"))
    ends = times.groupBy(*key, "part").agg(F.max("t").alias("end"))
    carried = ends.select(*key, "part", F.lag("end").over(W.partitionBy(*key).orderBy("part")).alias("carried"))  # one row a stretch
    gaps_ = times.withColumn("own", own).join(carried, [*key, "part"]).withColumn("gap", F.col("t") / 1e6 - F.coalesce("own", "carried") / 1e6)
    # n events of one time have n - 1 gaps of zero among them
    sums = gaps_.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("gap").alias("total"), F.sum(F.col("gap") * F.col("gap")).alias("squares")).where("n > 1")
    cnt, zero = F.col("n") - 1, F.lit(0.0)
    out = sums.select("code", "file", cnt.alias("cnt"), (F.coalesce("total", zero) / cnt).alias("gap"), (F.coalesce("squares", zero) / cnt).alias("square"))
    out = out.withColumn("deviation", F.sqrt(F.greatest(F.col("square") - F.col("gap") * F.col("gap"), zero))).drop("square")
    return out.where((F.col("cnt") >= least) & (F.col("deviation") <= spread * F.col("gap")))


def context_rows(events: DataFrame, within: int = 300) -> DataFrame:
    """Info and audit events within ``within`` seconds of an error.

    Buckets are as wide as the window, so an error of the same bucket is in reach, and of the buckets beside it only the
    last error before and the first after matter: three numbers a bucket, however many errors there are.
    """
    s = seconds(F.col("ts_dt"))
    bucket = F.floor(s / within)
    errors = events.where(T.is_error(F.col("level")) & F.col("ts_dt").isNotNull()).groupBy(bucket.alias("b")).agg(F.min(s).alias("lo"), F.max(s).alias("hi"))
    beside = lambda k, *cols: errors.select((F.col("b") + k).alias("b"), *cols)
    none = F.lit(None).cast("double")
    edges = (
        beside(0, F.lit(True).alias("own"), none.alias("before"), none.alias("after"))
        .unionByName(beside(1, F.lit(False).alias("own"), F.col("hi").alias("before"), none.alias("after")))
        .unionByName(beside(-1, F.lit(False).alias("own"), none.alias("before"), F.col("lo").alias("after")))
        .groupBy("b").agg(F.bool_or("own").alias("own"), F.max("before").alias("before"), F.max("after").alias("after"))
    )
    rows = events.where(F.col("level").isin("INFO", "AUDIT") & F.col("ts_dt").isNotNull()).withColumns({"s": s, "b": bucket})
    near = F.col("own") | F.coalesce(F.col("s") - F.col("before") <= within, F.lit(False)) | F.coalesce(F.col("after") - F.col("s") <= within, F.lit(False))
    return rows.join(edges, "b").where(near).drop("s", "b", "own", "before", "after")


def stack_clusters(events: DataFrame) -> DataFrame:
    """(fingerprint, cnt, file, event_seq): equal stacks without framework frames and line numbers, with their first event."""
    frames = F.filter(F.split("text", "\n", -1), lambda x: T.is_stack_line(x) & ~x.rlike(FRAMEWORK))
    key = F.array_join(F.transform(frames, lambda x: F.regexp_replace(F.trim(x, F.lit(" \t")), r":\d+\)$", ")")), "\n")
    out = events.withColumn("k", key).where("k <> ''").groupBy(F.sha2(F.col("k").cast("binary"), 256).alias("fingerprint")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(F.struct(*order(events))).alias("first")
    )
    return out.select("fingerprint", "cnt", "first.*")


#: Events of a file that are ordered together; a file's blocks are then joined at their ends.
BLOCK = 100_000


def before_in_file(events: DataFrame, value: Column, name: str) -> DataFrame:
    """``events`` with ``name``, the value of the event before, which must not be null, in the order of a file.

    A file is cut into blocks by its event numbers.  Only a block's first event looks to the block before, whose
    last value is one row, so no task orders a whole file.
    """
    rows = events.withColumns({"__block": F.floor(F.col("event_seq") / BLOCK), "__value": value})
    ends = rows.groupBy("file", "__block").agg(F.max_by("__value", "event_seq").alias("__end"))
    carried = ends.select("file", "__block", F.lag("__end").over(W.partitionBy("file").orderBy("__block")).alias("__carried"))  # one row a block
    own = F.lag("__value").over(W.partitionBy("file", "__block").orderBy("event_seq"))
    return rows.withColumn("__own", own).join(carried, ["file", "__block"]).withColumn(name, F.coalesce("__own", "__carried")).drop("__block", "__value", "__own", "__carried")


def runs_in_file(events: DataFrame, opens: Column, name: str) -> DataFrame:
    """``events`` with ``name``, how many events up to this one in the order of its file have ``opens``; by blocks too."""
    rows = events.withColumns({"__block": F.floor(F.col("event_seq") / BLOCK), "__opens": F.coalesce(opens, F.lit(False))})
    sums = rows.groupBy("file", "__block").agg(F.count_if("__opens").alias("__n"))
    prior = W.partitionBy("file").orderBy("__block").rowsBetween(W.unboundedPreceding, -1)  # one row a block
    sums = sums.select("file", "__block", F.coalesce(F.sum("__n").over(prior), F.lit(0)).alias("__before"))
    own = F.count_if("__opens").over(W.partitionBy("file", "__block").orderBy("event_seq"))
    return rows.withColumn("__run", own).join(sums, ["file", "__block"]).withColumn(name, F.col("__run") + F.col("__before")).drop("__block", "__opens", "__run", "__before")


def gaps(events: DataFrame, least: int = 30) -> DataFrame:
    """(file, event_seq, gap_seconds) where a file was silent for ``least`` seconds."""
    s = seconds(F.col("ts_dt"))
    dated = before_in_file(events.where("ts_dt is not null").select("file", "event_seq", "ts_dt"), s, "before")
    return dated.select("file", "event_seq", (s - F.col("before")).alias("gap_seconds")).where(F.col("gap_seconds") > least)


def startups(events: DataFrame, start_code: str, ready_code: str, slow: int = 300) -> DataFrame:
    """(file, run, start, ready, seconds, slow): each start of a file, up to its first ready event, if there is one."""
    is_code = lambda code: F.coalesce(F.col("code") == code, F.lit(False))
    run = runs_in_file(events.select("file", "event_seq", "ts_dt", "code"), is_code(start_code), "run").where("run > 0")
    out = run.groupBy("file", "run").agg(F.min_by("ts_dt", F.when(is_code(start_code), F.col("event_seq"))).alias("start"), F.min_by("ts_dt", F.when(is_code(ready_code), F.col("event_seq"))).alias("ready"))
    took = seconds(F.col("ready")) - seconds(F.col("start"))
    return out.withColumn("seconds", took).withColumn("slow", F.coalesce(took > slow, F.lit(False)))


def code_spikes(events: DataFrame, minutes: int = 5, least: int = 2) -> DataFrame:
    """(start, code, cnt) of error codes by window."""
    at = F.floor(seconds(F.col("ts_dt")) / (60 * minutes)) * 60 * minutes
    out = events.where(T.is_error(F.col("level")) & F.col("ts_dt").isNotNull() & F.col("code").isNotNull())
    return out.groupBy(at.cast("long").alias("start"), "code").agg(F.count(F.lit(1)).alias("cnt")).where(F.col("cnt") >= least)


def hourly_hung(events: DataFrame) -> DataFrame:
    """(hour, hung): events that report hung threads, by hour."""
    at = F.floor(seconds(F.col("ts_dt")) / 3600) * 3600
    return events.where(F.col("ts_dt").isNotNull() & F.array_contains("tags", "HungThreads")).groupBy(at.cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("hung"))


def pool_errors(events: DataFrame, minutes: int = 10) -> DataFrame:
    """(start, pool): events of connection pools, by window."""
    at = F.floor(seconds(F.col("ts_dt")) / (60 * minutes)) * 60 * minutes
    return events.where(F.col("ts_dt").isNotNull() & F.array_contains("tags", "DB/Pool")).groupBy(at.cast("long").alias("start")).agg(F.count(F.lit(1)).alias("pool"))


def file_code_matrix(events: DataFrame, codes: list[str]) -> DataFrame:
    """One row per file with a count column for each of the given codes."""
    return events.groupBy("file").pivot("code", codes).agg(F.count(F.lit(1))).na.fill(0)


def hourly_anomalies(events: DataFrame, hours: int = 24) -> DataFrame:
    """(hour, cnt, expected, deviation) of hours whose count exceeds the mean of the ``hours`` before by two deviations."""
    counts = events.where("ts_dt is not null").groupBy(F.floor(seconds(F.col("ts_dt")) / 3600).alias("hour")).agg(F.count(F.lit(1)).alias("cnt"))
    prior = W.orderBy("hour").rangeBetween(-hours, -1)  # one row an hour
    out = counts.withColumns({"expected": F.avg("cnt").over(prior), "deviation": F.stddev_pop("cnt").over(prior)})
    return out.where("cnt > expected + 2 * deviation")


def regressions(events: DataFrame, deploy: str) -> DataFrame:
    """Exception classes first seen after ``deploy``, with their counts."""
    at = F.lit(deploy).cast("timestamp_ntz")
    old = events.where((F.col("ts_dt") < at) & F.col("exception").isNotNull()).select("exception").distinct()
    new = events.where((F.col("ts_dt") >= at) & F.col("exception").isNotNull()).groupBy("exception").agg(F.count(F.lit(1)).alias("cnt"))
    return new.join(old, "exception", "left_anti")


def error_rates(events: DataFrame, deploy: str) -> DataFrame:
    """One row: events, errors and error rates before and after ``deploy``, and the second rate as a multiple of the first."""
    late = F.col("ts_dt") >= F.lit(deploy).cast("timestamp_ntz")
    error = T.is_error(F.col("level"))
    out = events.where("ts_dt is not null").agg(
        F.count_if(~late).alias("events_before"), F.count_if(~late & error).alias("errors_before"), F.count_if(late).alias("events_after"), F.count_if(late & error).alias("errors_after")
    )
    rate = lambda when: F.try_divide(F.col("errors_" + when), F.col("events_" + when))
    return out.withColumns({"rate_before": rate("before"), "rate_after": rate("after"), "ratio": F.try_divide(rate("after"), rate("before"))})


def shared_top_frames(events: DataFrame, least: int = 2) -> DataFrame:
    """(frame, threads, cnt) of top frames on which several threads stand."""
    frame = F.trim(F.get(F.filter(F.split("text", "\n", -1), T.is_stack_line), F.lit(0)), F.lit(" \t"))
    out = events.withColumn("frame", F.regexp_replace(frame, r"\([^)]*\)$", "")).where("frame is not null")
    return out.groupBy("frame").agg(F.count_distinct("thread_id").alias("threads"), F.count(F.lit(1)).alias("cnt")).where(F.col("threads") >= least)


def error_bursts(events: DataFrame, gap: int = 600) -> DataFrame:
    """(file, burst, start, end, cnt, largest): errors of a file with no pause longer than ``gap`` seconds, in the order of
    its events; ``largest`` marks the file's burst of most errors, the first of several."""
    s = seconds(F.col("ts_dt"))
    errors = events.where(T.is_error(F.col("level")) & F.col("ts_dt").isNotNull()).select("file", "event_seq", "ts_dt")
    marked = before_in_file(errors, s, "before")
    marked = runs_in_file(marked, F.col("before").isNull() | (F.abs(s - F.col("before")) > gap), "burst")
    out = marked.groupBy("file", "burst").agg(F.min("ts_dt").alias("start"), F.max("ts_dt").alias("end"), F.count(F.lit(1)).alias("cnt"))
    best = out.groupBy("file").agg(F.max_by("burst", F.struct("cnt", -F.col("burst"))).alias("best"))  # one row a file
    return out.join(best, "file").withColumn("largest", F.col("burst") == F.col("best")).drop("best")


def summary_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(dim, key, old_cnt, new_cnt, change) of two summaries."""
    a = old.select("dim", "key", F.col("cnt").alias("old_cnt"))
    b = new.select("dim", "key", F.col("cnt").alias("new_cnt"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return a.join(b, ["dim", "key"], "full").select("dim", "key", zero("old_cnt").alias("old_cnt"), zero("new_cnt").alias("new_cnt"), (zero("new_cnt") - zero("old_cnt")).alias("change"))


def json_lines(lines: DataFrame) -> DataFrame:
    """Server logs of one JSON object a line (file, line_no, line), as rows of the events table.

    The message and a stack below it are the text, redacted before anything is taken from it; a message id, level or thread
    that the object names wins over one in the text.  Lines that are no such object are left out.
    """
    schema = "type string, ibm_datetime string, ibm_messageId string, loglevel string, message string, ibm_threadId string, ibm_stackTrace string"
    rows = lines.select("file", F.col("line_no").alias("event_seq"), F.from_json("line", schema).alias("x")).select("file", "event_seq", "x.*").where("message is not null")
    text = F.col("text")
    # the zone is left out, as it is of other time stamps
    ts = F.regexp_replace("ibm_datetime", r"(Z|[+-]\d{2}:?\d{2})$", "")
    rows = rows.withColumns({"text": T.redact(F.concat_ws("\n", "message", "ibm_stackTrace")), "ts": ts})
    return rows.select(
        "file",
        "event_seq",
        "ts",
        parse_ts(F.col("ts")).alias("ts_dt"),
        F.coalesce(F.upper("loglevel"), T.level(text)).alias("level"),
        F.coalesce(F.lower("ibm_threadId"), T.thread_id(text)).alias("thread_id"),
        F.coalesce("ibm_messageId", T.message_code(text)).alias("code"),
        T.exception(text).alias("exception"),
        T.root_cause(text).alias("root_cause"),
        T.signal_tags(text).alias("tags"),
        "text",
    )


def failures_per_minute(events: DataFrame, pattern: str, least: int) -> DataFrame:
    """(minute, file, cnt) of minutes in which a file has ``least`` events that match, such as failed logins."""
    minute = F.floor(seconds(F.col("ts_dt")) / 60).cast("long")
    out = events.where(F.col("ts_dt").isNotNull() & F.col("text").rlike(pattern)).groupBy(minute.alias("minute"), "file").agg(F.count(F.lit(1)).alias("cnt"))
    return out.where(F.col("cnt") >= least)


def lockouts(events: DataFrame, failure: str, lockout: str, within: int = 300) -> DataFrame:
    """(file, event_seq, failed_seq): lockouts whose last event before it that failed to log in is at most ``within`` seconds old."""
    kind = F.when(F.col("text").rlike(lockout), "lockout").when(F.col("text").rlike(failure), "failure")
    rows = events.where("ts_dt is not null").select("file", "event_seq", "ts_dt", kind.alias("kind")).where("kind is not null")
    at = F.struct("kind", seconds(F.col("ts_dt")).alias("s"), F.col("event_seq").alias("seq"))
    found = before_in_file(rows, at, "before").where("kind = 'lockout' and before.kind = 'failure'")
    return found.where(seconds(F.col("ts_dt")) - F.col("before.s") <= within).select("file", "event_seq", F.col("before.seq").alias("failed_seq"))


def restarts(events: DataFrame, start_code: str, ready_code: str | None = None) -> DataFrame:
    """(file, run, events, errors, first_seq, unexpected): runs of a file between two events of the start code.

    A run begins unexpectedly if the one before was ready and then had errors.
    """
    ready = F.coalesce(F.col("code") == ready_code, F.lit(False)) if ready_code else F.lit(False)
    rows = runs_in_file(events.select("file", "event_seq", "code", "level"), F.col("code") == start_code, "run")
    error = T.is_error(F.col("level"))
    out = rows.groupBy("file", "run").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(error).alias("errors"), F.min("event_seq").alias("first_seq"),
        F.min(F.when(ready, F.col("event_seq"))).alias("ready"), F.max(F.when(error, F.col("event_seq"))).alias("failed"),
    )
    before = F.lag(F.coalesce(F.col("failed") > F.col("ready"), F.lit(False))).over(W.partitionBy("file").orderBy("run"))  # one row a run
    return out.withColumn("unexpected", F.coalesce(before, F.lit(False))).drop("ready", "failed")


def thread_timeline(events: DataFrame, minutes: int = 5) -> DataFrame:
    """(file, event_seq, hung_seq, seconds): what a thread did in the ``minutes`` before it was reported as hung.

    Of an event's reports the next one in the file counts: an as-of join, as a carry backward over blocks of events.  Each
    event has one row and no pairs are made.
    """
    key = ["file", "thread_id"]
    s = seconds(F.col("ts_dt"))
    rows = events.where("ts_dt is not null and thread_id is not null").select(*key, "event_seq", s.alias("s"), F.array_contains("tags", "HungThreads").alias("hung"), F.floor(F.col("event_seq") / BLOCK).alias("block"))
    report = F.when(F.col("hung"), F.struct("event_seq", "s"))
    after = W.partitionBy(*key, "block").orderBy("event_seq").rowsBetween(1, W.unboundedFollowing)
    own = rows.withColumn("own", F.first(report, ignorenulls=True).over(after))
    first = rows.groupBy(*key, "block").agg(F.min(report).alias("first"))
    later = W.partitionBy(*key).orderBy("block").rowsBetween(1, W.unboundedFollowing)  # one row a block
    carried = first.select(*key, "block", F.first("first", ignorenulls=True).over(later).alias("carried"))
    found = own.join(carried, [*key, "block"]).withColumn("h", F.coalesce("own", "carried")).where("h is not null")
    ago = F.col("h.s") - F.col("s")
    return found.where(ago.between(0, 60 * minutes)).select("file", "event_seq", F.col("h.event_seq").alias("hung_seq"), ago.alias("seconds"))
