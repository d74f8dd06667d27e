"""Ranked summaries, histograms, causes, samples and drilldowns over the events table.

Rows have no order of their own, so ranks carry the first event that showed a key.  Files come in the order in which they
were given, where events carry it as ``file_ord``, and else by name; events of a file by their number.
Each operator combines on the map side, and ranks only what is left: keys, buckets or rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..functions.time import ts_parts

def order(events: DataFrame) -> tuple[str, ...]:
    """The columns that order the events of all files."""
    return ("file_ord", "file", "event_seq") if "file_ord" in events.columns else ("file", "event_seq")


def at(events: DataFrame) -> Column:
    """An event's place in the order of files and events."""
    return F.struct(*order(events))


def total_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"))


def error_count(events: DataFrame) -> DataFrame:
    return events.agg(F.count_if(T.is_error(F.col("level"))).alias("errors"))


def ranked(counts: DataFrame, most: int | None) -> DataFrame:
    """(dim, key, cnt, first) with a rank per dimension: most frequent first, then what came first, then the key."""
    rank = F.row_number().over(W.partitionBy("dim").orderBy(F.desc("cnt"), "first", "key"))
    out = counts.withColumn("rank", rank)
    return (out if most is None else out.where(F.col("rank") <= most)).drop("first")


def summary(events: DataFrame, most: int | None = 10) -> DataFrame:
    """(dim, key, cnt, rank) of levels, codes, exceptions and tags in one pass."""
    entry = lambda dim, key: F.struct(F.lit(dim).alias("dim"), key.alias("key"))
    single = F.array(
        entry("level", F.coalesce("level", F.lit("UNKNOWN"))),
        entry("code", F.col("code")),
        entry("exception", F.col("exception")),
    )
    all_ = F.concat(single, F.transform("tags", lambda t: entry("tag", t)))
    counts = (
        events.select(*order(events), F.explode(all_).alias("e"))
        .where("e.key is not null")
        .groupBy("e.dim", "e.key")
        .agg(F.count(F.lit(1)).alias("cnt"), F.min(at(events)).alias("first"))
    )
    return ranked(counts, most)


def top(events: DataFrame, dim: str, most: int = 10) -> DataFrame:
    """(key, cnt, rank) of one dimension: level, code, exception or tag."""
    if dim == "tag":
        keys = events.select(*order(events), F.explode("tags").alias("key"))
    elif dim == "level":
        keys = events.select(*order(events), F.coalesce("level", F.lit("UNKNOWN")).alias("key"))
    else:
        keys = events.select(*order(events), F.col(dim).alias("key")).where("key is not null")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("cnt"), F.min(at(events)).alias("first"))
    return ranked(counts.withColumn("dim", F.lit(dim)), most).drop("dim")


def headline_metrics(events: DataFrame) -> DataFrame:
    """Totals of events, errors and warnings, and how many codes there are."""
    return events.agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(T.is_error(F.col("level"))).alias("errors"),
        F.count_if(F.col("level") == "WARNING").alias("warnings"),
        F.count_distinct("code").alias("codes"),
    )


def per_file(events: DataFrame) -> DataFrame:
    return events.groupBy("file").agg(F.count(F.lit(1)).alias("total"), F.count_if(T.is_error(F.col("level"))).alias("errors"))


def time_histogram(events: DataFrame, minutes: int = 1) -> DataFrame:
    """(bucket, total, errors); buckets restart at midnight, and show the date if there are several."""
    date, hour, minute = ts_parts(F.col("ts"))
    floor = F.floor((F.col("h") * 60 + F.col("m")) / minutes) * minutes
    buckets = (
        events.where("ts is not null")
        .select(date.alias("date"), hour.alias("h"), minute.alias("m"), T.is_error(F.col("level")).alias("error"))
        .where("h is not null and m is not null")
        .groupBy("date", floor.alias("floor"))
        .agg(F.count(F.lit(1)).alias("total"), F.count_if("error").alias("errors"))
    )
    dates = buckets.agg(F.count_distinct("date").alias("dates"))  # one row
    clock = F.format_string("%02d:%02d", F.floor(F.col("floor") / 60), F.col("floor") % 60)
    return (
        buckets.withColumn("one", F.lit(1))
        .join(F.broadcast(dates.withColumn("one", F.lit(1))), "one")
        .where((F.col("dates") == 0) | F.col("date").isNotNull())
        .select(F.when(F.col("dates") > 1, F.concat_ws(" ", "date", clock)).otherwise(clock).alias("bucket"), "total", "errors")
    )


def likely_causes(events: DataFrame) -> DataFrame:
    """(id, title, cnt, cause, fixes, rank) of the cause rules that match some event."""
    counts = events.agg(*(F.count_if(F.col("text").rlike(T.UNIX + p)).alias(f"c{i}") for i, (_, _, p) in enumerate(P.CAUSES)))

    def rule(i: int, key: str, title: str) -> Column:
        cause, fixes = P.CAUSE_TEXTS[key]
        fields = {"rule": F.lit(i), "id": F.lit(key), "title": F.lit(title), "cnt": F.col(f"c{i}"), "cause": F.lit(cause), "fixes": F.array(*map(F.lit, fixes))}
        return F.struct(*(c.alias(k) for k, c in fields.items()))

    rows = F.explode(F.array(*(rule(i, key, title) for i, (key, title, _) in enumerate(P.CAUSES))))
    rank = F.row_number().over(W.orderBy(F.desc("cnt"), "rule"))  # four rows at most
    return counts.select(rows.alias("r")).select("r.*").where("cnt > 0").withColumn("rank", rank).drop("rule")


def hung_threads(events: DataFrame) -> DataFrame:
    """Hung or stuck threads: how often, when first and last, their ids and the first stack sample."""
    hung = events.where(T.is_hung(F.col("text")))
    name = F.coalesce(T.hung_thread_name(F.col("text")), F.concat(F.lit("0x"), F.col("thread_id")), F.lit("unknown"))
    hung = hung.select(*order(events), "ts", "thread_id", name.alias("thread_name"), F.array_join(T.stack_sample(F.col("text")), "\n").alias("stack"))
    when = lambda c: F.when(c, at(events))
    out = hung.groupBy("thread_name").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min_by("ts", when(F.col("ts").isNotNull())).alias("first_ts"),
        F.max_by("ts", when(F.col("ts").isNotNull())).alias("last_ts"),
        F.array_sort(F.collect_set("thread_id")).alias("hex_ids"),
        F.coalesce(F.min_by("stack", when(F.col("stack") != "")), F.lit("")).alias("stack_sample"),
        F.min(at(events)).alias("first"),
    )
    rank = F.row_number().over(W.orderBy(F.desc("cnt"), "first"))  # one row a thread name
    search = F.concat(F.lit(P.SEARCH_SCOPE + ' "'), F.col("thread_name"), F.lit('"'))
    return out.withColumn("rank", rank).withColumn("search", search).drop("first")


def suggested_searches(events: DataFrame, most: int = 8, top_n: int = 10) -> DataFrame:
    """(rank, description, search) drawn from the summary: errors, exceptions, code prefixes, tags and spikes."""
    s = summary(events, top_n)
    scope = P.SEARCH_SCOPE
    generic = s.agg(F.lit(0).alias("part"), F.lit(0).alias("pos"), F.lit("All errors and severe events").alias("description"), F.lit(scope + " (ERROR OR SEVERE OR FATAL)").alias("search"))
    short = T.short_exception(F.col("key"))
    exceptions = s.where("dim = 'exception' and rank <= 3").select(
        F.lit(1).alias("part"),
        F.col("rank").alias("pos"),
        F.concat(F.lit("Events matching "), short, F.lit(" ("), F.col("cnt").cast("string"), F.lit(" seen)")).alias("description"),
        F.concat(F.lit(scope + ' "'), short, F.lit('"')).alias("search"),
    )
    prefix = s.where("dim = 'code' and rank <= 5").groupBy(T.code_prefix(F.col("key")).alias("p")).agg(F.min("rank").alias("pos"))
    prefix = prefix.withColumn("n", F.row_number().over(W.orderBy("pos"))).where("n <= 3")  # five rows at most
    codes = prefix.select(
        F.lit(2).alias("part"),
        "pos",
        F.concat(F.lit("All "), F.col("p"), F.lit("* message codes")).alias("description"),
        F.concat(F.lit(scope + ' "'), F.col("p"), F.lit('*"')).alias("search"),
    )
    known = F.create_map(*(x for t, (d, q) in P.TAG_SEARCHES.items() for x in (F.lit(t), F.struct(F.lit(d).alias("d"), F.lit(f"{scope} {q}").alias("q")))))
    tags = s.where(F.col("dim") == "tag").select("rank", known[F.col("key")].alias("t")).where("t is not null")
    tags = tags.select(F.lit(3).alias("part"), F.col("rank").alias("pos"), F.col("t.d").alias("description"), F.col("t.q").alias("search"))
    _, hour, minute = ts_parts(F.col("ts"))
    spike = events.where(hour.isNotNull() & minute.isNotNull()).select("ts").limit(1).select(
        F.lit(4).alias("part"),
        F.lit(0).alias("pos"),
        F.lit("Error spike timeline (adjust span to match your bucket size)").alias("description"),
        F.lit(scope + " (ERROR OR SEVERE OR FATAL) | timechart span=1m count by sourcetype").alias("search"),
    )
    every = generic.unionByName(exceptions).unionByName(codes).unionByName(tags).unionByName(spike)
    rank = F.row_number().over(W.orderBy("part", "pos"))  # a dozen rows
    return every.withColumn("rank", rank).where(F.col("rank") <= most).select("rank", "description", "search")


def incident_window(events: DataFrame, seconds: int = 30) -> DataFrame:
    """Events within ``seconds`` of the first error in list order, with their offset; the trigger is one row."""
    parsed = events.where("ts_dt is not null")
    trigger = parsed.where(T.is_error(F.col("level"))).agg(F.min(F.struct(*order(events), "ts_dt")).alias("t")).where("t is not null")
    trigger = trigger.select(F.lit(1).alias("one"), F.col("t.file").alias("t_file"), F.col("t.event_seq").alias("t_seq"), F.col("t.ts_dt").alias("t_dt"))
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    offset = (micros(F.col("ts_dt")) - micros(F.col("t_dt"))) / 1e6
    return (
        parsed.withColumn("one", F.lit(1))
        .join(F.broadcast(trigger), "one")
        .withColumn("offset_seconds", offset)
        .where(F.col("offset_seconds").between(-seconds, seconds))
        .withColumn("is_trigger", (F.col("file") == F.col("t_file")) & (F.col("event_seq") == F.col("t_seq")))
        .drop("one", "t_file", "t_seq", "t_dt")
    )


def dedup_events(events: DataFrame) -> DataFrame:
    """The first event of each (level, code, exception), nulls equal.  Aggregated, so a frequent triple is no hot group."""
    rest = [c for c in events.columns if c not in ("level", "code", "exception")]
    first = events.groupBy("level", "code", "exception").agg(F.min_by(F.struct(*rest), at(events)).alias("r"))
    return first.select("level", "code", "exception", "r.*").select(*events.columns)


def score_events(events: DataFrame) -> DataFrame:
    return events.withColumn("score", T.priority(F.col("level"), F.col("exception"), F.col("code"), F.col("tags")))


def pick_samples(events: DataFrame, most: int = 5) -> DataFrame:
    """The most telling events, one for each (level, code, exception)."""
    scored = score_events(dedup_events(events))
    rank = F.row_number().over(W.orderBy(F.desc("score"), *order(events)))
    return scored.orderBy(F.desc("score"), *order(events)).limit(most).withColumn("rank", rank)


def last_lines(lines: DataFrame, most: int = 300, contains: str | None = None) -> DataFrame:
    """The last ``most`` lines of each file that are not blank and hold the given text."""
    own = lines.where(~F.col("line").rlike(r"^\s*$"))
    if contains is not None:
        own = own.where(F.col("line").contains(contains))
    rank = F.row_number().over(W.partitionBy("file").orderBy(F.desc("line_no")))
    return own.withColumn("back", rank).where(F.col("back") <= most).drop("back")


def keep_last_n(rows: DataFrame, order: str, most: int) -> DataFrame:
    """The ``most`` rows inserted last."""
    return rows.orderBy(F.desc(order)).limit(most)


def append_distinct(history: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """History and those new rows whose keys it does not hold yet."""
    return history.unionByName(new.join(history.select(*keys), keys, "left_anti"))


def triage_report(events: DataFrame, top_n: int = 10, samples: int = 5, minutes: int = 1) -> DataFrame:
    """One row: a JSON object of files, totals, ranked summaries, causes with their fixes, searches, hung threads, timeline and
    samples: the whole analysis of a set of logs.

    Every part is ranked or grouped before it is gathered; what is gathered grows with the files, the threads that hung and
    the buckets only.
    """
    options = {"ignoreNullFields": "false"}

    def listed(name: str, df: DataFrame, order: str, fields: list) -> DataFrame:
        rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(*fields).alias("x"))))
        return df.agg(F.to_json(F.transform(rows, lambda r: r["x"]), options).alias("part")).select(F.lit(name).alias("name"), "part")

    ranks = summary(events, top_n)
    entry = lambda r: F.concat(F.to_json(F.array(r["key"])), F.lit(":"), r["cnt"].cast("string"))
    counted = ranks.groupBy("dim").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "cnt"))).alias("rows"))
    # a key in quotes is what an array of it holds
    maps = F.array_join(F.transform("rows", lambda r: F.regexp_replace(entry(r), r"^\[(?s)(.*)\]:", "$1:")), ",")
    counted = counted.select(F.col("dim").alias("name"), F.concat(F.lit("{"), maps, F.lit("}")).alias("part"))
    picked = pick_samples(events, samples)
    stack = F.filter(F.split("stack_sample", "\n", -1), lambda x: x != "")
    every = (
        listed("files", per_file(events), "file", ["file", F.col("total").alias("events"), "errors"])
        .unionByName(total_events(events).select(F.lit("total_events").alias("name"), F.col("total_events").cast("string").alias("part")))
        .unionByName(counted)
        .unionByName(listed("causes", likely_causes(events), "rank", ["id", "title", F.col("cnt").alias("count"), "cause", "fixes"]))
        .unionByName(listed("searches", suggested_searches(events, top_n=top_n), "rank", ["description", F.col("search").alias("query")]))
        .unionByName(listed("hung", hung_threads(events), "rank", ["thread_name", F.col("cnt").alias("count"), "first_ts", "last_ts", "hex_ids", stack.alias("stack_sample"), F.col("search").alias("splunk_query")]))
        .unionByName(listed("timeline", time_histogram(events, minutes), "bucket", ["bucket", "total", "errors"]))
        .unionByName(listed("samples", picked, "rank", ["level", "thread_id", "code", "exception", "root_cause", "ts", "tags", T.sample_text(F.col("text")).alias("text")]))
    )
    parts = every.agg(F.map_from_entries(F.collect_list(F.struct("name", "part"))).alias("p"))
    part = lambda title, name, none="{}": F.concat(F.lit(f'"{title}":'), F.coalesce(F.col("p")[name], F.lit(none)))
    fields = [
        part("files", "files"), part("total_events", "total_events"), part("levels", "level"), part("codes", "code"), part("exceptions", "exception"), part("tags", "tag"),
        part("likely_causes", "causes"), part("splunk_queries", "searches"), part("hung_thread_drilldown", "hung"), part("timeline", "timeline"), part("samples", "samples"),
    ]
    return parts.select(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")).alias("report"))


def top_sketches(events: DataFrame, dim: str, most_items: int = 10_000) -> DataFrame:
    """(day, sketch): for each day the frequent keys of one dimension (level, code or exception), to be stored and combined later.

    A sketch tracks ``most_items`` keys at most.  With fewer distinct keys its counts are exact; else each is wrong by no more
    than the day's events divided by 0.75 x ``most_items``, and keys whose counts are within that may be left out.  Undated events stand under a null day.
    """
    key = F.coalesce("level", F.lit("UNKNOWN")) if dim == "level" else F.col(dim)
    rows = events.select(F.to_date("ts_dt").alias("day"), key.alias("key")).where("key is not null")
    return rows.groupBy("day").agg(F.expr(f"approx_top_k_accumulate(key, {most_items})").alias("sketch"))


def top_of_sketches(sketches: DataFrame, most: int = 10, most_items: int = 10_000) -> DataFrame:
    """(key, cnt, rank) of the most frequent keys over the days whose sketches are given; the days' errors add up.

    Ties go by key, as sketches do not know what came first, so more than ``most`` are asked for and then ranked.
    """
    one = sketches.groupBy(F.lit(1).alias("one")).agg(F.expr(f"approx_top_k_combine(sketch, {most_items})").alias("s"))  # no row of none
    found = one.select(F.explode(F.expr(f"approx_top_k_estimate(s, {min(most_items, 100 * most)})")).alias("x"))
    rank = F.row_number().over(W.orderBy(F.desc("cnt"), "key"))  # a hundred times ``most`` rows
    return found.select(F.col("x.item").alias("key"), F.col("x.count").alias("cnt")).withColumn("rank", rank).where(F.col("rank") <= most)
