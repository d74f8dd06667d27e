"""Queries over the events table: summaries, histograms, causes, samples, incident window."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..operators import summary as A
from ..storage import store
from . import sql as S
from .events_queries import events, lines, table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def add(name: str, f, oracle: str | None = None) -> None:
    QUERIES[name] = f
    if oracle:
        ORACLES[name] = S.WITH_EVENTS + oracle


ERROR = "coalesce(level IN ('ERROR', 'SEVERE', 'FATAL'), false)"
KEYS = """, keyed AS (
  SELECT file, event_seq, 'level' AS dim, coalesce(level, 'UNKNOWN') AS key FROM ev UNION ALL
  SELECT file, event_seq, 'code', code FROM ev WHERE code IS NOT NULL UNION ALL
  SELECT file, event_seq, 'exception', exception FROM ev WHERE exception IS NOT NULL UNION ALL
  SELECT file, event_seq, 'tag', unnest(tags) FROM ev),
counts AS (SELECT dim, key, count(*) AS cnt, min((file, event_seq)) AS first FROM keyed GROUP BY dim, key),
summary AS (SELECT dim, key, cnt, CAST(row_number() OVER (PARTITION BY dim ORDER BY cnt DESC, first, key) AS INT) AS rank FROM counts)
"""

add("total_events", lambda s, d: A.total_events(events(s, d)), "SELECT count(*) AS total_events FROM ev")
add("error_count", lambda s, d: A.error_count(events(s, d)), f"SELECT count(*) FILTER ({ERROR}) AS errors FROM ev")
add("summary", lambda s, d: A.summary(events(s, d)), KEYS + "SELECT dim, key, cnt, rank FROM summary WHERE rank <= 10")
for _name, _dim in (("top_levels", "level"), ("top_codes", "code"), ("top_exceptions", "exception"), ("top_tags", "tag")):
    add(_name, lambda s, d, dim=_dim: A.top(events(s, d), dim), KEYS + f"SELECT key, cnt, rank FROM summary WHERE dim = '{_dim}' AND rank <= 10")
add(
    "top_codes_by_sketch",
    lambda s, d: A.top_of_sketches(store(A.top_sketches(events(s, d), "code"), "sketches")),
    "SELECT code AS key, count(*) AS cnt, CAST(row_number() OVER (ORDER BY count(*) DESC, code) AS INT) AS rank FROM ev WHERE code IS NOT NULL GROUP BY code QUALIFY rank <= 10",
)
add(
    "headline_metrics",
    lambda s, d: A.headline_metrics(events(s, d)),
    f"SELECT count(*) AS events, count(*) FILTER ({ERROR}) AS errors, count(*) FILTER (level = 'WARNING') AS warnings, count(DISTINCT code) AS codes FROM ev",
)
add("per_file", lambda s, d: A.per_file(events(s, d)), f"SELECT file, count(*) AS total, count(*) FILTER ({ERROR}) AS errors FROM ev GROUP BY file")
HIST = """, timed AS (
  SELECT split_part(replace(ts, 'T', ' '), ' ', 1) AS date, CAST(regexp_extract(ts, '(\\d{2}):(\\d{2})', 1) AS INT) * 60 + CAST(regexp_extract(ts, '(\\d{2}):(\\d{2})', 2) AS INT) AS m, level
  FROM ev WHERE ts IS NOT NULL)
"""
add(
    "time_histogram",
    lambda s, d: A.time_histogram(events(s, d), 7),
    HIST + f", n AS (SELECT count(DISTINCT date) AS dates FROM timed) SELECT CASE WHEN dates > 1 THEN date || ' ' ELSE '' END || printf('%02d:%02d', m // 7 * 7 // 60, m // 7 * 7 % 60) AS bucket, "
    f"count(*) AS total, count(*) FILTER ({ERROR}) AS errors FROM timed, n GROUP BY ALL",
)
_rules = " UNION ALL ".join(
    f"SELECT {i} AS rule, '{k}' AS id, {S.lit(t)} AS title, count(*) FILTER ({S.matches('text', p)}) AS cnt, {S.lit(P.CAUSE_TEXTS[k][0])} AS cause, [{', '.join(map(S.lit, P.CAUSE_TEXTS[k][1]))}] AS fixes FROM ev"
    for i, (k, t, p) in enumerate(P.CAUSES)
)
CAUSES = f"causes AS (SELECT id, title, cnt, cause, fixes, CAST(row_number() OVER (ORDER BY cnt DESC, rule) AS INT) AS rank FROM ({_rules}) WHERE cnt > 0)"
add(
    "likely_causes",
    lambda s, d: A.likely_causes(events(s, d)).withColumn("fixes", F.array_join("fixes", "\n")),
    ", " + CAUSES + " SELECT id, title, cnt, cause, array_to_string(fixes, chr(10)) AS fixes, rank FROM causes",
)
_name_sql = "coalesce(" + ", ".join(S.found("text", P.HUNG_NAME, i) for i in (1, 2, 3, 4)) + ", '0x' || thread_id, 'unknown')"
_stack = f"list_filter(string_split(text, chr(10)), lambda x: {S.matches('x', P.STACK_LINE)} OR {S.matches('x', P.CAUSED_BY)})[1:5]"
add(
    "hung_threads",
    lambda s, d: A.hung_threads(events(s, d)).withColumn("hex_ids", F.array_join("hex_ids", ",")),
    f", hung AS (SELECT file, event_seq, ts, thread_id, {_name_sql} AS thread_name, array_to_string(list_transform({_stack}, lambda x: trim(x, ' ' || chr(9))), chr(10)) AS stack "
    f"FROM ev WHERE {S.matches('text', P.TAGS['HungThreads'])}), "
    "g AS (SELECT thread_name, count(*) AS cnt, arg_min(ts, (file, event_seq)) FILTER (ts IS NOT NULL) AS first_ts, arg_max(ts, (file, event_seq)) FILTER (ts IS NOT NULL) AS last_ts, "
    "coalesce(string_agg(DISTINCT thread_id, ',' ORDER BY thread_id), '') AS hex_ids, coalesce(arg_min(stack, (file, event_seq)) FILTER (stack <> ''), '') AS stack_sample, min((file, event_seq)) AS first FROM hung GROUP BY thread_name) "
    f"SELECT thread_name, cnt, first_ts, last_ts, hex_ids, stack_sample, CAST(row_number() OVER (ORDER BY cnt DESC, first) AS INT) AS rank, '{P.SEARCH_SCOPE} \"' || thread_name || '\"' AS search FROM g",
)
_known = " UNION ALL ".join(f"SELECT {S.lit(t)} AS key, {S.lit(x)} AS description, {S.lit(P.SEARCH_SCOPE + ' ' + q)} AS search" for t, (x, q) in P.TAG_SEARCHES.items())
SUGGESTED = f"""
known AS ({_known}),
prefixed AS (SELECT regexp_extract(key, '^[A-Z]+', 0) AS p, min(rank) AS pos FROM summary WHERE dim = 'code' AND rank <= 5 GROUP BY 1 ORDER BY pos LIMIT 3),
parts AS (
  SELECT 0 AS part, 0 AS pos, 'All errors and severe events' AS description, '{P.SEARCH_SCOPE} (ERROR OR SEVERE OR FATAL)' AS search UNION ALL
  SELECT 1, rank, 'Events matching ' || regexp_extract(key, '[^.]*$', 0) || ' (' || cnt || ' seen)', '{P.SEARCH_SCOPE} "' || regexp_extract(key, '[^.]*$', 0) || '"' FROM summary WHERE dim = 'exception' AND rank <= 3 UNION ALL
  SELECT 2, pos, 'All ' || p || '* message codes', '{P.SEARCH_SCOPE} "' || p || '*"' FROM prefixed UNION ALL
  SELECT 3, rank, description, search FROM summary JOIN known USING (key) WHERE dim = 'tag' AND rank <= 10 UNION ALL
  SELECT 4, 0, 'Error spike timeline (adjust span to match your bucket size)', '{P.SEARCH_SCOPE} (ERROR OR SEVERE OR FATAL) | timechart span=1m count by sourcetype' WHERE EXISTS (SELECT 1 FROM ev WHERE ts IS NOT NULL)),
suggested AS (SELECT CAST(row_number() OVER (ORDER BY part, pos) AS INT) AS rank, description, search FROM parts)
"""
add("suggested_searches", lambda s, d: A.suggested_searches(events(s, d)), KEYS + "," + SUGGESTED + "SELECT rank, description, search FROM suggested WHERE rank <= 8")
INCIDENT = f""", trigger AS (SELECT file AS f, event_seq AS s, ts_dt AS t FROM ev WHERE {ERROR} AND ts_dt IS NOT NULL ORDER BY file, event_seq LIMIT 1)
SELECT file, event_seq, ts_dt, level, code, (epoch_us(ts_dt) - epoch_us(t)) / 1e6 AS offset_seconds, file = f AND event_seq = s AS is_trigger
FROM ev, trigger WHERE ts_dt IS NOT NULL AND abs(epoch_us(ts_dt) - epoch_us(t)) <= 3600000000
"""
add("incident_window", lambda s, d: A.incident_window(events(s, d), 3600).select("file", "event_seq", "ts_dt", "level", "code", "offset_seconds", "is_trigger"), INCIDENT)
UNIQUE = ", uniq AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY level, code, exception ORDER BY file, event_seq) = 1)"
SCORE = (
    "(CASE WHEN level = 'FATAL' THEN 4 WHEN level IN ('ERROR', 'SEVERE') THEN 3 WHEN level IN ('WARNING', 'WARN') THEN 1 ELSE 0 END "
    "+ CASE WHEN exception IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN code IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN len(tags) > 0 THEN 1 ELSE 0 END)"
)
add("dedup_events", lambda s, d: A.dedup_events(events(s, d)).select("file", "event_seq", "level", "code", "exception"), UNIQUE + "SELECT file, event_seq, level, code, exception FROM uniq")
add("score_events", lambda s, d: A.score_events(events(s, d)).select("file", "event_seq", "score"), f"SELECT file, event_seq, {SCORE} AS score FROM ev")
add(
    "pick_samples",
    lambda s, d: A.pick_samples(events(s, d), 5).select("rank", "file", "event_seq", "score"),
    UNIQUE + f" SELECT CAST(row_number() OVER (ORDER BY {SCORE} DESC, file, event_seq) AS INT) AS rank, file, event_seq, {SCORE} AS score FROM uniq QUALIFY rank <= 5",
)
QUERIES["last_lines"] = lambda s, d: A.last_lines(lines(s, d), 100, " E ").select("file", "line_no", "line")
ORACLES["last_lines"] = (
    S.WITH_LINES + "SELECT file, line_no, line FROM lines WHERE NOT regexp_matches(line, '^\\s*$') AND contains(line, ' E ') QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no DESC) <= 100"
)
QUERIES["keep_last_n"] = lambda s, d: A.keep_last_n(table(s, d, "events").select("event_id", "event_type"), "event_id", 50)
ORACLES["keep_last_n"] = "SELECT event_id, event_type FROM events ORDER BY event_id DESC LIMIT 50"


def append_distinct(spark, sf_dir):
    """Even conversations are history and all others new, also those without a number."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "role", "text").distinct()
    old = F.coalesce(F.col("conv_id") % 2 == 0, F.lit(False))
    return A.append_distinct(turns.where(old), turns.where(~old), ["role", "text"])


QUERIES["append_distinct"] = append_distinct
ORACLES["append_distinct"] = """
WITH t AS (SELECT DISTINCT conv_id, role, text, coalesce(conv_id % 2 = 0, false) AS old FROM conversations)
SELECT conv_id, role, text FROM t WHERE old UNION ALL
SELECT conv_id, role, text FROM t WHERE NOT old AND NOT EXISTS (SELECT 1 FROM t AS o WHERE o.old AND o.role = t.role AND o.text = t.text)
"""
_hist = "SELECT CASE WHEN dates > 1 THEN date || ' ' ELSE '' END || printf('%02d:%02d', m // 60, m % 60) AS bucket, count(*) AS total, count(*) FILTER (" + ERROR + ") AS errors FROM timed, (SELECT count(DISTINCT date) AS dates FROM timed) GROUP BY ALL"
_dims = "'{' || (SELECT coalesce(string_agg(CAST(to_json(key) AS VARCHAR) || ':' || cnt, ',' ORDER BY rank), '') FROM summary WHERE dim = '%s' AND rank <= 10) || '}'"
_listed = lambda fields, source, order: f"(SELECT CAST(to_json(coalesce(list({{{', '.join(fields)}}} ORDER BY {order}), [])) AS VARCHAR) FROM {source})"
_same = lambda *names: [f"'{n}': {n}" for n in names]
_pairs = (
    ("files", _listed(["'file': file", "'events': total", "'errors': errors"], f"(SELECT file, count(*) AS total, count(*) FILTER ({ERROR}) AS errors FROM ev GROUP BY file)", "file")),
    ("total_events", "(SELECT CAST(count(*) AS VARCHAR) FROM ev)"),
    ("levels", _dims % "level"), ("codes", _dims % "code"), ("exceptions", _dims % "exception"), ("tags", _dims % "tag"),
    ("likely_causes", _listed([*_same("id", "title"), "'count': cnt", *_same("cause", "fixes")], "causes", "rank")),
    ("splunk_queries", _listed([*_same("description"), "'query': search"], "(SELECT * FROM suggested WHERE rank <= 8)", "rank")),
    (
        "hung_thread_drilldown",
        _listed(
            [*_same("thread_name"), "'count': cnt", *_same("first_ts", "last_ts", "hex_ids"), "'stack_sample': list_filter(string_split(stack_sample, chr(10)), lambda x: x <> '')", "'splunk_query': search"],
            "hungs",
            "rank",
        ),
    ),
    ("timeline", _listed(_same("bucket", "total", "errors"), f"({_hist})", "bucket")),
    ("samples", _listed([*_same("level", "thread_id", "code", "exception", "root_cause", "ts", "tags"), "'text': substring(text, 1, 4000)"], "picked", "rank")),
)
_hungs = ORACLES["hung_threads"][len(S.WITH_EVENTS) :].replace("coalesce(string_agg(DISTINCT thread_id, ',' ORDER BY thread_id), '')", "coalesce(list_sort(list(DISTINCT thread_id) FILTER (thread_id IS NOT NULL)), [])")
_hungs = _hungs.replace(" SELECT thread_name, cnt", ", hungs AS (SELECT thread_name, cnt", 1) + ")"
add(
    "triage_report_json",
    lambda s, d: A.triage_report(events(s, d)),
    KEYS + "," + SUGGESTED + "," + CAUSES + _hungs + HIST + UNIQUE
    + f", picked AS (SELECT *, row_number() OVER (ORDER BY {SCORE} DESC, file, event_seq) AS rank FROM uniq QUALIFY rank <= 5) "
    + "SELECT '{' || " + " || ',' || ".join(f"'\"{t}\":' || {x}" for t, x in _pairs) + " || '}' AS report",
)
