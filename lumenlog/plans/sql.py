"""DuckDB SQL of the events table: rendered lines, block assembly, redaction and classification."""

from __future__ import annotations

from ..functions import patterns as P
from ..sources.rendered import DUCK_LINES


def lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def found(text: str, pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract({text}, {lit(pattern)}, {group}), '')"


def extract_ts(line: str) -> str:
    return f"coalesce({found(line, P.TS_CLASSIC)}, {found(line, P.TS_ISO)})"


def matches(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def redact(text: str) -> str:
    for pattern, to in P.REDACTIONS:
        text = f"regexp_replace({text}, {lit(pattern)}, {lit(to.replace('$1', chr(92) + '1'))}, 'g')"
    return text


def level(text: str) -> str:
    letter = f"regexp_extract({text}, {lit(P.LEVEL_LETTER)}, 1)"
    named = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LEVEL_NAMES.items())
    return f"CASE WHEN {letter} <> '' THEN CASE {letter} {named} END ELSE upper({found(text, P.LEVEL_WORD)}) END"


def tags(text: str) -> str:
    parts = ", ".join(f"CASE WHEN {matches(text, p)} THEN '{t}' END" for t, p in P.TAGS.items())
    return f"list_filter([{parts}], lambda x: x IS NOT NULL)"


def root_cause(text: str) -> str:
    return f"list_extract(regexp_extract_all({text}, {lit('(?m)' + P.ROOT_CAUSE)}, 1), -1)"


def parse_ts(ts: str) -> str:
    ts = f"regexp_replace({ts}, '\\s+', ' ', 'g')"
    iso = f"replace(replace({ts}, 'T', ' '), ',', '.')"
    classic = f"regexp_replace({ts}, ':(\\d{{3}})$', '.\\1')"
    shape = lambda p: f"regexp_matches({ts}, '{p}')"
    return (
        f"CASE WHEN {shape('^[0-9]+/[0-9]+/[0-9]{2} ')} THEN try_strptime({classic}, '%m/%d/%y %H:%M:%S.%g') "
        f"WHEN {shape('^[0-9]+/[0-9]+/[0-9]{4} ')} THEN try_strptime({classic}, '%m/%d/%Y %H:%M:%S.%g') "
        f"WHEN {shape('^[0-9]+-.*:[0-9]{2}$')} AND NOT {shape(':[0-9]{2}:[0-9]{2}:')} THEN try_strptime({iso}, '%Y-%m-%d %H:%M:%S') "
        f"WHEN {shape('^[0-9]+-.*[.,][0-9]+$')} THEN try_strptime({iso}, '%Y-%m-%d %H:%M:%S.%f') END"
    )


BLOCKS = f"""
marked AS (
  SELECT *, {extract_ts("line")} AS ts, {matches("line", P.STACK_LINE)} OR {matches("line", P.CAUSED_BY)} AS k, regexp_matches(line, '^\\s*$') AS b FROM lines),
flagged AS (SELECT *, ts IS NOT NULL AND NOT k AS a FROM marked),
behind AS (
  SELECT *, coalesce(max(CASE WHEN a THEN line_no END) OVER w, -1) AS la, coalesce(max(CASE WHEN k THEN line_no END) OVER w, -1) AS lk,
         coalesce(max(CASE WHEN b THEN line_no END) OVER w, -1) AS lb
  FROM flagged WINDOW w AS (PARTITION BY file ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
closed AS (SELECT *, b AND lk > greatest(la, lb) AS close FROM behind),
counted AS (SELECT *, CAST(sum(CASE WHEN a OR close THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY line_no) AS BIGINT) AS gid FROM closed),
blocks AS (SELECT file, line_no, line, ts, gid FROM counted WHERE NOT close)
"""
KEPT = """
first_gid AS (SELECT file, min(gid) AS first_gid FROM blocks WHERE ts IS NOT NULL GROUP BY file),
kept AS (SELECT blocks.* FROM blocks JOIN first_gid USING (file) WHERE gid >= first_gid)
"""
JOINED = f"""
joined AS (
  SELECT file, gid AS event_seq, arg_min(ts, line_no) FILTER (WHERE ts IS NOT NULL) AS ts, string_agg(line, chr(10) ORDER BY line_no) AS raw_text
  FROM kept GROUP BY file, gid),
redacted AS (SELECT file, event_seq, ts, raw_text, {redact("raw_text")} AS text FROM joined)
"""
EVENTS = f"""
ev AS MATERIALIZED (
  SELECT file, event_seq, ts, {parse_ts("ts")} AS ts_dt, {level("text")} AS level, {found("text", P.THREAD)} AS thread_id, {found("text", P.CODE)} AS code,
         {found("text", P.EXCEPTION)} AS exception, {root_cause("text")} AS root_cause, {tags("text")} AS tags, text
  FROM redacted)
"""
WITH_LINES = "WITH " + DUCK_LINES
WITH_BLOCKS = WITH_LINES + "," + BLOCKS
WITH_EVENTS = WITH_BLOCKS + "," + KEPT + "," + JOINED + "," + EVENTS
