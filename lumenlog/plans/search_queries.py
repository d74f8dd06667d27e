"""Queries over search, rule routing, caches and prompt rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import search as R
from . import sql as S
from .events_queries import events, kept

#: What users asked; the last ones fall through to text or hit nothing.
ASKED = ("SRVE0293E", "srve", "SQLException", "handshake", "CWPKI0022E why?", "stuck thread", "liberty startup & <system>login</system>", "heap space", "no such thing")

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
CODE_START = "^[A-Z]{4,5}[0-9]{4}[A-Z]\\b"
ASKED_SQL = "asked AS (SELECT CAST(i AS BIGINT) AS query_id, q AS query FROM (VALUES " + ", ".join(f"({i}, {S.lit(q)})" for i, q in enumerate(ASKED)) + ") v(i, q))"
HITS = f"""
hits AS (
  SELECT query_id, query, file, event_seq, code, exception, tags, text,
         CASE WHEN regexp_matches(query, '{CODE_START}') AND contains(upper(code), upper(query)) THEN 0
              WHEN contains(lower(exception), lower(query)) THEN 1 WHEN contains(lower(text), lower(query)) THEN 2 END AS priority
  FROM ev, asked),
best AS (SELECT query_id, min(priority) AS priority FROM hits WHERE priority IS NOT NULL GROUP BY query_id),
own AS (SELECT hits.* FROM hits JOIN best USING (query_id, priority)),
found AS (
  SELECT query_id, any_value(CASE priority WHEN 0 THEN 'code' WHEN 1 THEN 'exception' ELSE 'text' END) AS match_type,
         list_sort(list(DISTINCT code) FILTER (code IS NOT NULL)) AS codes, list_sort(list(DISTINCT exception) FILTER (exception IS NOT NULL)) AS exceptions,
         list_sort(list_distinct(flatten(list(tags)))) AS tags
  FROM own GROUP BY query_id),
match AS (
  SELECT query_id, query, match_type, coalesce(codes, CAST([] AS VARCHAR[])) AS codes, coalesce(exceptions, CAST([] AS VARCHAR[])) AS exceptions, coalesce(tags, CAST([] AS VARCHAR[])) AS tags
  FROM asked LEFT JOIN found USING (query_id))
"""
WITH_MATCH = S.WITH_EVENTS + ", " + ASKED_SQL + ", " + HITS


def add(name: str, f, oracle: str | None = None, start: str = WITH_MATCH) -> None:
    QUERIES[name] = f
    if oracle:
        ORACLES[name] = start + oracle


def matches(s, d):
    """One row per question, read several times by what follows."""
    return kept(s, d, "matches", lambda: R.search_events(events(s, d), ASKED))


def _values(rules: dict) -> str:
    return "(VALUES " + ", ".join(f"({S.lit(k)}, {i}, {j}, {S.lit(r)})" for i, (k, names) in enumerate(rules.items()) for j, r in enumerate(names)) + ") v(key, key_ord, pos, rule)"


for _name, _f, _q, _where in (
    ("search_code", R.search_code, "SRVE0293E", "contains(upper(code), 'SRVE0293E')"),
    ("search_exception", R.search_exception, "sqlexception", "contains(lower(exception), 'sqlexception')"),
    ("search_text", R.search_text, "Handler.java", "contains(lower(text), 'handler.java')"),
):
    add(_name, lambda s, d, f=_f, q=_q: f(events(s, d), q).select("file", "event_seq"), f"SELECT file, event_seq FROM ev WHERE {_where}", S.WITH_EVENTS)


def search_events(s, d):
    top = F.array_join(F.transform("events", lambda e: F.concat_ws(":", e["file"], e["event_seq"])), ",")
    return matches(s, d).select("query_id", "match_type", *(F.array_join(c, ",").alias(c) for c in ("codes", "exceptions", "tags")), F.coalesce(top, F.lit("")).alias("first_events"))


add(
    "search_events",
    search_events,
    ", firsts AS (SELECT query_id, string_agg(file || ':' || event_seq, ',' ORDER BY file, event_seq) AS first_events FROM (SELECT * FROM own QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY file, event_seq) <= 3) GROUP BY query_id) "
    "SELECT query_id, match_type, array_to_string(codes, ',') AS codes, array_to_string(exceptions, ',') AS exceptions, array_to_string(tags, ',') AS tags, coalesce(first_events, '') AS first_events FROM match LEFT JOIN firsts USING (query_id)",
)
PREFIXES = f"""
coded AS (SELECT DISTINCT code, regexp_extract(code, '^[A-Z]+', 0) AS p FROM ev WHERE code IS NOT NULL),
routed AS (SELECT code, key AS prefix, rule, pos FROM coded, {_values(P.RULES_BY_CODE_PREFIX)} WHERE starts_with(p, key) QUALIFY rank() OVER (PARTITION BY code ORDER BY length(key) DESC) = 1)
"""
add(
    "longest_prefix_route",
    lambda s, d: R.longest_prefix_route(events(s, d).select("code").where("code is not null")),
    ", " + PREFIXES + "SELECT code, prefix, rule, pos FROM routed",
    S.WITH_EVENTS,
)
ROUTES = f"""
, {PREFIXES},
routes AS (
  SELECT query_id, 'tag' AS source, rule, (0, list_position(tags, key) - 1, 0, pos) AS ord FROM match, {_values(P.RULES_BY_TAG)} WHERE list_contains(tags, key) UNION ALL
  SELECT query_id, 'code', rule, (1, list_position(codes, code) - 1, 0, pos) FROM match, routed WHERE list_contains(codes, code) UNION ALL
  SELECT query_id, 'exception', rule, (2, list_position(exceptions, e) - 1, key_ord, pos) FROM (SELECT *, unnest(exceptions) AS e FROM match), {_values(P.RULES_BY_EXCEPTION)} WHERE contains(lower(e), key) UNION ALL
  SELECT query_id, 'word', rule, (3, 0, key_ord, pos) FROM match, {_values(P.RULES_BY_WORD)} WHERE contains(lower(query), key)),
firsts AS (SELECT query_id, rule, min(ord) AS ord FROM routes GROUP BY ALL),
chosen AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY ord) AS INT) AS rank, rule FROM firsts QUALIFY rank <= {P.MOST_RULES}),
selected AS (SELECT query_id, coalesce(rank, 1) AS rank, coalesce(rule, '{P.DEFAULT_RULE}') AS rule FROM asked LEFT JOIN chosen USING (query_id))
"""
add("route_rules", lambda s, d: R.route_rules(matches(s, d)).select("query_id", "source", "rule"), ROUTES + "SELECT query_id, source, rule FROM routes")
add("select_rules", lambda s, d: R.select_rules(matches(s, d)), ROUTES + "SELECT query_id, rank, rule FROM selected")
KEY = "lower(trim(query)) || '|' || array_to_string(codes, ',') || '|' || array_to_string(exceptions, ',') || '|' || array_to_string(tags, ',') || '|' || coalesce(match_type, 'none')"
add("cache_key", lambda s, d: R.cache_keys(matches(s, d)).select("query_id", "cache_key"), f"SELECT query_id, {KEY} AS cache_key FROM match")


add(
    "cache_key_variants",
    lambda s, d: R.cache_keys(matches(s, d), provider="gemini", style="plain").select("query_id", "cache_key"),
    f"SELECT query_id, 'gemini:' || {KEY} || ':plain' AS cache_key FROM match",
)


def prompt_worklist(s, d):
    own = matches(s, d)
    keyed = R.cache_keys(own)
    return R.prompt_worklist(own, keyed.where("query_id % 3 = 0")).select("query_id", "cache_key")


add("prompt_worklist", prompt_worklist, f"SELECT query_id, {KEY} AS cache_key FROM match WHERE query_id % 3 <> 0")


def rule_docs(s, d):
    """Texts of the rules, taken from all turns of the conversations: the least of a rule's share.  One rule has none."""
    names = F.array(*map(F.lit, _names))
    talk = s.read.parquet(f"{d}/conversations.parquet").where("text is not null and conv_id is not null")
    return talk.groupBy(F.get(names, F.pmod("conv_id", F.lit(len(_names))).cast("int")).alias("rule")).agg(F.min("text").alias("text"))


_names = sorted({r for m in (P.RULES_BY_TAG, P.RULES_BY_CODE_PREFIX, P.RULES_BY_EXCEPTION, P.RULES_BY_WORD) for rs in m.values() for r in rs} - {"splunk-query.md"})
DOCS = (
    f", rule_docs AS (SELECT [{', '.join(map(S.lit, _names))}][conv_id % {len(_names)} + 1] AS rule, min(text) AS text FROM conversations WHERE text IS NOT NULL AND conv_id IS NOT NULL GROUP BY 1), "
    "context AS (SELECT query_id, string_agg('--- ' || rule || ' ---' || chr(10) || trim(text), chr(10) || chr(10) ORDER BY rank) AS context FROM selected JOIN rule_docs USING (rule) GROUP BY query_id)"
)
add("rule_context", lambda s, d: R.rule_context(R.select_rules(matches(s, d)), rule_docs(s, d)), ROUTES + DOCS + "SELECT query_id, context FROM context")
_clean = f"replace(replace(replace(regexp_replace(%s, {S.lit(P.DELIMITER_TAGS)}, '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_cut = "CASE WHEN len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) <= 25 THEN text ELSE array_to_string(string_split(regexp_replace(text, '\\n$', ''), chr(10))[1:25], chr(10)) || chr(10) || '...[truncated]...' END"
_line = lambda title, c: f"CASE WHEN len({c}) > 0 THEN '{title}' || array_to_string({c}, ', ') || chr(10) ELSE '' END"
add(
    "prompt_rows",
    lambda s, d: R.prompt_rows(matches(s, d), rule_docs(s, d)),
    ROUTES + DOCS + f""", excerpt AS (
  SELECT query_id, string_agg('<log_excerpt id="' || r || '">' || {_clean % ('(' + _cut + ')')} || '</log_excerpt>' || chr(10), chr(10) ORDER BY r) AS x
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY file, event_seq) AS r FROM own) WHERE r <= 2 GROUP BY query_id),
named AS (SELECT query_id, string_agg(rule, ', ' ORDER BY rank) AS rules FROM selected GROUP BY query_id)
SELECT query_id, '<user_query>' || {_clean % 'query'} || '</user_query>' || chr(10) || chr(10) || CASE WHEN match_type IS NULL
         THEN 'No exact match was found in the current log. Provide general guidance.' || chr(10)
         ELSE '<context>' || chr(10) || {_line('Matching WAS codes: ', 'codes')} || {_line('Matching exceptions: ', 'exceptions')} || {_line('Signal tags: ', 'tags')} || '</context>' || chr(10) || chr(10) || x END AS user_part,
       rules, context
FROM match JOIN named USING (query_id) LEFT JOIN excerpt USING (query_id) LEFT JOIN context USING (query_id)
""",
)
