"""The ``events`` table written as log lines, the input of the registered log queries.

Every event becomes a header line, errors also stack, cause and blank lines, so that all rules of block
assembly and every pattern meet text.  The expressions below are SQL that Spark and DuckDB read alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Events of one file that form a block.
BLOCK_EVENTS = 2000
FILE = "'node' || CAST(user_id % 8 AS STRING) || '.log'"


def case(key: str, values: list[str]) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def quoted(values: list[str]) -> list[str]:
    return ["'" + v.replace("'", "''") + "'" for v in values]


#: Events that all say the same, as health checks do.
NOISE = "event_id % 29 = 0 AND event_type <> 'error'"
LETTER = (
    f"CASE WHEN {NOISE} THEN 'I' ELSE " "CASE event_type WHEN 'error' THEN CASE event_id % 11 WHEN 0 THEN 'F' ELSE 'E' END "
    "WHEN 'view' THEN 'I' WHEN 'click' THEN 'A' WHEN 'signup' THEN 'W' ELSE 'O' END END"
)
WORD = "CASE event_type WHEN 'error' THEN 'SEVERE' WHEN 'view' THEN 'INFO' WHEN 'click' THEN 'debug' WHEN 'signup' THEN 'WARN' ELSE '-' END"
CODE = case(
    "event_id % 13",
    quoted(["SRVE0293E", "SRVE8094W", "WSVR0605W", "CWPKI0022E", "DSRA0080E", "TCPC0001I", "J2CA0045E", "CWWKZ0001I", "SESN0066E", "ARFM5007I", "SRVE0242I", "CWWKE0701E", "WTRN0006W"]),
)
COMPONENT = case("event_id % 4", quoted(["WebContainer", "ThreadMonitor", "TCPChannel", "ServletWrapper"]))
MESSAGE = case(
    "event_id % 23",
    quoted([
        "request done", "connection pool is near its limit", "the peer was refused: PKIX path building failed at host nine", "gave 503 to a HTTP/1.1 caller of /menu",
        "Java heap space is low", "Thread \"WebContainer : 5\" gives no answer", "password=maple7 was taken", "authorization: bearer q1w2.e3r4-5 came in",
        "cfg {\"api_key\": \"k-99\", \"n\": 1}", "store://north;user=ann;pwd=birch4;n=1", "pass eyJuIjox.eyJtIjoy.c2ln was shown", "work was submitted to the Default Executor-thread-42",
        "stuck thread Default Executor-thread-7 in pool", "token: 7f7f7f passed", "Timeout waiting for idle object", "hung thread suspected",
        "java.lang.IllegalStateException: closed", "OutOfMemoryError while allocating", "all well", "", "pool was exhausted", "SRVE 404 from HTTP", "thread 'ORB.thread.pool : 3' is a stuck thread",
    ]),
)
CAUSE = case(
    "event_id % 5",
    quoted(["java.sql.SQLException: no row", "javax.net.ssl.SSLHandshakeException: handshake_failure", "java.lang.NullPointerException", "com.acme.pay.PaymentError: declined", "unknown"]),
)
#: The lines of an event, in order; null ones are left out.
LINES = [
    "CASE WHEN event_id < 40 THEN '************ Start Display Current Environment ************' END",
    "CASE WHEN event_id % 17 = 16 AND NOT ({noise}) THEN iso || ' ' || {word} || ' ' || {code} || ' ' || {message} "
    "ELSE '[' || classic || ' UTC] ' || hex8 || ' ' || {component} || ' ' || {letter} || '   ' || {code} || ': ' || {message} END",
    "CASE WHEN event_type = 'error' AND event_id % 3 < 2 THEN chr(9) || 'at com.acme.web.Handler.run(Handler.java:' || CAST(event_id % 97 AS STRING) || ')' END",
    "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN 'Caused by: ' || {cause} END",
    "CASE WHEN event_type = 'error' AND event_id % 3 = 0 THEN chr(9) || 'at com.acme.db.Pool.take(Pool.java:12)' END",
    "CASE WHEN event_type = 'error' AND event_id % 6 = 0 THEN 'Caused by: java.io.IOException: reset by peer' END",
    "CASE WHEN event_id % 7 = 0 AND NOT ({noise}) THEN '' END",
    "CASE WHEN event_id % 14 = 0 AND NOT ({noise}) THEN 'a line of its own, event ' || CAST(event_id AS STRING) END",
]
CODE, MESSAGE, COMPONENT = (f"CASE WHEN {NOISE} THEN '{x}' ELSE {y} END" for x, y in (("DCSV8050I", CODE), ("view is stable", MESSAGE), ("RmmGroup", COMPONENT)))
LINES = [x.format(noise=NOISE, word=WORD, code=CODE, message=MESSAGE, component=COMPONENT, letter=LETTER, cause=CAUSE) for x in LINES]


def rendered_lines(events: DataFrame) -> DataFrame:
    """(file, block, pos, line) of the events table."""
    out = events.select(
        "event_id",
        "user_id",
        "event_type",
        F.date_format("ts", "MM/dd/yy HH:mm:ss:SSS").alias("classic"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss,SSS").alias("iso"),
        F.lower(F.lpad(F.hex("user_id"), 8, "0")).alias("hex8"),
    )
    lines = F.posexplode(F.expr("array(" + ", ".join(LINES) + ")")).alias("k", "line")
    return (
        out.select("event_id", F.expr(FILE).alias("file"), lines)
        .where("line is not null")
        .select("file", F.expr(f"event_id div {BLOCK_EVENTS}").alias("block"), (F.col("event_id") * len(LINES) + F.col("k")).alias("pos"), "line")
    )


#: The same lines in DuckDB, numbered by file.
DUCK_LINES = f"""
raw AS (
  SELECT event_id, user_id, event_type, strftime(ts, '%m/%d/%y %H:%M:%S:%g') AS classic, strftime(ts, '%Y-%m-%d %H:%M:%S,%g') AS iso,
         lpad(lower(to_hex(user_id)), 8, '0') AS hex8
  FROM events),
listed AS (SELECT event_id, {FILE} AS file, [{", ".join(LINES)}] AS l FROM raw),
spread AS (SELECT event_id, file, unnest(range(1, {len(LINES) + 1})) AS k, unnest(l) AS line FROM listed),
lines AS (SELECT file, row_number() OVER (PARTITION BY file ORDER BY event_id, k) AS line_no, line FROM spread WHERE line IS NOT NULL)
"""
