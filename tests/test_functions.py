"""Fixtures of single lines and events: extraction, redaction, tags, time stamps and text helpers."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import text as T
from lumenlog.functions.time import parse_ts, ts_parts


def values(spark, texts, *columns):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [tuple(r[1:]) for r in frame.select("i", *(c(F.col("t")).alias(f"c{k}") for k, c in enumerate(columns))).orderBy("i").collect()]


def test_time_stamps(spark):
    texts = ["[10/12/15 21:22:04:257 CEST] x", "2025-03-05T12:34:56.789 ERROR x", "none", "x 2025-03-05 12:34:56 [1/2/24 01:02:03:004 UTC] y"]
    assert values(spark, texts, T.extract_ts) == [("10/12/15 21:22:04:257",), ("2025-03-05T12:34:56.789",), (None,), ("1/2/24 01:02:03:004",)]


@pytest.mark.parametrize(
    ("ts", "parsed"),
    [
        ("10/12/15 21:22:04:257", datetime(2015, 10, 12, 21, 22, 4, 257000)),
        ("1/2/2024 01:02:03:004", datetime(2024, 1, 2, 1, 2, 3, 4000)),
        ("1/2/70 00:00:00:000", datetime(1970, 1, 2)),
        ("1/2/68 00:00:00:000", datetime(2068, 1, 2)),
        ("1/2/69 00:00:00:000", datetime(1969, 1, 2)),
        ("1/2/202 00:00:00:000", None),
        ("2025-03-05T12:34:56.789", datetime(2025, 3, 5, 12, 34, 56, 789000)),
        ("2025-03-05 12:34:56,789123", datetime(2025, 3, 5, 12, 34, 56, 789123)),
        ("2025-03-05 12:34:56", datetime(2025, 3, 5, 12, 34, 56)),
        ("2025-03-05 12:34:56:789", None),
        ("13/45/15 21:22:04:257", None),
        (None, None),
    ],
)
def test_parsed_time_stamps(spark, ts, parsed):
    assert values(spark, [ts], parse_ts) == [(parsed,)]


def test_time_parts(spark):
    texts = ["10/12/15 21:22:04:257", "2025-03-05T12:34:56.789", "12:34:56.789", "junk", "10/12/15 25:00:00:000"]
    got = values(spark, texts, *(lambda t, k=k: ts_parts(t)[k] for k in range(3)))
    assert got == [("10/12/15", 21, 22), ("2025-03-05", 12, 34), (None, 12, 34), (None, None, None), (None, None, None)]


def test_level_thread_code(spark):
    texts = [
        "[10/12/15 21:22:13:837 CEST] 00000150 WSX509TrustMa E   CWPKI0022E: SSL failure info",
        "2025-03-05 12:00:00 warn something ABC123X",
        "[t] 0000004e SystemOut     O hello error",
        "nothing here",
    ]
    assert values(spark, texts, T.level, T.thread_id, T.message_code) == [
        ("ERROR", "00000150", "CWPKI0022E"),
        ("WARN", None, None),
        ("STDOUT", "0000004e", None),
        (None, None, None),
    ]


def test_exceptions_and_root_cause(spark):
    text = "x com.acme.BadException: y\n\tat a.b(C.java:1)\nCaused by: java.io.IOException: z\nCaused by: \nCaused by: plain words\n Caused by: a.b.LastError: w"
    assert values(spark, [text, "NullPointerException only"], T.exception, T.root_cause) == [("com.acme.BadException", "a.b.LastError"), (None, None)]


def test_redaction_in_order(spark):
    texts = ["Authorization: Bearer abc.def", "password=hunter2; x", '{"api_key": "k1"}', "token: abc", "pwd=x;y", "eyJhbG.eyJzdWI.sig ok", "plain"]
    got = [x for (x,) in values(spark, texts, T.redact)]
    assert got == ["Authorization: Bearer [REDACTED]", "password=[REDACTED] x", '{"api_key": "[REDACTED]"}', "token=[REDACTED]", "pwd=[REDACTED];y", "[REDACTED_JWT] ok", "plain"]


def test_tags(spark):
    texts = ["PKIX path building failed", "java.lang.OutOfMemoryError", "connection pool; hung thread", "HTTP/1.1 returned 503", "SRVE0255E 404", "none", "pool\nexhausted"]
    got = [x for (x,) in values(spark, texts, T.signal_tags)]
    assert got == [["SSL/TLS"], ["OOM/GC"], ["DB/Pool", "HungThreads"], ["HTTP"], [], [], []]


def test_hung_names_and_stack(spark):
    texts = ['Thread "WebContainer : 5" has', "thread WebContainer : 7 x", "the Default Executor-thread-42", "none"]
    assert [x for (x,) in values(spark, texts, T.hung_thread_name)] == ["WebContainer : 5", "WebContainer : 7", "Default Executor-thread-42", None]
    text = "head\n\tat a.b.C.d(E.java:1)\nCaused by: x\n\tat <init>\n\tat e.f(G.java:2)"
    assert values(spark, [text], T.stack_sample) == [(["at a.b.C.d(E.java:1)", "Caused by: x", "at e.f(G.java:2)"],)]


def test_text_helpers(spark):
    assert values(spark, ["a\nb\nc"], lambda t: T.truncate_lines(t, 2)) == [("a\nb\n...[truncated]...",)]
    assert values(spark, ["a\nb\n"], lambda t: T.truncate_lines(t, 2)) == [("a\nb\n",)]
    assert values(spark, ["<system>a & b</system> <x>"], T.sanitize) == [("a &amp; b &lt;x&gt;",)]
    assert values(spark, ["~~Fix  the `big` thing~~ 30 min ✅", "open | item"], T.normalize, T.is_fixed) == [("fix the big thing", True), ("open item", False)]
    assert values(spark, ["SRVE0293E"], T.code_prefix) == [("SRVE",)]
    label = spark.range(1).select(T.event_label(F.lit("ERROR"), F.lit(None), F.lit("a.b.XError"))).first()[0]
    assert label == "ERROR  XError"
    key = spark.range(1).select(T.cache_key(F.lit(" Q "), F.array(F.lit("b"), F.lit("a")), F.array().cast("array<string>"), F.array(F.lit("t")), F.lit(None).cast("string"))).first()[0]
    assert key == "q|a,b||t|none"
