"""Operators on small event tables: summaries, causes, search, routing, documents, files and streams."""

import gzip
import os
import random
import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import assembly, documents, recipes, search, summary
from lumenlog.sources import files
from lumenlog.streaming import streams

LOG = """[10/12/15 21:22:04:257 CEST] 00000001 A I   ARFM5007I: start
[10/12/15 21:22:10:000 CEST] 00000150 B E   CWPKI0022E: PKIX path building failed a.b.CertException
[10/12/15 21:22:30:000 CEST] 00000151 C E   SRVE0293E: javax.servlet.ServletException: x
[10/12/15 21:22:50:000 CEST] 00000150 B W   WSVR0605W: Thread "WebContainer : 5" may be hung
[10/13/15 00:01:00:000 CEST] 00000152 B W   WSVR0605W: Thread "WebContainer : 5" may be hung
[10/13/15 00:02:00:000 CEST] 00000001 D I   TCPC0001I: connection pool password=abc
[10/13/15 00:02:10:000 CEST] 00000001 D F   OOMX0001F: java.lang.OutOfMemoryError""".split("\n")


@pytest.fixture(scope="module")
def events(spark):
    rows = [("a.log", 0, k, line) for k, line in enumerate(LOG)]
    lines = spark.createDataFrame(rows, "file string, block long, pos long, line string")
    return assembly.events(assembly.number_lines(lines)).persist()


def test_summary_and_ties(events):
    got = {(r.dim, r.key): (r.cnt, r.rank) for r in summary.summary(events).collect()}
    assert got["level", "INFO"] == (2, 1) and got["level", "ERROR"] == (2, 2) and got["level", "FATAL"] == (1, 4)
    assert got["code", "WSVR0605W"] == (2, 1) and got["tag", "HungThreads"] == (2, 2 if got["tag", "SSL/TLS"][0] > 2 else 1)
    assert [r.key for r in summary.top(events, "code", 2).orderBy("rank").collect()] == ["WSVR0605W", "ARFM5007I"]


def test_histogram_over_days_and_one_day(events):
    got = {r.bucket: (r.total, r.errors) for r in summary.time_histogram(events, 7).collect()}
    assert got == {"10/12/15 21:21": (4, 2), "10/13/15 00:00": (3, 1)}
    one = {r.bucket: r.total for r in summary.time_histogram(events.where("ts like '10/12%'"), 5).collect()}
    assert one == {"21:20": 4}
    assert summary.time_histogram(events.where("false")).count() == 0


def test_incident_window(events):
    got = summary.incident_window(events, 20).orderBy("ts_dt", "event_seq").collect()
    assert [(r.code, r.offset_seconds, r.is_trigger) for r in got] == [("ARFM5007I", -5.743, False), ("CWPKI0022E", 0.0, True), ("SRVE0293E", 20.0, False)]
    assert summary.incident_window(events.where("level = 'INFO'")).count() == 0


def test_causes_hung_threads_and_samples(events):
    assert [(r.id, r.cnt) for r in summary.likely_causes(events).orderBy("rank").collect()] == [("hung-threads", 2), ("ssl-trust", 1), ("db-pool", 1), ("oom-gc", 1)]
    hung = summary.hung_threads(events).collect()
    assert [(h.thread_name, h.cnt, h.first_ts, h.last_ts, h.hex_ids) for h in hung] == [("WebContainer : 5", 2, "10/12/15 21:22:50:000", "10/13/15 00:01:00:000", ["00000150", "00000152"])]
    samples = [r.code for r in summary.pick_samples(events, 3).orderBy("rank").collect()]
    assert samples[0] in ("OOMX0001F", "CWPKI0022E", "SRVE0293E") and len(samples) == 3
    assert summary.dedup_events(events).count() == 6


def test_suggested_searches_are_capped(events):
    got = summary.suggested_searches(events).orderBy("rank").collect()
    assert len(got) <= 8 and got[0].description == "All errors and severe events"
    assert [r.rank for r in got] == list(range(1, len(got) + 1))


def test_sketches_by_day_are_combined(spark):
    rng = random.Random(6)
    rows = [(datetime(2024, 1, 1 + k % 3) if k % 7 else None, f"CODE{min(int(rng.expovariate(0.05)), 400)}") for k in range(6000)]
    frame = spark.createDataFrame(rows, "ts_dt timestamp_ntz, code string")
    exact = {r.code: r["count"] for r in frame.groupBy("code").count().collect()}
    for most_items in (1000, 48):
        sketches = summary.top_sketches(frame, "code", most_items)
        assert sketches.count() == 4
        got = summary.top_of_sketches(sketches, 5, most_items).orderBy("rank").collect()
        bound = 0 if most_items == 1000 else 2 * len(rows) / (0.75 * most_items)
        assert got and all(abs(r.cnt - exact[r.key]) <= bound for r in got)
        assert len(got) == 5 or {r.key for r in got} >= {k for k, n in exact.items() if n > bound}
        assert most_items < 1000 or [(r.key, r.cnt) for r in got] == sorted(exact.items(), key=lambda x: (-x[1], x[0]))[:5]
    assert summary.top_of_sketches(summary.top_sketches(frame.where("false"), "code")).count() == 0


def test_report(events):
    import json

    report = json.loads(summary.triage_report(events).first()[0])
    assert list(report) == ["files", "total_events", "levels", "codes", "exceptions", "tags", "likely_causes", "splunk_queries", "hung_thread_drilldown", "timeline", "samples"]
    assert report["total_events"] == 7 and report["files"] == [{"file": "a.log", "events": 7, "errors": 3}]
    assert report["levels"] == {"INFO": 2, "ERROR": 2, "WARNING": 2, "FATAL": 1} and report["codes"]["WSVR0605W"] == 2
    assert set(report["samples"][0]) == {"level", "thread_id", "code", "exception", "root_cause", "ts", "tags", "text"}
    cause, hung = report["likely_causes"][0], report["hung_thread_drilldown"][0]
    assert set(cause) == {"id", "title", "count", "cause", "fixes"} and cause["count"] == 2 and len(cause["fixes"]) == 3
    assert set(report["splunk_queries"][0]) == {"description", "query"}
    assert set(hung) == {"thread_name", "count", "first_ts", "last_ts", "hex_ids", "stack_sample", "splunk_query"} and isinstance(hung["stack_sample"], list)
    assert hung["thread_name"] == "WebContainer : 5" and report["timeline"][0]["bucket"] == "10/12/15 21:22"
    nothing = json.loads(summary.triage_report(events.where("false")).first()[0])
    assert nothing["total_events"] == 0 and nothing["levels"] == {} and nothing["samples"] == []


def test_search_cascade_and_rules(events):
    asked = ["SRVE0293E", "servlet", "pool", "nothing at all", "SRVE0293E why?"]
    rows = search.search_events(events, asked).orderBy("query_id").collect()
    assert [r.match_type for r in rows] == ["code", "exception", "text", None, None]
    assert rows[0].codes == ["SRVE0293E"] and rows[2].tags == ["DB/Pool"]
    chosen = {}
    for r in search.select_rules(search.search_events(events, asked)).orderBy("query_id", "rank").collect():
        chosen.setdefault(r.query_id, []).append(r.rule)
    assert chosen[0] == ["message-codes.md", "servlet-errors.md", "splunk-query.md"]
    assert chosen[3] == ["message-codes.md"] and all(len(x) <= 3 for x in chosen.values())


def test_longest_prefix(spark):
    codes = spark.createDataFrame([("CWWKZ0001I",), ("CWWKE0701E",), ("XXXX0001I",)], "code string")
    got = {(r.code, r.prefix) for r in search.longest_prefix_route(codes).collect()}
    assert got == {("CWWKZ0001I", "CWWKZ"), ("CWWKE0701E", "CWWK")}


REPORT = """intro
## 1. Executive Summary
Key findings requiring attention:
- something long enough
- short
## 2. Code Review Findings
#### B1: Fix the parser
| # | Item |
| 3 | ~~Escape html~~ Done | x |
## Test Coverage
| `parse()` | High |
| Architecture | **A-** |
"""


def test_documents(spark):
    docs = spark.createDataFrame([(1, REPORT), (2, ""), (3, None)], "doc_id long, text string")
    sections = documents.doc_sections(docs)
    assert [r.title for r in sections.orderBy("seq").collect()] == ["Executive Summary", "Code Review Findings", "Test Coverage"]
    found = documents.doc_findings(documents.section_targets(sections)).orderBy("target", "seq").collect()
    assert [(f.id, f.text, f.fixed) for f in found if f.target == "Code Review Findings"] == [("B1", "Fix the parser", False), ("#3", "~~Escape html~~ Done", True)]
    assert [f.text for f in found if f.target == "Executive Summary"] == ["something long enough"]
    assert [(g.label, g.grade, g["class"]) for g in documents.extract_grades(docs).collect()] == [("Architecture", "A-", "good")]


def test_findings_diff(spark):
    old = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", False)], "seq long, norm string, fixed boolean")
    new = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "d", False), (4, "e", True)], "seq long, norm string, fixed boolean")
    got = {(r.norm, r.category) for r in documents.findings_diff(old, new).collect()}
    assert got == {("a", "fixed"), ("b", "remaining"), ("c", "fixed"), ("d", "new")}


def test_embedded_queries(spark):
    text = "Try this:\n**Errors**\n```spl\nindex=APP ERROR\n```\nthen\n```\n-- one\nindex=APP a\n-- two\nindex=APP b | stats count\n```\n```python\nindex=1\n```"
    got = documents.extract_queries(spark.createDataFrame([(1, text)], "doc_id long, text string")).orderBy("block", "part").collect()
    assert [(r.description, r.query) for r in got] == [("Errors", "index=APP ERROR"), ("one", "index=APP a"), ("two", "index=APP b | stats count")]


def test_fixed_crossref(spark):
    findings = spark.createDataFrame([(1, "B1", "x"), (2, None, "parse the time stamps"), (3, None, "escape html"), (4, None, "unrelated work")], "fid long, id string, norm string")
    fixed = spark.createDataFrame([(["B1"], "zz"), ([], "time stamps parse slowly"), ([], "please escape html now")], "ids array<string>, norm string")
    assert sorted(r.fid for r in documents.fixed_crossref(findings, fixed).collect()) == [1, 2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_bytes("\n".join(LOG).encode() + b"\nbad \xff byte\r\nlast")
    with gzip.open(tmp_path / "b.log.gz", "wt") as f:
        f.write("\n".join(LOG))
    (tmp_path / "c.csv").write_text("not a log")
    lines = files.read_numbered(spark, [str(tmp_path)])
    got = {r.file.rsplit("/", 1)[-1]: r.n for r in lines.groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert got == {"a.log": 9, "b.log.gz": 7}
    assert lines.where("line_no = 8").first().line == "bad  byte"
    by = {r.file.rsplit("/", 1)[-1]: r.n for r in assembly.events(lines).groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert by == {"a.log": 7, "b.log.gz": 7}
    (tmp_path / "d.gz").write_bytes(b"plain text\r\nin two lines\n")
    (tmp_path / "empty.gz").write_bytes(b"")
    report = {r.path.rsplit("/", 1)[-1]: r.readable for r in files.ingest_report(spark, [str(tmp_path), str(tmp_path / "none")]).collect()}
    assert report["d.gz"] is False and report["b.log.gz"] is True
    lines = files.read_numbered(spark, [str(tmp_path / "none.log"), str(tmp_path)])  # a missing path is skipped, a mis-named file is text
    assert [r.line for r in lines.where("file like '%/d.gz'").orderBy("line_no").collect()] == ["plain text", "in two lines"]
    assert {r.file.rsplit("/", 1)[-1]: r.n for r in lines.groupBy("file").agg(F.count("*").alias("n")).collect()} == {"a.log": 9, "b.log.gz": 7, "d.gz": 2}
    assert files.read_lines(spark, [str(tmp_path / "none.log")]).count() == 0


def test_damaged_gzip_is_reported(spark, tmp_path, monkeypatch):
    rng, member = random.Random(3), gzip.compress(b"one more member\n")
    whole = gzip.compress("\n".join(f"line {rng.random()}" for _ in range(20_000)).encode())
    broken = bytearray(whole)
    broken[-6] ^= 255  # the checksum at the end
    given = {"whole.gz": whole, "cut.gz": whole[:-20], "early.gz": whole[:3], "bad.gz": bytes(broken), "two.gz": whole + member + b"\0" * 9, "half.gz": whole + member[:-3], "text.gz": b"no gzip\n", "plain.log": b"x"}
    for name, content in given.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(files, "PIECE", 1 << 12)
    got = {r.path.rsplit("/", 1)[-1]: r for r in files.ingest_report(spark, [str(tmp_path)]).collect()}
    assert {k for k, r in got.items() if r.readable} == {"whole.gz", "two.gz", "plain.log"}
    size = len(gzip.decompress(whole))
    assert got["whole.gz"].inflated == size and got["two.gz"].inflated == size + 16 and got["plain.log"].inflated is None
    assert got["cut.gz"].reason == "truncated" and got["cut.gz"].offset == len(whole) - 20 and 0 < got["cut.gz"].inflated <= size
    assert got["half.gz"].reason == "truncated" and got["early.gz"].reason == "truncated" and "check" in got["bad.gz"].reason
    assert got["text.gz"].reason == "not gzip"
    lines = {r.file.rsplit("/", 1)[-1]: r.n for r in files.read_lines(spark, [str(tmp_path)]).groupBy("file").agg(F.count("*").alias("n")).collect()}
    assert lines["whole.gz"] == 20_000 and lines["text.gz"] == 1 and lines.get("cut.gz", 0) < 20_000


def test_plain_lines_by_pieces(tmp_path, monkeypatch):
    import pyarrow as pa

    rng = random.Random(4)
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(files, "PIECE", size)
        for _ in range(40):
            text = "".join(rng.choice(("a", "é", "\n", "\r", "\r\n")) for _ in range(rng.randrange(0, 12)))
            (tmp_path / "t").write_bytes(text.encode())
            want = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            want = want[:-1] if want[-1] == "" else want
            got = [r for b in files.plain_lines([pa.RecordBatch.from_arrays([pa.array([str(tmp_path / "t")])], ["file"])]) for r in b.to_pylist()]
            assert [r["line"] for r in got] == want and [r["pos"] for r in got] == list(range(len(want))), (size, text)


def test_given_order_decides_the_trigger(spark, tmp_path):
    for name, second in (("a.log", 10), ("b.log", 20)):
        (tmp_path / name).write_text(f"[10/12/15 21:22:{second}:000 UTC] 0000001a Web E   SRVE0293E: bad in {name}\n")
    given = lambda *names: files.read_events(spark, [str(tmp_path / "none.log"), *(str(tmp_path / n) for n in names)])
    first = lambda events: summary.incident_window(events).where("is_trigger").first()
    assert [first(given(*names)).file.rsplit("/", 1)[-1] for names in (("a.log", "b.log"), ("b.log", "a.log"))] == ["a.log", "b.log"]
    own = given("b.log", "a.log")
    assert summary.pick_samples(own, 1).first().file.endswith("b.log") and [r.file_ord for r in own.orderBy("file_ord").collect()] == [1, 2]
    assert summary.dedup_events(own).count() == 1 and summary.order(own) == ("file_ord", "file", "event_seq")


def test_file_order_and_blocked_roots(spark, tmp_path):
    for name in ("x/1.log", "x/11.log", "y/1.log"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(name)
    paths = [str(tmp_path / "y"), str(tmp_path / "x" / "1.log"), str(tmp_path / "x" / "11.log")]
    got = files.with_file_order(files.read_lines(spark, paths), paths).collect()
    assert {r.line: r.file_ord for r in got} == {"y/1.log": 0, "x/1.log": 1, "x/11.log": 2}
    assert files.read_lines(spark, paths, blocked=(str(tmp_path / "x"),)).count() == 1
    asked = ["file:///etc/a.log", "/etc/a.log", "/etc", "hdfs://n:1/proc/x/a.txt", "/home/etc/a.log", "/devices/a.out", "/home/a.csv", "/dev/a.log"]
    allowed = spark.createDataFrame([(p,) for p in asked], "p string").where(files.path_allowed(F.col("p"))).collect()
    assert [r.p for r in allowed] == ["/home/etc/a.log", "/devices/a.out"]


def test_events_are_written_by_day(spark, tmp_path, events):
    files.write_events(events, str(tmp_path / "events"))
    back = spark.read.parquet(str(tmp_path / "events"))
    assert back.count() == 7 and back.where("event_date = '2015-10-13'").count() == 3
    files.write_json_report(summary.total_events(events), str(tmp_path / "report"))
    assert spark.read.text(str(tmp_path / "report")).first()[0] == '{"total_events":7}'


def test_growing_files_are_followed(spark, tmp_path):
    from lumenlog.streaming.tail import TailSource

    spark.dataSource.register(TailSource)
    log = tmp_path / "logs" / "a.log"
    log.parent.mkdir()
    log.write_text("one\ntwo\n\nhal")
    (tmp_path / "logs" / "skipped.csv").write_text("no log\n")
    stream = spark.readStream.format("tail").option("path", str(tmp_path / "logs")).option("from", "start").option("maxBytes", "64").load()

    def run():
        query = stream.writeStream.option("checkpointLocation", str(tmp_path / "state")).format("parquet").start(str(tmp_path / "out"))
        query.processAllAvailable()
        return query

    lines = lambda: sorted(r.line for r in spark.read.parquet(str(tmp_path / "out")).collect())
    query = run()
    assert lines() == ["one", "two"]
    with log.open("a") as f:
        f.write("f\n" + "x" * 40 + "\n" + "y" * 40 + "\n")  # more than one poll
    query.processAllAvailable()
    assert lines() == ["half", "one", "two", "x" * 40, "y" * 40]
    log.write_text("new\n")  # truncated
    query.processAllAvailable()
    assert "new" in lines()
    query.stop()
    with log.open("a") as f:
        f.write("after\n")
    query = run()  # goes on where it was
    query.stop()
    assert sorted(lines()) == sorted(["half", "one", "two", "x" * 40, "y" * 40, "new", "after"])


def test_small_splits_give_the_same_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text("\n".join(f"{line} {k}" for k in range(300) for line in LOG))
    whole = [tuple(r) for r in files.read_numbered(spark, [str(tmp_path)]).select("line_no", "line").orderBy("line_no").collect()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
        lines = files.read_numbered(spark, [str(tmp_path)])
        assert lines.select("block").distinct().count() > 5
        assert [tuple(r) for r in lines.select("line_no", "line").orderBy("line_no").collect()] == whole
        assert assembly.events(lines).count() == 2100
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_streamed_events_equal_batch(spark, tmp_path, events):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.1.log").write_text("\n".join(LOG[:3]) + "\n\tat x.y(Z.java:1)\n")
    (source / "a.2.log").write_text("Caused by: q.r.SError: t\n\nloose\n" + "\n".join(LOG[3:]) + "\n[10/14/15 00:00:00:000 UTC] 00000001 Z I end")
    os.utime(source / "a.1.log", (1, 1))  # segments come in the order they were closed in
    stream = streams.stream_events(streams.stream_lines(spark, str(source), files_per_trigger=1))
    run = stream.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).format("parquet").start(str(tmp_path / "out"))
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("event_seq").collect()
    assert len(got) == 8 and [e.text for e in got[3:4]] == ["loose"]
    assert got[2].root_cause == "q.r.SError" and got[2].text.count("\n") == 2
    assert [e.code for e in got if e.text != "loose"] == [e.code for e in events.orderBy("event_seq").collect()]


def in_runs(spark, tmp_path, batches, schema, start, mode="update"):
    """Streams each batch in a run of its own, from the checkpoint of the one before, into a sink of versions."""
    for rows in batches:
        spark.createDataFrame(rows, schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = start(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        query = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state"))
        query.foreachBatch(streams.versions_writer(str(tmp_path / "out"))).start().awaitTermination()


def test_last_lines_of_a_stream(spark, tmp_path):
    rows = lambda seg, *lines: [("f", seg, k, x) for k, x in enumerate(lines)]
    schema = "file string, seg long, pos long, line string"
    batches = [rows(1, "c", "d", "  "), rows(0, "a", "", "b"), [("g", 0, 0, "x")], rows(2, "e")]
    in_runs(spark, tmp_path, batches, schema, lambda s: streams.stream_last_lines(s, 2))
    got = streams.latest_versions(spark, str(tmp_path / "out"), ["file"]).orderBy("file", "seg", "pos").collect()
    assert [(r.file, r.line) for r in got] == [("f", "d"), ("f", "e"), ("g", "x")]
    kept = spark.read.parquet(str(tmp_path / "out"))
    assert kept.where("batch = 1").count() == 0 and kept.where("batch = 2").count() == 1  # only files with new last lines are written


def test_a_batch_that_is_run_again_is_one_version(spark, tmp_path):
    keep = streams.versions_writer(str(tmp_path / "out"))
    rows = lambda *r: spark.createDataFrame(r, "k string, n long")
    keep(rows(("a", 1), (None, 1)), 0)
    for _ in range(2):
        keep(rows(("a", 2), ("b", 1)), 1)
    assert {(r.k, r.n) for r in streams.latest_versions(spark, str(tmp_path / "out"), ["k"]).collect()} == {("a", 2), ("b", 1), (None, 1)}


def test_late_rows_are_counted(spark, tmp_path):
    line = lambda h, m: ("f", f"[10/12/15 {h:02}:{m:02}:10:000 UTC] 0000001a Web E   SRVE0293E: bad")
    keep = streams.histogram_writer(str(tmp_path / "out"), 3600, 3600)
    rows = lambda *r: spark.createDataFrame(r, "file string, line string")
    keep(rows(line(1, 0), line(5, 30), ("f", "no time")), 0)
    for _ in range(2):  # a batch that is run again
        keep(rows(line(2, 59), line(3, 59), line(4, 0), line(9, 0)), 1)
    keep(rows(line(5, 0)), 2)
    got = {r.start.hour: (r.total, r.late) for r in streams.counted_histogram(spark, str(tmp_path / "out")).collect()}
    assert got == {1: (1, 0), 2: (0, 1), 3: (0, 1), 4: (1, 0), 5: (1, 1), 9: (1, 0)}


def test_segments_in_any_order_and_silent_files(spark, tmp_path, events):
    schema = "file string, seg long, pos long, line string, ends boolean"
    cut = [LOG[4:], LOG[2:4], LOG[:2]]  # the last segment first
    batches = [[("a.log", 3 - k, i, x, i == len(own) - 1) for i, x in enumerate(own)] for k, own in enumerate(cut)]
    in_runs(spark, tmp_path, batches, schema, lambda s: streams.stream_events(s, first=1), "append")
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.where("batch < 2").count() == 0 and [r.event_seq for r in got.orderBy("event_seq").collect()] == list(range(6))
    stream = streams.stream_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), first=1, timeout_ms=500)
    query = stream.writeStream.outputMode("append").trigger(processingTime="500 milliseconds").option("checkpointLocation", str(tmp_path / "state2")).format("parquet").start(str(tmp_path / "out2"))
    until = time.monotonic() + 60
    while time.monotonic() < until and query.isActive and spark.read.schema(stream.schema).parquet(str(tmp_path / "out2")).count() < 7:
        time.sleep(0.5)
    query.stop()
    codes = [r.code for r in spark.read.schema(stream.schema).parquet(str(tmp_path / "out2")).orderBy("event_seq").collect()]
    assert codes == [r.code for r in events.orderBy("event_seq").collect()]  # the open block too


def test_bursts_of_a_stream_equal_batch(spark, tmp_path):
    rng, at = random.Random(9), 0
    rows = []
    for k in range(60):
        at += rng.choice((5, 600, 601, 900))
        rows.append(("f", f"[10/{12 + at // 86400}/15 {at % 86400 // 3600:02}:{at % 3600 // 60:02}:{at % 60:02}:000 UTC] 0000001a Web E   SRVE0293E: bad"))
    frame = spark.createDataFrame([(f, 0, k, x) for k, (f, x) in enumerate(rows)], "file string, block long, pos long, line string")
    want = {(r.start, r.end, r.cnt) for r in recipes.error_bursts(assembly.events(frame)).collect()}
    order = list(range(60))
    rng.shuffle(order)  # late rows fall between others
    for n, own in enumerate((order[:30], order[30:])):
        spark.createDataFrame([rows[k] for k in own], "file string, line string").write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.error_bursts(spark.readStream.schema("file string, line string").parquet(str(tmp_path / "in")), delay="30 days")
        stream.writeStream.outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "state")).foreachBatch(streams.versions_writer(str(tmp_path / "out"))).start().awaitTermination()
    newest = spark.read.parquet(str(tmp_path / "out")).where("batch = 1")
    assert {(r.start, r.end, r.cnt) for r in newest.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")}).collect()} == want and len(want) > 5


def test_a_restarted_tail_reads_bounded_parts(tmp_path):
    from lumenlog.streaming.tail import TailReader

    log = tmp_path / "a.log"
    log.write_text("".join(f"line {k}\n" for k in range(20)))
    options = {"path": str(log), "maxbytes": "64", "from": "start"}

    def lines(reader, start, end):
        spans = reader.partitions(start, end)
        assert all(s.end - s.begin <= 64 for s in spans)
        return [x[3] for s in spans for x in reader.read(s)]

    reader = TailReader(options)
    start = reader.initialOffset()
    first = reader.latestOffset()
    got = lines(reader, start, first)
    with log.open("a") as f:
        f.write("".join(f"more {k} {'x' * (k % 50)}\n" for k in range(300)) + "open")
    again = TailReader(options)  # knows nothing of the one before
    end = again.latestOffset()
    got += lines(again, first, end)
    assert got == [f"line {k}" for k in range(20)] + [f"more {k} {'x' * (k % 50)}" for k in range(300)]
    log.write_text("".join(f"other {k}\n" for k in range(3000)))  # longer than before, with another head
    for reader in (again, TailReader(options)):
        at, found = end, []
        while (now := reader.latestOffset()) != at:
            found += lines(reader, at, now)
            at = now
        assert found == [f"other {k}" for k in range(3000)]


def test_stored_tables_are_cleared(spark):
    from lumenlog import storage

    df = storage.store(spark.range(3), "some")
    assert df.count() == 3 and storage.clear_stored(spark) >= 1
    with pytest.raises(Exception, match="(?i)not.*exist|no such"):
        df.count()


@pytest.mark.parametrize("block", [100_000, 2])
def test_windows_by_blocks_equal_whole_files(spark, monkeypatch, block):
    import random

    monkeypatch.setattr(recipes, "BLOCK", block)
    rng = random.Random(3)
    rows = [(f, k, rng.choice(["S", "R", "x"]), rng.randrange(100)) for f in "ab" for k in range(25)]
    frame = spark.createDataFrame(rows, "file string, event_seq long, code string, v long")
    from pyspark.sql import Window as W

    order = W.partitionBy("file").orderBy("event_seq")
    want = {(r.file, r.event_seq): (r.b, r.n) for r in frame.select("*", F.lag("v").over(order).alias("b"), F.count_if(F.col("code") == "S").over(order).alias("n")).collect()}
    got = recipes.runs_in_file(recipes.before_in_file(frame, F.col("v"), "b"), F.col("code") == "S", "n").collect()
    assert {(r.file, r.event_seq): (r.b, r.n) for r in got} == want


def test_recipes(events):
    bursts = recipes.error_bursts(events, 60).orderBy("start").collect()
    assert [(b.cnt, b.start) for b in bursts] == [(2, datetime(2015, 10, 12, 21, 22, 10)), (1, datetime(2015, 10, 13, 0, 2, 10))]
    assert sorted(r.code for r in recipes.context_rows(events, 15).collect()) == ["ARFM5007I", "TCPC0001I"]
    assert [r.exception for r in recipes.regressions(events, "2015-10-13 00:00:00").collect()] == ["java.lang.OutOfMemoryError"]
    assert recipes.without_noise(events, ["TCPC0001I"], ["WSVR"]).count() == 4
