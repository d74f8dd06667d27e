"""What shows only on more than a few tasks or larger tables: order of written files, and plans that do not shuffle texts."""

import os
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenlog.functions import patterns as P
from lumenlog.functions import text as T
from lumenlog.operators import covers, documents
from lumenlog.plans import document_queries, recipe_queries
from lumenlog.sources import files
from lumenlog.sources.rendered import rendered_lines
from lumenlog.streaming import streams, tail

SF_DIR = os.environ.get("LUMENLOG_TEST_SF", "/root/testdata/sf0.01")


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def several_tasks(spark):
    """Small shuffles stay in several tasks, as large ones do."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_written_logs_keep_their_order(spark, several_tasks):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables")
    root = recipe_queries.written(spark, SF_DIR)
    got = files.read_lines(spark, [root]).withColumn("log", F.regexp_extract("file", "/file=([^/]+)/", 1)).orderBy("log", "file", "block", "pos").select("log", "line").collect()
    want = rendered_lines(spark.read.parquet(f"{SF_DIR}/events.parquet")).orderBy("file", "pos").select(F.col("file").alias("log"), "line").collect()
    assert got == want


def test_documents_are_evaluated_once_and_lines_not_shuffled(spark):
    docs = spark.createDataFrame([(1, "## 1. A\nx\n\n## B\n##\n## 2. A\r\ny\n## ## C")], "doc_id long, text string")
    sections = documents.doc_sections(docs)
    assert "Exchange" not in plan_of(sections)
    assert sorted(tuple(r) for r in sections.collect()) == [(1, 2, "B", "##"), (1, 3, "A", "y"), (1, 4, "## C", "")]
    targets = spark.createDataFrame([(1, "Executive Summary", "x")], "doc_id long, target string, body string")
    assert "size(" not in plan_of(documents.doc_findings(targets))  # no filter that makes the findings a second time
    grades = plan_of(documents.extract_grades(docs))
    assert 0 < grades.split("Window")[-1].count("regexp_extract_all") <= 4


@pytest.mark.parametrize("name", ["normalize_text", "extract_grades", "extract_queries", "fixed_index", "doc_findings", "findings_diff"])
def test_documents_are_dealt_to_tasks(spark, name):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables")
    assert "REPARTITION_BY_NUM" in plan_of(document_queries.QUERIES[name](spark, SF_DIR))


def test_normal_form_of_odd_texts(spark):
    texts = {
        "  | `a`\t\r\n*b_  10 min ": "a b", "~~x~~ ✅ 5 5 min hr": "x", " app/x.py:3 see  tests/y mapp": "see mapp", " A  9hr": " a ", "a | | 5 min": "a",
        "30 minutes 4 hr": "30 minutes", "": "", "   ": "", "~~": "",
    }
    rows = spark.createDataFrame([(x,) for x in texts], "t string").select("t", T.normalize(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in rows} == texts


def test_small_reports_are_looked_through_without_an_index(spark, monkeypatch):
    rows = [("r", k, None, x) for k, x in enumerate(["alpha beta gamma", "see delta now", "no more", "", "alpha zeta", "one two three four five six"])] + [(None, 9, None, "alpha beta")]
    own = spark.createDataFrame(rows, "d string, fid int, id string, norm string")
    lines = spark.createDataFrame([("r", ["#1"], "gamma x beta"), ("r", [], "delta"), ("r", [], ""), ("s", [], "no more"), (None, [], "alpha beta"), ("r", [], "six five a b c d e")], "d string, ids array<string>, norm string")
    found = []
    for most in (covers.PAIRS, 0):  # looked through, and by the index
        monkeypatch.setattr(covers, "PAIRS", most)
        if most:
            monkeypatch.setattr(covers, "indexed", lambda texts: pytest.fail("an index was made"))
        found.append(sorted(r.fid for r in covers.fixed_crossref(own, lines, "d").collect()))
        monkeypatch.undo()
    assert found == [[0, 1], [0, 1]]


def test_patterns_of_events_run_only_where_they_can_match(spark):
    texts = ["PASSWORD = a b", "Authorization: Bearer x.y", 'cfg "API_KEY": "k"', "eyJa.eyJb.c", "poOl is exhausted", "GC OVERHEAD LIMIT EXCEEDED", "Unable to find valid certification path", "srve 404", "a.bError", "Caused by: a.b.CException: x", "", "plain"]
    df = spark.createDataFrame([(x,) for x in texts], "t string")
    plain = F.col("t")
    for pattern, to in P.REDACTIONS:
        plain = F.regexp_replace(plain, pattern, to)
    tags = F.array_compact(F.array(*(F.when(F.col("t").rlike(T.UNIX + p), F.lit(tag)) for tag, p in P.TAGS.items())))
    got = df.select(T.redact(F.col("t")), T.signal_tags(F.col("t")), T.exception(F.col("t")), T.root_cause(F.col("t")))
    assert "contains" in plan_of(got)
    want = df.select(plain, tags, T.found(F.col("t"), P.EXCEPTION), F.try_element_at(F.regexp_extract_all("t", F.lit("(?dm)" + P.ROOT_CAUSE), F.lit(1)), F.lit(-1)))
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()]


KINDS = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.string())


class State:
    """A processor's states, in memory."""

    def __init__(self):
        self.kept = {}

    def getValueState(self, name, schema):
        kept = self.kept

        class Value:
            exists = lambda self: name in kept
            get = lambda self: kept[name]
            update = lambda self, x: kept.update({name: x})

        return Value()

    def getListState(self, name, schema):
        kept = self.kept

        class Values:
            get = lambda self: list(kept.get(name, []))
            put = lambda self, x: kept.update({name: x})
            clear = lambda self: kept.pop(name, None)

        return Values()

    def getMapState(self, name, key, value):
        own = self.kept.setdefault(name, {})

        class Map:
            keys = lambda self: list(own)
            getValue = lambda self, k: own[k]
            updateValue = lambda self, k, x: own.update({k: x})
            removeKey = lambda self, k: own.pop(k)

        return Map()


@pytest.mark.parametrize("first", [None, 1])
def test_lines_are_folded_as_runs_that_come_early_twice_or_in_part(first):
    rng = random.Random(7)
    pool = ["[10/12/15 21:22:04:257 CEST] 00000001 A I x", "2015-10-12 21:22:04 y", "\tat a.b(C.java:1)", "Caused by: a.b.CError", "", "  ", "loose", None]
    for _ in range(100):
        segments = [[rng.choice(pool) for _ in range(rng.randrange(1, 9))] for _ in range(5)]
        want, left = streams.fold_lines("f", [x for s in segments for x in s], None)
        rows = [(s, p, p == len(own) - 1, x) for s, own in enumerate(segments, 1) for p, x in enumerate(own)]
        cuts = sorted({0, len(rows), *(rng.randrange(len(rows)) for _ in range(6))})
        pieces = [rows[max(0, a - rng.randrange(3)) : b] for a, b in zip(cuts, cuts[1:], strict=False)]  # overlapping
        rng.shuffle(pieces)
        if first is None:
            pieces.insert(0, rows[:1])
        pieces.append(rows[2:5])
        state, found = State(), []
        for piece in pieces:
            ts, kinds = zip(*(streams.marks([x for *_, x in piece])), strict=True)
            columns = [["f"] * len(piece), *([r[k] for r in piece] for k in (0, 1, 2, 3)), ts, kinds]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS, strict=True)], [f"c{k}" for k in range(7)])
            frames = [b.to_pandas() for b in streams.runs_of_lines(iter([batch]))]
            assert len(frames[0]) == 1 + sum(r[2] for r in piece[:-1])  # a row for all lines of a segment
            own = streams.Assembly(first, None)  # a batch knows only the state
            own.init(state)
            found += [tuple(r) for f in own.handleInputRows(("f",), iter(frames), None) for r in f.itertuples(index=False)]
        assert [x[1] for x in found] == [x[1] for x in want] and [x[3] for x in found] == [x[3] for x in want] and not state.kept["runs"]
        assert [x[0] for x in state.kept.get("lines", [])] == left[4]


def test_blocks_of_a_stream_are_dealt_to_tasks(spark, tmp_path):
    schema = "file string, seg long, pos long, line string, ends boolean"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "in"))
    plan = streams.stream_events(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))._jdf.queryExecution().analyzed().toString()
    assert "MapInArrow runs_of_lines" in plan and plan.index("RepartitionByExpression") < plan.index("TransformWithState")


def test_what_has_gathered_is_one_poll_of_a_tail(tmp_path, monkeypatch):
    log = tmp_path / "a.log"
    rows = [f"line {k}" for k in range(3000)] + ["y" * 300, "after"]
    log.write_text("\n".join(rows) + "\nopen")
    for tasks in (tail.TASKS, 10):  # parts, and neighbours in one task
        monkeypatch.setattr(tail, "TASKS", tasks)
        reader = tail.TailReader({"path": str(log), "maxbytes": "64", "from": "start"})
        start, now = reader.initialOffset(), reader.latestOffset()
        spans = reader.partitions(start, now)
        assert now[str(log)][0] == log.stat().st_size - len("open") == reader.latestOffset()[str(log)][0]
        found = [x[3] for s in spans for x in reader.read(s)]
        assert found == rows[:3000] + ["y" * 64] * 4 + ["y" * 44] + ["after"] and len({s.begin for s in spans}) == len(spans)
        assert (len(spans) <= 10) == (tasks == 10) and max(s.end - s.begin for s in spans) <= 64 * tail.NEIGHBOURS


def test_many_segments_are_listed_by_few_tasks(spark, tmp_path):
    (tmp_path / "a.1.log").write_text("x\n")
    streams.stream_lines(spark, str(tmp_path))
    assert int(spark.conf.get(streams.LISTING[0])) <= 256


def test_reports_are_compared_within_their_rows(spark, monkeypatch):
    """Only the documents are dealt; neither sections nor findings nor lines are shuffled or stored."""
    if not os.path.isdir(SF_DIR):
        pytest.skip("no tables")
    monkeypatch.setattr(documents, "store", lambda *_: pytest.fail("something was stored"))
    monkeypatch.setattr(covers, "store", lambda *_: pytest.fail("something was stored"))
    plan = document_queries.QUERIES["compare_reports"](spark, SF_DIR)._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("RepartitionByExpression") == 1
    compared = document_queries.QUERIES["compare_reports"](spark, SF_DIR)
    assert compared.count() > 0
    assert plan_of(compared).split("Initial Plan")[-1].count("Exchange ") == 1


def test_long_and_short_reports_are_compared_alike(spark, tmp_path, monkeypatch):
    rng = random.Random(3)
    word = lambda: rng.choice(("test", "summary", "Done", "~~old~~", "key findings:", "#### B2: x", "- item", "| 4 | row | high |", "#3", "B1", "app/x.py", "30 min", "**", *"abcdefghijk"))
    texts = ["\n".join(" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(0, 9))) for _ in range(60)]
    texts += ["", "\n\n", "## 1. Executive Summary\nkey findings:\n- one two three\n\n## Test\n| `a` | High |", "a\r\nb c", "test\ntest\ntest"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = []
    for most in (documents.LONG, -1):
        monkeypatch.setattr(documents, "LONG", most)
        rows.append(sorted(map(tuple, document_queries.QUERIES["compare_reports"](spark, str(tmp_path)).collect())))
    assert rows[0] == rows[1] and {r[3] for r in rows[0]} == {"fixed", "remaining"}


def test_shared_words_by_signatures(spark):
    rng = random.Random(5)
    line = lambda: " ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 120)))
    own, lines = [line() for _ in range(60)], [line() for _ in range(12)] + [""]
    words = lambda x: {w for w in x.split() if w not in P.STOP_WORDS}
    covers_ = lambda a, b: b != "" and (a in b or b in a or len(words(a) & words(b)) >= max(2, 0.4 * min(len(words(a)), len(words(b)))))
    want = {a for a in own if any(covers_(a, b) for b in lines)}
    rows = spark.createDataFrame([(own, lines)], "a array<string>, b array<string>").select(*covers.covers_of(F.col("a"), F.col("b")))
    got = rows.select(covers.covered_here(F.col("own"), F.col("lines")).alias("x")).head().x
    assert set(got) == want and 0 < len(want) < 60
