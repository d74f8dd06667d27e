"""Registered queries read whole texts and all rows: what stands at the end of a long text, or in any conversation or event, is found."""

import random
from datetime import datetime

import pytest

import __spark_entry__ as entry
from lumenlog.functions import patterns
from lumenlog.operators import covers, documents, recipes
from lumenlog.plans import document_queries, recipe_queries


@pytest.fixture(scope="module")
def docs_dir(spark, tmp_path_factory):
    """Two documents of 600 lines; the last lines hold a mark of their own."""
    out = str(tmp_path_factory.mktemp("tables"))
    long = lambda k: "\n".join([f"word {k} line {i} of the text | with a bar" for i in range(600)] + ["", f"Security rated A at the far end {k}"])
    rows = [(0, long(0)), (1, long(1)), (2, ""), (3, None), (4, "one\r\ntwo\u2028three")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(out + "/documents.parquet")
    return out


@pytest.mark.parametrize(
    ("name", "column", "most"),
    [("doc_sections", "title", 1206), ("section_targets", "body", 0), ("normalize_text", "norm", 0), ("doc_findings", "norm", 0), ("extract_queries", "query", 0), ("extract_queries", "description", 0)],
)
def test_the_end_of_a_text_is_read(spark, docs_dir, name, column, most):
    rows = entry.queries()[name](spark, docs_dir).where("doc_id < 2").collect()
    assert {r.doc_id for r in rows if "at the far end" in (r[column] or "").lower()} == {0, 1}
    assert len(rows) >= most


def test_every_line_is_a_finding(spark, docs_dir):
    rows = entry.queries()["doc_findings"](spark, docs_dir).where("target = 'Code Review Findings'").collect()
    assert {d: sum(r.doc_id == d and r.id.startswith("B") for r in rows) for d in range(5)} == {0: 601, 1: 601, 2: 0, 3: 0, 4: 3}


def test_flags_and_grades_of_whole_texts(spark, docs_dir):
    flags = entry.queries()["fixed_flag"](spark, docs_dir).where("doc_id = 0 and fixed").count()
    assert flags == 2 * 301  # bullets and findings of lines 0, 3, 4, 7, 8, ... 600
    grades = {(r.doc_id, r.label): r.grade for r in entry.queries()["extract_grades"](spark, docs_dir).collect()}
    assert grades[0, "Security"] == "A" and grades[1, "Security"] == "D" and grades[0, "Overall"] == "B"


def test_diff_of_whole_sentences(spark, tmp_path):
    head = "x" * 500 + ". "
    rows = [(0, head + "the parser is slow. the parser is wrong"), (1, head + "the parser is slow. the parser is new")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.norm: r.category for r in entry.queries()["findings_diff"](spark, str(tmp_path)).collect()}
    assert got == {"x" * 500: "remaining", "the parser is slow": "remaining", "the parser is wrong": "fixed", "the parser is new": "new"}
    assert {r.category: r.findings for r in entry.queries()["diff_counts"](spark, str(tmp_path)).collect()} == {"remaining": 2, "fixed": 1, "new": 1}


def test_crossref_of_whole_turns(spark, tmp_path):
    rows = [(1, 0, "user", "b" * 40 + " parse stamps"), (1, 1, "assistant", "a" * 40 + " stamps parse slowly"), (1, 2, "user", "c" * 40 + " other work"), (2, 0, "user", "b" * 40 + " parse stamps")]
    rows += [(2, 1, "assistant", "nothing"), (3, 1, "user", "unlike"), (3, 8, "assistant", "far off")]
    spark.createDataFrame([(*r[:3], r[3]) for r in rows], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert {tuple(r) for r in entry.queries()["fixed_crossref"](spark, str(tmp_path)).collect()} == {(1, 0)}  # only within a conversation


def test_reports_are_compared_section_by_section(spark):
    old = "## Code Review Findings\n#### B1: slow parser\n#### B2: wrong dates\n#### B3: lost rows\n#### B4: odd names here\n## Notes\nx"
    new = "## Code Review Findings\n#### B2: wrong dates\n#### B3: lost rows\n#### B4: odd names here\n#### B5: new leak\n#### B6: new and done ✅\n## Plan\n- ~~B3~~ Done\n- odd names ✅"
    frame = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.norm): r.category for r in documents.compare_reports(frame(old, old), frame(new, old)).collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == 0} == {"slow parser": "fixed", "wrong dates": "remaining", "lost rows": "fixed", "odd names here": "fixed", "new leak": "new"}
    assert {v for k, v in got.items() if k[0] == 1} == {"remaining"}
    index = documents.fixed_lines(frame("| #7 | B2 and C3 | Done |\nopen\n~~gone~~")).orderBy("i").collect()
    assert [(r.i, r.ids, r.norm) for r in index] == [(0, ["#7", "B2", "C3"], "#7 b2 and c3 done"), (2, [], "gone")]


def test_queries_of_replies_keep_control_characters(spark):
    text = "Say \x01 first\n```spl\nindex=APP \x01 a\n```\nlater"
    got = documents.extract_queries(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert [(r.block, r.description, r.query) for r in got] == [(1, "Say \x01 first", "index=APP \x01 a")]


def covered(a, b):
    wa, wb = ({w for w in x.split() if w not in patterns.STOP_WORDS} for x in (a, b))
    return a in b or b in a or len(wa & wb) >= 2 and len(wa & wb) / min(len(wa), len(wb)) >= 0.4


@pytest.mark.parametrize("most", [4096, 3])
def test_crossref_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(covers, "FREQUENT", most)
    monkeypatch.setattr(covers, "LIKELY", 1 + most % 2)
    rng = random.Random(7)
    line = lambda n: " ".join(rng.choice(("hot", "the", *"uvxyz")) + rng.choice(("", "", "1", "2", "33", "k", "mm")) for _ in range(n))
    own, fixed = [line(rng.randrange(1, 16)) for _ in range(150)], [line(rng.choice((1, 2, 3, 12))) for _ in range(6)]
    want = {i for i, a in enumerate(own) if any(covered(a, b) for b in fixed)}
    got = documents.fixed_crossref(
        spark.createDataFrame(list(enumerate(own)), "fid long, norm string").selectExpr("fid", "cast(null as string) as id", "norm"),
        spark.createDataFrame([([], x) for x in fixed], "ids array<string>, norm string"),
    )
    assert {r.fid for r in got.collect()} == want and 0 < len(want) < 150


def test_a_frequent_word_makes_no_pairs(spark):
    texts = lambda side: spark.createDataFrame([("", f"hot {side}{i} {side}{i}x {side}{i}y") for i in range(100)], "d string, t string")
    index = covers.word_index(texts("a"), texts("b"))
    assert index.count() == 200
    assert covers.word_pairs(covers.postings(index.where("a"), "a"), covers.postings(index.where("b"), "b")).count() == 0


def test_every_conversation_is_history_or_new(spark, tmp_path):
    rows = [(k, "user", f"text {k}") for k in (*range(12), None)] + [(5, "user", "text 0")]
    spark.createDataFrame(rows, "conv_id long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = [(r.conv_id, r.text) for r in entry.queries()["append_distinct"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(k, t) for k, _, t in rows[:-1]], key=str)


def test_regressions_see_every_event(spark, monkeypatch):
    day = lambda k: datetime(2024, 1, k)
    rows = [("f", 5, day(1), "a.Old"), ("f", 7, day(3), "a.Old"), ("f", 8, day(3), "a.New"), ("f", 100, day(3), None), ("f", 50, day(1), None), ("f", 10, None, "a.Old")]
    ev = spark.createDataFrame(rows, "file string, event_seq long, ts_dt timestamp_ntz, exception string")
    monkeypatch.setattr(recipe_queries, "events", lambda s, d: ev)
    got = {(r.exception, r.cnt) for r in entry.queries()["regressions"](spark, "").collect()}
    assert got == {("a.New", 1), (recipe_queries.LATE, 1)}


def test_noise_has_one_message(spark):
    head = ("[10/12/15 21:22:10:000 UTC] 0000001a ", "2015-10-12 21:22:10,000 ", "2015-10-12 21:22:11,500 ")
    rows = [("ONE", "INFO", h + "ONE: same") for h in head[1:]] + [("CLASSIC", "INFO", head[0] + "CLASSIC: same")] * 2
    rows += [("MANY", "INFO", f"{head[0]}MANY: message {k}") for k in range(2)] + [("BAD", "ERROR", head[0] + "BAD: same")] * 2
    events = spark.createDataFrame(rows, "code string, level string, text string")
    assert {(r.code, r.cnt) for r in recipes.noise_candidates(events, 1).collect()} == {("ONE", 2), ("CLASSIC", 2)}
