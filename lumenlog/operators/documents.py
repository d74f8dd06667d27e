"""Sections, findings, grades and queries of documents, and the diff of two snapshots.

Each step is parallel over documents: texts are split by built-in functions and exploded into rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..storage import store
from .covers import covered_here, covers_of, fixed_crossref

HEADING = P.HEADING
#: Reports of more lines go by the index of ``covers``; any number gives the same rows.
LONG = 16384


def each(docs: DataFrame, items: Column, name: str) -> DataFrame:
    """(doc_id, item) of an array.  An inner generator would evaluate the array once more, to leave out rows without items."""
    return docs.select("doc_id", F.explode_outer(items).alias(name)).where(F.col(name).isNotNull())


def text_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, line) of (doc_id, text)."""
    return docs.select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("i", "line")).where("i is not null")


def sections_of(text: Column, fits=None) -> Column:
    """What starts with a second-level heading, as an array of (title, seq, body), sorted; ``fits`` chooses by lower-cased titles."""
    pieces = F.filter(F.split(F.concat(F.lit("\n"), text), r"\n(?=##[^\S\n])", -1), lambda x: x.startswith("##"))

    def titled(piece: Column, i: Column) -> Column:
        title = F.trim(F.regexp_extract(F.substring_index(piece, "\n", 1), HEADING, 1))
        return F.struct(title.alias("title"), (i + 1).cast("long").alias("seq"), piece.alias("piece"))

    def section(x: Column) -> Column:
        heading = F.length(F.substring_index(x["piece"], "\n", 1))
        return F.struct(x["title"].alias("title"), x["seq"].alias("seq"), F.substring(x["piece"], heading + 2, F.length(x["piece"])).alias("body"))

    chosen = lambda x: x["title"] != "" if fits is None else (x["title"] != "") & fits(F.lower(x["title"]))
    return F.array_sort(F.transform(F.filter(F.transform(pieces, titled), chosen), section))


def lasts(sections: Column) -> Column:
    """Of sorted sections of equal titles the last."""
    return F.filter(sections, lambda x, i: F.coalesce(x["title"] != F.get(sections, i + 1)["title"], F.lit(True)))


def names(title: Column, target: Column) -> Column:
    """Whether one of two lower-cased names holds the other."""
    return F.contains(title, target) | F.contains(target, title)


def targets_of(sections: Column) -> Column:
    """(target, body) of each target's first section, of an array of sections."""
    first = lambda t: F.array_min(F.transform(F.filter(sections, lambda x: names(F.lower(x["title"]), F.lit(t.lower()))), lambda x: F.struct(x["seq"], F.lit(t).alias("target"), x["body"].alias("body"))))
    return F.array_compact(F.array(*map(first, P.TARGET_SECTIONS)))


def doc_sections(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, title, body): what stands below each second-level heading.  Of equal titles the last stays.

    A text is cut, and its titles are compared, within its row: no line is shuffled.
    """
    found = docs.select("doc_id", sections_of(F.col("text")).alias("s"))
    beside = F.arrays_zip(F.col("s").alias("own"), F.slice("s", 2, F.size("s")).alias("after"))
    last = F.filter(beside, lambda x: F.coalesce(x["own"]["title"] != x["after"]["title"], F.lit(True)))
    return each(found, last, "x").select("doc_id", "x.own.seq", "x.own.title", "x.own.body")


def section_targets(sections: DataFrame) -> DataFrame:
    """(doc_id, target, seq, title): each target's first section whose title holds the target's name or is held by it."""
    names = [(t, i) for i, t in enumerate(P.TARGET_SECTIONS)]
    targets = sections.sparkSession.createDataFrame(names, "target string, target_ord int")
    title, target = F.lower("title"), F.lower("target")
    fits = sections.join(F.broadcast(targets), title.contains(target) | target.contains(title))  # five rows
    first = F.row_number().over(W.partitionBy("doc_id", "target").orderBy("seq"))
    return fits.withColumn("r", first).where("r = 1").drop("r", "target_ord")


def findings_in(body: Column, target: Column) -> Column:
    """(kind, i, id, text) of all that a targeted section may list as findings, in order."""

    def pairs(pattern: str, needs: str) -> Column:
        part = lambda k: F.when(body.contains(needs), F.regexp_extract_all(body, F.lit(pattern), F.lit(k))).otherwise(F.array().cast("array<string>"))
        return F.arrays_zip(part(1).alias("id"), part(2).alias("raw"))

    named = pairs(P.FINDING_NAMED, "####")
    rows = pairs(P.FINDING_ROW, "|")
    block = F.regexp_extract(body, P.FINDING_BLOCK, 1)
    bullets = F.transform(F.regexp_extract_all(block, F.lit(P.FINDING_BULLET), F.lit(1)), lambda x: F.struct(F.lit(None).cast("string").alias("id"), x.alias("raw")))
    gaps = F.transform(
        F.regexp_extract_all(body, F.lit(P.FINDING_GAP), F.lit(1)), lambda x: F.struct(F.lit(None).cast("string").alias("id"), x.alias("raw"))
    )
    target = F.lower(target)
    none = F.array().cast("array<struct<id:string,raw:string>>")
    kinds = (
        (0, F.transform(named, lambda x: F.struct(F.upper(x["id"]).alias("id"), x["raw"].alias("raw")))),
        (1, F.transform(rows, lambda x: F.struct(F.concat(F.lit("#"), x["id"]).alias("id"), x["raw"].alias("raw")))),
        (2, F.when(target.contains("summary"), bullets).otherwise(none)),
        (3, F.when(target.contains("coverage") | target.contains("test"), gaps).otherwise(none)),
    )

    def of_kind(kind: int, rows: Column) -> Column:
        return F.transform(rows, lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["id"].alias("id"), F.trim(x["raw"]).alias("text")))

    return F.flatten(F.array(*(of_kind(k, a) for k, a in kinds)))


def doc_findings(sections: DataFrame) -> DataFrame:
    """(doc_id, target, seq, id, text, fixed, norm) of targeted sections with their bodies.

    Named findings always count; table rows, summary bullets and coverage rows count once a normal form.
    """
    every = findings_in(F.col("body"), F.col("target"))
    normal = F.transform(every, lambda x: x.withField("norm", T.normalize(x["text"])))  # before the rows are filtered, so once each
    found = sections.select("doc_id", "target", F.explode_outer(normal).alias("f")).where("f is not null").select("doc_id", "target", "f.*")
    head = F.lower("text")
    skip = ((F.col("kind") == 1) & (F.col("text").startswith("---") | head.startswith("item") | F.col("text").startswith("#"))) | (
        (F.col("kind") == 3) & (F.col("text").startswith("---") | (head == "missing test"))
    )
    found = found.where(~skip & ((F.col("kind") == 0) | (F.col("norm") != "")) & ((F.col("kind") != 2) | (F.length("text") > 10)))
    place = W.partitionBy("doc_id", "target").orderBy("kind", "i")
    again = F.row_number().over(W.partitionBy("doc_id", "target", "norm").orderBy("kind", "i"))
    kept = found.withColumn("r", again).where("kind = 0 or r = 1")
    return kept.select("doc_id", "target", F.row_number().over(place).alias("seq"), "id", "text", T.is_fixed(F.col("text")).alias("fixed"), "norm")


def findings_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(norm, category) of two tables of (seq, norm, fixed): fixed, remaining or new; of equal keys the last counts."""
    last = lambda df, name: df.where("norm <> ''").groupBy("norm").agg(F.max_by("fixed", "seq").alias(name))
    both = last(old, "old_fixed").join(last(new, "new_fixed"), "norm", "full")
    return both.select("norm", category(F.col("old_fixed"), F.col("new_fixed")).alias("category")).where("category is not null")


def diff_counts(diff: DataFrame) -> DataFrame:
    return diff.groupBy("category").agg(F.count(F.lit(1)).alias("findings"))


def named_ids(line: Column) -> Column:
    """The ids of findings that a line names."""
    found = F.when(line.contains("#"), F.regexp_extract_all(line, F.lit(P.FINDING_NUMBER), F.lit(1))).otherwise(F.array().cast("array<string>"))
    numbers = F.transform(found, lambda x: F.concat(F.lit("#"), x))
    return F.concat(F.regexp_extract_all(line, F.lit(P.FINDING_ID), F.lit(1)), numbers)


def fixed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, ids, norm): the index of what a report marks as fixed.  Each marked line counts, with the ids it names."""
    lines = text_lines(docs).where(T.is_fixed(F.col("line")))
    ids = F.array_sort(F.array_distinct(named_ids(F.col("line"))))
    return lines.select("doc_id", "i", ids.alias("ids"), T.normalize(F.col("line")).alias("norm"))


def category(old: Column, new: Column) -> Column:
    """What became of a finding, by whether the old and the new version have it marked as fixed (null: do not have it)."""
    return F.when(new.isNull(), "fixed").when(old.isNotNull(), F.when(new, "fixed").otherwise("remaining")).when(~new, "new")


def compare_long_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """``compare_reports`` of reports whose lines are too many to meet in pairs: what both versions find is stored, and indexed by words.
    """
    version = lambda docs, v: docs.select(F.struct("doc_id", F.lit(v).alias("v")).alias("doc_id"), "text")
    found = store(doc_findings(section_targets(doc_sections(version(old, 0).unionByName(version(new, 1))))).select("doc_id.*", "target", "seq", "id", "fixed", "norm"), "findings")
    before, after = found.where("v = 0"), found.where("v = 1")
    own = after.where("not fixed").select("doc_id", F.struct("doc_id", "target", "seq").alias("fid"), "id", "norm")
    sure = fixed_crossref(own, store(fixed_lines(new), "fixed-lines"), "doc_id").select("fid.*").withColumn("sure", F.lit(True))
    after = after.join(sure, ["doc_id", "target", "seq"], "left").withColumn("fixed", F.col("fixed") | F.coalesce("sure", F.lit(False)))
    last = lambda df, name: df.where("norm <> ''").groupBy("doc_id", "target", "norm").agg(F.max_by("fixed", "seq").alias(name))
    both = last(before, "old_fixed").join(last(after, "new_fixed"), ["doc_id", "target", "norm"], "full")
    return both.select("doc_id", "target", "norm", category(F.col("old_fixed"), F.col("new_fixed")).alias("category")).where("category is not null")


def found_in(targets: Column) -> Column:
    """The findings of an array of (target, body), as (target, norm, id, fixed, place).  Of a target's equal normal forms the one of the
    largest place counts: the last named finding, or else the first of the others."""
    head = lambda x: F.lower(x["text"])
    skipped = lambda x: ((x["kind"] == 1) & (x["text"].startswith("---") | head(x).startswith("item") | x["text"].startswith("#"))) | (
        (x["kind"] == 3) & (x["text"].startswith("---") | (head(x) == "missing test"))
    )
    whole = lambda x: ~skipped(x) & ((x["kind"] != 2) | (F.length(x["text"]) > 10))

    def finding(t: Column, x: Column) -> Column:
        place = F.when(x["kind"] == 0, F.lit(1 << 50) + x["i"]).otherwise(-(x["kind"] * F.lit(1 << 40) + x["i"]))
        return F.struct(t["target"].alias("target"), T.normalize(x["text"]).alias("norm"), x["id"].alias("id"), T.is_fixed(x["text"]).alias("fixed"), place.alias("place"))

    every = F.flatten(F.transform(targets, lambda t: F.transform(F.filter(findings_in(t["body"], t["target"]), whole), lambda x: finding(t, x))))
    return F.filter(every, lambda x: x["norm"] != "")


def compare_texts(texts: DataFrame) -> DataFrame:
    """``compare_reports`` of (doc_id, old, new), with nothing between the texts and the result but arrays of their own rows.

    A finding's mark is the last bit beside its place, so that the largest number of a normal form tells both.
    """
    versions = ("old", "new")
    fits = lambda title: F.exists(F.array(*(F.lit(t.lower()) for t in P.TARGET_SECTIONS)), lambda t: names(title, t))
    marked = F.filter(F.split("new", "\n", -1), lambda x: T.is_fixed(x))
    rows = texts.select("doc_id", marked.alias("marked"), *(sections_of(F.col(v), fits).alias(v) for v in versions))
    rows = rows.select("doc_id", "marked", *(lasts(F.col(v)).alias(v) for v in versions))
    rows = rows.select("doc_id", "marked", *(targets_of(F.col(v)).alias(v) for v in versions))
    ids, lines = F.array_distinct(F.flatten(F.transform("marked", lambda x: named_ids(x)))), F.array_distinct(F.transform("marked", lambda x: T.normalize(x)))
    named = lambda x, ids: x.withField("fixed", x["fixed"] | F.coalesce(F.array_contains(ids, x["id"]), F.lit(False)))
    new = T.bound(ids, lambda ids: F.transform(found_in(F.col("new")), lambda x: named(x, ids)))
    rows = rows.select("doc_id", lines.alias("lines"), found_in(F.col("old")).alias("old"), new.alias("new"))
    open_ = F.array_distinct(F.transform(F.filter("new", lambda x: ~x["fixed"]), lambda x: x["norm"]))
    rows = rows.select("doc_id", "old", "new", *covers_of(open_, F.col("lines")))
    rows = rows.select("doc_id", "old", "new", covered_here(F.col("own"), F.col("lines")).alias("covered"))
    number = lambda x, fixed: 2 * x["place"] + fixed.cast("long")
    pair = lambda x, old, new: F.struct(x["target"].alias("target"), x["norm"].alias("norm"), old.alias("old"), new.alias("new"))
    none = F.lit(None).cast("long")
    old = F.transform("old", lambda x: pair(x, number(x, x["fixed"]), none))
    new = T.bound(F.col("covered"), lambda covered: F.transform("new", lambda x: pair(x, none, number(x, x["fixed"] | F.array_contains(covered, x["norm"])))))
    found = each(rows, F.concat(old, new), "x").select("doc_id", "x.*").groupBy("doc_id", "target", "norm").agg(F.max("old").alias("old"), F.max("new").alias("new"))
    fixed = lambda v: F.col(v).bitwiseAND(1) == 1
    return found.select("doc_id", "target", "norm", category(fixed("old"), fixed("new")).alias("category")).where("category is not null")


def compare_versions(texts: DataFrame) -> DataFrame:
    """``compare_reports`` of (doc_id, old, new, long): both versions of a report, and whether it has too many lines to meet in pairs."""
    out = compare_texts(texts.where("not long"))
    long = texts.where("long")
    if long.head(1):
        out = out.unionByName(compare_long_reports(long.select("doc_id", F.col("old").alias("text")), long.select("doc_id", F.col("new").alias("text"))))
    return out


def compare_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, target, norm, category) of two versions (doc_id, text) of each report, section by section.

    Findings of the new version that it marks as fixed anywhere, by id, by containing text or by shared words, count as fixed.
    """
    both = old.select("doc_id", F.col("text").alias("old")).join(new.select("doc_id", F.col("text").alias("new")), "doc_id", "full")
    text = lambda v: F.coalesce(v, F.lit("")).alias(v)
    return compare_versions(both.select("doc_id", text("old"), text("new")).withColumn("long", F.length("new") - F.length(F.translate("new", "\n", "")) > LONG))


def extract_queries(replies: DataFrame) -> DataFrame:
    """(doc_id, block, part, description, query) of the searches in a reply's fenced code blocks."""
    block = r"(?s)```[^\n]*\n.*?\n```"
    beside = F.arrays_zip(F.regexp_extract_all("text", F.lit(block), F.lit(0)).alias("part"), F.split("text", block, -1).alias("before"))  # one longer
    rows = replies.select("doc_id", F.posexplode_outer(beside).alias("k", "p")).where("p.part is not null").select("doc_id", (2 * F.col("k") + 1).alias("i"), "p.part", "p.before")
    fence = r"(?s)^```(\w*)\n(.*?)\n```$"
    rows = rows.where(F.col("part").rlike(fence)).select(
        "doc_id", "i", F.lower(F.regexp_extract("part", fence, 1)).alias("lang"), F.trim(F.regexp_extract("part", fence, 2), F.lit(" \n\t")).alias("code"), "before"
    )
    looks = lambda c: F.lower(c).rlike("|".join(w.replace("|", r"\|") for w in P.SEARCH_WORDS))
    rows = rows.where(F.col("lang").isin("spl", "splunk", "") & looks(F.col("code")))
    said = F.filter(
        F.transform(F.split("before", "\n"), lambda x: F.trim(F.trim(F.trim(F.trim(x), F.lit("*")), F.lit("#")))), lambda x: x != ""
    )
    chunks = F.filter(F.transform(F.split("code", "(?m)^-- +"), lambda x: F.trim(x, F.lit(" \n\t"))), lambda x: x != "")
    cut = F.transform(
        chunks, lambda x: F.struct(F.trim(F.substring_index(x, "\n", 1)).alias("description"), F.trim(F.regexp_extract(x, r"(?s)^[^\n]*\n(.*)$", 1), F.lit(" \n\t")).alias("query"))
    )
    cut = F.filter(cut, lambda x: looks(x["query"]))
    several = F.size(F.split("code", "(?m)^-- +")) > 1
    single = F.struct(F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit("Splunk query")).alias("description"), F.col("code").alias("query"))
    found = F.when(several & (F.size(cut) > 1), cut).otherwise(F.array(single))
    return rows.select("doc_id", F.col("i").alias("block"), F.posexplode_outer(found).alias("part", "f")).where("f is not null").select("doc_id", "block", "part", "f.description", "f.query")


def extract_grades(docs: DataFrame) -> DataFrame:
    """(doc_id, label, grade, class): grades by area; table rows win over inline ones, and the first counts."""
    text = F.col("text")

    def pairs(order: int, pattern: str, label: str, grade: str) -> Column:
        """Of each match, found in one pass, the label it starts with and the grade it ends with."""
        found = F.regexp_extract_all(text, F.lit(T.ascii_bounds(pattern)), F.lit(0))
        part = lambda x, p: F.regexp_extract(x, p, 1)
        return F.transform(found, lambda x, i: F.struct(F.lit(order).alias("o"), i.alias("i"), F.initcap(F.trim(part(x, label))).alias("label"), F.upper(part(x, grade)).alias("grade")))

    overall = F.transform(
        F.regexp_extract_all(text, F.lit(P.GRADE_OVERALL), F.lit(1)), lambda g, i: F.struct(F.lit(2).alias("o"), i.alias("i"), F.lit("Overall").alias("label"), F.upper(g).alias("grade"))
    )
    table = pairs(0, P.GRADE_TABLE, r"^\|\s*\*{0,2}([^*|]*?)\*{0,2}\s*\|", r"([A-Za-z][+-]?)\*{0,2}\s*\|$")
    inline = pairs(1, P.GRADE_INLINE_HEAD + P.GRADE_INLINE, r"(?i)^(" + P.GRADE_AREAS + r")(?!\w)", r"([A-Za-z][+-]?)$")
    every = each(docs, F.flatten(F.array(table, inline, overall)), "x").select("doc_id", "x.*")
    known = F.create_map(*(F.lit(v) for pair in P.GRADE_CLASSES.items() for v in pair))
    valid = every.where("grade not in ('D+', 'D-', 'F+', 'F-')").withColumn("class", known[F.substring("grade", 1, 1)])
    first = F.row_number().over(W.partitionBy("doc_id", F.replace(F.lower("label"), F.lit("  "), F.lit(" "))).orderBy("o", "i"))
    return valid.withColumn("r", first).where("r = 1").select("doc_id", "label", "grade", "class")


def previous_snapshot(versions: DataFrame, key: str, version: str) -> DataFrame:
    """Each version with the one before it, by series."""
    return versions.withColumn("previous", F.lag(version).over(W.partitionBy(key).orderBy(version)))
