"""Which findings the fixed lines of a report cover.

A fixed line covers a finding whose id it names, whose text it contains or is contained in, or with which it shares two
significant words that are 0.4 of the smaller set.  Equal texts of a report are one text, numbered and stored once with
its significant words, rarest first: the inverted index, from which both sides' postings are read.  Two texts meet at a
word only if enough words can follow it in both (filters by length and position), so a text's most frequent words make
no pairs.

Most reports are small: if all pairs of their texts are no more than ``PAIRS``, their findings look through their lines and stop
at the first cover, so only texts are shuffled.  The index is made of the larger reports alone.

A finding leaves at its first cover: ids come first, then the few shortest lines of each posting, then whole postings
for what is left, then texts too short to share two words, which meet at a rare inner word or at the characters of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..storage import store

#: Words that count as frequent where rare ones come first, and lines of a posting that are tried first; any numbers give
#: the same rows.
FREQUENT, LIKELY = 4096, 4
#: Pairs of a report's findings and fixed lines that are looked through without an index; any number gives the same rows.
PAIRS = 1 << 18


def significant(norm: Column, blank: str = r"\s+") -> Column:
    """The distinct words of a normal form without stop words."""
    words = F.array_distinct(F.filter(F.split(norm, blank), lambda w: w != ""))
    return F.array_except(words, F.array(*map(F.lit, P.STOP_WORDS)))


def distinct_texts(findings: DataFrame, fixed: DataFrame) -> DataFrame:
    """(d, k, t, a, b, own): the distinct texts t of each report d, stored with their numbers k, whether findings (a) and fixed lines
    (b) have them, and their significant words."""
    sides = findings.select("d", "t", F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(fixed.select("d", "t", F.lit(False).alias("a"), F.lit(True).alias("b")))
    texts = sides.where("t <> ''").groupBy("d", "t").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return store(texts.select("d", F.monotonically_increasing_id().alias("k"), "t", "a", "b", significant(F.col("t")).alias("own")), "texts")


def needed(n: Column) -> Column:
    """How many words two texts have to share if the smaller one has ``n``: two, and 0.4 of it."""
    return F.greatest(F.lit(2), F.floor((2 * n + 4) / 5))


def looked_through(texts: DataFrame) -> DataFrame:
    """(d, t) of the findings' texts that some line of their report covers, by trying its lines in turn."""
    own = texts.where("a").select("d", "t", "own")
    lines = texts.where("b").select(F.col("d").alias("dl"), F.col("t").alias("tl"), F.col("own").alias("wl"))
    shared = F.size(F.array_intersect("own", "wl")) >= needed(F.least(F.size("own"), F.size("wl")))
    covers = F.contains("t", "tl") | F.contains("tl", "t") | shared
    return own.join(lines, (F.col("d") == F.col("dl")) & covers, "left_semi").select("d", "t")


#: Words of 64 bits of a text's signature, one bit a significant word; any number gives the same rows.
SIGNS = 4


def covers_of(own: Column, lines: Column) -> tuple[Column, Column]:
    """The normal forms of two arrays of one report, empty ones aside, as arrays ``own`` and ``lines`` of (t, w, k, c, m): with their
    significant words, how many of them at least have to be shared, and a signature m, in which c words have no bit of their own."""

    def sign(hashes: Column, part: int) -> Column:
        bit = lambda h: F.when(F.shiftrightunsigned(h, 6).bitwiseAND(SIGNS - 1) == part, F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long"))
        return F.aggregate(hashes, F.lit(0).cast("long"), lambda m, h: m.bitwiseOR(bit(h)))

    def text(t: Column, w: Column, m: Column) -> Column:
        bits = sum((F.bit_count(m[i]) for i in range(1, SIGNS)), F.bit_count(m[0]))
        return F.struct(t.alias("t"), w.alias("w"), needed(F.size(w)).cast("int").alias("k"), (F.size(w) - bits).alias("c"), m.alias("m"))

    def told(t: Column) -> Column:
        signs = lambda w: T.bound(F.transform(w, lambda x: F.xxhash64(x)), lambda hashes: F.array(*(sign(hashes, i) for i in range(SIGNS))))
        return T.bound(significant(t, " "), lambda w: T.bound(signs(w), lambda m: text(t, w, m)))

    each = lambda texts: F.transform(F.filter(texts, lambda t: t != ""), lambda t: told(t))
    return each(own).alias("own"), each(lines).alias("lines")


def covered_here(own: Column, lines: Column) -> Column:
    """The texts of ``own`` that some line of the same row covers, each tried up to its first cover; both as ``covers_of`` gives them.

    Two texts share no more words than bits of their signatures, and words without a bit of their own.
    """
    holds = lambda a, b: F.contains(a["t"], b["t"]) | F.contains(b["t"], a["t"])

    def shares(a: Column, b: Column) -> Column:
        bits = lambda i: F.bit_count(a["m"][i].bitwiseAND(b["m"][i]))
        least = F.least(a["k"], b["k"])
        return (sum((bits(i) for i in range(1, SIGNS)), bits(0)) + F.least(a["c"], b["c"]) >= least) & (F.size(F.array_intersect(a["w"], b["w"])) >= least)

    covered = F.filter(own, lambda a: F.exists(lines, lambda b: holds(a, b)) | F.exists(lines, lambda b: shares(a, b)))
    return F.transform(covered, lambda a: a["t"])


def word_index(findings: DataFrame, fixed: DataFrame) -> DataFrame:
    """(d, k, t, a, b, ws, n) of all texts of both sides."""
    return indexed(distinct_texts(findings, fixed))


def indexed(texts: DataFrame) -> DataFrame:
    """(d, k, t, a, b, ws, n): distinct texts with their significant words, rarest first, stored."""
    words = texts.select("k", F.explode("own").alias("w"))
    often = words.groupBy("w").agg(F.count(F.lit(1)).alias("often")).orderBy(F.desc("often"), "w").limit(FREQUENT)
    rank = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "w")
    ranked = words.join(F.broadcast(often), "w", "left").groupBy("k").agg(F.array_sort(F.collect_list(rank)).alias("r"))
    ws = F.coalesce(F.col("r.w"), F.array().cast("array<string>"))
    return store(texts.drop("own").join(ranked, "k", "left").select("d", "k", "t", "a", "b", ws.alias("ws"), F.size(ws).alias("n")), "word-index")


def postings(texts: DataFrame, side: str) -> DataFrame:
    """(d, w, k, n, p) of the words at which texts can meet, all but the most frequent one of each, by hash: pairs are verified."""
    at = texts.where("n >= 2").select("d", "k", "n", F.posexplode(F.transform("ws", lambda w: F.xxhash64(w))).alias("p", "w")).where("p <= n - 2")
    return at.withColumnsRenamed({c: c + side for c in ("k", "n", "p")})


def word_pairs(own: DataFrame, lines: DataFrame) -> DataFrame:
    """(d, ka, kb) of all texts that can share two words and 0.4 of the smaller set, from the postings of both sides."""
    na, nb, pa, pb = (F.col(c) for c in ("na", "nb", "pa", "pb"))
    enough = F.least(na - pa, nb - pb) >= needed(F.least(na, nb))
    early = F.when(na <= nb, pa <= na - needed(na)).otherwise(pb <= nb - needed(nb))
    return own.join(lines, ["d", "w"]).where(enough & early).select("d", "ka", "kb").distinct()


def share_words(pairs: DataFrame, index: DataFrame) -> DataFrame:
    """The k of the findings of ``pairs`` that share enough words with their lines."""
    words = lambda s: index.select(F.col("k").alias("k" + s), F.col("ws").alias("w" + s), F.col("n").alias("n" + s))
    both = pairs.join(words("a"), "ka").join(words("b"), "kb").withColumn("both", F.size(F.array_intersect("wa", "wb")))
    return both.where((F.col("both") >= 2) & (5 * F.col("both") >= 2 * F.least("na", "nb"))).select(F.col("ka").alias("k")).distinct()


def grams(text: Column, k: Column) -> Column:
    """The distinct substrings of ``k`` characters."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - k + 1), lambda i: F.substring(text, i, k)))


def holding_words(short: DataFrame, words: DataFrame, k: int = 4) -> DataFrame:
    """(d, s, w) with the string s of ``short`` inside the word w of the same d, by an equi join on the first ``k`` characters
    of s (all of them if it has fewer) among the substrings of w."""
    size = F.least(F.lit(k), F.length("s"))
    left = short.select("d", "s", size.alias("size"), F.substring(F.col("s"), F.lit(1), size).alias("g"))
    sizes = F.explode(F.sequence(F.lit(1), F.least(F.lit(k), F.length("w")))).alias("size")
    right = words.join(short.select("d").distinct(), "d", "left_semi").select("d", "w", sizes)
    right = right.select("d", "w", "size", F.explode(grams(F.col("w"), F.col("size"))).alias("g"))
    return left.join(right, ["d", "size", "g"]).where(F.contains("w", "s")).select("d", "s", "w").distinct()


def inside(open_: DataFrame, lines: DataFrame) -> DataFrame:
    """The k of open findings that hold a line, or stand in one, where the shorter text has less than two inner significant
    words.  All others that contain each other share enough words: inner words are whole words of the longer text too."""
    parts = F.split("t", " ")
    inner = F.array_intersect("ws", F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))))
    sides = open_.withColumn("b", F.lit(False)).unionByName(lines.withColumn("a", F.lit(False)))
    longest = F.array_max(F.transform(parts, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    short = sides.withColumn("inner", inner).where("size(inner) < 2").select("d", "k", "t", "a", F.try_element_at("inner", F.lit(1)).alias("w"), longest.alias("s"))
    words = sides.select("d", F.col("k").alias("kl"), F.col("t").alias("tl"), F.col("a").alias("al"), F.explode(F.array_distinct(parts)).alias("w"))
    few = short.where("w is null").drop("w")
    held = holding_words(few.select("d", "s").distinct(), words.select("d", "w").distinct())
    met = short.where("w is not null").drop("s").unionByName(few.join(held, ["d", "s"]).drop("s"))
    pairs = met.join(words, ["d", "w"]).where("a <> al").where(F.contains("tl", "t"))
    return pairs.select(F.when(F.col("a"), F.col("k")).otherwise(F.col("kl")).alias("k")).distinct()


def covered_texts(index: DataFrame) -> DataFrame:
    """(k) of the findings' texts that some fixed line of their report covers."""
    own, lines = index.where("a"), index.where("b")
    told = index.where("a and b").select("k")  # equal texts
    without = lambda found: own.join(found, "k", "left_anti")
    right = postings(lines, "b")
    first = F.row_number().over(W.partitionBy("d", "w").orderBy("nb", "kb"))
    likely = right.withColumn("r", first).where(F.col("r") <= LIKELY).drop("r")
    told = store(told.unionByName(share_words(word_pairs(postings(without(told), "a"), likely), index)), "covered")
    told = told.unionByName(store(share_words(word_pairs(postings(without(told), "a"), right), index), "covered"))
    return told.unionByName(inside(without(told), lines)).distinct()


def fixed_crossref(findings: DataFrame, fixed: DataFrame, within: str | None = None) -> DataFrame:
    """The fid of findings (fid, id, norm) that some fixed row (ids, norm) covers: by id, by containing text either
    way, or by two shared words that are 0.4 of the smaller word set.  ``within`` names a column of both, such as a
    report: then only rows of equal value meet.  Empty texts cover nothing; a null id has no cover by id.
    """
    d = (F.lit("") if within is None else F.col(within)).alias("d")
    findings, fixed = findings.select(d, "fid", "id", F.col("norm").alias("t")), fixed.select(d, "ids", F.col("norm").alias("t"))
    by_id = store(findings.join(fixed.select("d", F.explode("ids").alias("id")).distinct(), ["d", "id"], "left_semi").select("fid").distinct(), "by-id")
    left = findings.join(by_id, "fid", "left_anti")
    texts = distinct_texts(left, fixed)
    sizes = texts.groupBy("d").agg((F.count_if("a") * F.count_if("b")).alias("pairs")).where("pairs > 0")
    covered = looked_through(texts.join(sizes.where(F.col("pairs") <= PAIRS), "d", "left_semi"))
    large = store(sizes.where(F.col("pairs") > PAIRS).select("d"), "large")
    if large.head(1):
        index = indexed(texts.join(large, "d", "left_semi"))
        covered = covered.unionByName(index.where("a").join(covered_texts(index), "k", "left_semi").select("d", "t"))
    return by_id.unionByName(left.join(covered, ["d", "t"], "left_semi").select("fid")).distinct()
