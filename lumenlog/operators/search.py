"""Search over events for a list of user queries, rule routing, and prompt rows.

User queries are a list from the caller, so they become literals of one scan: every event is tested once for
all of them, and only hits leave the scan.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .summary import order

KINDS = ("code", "exception", "text")


def search_code(events: DataFrame, query: str) -> DataFrame:
    """Events whose code holds the query, if the query starts like a code."""
    query = query.strip()
    if not re.match(P.CODE, query):
        return events.where(F.lit(False))
    return events.where(F.upper("code").contains(query.upper()))


def search_exception(events: DataFrame, query: str) -> DataFrame:
    return events.where(F.lower("exception").contains(query.strip().lower()))


def search_text(events: DataFrame, query: str) -> DataFrame:
    return events.where(F.lower("text").contains(query.strip().lower()))


def all_hits(events: DataFrame, queries: Sequence[str]) -> DataFrame:
    """(query_id, query, priority, event columns): every hit of every kind, found in one scan."""
    def flag(i: int, query: str) -> Column:
        upper, lower = query.strip().upper(), query.strip().lower()
        like = F.upper("code").contains(upper) if re.match(P.CODE, query.strip()) else F.lit(False)
        best = F.when(like, 0).when(F.lower("exception").contains(lower), 1).when(F.lower("text").contains(lower), 2)
        return F.when(best.isNotNull(), F.struct(F.lit(i).cast("long").alias("query_id"), F.lit(query).alias("query"), best.alias("priority")))

    hits = events.withColumn("hit", F.explode(F.array_compact(F.array(*(flag(i, q) for i, q in enumerate(queries))))))
    return hits.select("hit.query_id", "hit.query", "hit.priority", *events.columns)


def search_events(events: DataFrame, queries: Sequence[str], most: int = 3) -> DataFrame:
    """One row per query: the first kind that hits, its first events, and all codes, exceptions and tags of its hits.

    An event that hits by code is no exception hit of the same query, so kinds count events by their own test.
    """
    spark = events.sparkSession
    hits = all_hits(events, queries)
    best = hits.groupBy("query_id").agg(F.min("priority").alias("priority"))  # one row a query
    own = hits.join(F.broadcast(best), ["query_id", "priority"])
    sets = own.groupBy("query_id", "priority").agg(
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.array_sort(F.collect_set("exception")).alias("exceptions"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("tags")))).alias("tags"),
    )
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(*order(events)))
    first = own.withColumn("r", rank).where(F.col("r") <= most).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("r", *order(events), "text"))).alias("events"))
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(queries)], "query_id long, query string")
    kind = F.when(F.col("priority") == 0, KINDS[0]).when(F.col("priority") == 1, KINDS[1]).when(F.col("priority") == 2, KINDS[2])
    none = F.array().cast("array<string>")
    return (
        asked.join(sets, "query_id", "left")
        .join(first, "query_id", "left")
        .select(
            "query_id",
            "query",
            kind.alias("match_type"),
            *(F.coalesce(c, none).alias(c) for c in ("codes", "exceptions", "tags")),
            "events",
        )
    )


def rule_table(spark: SparkSession, rules: dict[str, Sequence[str]]) -> DataFrame:
    """(key, key_ord, pos, rule) of one of the fixed rule maps: a few dozen rows."""
    rows = [(k, i, j, r) for i, (k, names) in enumerate(rules.items()) for j, r in enumerate(names)]
    return spark.createDataFrame(rows, "key string, key_ord int, pos int, rule string")


def longest_prefix_route(codes: DataFrame) -> DataFrame:
    """(code, prefix, rule, pos): the rules of the longest known prefix of each code, of 3 letters at least."""
    rules = rule_table(codes.sparkSession, P.RULES_BY_CODE_PREFIX)
    own = codes.select("code", T.code_prefix(F.col("code")).alias("p")).distinct()
    known = F.broadcast(rules.where(F.length("key") >= 3))  # the fixed map
    routed = own.join(known, F.col("p").startswith(F.col("key")))
    best = F.rank().over(W.partitionBy("code").orderBy(F.desc(F.length("key"))))
    return routed.withColumn("r", best).where("r = 1").select("code", F.col("key").alias("prefix"), "rule", "pos")


def route_rules(matches: DataFrame) -> DataFrame:
    """(query_id, source, rule, ord): rules by tag, code prefix, exception keyword and query word, in order.

    ``ord`` sorts as tags, codes, exceptions, words; within them by the match's place, then the rule's.
    """
    spark = matches.sparkSession
    number = lambda *parts: F.array(*(F.col(p).cast("int") if isinstance(p, str) else F.lit(p) for p in parts))
    tags = matches.select("query_id", F.posexplode("tags").alias("i", "key")).join(F.broadcast(rule_table(spark, P.RULES_BY_TAG)), "key")
    tags = tags.select("query_id", F.lit("tag").alias("source"), "rule", number(0, "i", 0, "pos").alias("ord"))
    codes = matches.select("query_id", F.posexplode("codes").alias("i", "code"))
    codes = codes.join(longest_prefix_route(codes), "code").select("query_id", F.lit("code").alias("source"), "rule", number(1, "i", 0, "pos").alias("ord"))
    named = matches.select("query_id", F.posexplode("exceptions").alias("i", "e"))
    known = F.broadcast(rule_table(spark, P.RULES_BY_EXCEPTION))
    exceptions = named.join(known, F.lower("e").contains(F.col("key"))).select("query_id", F.lit("exception").alias("source"), "rule", number(2, "i", "key_ord", "pos").alias("ord"))
    known = F.broadcast(rule_table(spark, P.RULES_BY_WORD))
    words = matches.join(known, F.lower("query").contains(F.col("key"))).select("query_id", F.lit("word").alias("source"), "rule", number(3, 0, "key_ord", "pos").alias("ord"))
    return tags.unionByName(codes).unionByName(exceptions).unionByName(words)


def select_rules(matches: DataFrame, most: int = P.MOST_RULES) -> DataFrame:
    """(query_id, rank, rule): each rule once, at its first place; the default rule if none is found."""
    first = route_rules(matches).groupBy("query_id", "rule").agg(F.min("ord").alias("ord"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("ord"))
    chosen = first.withColumn("rank", rank).where(F.col("rank") <= most)
    return matches.select("query_id").join(chosen, "query_id", "left").select("query_id", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("rule", F.lit(P.DEFAULT_RULE)).alias("rule"))


def rule_context(selected: DataFrame, rule_docs: DataFrame) -> DataFrame:
    """(query_id, context): the texts of the chosen rules in order; rules without a text are left out."""
    joined = selected.join(rule_docs, "rule")
    part = F.concat(F.lit("--- "), F.col("rule"), F.lit(" ---\n"), F.trim("text"))
    return joined.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", part.alias("part")))), lambda x: x["part"]), "\n\n").alias("context"))


def cache_keys(matches: DataFrame, *, provider: str | None = None, style: str | None = None) -> DataFrame:
    key = T.cache_key(F.col("query"), F.col("codes"), F.col("exceptions"), F.col("tags"), F.col("match_type"), provider=provider, style=style)
    return matches.withColumn("cache_key", key)


def prompt_worklist(matches: DataFrame, cache: DataFrame) -> DataFrame:
    """Matches whose cache key has no stored response."""
    return cache_keys(matches).join(cache.select("cache_key"), "cache_key", "left_anti")


def prompt_rows(matches: DataFrame, rule_docs: DataFrame, excerpts: int = 2) -> DataFrame:
    """(query_id, user_part, rules, context): the cleaned question, what matched, and excerpts of the first hits."""
    chosen = select_rules(matches)
    rules = chosen.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "rule"))), lambda x: x["rule"]), ", ").alias("rules"))
    line = lambda title, c: F.when(F.size(c) > 0, F.concat(F.lit(title), F.array_join(c, ", ")))
    shown = F.transform(
        F.slice("events", 1, excerpts),
        lambda e: F.concat(F.lit('<log_excerpt id="'), e["r"].cast("string"), F.lit('">'), T.sanitize(T.truncate_lines(e["text"])), F.lit("</log_excerpt>\n")),
    )
    hit = F.concat_ws(
        "\n",
        F.lit("<context>"),
        line("Matching WAS codes: ", F.col("codes")),
        line("Matching exceptions: ", F.col("exceptions")),
        line("Signal tags: ", F.col("tags")),
        F.lit("</context>\n"),
        F.array_join(shown, "\n"),
    )
    none = F.lit("No exact match was found in the current log. Provide general guidance.\n")
    question = F.concat(F.lit("<user_query>"), T.sanitize(F.col("query")), F.lit("</user_query>\n\n"))
    user = F.concat(question, F.when(F.col("match_type").isNotNull(), hit).otherwise(none))
    return matches.select("query_id", user.alias("user_part")).join(rules, "query_id").join(rule_context(chosen, rule_docs), "query_id", "left")
