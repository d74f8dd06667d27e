"""Columns extracted from the text of a log line or event.  All are built-in expressions; no match is null."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

#: Line terminators other than \n do not end a dot's reach.
UNIX = "(?d)"


#: A word boundary of ASCII letters, digits and _, whatever the Java version takes for one.
BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"


def ascii_bounds(pattern: str) -> str:
    return pattern.replace(r"\b", BOUNDARY)


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def extract_ts(line: Column) -> Column:
    """Raw time stamp text: the classic form if the line has one anywhere, else the ISO form."""
    return F.coalesce(found(line, P.TS_CLASSIC), found(line, P.TS_ISO))


def is_stack_line(line: Column) -> Column:
    return line.rlike(UNIX + P.STACK_LINE)


def is_cause_line(line: Column) -> Column:
    return line.rlike(UNIX + P.CAUSED_BY)


def level(text: Column) -> Column:
    """The level letter after thread and component wins over a level word anywhere."""
    letter = F.regexp_extract(text, P.LEVEL_LETTER, 1)
    named = F.create_map(*(F.lit(x) for pair in P.LEVEL_NAMES.items() for x in pair))
    return F.when(letter != "", F.element_at(named, letter)).otherwise(F.upper(found(text, P.LEVEL_WORD)))


def thread_id(text: Column) -> Column:
    return found(text, P.THREAD)


def message_code(text: Column) -> Column:
    return found(text, P.CODE)


def exception(text: Column) -> Column:
    return F.when(holds(text, "Exception", "Error"), found(text, P.EXCEPTION))


def root_cause(text: Column) -> Column:
    """The class on the last ``Caused by:`` line that names one."""
    return F.when(text.contains("Caused by:"), F.try_element_at(F.regexp_extract_all(text, F.lit("(?dm)" + P.ROOT_CAUSE), F.lit(1)), F.lit(-1)))


def signal_tags(text: Column) -> Column:
    """Sorted array of the signals that the text shows."""
    shows = lambda tag, p: holds(F.lower(text), *P.TAG_NEEDS[tag]) & text.rlike(UNIX + p)
    return F.array_compact(F.array(*(F.when(shows(tag, p), F.lit(tag)) for tag, p in P.TAGS.items())))


def redact(text: Column) -> Column:
    for (pattern, to), parts in zip(P.REDACTIONS, P.REDACTION_NEEDS, strict=True):
        text = replaced(text, lambda x, parts=parts: holds(F.lower(x), *parts), pattern, to)
    return text


def hung_thread_name(text: Column) -> Column:
    return F.coalesce(*(found(text, P.HUNG_NAME, i) for i in (1, 2, 3, 4)))


def is_hung(text: Column) -> Column:
    return text.rlike(UNIX + P.TAGS["HungThreads"])


def stack_sample(text: Column, most: int = 5) -> Column:
    """The first stack and cause lines of the text, trimmed."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: is_stack_line(x) | is_cause_line(x))
    return F.transform(F.slice(lines, 1, most), lambda x: F.trim(x, F.lit(" \t\r\f\x0b")))


def sample_text(text: Column, most: int = 4000) -> Column:
    return F.substring(text, 1, most)


def truncate_lines(text: Column, most: int = 25) -> Column:
    """At most ``most`` lines, with a marker if there were more; a line end at the end opens no line."""
    lines = F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1)
    return F.when(F.size(lines) <= most, text).otherwise(F.concat(F.array_join(F.slice(lines, 1, most), "\n"), F.lit("\n...[truncated]...")))


def short_exception(name: Column) -> Column:
    return F.substring_index(name, ".", -1)


def code_prefix(code: Column) -> Column:
    return found(code, "^[A-Z]+", 0)


def sanitize(text: Column) -> Column:
    """Strips the tags that delimit prompts and escapes what could make new ones."""
    text = F.regexp_replace(text, P.DELIMITER_TAGS, "")
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def event_label(lvl: Column, code: Column, exc: Column) -> Column:
    """Level, code and short class in fixed slots; an absent code leaves its blank."""
    part = lambda c: F.coalesce(c, F.lit(""))
    return F.trim(F.concat(part(lvl), F.lit(" "), part(code), F.lit(" "), part(short_exception(exc))))


def cache_key(query: Column, codes: Column, exceptions: Column, tags: Column, match_type: Column, *, provider: str | None = None, style: str | None = None) -> Column:
    """Key of a stored response; one for each provider but the usual one, and for each style of answers."""
    joined = lambda a: F.array_join(F.array_sort(F.coalesce(a, F.array().cast("array<string>"))), ",")
    key = F.concat_ws("|", F.lower(F.trim(query)), joined(codes), joined(exceptions), joined(tags), F.coalesce(match_type, F.lit("none")))
    return F.concat(F.lit(f"{provider}:" if provider else ""), key, F.lit(f":{style}" if style else ""))


def is_error(lvl: Column) -> Column:
    return F.coalesce(lvl.isin(*P.ERROR_LEVELS), F.lit(False))


def priority(lvl: Column, exc: Column, code: Column, tags: Column) -> Column:
    """How much an event deserves to be a sample."""
    return (
        F.when(lvl == "FATAL", 4).when(lvl.isin("ERROR", "SEVERE"), 3).when(lvl.isin("WARNING", "WARN"), 1).otherwise(0)
        + F.when(exc.isNotNull(), 2).otherwise(0)
        + F.when(code.isNotNull(), 1).otherwise(0)
        + F.when(F.size(tags) > 0, 1).otherwise(0)
    )


def holds(text: Column, *parts: str) -> Column:
    """Whether the text has one of the parts; far cheaper than a pattern."""
    out = text.contains(parts[0])
    for part in parts[1:]:
        out = out | text.contains(part)
    return out


def is_fixed(text: Column) -> Column:
    return holds(text, "Done", "Fixed", "\u2705", "\u2714") | (text.contains("~~") & text.rlike(r"~~.*?~~"))


def bound(value: Column, f) -> Column:
    """``f`` of a value that is bound by a lambda, so it is evaluated once however often it is read."""
    return F.transform(F.array(value), f)[0]


def replaced(text: Column, needs, pattern: str, to: str) -> Column:
    """The pattern replaced where ``needs`` holds."""
    return bound(text, lambda x: F.when(needs(x), F.regexp_replace(x, pattern, to)).otherwise(x))


def normalize(text: Column, roots: tuple[str, ...] = P.PATH_ROOTS) -> Column:
    """A finding's text for matching: no marks, markup, efforts or paths below ``roots``; lower case.

    A pattern runs only on texts that hold what it needs.  Outer blanks take no part in any and go last.
    """
    several = r" \s+|[\t\n\x0B\f\r]\s*"  # all blanks but single spaces
    blanks = ("  ", "\t", "\n", "\x0b", "\f", "\r")
    plain = all(re.fullmatch(r"[\w/ -]+", root) for root in roots)
    effort = lambda unit: lambda x: x.contains(unit) & x.rlike(rf"\d\s*{unit}")
    for needs, pattern, to in (
        (lambda x: x.contains("~~"), r"~~(.*?)~~", "$1"),
        (lambda x: holds(x, "\u2705", "\u2714"), r"[\x{2705}\x{2714}]", ""),
        (lambda x: holds(x, *blanks), several, " "),
        (lambda x: holds(x, *"|`*_~"), r"[|`*_~]", ""),
        (effort("min"), r"\s*\d+\s*min\b", ""),
        (effort("hr"), r"\s*\d+\s*hr\b", ""),
        (lambda x: holds(x, *roots) if plain else x.rlike("|".join(roots)), r"\b(" + "|".join(roots) + r")[\w./:-]*", ""),
        (lambda x: holds(x, *blanks), several, " "),
    ):
        text = replaced(text, needs, UNIX + ascii_bounds(pattern), to)
    return F.lower(F.trim(text))
