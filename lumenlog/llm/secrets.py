"""Secret scans: three fixed patterns, and the guess cost of values in credential contexts.

Base spans are whole matches of three patterns, leftmost and non-overlapping within a kind; a match whose
value is too short is dropped after it was found.  The method adds spans of kind ``guess``: in a wider set
of credential contexts (base assignments, names with a credential word, ``user:password@`` in URLs, bearer tokens) the
value is cut into words, dates, repeats, sequences, keyboard walks and brute-force stretches so that the product of
the parts' guesses is smallest, by dynamic programming over its characters.  A value whose log10 guess
count reaches ``min_guesses`` is reported; an easily guessed one is not.

Words are a short fixed list of common passwords and what ``frequent_words`` finds in the corpus: every text is
counted, and a word is common if it stands in many texts.  Repeats, their units, sequences and walks may have any length.

Defined results: a null text counts as empty and has no spans; offsets are code points, end exclusive;
repeated rows are scanned alike; an empty table gives no rows; other columns pass through, but one named as
``into`` is replaced.  Byte searches decide which of the patterns are run at all, so most texts cost a few passes
in C.  A value is read whole, but no part is weighed that follows parts of ``min_guesses`` together, so a long
random value costs no more than a short one.
"""

from __future__ import annotations

import array
import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import binary_values

KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Contexts whose value is weighed; group 1 is the value.  A key is any name with a credential word in it; ``pin`` has to be
#: a part of the name by itself, as in USER_PIN or userPin, not letters of a word.  A name without a value is matched whole
#: and has no group 1, so a long one is read once.
CONTEXTS = (
    re.compile(
        r"""(?:password|passwd|passphrase|pwd|secret|token|credential|(?:api|auth|access|private)[_.-]?key|(?<![A-Za-z])pin(?![A-Za-z])|(?-i:(?<=[a-z0-9])Pin(?![a-z])))"""
        r"""[A-Za-z0-9_.-]*+(?:["']?\x20*(?::=|=>|[:=])\x20*["']?([!-&(-~]{6,}))?""",
        re.I | re.A,
    ),
    re.compile(r"\bbearer\x20+([A-Za-z0-9._~+/=-]{8,})", re.I | re.A),
    re.compile(r"://[^\s/:@]+:([^\s/@]{6,})@", re.A),
)
#: Byte strings of which a lower-cased text holds one if the pattern beside them can match.
ASSIGN_HINTS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
CONTEXT_HINTS = (
    *ASSIGN_HINTS, b"passphrase", b"pwd", b"credential", b"pin", b"bearer", b"://",
    *(a + b + b"key" for a in (b"api", b"auth", b"access", b"private") for b in (b"", b"_", b".", b"-")),
)
HEX_FOLD = bytes(49 if 48 <= b <= 57 or 97 <= b <= 102 else 48 for b in range(256))
#: Common passwords and words, most common first: a word costs its rank.
WORDS = (
    "password", "123456", "admin", "welcome", "letmein", "secret", "token", "qwerty", "monkey", "dragon", "master", "login",
    "test", "guest", "hello", "love", "summer", "winter", "spring", "autumn", "sunshine", "princess", "football", "baseball",
    "shadow", "superman", "batman", "trustno", "access", "flower", "iloveyou", "michael", "jordan", "hunter", "ranger", "ninja",
    "changeme", "default", "root", "user", "example", "sample", "demo", "value", "string", "null", "none", "true", "false",
    "your", "here", "name", "key", "api", "my", "the", "and", "for", "with", "this", "that", "from", "have", "not", "are", "was",
    "pass", "word", "code", "data", "file", "home", "work", "office", "house", "money", "company", "server", "client", "system",
    "service", "account", "email", "mail", "phone", "blue", "red", "green", "black", "white", "orange", "purple", "happy",
    "lucky", "star", "moon", "sun", "cat", "dog", "horse", "battery", "staple", "correct", "tiger", "lion", "eagle", "bear",
    "monday", "friday", "january", "june", "july", "august", "october", "december", "london", "paris", "berlin", "madrid",
)
RANK = {w: k + 1 for k, w in enumerate(WORDS)}
ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
NEXT = {(a, b) for row in ROWS for a, b in [*zip(row, row[1:]), *zip(row[1:], row)]}  # noqa: B905
LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})
LEET = str.maketrans("@4310$57!", "aaeiossti")
DATE = re.compile(r"(?:19|20)\d\d|(?:(?:19|20)\d\d([-/.]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01]))|(?:0?[1-9]|[12]\d|3[01])([-/.]?)(?:0?[1-9]|1[0-2])\2(?:(?:19|20)?\d\d)")
#: No word of the lists is longer.
LONGEST_WORD = 20
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32 for b in range(256))


def char_cost(c: str) -> float:
    return 1.0 if c.isdigit() else math.log10(26) if c.isascii() and c.isalpha() else math.log10(33) if c.isascii() else 2.0


def word_cost(part: str, low: str, rank: int, exact: bool) -> float:
    capitals = 1 if part == low or part[1:] == low[1:] else 2 ** min(len(part), 10)
    return math.log10(rank * capitals * (1 if exact else 2) + 1)


def walk_cost(n: int) -> float:
    return math.log10(47 * 2 ** min(n, 6) * n)


def sequence_cost(n: int) -> float:
    return math.log10(26 * n)


def date_cost(n: int) -> float:
    return math.log10(365 * 150 if n > 4 else 150)


def least_cost(n: int) -> float:
    """No ``n`` characters cost less, however they are cut: the cheapest word is a long one, and only repeats stretch it."""
    return math.log10(max(2.0, n / 10)) if n else 0.0


def common_length(value: str, a: int, b: int) -> int:
    """How many characters from ``a`` and from ``b`` > a on are equal."""
    n, k, step = len(value) - b, 0, 16
    while k < n and value[a + k : a + k + step] == value[b + k : b + k + step]:
        k += step
        step *= 2
    k, high = min(k, n), min(k + step, n)
    while k < high:  # the first that differ are in here, if any do
        mid = (k + high + 1) // 2
        if value[a + k : a + mid] == value[b + k : b + mid]:
            k = mid
        else:
            high = mid - 1
    return k


class Cheapest:
    """Least sums up to each place of a value, and which run the last part there belongs to."""

    def __init__(self, n: int, limit: float):
        self.best, self.run, self.limit = array.array("d", [math.inf]) * (n + 1), array.array("q", [-1]) * (n + 1), limit
        self.best[0], self.ahead = 0.0, 1  # places from here on whose sum is below the limit
        self.starts: dict[tuple[int, int], list[tuple[int, float, float]]] = {}  # by run and phase, see cheaper_until

    def offer(self, place: int, cost: float, run: int = -1) -> None:
        before = self.best[place]
        if cost < before and cost < self.limit:
            self.ahead += before >= self.limit or before == math.inf
            self.best[place], self.run[place] = cost, run

    def cheaper_until(self, start: int, step: int, run: int) -> float:
        """Up to where a part of ``run`` from ``start`` on can cost less than one from an earlier start in the same phase.

        Costs grow with the logarithm of the length, so of two starts the later one is cheaper first, if ever, and the earlier one
        from some place on for good.  Starts that are cheapest nowhere any more are dropped, the others wait as (place, sum, until).
        """
        base, until, waiting = self.best[start], math.inf, self.starts.setdefault((run, start % step), [])
        while waiting:
            before, own, ends = waiting[-1]
            until = start + (start - before) / math.expm1(min(base - own, 99) * math.log(10)) if base > own else math.inf
            if ends > until:
                break
            waiting.pop()
        waiting.append((start, base, until))
        return until

    def offer_ends(self, start: int, end: int, step: int, least: int, costs, run: int) -> None:
        """Parts of ``least`` steps and more from ``start`` on, up to ``end``, whose costs ``costs`` gives for numbers of steps.

        Every end counts; left out are those whose sum is not below the limit or not below that of an earlier start, and of many
        ends those from which the value cannot cost less than it is known to.
        """
        most = (end - start) // step
        if most < least:
            return
        base, until = self.best[start], self.cheaper_until(start, step, run)
        if until < end:
            most = min(most, int((until - start) / step) + 1)
        if base + costs(most) >= self.limit:
            most = min(most, least + bisect_left(range(least, most + 1), self.limit - base, key=costs))
        if most - least < 40:
            for m in range(least, most + 1):
                self.offer(start + step * m, base + costs(m), run)
            return
        import numpy as np

        n = len(self.best) - 1
        if start + step * most == n:
            self.offer(n, base + costs(most), run)
        own = slice(start + step * least, start + step * most + 1, step)
        best, runs = np.frombuffer(self.best), np.frombuffer(self.run, np.int64)
        sums = base + costs(np.arange(least, most + 1))
        rest = np.log10(np.maximum(2.0, (n - np.arange(own.start, own.stop, step)) / 10))  # least_cost, but for the end
        better = (sums < best[own]) & (sums + rest < min(self.limit, best[n]))
        self.ahead += int((better & ((best[own] >= self.limit) | np.isinf(best[own]))).sum())
        best[own][better] = sums[better]
        runs[own][better] = run


def logarithm(x):
    """log10 of a number or of an array of them."""
    if isinstance(x, int | float):
        return math.log10(x)
    import numpy as np

    return np.log10(x)


def walk_costs(n):
    return walk_cost(n) if isinstance(n, int) else logarithm(47 * 64.0 * n)  # arrays are of long walks


def guess_cost(value: str, rank: dict[str, int] = RANK, limit: float = math.inf, held: dict | None = None) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; ``limit`` if it is not below that.

    Every part that starts where a sum below ``limit`` ends is tried, unless that sum and the least that the rest costs are no
    less than what the whole value is known to cost.  Costs are positive, so once no such place is ahead, nothing can be
    below ``limit``.  Two parts of one run after each other never beat one of both, so a run does
    not start where the cheapest part before is of the same run.  A repeat's unit is the shortest one.
    """
    n, low = len(value), value.translate(LOWER)
    plain = low.translate(LEET)
    held = {} if held is None else held  # costs of units
    found = Cheapest(n, limit)
    walk = sequence = 0  # where the run that covers this place ends
    walk_run = sequence_run = 0
    periods: dict[int, tuple[int, int]] = {}  # the last run of each period
    for i in range(n):
        if not found.ahead:
            return limit
        own = found.best[i]
        if own >= limit:
            continue
        found.ahead -= 1
        bound = min(limit, found.best[n])
        if own + least_cost(n - i) >= bound:
            continue
        before = found.run[i]
        found.offer(i + 1, own + char_cost(value[i]))
        for j in range(i + 2, min(n, i + LONGEST_WORD) + 1):
            word = low[i:j]
            if r := rank.get(word):
                found.offer(j, own + word_cost(value[i:j], word, r, True))
            elif r := rank.get(plain[i:j]):
                found.offer(j, own + word_cost(value[i:j], word, r, False))
        if value[i].isdigit():
            for j in range(i + 4, min(n, i + 10) + 1):
                if DATE.fullmatch(value, i, j):
                    found.offer(j, own + date_cost(j - i))
        if walk <= i + 1:
            walk, walk_run = i + 1, 4 * i
            while walk < n and (low[walk - 1], low[walk]) in NEXT:
                walk += 1
        if before != walk_run or not i:
            # long walks have one cost a step more; the first few have their own
            for m in range(3, min(walk - i, 6) + 1):
                found.offer(i + m, own + walk_cost(m), walk_run)
            if walk - i > 6:
                found.offer_ends(i, walk, 1, 7, walk_costs, walk_run)
        shortest = 1  # of units that are still looked for
        if i + 1 < n and abs(step := ord(value[i + 1]) - ord(value[i])) <= 2:
            if sequence <= i + 1:
                sequence_run = 4 * i + 1
                if step:
                    sequence = i + 2
                    while sequence < n and ord(value[sequence]) - ord(value[sequence - 1]) == step:
                        sequence += 1
                else:
                    sequence = i + 1 + common_length(value, i, i + 1)
            if before != sequence_run or not i:
                base = 26.0 if step else min(26.0, 10 ** char_cost(value[i]))  # equal characters are a repeat too
                found.offer_ends(i, sequence, 1, 3, lambda m, base=base: logarithm(base * m), sequence_run)
            if not step:
                shortest = (sequence - i) // 2 + 1
        while 2 * shortest <= n - i:
            at = value.find(value[i : i + shortest], i + shortest)
            u = at - i
            if at < 0 or 2 * u > n - i:
                break
            start, end = periods.get(u, (0, 0))
            if not (start <= i and i + 2 * u <= end):
                start, end = i, at + common_length(value, i, at)
                if end < i + 2 * u:
                    shortest = u + 1
                    continue
                periods[u] = start, end
            run = 4 * (start * (n + 1) + u) + 2
            if before != run:
                most = (end - i) // u
                left = min(math.log10(2) + least_cost(n - i - 2 * u), math.log10(max(2, min(most, (n - i - LONGEST_WORD) / u))))
                unit, room = value[i:at], bound - own - left  # repeats, and what follows them, cost that much at least
                cost, known = held.get(unit, (0.0, 0.0))  # below what it was known for it is exact
                if cost >= known and known < room:
                    cost = guess_cost(unit, rank, room, held)
                    held[unit] = cost, room
                if cost < room:
                    found.offer_ends(i, end, u, 2 if u > 1 else 3, lambda m, cost=cost: cost + logarithm(m), run)
            shortest = (end - i) // 2 + 1  # a longer unit within the run repeats this one
    return min(found.best[n], limit)


def frequent_words(docs: DataFrame, *, text: str = "text", most: int = 20_000, share: float = 1e-3, least: int = 20) -> dict[str, int]:
    """The words of 4 to 20 ASCII letters that stand in at least ``share`` of all texts (and in ``least``), by rank.

    Every text is counted.  No more words than a text's mean number of distinct ones, divided by ``share``, can be so
    common, which bounds what reaches the driver at any size; the ``most`` most common are kept.  A value that stands in
    a few texts only, such as a leaked password, never becomes a word.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for raw in binary_values(batch.column(0)):
                held.update(set((raw or b"").translate(LETTERS).split()))
            if len(held) > 200_000:
                yield out()
                held.clear()
        yield out()

    n = docs.count()
    counted = docs.select(text).mapInArrow(count, "word string, n long").where(f"length(word) between 4 and {LONGEST_WORD}")
    common = counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= max(least, math.ceil(share * n)))
    rows = sorted(common.collect(), key=lambda r: (-r.n, r.word))[:most]
    found = [*WORDS, *(r.word for r in rows if r.word not in RANK)]
    return {w: k + 1 for k, w in enumerate(found)}


def scan_secrets(raw: bytes | None, min_guesses: float, rank: dict[str, int] = RANK) -> dict:
    """All spans of one text as (kind, start, end) in order, and how many of each base kind."""
    raw = raw or b""
    low = raw.lower()
    assign = any(h in low for h in ASSIGN_HINTS)
    access = b"AKIA" in raw
    hexes = b"1" * 24 in raw.translate(HEX_FOLD)
    context = assign or any(h in low for h in CONTEXT_HINTS)
    spans: list[tuple[int, int, int]] = []
    if assign or access or hexes or context:
        text = raw.decode("utf-8", "replace")
        if assign:
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if access:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        if hexes:
            spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
        if context:
            values = {m.span(1) for pattern in CONTEXTS for m in pattern.finditer(text) if m[1]}
            if assign:
                values |= {m.span(2) for m in ASSIGN.finditer(text) if len(m[2]) >= 6}
            spans += [(a, 3, b) for a, b in values if guess_cost(text[a:b], rank, min_guesses) >= min_guesses]
    spans.sort()
    base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < 3)
    return {
        "n_assign": sum(k == 0 for _, k, _ in spans),
        "n_access": sum(k == 1 for _, k, _ in spans),
        "n_hex": sum(k == 2 for _, k, _ in spans),
        "base_sha256": hashlib.sha256(base.encode()).hexdigest(),
        "spans": [{"kind": KINDS[k], "start": a, "end": b} for a, k, b in spans],
    }


def find_secrets(docs: DataFrame, *, text: str = "text", min_guesses: float = 10.0, words: dict[str, int] | None = None, into: str = "secrets") -> DataFrame:
    """``docs`` with a struct column ``into``: n_assign, n_access, n_hex, base_sha256 and all spans.

    ``words`` ranks common words, as ``frequent_words`` finds them; by default only the fixed list counts.
    """
    held = docs.sparkSession.sparkContext.broadcast(RANK if words is None else words)

    @arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:array<struct<kind:string,start:bigint,end:bigint>>>")
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        counts = [(c, pa.int64()) for c in ("n_assign", "n_access", "n_hex")]
        kind = pa.struct([*counts, ("base_sha256", pa.string()), ("spans", pa.list_(span))])
        rank = held.value
        for batch in batches:
            yield pa.array([scan_secrets(raw, min_guesses, rank) for raw in binary_values(batch)], kind)

    return docs.withColumn(into, scan.asNondeterministic()(F.col(text)))
