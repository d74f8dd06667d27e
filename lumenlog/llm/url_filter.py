"""URL filters: host and path rules first, then a weighted vocabulary counted by Aho-Corasick.

The rule whose host and path together are longest decides; a rule fits its host and all subdomains if the
path starts with the rule's.  Without a rule the lower-cased URL is read once by an automaton of terms.  A
hit counts if no ASCII letter or digit stands on either side.  One strict term, or soft terms whose
weights (each distinct term once) reach ``limit``, block.

Defined results: a null URL, or one without ``://``, has an empty host and path and no rule; the
vocabulary still reads it, and a null counts as empty; repeated rows are judged alike; very long URLs are read
whole; an empty table gives no rows; other columns pass, but one named as ``into`` is replaced, and ``__terms`` is the
operator's own.  The vocabulary (English, with some German, French and Spanish) and the rules are parameters, so
their size does not grow with the pages.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import LOWER_FOLD, binary_values

RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: One of these blocks.
STRICT = (
    "xxx", "porn", "porno", "pornos", "pornhub", "pornstar", "xvideos", "xnxx", "redtube", "hentai", "sexcam", "sexcams", "sexchat", "sexshop", "camgirls", "livejasmin",
    "milf", "milfs", "bdsm", "blowjob", "gangbang", "bukkake", "fetish", "escort", "escorts", "callgirl", "callgirls", "puta", "putas", "salope", "nutten", "fickt", "sexo", "pornografia",
    "warez", "keygen", "keygens", "malware", "phishing", "ransomware", "botnet", "carding", "cvvshop", "darknet", "spamlink", "linkfarm",
)
#: Distinct ones add up.
SOFT = {
    "adult": 1, "adults": 1, "sex": 2, "sexy": 1, "nude": 2, "nudes": 2, "naked": 1, "erotic": 2, "erotik": 2, "erotica": 2, "erotico": 2, "sexe": 2, "sexuel": 1, "webcam": 1, "cam": 1, "cams": 1, "hot": 1, "teen": 1, "teens": 1, "desnuda": 2, "nackt": 2, "nue": 1,
    "casino": 2, "casinos": 2, "kasino": 2, "poker": 1, "roulette": 1, "blackjack": 1, "baccarat": 1, "bingo": 1, "bet": 1, "bets": 1, "betting": 1, "bookmaker": 1, "slot": 1, "slots": 1, "gambling": 2, "jackpot": 1, "lotto": 1, "apuestas": 2, "wetten": 1, "paris-sportifs": 2,
    "viagra": 2, "cialis": 2, "levitra": 2, "xanax": 2, "tramadol": 2, "pills": 1, "pharmacy": 1, "rx": 1, "steroids": 1,
    "torrent": 2, "torrents": 2, "crack": 1, "cracked": 2, "serial": 1, "nulled": 2, "pirate": 1, "free": 1, "download": 1, "downloads": 1, "apk": 1, "mod": 1, "gratis": 1,
    "dating": 1, "hookup": 2, "hookups": 2, "singles": 1, "mature": 1,
    "loan": 1, "loans": 1, "payday": 2, "kredit": 1, "credito": 1, "crypto": 1, "forex": 1, "invest": 1, "bitcoin": 1, "profit": 1, "replica": 1, "rolex": 1, "cheap": 1, "discount": 1,
    "click": 1, "ads": 1, "adserver": 2, "promo": 1, "coupon": 1, "coupons": 1, "affiliate": 1, "winner": 1, "prize": 1, "giveaway": 1,
}
LIMIT = 3
RESULT = "struct<strict:array<string>,soft:array<string>,weight:bigint>"


def count_terms(auto, raw: bytes | None) -> dict:
    """The distinct strict and soft terms that stand on their own in one URL, and the soft ones' weight."""
    url = (raw or b"").translate(LOWER_FOLD).decode("latin-1")
    alone = lambda i: not (0 <= i < len(url) and url[i].isascii() and url[i].isalnum())
    strict, soft = set(), {}
    for end, (term, weight) in auto.iter(url):
        if alone(end + 1) and alone(end - len(term)):
            if weight is None:
                strict.add(term)
            else:
                soft[term] = weight
    return {"strict": sorted(strict), "soft": sorted(soft), "weight": sum(soft.values())}


def term_counter(strict: tuple[str, ...], soft: dict[str, int]):
    @arrow_udf(RESULT)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        import ahocorasick
        auto = ahocorasick.Automaton()
        for term in strict:
            auto.add_word(term, (term, None))
        for term, weight in soft.items():
            auto.add_word(term, (term, weight))
        auto.make_automaton()
        kind = pa.struct([("strict", pa.list_(pa.string())), ("soft", pa.list_(pa.string())), ("weight", pa.int64())])
        for batch in batches:
            yield pa.array([count_terms(auto, raw) for raw in binary_values(batch)], kind)

    return count.asNondeterministic()


def host_of(url: Column) -> Column:
    after = F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(after, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(
    pages: DataFrame,
    *,
    url: str = "url",
    rules: tuple = RULES,
    strict: tuple[str, ...] = STRICT,
    soft: dict[str, int] | None = None,
    limit: int = LIMIT,
    into: str = "url_filter",
) -> DataFrame:
    """``pages`` with a struct column ``into``: host, path, rule, strict, soft, weight, verdict."""
    terms = term_counter(tuple(strict), SOFT if soft is None else soft)
    host, path = host_of(F.col(url)), path_of(F.col(url))
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1])))
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    rule, said = F.lit(None).cast("string"), F.lit(None).cast("string")
    for verdict, h, p in reversed(ordered):
        rule = F.when(fits(h, p), F.lit(h + p)).otherwise(rule)
        said = F.when(fits(h, p), F.lit(verdict)).otherwise(said)
    seen = F.col("__terms")
    own = F.when((F.size(seen["strict"]) > 0) | (seen["weight"] >= limit), "block").otherwise("allow")
    return (
        pages.withColumn("__terms", terms(F.col(url)))
        .withColumn(
            into,
            F.struct(
                host.alias("host"),
                path.alias("path"),
                rule.alias("rule"),
                seen["strict"].alias("strict"),
                seen["soft"].alias("soft"),
                seen["weight"].alias("weight"),
                F.coalesce(said, own).alias("verdict"),
            ),
        )
        .drop("__terms")
    )
