"""URL verdicts by host rules and a weighted vocabulary.

A rule for the host decides first. Otherwise an Aho-Corasick automaton counts
the terms of a small vocabulary in the URL, each only where it stands alone
between boundaries. Terms have weights; a strict one weighs enough to block a
URL by itself, soft ones only together. The vocabulary is a parameter.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (verdict, host, path)
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
#: From this weight on a URL is blocked: one strict term, or several distinct soft ones.
BLOCK_AT = 2
STRICT = (
    "bestiality", "camgirl", "camgirls", "camsex", "cialis", "cracks4u", "cumshot", "deepthroat", "escorts", "fetish", "gangbang", "hardcore",
    "hentai", "hookup", "hookups", "keygen", "keygens", "lesbians", "livesex", "milf", "milfs", "nudes", "onlinecasino", "onlyfans", "porn",
    "porno", "pornos", "pornstar", "pornstars", "pornhub", "redtube", "rule34", "serialz", "sexcam", "sexcams", "sexchat", "sexshop", "sextape",
    "shemale", "slotgacor", "sportsbetting", "stripchat", "striptease", "swingers", "upskirt", "viagra", "warez", "webcamsex", "xhamster", "xnxx", "xvideos",
    "xxx", "youporn",
)
SOFT = (
    "adult", "adults", "amateur", "arcade", "babes", "bet", "bets", "betting", "blackjack", "bonus", "bonuses", "bookmaker", "casino", "casinos",
    "cash", "cheap", "cheapest", "cheats", "clickbait", "coupon", "coupons", "crack", "cracked", "cracks", "credit", "dating", "deals",
    "discount", "discounts", "earn", "erotic", "escort", "explicit", "flirt", "forex", "free", "gamble", "gambling", "girls", "hack", "hacked",
    "hacks", "hot", "jackpot", "jackpots", "keto", "loan", "loans", "lottery", "lotto", "lust", "mature", "meds", "milfy", "naked", "naughty",
    "nude", "nudity", "odds", "payday", "pharma", "pharmacy", "pills", "pirate", "poker", "prize", "prizes", "replica", "replicas", "roulette",
    "serial", "sex", "sexual", "sexy", "singles", "slot", "slots", "spins", "steroids", "strip", "sweepstakes", "teen", "teens", "torrent",
    "torrents", "viral", "wagering", "webcam", "weightloss", "win", "winner", "winners", "xanax",
)
VOCABULARY: Mapping[str, int] = {**dict.fromkeys(SOFT, 1), **dict.fromkeys(STRICT, BLOCK_AT)}
#: Bound on a vocabulary that is read from a table; it goes to every task.
MOST_TERMS = 1_000_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLD = str.maketrans(_UPPER, _LOWER)


def read_vocabulary(terms: DataFrame, term: str = "term", weight: str = "weight") -> dict[str, int]:
    """A vocabulary from a table of terms and weights: lower-cased A-Z, the largest weight of each; null and empty terms are left out."""
    name = F.translate(F.trim(term), _UPPER, _LOWER)
    rows = terms.select(name.alias("term"), F.col(weight).cast("long").alias("weight")).where("term != '' and weight is not null")
    found = rows.groupBy("term").agg(F.max("weight").alias("weight")).limit(MOST_TERMS + 1).collect()
    if len(found) > MOST_TERMS:
        raise ValueError(f"a vocabulary may have {MOST_TERMS} terms")
    return {r["term"]: r["weight"] for r in found}


def term_counts(urls: DataFrame, vocabulary: Mapping[str, int], block_at: int = BLOCK_AT) -> DataFrame:
    """The rows of urls, which has url, with strict_hits, soft_hits (distinct terms in url) and weight (their sum)."""
    shared = urls.sparkSession.sparkContext.broadcast(dict(vocabulary))  # MOST_TERMS at most

    def count(batches):
        import ahocorasick
        import pyarrow as pa

        automaton = ahocorasick.Automaton()
        for term, weight in shared.value.items():
            automaton.add_word(term, (term, weight))
        automaton.make_automaton()
        for batch in batches:
            hits: tuple[list, ...] = ([], [], [])
            for url in batch.column(batch.schema.get_field_index("url")).to_pylist():
                text = (url or "").translate(_FOLD)
                found: dict[str, int] = {}
                for last, (term, weight) in automaton.iter(text) if len(automaton) else ():
                    first = last + 1 - len(term)
                    if (first == 0 or not text[first - 1].isalnum()) and not text[last + 1 : last + 2].isalnum():
                        found[term] = weight
                strict = sum(w >= block_at for w in found.values())
                for column, value in zip(hits, (strict, len(found) - strict, sum(found.values())), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(h, pa.int32()) for h in hits)],
                names=[*batch.schema.names, "strict_hits", "soft_hits", "weight"],
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema.fields)
    return urls.mapInArrow(count, f"{fields}, strict_hits int, soft_hits int, weight int")


def judge_urls(
    pages: DataFrame,
    key: str = "page_id",
    rules: Sequence[tuple[str, str, str]] = RULES,
    vocabulary: Mapping[str, int] = VOCABULARY,
    block_at: int = BLOCK_AT,
) -> DataFrame:
    """One row per row of pages: key, host, path, rule, verdict, strict_hits, soft_hits, weight.

    host is what stands between the first `://` and `/`, `?`, `#` or the end,
    with A-Z lower-cased, path what follows up to `?`, `#` or the end; a null
    URL or one without `://` has an empty host and path, and no rule fits it.
    A rule fits its host and the subdomains of it where path starts with the
    rule's; the longest wins. Else the distinct terms of the vocabulary that
    stand between characters other than letters and digits are weighed (A-Z are
    lower-cased), and a weight of block_at blocks. Null and empty URLs have no
    terms and are allowed. No row is joined or grouped, so repeated rows, very
    long URLs and hot hosts cost nothing extra; an empty table gives none.
    """
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    light = pages.select(F.col(key).alias("key"), F.col("url").cast("string").alias("url"))
    parts = term_counts(light, vocabulary, block_at).withColumn("rest", rest)
    parts = parts.withColumns(
        {
            "host": F.translate(F.regexp_extract("rest", "^[^/?#]*", 0), _UPPER, _LOWER),
            "path": F.regexp_extract("rest", "^[^/?#]*([^?#]*)", 1),
        }
    )
    verdict, name = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones, longer, come on top
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
        name = F.when(fits, F.lit(host + path)).otherwise(name)
    by_terms = F.when(F.col("weight") >= block_at, F.lit("block")).otherwise("allow")
    return parts.select(
        F.col("key").alias(key),
        "host",
        "path",
        name.alias("rule"),
        F.coalesce(verdict, by_terms).alias("verdict"),
        "strict_hits",
        "soft_hits",
        "weight",
    )
