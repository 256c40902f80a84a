"""Secrets in whole texts, with SQL functions only.

Splitting a text by a pattern gives the gaps between its matches, and with the
matches' own lengths that gives their positions. Known formats are found by
pattern; other strings that look random are found by Shannon entropy over a
sliding window of a candidate, kept up to date by one count in and one count
out per step, with a threshold for each character class. An allow-list cuts
harmless parts out of candidates, and nothing but those.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = "(?i:(password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: A run of the class is as long as it can be, so shorter runs may be left to the pattern.
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: (what the class consists of, bits that a window must reach); the first that fits counts. Digits alone are never secret.
CLASSES = (
    ("^[0-9+/_=-]+$", 9.0),
    ("^[0-9a-fA-F-]+$", 3.0),
    ("^[A-Z0-9_=-]+$", 3.5),
    ("^[^0-9]+$", 4.1),
    ("^.*$", 3.8),
)
#: What is known to be harmless. It cuts a candidate where it stands; what is left on either side is looked at.
ALLOWED = "(?i)example|sample|dummy|test|placeholder|changeme|xxxx|0123456789|abcdef|(.)\\1{5,}"
#: Matches of a text that are placed at a time.
CHUNK = 512

_SPANS = "array<struct<start: int, end: int, kind: string, hit: string>>"


def matches(text: Column, pattern: str, kind: str) -> Column:
    """Array of (start, end, kind, hit) of the pattern's matches, leftmost first, in code points.

    Positions are sums of the lengths before. They are summed by chunks, and
    within each chunk, so that a text with very many matches takes no longer per match.
    """
    gaps = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.lit(None).cast(_SPANS)
    none = F.coalesce(none, F.array().cast(_SPANS))

    def step(acc, pair):
        start = acc["at"] + F.length(pair["gap"])
        end = start + F.length(pair["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), pair["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.concat(acc["found"], F.array(one)).alias("found"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / CHUNK).cast("int")), lambda i: i * CHUNK + 1)
    chunks = F.zip_with(chunks, F.array_repeat(pairs, F.size(chunks)), lambda i, p: F.slice(p, i, F.lit(CHUNK)))
    size = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.length(p["gap"]) + F.length(p["hit"]))
    starts = F.aggregate(F.transform(chunks, size), F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    placed = F.zip_with(
        chunks,
        F.slice(starts, 1, F.size(chunks)),
        lambda c, at: F.aggregate(c, F.struct(at.alias("at"), none.alias("found")), step, lambda acc: acc["found"]),
    )
    return F.when(text.rlike(pattern), F.flatten(placed)).otherwise(none)


def _weight(count: Column) -> Column:
    """count * log2(count), 0 for 0."""
    return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(0.0)


def window_entropy(text: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy, in bits, of any window of a string over ALPHABET."""
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    begin = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"),
        F.lit(0.0).alias("sum"),
        F.lit(0.0).alias("most"),
    )

    def step(acc, pair):
        new, old, full = pair["new"], pair["old"], pair["full"]
        here = F.element_at(acc["counts"], new + 1)
        added = acc["sum"] + _weight(here + 1) - _weight(here)
        # the count that goes, after the new one has come
        there = F.element_at(acc["counts"], old + 1) + F.when(old == new, 1).otherwise(0)
        total = F.when(full == 2, added - _weight(there) + _weight(there - 1)).otherwise(added)
        counts = F.transform(
            acc["counts"],
            lambda x, i: x + F.when(i == new, 1).otherwise(0) - F.when((full == 2) & (i == old), 1).otherwise(0),
        )
        bits = F.when(full >= 1, F.lit(window).cast("double")).otherwise(None)
        bits = F.log2(bits) - total / window
        return F.struct(counts.alias("counts"), total.alias("sum"), F.greatest(acc["most"], bits).alias("most"))

    steps = F.transform(
        codes,
        lambda c, i: F.struct(
            c.alias("new"),
            F.when(i >= window, F.get(codes, i - window)).otherwise(0).alias("old"),
            F.when(i >= window, 2).when(i == window - 1, 1).otherwise(0).alias("full"),
        ),
    )
    return F.aggregate(steps, begin, step, lambda acc: acc["most"])


def looks_random(hit: Column) -> Column:
    """Whether the best window of a string reaches the bits of its class."""
    bits = F.lit(CLASSES[-1][1])
    for pattern, least in reversed(CLASSES[:-1]):
        bits = F.when(hit.rlike(pattern), F.lit(least)).otherwise(bits)
    return window_entropy(hit) >= bits


def remainders(candidates: Column, cutters: Column) -> Column:
    """What cutters leave of the candidates, pieces of WINDOW characters or more, as spans of kind entropy.

    One pass over both in order of their starts: a cutter ends the piece before
    it and moves on where the rest of the candidate begins.
    """
    event = lambda rank: lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), s["hit"].alias("hit"))
    events = F.array_sort(F.concat(F.transform(cutters, event(0)), F.transform(candidates, event(1))))
    zero, none = F.lit(0), F.array().cast(_SPANS)

    def piece(acc, end):
        hit = F.substring(acc["hit"], acc["at"] - acc["first"] + 1, end - acc["at"])
        one = F.struct(acc["at"].alias("start"), end.alias("end"), F.lit("entropy").alias("kind"), hit.alias("hit"))
        return F.when(end - acc["at"] >= WINDOW, F.concat(acc["found"], F.array(one))).otherwise(acc["found"])

    def step(acc, e):
        cuts, inside = e["rank"] == 0, e["start"] < acc["end"]
        found = F.when(cuts & ~inside, acc["found"]).otherwise(piece(acc, F.when(cuts, e["start"]).otherwise(acc["end"])))
        at = F.when(~cuts, F.greatest(e["start"], acc["limit"])).when(inside, F.greatest(acc["at"], e["end"])).otherwise(acc["at"])
        return F.struct(
            F.when(cuts, F.greatest(acc["limit"], e["end"])).otherwise(acc["limit"]).alias("limit"),
            at.alias("at"),
            F.when(cuts, acc["end"]).otherwise(e["end"]).alias("end"),
            F.when(cuts, acc["first"]).otherwise(e["start"]).alias("first"),
            F.when(cuts, acc["hit"]).otherwise(e["hit"]).alias("hit"),
            found.alias("found"),
        )

    begin = F.struct(zero.alias("limit"), zero.alias("at"), zero.alias("end"), zero.alias("first"), F.lit("").alias("hit"), none.alias("found"))
    return F.aggregate(events, begin, step, lambda acc: piece(acc, acc["end"]))


def listed(spans: Column) -> Column:
    """`kind:start:end` of spans, joined by commas."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def in_order(spans: Column) -> Column:
    """By start, then by kind as listed."""
    rank = lambda s: F.array_position(F.array(*[F.lit(k) for k in KINDS]), s["kind"])
    keyed = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), rank(s).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind"), s["hit"].alias("hit")))
    return F.array_sort(keyed)


def scan(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per row of docs: key, n_assign, n_access, n_hex, base (spans), found (base and entropy spans).

    A span has start, end (exclusive, code points), kind and hit. Base kinds
    are leftmost matches that do not overlap within a kind: assignments whose
    value has 12 characters or more, access keys of 18 or more, lower-case hex
    of 16 or more. Entropy spans are what base spans and the allow-list leave
    of candidates, if it looks random. A null or empty text has none; very long
    texts and very many matches are taken in chunks. No row is joined or
    grouped, so repeated rows cost nothing extra; an empty table gives none;
    other columns are ignored.
    """
    light = docs.select(F.col(key).alias("key"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    long_value = lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 12
    found = light.select(
        "key",
        "text",
        F.filter(matches(F.col("text"), ASSIGN, "assign"), long_value).alias("assign"),
        matches(F.col("text"), ACCESS, "access").alias("access"),
        matches(F.col("text"), HEX, "hex").alias("hex"),
        matches(F.col("text"), CANDIDATE, "entropy").alias("candidates"),
    )
    found = found.withColumn("base", in_order(F.concat("assign", "access", "hex")))
    # most texts have no candidate: nothing is computed for them
    some = F.size("candidates") > 0
    harmless = F.when(some, matches(F.col("text"), ALLOWED, "allowed")).otherwise(F.col("candidates"))
    pieces = F.when(some, remainders(F.col("candidates"), F.concat("assign", "access", "hex", harmless))).otherwise(F.col("candidates"))
    found = found.select("key", "assign", "access", "hex", "base", pieces.alias("pieces"))
    random = F.filter("pieces", lambda s: looks_random(s["hit"]))
    return found.select(
        F.col("key").alias(key),
        F.size("assign").cast("long").alias("n_assign"),
        F.size("access").cast("long").alias("n_access"),
        F.size("hex").cast("long").alias("n_hex"),
        "base",
        in_order(F.concat(F.col("assign"), F.col("access"), F.col("hex"), random)).alias("found"),
    )
