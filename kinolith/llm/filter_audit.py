"""Audit of a chain of filters: what each removes in every order, from 32 signed sums a part and label.

A document's failures are a mask of five bits. The masks are not counted one by
one: for each set s of filters a part has the sum of (-1)^|mask & s|, its
Walsh-Hadamard transform, which adds up over rows in any grouping. The inverse
of the transform is exact in whole numbers and gives the cells, the documents of
each mask; orders, redundancy and Shapley values are sums over cells.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolith.llm.shared import settle, utf8_rows

FILTERS = "ABCDE"
LABELS = ("all", "good", "toxic")
#: Rows without a doc_id are dealt over so many keys in the join with labels.
SPREAD = 1024


_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SIGNS = b"#$%&*|"


def mask_of(text: bytes, points: int) -> int:
    """Filters A to D that a UTF-8 text of so many code points fails; bytes.split() cuts at blanks and the controls 9 to 13."""
    words = text.split()
    count = len(words)
    capitals = len(text) - len(text.translate(None, _CAPITALS))
    failed = (count < 100, 100 * len(set(words)) < 80 * count, 100 * capitals > 10 * points, len(text.translate(None, _SIGNS)) < len(text))
    return sum(1 << i for i, f in enumerate(failed) if f)


def failures(docs: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """id, part, sha (of the text) and mask of the filters A to D that a document fails; one row per row of docs.

    A: under 100 words; B: 100 * distinct words < 80 * words; C: 100 * capitals
    A-Z > 10 * code points; D: holds one of #$%&*|. Words are runs of anything
    but blanks and the controls 9 to 13. A null text is empty, a null part the
    empty string.
    """
    empty = F.lit("")
    rows = docs.select(
        F.col(key).cast("long").alias("id"),
        F.coalesce(F.col(part).cast("string"), empty).alias("part"),
        F.coalesce(F.col("text").cast("string"), empty).alias("text"),
    )

    def judge(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            points = pc.utf8_length(batch.column(2)).to_pylist()
            texts = [text for (text,) in utf8_rows(batch, "text")]
            found = [
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pa.array([mask_of(t, n) for t, n in zip(texts, points, strict=True)], pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], names=["id", "part", "sha", "mask"])

    return rows.mapInArrow(judge, "id long, part string, sha binary, mask int")


def masks(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """part, mask of all five filters, good, toxic and n, the rows of one document and part that are alike.

    E: the text is that of a smaller key, anywhere in the table. The first key
    of each text is a minimum that shrinks before the shuffle, so a third of all
    rows may share a text; a row passes E if its key and text are such a first,
    which is a join on both, with a row a key. Rows without a key fail E never
    and have no label; they are spread over SPREAD keys in the join with labels.
    A key is good or toxic if any of its label rows says so.
    """
    rows = failures(docs, key, part).groupBy("id", "part", "sha", "mask").agg(F.count("*").alias("n"))
    rows = settle(rows, "filter-masks")
    first = rows.where("id is not null").groupBy("sha").agg(F.min("id").alias("id")).withColumn("first", F.lit(True))
    rows = rows.join(first, ["id", "sha"], "left")
    copy = (F.col("id").isNotNull() & F.col("first").isNull()).cast("int")
    spread = F.when(F.col("id").isNull(), F.pmod(F.xxhash64("sha", "part"), F.lit(SPREAD)) + 1).otherwise(0)
    rows = rows.select("id", spread.cast("int").alias("spread"), "part", (F.col("mask") + 16 * copy).alias("mask"), "n")
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias("good" if c == "quality" else c)
    known = labels.select(F.col("doc_id").cast("long").alias("id"), "quality", "toxic").where("id is not null and (quality = 1 or toxic = 1)")
    known = known.groupBy("id").agg(said("quality"), said("toxic")).withColumn("spread", F.lit(0))
    rows = rows.join(known, ["id", "spread"], "left")
    no = F.lit(False)
    return rows.select("part", "mask", F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")


def _sign(a: Column | int, b: Column | int) -> Column:
    """(-1) to the number of bits that a and b have in common."""
    common = (a if isinstance(a, Column) else F.lit(a)).bitwiseAND(b)
    return F.lit(1) - 2 * F.bit_count(common) % 4


def parity_sums(rows: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, label and sums, the 2^filters signed sums; label is all, good or toxic."""
    kinds = F.array_compact(F.array(F.lit("all"), F.when(F.col("good"), "good"), F.when(F.col("toxic"), "toxic")))
    each = rows.select("part", F.explode(kinds).alias("label"), "mask", "n")
    sums = [F.sum(_sign(F.col("mask"), s) * F.col("n")).alias(f"s{s}") for s in range(1 << filters)]
    return each.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*(f"s{s}" for s in range(1 << filters))).alias("sums"))


def cells(sums: DataFrame, filters: int = len(FILTERS)) -> DataFrame:
    """part, and for each label an array of how many documents have each mask."""
    many = 1 << filters
    every = F.sequence(F.lit(0), F.lit(many - 1))
    signed = lambda m: F.aggregate(every, F.lit(0).cast("long"), lambda t, s: t + _sign(m, s) * F.get("sums", s))
    # the sum is a multiple of many, so that the shift divides exactly
    found = sums.withColumn("cells", F.transform(every, lambda m: F.shiftright(signed(m), len(bin(many)) - 3)))
    none = F.array_repeat(F.lit(0).cast("long"), many)
    return found.groupBy("part").agg(*(F.coalesce(F.max(F.when(F.col("label") == k, F.col("cells"))), none).alias(k) for k in LABELS))


def orders(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row per part, filter_order and step, with counts; see audit()."""
    names = ["".join(p) for p in permutations(filters)]
    rows = found.withColumn("filter_order", F.explode(F.array(*map(F.lit, names))))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bits = lambda letters: sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(filters)), F.lit(0))
    rows = rows.withColumn("own", bits(F.expr("substring(filter_order, step, 1)")))
    rows = rows.withColumn("before", bits(F.expr("substring(filter_order, 1, step - 1)")))
    every = F.sequence(F.lit(0), F.lit((1 << len(filters)) - 1))
    own, before = (lambda m: m.bitwiseAND(F.col("own")) != 0), (lambda m: m.bitwiseAND(F.col("before")) != 0)
    ways = factorial(len(filters))
    total = lambda label, test, weight=lambda m: F.lit(1): F.aggregate(
        F.filter(every, test), F.lit(0).cast("long"), lambda t, m: t + F.get(label, m) * weight(m)
    )
    removed = lambda m: own(m) & ~before(m)
    return rows.select(
        "part",
        "filter_order",
        F.col("step").cast("int").alias("step"),
        total("all", lambda m: ~own(m) & ~before(m)).alias("kept"),
        total("all", removed).alias("removed"),
        total("all", lambda m: own(m) & before(m)).alias("redundant"),
        total("all", lambda m: m == F.col("own")).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        # a document that fails k filters is removed by each of them in one k-th of all orders
        total("all", own, lambda m: (F.lit(ways) / F.bit_count(m)).cast("long")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", part: str = "lang") -> DataFrame:
    """Counts of documents per part, filter_order and step, zeros included.

    kept: after this step; removed: here; redundant: failing this filter, but
    removed earlier; unique_fails: failing this filter only; good_lost and
    toxic_lost: removed here with that label; shapley: removed by this filter,
    summed over all orders. The parts are the values of the part column, null
    as the empty string. Each row of docs counts, repeated ones too; rows
    without a key are no copies and carry no label; an empty table gives no
    rows; very long texts take the memory of their words; other columns are
    ignored.
    """
    return orders(cells(parity_sums(masks(docs, labels, key, part))))
