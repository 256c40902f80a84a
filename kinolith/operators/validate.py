"""Checks of input tables: columns, emptiness, alphabets, lengths, reasons per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinolith.functions.arrays import split_list
from kinolith.functions.text import in_alphabet, offending
from kinolith.operators.assembly import rank_in_groups

SINGLE = ("Protein Sequence", "Substrate")
MULTI = ("Protein Sequence", "Substrates", "Products")
#: Longest sequence of each method; null means no limit. Fixed values.
LIMITS: Mapping[str, int | None] = {"A": 1024, "B": 1024, "C": 1000, "D": None, "E": 1500, "F": 1500}
SERVER_LIMIT = 10_000


def missing_columns(columns: Sequence[str], required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in columns]


def layout(columns: Sequence[str]) -> str:
    """single, multi or invalid."""
    if not missing_columns(columns, MULTI):
        return "multi"
    return "invalid" if missing_columns(columns, SINGLE) else "single"


def effective_limit(method: str, limits: Mapping[str, int | None] = LIMITS, server: int = SERVER_LIMIT) -> int:
    own = limits[method]
    return server if own is None else min(own, server)


def column_emptiness(rows: DataFrame, columns: Sequence[str], row: str) -> DataFrame:
    """One row per column: rows, blanks, verdict (empty over 90 %, gaps over 10 %) and at most ten row numbers.

    The counts are one aggregation; the numbers come from the first eleven blank
    rows of a column, which each task cuts before the shuffle.
    """
    blank = {c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "") for c in columns}
    marked = rows.select(
        F.col(row).alias("_row"),
        F.explode(F.array(*[F.struct(F.lit(c).alias("column"), b.alias("blank")) for c, b in blank.items()])).alias("_c"),
    )
    counts = marked.groupBy("_c.column").agg(F.count("*").alias("n"), F.count_if("_c.blank").alias("blanks"))
    place = F.row_number().over(Window.partitionBy("column").orderBy("_row"))  # limited before the shuffle, too
    first = marked.where("_c.blank").select("_c.column", "_row").withColumn("_r", place).where("_r <= 11")
    listed = first.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list(F.col("_row"))), ",").alias("row_list"))
    share = F.col("blanks") / F.col("n")
    verdict = F.when(share > 0.9, "empty").when(share > 0.1, "gaps").otherwise("ok")
    shown = F.when(F.col("blanks") <= 10, F.coalesce("row_list", F.lit(""))).otherwise("")
    return counts.join(listed, "column", "left").select("column", "n", "blanks", verdict.alias("verdict"), shown.alias("row_list"))


def invalid_sequences(rows: DataFrame, sequence: str, row: str) -> DataFrame:
    """Rows with a reason: empty, or invalid characters and which."""
    text = F.col(sequence)
    empty = text.isNull() | (F.trim(text) == "")
    reason = F.when(empty, "empty").when(~in_alphabet(text), "invalid characters")
    found = rows.select(F.col(row).alias("row"), reason.alias("reason"), F.when(~empty, offending(text)).alias("characters"))
    return found.where("reason is not null").select("row", "reason", F.array_join(F.coalesce("characters", F.array()), "").alias("characters"))


def invalid_parts(rows: DataFrame, column: str, row: str, known: DataFrame, part: str) -> DataFrame:
    """Parts of a `;` list, with their place, that a table of valid parts does not have."""
    parts = rows.select(F.col(row).alias("row"), F.posexplode(split_list(F.col(column))).alias("place", part))
    return parts.join(known.select(part).distinct(), part, "left_anti").select("row", "place", part)


def by_reason(invalid: DataFrame) -> DataFrame:
    """reason, n (rows with it), place (from 0, in order of row) and row: one row per invalid row, so that a reason may have any number."""
    return rank_in_groups(invalid.select("reason", "row"), ["reason"], ["row"], "place", "n").select("reason", "n", "place", "row")


def length_violations(rows: DataFrame, sequence: str, limits: Mapping[str, int | None] = LIMITS) -> DataFrame:
    """How many sequences are longer than each method's limit, in one pass."""
    size = F.length(sequence)
    capped = {m: x for m, x in limits.items() if x is not None}
    one = rows.agg(*[F.count_if(size > x).alias(m) for m, x in capped.items()])
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(x).alias("limit"), F.col(m).alias("n")) for m, x in capped.items()])
    return one.select(F.inline(pairs))
