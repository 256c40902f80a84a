"""Curation of measurements: maxima per key, set-valued keys, mutants and wild types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.functions.arrays import set_key
from kinolith.functions.text import mutation_codes


def max_with_unit(rows: DataFrame, keys: Sequence[str], value: str, unit: str) -> DataFrame:
    """Largest value per key and its unit; of equal values the smaller unit."""
    best = rows.groupBy(*keys).agg(F.max(value).alias(value), F.min(F.struct((-F.col(value)).alias("v"), F.col(unit).alias("u"))).alias("_b"))
    return best.select(*keys, value, F.col("_b.u").alias(unit))


def max_per_set_key(rows: DataFrame, text: str, value: str, separator: str = "/", more: Sequence[str] = ()) -> DataFrame:
    """Largest value per key whose text part is a set: the order of its parts does not count."""
    keyed = rows.withColumn("_set", F.array_join(set_key(F.col(text), separator), separator))
    return keyed.groupBy(F.col("_set").alias(text), *more).agg(F.max(value).alias(value), F.count("*").alias("n"))


def usable(rows: DataFrame, value: str, kind: str, most: float = 1e7) -> DataFrame:
    """Rows with a value that is not the sentinel -999, not above a cap, and whose kind is no mutant."""
    return rows.where((F.col(value) != -999) & (F.col(value) <= most) & ~F.contains(F.lower(kind), F.lit("mutant")))


def with_codes(rows: DataFrame, comment: str) -> DataFrame:
    """Rows whose comment speaks of a mutant and names a code; codes joined by /."""
    said = F.contains(F.lower(comment), F.lit("mutant")) | F.contains(F.lower(comment), F.lit("mutated"))
    codes = rows.where(said).withColumn("codes", mutation_codes(F.col(comment)))
    return codes.where(F.size("codes") > 0).withColumn("codes", F.array_join("codes", "/"))


def same_entry(rows: DataFrame, entry: str, role: str, one: str, two: str, value: str) -> DataFrame:
    """Rows of role one beside rows of role two with the same entry; a plain key join."""
    left = rows.where(F.col(role) == one).select(entry, F.col(value).alias("value_one"))
    right = rows.where(F.col(role) == two).select(entry, F.col(value).alias("value_two"))
    return left.join(right, entry)


def against_reference(rows: DataFrame, keys: Sequence[str], kind: str, reference: str, value: str) -> DataFrame:
    """ratio of each other row to the largest reference value of its key: aggregate, then join."""
    base = rows.where(F.col(kind) == reference).groupBy(*keys).agg(F.max(value).alias("reference"))
    return rows.where(F.col(kind) != reference).join(base, list(keys)).withColumn("ratio", F.try_divide(value, "reference"))


def listed(rows: DataFrame, key: str, value: str, separator: str = ";") -> DataFrame:
    """Sorted distinct values per key as text."""
    return rows.groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(F.col(value).cast("string"))), separator).alias(value))


def trainable(rows: DataFrame, sequence: str, value: str, structure: str, longest: int = 1499) -> DataFrame:
    """Rows with a sequence up to a length, a positive value (whose logarithm exists) and a structure of one part."""
    return rows.where((F.length(sequence) <= longest) & (F.col(value) > 0) & ~F.contains(structure, F.lit(".")))


def maxima_with_paths(rows: DataFrame, keys: Sequence[str], value: str, path: str, separator: str = ";") -> DataFrame:
    """Largest value per key and its distinct paths, sorted and joined."""
    return rows.groupBy(*keys).agg(
        F.max(value).alias(value), F.array_join(F.array_sort(F.collect_set(path)), separator).alias(path)
    )
