"""Array and vector expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def split_list(text: Column, separator: str = ";") -> Column:
    """Trimmed, non-blank parts of a separated list."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def set_key(text: Column, separator: str = "/") -> Column:
    """A key that does not depend on the order of parts."""
    return F.array_sort(F.array_distinct(F.split(text, separator)))


def numbers(text: Column, separator: str = ",") -> Column:
    return F.transform(F.split(text, separator), lambda x: F.trim(x).try_cast("double"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def mean(values: Column) -> Column:
    return total(values) / F.size(values)


def deviation(values: Column) -> Column:
    """Population standard deviation."""
    centre = mean(values)
    return F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, x: s + (x - centre) * (x - centre)) / F.size(values))


def quantile(values: Column, q: float) -> Column:
    """Quantile with linear interpolation between order statistics."""
    ordered = F.array_sort(values)
    at = (F.size(values) - 1) * F.lit(q)
    low = F.floor(at).cast("int")
    high = F.ceil(at).cast("int")
    return F.get(ordered, low) + (at - low) * (F.get(ordered, high) - F.get(ordered, low))


def dot(left: Column, right: Column) -> Column:
    return total(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")))


def cosine(left: Column, right: Column) -> Column:
    return dot(left, right) / (F.sqrt(dot(left, left)) * F.sqrt(dot(right, right)))


def weighted_mean(rows: Column, weights: Column) -> Column:
    """Weighted mean of the vectors in rows (array of arrays), weights normalised to sum one."""
    whole = total(weights)
    first = F.get(rows, F.lit(0))
    return F.transform(
        F.sequence(F.lit(0), F.size(first) - 1),
        lambda d: total(F.zip_with(rows, weights, lambda r, w: F.get(r, d).cast("double") * w)) / whole,
    )


def softmax(logits: Column, temperature: float = 15.0) -> Column:
    powers = F.transform(logits, lambda x: F.exp(x / temperature))
    return F.transform(powers, lambda x: x / total(powers))


def scaled_by_maximum(values: Column, digits: int = 4) -> Column:
    return F.transform(values, lambda x: F.round(x / F.array_max(values), digits))


def single(value: float) -> Column:
    """A number in single precision: a float equal to it is not above it, as it may be above the double."""
    return F.lit(value).cast("float")


def positions_above(values: Column, threshold: float | Column) -> Column:
    """0-based positions of values over a threshold, which should have the values' precision."""
    marked = F.transform(values, lambda x, i: F.when(x > threshold, i))
    return F.filter(marked, lambda i: i.isNotNull())


def tanimoto(left: Column, right: Column) -> Column:
    """Shared over all distinct entries of two arrays."""
    union = F.size(F.array_union(left, right))
    return F.when(union > 0, F.size(F.array_intersect(left, right)) / union).otherwise(0.0)


def dense(indices: Column, values: Column, size: int) -> Column:
    """Dense array of a sparse vector given by two arrays."""
    entries = F.map_from_arrays(indices, values)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at(entries, i), F.lit(0.0)))


def hamming(left: Column, right: Column) -> Column:
    """Positions at which two strings of one length differ."""
    at = F.sequence(F.lit(1), F.length(left))
    return F.size(F.filter(at, lambda i: F.substring(left, i, F.lit(1)) != F.substring(right, i, F.lit(1))))
