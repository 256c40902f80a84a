"""Evaluation: regression metrics, intervals, groups, confusion totals, rank sums."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from kinolith.functions import arrays, maths
from kinolith.operators.assembly import quantiles, running_total


def regression(rows: DataFrame, y: Column, predicted: Column, by: Sequence[str] = ()) -> DataFrame:
    """n, mae, rmse, r2 and pearson per group, in one aggregation."""
    e = y - predicted
    return rows.groupBy(*by).agg(
        F.count(e).alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count(e))).alias("r2"),
        F.corr(y, predicted).alias("pearson"),
    )


def tagged(rows: DataFrame, subsets: Mapping[str, Column], name: str = "subset") -> DataFrame:
    """Each row once per subset it is in; the table is read once."""
    tags = F.filter(F.array(*[F.when(c, F.lit(t)) for t, c in subsets.items()]), lambda t: t.isNotNull())
    return rows.withColumn(name, F.explode(tags))


def intervals(rows: DataFrame, trees: str, alpha: float, z: float | None = None) -> DataFrame:
    """rows with centre, low, high, spread from an array of predictions: quantiles, or centre ± z deviations."""
    values = F.transform(trees, lambda x: x.cast("double"))
    with_mean = rows.withColumns({"centre": arrays.mean(values), "spread": arrays.deviation(values)})
    if z is None:
        return with_mean.withColumns(
            {"low": arrays.quantile(values, alpha / 2), "high": arrays.quantile(values, 1 - alpha / 2)}
        )
    return with_mean.withColumns({"low": F.col("centre") - z * F.col("spread"), "high": F.col("centre") + z * F.col("spread")})


def interval_quality(rows: DataFrame, y: str, alpha: float, by: Sequence[str] = ()) -> DataFrame:
    """Coverage, gap to the nominal one, misses on either side, widths, error and interval score."""
    wide = rows.withColumn("_width", F.col("high") - F.col("low"))
    inside = F.col(y).between(F.col("low"), F.col("high"))
    found = wide.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg(inside.cast("double")).alias("coverage"),
        (F.avg(inside.cast("double")) - (1 - alpha)).alias("gap"),
        F.avg((F.col(y) < F.col("low")).cast("double")).alias("under"),
        F.avg((F.col(y) > F.col("high")).cast("double")).alias("over"),
        F.avg("_width").alias("width"),
        F.avg(F.abs(F.col(y) - F.col("centre"))).alias("mae"),
        F.avg(maths.winkler(F.col(y), F.col("low"), F.col("high"), alpha)).alias("winkler"),
        F.corr("spread", F.abs(F.col(y) - F.col("centre"))).alias("spread_error_corr"),
    )
    widths = quantiles(wide, list(by), "_width", {"width_p10": 0.1, "width_median": 0.5, "width_p90": 0.9})
    return found.join(widths, list(by)) if by else found.crossJoin(F.broadcast(widths))  # one row each


def coverage_by_decile(rows: DataFrame, y: str, spread: str = "spread") -> DataFrame:
    """decile (0 to 9) of the spread, n and coverage; deciles are cut at exact quantiles, ties stay together."""
    cuts = quantiles(rows, [], spread, {f"q{i}": i / 10 for i in range(1, 10)})
    marked = rows.crossJoin(F.broadcast(cuts))  # one row
    decile = sum((F.col(spread) > F.col(f"q{i}")).cast("int") for i in range(1, 10))
    inside = F.col(y).between(F.col("low"), F.col("high")).cast("double")
    return marked.groupBy(decile.alias("decile")).agg(F.count("*").alias("n"), F.avg(inside).alias("coverage"))


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """rows with the average rank of their value; ties share it. Ranks come from running totals over ranges of values."""
    counts = rows.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    ranked = running_total(counts, ["_v"], F.col("_k"), "_upto").select("_v", (F.col("_upto") - (F.col("_k") - 1) / 2).alias("rank"))
    return rows.join(ranked, rows[value] == ranked["_v"]).drop("_v")


def rank_sum(rows: DataFrame, value: str, group: str, one: str, two: str) -> DataFrame:
    """Rank-sum z and two-sided p of two groups, without tie correction."""
    both = rows.where(F.col(group).isin(one, two))
    ranked = average_ranks(both, value)
    totals = ranked.agg(
        F.sum(F.when(F.col(group) == one, F.col("rank"))).alias("s"),
        F.count_if(F.col(group) == one).cast("double").alias("n1"),
        F.count_if(F.col(group) == two).cast("double").alias("n2"),
    )
    expected = F.col("n1") * (F.col("n1") + F.col("n2") + 1) / 2
    z = F.try_divide(F.col("s") - expected, F.sqrt(F.col("n1") * F.col("n2") * (F.col("n1") + F.col("n2") + 1) / 12))
    return totals.select(F.col("n1").cast("long").alias("n1"), F.col("n2").cast("long").alias("n2"), z.alias("z")).withColumn("p", maths.rank_sum_p(F.col("z")))


def confusion(rows: DataFrame, true: str, predicted: str, size: str) -> DataFrame:
    """Precision, recall, specificity, accuracy and F1 from totals over position sets."""
    both = F.size(F.array_intersect(true, predicted))
    sums = rows.agg(
        F.sum(both).alias("tp"),
        F.sum(F.size(predicted) - both).alias("fp"),
        F.sum(F.size(true) - both).alias("fn"),
        F.sum(F.col(size) - F.size(F.array_union(true, predicted))).alias("tn"),
    )
    share = lambda a, *b: F.try_divide(F.col(a), sum((F.col(x) for x in b), F.lit(0)))
    precision, recall, specificity = share("tp", "tp", "fp"), share("tp", "tp", "fn"), share("tn", "tn", "fp")
    return sums.select(
        "tp", "fp", "fn", "tn",
        precision.alias("precision"),
        recall.alias("recall"),
        specificity.alias("specificity"),
        F.try_divide(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("accuracy"),
        F.sqrt(specificity * recall).alias("g_mean"),
        F.try_divide(2 * precision * recall, precision + recall).alias("f1"),
        F.try_divide(5 * precision * recall, 4 * precision + recall).alias("f2"),
    )


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 1000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def correlation_p(found: DataFrame, r: str = "pearson", n: str = "n", name: str = "p") -> DataFrame:
    """found, which has a row per group, with the two-sided p-value of its correlations (Student's t, n - 2 degrees of freedom)."""

    @F.pandas_udf(DoubleType())
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        def one(x, count):
            if not count > 2 or x != x:
                return None
            return beta_share((count - 2) / 2, 0.5, max(0.0, 1 - x * x))

        return pd.Series([one(x, c) for x, c in zip(r, n, strict=True)], dtype=float)

    return found.withColumn(name, p(F.col(r), F.col(n)))


def fold_summary(rows: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("sd"), F.count(value).alias("folds"))


def share_by(rows: DataFrame, label: Column) -> DataFrame:
    """Rows and share of each label."""
    counts = rows.groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def cumulative_share(rows: DataFrame, value: str, grid: Sequence[float]) -> DataFrame:
    """Share of values at or below each grid point, in one pass."""
    points = F.array(*[F.lit(float(g)) for g in grid])
    counts = rows.where(F.col(value).isNotNull()).agg(*[F.count_if(F.col(value) <= g).alias(f"_{i}") for i, g in enumerate(grid)], F.count("*").alias("_n"))
    entries = F.array(*[F.struct(F.get(points, F.lit(i)).alias("point"), F.try_divide(F.col(f"_{i}"), F.col("_n")).alias("share")) for i in range(len(grid))])
    return counts.select(F.inline(entries))


def cumulative_curve(rows: DataFrame, value: str, points: int = 50_000) -> DataFrame:
    """point (0 to points - 1), x, share at or below x and whether x is the first past the median, on an even grid.

    Each value is put to the first grid point not below it; the grid has a bounded number of rows.
    """
    some = rows.where(F.col(value).isNotNull())
    ends = some.agg(F.min(value).cast("double").alias("low"), F.max(value).cast("double").alias("high"), F.count("*").alias("n"))
    step = (F.col("high") - F.col("low")) / (points - 1)
    at = F.when(step > 0, F.ceil((F.col(value) - F.col("low")) / step)).otherwise(0)
    placed = some.crossJoin(F.broadcast(ends)).groupBy(F.least(F.lit(points - 1), at).cast("int").alias("point")).agg(F.count("*").alias("k"))  # one row
    grid = rows.sparkSession.range(points).select(F.col("id").cast("int").alias("point"))
    full = grid.join(placed, "point", "left").na.fill(0, ["k"]).crossJoin(F.broadcast(ends))
    upto = F.sum("k").over(Window.orderBy("point").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # points rows
    curve = full.select("point", (F.col("low") + F.col("point") * step).alias("x"), F.try_divide(upto, F.col("n")).alias("share"))
    before = F.lag("share", 1, 0.0).over(Window.orderBy("point"))
    return curve.withColumn("median", (F.col("share") >= 0.5) & (before < 0.5))


def histogram(rows: DataFrame, value: str, bins: int = 5_000) -> DataFrame:
    """bin, low and n of the bins that hold something, of equal width between the least and the largest value."""
    some = rows.where(F.col(value).isNotNull())
    ends = some.agg(F.min(value).cast("double").alias("a"), F.max(value).cast("double").alias("z"))
    width = (F.col("z") - F.col("a")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("a")) / width))).otherwise(0).cast("int")
    return some.crossJoin(F.broadcast(ends)).groupBy(at.alias("bin")).agg(  # one row
        F.min(F.col("a") + at * width).alias("low"), F.count("*").alias("n")
    )


def density_grid(rows: DataFrame, x: str, y: str, cells: int = 50) -> DataFrame:
    """Rows with density: how many rows share their cell of an even grid over both columns, as a share of all."""
    ends = rows.agg(*[f(c).cast("double").alias(f"_{n}{c}") for c in (x, y) for n, f in (("a", F.min), ("z", F.max))], F.count("*").alias("_n"))
    cell = {}
    for c in (x, y):
        width = (F.col(f"_z{c}") - F.col(f"_a{c}")) / cells
        cell[f"cell_{c}"] = F.when(width > 0, F.least(F.lit(cells - 1), F.floor((F.col(c) - F.col(f"_a{c}")) / width))).otherwise(0).cast("int")
    placed = rows.crossJoin(F.broadcast(ends)).withColumns(cell)  # one row
    counts = placed.groupBy(*cell).agg((F.count("*") / F.max("_n")).alias("density"))
    return placed.join(F.broadcast(counts), list(cell)).select(*rows.columns, *cell, "density")  # cells * cells rows


#: A kernel is cut off after so many deviations; beyond them it is under 0.0004 of its top.
KERNEL_REACH = 4.0


def kernel_density(cells: DataFrame, x: str, y: str, n: str, deviation_x: float, deviation_y: float) -> DataFrame:
    """x, y and density of the cells of a grid: a Gaussian kernel over the rows of all cells, in rows per cell.

    cells has integer x and y, and n, how many rows a cell holds; deviations are
    in cells. The kernel is a product, so a pass along x and one along y do, of
    2 * KERNEL_REACH deviations each, and sums shrink before they are shuffled.
    Against the direct sum over rows, placing a row at its cell's middle is off
    by at most 0.61 / deviation of the top in each direction, and cutting the
    kernel by 0.0004 of it a row. Cells out of every row's reach are left out.
    """

    def along(rows: DataFrame, axis: str, value: str, deviation: float) -> DataFrame:
        reach = int(KERNEL_REACH * deviation)
        off = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
        weight = F.exp(-0.5 * (F.col("_off") / F.lit(deviation)) ** 2) / (deviation * (2 * 3.141592653589793) ** 0.5)
        spread = rows.withColumn("_off", off).withColumns({"_w": F.col(value) * weight, axis: F.col(axis) + F.col("_off")})
        return spread.groupBy(x, y).agg(F.sum("_w").alias("density"))

    return along(along(cells.select(x, y, n), x, n, deviation_x), y, "density", deviation_y)
