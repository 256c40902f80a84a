"""Experiments over rows: grids of settings, studies, out-of-fold predictions, stacked linear models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolith.operators import metrics
from kinolith.operators.staging import join_facts


def grid(rows: DataFrame, y: Column, predictions: Mapping[str, Column], folds: Mapping[str, str]) -> DataFrame:
    """config, split, fold and the metrics of every setting on every fold of every way to split, as one long table.

    predictions are the settings' values as columns, folds the columns of the
    ways to split. The rows are read once, and one aggregation makes the table.
    """
    tried = F.explode(F.array(*[F.struct(F.lit(n).alias("config"), p.cast("double").alias("_p")) for n, p in predictions.items()]))
    split = F.explode(F.array(*[F.struct(F.lit(n).alias("split"), F.col(c).alias("fold")) for n, c in folds.items()]))
    long = rows.withColumn("_y", y.cast("double")).withColumn("_c", tried)
    long = long.withColumn("_s", split).select("_y", "_c.config", "_c._p", "_s.split", "_s.fold")
    return metrics.regression(long, F.col("_y"), F.col("_p"), ["config", "split", "fold"])


def best_settings(table: DataFrame, score: str, by: Sequence[str], config: str = "config") -> DataFrame:
    """by, config and score of the setting with the smallest mean score over folds; ties go to the smaller name."""
    means = table.groupBy(*by, config).agg(F.avg(score).alias(score))
    best = means.groupBy(*by).agg(F.min(F.struct(score, config)).alias("b"))
    return best.select(*by, F.col(f"b.{config}").alias(config), F.col(f"b.{score}").alias(score))


def study(trials: DataFrame, name: str, trial: str, value: str, wanted: int, every: int = 10) -> DataFrame:
    """One row per study: trials done, left and to be saved (every so many), the best trial and its value; failed trials are worst."""
    low = F.coalesce(F.col(value).cast("double"), F.lit(float("-inf")))
    sums = trials.groupBy(name).agg(F.count("*").alias("done"), F.max(F.struct(low.alias("v"), (-F.col(trial)).alias("t"))).alias("b"))
    return sums.select(
        name,
        "done",
        F.greatest(F.lit(0), F.lit(wanted) - F.col("done")).cast("long").alias("left"),
        F.floor(F.col("done") / every).cast("long").alias("saves"),
        (-F.col("b.t")).alias("best_trial"),
        F.when(F.col("b.v") > float("-inf"), F.col("b.v")).alias("best_value"),
    )


def _sums(x: Column, y: Column) -> dict[str, Column]:
    return {"n": F.count(x + y), "x": F.sum(x), "y": F.sum(y), "xx": F.sum(x * x), "xy": F.sum(x * y)}


def _line(n: Column, x: Column, y: Column, xx: Column, xy: Column) -> tuple[Column, Column]:
    """Slope and intercept of a least-squares line from its sums."""
    slope = F.try_divide(n * xy - x * y, n * xx - x * x)
    return slope, (y - slope * x) / n


def out_of_fold(rows: DataFrame, x: str, y: str, fold: str, name: str = "prediction") -> DataFrame:
    """rows with the prediction of a line fitted on all other folds.

    A fold's model comes from the sums of all rows less its own, so the rows
    are read once for all models; there is one model a fold.
    """
    each = rows.groupBy(fold).agg(*[c.alias(f"_{n}") for n, c in _sums(F.col(x).cast("double"), F.col(y).cast("double")).items()])
    names = ("n", "x", "y", "xx", "xy")
    whole = each.agg(*[F.sum(f"_{n}").alias(f"_all_{n}") for n in names])
    slope, intercept = _line(*[F.col(f"_all_{n}") - F.col(f"_{n}") for n in names])
    models = each.crossJoin(F.broadcast(whole)).select(fold, slope.alias("_slope"), intercept.alias("_intercept"))  # one row
    return rows.join(F.broadcast(models), fold).withColumn(name, F.col("_intercept") + F.col("_slope") * F.col(x)).select(*rows.columns, name)


def two_stage(rows: DataFrame, y: str, first: str, second: str, by: Sequence[str]) -> DataFrame:
    """A line on `first` per group, a line on `second` over what it leaves, and their linear fusion.

    Gives by, slope, intercept, second_slope, second_intercept, and the weights
    fused_base and fused_first that a last line of y over the sum of both gets.
    """
    sized = rows.groupBy(*by).agg(F.regr_slope(y, first).alias("slope"), F.regr_intercept(y, first).alias("intercept"), F.count("*").alias("_rows"))
    base, sizes = sized.drop("_rows"), sized.select(*by, "_rows")
    with_base = join_facts(rows, sized, by, "_rows", "inner").withColumn("_base", F.col("intercept") + F.col("slope") * F.col(first))
    rest = with_base.withColumn("_rest", F.col(y) - F.col("_base"))
    more = rest.groupBy(*by).agg(F.regr_slope("_rest", second).alias("second_slope"), F.regr_intercept("_rest", second).alias("second_intercept"))
    summed = join_facts(rest, more.join(sizes, list(by)), by, "_rows", "inner").withColumn("_sum", F.col("_base") + F.col("second_intercept") + F.col("second_slope") * F.col(second))
    fused = summed.groupBy(*by).agg(F.regr_slope(y, "_sum").alias("fused_slope"), F.regr_intercept(y, "_sum").alias("fused_intercept"))
    return base.join(more, list(by)).join(fused, list(by))
