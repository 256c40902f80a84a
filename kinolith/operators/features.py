"""Features: vocabularies, pooled vectors, scaling, graph labels, positions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinolith.operators.assembly import dense_rank_over_ranges, first_seen_ids, quantiles, rank_in_groups


def vocabulary(rows: DataFrame, tokens: Column) -> DataFrame:
    """token and n."""
    return rows.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


def frequent(vocabulary: DataFrame, size: int, least: int = 1) -> DataFrame:
    """The size most frequent tokens seen at least so often; ties in order of the token."""
    return vocabulary.where(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(size)


def token_ids(rows: DataFrame, key: str, tokens: Column, ids: DataFrame, unknown: int = 0) -> DataFrame:
    """key, place and id of each token; unknown tokens stay, with their own id. ids has token and id."""
    parts = rows.select(key, F.posexplode(tokens).alias("place", "token"))
    return parts.join(ids, "token", "left").select(key, "place", F.coalesce("id", F.lit(unknown)).alias("id"))


def growing_dictionary(rows: DataFrame, position: str, tokens: Column) -> DataFrame:
    """token and id in order of first appearance over rows and places."""
    parts = rows.select(F.col(position), F.posexplode(tokens).alias("place", "token"))
    parts = parts.withColumn("_at", F.struct(position, "place"))
    return first_seen_ids(parts, "token", "_at")


def pooled(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, mean of the vectors of a key; a sum per dimension that is combined before the shuffle."""
    return rows.select(key, F.posexplode(vector).alias("dim", "x")).groupBy(key, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def pooled_vectors(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and the mean vector."""
    return pooled(rows, key, vector).groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias(vector)
    )


def standard_scaled(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, z; the statistics have one row per dimension and are broadcast."""
    long = rows.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = long.groupBy("dim").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    return long.join(F.broadcast(stats), "dim").select(key, "dim", F.coalesce(F.try_divide(F.col("x") - F.col("m"), F.col("s")), F.lit(0.0)).alias("z"))


def robust_scaled(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key, dim, z by median and interquartile range."""
    long = rows.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = quantiles(long, ["dim"], "x", {"low": 0.25, "middle": 0.5, "high": 0.75})  # a row a dimension
    z = F.try_divide(F.col("x") - F.col("middle"), F.col("high") - F.col("low"))
    return long.join(F.broadcast(stats), "dim").select(key, "dim", F.coalesce(z, F.lit(0.0)).alias("z"))


def in_canonical_order(blocks: Mapping[str, Column], order: Sequence[str]) -> Column:
    """The blocks' vectors as one, in a fixed order of their names whatever order they come in; unknown names are an error."""
    unknown = sorted(set(blocks) - set(order))
    if unknown:
        raise ValueError(f"blocks without a place: {', '.join(unknown)}")
    return F.concat(*[blocks[name] for name in order if name in blocks])


def stacked(rows: DataFrame, key: str, tree: str, value: str) -> DataFrame:
    """key and the array of its values in order of tree: one row of a matrix with a column per tree."""
    ordered = F.array_sort(F.collect_list(F.struct(tree, value)))  # as many as there are trees
    return rows.groupBy(key).agg(F.transform(ordered, lambda s: s[value]).alias("trees"))


def reduced(rows: DataFrame, key: str, vector: str, size: int, fitted=None):
    """(key and principal components of standardised vectors, the fitted model); a fitted model is used again as it is."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    if fitted is None:
        stages = [StandardScaler(inputCol="_v", outputCol="_z", withMean=True, withStd=True), PCA(k=size, inputCol="_z", outputCol="_p")]
        fitted = Pipeline(stages=stages).fit(ready)
    return fitted.transform(ready).select(key, vector_to_array("_p").alias(vector)), fitted


def graph_labels(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """mol, i, label after rounds of relabelling by a node's label and its sorted neighbours.

    nodes has mol, i, label; edges has mol, i, j, bond in both directions. A
    new label is the digest of what it was made of, so no dictionary grows.
    """
    labels = nodes.select("mol", "i", F.col("label").cast("string").alias("label"))
    for _ in range(rounds):
        near = edges.join(labels.select("mol", F.col("i").alias("j"), F.col("label").alias("other")), ["mol", "j"])
        around = near.groupBy("mol", "i").agg(F.array_sort(F.collect_list(F.concat_ws(":", "other", F.col("bond").cast("string")))).alias("around"))
        labels = labels.join(around, ["mol", "i"], "left").select(
            "mol",
            "i",
            F.when(F.col("around").isNull(), F.col("label")).otherwise(F.substring(F.sha2(F.concat_ws("|", "label", F.array_join("around", ",")), 256), 1, 16)).alias("label"),
        )
    return labels


def evenly_spaced(rows: DataFrame, group: str, order: list[str], picks: int) -> DataFrame:
    """picks rows of each group at even places of its order; ranks come from ranges, so a group may be of any size."""
    ranked = rank_in_groups(rows, [group], order, "_r", "_n")
    places = F.transform(F.sequence(F.lit(0), F.lit(picks - 1)), lambda p: F.floor(p * (F.col("_n") - 1) / (picks - 1)).cast("long"))
    return ranked.where(F.array_contains(places, F.col("_r"))).select(*rows.columns)


def length_batches(rows: DataFrame, length: str, key: str, size: int) -> DataFrame:
    """rows with a batch number: size rows each, longest first."""
    placed = dense_rank_over_ranges(rows.withColumn("_less", -F.col(length)), ["_less", key], "_r")
    return placed.withColumn("batch", F.floor(F.col("_r") / size).cast("long")).drop("_less", "_r")
