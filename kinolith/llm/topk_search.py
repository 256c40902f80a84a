"""Exact top-k inner products by norm buckets with local cosine thresholds.

Candidates are grouped by length (Euclidean norm) and the groups are cut into
blocks of bounded size. A first pass over the longest vectors gives each query
a lower bound of its k-th score. A block can then only matter to a query if

    bound <= |query| * longest vector of the block * cosine,  cosine <= 1,

so the bound turns into a cosine threshold per query and block: over 1, the
block is skipped before anything is shuffled; near 1, a block keeps only
vectors that are long enough; below, the coordinate where the query is largest
gives the interval that a candidate of that cosine must have there. What is
left is verified with whole integer products.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinolith.llm.shared import settle

BLOCK_ROWS = 4096
NORM_GROUPS = 256
QUERY_ROWS = 1024
#: Queries that come to a block together; more are cut into slices, each with the block's vectors.
SLICE_ROWS = 4096
#: From this cosine on, length alone prunes well; below, the query's main coordinate is tested.
LENGTH_ONLY = 0.97
#: Facts on norm groups that are broadcast; their number follows the number of different dimensions.
SENT_ROWS = 100_000


def integer_vectors(vectors: DataFrame, key: str, column: str, scale: int) -> DataFrame:
    """key, v (integer components floor(scale * x)), dim and norm2; unusable vectors are left out."""
    x = F.col(column)
    usable = x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf"))
    )
    whole = vectors.where(F.coalesce(usable, F.lit(False))).select(
        F.col(key).cast("long").alias("id"),
        F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"),
    )
    norm2 = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    return whole.where("id is not null").select("id", "v", F.size("v").alias("dim"), norm2.alias("norm2"))


def _matrix(column, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    return flat.flatten().to_numpy().reshape(len(column), dim)


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Whole inner products; through doubles while those are exact, through Python's integers beyond longs."""
    size = int(np.abs(left).max(initial=0)) * int(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if size < 2**53:
        return np.rint(left.astype(float) @ right.astype(float).T).astype(np.int64)
    if size < 2**63:
        return left @ right.T
    whole = left.astype(object) @ right.astype(object).T
    if any(abs(x) >= 2**63 for x in whole.ravel()):
        raise OverflowError("an inner product does not fit into a long")
    return whole.astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, query: int, k: int) -> list[tuple[int, int]]:
    other = ids != query
    ids, scores = ids[other], scores[other]
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        fit = scores >= least
        ids, scores = ids[fit], scores[fit]
    order = np.lexsort((ids, -scores))[:k]
    return [(int(ids[i]), int(scores[i])) for i in order]


def search_block(queries, block, k: int):
    """Rows (query_id, id, score): the k best of one block for each query that came to it.

    queries has id, v, norm and bound (the k-th score known so far or null).
    """
    found: list[tuple[int, int, int]] = []
    if not len(queries) or not len(block):
        return found
    dim = len(block["v"][0])
    ids, vectors = block["id"].to_numpy(), _matrix(block["v"], dim)
    norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
    order = np.argsort(-norms, kind="stable")
    ids, vectors, norms = ids[order], vectors[order], norms[order]
    longest = norms[0]
    names, wanted = queries["id"].to_numpy(), _matrix(queries["v"], dim)
    lengths = queries["norm"].to_numpy()
    bounds = queries["bound"].to_numpy(zero_copy_only=False).astype(float)
    with np.errstate(divide="ignore", invalid="ignore"):
        cosines = bounds / (lengths * longest)
    free = ~(cosines > 0)  # no bound, or one that prunes nothing
    for start in range(0, len(names), QUERY_ROWS):
        rows = np.flatnonzero(free[start : start + QUERY_ROWS]) + start
        if len(rows):
            for row, scores in zip(rows, _products(wanted[rows], vectors), strict=True):
                found += [(int(names[row]), *b) for b in _best(ids, scores, names[row], k)]
    for row in np.flatnonzero(~free):
        if cosines[row] > 1 + 1e-9:
            continue
        # length: |query| * |candidate| >= bound
        count = int(np.searchsorted(-norms, -(bounds[row] / lengths[row]) * (1 - 1e-9), side="right"))
        kept = slice(0, count)
        local_ids, local = ids[kept], vectors[kept]
        if cosines[row] < LENGTH_ONLY and count:
            # coordinate: q.v <= q_f v_f + sqrt(|q|^2 - q_f^2) * sqrt(|v|^2 - v_f^2)
            focus = int(np.abs(wanted[row]).argmax())
            q, v, n = float(wanted[row][focus]), local[:, focus].astype(float), norms[kept]
            most = q * v + math.sqrt(max(0.0, lengths[row] ** 2 - q * q)) * np.sqrt(np.maximum(0.0, n * n - v * v))
            fit = most * (1 + 1e-9) + 1e-6 >= bounds[row]
            local_ids, local = local_ids[fit], local[fit]
        if len(local):
            scores = _products(wanted[row : row + 1], local)[0]
            found += [(int(names[row]), *b) for b in _best(local_ids, scores, names[row], k)]
    return found


def _searched(queries: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """Bring queries and vectors of a block together; both have a column block."""

    def one(left, right):
        import pyarrow as pa

        rows = search_block(left, right, k)
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "id", "score"), cols, strict=True)})

    queries = queries.toDF(*queries.columns)  # both sides come from one table
    return (
        queries.groupBy("block").cogroup(blocks.groupBy("block")).applyInArrow(one, "query_id long, id long, score long")
    )


def _by_size(facts: DataFrame) -> DataFrame:
    """A written table of block facts, to be broadcast while it has at most SENT_ROWS rows; then a plain join."""
    return F.broadcast(facts) if facts.limit(SENT_ROWS + 1).count() <= SENT_ROWS else facts.hint("merge")


def _slices(rows: str) -> Column:
    return F.ceil(F.col(rows) / SLICE_ROWS).cast("int").alias("slices")


def _slice_of(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key), F.lit("slice")), F.col("slices")).cast("int")


def top_k(
    vectors: DataFrame,
    k: int = 5,
    key: str = "vec_id",
    column: str = "embedding",
    scale: int = 256,
    query_every: int = 50,
) -> DataFrame:
    """query_id, rank, id (named key), score: the k largest integer inner products of each query.

    Components become floor(scale * x). Queries are the rows whose key is
    divisible by query_every, candidates all rows with another key. Ties go to
    the smaller key; fewer candidates than k give all of them. Vectors that are
    null or hold null or non-finite components take no part, nor do null keys;
    vectors of different dimension are not compared; empty vectors meet each
    other with product 0; an empty table gives no rows; of repeated keys the smallest vector is the query, each row is a
    candidate of the others. Other columns are ignored.
    """
    whole = settle(integer_vectors(vectors, key, column, scale), "vectors")
    total = whole.count()
    groups = min(NORM_GROUPS, max(1, total // BLOCK_ROWS))
    # edges of equal share; one value per group, at most NORM_GROUPS
    edges = whole.agg(F.percentile_approx("norm2", [i / groups for i in range(1, groups)] or [0.5], 10_000)).first()[0]
    edges = sorted(set(edges or [])) if groups > 1 else []
    group = F.lit(0)
    for edge in edges:
        group = group + (F.col("norm2") > edge).cast("int")
    grouped = whole.withColumn("grp", group)
    held = grouped.groupBy("dim", "grp").agg(F.count("*").alias("held"), F.max("norm2").alias("longest2"))
    held = held.withColumn("parts", F.ceil(F.col("held") / BLOCK_ROWS).cast("int"))
    held = settle(held, "norm-groups")
    blocks = grouped.join(_by_size(held.select("dim", "grp", "parts")), ["dim", "grp"])
    blocks = blocks.withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    blocks = blocks.select("id", "v", "dim", "grp", F.struct("part").alias("block"))
    one = whole.where(F.col("id") % query_every == 0).groupBy("id").agg(F.min(F.struct("v", "dim", "norm2")).alias("q"))
    queries = settle(one.select("id", "q.v", "q.dim", F.sqrt("q.norm2").alias("norm")), "queries")
    # a first bound from one block of the longest vectors of each dimension, whose queries come in slices
    first = held.groupBy("dim").agg(F.max("grp").alias("grp"))
    first = first.join(queries.groupBy("dim").agg(F.count("*").alias("n")), "dim").select("dim", "grp", _slices("n"))
    place = lambda at: F.struct("dim", "grp", F.lit(0).alias("part"), at.alias("slice")).alias("block")
    first = _by_size(settle(first, "first-blocks"))
    seeds = queries.join(first, "dim").select(place(_slice_of("id")), "id", "v", "norm", F.lit(None).cast("long").alias("bound"))
    longest = blocks.where("block.part = 0").join(first, ["dim", "grp"])
    longest = longest.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    seeded = settle(_searched(seeds, longest.select(place(F.col("at")), "id", "v"), k), "seeds")
    bounds = seeded.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("low"))
    bounds = bounds.select(F.col("query_id").alias("id"), F.when(F.col("n") >= k, F.col("low")).alias("bound"))
    # norm groups that can still matter to a query; the bound is tested before rows are sent
    asked = queries.join(bounds, "id", "left").join(_by_size(held), "dim")
    asked = settle(
        asked.where(
            F.col("bound").isNull() | (F.col("norm") * F.sqrt("longest2") * (1 + 1e-9) + 1e-6 >= F.col("bound"))
        ).select("dim", "grp", "parts", "id", "v", "norm", "bound"),
        "asked",
    )
    counted = settle(asked.groupBy("dim", "grp").agg(F.count("*").alias("n")).select("dim", "grp", _slices("n")), "slices")
    place = lambda part, at: F.struct("dim", "grp", part.alias("part"), at.alias("slice")).alias("block")
    asked = asked.join(_by_size(counted), ["dim", "grp"]).withColumn("at", _slice_of("id"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select(place(F.col("part"), F.col("at")), "id", "v", "norm", "bound")
    blocks = blocks.join(_by_size(counted), ["dim", "grp"])
    blocks = blocks.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    blocks = blocks.select(place(F.col("block.part"), F.col("at")), "id", "v")
    hits = _searched(asked, blocks, k)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select(
        "query_id", "rank", F.col("id").alias(key), "score"
    )
