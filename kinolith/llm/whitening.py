"""Whitening of embeddings by a randomised range finder.

The covariance of the distinct integer vectors is never formed. A block of
orthonormal directions, a few more than the components asked for, is sent
through it: each pass is one Spark job in which every task adds up
(x - mean)^T ((x - mean) Q) of its rows, so that what is shuffled and fetched is
one row per dimension. Passes are repeated as power passes until the residuals
of the Ritz pairs are down to rounding. If they fall too slowly for that, the
block is doubled, up to the full dimension, where Rayleigh-Ritz is the whole
eigenproblem and no residual is left but rounding.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinolith.llm.shared import settle

#: Directions beyond the components asked for.
OVERSAMPLING = 8
#: Power passes that may still be missing, by the rate of the last one; beyond, the block is doubled.
PASSES = 8
#: Largest residual of an accepted component, as a part of the largest eigenvalue.
RESIDUAL = 4e-14
#: Eigenvalues up to this part of the largest are rounding: such components don't exist.
NO_VALUE = 1e-12
#: Lengths of vectors a table may have; each has a fit of its own.
LENGTHS = 64


@dataclass
class Fit:
    """Components of the vectors of one length; directions has a column a component."""

    dim: int
    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float = 0.0
    width: int = 0
    passes: int = 0


def integer_vectors(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """id and v, floor(scale * component) as longs, of the rows whose vector is neither null nor empty nor holds a null or non-finite entry.

    Entries beyond a long stay at its end.
    """
    x = F.col(column)
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != float("inf")))
    usable = F.coalesce(x.isNotNull() & (F.size(x) > 0) & whole, F.lit(False))
    return vectors.where(usable).select(
        F.col(key).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v")
    )


def _rows(batch, dim: int, name: str = "v") -> np.ndarray:
    array = batch.column(batch.schema.get_field_index(name))
    return array.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _centred(v: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x - S/n in doubles: the whole part of the mean is taken off in longs first."""
    floor = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s % n) / n for s in sums])
    if np.abs(v).max(initial=0) < 2**62 and np.abs(floor).max(initial=0) < 2**62:
        return (v - floor).astype(float) - rest
    return (v.astype(object) - floor.astype(object)).astype(float) - rest


def _column_sums(fit_list: DataFrame, dim: int) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension; a row a dimension and task is shuffled."""

    def add(batches):
        import pyarrow as pa

        total, count = [0] * dim, 0
        for batch in batches:
            v = _rows(batch, dim)
            count += len(v)
            whole = v if np.abs(v).max(initial=0) < 2**63 // max(1, len(v)) else v.astype(object)
            total = [t + int(s) for t, s in zip(total, whole.sum(axis=0), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(dim), pa.int32()), pa.array([str(t) for t in total]), pa.array([count] * dim, pa.int64())], names=["at", "total", "n"]
        )

    parts = fit_list.select("v").mapInArrow(add, "at int, total string, n long")
    found = parts.groupBy("at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n")).collect()
    sums = {r["at"]: (int(r["total"]), r["n"]) for r in found}
    return sums[0][1], [sums[i][0] for i in range(dim)]


def _pass(fit_list: DataFrame, dim: int, n: int, sums: list[int], block: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance times block, and the covariance's trace; a row a dimension and task is shuffled."""
    width = block.shape[1]
    fields = ", ".join(f"c{i} double" for i in range(width + 1))

    def send(batches):
        import pyarrow as pa

        total = np.zeros((dim, width + 1))
        for batch in batches:
            x = _centred(_rows(batch, dim), n, sums)
            total[:, :width] += x.T @ (x @ block)
            total[:, width] += (x * x).sum(axis=0)
        arrays = [pa.array(range(dim), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in total.T)]
        yield pa.RecordBatch.from_arrays(arrays, names=["at", *(f"c{i}" for i in range(width + 1))])

    parts = fit_list.select("v").mapInArrow(send, f"at int, {fields}")
    found = parts.groupBy("at").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(width + 1))).collect()
    image = np.zeros((dim, width + 1))
    for row in found:
        image[row["at"]] = row[1:]
    return image[:, :width] / n, float(image[:, width].sum()) / n


def _ritz(block: np.ndarray, image: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Values and vectors of the block, largest first, and the largest residual of the first ones wanted, by the largest value."""
    small = block.T @ image
    values, turns = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, turns = values[order], turns[:, order]
    vectors = block @ turns
    off = image @ turns[:, :wanted] - vectors[:, :wanted] * values[:wanted]
    largest = max(float(values[0]), np.finfo(float).tiny)
    return values, vectors, float(np.sqrt((off**2).sum(axis=0)).max(initial=0)) / largest


def fit(fit_list: DataFrame, dim: int, components: int = 4, seed: int = 7) -> Fit:
    """The components of distinct integer vectors v of one length.

    A component is taken once its residual |V q - e q| is at most RESIDUAL of
    the largest eigenvalue, or once the block has the full dimension. The last
    pass measures the covariance of what whitening gives.
    """
    n, sums = _column_sums(fit_list, dim)
    wanted = min(components, dim)
    width = min(dim, wanted + OVERSAMPLING)
    rng = np.random.default_rng(seed)
    block = np.linalg.qr(rng.standard_normal((dim, width)))[0]
    done, last = 0, None
    while True:
        image, trace = _pass(fit_list, dim, n, sums, block)
        done += 1
        values, vectors, residual = _ritz(block, image, wanted)
        if residual <= RESIDUAL or width == dim or trace == 0:
            break
        rate = residual / last if last else None
        last = residual
        if rate is not None and residual * min(rate, 1.0) ** PASSES > RESIDUAL:
            # the directions found stay, as many random ones join them
            width, last = min(dim, 2 * width), None
            image = np.column_stack([image, rng.standard_normal((dim, width - image.shape[1]))])
        block = np.linalg.qr(image / np.maximum(np.sqrt((image**2).sum(axis=0)), np.finfo(float).tiny))[0]
    real = int((values[:wanted] > NO_VALUE * max(trace, 0.0)).sum()) if trace > 0 else 0
    found = Fit(dim, n, sums, vectors[:, :real], values[:real], trace, width=width, passes=done)
    if real:
        found.identity_error = _identity_error(fit_list, found)
    return found


def _identity_error(fit_list: DataFrame, found: Fit) -> float:
    """Largest entry of the whitened rows' covariance minus the identity, from a pass over all of them."""
    many = found.directions.shape[1]
    turn = found.directions / np.sqrt(found.values)

    def add(batches):
        import pyarrow as pa

        total = np.zeros((many, many + 1))
        for batch in batches:
            w = _centred(_rows(batch, found.dim), found.n, found.sums) @ turn
            total[:, :many] += w.T @ w
            total[:, many] += w.sum(axis=0)
        arrays = [pa.array(range(many), pa.int32()), *(pa.array(np.ascontiguousarray(c)) for c in total.T)]
        yield pa.RecordBatch.from_arrays(arrays, names=["at", *(f"c{i}" for i in range(many + 1))])

    fields = ", ".join(f"c{i} double" for i in range(many + 1))
    parts = fit_list.select("v").mapInArrow(add, f"at int, {fields}")
    rows = {r["at"]: r[1:] for r in parts.groupBy("at").agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(many + 1))).collect()}
    total = np.array([rows[i] for i in range(many)]) / found.n
    mean = total[:, many]
    return float(np.abs(total[:, :many] - np.outer(mean, mean) - np.eye(many)).max())


def _deviations(v: np.ndarray, n: int, sums: list[int]) -> list[str]:
    """Exact sums of (n * x - S)^2, as text; in longs where they are sure to fit."""
    most = int(np.abs(v).max(initial=0)) * n + max((abs(s) for s in sums), default=0)
    if most * most * v.shape[1] < 2**63:
        off = v * n - np.array(sums, np.int64)
        return [str(d) for d in (off * off).sum(axis=1)]
    off = v.astype(object) * n - np.array(sums, object)
    return [str(d) for d in (off * off).sum(axis=1)]


def whiten(vectors: DataFrame, components: int = 4, key: str = "vec_id", column: str = "embedding", scale: int = 256) -> DataFrame:
    """One row per usable row of vectors and component, from 1 by falling eigenvalue.

    key, component, n (distinct vectors fitted), deviation (decimal, the exact
    sum of (n * x - S)^2), whitened, explained (the eigenvalue's share of the
    trace) and identity_error (one value of the fit). The sign of a component is
    such that its largest entry is positive. Rows without a usable vector are
    left out, as are empty vectors, which have no component; repeated rows and
    rows without a key each have their rows. Vectors of one length are a fit of
    their own, at most LENGTHS of them. There are fewer components where the
    length or the rank is smaller, so none where all vectors are equal; an empty
    table gives no rows. Components with equal eigenvalues are any basis of
    their space. Other columns are ignored.
    """
    rows = integer_vectors(vectors, key, column, scale)
    whole = settle(rows, "whole-vectors")
    lengths = [r[0] for r in whole.select(F.size("v").alias("dim")).distinct().orderBy("dim").limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} lengths")
    schema = f"{key} long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    found = None
    for dim in lengths:
        own = whole.where(F.size("v") == dim)
        # equal vectors are made one before the shuffle where they meet in a task
        fitted = fit(settle(own.select("v").distinct(), "fit-list"), dim, components)
        part = project(own, fitted, key)
        found = part if found is None else found.union(part)
    return found if found is not None else vectors.sparkSession.createDataFrame([], schema)


def project(rows: DataFrame, fitted: Fit, key: str = "vec_id") -> DataFrame:
    """Rows id, v of one length on the components of a fit; see whiten()."""
    many = fitted.directions.shape[1]
    main = np.abs(fitted.directions).argmax(axis=0)
    signs = np.sign(fitted.directions[main, np.arange(many)]) if many else np.zeros(0)
    turn = fitted.directions * signs / np.sqrt(fitted.values)
    explained = fitted.values / fitted.trace if many else fitted.values

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            v = _rows(batch, fitted.dim)
            count = len(v)
            white = _centred(v, fitted.n, fitted.sums) @ turn
            twice = np.repeat(np.arange(count), many)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(twice)),
                    pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * many, fitted.n)),
                    pa.array(_deviations(v, fitted.n, fitted.sums), pa.string()).take(pa.array(twice)),
                    pa.array(white.ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * many, fitted.identity_error)),
                ],
                names=["id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    fields = "id long, component int, n long, deviation string, whitened double, explained double, identity_error double"
    placed = rows.select("id", "v").mapInArrow(place, fields)
    return placed.select(
        F.col("id").alias(key), "component", "n", F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened", "explained", "identity_error"
    )
