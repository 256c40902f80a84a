"""Pluggable scorers: Arrow functions from rows to a value, run on distinct keys that a cache lacks."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@dataclass(frozen=True)
class Scorer:
    """load() is called once a task, score(model, frame) once a batch; null means no prediction."""

    name: str
    columns: tuple[str, ...]
    load: Callable[[], object]
    score: Callable[[object, pd.DataFrame], pd.Series]
    limit: int | None = None
    options: Mapping[str, object] = field(default_factory=dict)


class Registry:
    """Scorers by name, with the columns they need."""

    def __init__(self) -> None:
        self._scorers: dict[str, Scorer] = {}

    def add(self, scorer: Scorer) -> Scorer:
        if scorer.name in self._scorers:
            raise ValueError(f"there is a scorer {scorer.name} already")
        self._scorers[scorer.name] = scorer
        return scorer

    def get(self, name: str) -> Scorer:
        if name not in self._scorers:
            raise KeyError(f"no scorer {name}; there are {', '.join(sorted(self._scorers)) or 'none'}")
        return self._scorers[name]


def scored(rows: DataFrame, scorer: Scorer, cache: DataFrame | None = None) -> DataFrame:
    """rows with prediction: scored once per distinct key, and only for keys that the cache lacks."""
    missing = [c for c in scorer.columns if c not in rows.columns]
    if missing:
        raise ValueError(f"{scorer.name} needs the columns {', '.join(missing)}")
    keys = list(scorer.columns)
    wanted = rows.select(*keys).distinct()
    todo = wanted if cache is None else wanted.join(cache.select(*keys), keys, "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = scorer.load()
        for frame in frames:
            yield frame.assign(prediction=scorer.score(model, frame).astype(float))

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys) + ", prediction double"
    fresh = todo.mapInPandas(run, schema)
    if cache is not None:
        fresh = fresh.unionByName(cache.select(*keys, F.col("prediction").cast("double").alias("prediction")))
    return rows.join(fresh, keys, "left")


#: Rows of a model's call. Fixed value.
BATCH_ROWS = 256


def predicted(rows: DataFrame, columns: Sequence[str], load: Callable[[], Callable[..., object]], name: str = "prediction", batch: int = BATCH_ROWS) -> DataFrame:
    """rows with a model's value from number columns, in calls of `batch` rows at most.

    load() gives a function from numpy arrays to an array of values; a worker
    calls it once and keeps it. Rows with a null column get null and are not
    asked for.
    """
    from pyspark.ml.functions import predict_batch_udf

    whole = F.lit(True)
    for c in columns:
        whole = whole & F.col(c).isNotNull()
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]
    model = predict_batch_udf(load, return_type=DoubleType(), batch_size=batch)
    return rows.withColumn(name, F.when(whole, model(*filled)))


class Named:
    """Things by name, with an error that lists the names: vectorisers (column to column) and reference tables."""

    def __init__(self, what: str) -> None:
        self.what, self._held = what, {}

    def add(self, name: str, thing: object) -> None:
        if name in self._held:
            raise ValueError(f"there is a {self.what} {name} already")
        self._held[name] = thing

    def get(self, name: str):
        if name not in self._held:
            raise KeyError(f"no {self.what} {name}; there are {', '.join(sorted(self._held)) or 'none'}")
        return self._held[name]


VECTORISERS = Named("vectoriser")
#: Reference tables of similarity searches: functions from a session to a table with key and sequence.
TARGETS = Named("target table")
