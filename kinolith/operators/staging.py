"""Tables written between the steps of a job, so that a step is done once and its plan stays short."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}
#: At most so many keys can each have more than this part of all rows.
HOT_KEYS = 1000
#: Facts that are broadcast whole; their number is counted.
SENT_ROWS = 10_000


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which driver and executors share; a local master without it gets a folder of its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="kinolith-")
    return _OWN_FOLDER[app]


def settled(df: DataFrame, folder: str | None = None) -> DataFrame:
    """df written to the shared folder and read back."""
    path = f"{(folder or shared_folder(df.sparkSession)).rstrip('/')}/rows-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_facts(rows: DataFrame, facts: DataFrame, keys: Sequence[str], size: str, how: str = "left") -> DataFrame:
    """rows with the columns of facts, which has one row per key and in size about how many rows have that key.

    Up to SENT_ROWS facts are broadcast. Of more, keys that hold more than a
    thousandth of all rows, a thousand at most, are, so that no task gets all
    rows of one key; the others are joined as usual. Null keys equal each
    other. size itself is dropped; how is left or inner.
    """
    facts = settled(facts)
    many, total = facts.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    own = [f"_k{i}" for i in range(len(keys))]
    more = [c for c in facts.columns if c not in (*keys, size)]
    named = facts.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], *more, size)
    same = lambda: [rows[k].eqNullSafe(F.col(o)) for k, o in zip(keys, own, strict=True)]
    columns = [*(rows[c] for c in rows.columns), *more]
    if many <= SENT_ROWS:
        return rows.join(F.broadcast(named.drop(size)), same(), how).select(*columns)
    is_hot = F.col(size) > max(1, total // HOT_KEYS)
    hot, cold = named.where(is_hot).drop(size), named.where(~is_hot).drop(size)
    often = rows.join(F.broadcast(hot), same()).select(*columns)
    rest = rows.join(F.broadcast(hot.select(*own)), same(), "left_anti").join(cold, same(), how).select(*columns)
    return often.union(rest)
