"""Small helpers that the operators of this subpackage have in common."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_OWN_FOLDER: dict[str, str] = {}
#: At most so many keys can each have more than this part of all rows.
HOT_KEYS = 1000
_KEPT: dict[str, Any] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one input table through Spark, so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only a local master, where there is one machine, gets a folder of its own
    when the setting is missing.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = "file://" + tempfile.mkdtemp(prefix="kinolith-")
    return _OWN_FOLDER[app]


def settle(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back.

    The plan behind it is then done once, and a lost executor costs a reread
    instead of the work above it.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete a table made by settle() that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def join_by_key(rows: DataFrame, facts: DataFrame, keys: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """rows with the columns of facts, which has one row per key and, as size, how many rows have it.

    Keys with more than a thousandth of all rows can be a thousand at most:
    they are broadcast, so that no task gets all rows of one key.
    """
    from pyspark.sql import functions as F

    least = max(1, total // HOT_KEYS)
    hot = facts.where(F.col(size) > least).drop(size)
    cold = facts.where(F.col(size) <= least).drop(size)
    columns = [*rows.columns, *(c for c in hot.columns if c not in keys)]
    often = rows.join(F.broadcast(hot), keys).select(*columns)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, how).select(*columns)
    return often.union(rest)


def forget() -> None:
    """Drop what this Python worker keeps; operators without a cache call it, as workers outlive the stages of a pipeline."""
    if not _KEPT:
        return
    import ctypes

    _KEPT.clear()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where there is none, freed memory is only used again
    if trim is not None:
        trim(0)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps under a name for later tasks, one thing at a time: the caches of two operators never add up."""
    if name not in _KEPT:
        forget()
        _KEPT[name] = make()
    return _KEPT[name]


def by_bytes(items: Iterable[tuple], limit: int, weigh) -> Iterator[list[tuple]]:
    """Group consecutive items so that each group holds about limit bytes."""
    group, held = [], 0
    for item in items:
        group.append(item)
        held += weigh(item)
        if held >= limit:
            yield group
            group, held = [], 0
    if group:
        yield group


def utf8_rows(batch, *columns: str) -> Iterator[tuple]:
    """Rows of an Arrow batch; strings named 'text' come as UTF-8 bytes, nulls as None."""
    import pyarrow as pa

    arrays = []
    for name in columns:
        array = batch.column(batch.schema.get_field_index(name))
        if pa.types.is_string(array.type) and name == "text":
            array = array.cast(pa.binary())
        elif pa.types.is_large_string(array.type) and name == "text":
            array = array.cast(pa.large_binary())
        arrays.append(array.to_pylist())
    return zip(*arrays)


def free_names(df: DataFrame, *names: str) -> tuple[str, ...]:
    """The names, with underscores in front until df has no such column in any case."""
    taken, free = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        free.append(name)
    return tuple(free)


def add_columns(docs: DataFrame, fields: list[tuple[str, str]], compute) -> DataFrame:
    """docs with columns (name, type) that compute(batch) makes, as Arrow arrays; columns of those names are replaced.

    All other columns go along unchanged, so nothing has to be joined back.
    """
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    names = [name for name, _ in fields]
    own = [StructField(name, _parse_datatype_string(kind)) for name, kind in fields]
    schema = StructType([f for f in docs.schema.fields if f.name not in names] + own)

    def add(batches):
        import pyarrow as pa

        for batch in batches:
            kept = [i for i, name in enumerate(batch.schema.names) if name not in names]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), *compute(batch)],
                names=[*(batch.schema.names[i] for i in kept), *names],
            )

    return docs.mapInArrow(add, schema)
