"""A keyed Parquet store with commits: writers may run at the same time and repeat batches, readers see each commit whole.

Rows go to a folder of their own first. A commit then is one small numbered file
that names it, made so that of two writers of a number only one succeeds; the
other reads what came in between and tries the next number. So a key is written
once, and a batch that is repeated after a failure finds its name and does
nothing. The file system must create a file only if there is none, in one step,
as HDFS and local disks do.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

#: Attempts of a commit; each lost one means that another writer got through.
ATTEMPTS = 100


@dataclass
class Store:
    """Rows of a schema (a DDL string) under a path."""

    spark: SparkSession
    path: str
    schema: str

    def _file(self, *parts: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path.rstrip("/"), *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def commits(self) -> list[dict]:
        """What was committed, in order: number, batch and folder (null for a batch without new rows)."""
        folder, fs = self._file("commits")
        if not fs.exists(folder):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(folder))
        wanted = [f"{folder}/{n}" for n in names if n.endswith(".json") and not n.startswith(".")]
        if not wanted:
            return []
        read = self.spark.read.schema("number long, batch string, folder string").json(wanted)
        return [r.asDict() for r in read.orderBy("number").collect()]  # a row a commit

    def read(self, upto: int | None = None) -> DataFrame:
        """The committed rows, all of them or those of the commits up to a number."""
        known = [c for c in self.commits() if c["folder"] and (upto is None or c["number"] <= upto)]
        return self._rows([c["folder"] for c in known])

    def _rows(self, folders: Sequence[str]) -> DataFrame:
        schema = _parse_datatype_string(self.schema)
        assert isinstance(schema, StructType)
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path.rstrip('/')}/rows/{f}" for f in folders])

    def _claim(self, number: int, batch: str, folder: str | None) -> bool:
        """Make the commit's file; False if another writer has that number."""
        path, fs = self._file("commits", f"{number:012}.json")
        body = bytearray((json.dumps({"number": number, "batch": batch, "folder": folder}) + "\n").encode())
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "exist" in str(e.java_exception):
                return False
            raise
        try:
            out.write(body)
        finally:
            out.close()
        return True

    def commit(self, batch: str, make: Callable[[DataFrame], DataFrame]) -> bool:
        """Commit make(rows so far) under a batch's name; False if that batch was committed before.

        When another writer comes first, make is asked again with its rows.
        """
        seen = self.commits()
        for _ in range(ATTEMPTS):
            if any(c["batch"] == batch for c in seen):
                return False
            folder = uuid.uuid4().hex
            rows = make(self._rows([c["folder"] for c in seen if c["folder"]]))
            columns = _parse_datatype_string(self.schema).fieldNames()
            rows.select(*columns).write.parquet(f"{self.path.rstrip('/')}/rows/{folder}")
            if self._claim(seen[-1]["number"] + 1 if seen else 0, batch, folder):
                return True
            path, fs = self._file("rows", folder)
            fs.delete(path, True)
            seen = self.commits()
        raise RuntimeError(f"{ATTEMPTS} other writers came first")

    def add_missing(self, rows: DataFrame, keys: Sequence[str], batch: str) -> bool:
        """Commit the rows whose keys the store lacks, one row a key (that of the smallest values). Null keys are left out."""
        rest = [c for c in rows.columns if c not in keys]
        known = rows.where(" and ".join(f"`{k}` is not null" for k in keys))
        one = known.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r")).select(*keys, *[F.col("_r")[c].alias(c) for c in rest]) if rest else known.distinct()
        return self.commit(batch, lambda have: one.join(have.select(*keys), list(keys), "left_anti"))

    def add(self, rows: DataFrame, batch: str) -> bool:
        """Commit rows as they are, once per batch: counters and logs, which are summed up when read."""
        return self.commit(batch, lambda _: rows)


def missing_batches(store: Store, keys: Sequence[str], writer: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: each batch's new keys go to the store, whatever is repeated after a restart."""
    return lambda frame, number: None if store.add_missing(frame, keys, f"{writer}-{number}") else None


def usage_batches(store: Store, text: str, at: str, writer: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: uses of texts, by digest, as increments; see registry.from_usage()."""
    from kinolith.operators.registry import usage_of

    return lambda frame, number: None if store.add(usage_of(frame, text, at), f"{writer}-{number}") else None
