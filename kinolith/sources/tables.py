"""Readers and writers for the formats of this field, through Spark's own sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV file with header; rows without any value are dropped."""
    reader = spark.read.option("header", True).option("mode", "FAILFAST")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path).na.drop("all")


def read_tsv(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Tab-separated columns by position; the first line is skipped."""
    return spark.read.csv(path, schema=schema, sep="\t", header=True, enforceSchema=True)


def read_folder(spark: SparkSession, path: str, schema: StructType | str, pattern: str, key: str = "key") -> DataFrame:
    """Tab-separated files of a folder, with a key taken from each file's name by a pattern with one group."""
    name = F.col("_metadata.file_name")
    return spark.read.csv(path, schema=schema, sep="\t").select("*", F.regexp_extract(name, pattern, 1).alias(key))


def read_json_array(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A file that holds one array of objects."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def read_json_map(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """A file that holds one object, as rows of its entries."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", "map<string,string>")).alias(key, value))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """id (first word after >) and sequence of each record, blanks and line ends removed.

    A record begins with > at the start of a line; another > belongs to its header.
    """
    records = spark.read.text(path, lineSep="\n>").where(F.trim("value") != "")
    whole = F.when(F.startswith("value", F.lit(">")), F.expr("substring(value, 2)")).otherwise(F.col("value"))
    records = records.select(whole.alias("value"))
    head = F.substring_index(F.replace("value", F.lit("\r"), F.lit("")), "\n", 1)
    body = F.expr("substring(value, length(substring_index(value, '\n', 1)) + 1)")
    return records.select(
        F.regexp_extract(F.trim(head), r"^\S*", 0).alias("id"), F.regexp_replace(body, r"\s", "").alias("sequence")
    )


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    """representative and member of a cluster table without header, and the size of each cluster."""
    rows = spark.read.csv(path, sep="\t", schema="representative long, member long").where("member is not null")
    sizes = rows.groupBy("representative").agg(F.count("*").alias("size"))
    return rows.join(sizes, "representative")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank."""
    return spark.read.text(path).where(F.trim("value") != "")


def read_prefixed(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """Second field of the lines that begin with a prefix."""
    lines = spark.read.text(path).where(F.startswith(F.col("value"), F.lit(prefix)))
    return lines.select(F.get(F.split("value", r"\s+"), F.lit(1)).alias("value"))


def tagged_records(lines: DataFrame, column: str, fields: Sequence[str], missing: str = "*") -> DataFrame:
    """Records like `field*value#other*value`: one column per field, missing where it is absent."""
    def value(field: str):
        return F.regexp_extract(column, rf"(?:^|#){field}\*([^#]*)", 1)

    return lines.select(*[F.when(value(f) == "", missing).otherwise(value(f)).alias(f) for f in fields])


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """query, target and percentage of an alignment table; short and unparsable rows are left out."""
    raw = spark.read.csv(path, sep="\t", schema="query string, target string, pident string")
    return raw.withColumn("pident", F.col("pident").try_cast("double")).where("query is not null and target is not null and pident is not null")


def read_named(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Named columns of a CSV file, trimmed, without rows in which one is blank."""
    rows = spark.read.option("header", True).csv(path)
    lacking = [c for c in columns if c not in rows.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    trimmed = rows.select(*[F.trim(c).alias(c) for c in columns])
    for c in columns:
        trimmed = trimmed.where(F.col(c) != "")
    return trimmed


def write_csv(rows: DataFrame, path: str, separator: str = ",") -> None:
    rows.write.mode("overwrite").option("header", True).option("sep", separator).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    """One object a line."""
    rows.write.mode("overwrite").json(path)


def write_json_array(rows: DataFrame, path: str, files: int = 1) -> None:
    """Files that hold one array of objects each, an object a line.

    The first and the last row of a file carry its brackets; one file passes
    through one task, so take more for a large table.
    """

    def bracketed(batches):
        import pyarrow as pa

        line = None
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if line is not None:
                    yield pa.RecordBatch.from_arrays([pa.array([line + ","])], names=["value"])
                    line = text
                else:
                    line = "[" + text
        if line is not None:
            yield pa.RecordBatch.from_arrays([pa.array([line + "]"])], names=["value"])

    texts = rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
    if texts.limit(1).count():
        texts = texts.coalesce(files).mapInArrow(bracketed, "value string")
    else:
        texts = rows.sparkSession.createDataFrame([("[]",)], "value string").coalesce(1)
    texts.write.mode("overwrite").text(path)


def write_all(rows: DataFrame, path: str) -> dict[str, str]:
    """The same rows as JSON lines, CSV and Parquet under path; the Parquet table comes first and is what the others read."""
    rows.write.mode("overwrite").parquet(f"{path}/parquet")
    kept = rows.sparkSession.read.parquet(f"{path}/parquet")
    write_json(kept, f"{path}/json")
    write_csv(kept, f"{path}/csv")
    return {kind: f"{path}/{kind}" for kind in ("parquet", "json", "csv")}


def write_fasta(rows: DataFrame, path: str, name: str = "id", sequence: str = "sequence") -> None:
    """One record per distinct sequence, under its smallest id."""
    one = rows.groupBy(sequence).agg(F.min(name).alias(name))
    one.select(F.concat(F.lit(">"), F.col(name).cast("string"), F.lit("\n"), F.col(sequence))).write.mode("overwrite").text(path)


def append_missing(rows: DataFrame, path: str, keys: Sequence[str]) -> DataFrame:
    """Append to a Parquet cache the rows whose keys it lacks; the cache as it then is, each key once.

    Two writers at a time may both append a key. Readers get one row of it
    then: that of the smallest values, so that all readers agree.
    """
    spark = rows.sparkSession
    try:
        have = spark.read.parquet(path).select(*keys)
        rows = rows.join(have, list(keys), "left_anti")
    except AnalysisException as e:  # the cache is not there yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.dropDuplicates(list(keys)).write.mode("append").parquet(path)
    return read_cache(spark, path, keys)


def read_cache(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """A cache's rows, each key once."""
    held = spark.read.parquet(path)
    rest = [c for c in held.columns if c not in keys]
    if not rest:
        return held.distinct()
    one = held.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_r"))
    return one.select(*keys, *[F.col("_r")[c].alias(c) for c in rest]).select(*held.columns)
