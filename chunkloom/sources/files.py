"""Readers: raw uploads, mapping files, relational tables and captured streams."""

from __future__ import annotations

import gc
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from chunkloom import constants as K

SPREAD_BYTES = 32 * 1024 * 1024
#: Folders whose files the driver knows at a time; Spark lists more than 32 in tasks.
FOLDERS_AT_ONCE = 50
MAPPING_SCHEMA = "row_id int, chunk_id long, doc_id long, chunk_index int, content string"


def read_files(spark: SparkSession, path: str | Sequence[str], extensions: Sequence[str] = K.SUPPORTED_EXTENSIONS) -> DataFrame:
    """Uploaded files with path, size and bytes, their suffix in any case; other suffixes are not even listed."""
    any_case = ["".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions]
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.{" + ",".join(any_case) + "}")
        .option("recursiveFileLookup", "true")
        .load(path if isinstance(path, str) else list(path))
        .select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size_bytes"), "content")
    )


def read_folders(spark: SparkSession, path: str, folders: Sequence[str], extensions: Sequence[str] = K.SUPPORTED_EXTENSIONS) -> Iterator[DataFrame]:
    """``read_files`` over ``folders`` below ``path``, some at a time, so that the driver never holds the paths of all files.

    Without folders the files of ``path`` are read. Spark gives a task 32 small files; the tasks are drawn together to a few for each core.
    Frames refer to themselves, so Python would leave those of earlier folders, and with them the paths in the JVM, for a collection much later.
    """
    tasks = 4 * spark.sparkContext.defaultParallelism
    for k in range(0, max(1, len(folders)), FOLDERS_AT_ONCE):
        yield read_files(spark, folders[k : k + FOLDERS_AT_ONCE] or path, extensions).coalesce(tasks)
        gc.collect()


def read_index_mapping_json(spark: SparkSession, path: str) -> DataFrame:
    """Per-document mapping files, each a JSON array of rows."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", "true").schema(MAPPING_SCHEMA).json(path)


def read_table(
    spark: SparkSession, location: str, columns: Sequence[str] | None = None, where: Column | None = None,
    jdbc: dict[str, str] | None = None,
) -> DataFrame:
    """Parquet path, or a database table when ``jdbc`` options are given; filter and columns are pushed down."""
    if jdbc is not None:
        table = spark.read.format("jdbc").options(**jdbc).option("dbtable", location).load()
    else:
        table = spark.read.parquet(location)
    if where is not None:
        table = table.where(where)
    return table.select(*columns) if columns else table


def key_bounds(keys: DataFrame, key: str, parts: int) -> list:
    """Up to ``parts`` - 1 distinct values that cut the rows into stretches of about as many rows each; null keys do not count."""
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    column = F.col(key)
    if dict(keys.dtypes)[key] in ("string", "boolean", "binary"):
        # No quantile sketch orders strings: the bounds are the first values of even stretches of a bounded sample.
        sample = sorted(r[0] for r in keys.where(column.isNotNull()).orderBy(F.xxhash64(column)).limit(100 * parts).select(key).collect())
        return sorted({sample[len(sample) * i // parts] for i in range(1, parts)}) if sample else []
    found = keys.agg(F.percentile_approx(column, shares, F.lit(100 * parts)).alias("b")).head()[0]
    return sorted(set(found or []))


def _literal(value) -> str:
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return str(value)
    return "'" + str(value).replace("'", "''") + "'"


def key_predicates(key: str, bounds: Sequence) -> list[str]:
    """Conditions that part all rows, each in one part; rows without a key go with the lowest ones."""
    if not bounds:
        return ["1 = 1"]
    cuts = [_literal(b) for b in bounds]
    between = [f"{key} >= {a} AND {key} < {b}" for a, b in zip(cuts, cuts[1:])]
    return [f"{key} < {cuts[0]} OR {key} IS NULL", *between, f"{key} >= {cuts[-1]}"]


def read_database(
    spark: SparkSession, url: str, table: str, key: str, parts: int, columns: Sequence[str] = ("*",), where: str | None = None,
    newest: int | None = None, properties: dict[str, str] | None = None,
) -> DataFrame:
    """A database table in ``parts`` queries of about as many rows each, parted by quantiles of ``key`` rather than even steps of its range.

    Columns, filter and, with ``newest``, an order by the key with a limit are part of the query that the database runs.
    """
    query = f"SELECT {', '.join(columns)} FROM {table}" + (f" WHERE {where}" if where else "")
    if newest is not None:
        limited = f"({query} ORDER BY {key} DESC LIMIT {newest}) limited"
        return spark.read.jdbc(url, limited, properties=properties or {})
    keys = spark.read.jdbc(url, f"(SELECT {key} FROM {table}" + (f" WHERE {where}" if where else "") + ") keys", properties=properties or {})
    return spark.read.jdbc(url, f"({query}) part", predicates=key_predicates(key, key_bounds(keys, key, parts)), properties=properties or {})


def spread(table: DataFrame, key: str) -> DataFrame:
    """Deal a small input that sits in few row groups out to all cores; a large one is split already."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return table.repartition(cores, key) if size < cores * SPREAD_BYTES else table


def schema_tolerant(table: DataFrame, wanted: StructType) -> DataFrame:
    """The wanted columns; those the table lacks are null."""
    present = set(table.columns)
    return table.select(
        *[
            (F.col(f.name) if f.name in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in wanted.fields
        ]
    )


def read_sse_files(spark: SparkSession, path: str) -> DataFrame:
    """Captured streams, one file per stream."""
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(
        F.input_file_name().alias("stream"), F.col("value").alias("capture")
    )
