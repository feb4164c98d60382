"""Read and write campaign tables: many small Parquet parts, CSV, JSON manifests; unions and id sets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyarrow import parquet
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyfield.session import pinned

ORDER_FILE, ORDER_ROW = "read_file", "read_row"


def read_parts(
    spark: SparkSession, root: str, columns: Sequence[str] | None = None, pattern: str = "*.parquet", with_order: bool = False
) -> DataFrame:
    """Every Parquet part below ``root``; schemas are merged, so a part with fewer columns reads as NULL there.

    ``with_order`` adds the file and the row number in it: the order in which rows count as read,
    for keep-last. Only the wanted columns are read.
    """
    df = (
        spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)
    )
    picks = list(columns) if columns else df.columns
    if with_order:
        return df.selectExpr(*picks, f"_metadata.file_path as {ORDER_FILE}", f"_metadata.row_index as {ORDER_ROW}")
    return df.select(*picks)


#: Files looked into at a time among those that gave no rows.
SILENT_FILES = 1000
#: A Parquet file without rows is its footer only; a longer one that gives no rows is damaged.
LONGEST_EMPTY = 64 << 20


def _footers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        states = []
        for content in batch.column(batch.schema.get_field_index("content")).to_pylist():
            try:
                states.append("empty" if parquet.read_metadata(pa.BufferReader(content)).num_rows == 0 else "unreadable")
            except (pa.ArrowInvalid, OSError):
                states.append("unreadable")
        yield pa.record_batch([batch.column(batch.schema.get_field_index("path")), pa.array(states)], ["path", "state"])


def part_states(spark: SparkSession, root: str, schema: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, bytes, n_rows, fingerprint, state) of every Parquet part below ``root``; damaged parts are named and do not end the job.

    A part counts as ``ok`` if all its columns in ``schema`` can be read and give rows, ``empty`` if it is sound and has no rows, else
    ``unreadable``. Parts are listed first, so one that gives nothing is still seen. Only the few that give no rows are opened again for
    their footer. A part that breaks off midway keeps the rows before the damage; a contract on its scenarios shows the rest as missing.
    ``fingerprint`` is an order-free hash of the rows.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path", F.col("length").alias("bytes"))
    rows = spark.read.schema(schema).option("ignoreCorruptFiles", True).option("recursiveFileLookup", True).option("pathGlobFilter", pattern).parquet(root)
    read = rows.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(F.xxhash64(*[F.col(c) for c in rows.columns])).alias("fingerprint"))
    plain = F.regexp_replace(F.col("path"), "^file:/+", "file:/")
    found = pinned(listed.join(read.withColumn("_plain", F.regexp_replace(F.url_decode(F.regexp_replace("_file", "[+]", "%2B")), "^file:/+", "file:/")), plain == F.col("_plain"), "left").select("path", "bytes", "n_rows", "fingerprint"))
    silent = found.filter(f"n_rows is null and bytes <= {LONGEST_EMPTY}").select("path").toLocalIterator()
    states = spark.createDataFrame([], "path string, state string")
    while paths := [r["path"] for r in islice(silent, SILENT_FILES)]:
        states = states.unionByName(spark.read.format("binaryFile").load(paths).select("path", "content").mapInArrow(_footers, "path string, state string"))
    return found.join(states, "path", "left").select(
        "path", "bytes", F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"), "fingerprint",
        F.when(F.col("n_rows").isNotNull(), "ok").otherwise(F.coalesce("state", F.lit("unreadable"))).alias("state"))


def read_csv(spark: SparkSession, path: str | Sequence[str], schema: str | StructType, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV or .csv.gz with a header and a stated schema; a file without rows gives an empty typed frame."""
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    return df.select(*columns) if columns else df


def read_manifests(spark: SparkSession, root: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """One row per JSON document with its path; a document that cannot be read gives NULLs and ``readable`` = false."""
    fields = f"{schema}, _corrupt string"
    df = (
        spark.read.schema(fields).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("recursiveFileLookup", True).option("pathGlobFilter", pattern).json(root)
    )
    return df.selectExpr("_metadata.file_path as path", "_corrupt is null as readable", "*").drop("_corrupt")


def marker_flags(files: DataFrame, markers: Sequence[str]) -> DataFrame:
    """From a file listing (``path``): one row per folder, one flag per marker file name."""
    split = files.selectExpr("regexp_extract(path, '^(.*)/[^/]*$', 1) as folder", "regexp_extract(path, '([^/]*)$', 1) as name")
    return split.groupBy("folder").agg(*[F.expr(f"bool_or(name = '{m}') as `has_{m.split('.')[0].lower().strip('_')}`") for m in markers])


def collect_outputs(spark: SparkSession, root: str, schema: str, name: str, case_level: int = 1) -> DataFrame:
    """Union of one summary CSV per case folder; the case id is the folder name."""
    df = (
        spark.read.schema(schema).option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).csv(root)
    )
    return df.selectExpr(f"element_at(split(_metadata.file_path, '/'), {-1 - case_level}) as case_id", "*")


def write_table(df: DataFrame, path: str, kind: str = "parquet", partition_by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """Parquet with zstd, or CSV with a header; written by all tasks at once."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    else:
        raise ValueError(f"unknown format {kind}")


def union_promote(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; a column missing in one of them is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def id_sets(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """(key, side): ids in both, in the first only, in the second only. One aggregation instead of three set operations."""
    tagged = first.selectExpr(key, "1 as s").unionByName(second.selectExpr(key, "2 as s")).distinct()
    return tagged.groupBy(key).agg(F.expr("sum(s) as s")).selectExpr(
        key, "case s when 3 then 'both' when 1 then 'first_only' else 'second_only' end as side"
    )


def same_ids(first: DataFrame, second: DataFrame, key: str) -> bool:
    return id_sets(first, second, key).filter("side <> 'both'").isEmpty()
