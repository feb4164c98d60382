"""File inventories and checksums. Listings never read file contents; checksums read each file once."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.session import pinned, scratch_path

#: Files of up to so many bytes are hashed as one row, longer ones in legs of so many bytes.
LEG_BYTES = 256 << 20


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, bytes): path below ``root``. The content column is pruned, so only metadata is read."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    inside = root.rstrip("/").split("/")[-1]
    return df.selectExpr(f"regexp_extract(path, '(?:^|/){inside}/(.*)$', 1) as path", "length as bytes")


def inventory(files: DataFrame, event_pattern: str, case_pattern: str) -> DataFrame:
    """Per file: event and case found in its path, role (file name), extension and size."""
    return files.select(
        "path",
        F.regexp_extract("path", event_pattern, 1).alias("event"),
        F.regexp_extract("path", case_pattern, 1).alias("case_id"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("role"),
        F.lower(F.regexp_extract("path", r"((?:\.[A-Za-z0-9]+)+)$", 1)).alias("extension"),
        "bytes",
    )


def role_totals(listed: DataFrame) -> DataFrame:
    return listed.groupBy("event", "extension").agg(F.expr("count(*) as files"), F.expr("sum(bytes) as bytes"))


def folder_counts(files: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Files below every folder prefix, down to ``max_depth`` if one is given: each path is exploded into its prefixes, then counted."""
    parts = files.selectExpr("slice(split(path, '/'), 1, size(split(path, '/')) - 1) as p").filter("size(p) > 0")
    depth = "size(p)" if max_depth is None else f"least(size(p), {max_depth})"
    prefixes = parts.selectExpr(
        f"explode(transform(sequence(1, {depth}), n -> array_join(slice(p, 1, n), '/'))) as folder"
    )
    return prefixes.groupBy("folder").agg(F.expr("count(*) as files"))


def large_members(listed: DataFrame, at_least: int) -> DataFrame:
    """Pointers to files too large to copy: path, case, role and size."""
    return listed.filter(F.col("bytes") >= at_least).select("path", "case_id", "role", "bytes")


def _openssl():
    """SHA-256 of the library behind ``hashlib``, whose state is a plain record of 112 bytes; None where Python is built without it."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        return lib if lib.SHA256_Init and lib.SHA256_Update and lib.SHA256_Final else None
    except (ImportError, AttributeError, OSError):
        return None


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines (file, start of their split, line) in order, as pieces of many lines each."""
    place = 0
    for batch in batches:
        file, start = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        edges = [0, *(np.flatnonzero((file[1:] != file[:-1]) | (start[1:] != start[:-1])) + 1).tolist(), len(file)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if a < b:
                lines = pa.LargeListArray.from_arrays(pa.array([0, b - a], pa.int64()), batch.column(2).slice(a, b - a).cast(pa.large_binary()))
                piece = pc.binary_join(lines, pa.scalar(b"\n", pa.large_binary()))[0].as_py()
                yield pa.record_batch([pa.array([x]) for x in (int(file[a]), int(start[a]), place, len(piece), piece)], ["file", "start", "place", "size", "piece"])
                place += 1


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by file, start and place: the state of a file (start -1: record, then a byte that tells whether a piece came before), then its pieces."""
    lib, at, record, begun = _openssl(), None, None, 0

    def state() -> pa.RecordBatch:
        return pa.record_batch([pa.array([at]), pa.array([record.raw + bytes([begun])])], ["file", "state"])

    for batch in batches:
        for file, start, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            piece = piece.as_py()
            if start < 0:
                if at is not None:
                    yield state()
                at, record, begun = file, ctypes.create_string_buffer(piece[:-1], 112), piece[-1]
                continue
            if begun:
                lib.SHA256_Update(record, b"\n", ctypes.c_size_t(1))
            lib.SHA256_Update(record, piece, ctypes.c_size_t(len(piece)))
            begun = 1
    if at is not None:
        yield state()


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first state of every file: (file, rest), with the byte order mark that the reader of lines leaves out."""
    lib = _openssl()
    for batch in batches:
        states = []
        for rest in batch.column(1).to_pylist():
            record = ctypes.create_string_buffer(112)
            lib.SHA256_Init(record)
            if rest >= 3:
                lib.SHA256_Update(record, b"\xef\xbb\xbf", ctypes.c_size_t(3))
            states.append(record.raw + b"\0")
        yield pa.record_batch([batch.column(0), pa.array(states, pa.binary())], ["file", "state"])


def _ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, bytes, state, rest) to digests, with the newline at the end if there is one."""
    lib = _openssl()
    for batch in batches:
        digests = []
        for state, rest in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            record, out = ctypes.create_string_buffer(state[:-1], 112), ctypes.create_string_buffer(32)
            if rest in (1, 4):
                lib.SHA256_Update(record, b"\n", ctypes.c_size_t(1))
            lib.SHA256_Final(out, record)
            digests.append(out.raw.hex())
        yield pa.record_batch([batch.column(0), batch.column(1), pa.array(digests, pa.string())], ["path", "bytes", "sha256"])


def _in_legs(spark: SparkSession, lines: DataFrame, large: DataFrame, leg_bytes: int) -> DataFrame:
    """(path, bytes, sha256) of the files in ``large`` (file, path, bytes), read as ``lines`` (file, start, line).

    A SHA-256 is a chain over a file's bytes, but its state is small: all splits are read at once, then a task per file takes the state
    over the next leg. So no task reads a file; there are as many rounds as legs of the largest file. Lines are cut at newlines alone and joined by
    them again; a file whose size differs by more than the newline at its end and the byte order mark ends the job.
    """
    folder = scratch_path(spark, "file-legs")
    pieces = lines.mapInArrow(_joined, "file long, start long, place long, size long, piece binary")
    pieces.withColumn("leg", F.expr(f"start div {leg_bytes}")).write.partitionBy("leg").parquet(folder)
    pieces = spark.read.schema("file long, start long, place long, size long, piece binary, leg long").parquet(folder)
    sizes = pieces.groupBy("file").agg(F.expr("sum(size) + count(*) - 1 as joined"))
    known = pinned(large.join(sizes, "file", "left").selectExpr("file", "path", "bytes", "cast(bytes - joined as int) as rest"))
    files, rounds, wrong = known.agg(F.count("*"), F.max("bytes"), F.expr("min_by(path, path) filter (where rest is null or rest not in (0, 1, 3, 4))")).first()
    if wrong is not None:
        raise ValueError(f"{wrong}: its lines do not make up the file")
    state = known.select("file", "rest").mapInArrow(_begun, "file long, state binary")
    for leg in range(-(-rounds // leg_bytes)):
        rows = state.selectExpr("file", "-1L as start", "-1L as place", "state as piece").unionByName(pieces.where(f"leg = {leg}").select("file", "start", "place", "piece"))
        ordered = rows.repartition(4 * files, "file").sortWithinPartitions("file", "start", "place")
        state = pinned(ordered.select("file", "start", "piece").mapInArrow(_advance, "file long, state binary"))
    return known.join(state, "file").select("path", "bytes", "state", "rest").mapInArrow(_ended, "path string, bytes long, sha256 string")


def checksum_manifest(spark: SparkSession, root: str, pattern: str = "*", leg_bytes: int = LEG_BYTES) -> DataFrame:
    """(path, bytes, sha256). Files above ``leg_bytes`` are read in splits and hashed in legs, here and now (:func:`_in_legs`); others are a row each.

    Files that Spark would unpack when it reads lines stay a row each, as do all files where Python lacks OpenSSL.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    inside = root.rstrip("/").split("/")[-1]
    below = f"regexp_extract(path, '(?:^|/){inside}/(.*)$', 1) as path"
    digest = [below, "length as bytes", "sha2(content, 256) as sha256"]
    packed = r"_metadata.file_path rlike '\\.(bz2|deflate|gz|lz4|lzo|passthrough|snappy|xz|zst|zstd)$'"
    large = df.where(f"_metadata.file_size > {leg_bytes} and not {packed}").selectExpr("xxhash64(_metadata.file_path) as file", below, "length as bytes")
    if _openssl() is None or large.isEmpty():
        return df.selectExpr(*digest)
    text = spark.read.option("lineSep", "\n").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root)
    lines = text.where(f"_metadata.file_size > {leg_bytes} and not {packed}").selectExpr(
        "xxhash64(_metadata.file_path) as file", "_metadata.file_block_start as start", "cast(value as binary) as line")
    found = _in_legs(spark, lines, large, leg_bytes)
    whole = df.where(f"_metadata.file_size <= {leg_bytes} or {packed}")  # a filter on these columns is held against the listing: other files are not read
    return whole.selectExpr(*digest).unionByName(found)


def verify_manifest(manifest: DataFrame, actual: DataFrame, max_bytes: int, required: Sequence[str] = ()) -> DataFrame:
    """(path, problem): missing, changed, not listed, oversize, or required but absent."""
    left = manifest.selectExpr("path", "sha256 as want")
    right = actual.selectExpr("path", "sha256 as have", "bytes")
    joined = left.join(right, "path", "full")
    problem = f"""case when have is null then 'missing' when want is null then 'not_listed' when want <> have then 'changed'
        when bytes > {max_bytes} then 'oversize' end"""
    found = joined.selectExpr("path", f"{problem} as problem").filter("problem is not null")
    if not required:
        return found
    names = ", ".join(f"'{r}'" for r in required)
    present = actual.agg(F.expr(f"collect_set(if(path in ({names}), path, null)) as present"))
    absent = present.selectExpr(f"explode(array_except(array({names}), present)) as path", "'required_absent' as problem")
    return found.unionByName(absent)
