"""Shared pieces: tables, Arrow batches cut by bytes, process-wide caches, and vectorised word and n-gram hashes."""

from __future__ import annotations

import ctypes
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
#: Words are hashed in runs of so many bytes, or one longer word: a run takes 40 bytes of memory per byte.
HASH_BYTES = 1 << 18
#: Rows travel to workers in Arrow batches of so many bytes, less than a slice. Spark's own limit is 64 MB, and an executor holds several copies of a batch.
BATCH_BYTES, BATCH_SETTING = 3 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"
WHITE_BYTES = b"\x20\x09\x0a\x0b\x0c\x0d"


def small_batches(spark: SparkSession) -> None:
    """Limit the session's Arrow batches, unless it has a limit of its own. Spark reads the setting when a job starts, so it stays set."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, BATCH_BYTES)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 5 = 0; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def process_cache(name: str, make: Callable[[], object]) -> object:
    """The last object asked for, kept per Python worker. Functions travel by value, so module globals do not outlive a task.

    A worker serves stage after stage; asking for another object drops the one of the stage before.
    """
    caches = sys.__dict__.setdefault("_text_operator_caches", {})
    if name not in caches:
        caches.clear()
        caches[name] = make()
    return caches[name]


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the worker lives on and serves other stages."""
    pa.default_memory_pool().release_unused()
    if sys.platform.startswith("linux"):
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a slice holds about ``limit`` bytes of ``column``, or one longer row."""
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(size, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(at, to - at)
            at = to
    give_back()


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def utf8(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """The column's texts as UTF-8; null is empty."""
    values = column(batch, name)
    kind = pa.large_binary() if pa.types.is_large_string(values.type) else pa.binary()
    return [x or b"" for x in values.cast(kind).to_pylist()]


def texts(batch: pa.RecordBatch, name: str) -> list[str]:
    return [x or "" for x in column(batch, name).to_pylist()]


def mapped(df: DataFrame, text: str, make: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """``make`` on every slice of every batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            out = make(part)
            if out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit words (shift and multiply rounds)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n, kept per process and as long as the largest run of words so far."""
    kept = process_cache("powers", dict)
    if kept.get("n", 0) < n:
        n = -(-n >> 18) << 18
        up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        kept.update(n=n, up=np.multiply.accumulate(up), down=np.multiply.accumulate(down))
    return kept["up"], kept["down"]


def separators(ascii_words: bytes | None = None) -> np.ndarray:
    """A flag per byte: white space, or with ``ascii_words`` every ASCII byte outside it."""
    flags = np.zeros(256, bool)
    if ascii_words is None:
        flags[list(WHITE_BYTES)] = True
    else:
        flags[:128] = True
        flags[list(ascii_words)] = False
    return flags


def lower_table() -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def word_hashes(docs: list[bytes], split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of all documents in order, and where each document's words begin (one more entry at the end).

    A word's hash is its polynomial over the bytes, taken as a difference of one running sum per run of words, so no loop runs per word.
    """
    joined = np.frombuffer(b"\n".join(docs) + b"\n", np.uint8)
    sizes = np.fromiter((len(d) + 1 for d in docs), np.int64, len(docs))
    if len(joined) == 1 and not docs:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    gap = split[joined]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    begin, end = edge[0::2], edge[1::2]
    words = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        start = int(begin[at])
        to = max(at + 1, int(np.searchsorted(end, start + HASH_BYTES, side="right")))
        length = int(end[to - 1]) - start
        up, down = _powers(length)
        run = np.empty(length + 1, np.uint64)
        run[0] = 0
        np.cumsum((joined[start : start + length].astype(np.uint64) + np.uint64(1)) * up[:length], out=run[1:])
        a, b = begin[at:to] - start, end[at:to] - start
        words[at:to] = mix((run[b] - run[a]) * down[a])
        at = to
    doc_ends = np.cumsum(sizes)
    return words, np.concatenate(([0], np.searchsorted(begin, doc_ends))).astype(np.int64)


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash per run of ``size`` words, order kept; empty when there are fewer words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out = out * np.uint64(BASE | 1) + words[i : i + n]
    return mix(out)


def binary_list(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def native_id_type(df: DataFrame, name: str = "doc_id") -> str:
    return dict(df.dtypes)[name]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_buckets(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """The hash bucket of every character n-gram of the given sizes, in ``2**bits`` buckets."""
    out = []
    for n in sizes:
        if len(points) < n:
            continue
        h = points[: len(points) - n + 1] + np.uint32(n)
        for i in range(1, n):
            h = h * np.uint32(0x01000193) + points[i : len(points) - n + 1 + i]
        h ^= h >> np.uint32(15)
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits))
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def summed_rows(rows: DataFrame, width: int, names: list[str]) -> DataFrame:
    """``rows`` has a binary of ``width`` 64-bit counts per task and name; their sums as (which name, at, n), zeros left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), width), np.int64)
        for batch in batches:
            for name, blob in zip(column(batch, "name").to_pylist(), column(batch, "counts").to_pylist(), strict=True):
                total[names.index(name)] += np.frombuffer(blob, "<i8")
        which, at = np.nonzero(total)
        yield pa.record_batch([pa.array(which), pa.array(at), pa.array(total[which, at])], ["which", "at", "n"])

    return rows.mapInArrow(run, "which long, at long, n long").groupBy("which", "at").agg(F.sum("n").alias("n"))


def summed_tables(rows: DataFrame, width: int, names: list[str]) -> np.ndarray:
    """The sums as an array (name, width): at most that many rows reach the driver, as Arrow batches, since rows as objects take its memory."""
    found = summed_rows(rows, width, names).toArrow()
    out = np.zeros((len(names), width), np.int64)
    out[found["which"].to_numpy(), found["at"].to_numpy()] = found["n"].to_numpy()
    return out
