"""Whitening of embeddings: equal vectors once, weighted centred products, one projection per distinct vector, joined back."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import column, native_id_type, table
from tallyfield.llm.registry import query
from tallyfield.session import pinned

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Vectors that more than one in so many rows share meet their rows without a shuffle; there are fewer of them than this number.
HOT = 256
#: Rows of a matrix held at once.
ROWS = 4096


def whole_vectors(embeddings: DataFrame, dimensions: int, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x, key) of the rows whose vector has ``dimensions`` entries, all finite: x as little-endian 64-bit numbers, key its 128-bit hash."""
    scaled = F.transform(F.col(vector), lambda c: F.floor(F.lit(SCALE) * c.cast("double")) + F.lit(SHIFT))
    usable = embeddings.where(F.col(vector).isNotNull() & (F.size(vector) == dimensions)).where(
        F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) != F.lit(float("inf"))))
    )

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = column(batch, "x").flatten().to_numpy(zero_copy_only=False).astype("<i8")
            blob = pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * dimensions), batch.num_rows, [None, pa.py_buffer(values.tobytes())])
            yield pa.record_batch([column(batch, "vec_id"), blob.cast(pa.binary())], ["vec_id", "x"])

    rows = usable.select(F.col(id_column).alias("vec_id"), scaled.alias("x")).mapInArrow(packed, f"vec_id {native_id_type(embeddings, id_column)}, x binary")
    return rows.withColumn("key", F.unhex(F.md5("x")))


def matrices(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, ROWS):
            part = batch.slice(a, ROWS)
            yield part, np.frombuffer(b"".join(column(part, "x").to_pylist()), "<i8").reshape(part.num_rows, dimensions)


def summed_products(rows: DataFrame, make, width: int) -> np.ndarray:
    """The sum of ``make(batch)``, a matrix with rows of ``width`` numbers per slice of ``rows``.

    Each task adds up its slices and sends every line of its matrix to the task that adds up this line, so no task receives a whole matrix from all.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                more = make(batch.slice(a, ROWS))
                total = more if total is None else total + more
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array([line.astype("<f8").tobytes() for line in total], pa.binary())], ["line", "numbers"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines: dict[int, np.ndarray] = {}
        for batch in batches:
            for line, blob in zip(column(batch, "line").to_pylist(), column(batch, "numbers").to_pylist(), strict=True):
                numbers = np.frombuffer(blob, "<f8")
                lines[line] = lines[line] + numbers if line in lines else numbers
        if lines:
            yield pa.record_batch([pa.array(list(lines)), pa.array([v.tobytes() for v in lines.values()], pa.binary())], ["line", "numbers"])

    schema = "line long, numbers binary"
    found = rows.mapInArrow(partial, schema).repartition("line").mapInArrow(added, schema).collect()  # one row per line
    out = np.zeros((len(found), width))
    for r in found:
        out[r["line"]] = np.frombuffer(r["numbers"], "<f8")
    return out


@dataclass
class Whitening:
    """Fitted on distinct vectors: their total weight ``n``, weighted sums ``sums``, ``components`` in columns and their variances ``values`` of ``trace`` in all."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def middle(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and the rest, so that vectors are centred without loss."""
        whole = self.sums // max(1, self.n)
        return whole, (self.sums - whole * self.n) / max(1, self.n)

    def apply(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.middle()
        return ((x - whole) - rest) @ self.components / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums of (n x - sums)^2; null where a long cannot hold them."""
        apart = self.n * x - self.sums
        held = (apart.astype(np.float64) ** 2).sum(axis=1) < 9.2e18
        exact = (np.where(held[:, None], apart, 0) ** 2).sum(axis=1)
        return [v if h else None for v, h in zip(exact.tolist(), held.tolist(), strict=True)]


def fit(distinct: DataFrame, dimensions: int, components: int = COMPONENTS, weight: str = "one") -> Whitening:
    """Weighted covariance of the distinct vectors (columns x, copies): every vector counts once, or as often as it occurs (``weight="copies"``).

    Sums are exact whole numbers. Vectors are centred on the whole part of the mean before they are multiplied: those products and their sums are exact
    for entries up to some millions, whatever order tasks end in, and the rest of the mean, below one, is taken out of the result.
    Components whose variance is nil beside the largest are left out, so constant dimensions do no harm.
    """
    factor = F.lit(1) if weight == "one" else F.col("copies")
    rows = distinct.select("x", factor.cast("long").alias("w"))

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, np.zeros(dimensions, np.int64)
        for part, x in matrices(batches, dimensions):
            w = column(part, "w").to_numpy()
            n, sums = n + int(w.sum()), sums + (x * w[:, None]).sum(axis=0)
        yield pa.record_batch([pa.array(np.arange(dimensions + 1)), pa.array([*sums.tolist(), n], pa.int64())], ["at", "total"])

    total = {r["at"]: r["total"] for r in rows.mapInArrow(totals, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).collect()}
    n = int(total.get(dimensions, 0))
    sums = np.array([total.get(i, 0) for i in range(dimensions)], np.int64)
    empty = Whitening(n, sums, np.zeros((dimensions, 0)), np.zeros(0), 0.0)
    if n < 1:
        return empty
    whole, rest = empty.middle()

    def products(batch: pa.RecordBatch) -> np.ndarray:
        x = np.frombuffer(b"".join(column(batch, "x").to_pylist()), "<i8").reshape(batch.num_rows, dimensions)
        centred = (x - whole).astype(np.float64)
        return (centred * column(batch, "w").to_numpy()[:, None]).T @ centred

    covariance = summed_products(rows, products, dimensions) / n - np.outer(rest, rest)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values > max(0.0, float(values[0])) * dimensions * 1e-14
    keep = min(components, int(real.sum()))
    return Whitening(n, sums, vectors[:, :keep], values[:keep], float(np.trace(covariance)))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, weight: str = "one", id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row per usable row of ``embeddings`` and component.

    Usable are rows with a vector whose entries are neither null nor infinite nor NaN; of vectors of several lengths, those of the most frequent length (the longer of
    two equally frequent ones), and never empty ones. Null and repeated ids are rows like others, equal vectors count once in the fit (or by their number, with
    ``weight="copies"``). With fewer than two distinct vectors, or an empty table, no component has a variance and there are no rows.
    Other columns are not read.

    Distinct vectors are found by a 128-bit hash after map-side combining. Each is projected once, and its numbers are joined back by that hash; the few vectors
    that many rows share (fewer than ``HOT``) are broadcast, so their rows stay where they are.
    """
    spark = embeddings.sparkSession
    id_type = native_id_type(embeddings, id_column)
    schema = f"vec_id {id_type}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = embeddings.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).first()
    if sizes is None:
        return spark.createDataFrame([], schema)
    dimensions = sizes["d"]
    rows = whole_vectors(embeddings, dimensions, id_column, vector)
    distinct = pinned(rows.groupBy("key").agg(F.any_value("x").alias("x"), F.count("*").alias("copies")))
    model = fit(distinct, dimensions, components, weight)
    kept = len(model.values)
    if not kept:
        return spark.createDataFrame([], schema)
    held = spark.sparkContext.broadcast((model.n, model.sums, model.components, model.values, model.trace))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = Whitening(*held.value)
        for part, x in matrices(batches, dimensions):
            numbers = fitted.apply(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, numbers.size + 1, kept), pa.int32()), pa.array(numbers.ravel()))
            yield pa.record_batch([column(part, "key"), column(part, "copies"), pa.array(fitted.deviations(x), pa.int64()), lists], ["key", "copies", "deviation", "whitened"])

    projected = pinned(distinct.select("key", "copies", "x").mapInArrow(project, "key binary, copies long, deviation long, whitened array<double>"))
    weighted = projected.select("whitened", (F.lit(1) if weight == "one" else F.col("copies")).cast("long").alias("w"))

    def numbers_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        return column(batch, "whitened").flatten().to_numpy().reshape(batch.num_rows, kept), column(batch, "w").to_numpy()[:, None].astype(np.float64)

    def weighted_sum(batch: pa.RecordBatch) -> np.ndarray:
        y, w = numbers_of(batch)
        return (y * w).sum(axis=0)[None, :]

    mean = summed_products(weighted, weighted_sum, kept)[0] / model.n

    def products(batch: pa.RecordBatch) -> np.ndarray:
        y, w = numbers_of(batch)
        return ((y - mean) * w).T @ (y - mean)

    error = float(np.abs(summed_products(weighted, products, kept) / model.n - np.eye(kept)).max())
    total = projected.agg(F.sum("copies")).first()[0]
    shared = F.col("copies") * HOT > total
    hot = projected.where(shared).select("key", "deviation", "whitened")
    by_key = rows.select("vec_id", "key")
    hot_rows = by_key.join(F.broadcast(hot), "key")
    other_rows = by_key.join(F.broadcast(hot.select("key")), "key", "left_anti").join(projected.where(~shared).select("key", "deviation", "whitened"), "key")
    share = F.array(*[F.lit(float(v / model.trace)) for v in model.values])
    return hot_rows.unionByName(other_rows).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.element_at(share, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


@query("op13_whitening")
def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
