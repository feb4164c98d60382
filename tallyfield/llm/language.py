"""Language identification by the nearest of several centroids per language, with rejection by distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import code_points, column, gram_buckets, held_out, mapped, native_id_type, slices, summed_tables, table, texts
from tallyfield.llm.registry import query

SIZES, BITS = (1, 2, 3), 14
#: Labelled texts per language on which centroids and distance limits are fitted; document frequencies cover all training texts.
SAMPLE = 400
CENTROIDS, ROUNDS = 4, 12
#: A text is rejected if its cosine is below this share of the first percentile of training windows of its length.
MARGIN = 0.7
SHORTEST, LONGEST = 4, 13
UNKNOWN = "und"


#: Runs of anything but letters become one space: symbols and digits say nothing about the language.
NO_LETTERS = re.compile(r"[\W\d_]+")


def counts_of(text: str) -> np.ndarray:
    letters = " " + NO_LETTERS.sub(" ", text.lower()).strip() + " "
    return np.bincount(gram_buckets(code_points(letters), SIZES, BITS), minlength=1 << BITS)


@dataclass
class Model:
    """Languages by centroid, unit centroids, inverse document frequencies, and the least cosine by length (power of two of characters)."""

    languages: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray

    def vector(self, counts: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * self.idf
        norm = np.sqrt(v @ v)
        return (v / norm if norm else v).astype(np.float32)

    def predict(self, text: str) -> tuple[str, float, bool]:
        """Language, cosine to the nearest centroid, rejected. Without letters or without any training text: unknown, 0, rejected."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vector(counts_of(text))
        best = int(np.argmax(cosines))
        score = float(min(1.0, max(0.0, cosines[best])))
        length = min(LONGEST, len(text).bit_length() - 1)
        return self.languages[best], score, length >= SHORTEST and score < self.least[best, length]


def clusters(vectors: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means, seeded with the mean and then always the vector farthest from all seeds."""
    seeds = [vectors.mean(0)]
    while len(seeds) < min(k, len(vectors)):
        near = np.max(vectors @ np.array(seeds).T, axis=1)
        seeds.append(vectors[int(np.argmin(near))])
    centroids = np.array(seeds)
    for _ in range(rounds):
        which = np.argmax(vectors @ centroids.T, axis=1)
        centroids = np.array([vectors[which == i].mean(0) for i in range(len(centroids)) if (which == i).any()])
        centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    return centroids.astype(np.float32)


def fit(documents: DataFrame, sample: int = SAMPLE, k: int = CENTROIDS) -> Model:
    """Fit on the rows with a language whose id is not held out.

    Document frequencies come from all of them, as sums of tables of a fixed width. At most ``sample`` texts per language, those with the least
    hash of their id, go to the driver as sparse counts for clustering and for the distance limits.
    """
    train = documents.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    by_language = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count("*").alias("n")).collect()}

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS) + 1, np.int64)
        for batch in slices(batches, "text"):
            for text in texts(batch, "text"):
                total[:-1] += counts_of(text) > 0
                total[-1] += 1
        yield pa.record_batch([pa.array(["df"]), pa.array([total.astype("<i8").tobytes()], pa.binary())], ["name", "counts"])

    df = summed_tables(train.select("text").mapInArrow(frequencies, "name string, counts binary"), (1 << BITS) + 1, ["df"])[0]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1.0
    shares = F.create_map(*[F.lit(x) for name, n in by_language.items() for x in (name, min(1.0, 1.5 * sample / n + 20 / n))]) if by_language else None
    if shares is None:
        return Model([], np.zeros((0, 1 << BITS), np.float32), idf, np.zeros((0, LONGEST + 1)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    chosen = train.select("text", "lang", draw.alias("draw")).where(F.col("draw") < shares[F.col("lang")])

    def sparse(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text, draw_ in zip(texts(batch, "text"), column(batch, "draw").to_pylist(), strict=True):
            rows = []
            for length in range(SHORTEST, LONGEST):
                room = len(text) - (1 << length)
                if room >= 0:
                    at = int(draw_ * 7919 * (length + 1) * 104729) % (room + 1)
                    rows.append((length, text[at : at + (1 << length)]))
            whole = counts_of(text)
            used = np.flatnonzero(whole)
            out.append((used.tolist(), whole[used].tolist(), [w for _, w in rows]))
        return pa.record_batch([column(batch, "lang"), column(batch, "draw"), *[pa.array(c, pa.list_(t)) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.string()), strict=True)]], ["lang", "draw", "used", "times", "windows"])

    rows = mapped(chosen, "text", sparse, "lang string, draw double, used array<int>, times array<int>, windows array<string>").toArrow().sort_by([("lang", "ascending"), ("draw", "ascending")])
    model = Model([], np.zeros((0, 1 << BITS), np.float32), idf, np.zeros((0, LONGEST + 1)))
    found, kept = [], []
    for language in pc.unique(rows["lang"]).to_pylist():
        group = rows.filter(pc.equal(rows["lang"], language)).slice(0, sample)
        vectors = np.zeros((len(group), 1 << BITS), np.float32)
        for i, (used, times) in enumerate(zip(group["used"], group["times"], strict=True)):
            counts = np.zeros(1 << BITS)
            counts[used.values.to_numpy()] = times.values.to_numpy()
            vectors[i] = model.vector(counts)
        own = clusters(vectors, k, ROUNDS)
        least = np.zeros(LONGEST + 1)
        cosines: dict[int, list[float]] = {}
        for windows in group["windows"]:
            for window in windows.as_py():
                cosines.setdefault(len(window).bit_length() - 1, []).append(float(np.max(own @ model.vector(counts_of(window)))))
        for length, values in cosines.items():
            least[length] = MARGIN * np.quantile(values, 0.01) if len(values) >= 20 else 0.0
        least = np.maximum.accumulate(least)  # a longer text is never held to less than a shorter one
        found.append(own)
        kept += [(language, least)] * len(own)
    model.centroids = np.concatenate(found) if found else model.centroids
    model.languages = [language for language, _ in kept]
    model.least = np.array([least for _, least in kept]) if kept else model.least
    return model


def identify(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document, from its whole text only.

    Null texts and texts without a letter: ``und``, score 0, rejected. Ties go to the first centroid by language name. Repeated rows give
    repeated results, an empty table none; columns other than doc_id and text are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        predict = Model(*held.value).predict
        rows = [predict(t) for t in texts(batch, "text")]
        types = (pa.string(), pa.float64(), pa.bool_())
        return pa.record_batch([column(batch, "doc_id"), column(batch, "held_out"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], ["doc_id", "held_out", "lang_pred", "score", "rejected"])

    return mapped(documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), "text", make, f"doc_id {native_id_type(documents)}, held_out boolean, lang_pred string, score double, rejected boolean")


def accepted(documents: DataFrame, model: Model) -> DataFrame:
    """The rows, all columns kept, whose text is not rejected."""
    held = documents.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        predict = Model(*held.value).predict
        return batch.filter(pa.array([not predict(t)[2] for t in texts(batch, "text")], pa.bool_()))

    return mapped(documents, "text", make, documents.schema)


@query("op3_language")
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return identify(documents, fit(documents))
