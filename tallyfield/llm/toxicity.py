"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import code_points, column, gram_buckets, held_out, mapped, native_id_type, slices, summed_rows, table, texts
from tallyfield.llm.registry import query
from tallyfield.session import pinned

SIZES, BITS = (2, 3, 4, 5, 6), 20
#: Labelled documents per class on which the model is fitted, those with the least hash of their id.
SAMPLE = 6000
#: Buckets kept for the linear model: those whose presence in toxic texts exceeds that in clean ones most clearly.
FEATURES = 1024
SMOOTH, PENALTY, ROUNDS = 1.0, 1.0, 400


def buckets_of(text: str) -> np.ndarray:
    return gram_buckets(code_points(f" {text.lower()} "), SIZES, BITS)


@dataclass
class Model:
    """A weight per bucket (ratio times coefficient, 0 outside the features) and the intercept, class shares included."""

    weights: np.ndarray
    intercept: float

    def score(self, text: str) -> float:
        buckets = buckets_of(text)
        hit = buckets[self.weights[buckets] != 0]
        margin = self.intercept + (float(self.weights[np.unique(hit)].sum()) if len(hit) else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500))))


def descend(rows: list[np.ndarray], ratio: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with a quadratic penalty on ratio-scaled presence, classes weighted equally; full gradient steps with moments."""
    sizes = np.array([len(r) for r in rows])
    flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(rows)), sizes)
    value = ratio[flat]
    share = np.where(toxic, 0.5 / max(1, toxic.sum()), 0.5 / max(1, (~toxic).sum()))
    w, b = np.ones(len(ratio)), 0.0
    m, v = np.zeros(len(ratio) + 1), np.zeros(len(ratio) + 1)
    for step in range(1, ROUNDS + 1):
        margin = b + np.bincount(owner, value * w[flat], len(rows))
        error = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - toxic) * share
        gradient = np.append(np.bincount(flat, value * error[owner], len(ratio)) + PENALTY * w / max(1, len(ratio)), error.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Model:
    """Fit on at most ``sample`` labelled documents per class whose id is not held out; a document with several labels takes the highest.

    The sample's ids (bounded by the parameter) are broadcast to find its texts. Without rows of both classes the model is constant.
    """
    marked = labels.select("doc_id", "toxic").where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {int(r["toxic"]): r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    zero = np.zeros(1 << BITS, np.float32)
    if len(sizes) < 2:
        return Model(zero, {0: -5.0, 1: 5.0}.get(next(iter(sizes), 0), 0.0))
    draw = F.xxhash64("doc_id")
    ids = None
    for label in (0, 1):
        part = marked.where(F.col("toxic") == label).orderBy(draw, "doc_id").limit(sample)
        ids = part if ids is None else ids.union(part)
    chosen = documents.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("text", "toxic")

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, (1 << BITS) + 1), np.int64)
        for batch in slices(batches, "text"):
            for text, label in zip(texts(batch, "text"), column(batch, "toxic").to_pylist(), strict=True):
                total[label, np.unique(buckets_of(text))] += 1
                total[label, -1] += 1
        yield pa.record_batch([pa.array(["0", "1"]), pa.array([t.astype("<i8").tobytes() for t in total], pa.binary())], ["name", "counts"])

    sums = summed_rows(chosen.mapInArrow(presence, "name string, counts binary"), (1 << BITS) + 1, ["0", "1"])
    counts = pinned(sums.groupBy("at").agg(F.sum(F.expr("if(which = 0, n, 0)")).alias("clean"), F.sum(F.expr("if(which = 1, n, 0)")).alias("toxic")))
    documents_of = counts.where(F.col("at") == 1 << BITS).first()
    if documents_of is None or not documents_of["clean"] or not documents_of["toxic"]:
        return Model(zero, 0.0)
    shares = counts.where(F.col("at") < 1 << BITS).select("at", *[((F.col(k) + SMOOTH) / (documents_of[k] + 2 * SMOOTH)).alias(k) for k in ("clean", "toxic")])
    spread = F.sqrt(F.col("toxic") * (1 - F.col("toxic")) / documents_of["toxic"] + F.col("clean") * (1 - F.col("clean")) / documents_of["clean"])
    top = shares.orderBy(F.desc((F.col("toxic") - F.col("clean")) / spread), "at").limit(features).toPandas().sort_values("at")
    best, ratio = top["at"].to_numpy(), np.log(top["toxic"].to_numpy() / top["clean"].to_numpy())
    place = np.full(1 << BITS, -1, np.int64)
    place[best] = np.arange(len(best))
    held = documents.sparkSession.sparkContext.broadcast(place)

    def selected(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [np.unique(x[x >= 0]).astype(np.int32) for x in (held.value[buckets_of(t)] for t in texts(batch, "text"))]
        return pa.record_batch([pa.array([r.tolist() for r in rows], pa.list_(pa.int32())), column(batch, "toxic")], ["found", "toxic"])

    found = mapped(chosen, "text", selected, "found array<int>, toxic int").toPandas()
    is_toxic = found["toxic"].to_numpy() == 1
    w, b = descend([np.asarray(r, np.int64) for r in found["found"]], ratio, is_toxic)
    weights = zero.copy()
    weights[best] = ratio * w
    return Model(weights, b + float(np.log(sizes[1] / sizes[0])))


def toxicity(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from its whole text only.

    Null text counts as empty and scores like the intercept. Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(tuple(vars(model).values()))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        score = Model(*held.value).score
        scores = np.array([score(t) for t in texts(batch, "text")])
        return pa.record_batch([column(batch, "doc_id"), column(batch, "held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), "text", make, f"doc_id {native_id_type(documents)}, held_out boolean, score double, predicted int")


@query("op8_toxicity")
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity(documents, fit(documents, table(spark, sf_dir, "labels")))
