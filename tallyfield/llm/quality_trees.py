"""Document quality by histogram gradient-boosted trees over document statistics, flattened for vectorised traversal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import WHITE_BYTES, column, mapped, mix, native_id_type, table, utf8, word_hashes, separators
from tallyfield.llm.registry import query

#: Labelled documents per class on which the trees are grown, those with the least hash of their id.
SAMPLE = 8000
#: Trees, levels of each, and bins per statistic (cut at quantiles of the sample).
TREES, DEPTH, BINS = 80, 4, 64
RATE, PENALTY, LEAST_WEIGHT = 0.15, 1.0, 5.0
#: Bytes of one text handled at once; longer texts are read in windows that end at white space.
WINDOW_BYTES = 2 << 20

SYMBOLS, ENDS, COMMAS = b"#*$%&|<>", b".!?", b",;:"
#: What is counted in bytes: one flag per byte value.
CLASSES = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": bytes(range(48, 58)), "symbol": SYMBOLS, "end": ENDS, "comma": COMMAS,
    "white": WHITE_BYTES, "newline": b"\n", "continued": bytes(range(128, 192)), "leading": bytes(range(192, 256)), "control": bytes([*range(0, 9), *range(14, 32), 127]),
}
STATISTICS = [
    "log_points", "log_words", "log_lines", "word_points", "longest_word", "lower", "upper", "digit", "symbol", "end_per_word", "comma_per_word", "white", "beyond_ascii",
    "control", "points_per_line", "distinct_words", "top_word", "same_as_previous", "distinct_triples", "top_triple", "repeated_lines", "symbol_words", "capital_words",
]


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 = 1; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def _windows(text: bytes) -> list[bytes]:
    out, at = [], 0
    while len(text) - at > WINDOW_BYTES:
        cuts = [text.rfind(bytes([b]), at + 1, at + WINDOW_BYTES) for b in WHITE_BYTES]
        to = max(cuts) if max(cuts) > at else at + WINDOW_BYTES  # a word longer than a window is cut
        out.append(text[at:to])
        at = to
    return [*out, text[at:]]


def _read(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Per text: counts of byte classes, and the bounds of its words; per word: hash, line break before it, code points, a flag for symbols and for a capital."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    table_ = np.zeros((len(CLASSES), 256), bool)
    for row, values in zip(table_, CLASSES.values(), strict=True):
        row[list(values)] = True
    counts = np.stack([np.add.reduceat(row[joined], starts, dtype=np.int64) for row in table_], axis=1)
    names = list(CLASSES)
    counts[:, [names.index("newline"), names.index("white")]] -= 1  # the byte that joins texts
    split = separators()
    hashes, begin_of = word_hashes(texts, split)
    gap = np.concatenate(([True], split[joined], [True]))
    begin = np.flatnonzero(gap[:-1] & ~gap[1:])
    end = np.flatnonzero(~gap[:-1] & gap[1:])
    lines = np.cumsum(joined == 10)
    line = lines[begin] if len(begin) else np.zeros(0, np.int64)
    points = np.concatenate(([0], np.cumsum((joined & 0xC0) != 0x80)))
    symbols = np.concatenate(([0], np.cumsum(table_[names.index("symbol")][joined])))
    capital = table_[names.index("upper")][joined[begin]] if len(begin) else np.zeros(0, bool)
    return counts, begin_of, hashes, line, points[end] - points[begin], symbols[end] > symbols[begin], capital


def _repeats(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per owner: number of keys, of distinct keys, and the largest number of equal ones."""
    total = np.bincount(owner, minlength=n)
    if not len(keys):
        return total, total, total
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]) | (o[1:] != o[:-1]))))
    times = np.diff(np.append(first, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, o[first], times)
    return total, np.bincount(o[first], minlength=n), most


def statistics(texts: list[bytes]) -> np.ndarray:
    """(text, statistic), from the whole texts; an empty text has zeros throughout."""
    if len(texts) == 1 and len(texts[0]) > WINDOW_BYTES:
        reads = []
        breaks = 0
        for window in _windows(texts[0]):
            counts, _, hashes, line, points, symbol, capital = _read([window])
            reads.append((counts, hashes, line + breaks, points, symbol, capital))
            breaks += window.count(b"\n")
        counts = sum(r[0] for r in reads)
        hashes, line, points, symbol, capital = (np.concatenate([r[i] for r in reads]) for i in range(1, 6))
        begin = np.array([0, len(hashes)])
    else:
        counts, begin, hashes, line, points, symbol, capital = _read(texts)
    n = len(texts)
    size = np.array([len(t) for t in texts])
    owner = np.repeat(np.arange(n), np.diff(begin))
    at = dict(zip(CLASSES, counts.T, strict=True))
    code_points = size - at["continued"]
    words, distinct, top = _repeats(hashes, owner, n)
    near = owner[1:] == owner[:-1]
    same = np.bincount(owner[1:][near & (hashes[1:] == hashes[:-1])], minlength=n)
    triple = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
    keys = mix(hashes[:-2] * np.uint64(3) + mix(hashes[1:-1]) * np.uint64(5) + hashes[2:])[triple] if len(owner) > 2 else np.zeros(0, np.uint64)
    triples, distinct_triples, top_triple = _repeats(keys, owner[2:][triple] if len(owner) > 2 else owner[:0], n)
    new_line = np.concatenate(([True], (line[1:] != line[:-1]) | ~near)) if len(owner) else np.zeros(0, bool)
    lines_at = np.flatnonzero(new_line)
    place = np.arange(len(hashes)) - np.repeat(lines_at, np.diff(np.append(lines_at, len(hashes)))) if len(hashes) else np.zeros(0, np.int64)
    line_keys = np.add.reduceat(mix(hashes + mix(place.astype(np.uint64) + np.uint64(1))), lines_at) if len(lines_at) else np.zeros(0, np.uint64)
    lines, distinct_lines, _ = _repeats(line_keys, owner[lines_at], n)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, owner, points)
    word_points = np.bincount(owner, points, n)

    def per(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(b > 0, a / np.maximum(b, 1), 0.0)

    beyond = at["leading"]
    return np.stack([
        np.log1p(code_points), np.log1p(words), np.log1p(lines), per(word_points, words), np.log1p(longest), per(at["lower"], code_points), per(at["upper"], code_points),
        per(at["digit"], code_points), per(at["symbol"], code_points), per(at["end"], words), per(at["comma"], words), per(at["white"], code_points), per(beyond, code_points),
        per(at["control"], code_points), np.log1p(per(code_points, np.maximum(1, lines))), per(distinct, words), per(top, words), per(same, words), per(distinct_triples, triples),
        per(top_triple, triples), per(lines - distinct_lines, lines), per(np.bincount(owner, symbol, n), words), per(np.bincount(owner, capital, n), words),
    ], axis=1)


@dataclass
class Forest:
    """Complete trees in arrays: node k of a tree leads to 2k + 1 (statistic <= threshold) and 2k + 2; ``leaves`` hold log-odds. A node that does
    not split has an infinite threshold."""

    intercept: float
    feature: np.ndarray
    threshold: np.ndarray
    leaves: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees at once, one level a step."""
        out = np.full(len(x), self.intercept)
        if not len(self.leaves):
            return out
        trees = np.arange(len(self.leaves))
        inner = self.feature.shape[1]
        depth = (inner + 1).bit_length() - 1
        for a in range(0, len(x), 4096):
            rows = x[a : a + 4096]
            node = np.zeros((len(rows), len(trees)), np.int64)
            for _ in range(depth):
                goes = rows[np.arange(len(rows))[:, None], self.feature[trees, node]] > self.threshold[trees, node]
                node = 2 * node + 1 + goes
            out[a : a + 4096] += self.leaves[trees, node - inner].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -500, 500)))


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS) -> Forest:
    """Boosted trees on logistic loss. Statistics are cut into bins once; every level of a tree is split from one histogram of gradients over
    (node, statistic, bin), and the best cut of each node is taken by gain. Equal gains: the first statistic, the lowest cut."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    cut_at = np.full((width, bins), np.inf)
    for f, e in enumerate(edges):
        cut_at[f, : len(e)] = e
    share = float((weight * y).sum() / weight.sum())
    intercept = float(np.log(share / (1 - share)))
    margin = np.full(n, intercept)
    inner = (1 << depth) - 1
    feature, threshold, leaves = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    cell = (np.arange(width) * bins)[None, :] + binned
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes = 1 << level
            flat = (node[:, None] * (width * bins) + cell).ravel()
            shape = (nodes, width, bins)
            g = np.bincount(flat, np.repeat(gradient, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            h = np.bincount(flat, np.repeat(curve, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            m = np.bincount(flat, np.repeat(weight, width), nodes * width * bins).reshape(shape).cumsum(axis=2)
            g_all, h_all, m_all = g[:, :, -1:], h[:, :, -1:], m[:, :, -1:]
            gain = g**2 / (h + PENALTY) + (g_all - g) ** 2 / (h_all - h + PENALTY) - g_all**2 / (h_all + PENALTY)
            gain[(m < LEAST_WEIGHT) | (m_all - m < LEAST_WEIGHT) | ~np.isfinite(cut_at)[None]] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            f, b = best // bins, best % bins
            splits = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            first = nodes - 1
            feature[t, first : first + nodes] = np.where(splits, f, 0)
            threshold[t, first : first + nodes] = np.where(splits, cut_at[f, b], np.inf)
            node = 2 * node + (splits[node] & (binned[np.arange(n), f[node]] > b[node]))
        g = np.bincount(node, gradient, inner + 1)
        h = np.bincount(node, curve, inner + 1)
        leaves[t] = -RATE * g / (h + PENALTY)
        margin += leaves[t][node]
    return Forest(intercept, feature, threshold, leaves)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """Grow the trees on at most ``sample`` labelled documents per class whose id is not held out; a document with several labels takes the lowest.

    The sample's ids (bounded by the parameter) are broadcast to find its texts, and only statistics reach the driver, one row per id: of rows that
    share an id, the least statistics. Each class weighs as in all labels. Without rows of both classes the score is constant.
    """
    marked = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sizes = {r["quality"]: r["n"] for r in marked.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    none = (np.zeros((0, 1), np.int64), np.zeros((0, 1)), np.zeros((0, 2)))
    constant = Forest({0: -5.0, 1: 5.0}.get(next(iter(sizes), -1), 0.0), *none)
    if len(sizes) < 2:
        return constant
    zero, one = (marked.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for q in (0, 1))
    chosen = documents.select("doc_id", "text").join(F.broadcast(zero.union(one)), "doc_id").select("doc_id", "quality", "text")

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(utf8(batch, "text"))
        return pa.record_batch([column(batch, "doc_id"), column(batch, "quality").cast(pa.int32()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = mapped(chosen, "text", make, f"doc_id {native_id_type(documents)}, quality int, x array<double>").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id").toPandas()
    y = rows["quality"].to_numpy()
    if len(set(y.tolist())) < 2:
        return constant
    weight = np.where(y == 1, sizes[1] / (y == 1).sum(), sizes[0] / (y == 0).sum())
    return grow(np.stack(rows["x"].to_list()), y, weight * len(y) / weight.sum())


def quality(documents: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, from statistics of its whole text.

    Null text counts as empty. Repeated rows give repeated results, an empty table none; other columns are not read.
    """
    held = documents.sparkSession.sparkContext.broadcast(tuple(vars(forest).values()))

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        scores = Forest(*held.value).score(statistics(utf8(batch, "text")))
        return pa.record_batch([column(batch, "doc_id"), column(batch, "held_out"), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return mapped(documents.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), "text", make, f"doc_id {native_id_type(documents)}, held_out boolean, score double, predicted int")


@query("op12_quality")
def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality(documents, fit(documents, table(spark, sf_dir, "labels")))
