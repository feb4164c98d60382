"""Ranked lexical search over hashed max-sketches: bounds for all documents at once, exact scores down the bounds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyfield.llm.common import column, native_id_type, separators, slices, table, utf8, word_hashes
from tallyfield.llm.registry import query
from tallyfield.session import scratch_path

TOP = 50
#: A sketch has at least so many coordinates per distinct term of its document, rounded up to a power of two. More make tighter bounds.
WIDTH = 2
#: Coordinates hold counts up to here; the last value stands for itself and everything above.
MOST = 255
#: No impact reaches this, however often a term occurs.
IMPACT_LIMIT = 1_000_000
#: Queries are looked up in blocks of so many items and bytes of text at most (one longer item is a block of its own).
ITEMS_A_BLOCK, BYTES_A_BLOCK = 512, 1 << 20
#: Entries of the matrix (query term, document) held at once, and documents whose bounds are held at once.
LOOKUP, DOCUMENTS = 1 << 21, 4096
#: Distinct terms a task counts before it writes its counts out; a term may then have several counts, which are summed.
TERMS_A_TASK = 400_000
#: Texts above this are cut into windows, at a separator.
WINDOW_BYTES = 8 << 20

WORD_BYTES = bytes([*range(48, 58), *range(65, 91), *range(97, 123)])
#: A-Z to lower case, every other ASCII byte that is no letter or digit to a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b in WORD_BYTES or b > 127 else 32 for b in range(256))


def term_hashes(terms: list[bytes]) -> np.ndarray:
    """64-bit hashes of terms (without spaces); they choose coordinates only, so equal ones loosen a bound and change no result."""
    return word_hashes(terms, separators())[0]


def _split(plain: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """(document, term) of every term occurrence, in order."""
    data = b"".join(plain)
    offsets = np.concatenate(([0], np.cumsum([len(p) for p in plain], dtype=np.int64)))
    cut = pc.ascii_split_whitespace(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(plain), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).view(pa.large_string()))
    values = cut.values
    owner = np.repeat(np.arange(len(plain)), np.diff(cut.offsets.to_numpy()))
    filled = pc.greater(pc.binary_length(values), 0)
    return owner[filled.to_numpy(zero_copy_only=False)], values.filter(filled)


def _windows(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        to = at + WINDOW_BYTES
        to = len(text) if to >= len(text) else text.find(b" ", to)
        to = len(text) if to < 0 else to
        yield text[at:to]
        at = to


def counted(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(document, term, times, terms): the distinct terms of every document with their counts, ordered by document; ``term`` points into ``terms``."""
    owners, parts = [], []
    for group in [[t.translate(PLAIN) for t in texts]] if len(texts) != 1 else [[w] for w in _windows(texts[0].translate(PLAIN))]:
        owner, values = _split(group)
        coded = values.dictionary_encode()
        keys, times = np.unique(owner * max(1, len(coded.dictionary)) + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
        owners.append((keys // max(1, len(coded.dictionary)), times))
        parts.append(coded.dictionary.take(pa.array(keys % max(1, len(coded.dictionary)))))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), []
    coded = pa.chunked_array(parts).combine_chunks().dictionary_encode()
    doc, term = np.concatenate([o for o, _ in owners]), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    times = np.concatenate([t for _, t in owners])
    if len(parts) > 1:  # windows of one text
        times = np.bincount(term, times, len(coded.dictionary)).astype(np.int64)
        term = np.arange(len(times))
        doc = np.zeros(len(times), np.int64)
    return doc, term, times, coded.dictionary.cast(pa.large_binary()).to_pylist()


def widths(distinct: np.ndarray) -> np.ndarray:
    return 1 << np.maximum(4, np.ceil(np.log2(np.maximum(1, WIDTH * distinct)))).astype(np.int64)


def impacts(times: np.ndarray, length_norm: np.ndarray) -> np.ndarray:
    times = times.astype(np.int64)
    return (1_000_000_000 * times) // np.maximum(1, 1000 * times + 20 * length_norm)


def build_index(documents: DataFrame, folder: str) -> None:
    """Write one row per document that has terms, and rows of document frequencies, one per task as a rule.

    A document's row: its number of terms, its distinct terms with their counts, and its sketch. A sketch folds the terms into coordinates by
    their hash and keeps the greatest count of each. In one document an impact rises with the count, so the greatest count of a coordinate gives its
    greatest impact; corpus totals are not needed for it and an index may grow by further parts.
    """
    kind = native_id_type(documents)
    schema = f"kind int, doc_id {kind}, n long, docs long, sketch binary, terms string, times binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, int] = {}
        total = docs = 0
        id_type = None

        def statistics() -> pa.RecordBatch:
            row = [1, None, total, docs, None, b" ".join(held).decode(), np.fromiter(held.values(), "<i8", len(held)).tobytes()]
            types = [pa.int32(), id_type, pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.binary()]
            return pa.record_batch([pa.array([v], t) for v, t in zip(row, types, strict=True)], NAMES)

        for batch in slices(batches, "text"):
            ids = column(batch, "doc_id")
            id_type = ids.type
            doc, term, times, terms = counted(utf8(batch, "text"))
            if not len(doc):
                continue
            for t, n in zip(terms, np.bincount(term, minlength=len(terms)).tolist(), strict=True):
                held[t] = held.get(t, 0) + n
            at = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            ends = np.append(at[1:], len(doc))
            lengths = np.add.reduceat(times, at)
            total, docs = total + int(lengths.sum()), docs + len(at)
            width = widths(ends - at)
            begin = np.cumsum(width) - width
            flat = np.zeros(int(width.sum()), np.uint8)
            hashes = term_hashes(terms)[term]
            place = np.repeat(begin, ends - at) + (hashes & np.repeat(width - 1, ends - at).astype(np.uint64)).astype(np.int64)
            np.maximum.at(flat, place, np.minimum(times, MOST).astype(np.uint8))
            blob, named, counts = flat.tobytes(), [terms[t] for t in term.tolist()], times.astype("<u4")
            yield pa.record_batch([
                pa.array(np.zeros(len(at), np.int32)), ids.take(pa.array(doc[at])), pa.array(lengths.astype(np.int64)), pa.nulls(len(at), pa.int64()),
                pa.array([blob[b : b + w] for b, w in zip(begin.tolist(), width.tolist(), strict=True)], pa.binary()),
                pa.array([b" ".join(named[a:b]).decode() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.string()),
                pa.array([counts[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist(), strict=True)], pa.binary()),
            ], NAMES)
            if len(held) > TERMS_A_TASK:
                yield statistics()
                held.clear()
                total = docs = 0
        if held:
            yield statistics()

    NAMES = ["kind", "doc_id", "n", "docs", "sketch", "terms", "times"]
    documents.select("doc_id", "text").mapInArrow(run, schema).write.parquet(folder)


def item_blocks(items: DataFrame) -> Iterator[list[tuple[int, object, list[bytes]]]]:
    """(number, item_id, distinct terms) of all items, in blocks of bounded number and bytes. Each row is a query of its own."""
    block, size = [], 0
    for number, row in enumerate(items.select("item_id", "text").toLocalIterator()):
        text = (row["text"] or "").encode()
        if block and (len(block) == ITEMS_A_BLOCK or size + len(text) > BYTES_A_BLOCK):
            yield block
            block, size = [], 0
        terms = sorted(counted([text])[3])
        if terms:
            block.append((number, row["item_id"], terms))
            size += len(text)
    if block:
        yield block


class Lookup:
    """Queries as pointers into their sorted distinct terms, with whole-number weights."""

    def __init__(self, items: list[list[bytes]], weights: dict[bytes, int]):
        self.terms = sorted({t for terms in items for t in terms})
        place = {t: i for i, t in enumerate(self.terms)}
        self.items = [np.array([place[t] for t in terms], np.int64) for terms in items]
        self.weights = np.array([weights.get(t, 0) for t in self.terms], np.int64)
        self.hashes = term_hashes(self.terms)
        self.known = pa.array(self.terms, pa.large_binary())

    def bounds(self, sketches: list[bytes], norm: np.ndarray) -> np.ndarray:
        """(item, document): no score is above its bound. All numbers are whole and below 2**53."""
        out = np.zeros((len(self.items), len(sketches)))
        size = np.array([len(s) for s in sketches])
        step = max(1, LOOKUP // max(1, len(self.terms)))
        for width in np.unique(size).tolist():
            same = np.flatnonzero(size == width)
            at = (self.hashes & np.uint64(width - 1)).astype(np.int64)
            for a in range(0, len(same), step):
                docs = same[a : a + step]
                folded = np.frombuffer(b"".join([sketches[d] for d in docs.tolist()]), np.uint8).reshape(len(docs), width)
                most = np.where(folded == MOST, IMPACT_LIMIT, impacts(folded, norm[docs][:, None]))
                looked = np.ascontiguousarray(most.T)[at] * self.weights[:, None].astype(np.float64)
                for i, terms in enumerate(self.items):
                    out[i, docs] = looked[terms].sum(axis=0)
        return out

    def postings(self, terms: pa.Array, times: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys document * number of terms + term, and counts, of the query terms in the given rows of the index."""
        cut = pc.split_pattern(terms.cast(pa.large_string()), " ")
        coded = cut.values.dictionary_encode()
        where = pc.fill_null(pc.index_in(coded.dictionary.cast(pa.large_binary()), self.known), -1).to_numpy(zero_copy_only=False)
        term = where[coded.indices.to_numpy(zero_copy_only=False)].astype(np.int64)
        owner = np.repeat(np.arange(len(terms)), np.diff(cut.offsets.to_numpy()))
        hit = term >= 0
        keys = owner[hit] * len(self.terms) + term[hit]
        order = np.argsort(keys)
        return keys[order], np.frombuffer(b"".join(times), "<u4")[hit][order].astype(np.int64)

    def exact(self, item: np.ndarray, doc: np.ndarray, norm: np.ndarray, postings: tuple[np.ndarray, np.ndarray], place: np.ndarray) -> np.ndarray:
        """Scores of (item, document) pairs; ``place`` leads from a document to its row in ``postings``."""
        keys, times = postings
        sizes = np.array([len(t) for t in self.items])[item]
        wanted = np.concatenate([self.items[i] for i in item.tolist()])
        owner = np.repeat(np.arange(len(item)), sizes)
        key = place[doc][owner] * len(self.terms) + wanted
        at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
        found = keys[at] == key if len(keys) else np.zeros(len(key), bool)
        part = np.zeros(len(key), np.int64)
        part[found] = self.weights[wanted[found]] * impacts(times[at[found]], norm[doc][owner[found]])
        score = np.zeros(len(item), np.int64)
        np.add.at(score, owner, part)
        return score


class Best:
    """The ``top`` highest (score, then least id) of every item seen so far; a null id comes first among equal scores."""

    def __init__(self, items: int, top: int, ids: pa.DataType):
        self.top = top
        self.rows = pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], ids)], ["item", "score", "doc_id"])
        self.least = np.ones(items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        keep = score >= self.least[item]
        if not keep.any():
            return
        more = pa.table([pa.array(item[keep]), pa.array(score[keep]), ids.filter(pa.array(keep))], self.rows.column_names)
        rows = pa.concat_tables([self.rows, more])
        rows = rows.take(pc.sort_indices(rows, [("item", "ascending"), ("score", "descending"), ("doc_id", "ascending")], null_placement="at_start"))
        items = rows["item"].to_numpy()
        rank = np.arange(len(items)) - np.searchsorted(items, items)
        kept = rank < self.top
        self.rows = rows.filter(pa.array(kept)).combine_chunks()
        full = rank == self.top - 1
        self.least[items[full]] = rows["score"].to_numpy()[full]


def search_block(lookup: Lookup, best: Best, batch: pa.RecordBatch, norm: np.ndarray) -> None:
    """Rescore a slice of the index in rounds down the bounds; an item ends where its next bound is below its threshold."""
    ids, terms, times = column(batch, "doc_id"), column(batch, "terms"), column(batch, "times")
    bounds = lookup.bounds(column(batch, "sketch").to_pylist(), norm)
    n = bounds.shape[1]
    order = np.argsort(-bounds, axis=1, kind="stable")
    falling = np.take_along_axis(bounds, order, axis=1)
    at = np.zeros(len(bounds), np.int64)
    step = best.top
    while True:
        reach = np.array([np.searchsorted(-f, -float(t), side="right") for f, t in zip(falling, best.least.tolist(), strict=True)])
        to = np.minimum(at + step, reach)
        sizes = np.maximum(0, to - at)
        if not sizes.any():
            return
        item = np.repeat(np.arange(len(bounds)), sizes)
        doc = order[item, np.repeat(at, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        rows = np.unique(doc)
        place = np.full(n, -1, np.int64)
        place[rows] = np.arange(len(rows))
        postings = lookup.postings(terms.take(pa.array(rows)), times.take(pa.array(rows)).to_pylist())
        score = lookup.exact(item, doc, norm, postings, place)
        best.add(item, score, ids.take(pa.array(doc)))
        at = np.maximum(at, to)
        step *= 2


def search(spark: SparkSession, folder: str, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``top`` highest-scoring documents above 0 of every item, equal scores by ascending id.

    Every row of ``items`` is a query of its own, a repeated row too; null or empty texts and terms that no document holds give no rows. Every row of the
    index is a document of its own, so copies and repeated ids all rank; a null id comes first among equal scores. An empty index gives no rows. Items are looked up
    in blocks, each in one pass over the index; a task keeps ``top`` rows per item of the block, and those meet by item.
    """
    index = spark.read.parquet(folder)
    kind = index.schema["doc_id"].dataType.simpleString()
    item_kind = items.schema["item_id"].dataType
    totals = index.where("kind = 1").agg(F.sum("docs"), F.sum("n")).first()
    n_docs, n_terms = (int(v or 0) for v in totals)
    out = None
    for block in item_blocks(items):
        wanted = spark.sparkContext.broadcast(sorted({t for _, _, terms in block for t in terms}))

        def frequencies(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            known = pa.array(wanted.value, pa.large_binary())
            for batch in batches:
                for terms, counts in zip(column(batch, "terms").to_pylist(), column(batch, "times").to_pylist(), strict=True):
                    place = pc.index_in(pa.array(terms.encode().split(b" "), pa.large_binary()), known)
                    hit = pc.is_valid(place).to_numpy(zero_copy_only=False)
                    yield pa.record_batch([place.drop_null().cast(pa.int64()), pa.array(np.frombuffer(counts, "<i8")[hit])], ["term", "df"])

        rows = index.where("kind = 1").select("terms", "times").mapInArrow(frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
        weights = {wanted.value[r["term"]]: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * r["df"] + 1))) for r in rows}  # one per query term at most
        held = spark.sparkContext.broadcast(([terms for _, _, terms in block], weights))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            lookup, best = Lookup(*held.value), None
            for batch in slices(batches, "terms"):
                best = best or Best(len(lookup.items), top, column(batch, "doc_id").type)
                norm = 50 + (50 * column(batch, "n").to_numpy() * n_docs) // max(1, n_terms)
                for a in range(0, batch.num_rows, DOCUMENTS):
                    search_block(lookup, best, batch.slice(a, DOCUMENTS), norm[a : a + DOCUMENTS])
            if best:
                yield from best.rows.to_batches()

        found = index.where("kind = 0").select("doc_id", "n", "sketch", "terms", "times").mapInArrow(run, f"item long, score long, doc_id {kind}")
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))).where(F.col("rank") <= top)
        names = spark.createDataFrame([(k, item_id) for k, (_, item_id, _) in enumerate(block)], f"item long, item_id {item_kind.simpleString()}")
        part = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], f"item_id {item_kind.simpleString()}, rank int, doc_id {kind}, score long")


TERMS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT doc_id, t, len(t) AS n FROM (SELECT doc_id, {TERMS_SQL} AS t FROM documents) WHERE len(t) > 0),
totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM d),
q AS (SELECT item_id, unnest(list_distinct({TERMS_SQL})) AS term FROM benchmark),
tf AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, n, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM tf, totals GROUP BY term, docs),
s AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term), totals GROUP BY item_id, doc_id),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""


@query("op11_lexical", SQL)
def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "lexical-index")
    build_index(table(spark, sf_dir, "documents"), folder)
    return search(spark, folder, table(spark, sf_dir, "benchmark"))
