"""A positional inverted index of documents, and exact phrase and proximity search for benchmark texts in it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm.common import column, lower_table, native_id_type, separators, slices, table, utf8, word_hashes
from tallyfield.llm.registry import query
from tallyfield.session import scratch_path

WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
#: Benchmark items held by a task at a time; a larger benchmark is searched in several passes over the index.
ITEMS_A_PASS = 50_000


def words_of(docs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lower = lower_table()
    return word_hashes([d.translate(lower) for d in docs], separators(WORD_BYTES))


def build_index(documents: DataFrame, folder: str) -> None:
    """Write one row per index block: its documents, and for each term the sorted positions of its tokens in the block.

    A block holds the documents of about 4 MB of text, or one longer document, so a term of any frequency is spread over the blocks and no
    shuffle gathers it. Null text has no words; repeated rows are separate documents; an empty table gives an empty index.
    """
    kind = native_id_type(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 33
        for batch in slices(batches, "text"):
            words, begin = words_of(utf8(batch, "text"))
            order = np.argsort(words, kind="stable")
            ordered = words[order]
            first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(words) else np.zeros(0, np.int64)
            docs = column(batch, "doc_id")
            row = [pa.array([made]), pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), *[pa.array([x.tobytes()], pa.binary()) for x in (begin.astype("<i8"), ordered[first], np.append(first, len(words)).astype("<u4"), order.astype("<u4"))]]
            made += 1
            yield pa.record_batch(row, ["block", "doc_ids", "doc_begin", "terms", "term_begin", "positions"])

    schema = f"block long, doc_ids array<{kind}>, doc_begin binary, terms binary, term_begin binary, positions binary"
    documents.select("doc_id", "text").mapInArrow(run, schema).write.parquet(folder)


class Windows:
    """Distinct word windows of a set of items, as positions in the list of distinct terms."""

    def __init__(self, items: list[tuple[str, bytes]], size: int):
        words, begin = words_of([text for _, text in items])
        self.terms, which = np.unique(words, return_inverse=True)
        self.windows: list[np.ndarray] = []
        self.items: list[set[str]] = []
        seen: dict[bytes, int] = {}
        for (item, _), a, b in zip(items, begin[:-1].tolist(), begin[1:].tolist(), strict=True):
            if a == b:
                continue
            length = min(size, b - a)
            for at in range(a, b - length + 1):
                terms = which[at : at + length]
                key = terms.tobytes()
                if key not in seen:
                    seen[key] = len(self.windows)
                    self.windows.append(terms)
                    self.items.append(set())
                self.items[seen[key]].add(item)


class Block:
    """An index block in memory, with the postings of the searched terms."""

    def __init__(self, row: dict, terms: np.ndarray):
        self.doc_ids = row["doc_ids"]
        self.begin = np.frombuffer(row["doc_begin"], "<i8")
        self.positions = np.frombuffer(row["positions"], "<u4")
        own, ends = np.frombuffer(row["terms"], "<u8"), np.frombuffer(row["term_begin"], "<u4").astype(np.int64)
        at = np.minimum(np.searchsorted(own, terms), max(len(own) - 1, 0))
        found = own[at] == terms if len(own) else np.zeros(len(terms), bool)
        self.low = np.where(found, ends[at] if len(own) else 0, 0)
        self.high = np.where(found, ends[at + 1] if len(own) else 0, 0)
        self.count = self.high - self.low

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.low[term] : self.high[term]].astype(np.int64)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begin, position, side="right") - 1

    def phrase(self, terms: np.ndarray) -> np.ndarray:
        """Start positions of the exact phrase: offset-adjusted lists intersected from the rarest term on."""
        counts = self.count[terms]
        order = np.argsort(counts, kind="stable")
        if counts[order[0]] == 0:
            return np.zeros(0, np.int64)
        starts = self.postings(terms[order[0]]) - order[0]
        for i in order[1:]:
            if not len(starts):
                return starts
            there = self.positions[self.low[terms[i]] : self.high[terms[i]]]
            wanted = starts + i
            at = np.minimum(np.searchsorted(there, wanted), len(there) - 1)
            starts = starts[there[at] == wanted]
        starts = starts[starts >= 0]
        return starts[self.begin[self.document(starts) + 1] >= starts + len(terms)] if len(starts) else starts

    def near(self, terms: np.ndarray, span: int) -> np.ndarray:
        """Documents (by place in the block) with all distinct terms within ``span`` consecutive words."""
        distinct = np.unique(terms)
        order = distinct[np.argsort(self.count[distinct], kind="stable")]
        anchors = self.postings(order[0])
        for t in order[1:]:
            there = self.postings(t)
            anchors = anchors[np.searchsorted(there, anchors + span) > np.searchsorted(there, anchors - span + 1)]
            if not len(anchors):
                break
        found = []
        for a in anchors.tolist():
            doc = int(self.document(np.array([a]))[0])
            low, high = max(a - span + 1, int(self.begin[doc])), min(a + span, int(self.begin[doc + 1]))
            marks = []
            for t in order.tolist():
                there = self.postings(t)
                marks += [(p, t) for p in there[np.searchsorted(there, low) : np.searchsorted(there, high)].tolist()]
            marks.sort()
            last: dict[int, int] = {}
            for p, t in marks:
                last[t] = p
                if len(last) == len(order) and p - min(last.values()) < span:
                    found.append(doc)
                    break
        return np.unique(np.array(found, np.int64))


def passes(benchmark: DataFrame, size: int, items_a_pass: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in lists of bounded length, each item whole; ids as text, a null id as empty text. Repeated rows count once."""
    rows = benchmark.selectExpr("coalesce(cast(item_id as string), '') as item", "coalesce(text, '') as text").distinct()
    n = max(1, -(-rows.count() // items_a_pass))
    for k in range(n):
        part = rows if n == 1 else rows.where(f"pmod(xxhash64(item), {n}) = {k}")
        yield sorted((r["item"], r["text"].encode()) for r in part.toLocalIterator())


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in slices(batches, "positions"):
        for i in range(batch.num_rows):
            yield {name: column(batch, name)[i].as_py() if name != "doc_ids" else column(batch, name)[i].values for name in batch.schema.names}


def contamination(spark: SparkSession, folder: str, benchmark: DataFrame, size: int = WINDOW, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """One row per indexed document: doc_id, n_words, n_hit, items (sorted ids whose windows occur), contaminated.

    An item's windows are its runs of ``size`` words, or all of a shorter item; a word inside any occurrence is hit. An item without words and an
    empty benchmark hit nothing. A benchmark above ``items_a_pass`` is searched in several passes whose marks are merged per document.
    """
    index = spark.read.parquet(folder)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    def searched(items: list[tuple[str, bytes]]) -> DataFrame:
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            windows = Windows(held.value, size)
            for row in _rows(batches):
                block = Block(row, windows.terms)
                n_words = int(block.begin[-1])
                edges = np.zeros(n_words + 1, np.int32)
                items_of: list[set[str]] = [set() for _ in range(len(block.doc_ids))]
                present = block.count > 0
                for terms, names in zip(windows.windows, windows.items, strict=True):
                    if not present[terms].all():
                        continue
                    starts = block.phrase(terms)
                    if len(starts):
                        np.add.at(edges, starts, 1)
                        np.add.at(edges, starts + len(terms), -1)
                        for doc in np.unique(block.document(starts)).tolist():
                            items_of[doc] |= names
                hit = np.cumsum(edges[:-1]) > 0
                total = np.concatenate(([0], np.cumsum(hit)))
                n = np.diff(block.begin)
                n_hit = total[block.begin[1:]] - total[block.begin[:-1]]
                marks = [np.packbits(hit[a:b]).tobytes() if h else b"" for a, b, h in zip(block.begin[:-1], block.begin[1:], n_hit, strict=True)]
                items = [sorted(x) for x in items_of]
                yield pa.record_batch([pa.array([row["block"]] * len(n)), pa.array(np.arange(len(n))), block.doc_ids, pa.array(n), pa.array(n_hit.astype(np.int64)), pa.array(items, pa.list_(pa.string())), pa.array(marks, pa.binary())], ["block", "place", "doc_id", "n_words", "n_hit", "items", "marks"])

        return index.mapInArrow(run, f"block long, place long, doc_id {kind}, n_words long, n_hit long, items array<string>, marks binary")

    found = [searched(items) for items in passes(benchmark, size, items_a_pass)]
    out = found[0]
    if len(found) > 1:

        def merge(pdf):
            marks = [np.unpackbits(np.frombuffer(m, np.uint8)) for m in pdf["marks"] if m]
            items = sorted({i for x in pdf["items"] for i in x})
            return pdf.head(1).assign(n_hit=int(np.maximum.reduce(marks).sum()) if marks else 0, items=[items], marks=[b""])

        for more in found[1:]:
            out = out.unionByName(more)
        out = out.groupBy("block", "place").applyInPandas(merge, out.schema)
    return out.selectExpr("doc_id", "n_words", "n_hit", "items", "n_hit > 0 as contaminated")


def near_matches(spark: SparkSession, folder: str, benchmark: DataFrame, span: int = 20, size: int = WINDOW, items_a_pass: int = ITEMS_A_PASS) -> DataFrame:
    """(doc_id, item_id, windows): how many of an item's windows have all their words, in any order, within ``span`` words of a document."""
    index = spark.read.parquet(folder)
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()
    out = None
    for items in passes(benchmark, size, items_a_pass):
        held = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            windows = Windows(held.value, size)
            for row in _rows(batches):
                block = Block(row, windows.terms)
                ids = block.doc_ids.to_pylist()
                counts: dict[tuple, int] = {}
                present = block.count > 0
                for terms, names in zip(windows.windows, windows.items, strict=True):
                    if present[terms].all():
                        for doc in block.near(terms, span).tolist():
                            for name in names:
                                counts[doc, name] = counts.get((doc, name), 0) + 1
                if counts:
                    yield pa.record_batch([pa.array([ids[d] for d, _ in counts], block.doc_ids.type), pa.array([n for _, n in counts]), pa.array(list(counts.values()), pa.int64())], ["doc_id", "item_id", "windows"])

        part = index.select("block", "doc_ids", "doc_begin", "terms", "term_begin", "positions").mapInArrow(run, f"doc_id {kind}, item_id string, windows long")
        out = part if out is None else out.unionByName(part)
    return out


@query("op10_phrases")
def op10_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "phrase-index")
    build_index(table(spark, sf_dir, "documents"), folder)
    found = contamination(spark, folder, table(spark, sf_dir, "benchmark"))
    return found.selectExpr("doc_id", "n_words", "n_hit", "cast(size(items) as long) as n_items", "sha2(array_join(items, ','), 256) as items_sha256", "contaminated")
