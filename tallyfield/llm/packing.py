"""Harmonic packing of token ids into sequences of a fixed capacity."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm.common import column, native_id_type, slices, small_batches, table, texts
from tallyfield.llm.registry import query
from tallyfield.llm.tokens import default_tokenizer, encoder


#: Bytes of text encoded at once.
TEXT_BYTES = 1 << 20


def cuts(length: int, capacity: int, slack: int) -> list[tuple[int, int]]:
    """Cut a remainder below ``capacity`` into (piece length, class); class k bins take exactly k pieces.

    A piece stays whole if k of it leave at most ``slack`` unused; otherwise the largest capacity // (k + 1) is cut off,
    which fills the bins of class k + 1 up to less than k + 1 ids, and the rest is treated alike.
    """
    out = []
    while length:
        k = capacity // length
        if capacity - k * length <= slack:
            out.append((length, k))
            break
        piece = capacity // (k + 1)
        out.append((piece, k + 1))
        length -= piece
    return out


def pack(documents: DataFrame, capacity: int = 1024, end_id: int = 0, slack: int | None = None, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ``ids`` if asked for.

    Every worker packs the rows of its own partition: full sequences are cut off first, the remainder goes by reciprocal
    class (:func:`cuts`) into bins of a fixed count, and what is left of all classes at the end of the partition is laid end to end, its
    last incomplete sequence cut at powers of two. So there is no shuffle, and a worker holds at most ``capacity`` ids per class.

    Null or empty text: the end id alone. Repeated rows are packed each for itself. An empty table gives no rows. Sequence ids are the
    partition number shifted by 33 bits plus a count, so they are unique in the result; other columns of the input are not read.
    """
    small_batches(documents.sparkSession)
    path = tokenizer or default_tokenizer()
    spare = capacity // 64 if slack is None else slack
    kind = native_id_type(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        first_id = TaskContext.get().partitionId() << 33
        made = 0
        waiting: dict[int, list[tuple]] = defaultdict(list)
        known = [cuts(n, capacity, spare) for n in range(capacity)]
        rows: list[tuple] = []
        doc_type = None

        def emit(sequence: list[tuple]) -> None:
            nonlocal made
            at = 0
            for doc, start, ids, total in sequence:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, first_id + made, at, ids.tobytes() if with_ids else None))
                at += len(ids)
            made += 1

        def flush() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in range(8)]
            rows.clear()
            types = [doc_type, *[pa.int64()] * 6, pa.binary()]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
            n = 8 if with_ids else 7
            return pa.record_batch([pa.array(c, t) for c, t in zip(columns[:n], types[:n], strict=True)], names[:n])

        for batch in slices(batches, "text", TEXT_BYTES):
            ids_column = column(batch, "doc_id")
            doc_type = ids_column.type
            for doc, ids in zip(ids_column.to_pylist(), tokens.encode(texts(batch, "text")), strict=True):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                total, at = len(ids), 0
                for at in range(0, total - capacity + 1, capacity):
                    emit([(doc, at, ids[at : at + capacity], total)])
                at = total - total % capacity
                for length, k in known[total % capacity]:
                    bin_ = waiting[k]
                    bin_.append((doc, at, ids[at : at + length].copy(), total))  # a view would hold the whole document's ids
                    at += length
                    if len(bin_) == k:
                        emit(bin_)
                        waiting[k] = []
            yield flush()
        left = sum(len(p[2]) for k in waiting for p in waiting[k])
        sizes = [capacity] * (left // capacity) + [1 << b for b in range(capacity.bit_length(), -1, -1) if (left % capacity) >> b & 1]
        pieces = iter([p for k in sorted(waiting) for p in waiting[k]])
        piece = next(pieces, None)
        for size in sizes:
            sequence, room = [], size
            while room:
                doc, start, ids, total = piece
                sequence.append((doc, start, ids[:room], total))
                taken = min(room, len(ids))
                room -= taken
                piece = (doc, start + taken, ids[taken:], total) if taken < len(ids) else next(pieces, None)
            emit(sequence)
        if rows:
            yield flush()

    extra = ", ids binary" if with_ids else ""
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{extra}"
    return documents.select("doc_id", "text").mapInArrow(run, schema)


@query("op2_packing")
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
