"""Token ids in blocks of canonical, length-limited Huffman code, with bit-offset checkpoints.

A file set is a folder of Parquet parts, one row per block: shard, block, the block's documents with their token counts, the bit
stream, and one bit offset for every ``STEP`` ids. A block decodes by itself from the code lengths alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfield.llm.common import column, native_id_type, slices, table, texts
from tallyfield.llm.registry import query
from tallyfield.llm.tokens import default_tokenizer, encoder
from tallyfield.session import scratch_path

MAX_BITS = 18
STEP = 128
BLOCK_IDS = 1 << 16


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` for the symbols with a positive count (package-merge); 0 for the others."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} symbols do not fit codes of {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages, masks = np.zeros(0), []
    for _ in range(max_bits):
        weights = np.concatenate((leaves, packages))
        rank = np.argsort(weights, kind="stable")
        masks.append(rank < len(leaves))
        weights = weights[rank]
        paired = len(weights) // 2 * 2
        packages = weights[0:paired:2] + weights[1:paired:2]
    bits = np.zeros(len(leaves), np.int64)
    take = 2 * len(leaves) - 2
    for mask in reversed(masks):
        of_leaves = int(mask[:take].sum())
        bits[:of_leaves] += 1
        take = 2 * (take - of_leaves)
    lengths[order] = bits
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, symbol)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    previous = int(lengths[order[0]]) if len(order) else 0
    for length in range(previous, int(lengths.max(initial=0)) + 1):
        code <<= length - previous
        previous = length
        same = order[lengths[order] == length]
        codes[same] = code + np.arange(len(same))
        code += len(same)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Symbol and length for every value of the next ``bits`` bits."""
    bits = max(1, int(lengths.max(initial=1)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = (1 << (bits - lengths[order].astype(np.int64))).astype(np.int64)
    symbols, sizes = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.int64)
    filled = int(spans.sum())
    symbols[:filled] = np.repeat(order, spans)
    sizes[:filled] = np.repeat(lengths[order], spans)
    return symbols, sizes, bits


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, step: int = STEP) -> tuple[bytes, bytes]:
    """The bit stream, and the bit offset of every ``step``-th id as little-endian 32-bit integers."""
    if not len(ids):
        return b"", b""
    sizes = lengths[ids].astype(np.int64)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    word, into = starts >> 6, starts & 63
    value = codes[ids].astype(np.uint64)
    over = into + sizes - 64
    head = np.where(over > 0, value >> np.maximum(over, 0).astype(np.uint64), value << np.maximum(-over, 0).astype(np.uint64))
    n_words = int(ends[-1] - 1 >> 6) + 1
    first = np.flatnonzero(np.diff(word, prepend=-1))
    packed = np.zeros(n_words, np.uint64)
    packed[word[first]] = np.add.reduceat(head, first)
    spill = np.flatnonzero(over > 0)
    packed[word[spill] + 1] |= value[spill] << (64 - over[spill]).astype(np.uint64)
    return packed.astype(">u8").tobytes()[: int(ends[-1] + 7 >> 3)], starts[::step].astype("<u4").tobytes()


def decode_block(payload: bytes, checkpoints: bytes, n: int, decoder: tuple[np.ndarray, np.ndarray, int], step: int = STEP) -> np.ndarray:
    """All lanes between checkpoints advance together, one id a round."""
    if not n:
        return np.zeros(0, np.uint32)
    symbols, sizes, bits = decoder
    raw = np.frombuffer(payload + b"\0" * (8 + step * bits // 8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    at = np.frombuffer(checkpoints, "<u4").astype(np.int64)
    out = np.empty((len(at), step), np.uint32)
    last, drop = len(window) - 1, np.uint32(32 - bits)
    for i in range(step):
        ahead = (window[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> drop
        out[:, i] = symbols[ahead]
        at = at + sizes[ahead]
    return out.reshape(-1)[:n]


def tokenized(documents: DataFrame, folder: str, end_id: int, path: str) -> None:
    """Write (doc_id, ids) in rows of kind "ids" and one count table per task in a row of kind "counts", so texts are encoded once."""
    kind = native_id_type(documents)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = encoder(path)
        counts = np.zeros(len(tokens.spelled_ids), np.int64)
        narrow = len(counts) <= 1 << 16
        doc_type = pa.int64()
        for batch in slices(batches, "text"):
            docs = column(batch, "doc_id")
            doc_type = docs.type
            ids = tokens.encode(texts(batch, "text"))
            flat = np.insert(np.concatenate(ids), np.cumsum([len(x) for x in ids]), end_id)
            counts += np.bincount(flat, minlength=len(counts))
            flat = flat.astype("<u2" if narrow else "<u4")
            ends = np.cumsum([(len(x) + 1) * flat.itemsize for x in ids], dtype=np.int32)
            blobs = pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(np.concatenate(([np.int32(0)], ends))), pa.py_buffer(flat)])
            yield pa.record_batch([docs, blobs, pa.array(["ids"] * len(ids))], ["doc_id", "ids", "kind"])
        yield pa.record_batch([pa.array([None], doc_type), pa.array([counts.astype("<i8").tobytes()], pa.binary()), pa.array(["counts"])], ["doc_id", "ids", "kind"])

    documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids binary, kind string").write.parquet(folder)


def global_counts(counts: DataFrame) -> np.ndarray:
    """Sum of the tasks' count tables; at most one row per id of the vocabulary reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for blob in column(batch, "ids").to_pylist():
                one = np.frombuffer(blob, "<i8")
                total = one.copy() if total is None else total + one
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["id", "n"])

    rows = counts.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(len(rows), np.int64)
    out[rows["id"].to_numpy()] = rows["n"].to_numpy()
    return out


def write_token_files(documents: DataFrame, folder: str, end_id: int = 2, tokenizer: str | None = None, max_bits: int = MAX_BITS, step: int = STEP, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``documents`` in ascending doc_id order to ``folder``/blocks; ``folder``/lengths holds the code lengths by id.

    Null text counts as empty (the end id alone). A null doc_id sorts first; equal ids stay side by side, ordered by their tokens. Blocks hold
    whole documents; a block ends once it has ``block_ids`` ids, so only a longer document makes a longer block. The documents table may be
    empty. Parts are committed by Spark's writer: a lost task is written again, whole.
    """
    spark = documents.sparkSession
    path = tokenizer or default_tokenizer()
    tokenized(documents, f"{folder}/tokens", end_id, path)
    kind = native_id_type(documents)
    written = spark.read.schema(f"doc_id {kind}, ids binary, kind string").parquet(f"{folder}/tokens")
    counts = written.where("kind = 'counts'")
    lengths = code_lengths(global_counts(counts), max_bits)
    wide = len(lengths) > 1 << 16
    spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "id int, bits int").coalesce(1).write.parquet(f"{folder}/lengths")
    ids = written.where("kind = 'ids'").select("doc_id", "ids")
    shipped = lengths.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = np.frombuffer(shipped, np.uint8)
        codes = canonical_codes(sizes)
        shard, made, start = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[np.ndarray] = []
        doc_type = pa.int64()

        def block() -> pa.RecordBatch:
            nonlocal made, start
            payload, marks = encode_block(np.concatenate(held), codes, sizes, step)
            n = [len(x) for x in held]
            row = [pa.array([shard]), pa.array([made]), pa.array([start]), pa.array([docs], pa.list_(doc_type)), pa.array([n], pa.list_(pa.int64())), pa.array([payload], pa.binary()), pa.array([marks], pa.binary())]
            made, start = made + 1, start + sum(n)
            docs.clear()
            held.clear()
            return pa.record_batch(row, ["shard", "block", "start", "doc_ids", "n_tokens", "payload", "checkpoints"])

        waiting = 0
        for batch in slices(batches, "ids"):
            doc_type = column(batch, "doc_id").type
            for doc, blob in zip(column(batch, "doc_id").to_pylist(), column(batch, "ids").to_pylist(), strict=True):
                docs.append(doc)
                held.append(np.frombuffer(blob, "<u4" if wide else "<u2"))
                waiting += len(held[-1])
                if waiting >= block_ids:
                    yield block()
                    waiting = 0
        if docs:
            yield block()

    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = ids.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "ids")
    schema = f"shard long, block long, start long, doc_ids array<{kind}>, n_tokens array<long>, payload binary, checkpoints binary"
    ordered.mapInArrow(run, schema).write.parquet(f"{folder}/blocks")


def read_token_files(spark: SparkSession, folder: str, step: int = STEP, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of every document, decoded block by block from the files."""
    lengths = spark.read.parquet(f"{folder}/lengths").toPandas().sort_values("id")["bits"].to_numpy().astype(np.uint8).tobytes()
    blocks = spark.read.parquet(f"{folder}/blocks")
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    # One row per shard, and a shard is a partition of the writing job: this list is as long as that job had tasks.
    totals = sorted(blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect())
    before, offsets = 0, {}
    for shard, n in totals:
        offsets[shard] = before
        before += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = decode_table(np.frombuffer(lengths, np.uint8))
        for batch in slices(batches, "payload"):
            for row in range(batch.num_rows):
                get = lambda name, r=row, b=batch: column(b, name)[r]
                n = np.array(get("n_tokens").as_py(), np.int64)
                ids = decode_block(get("payload").as_py(), get("checkpoints").as_py(), int(n.sum()), decoder, step).astype("<u4")
                ends = np.cumsum(n)
                starts = ends - n + offsets[get("shard").as_py()] + get("start").as_py()
                own = [x.tobytes() for x in np.split(ids, ends[:-1])]
                columns = [get("doc_ids").values, pa.array(starts), pa.array(n), pa.array([zlib.crc32(x) for x in own], pa.int64())]
                yield pa.record_batch(columns + ([pa.array(own, pa.binary())] if with_ids else []), ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: 5 if with_ids else 4])

    return blocks.mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long{', ids binary' if with_ids else ''}")


@query("op6_token_file")
def op6_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder)
    return read_token_files(spark, folder)
