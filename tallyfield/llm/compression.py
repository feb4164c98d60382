"""Quality rules: counts of a text, and bands of its compression ratio over the whole and over fixed chunks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tallyfield.llm.common import WHITE_BYTES, column, mapped, native_id_type, process_cache, table, utf8, window_hashes
from tallyfield.llm.registry import query

#: Up to so many bytes of UTF-8: least and largest compressed size over raw size. Short texts carry the frame and an
#: untrained window, so their band lies higher and wider. Below the first entry no text is judged. The largest ratios of the documents
#: in sf0.1 are 0.857, 0.698, 0.592, 0.521, 0.478 and 0.437; English manuals and licences, cut to the least length of a row, reach
#: 0.864, 0.756, 0.698, 0.648, 0.552 and 0.409. The limits leave room above both for other scripts, and lie below base64.
BANDS = [(200, 0.0, 9.0), (500, 0.30, 0.90), (1000, 0.24, 0.78), (2000, 0.16, 0.73), (4000, 0.16, 0.68), (16000, 0.10, 0.64), (1 << 62, 0.06, 0.56)]
#: Up to so many bytes: largest compressed size over the entropy of the single bytes. Text in any script has repetitions, so it falls below
#: its bytes' own entropy, hex or random letters never do. The documents in sf0.1 reach 0.98 at 4,096 bytes, 0.94 at 8,192, 0.89 at 20,000.
#: Shorter texts, prose and noise alike, lie above their entropy and are judged by BANDS alone. So are ratios up to ORDINARY, which ordinary
#: text has too: its chunks in sf0.1 reach 0.484, hex starts at 0.50.
OVER_ENTROPY = [(3000, 9.0), (4000, 1.015), (8000, 0.99), (16000, 0.985), (1 << 62, 0.97)]
ORDINARY = 0.49
CHUNK_BYTES = 4096
#: A text is rejected if more than this share of its bytes lies in chunks outside the limits of their length.
CHUNK_SHARE = 0.5
SYMBOLS = b"#*$%&|<>"
LEVEL = 3


def band(size: int, bands: list[tuple]) -> tuple[float, float]:
    return next((low, high) for most, low, high in bands if size <= most)


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of one UTF-8 text."""
    words = text.split()
    continuing = len(text) - len(text.translate(None, bytes(range(128, 192))))
    chars = len(text) - continuing - sum(map(text.count, [bytes([b]) for b in WHITE_BYTES]))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if len(words) >= 3:
        numbers: dict[bytes, int] = {}
        ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
        n = len(numbers)
        keys = (ids[:-2] * np.uint64(n) + ids[1:-1]) * np.uint64(n) + ids[2:] if n < 2_000_000 else window_hashes(ids, 3)
        _, which, times = np.unique(keys, return_inverse=True, return_counts=True)
        twice = times[which] > 1
        marked = np.zeros(len(words), bool)
        for i in range(3):
            marked[i : i + len(twice)] |= twice
        repeated = int(marked.sum())
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def byte_entropy(text: bytes) -> float:
    """Least mean size of a byte, over 8 bits, in a code of single bytes."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    shares = counts[counts > 0] / len(text)
    return float(-(shares * np.log2(shares)).sum()) / 8


def ratios(text: bytes, chunk_bytes: int = CHUNK_BYTES, level: int = LEVEL) -> tuple[float, list[float]]:
    """Compressed over raw size of the whole text and of every chunk, the shorter last one too; an empty text has ratio 0 and no chunks."""
    squeeze = process_cache(f"zstd{level}", lambda: zstandard.ZstdCompressor(level=level)).compress
    whole = len(squeeze(text)) / len(text) if text else 0.0
    parts = [text[i : i + chunk_bytes] for i in range(0, len(text), chunk_bytes)]
    return whole, [len(squeeze(p)) / len(p) for p in parts]


def inside(text: bytes, ratio: float, bands: list[tuple]) -> bool:
    low, high = band(len(text), bands)
    over = next(limit for most, limit in OVER_ENTROPY if len(text) <= most)
    return low <= ratio <= high and (ratio <= ORDINARY or over >= 9 or ratio <= over * byte_entropy(text))


def verdict(text: bytes, bands: list[tuple] = BANDS, chunk_bytes: int = CHUNK_BYTES, share: float = CHUNK_SHARE, level: int = LEVEL) -> tuple[float, int, int, bool]:
    """Whole ratio, chunks outside their limits, chunks, and whether the text is kept. A last chunk too short to be judged is no chunk."""
    whole, parts = ratios(text, chunk_bytes, level)
    chunks = [(text[i * chunk_bytes : (i + 1) * chunk_bytes], r) for i, r in enumerate(parts)]
    chunks = [(c, r) for c, r in chunks if len(c) == chunk_bytes or len(c) > bands[0][0]]
    outside = [len(c) for c, r in chunks if not inside(c, r, bands)]
    kept = inside(text, whole, bands) and sum(outside) <= share * sum(len(c) for c, _ in chunks)
    return whole, len(outside), len(chunks), kept


def quality(documents: DataFrame, bands: list[tuple] = BANDS, chunk_bytes: int = CHUNK_BYTES, share: float = CHUNK_SHARE) -> DataFrame:
    """One row per document: doc_id, base counts, base_failed, ratio, n_outside, n_chunks, kept.

    Null text counts as empty: no words, so base_failed. Texts are read whole whatever their length, one row at a time, no shuffle.
    Repeated rows give repeated results; an empty table gives no rows; other columns are not read.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in utf8(batch, "text"):
            n, chars, symbols, dup, repeat = base_counts(text)
            failed = n < 50 or 100 * repeat > 50 * n
            whole, outside, parts, kept = verdict(text, bands, chunk_bytes, share)
            rows.append((n, chars, symbols, dup, repeat, failed, whole, outside, parts, kept and not failed))
        types = [*[pa.int64()] * 5, pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.bool_()]
        names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "ratio", "n_outside", "n_chunks", "kept"]
        return pa.record_batch([column(batch, "doc_id"), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names)

    schema = f"doc_id {native_id_type(documents)}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, ratio double, n_outside long, n_chunks long, kept boolean"
    return mapped(documents.select("doc_id", "text"), "text", make, schema)


@query("op5_compression")
def op5_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"))
