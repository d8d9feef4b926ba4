"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftengine.scale import shared_dir

#: ASCII white space; ``bytes.split()`` in Python cuts at the same six bytes.
SPACE = r"[\x20\x09-\x0D]+"
#: A side that was measured and has at most this many bytes is broadcast.
SMALL_BYTES = 16 << 20


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: lost executors are harmless
    and later steps do not compute it anew."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget_shuffles(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files of queries that have ended: it does once their plans are collected
    in the driver, which may be much later than the disk is needed."""
    spark.sparkContext._jvm.System.gc()


def sized_join(big: DataFrame, info: DataFrame, on: str | Sequence[str], width: int, how: str = "left"):
    """Join a large table with ``info`` (stored; ``width`` bytes a row at most). ``info`` is broadcast
    if its counted rows are small; otherwise both sides are shuffled. The rows are the same."""
    if info.count() * width <= SMALL_BYTES:
        info = F.broadcast(info)
    return big.join(info, on, how)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """Texts of a batch as UTF-8; null is empty."""
    return [b"" if t is None else t for t in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def ramp(lengths: np.ndarray) -> np.ndarray:
    """0..n-1 for each n, one after the other."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths)


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x5851F42D4C957F2D
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of an odd base, or of its inverse, modulo 2**64."""
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        step = np.full(max(n, 1 << 20), base, np.uint64)
        step[0] = 1
        with np.errstate(over="ignore"):
            have = _powers[kind] = np.cumprod(step)
    return have[:n]


def hashed_spans(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, chunk: int = 1 << 20) -> np.ndarray:
    """64-bit hash of ``values[start:stop]`` of each span; spans are in order and may overlap.

    A hash is a difference of running sums, taken over stretches of about ``chunk`` values, so memory
    does not grow with the text. ``values`` are bytes or 64-bit hashes.
    """
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        low = starts[at]
        to = max(at + 1, int(np.searchsorted(starts, low + chunk)))
        part = values[low:stops[to - 1] if to - at == 1 else max(stops[at:to])]
        part = _BYTE[part] if part.dtype == np.uint8 else part
        with np.errstate(over="ignore"):
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * _power("up", len(part)), out=sums[1:])
            first, last = starts[at:to] - low, stops[at:to] - low
            out[at:to] = mix((sums[last] - sums[first]) * _power("down", len(part) + 1)[first]
                             + (last - first).astype(np.uint64))
        at = to
    return out


def word_spans(docs: Sequence[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of the texts, first byte and end of every word, and the words of each text.

    Words are runs of bytes other than ASCII white space; ``lower`` folds A-Z. White space is before
    the first word and after the last.
    """
    joined = b" " + b" ".join(docs) + b" "
    if lower:
        joined = joined.lower()
    raw = np.frombuffer(joined, np.uint8)
    white = _WHITE[raw]
    starts = np.flatnonzero(white[:-1] & ~white[1:]) + 1
    stops = np.flatnonzero(~white[:-1] & white[1:]) + 1
    upto = np.searchsorted(starts, np.cumsum([len(d) + 1 for d in docs]) + 1)
    return raw, starts, stops, np.diff(upto, prepend=0)


def hashed_words(docs: Sequence[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word of every text, and the number of words of each text."""
    raw, starts, stops, n_words = word_spans(docs, lower)
    return hashed_spans(raw, starts, stops), n_words


def shingles(words: np.ndarray, n_words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order and their number per text. A text with fewer words
    has its whole sequence as one shingle; a text without words has none."""
    starts = np.cumsum(n_words) - n_words
    size = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    at = np.repeat(starts, size) + ramp(size)
    width = np.repeat(np.minimum(n_words, k), size)
    out = width.astype(np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            inside = j < width
            nxt = words[np.minimum(at + j, len(words) - 1)] if len(words) else words
            out = np.where(inside, out * np.uint64(0x9FB21C651E98DF25) + nxt, out)
    return mix(out), size


def rows(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20, column: str = "text"):
    """Cut batches so that no piece holds much more than ``limit`` bytes of text (a single longer
    text is a piece of its own)."""
    for batch in batches:
        sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0))
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
