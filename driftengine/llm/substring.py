"""Substring deduplication by level-wise doubling.

A window is a run of words. Level one compares 7-word windows, and only one of them for each 13-word
window: the one with the smallest hash among the seven it holds. Equal 13-word windows choose equal
7-word ones, so where those are not repeated nothing longer is. Level two compares the 13-word windows
(twice seven, less the word they share) whose choice is repeated; after that, windows repeated at one
length alone, twice in a row, are extended to twice the length, until no candidates survive.

Each comparison sends hashes to buckets. A map task first settles what it can: of equal windows in its
batch only those of the smallest document are sent, the others are known to be repeated. So a passage
in a third of all documents sends one entry a batch. Verdicts come back as runs of positions, a few
bytes a document. Copies of whole documents are settled before, by the digest of their words.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftengine.llm.common import SPACE, hashed_spans, hashed_words, ramp, rows, sized_join, stored, texts

WORDS = 13
BASE = (WORDS + 1) // 2
#: Documents per bucket of a comparison, which bounds what a task holds.
BUCKET_DOCS = 2048
#: Null ids come after all others.
LAST = 2**63 - 1
#: Bytes of text that are settled together in a map task.
BATCH = 1 << 20

INFO = "key long, part int, repeated binary, later binary, reach int"


def window_hashes(words: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; positions ascend."""
    return hashed_spans(words, at, at + k)


def chosen(words: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the 13-word windows (in the joined words), their documents, the positions of the
    chosen base windows and, for each 13-word window, which of those it chose."""
    size = np.maximum(0, n_words - WORDS + 1)
    first = np.cumsum(n_words) - n_words
    at = np.repeat(first, size) + ramp(size)
    doc = np.repeat(np.arange(len(n_words)), size)
    if not len(at):
        return at, doc, at, at
    base = window_hashes(words, np.arange(len(words) - BASE + 1), BASE)
    best, step = base[at], np.zeros(len(at), np.int64)
    for j in range(1, WORDS - BASE + 1):
        other = base[at + j]
        less = other <= best
        best, step = np.where(less, other, best), np.where(less, j, step)
    where, choice = np.unique(at + step, return_inverse=True)
    return at, doc, where, choice


def from_runs(runs: list[bytes | None], base: np.ndarray) -> np.ndarray:
    """Joined positions of the runs (first, last) of each document, which begins at ``base``."""
    parts = [np.frombuffer(r or b"", np.int32).reshape(-1, 2) for r in runs]
    n = np.array([len(p) for p in parts])
    both = np.concatenate(parts).astype(np.int64) if len(parts) else np.zeros((0, 2), np.int64)
    size = both[:, 1] - both[:, 0] + 1
    return np.repeat(both[:, 0] + np.repeat(base, n), size) + ramp(size)


def to_runs(values: np.ndarray) -> bytes:
    values = np.unique(values)
    cut = np.flatnonzero(np.diff(values) != 1)
    return np.stack([values[np.append(0, cut + 1)], values[np.append(cut, len(values) - 1)]], axis=1) \
        .astype(np.int32).tobytes() if len(values) else b""


def compare(docs: DataFrame, windows: Callable[[pa.RecordBatch], tuple], buckets: int) -> DataFrame:
    """Which windows start in several documents, and which in a smaller one.

    ``windows`` maps a batch with key and part to hashes, the row of each and its position. Returns
    key, part and the runs of repeated and of later positions, for documents that have any.
    """
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, BATCH):
            hashes, row, pos = windows(batch)
            key, part = (np.asarray(batch.column(c)) for c in ("key", "part"))
            order = np.lexsort((key[row], hashes))
            h, k = hashes[order], key[row[order]]
            new = np.concatenate([[True], h[1:] != h[:-1]])[: len(h)]
            group = np.cumsum(new) - 1
            smallest = k == k[new][group]
            several = np.bincount(group, ~smallest, minlength=0)[group] > 0
            send = np.sort(order[smallest])
            flag = np.zeros(len(order), np.int8)
            flag[order] = several
            bucket = (hashes[send] >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            send, bucket = send[by], bucket[by]
            edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])[: len(bucket) + 1]) if len(bucket) else np.zeros(1, int)
            out = [(int(bucket[a]), hashes[s], key[row[s]], part[row[s]], pos[s], flag[s])
                   for a, b in zip(edge, edge[1:]) for s in [send[a:b]]]
            known = order[~smallest]
            if len(known):  # needs no comparison; any bucket passes it on
                out.append((int(hashes[known[0]] % np.uint64(buckets)), np.zeros(0, np.uint64),
                            key[row[known]], part[row[known]], pos[known], flag[known]))
            kinds = (None, np.uint64, np.int64, np.int32, np.int32, np.int8)
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()),
                 *(pa.array([o[i].astype(kinds[i]).tobytes() for o in out], pa.binary()) for i in range(1, 6))],
                names=["bucket", "hash", "key", "part", "pos", "several"])

    def verdicts(key, part, pos, later) -> pa.RecordBatch:
        """Positions, doubled, plus one if later."""
        return pa.RecordBatch.from_arrays(
            [pa.array(key), pa.array(part), pa.array((pos << 1) | later.astype(np.int32))], names=["key", "part", "found"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            for i in range(batch.num_rows):
                raw = [batch.column(c)[i].as_py() for c in ("hash", "key", "part", "pos", "several")]
                arrays = [np.frombuffer(r, t) for r, t in zip(raw, (np.uint64, np.int64, np.int32, np.int32, np.int8))]
                if len(arrays[0]):
                    held.append(arrays)
                else:
                    yield verdicts(*arrays[1:4], np.ones(len(arrays[1]), bool))
        if not held:
            return
        h, key, part, pos, several = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((key, h))
        h, key, part, pos, several = (x[order] for x in (h, key, part, pos, several))
        new = np.concatenate([[True], h[1:] != h[:-1]])
        group = np.cumsum(new) - 1
        later = key > key[new][group]
        repeated = np.bincount(group, later | (several > 0))[group] > 0
        if repeated.any():
            yield verdicts(key[repeated], part[repeated], pos[repeated], later[repeated])

    sent = docs.mapInArrow(settle, "bucket int, hash binary, key binary, part binary, pos binary, several binary")
    found = sent.repartition(buckets, "bucket").mapInArrow(decide, "key long, part int, found int")
    lists = found.groupBy("key", "part").agg(F.collect_list("found").alias("found"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item in batch.column("found"):
                v = np.asarray(item.values)
                repeated = to_runs(v >> 1)
                ends = np.frombuffer(repeated, np.int32)
                out.append((repeated, to_runs(v[(v & 1) == 1] >> 1), int(ends[-1] - ends[0])))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("part"), *(pa.array([o[i] for o in out], pa.binary()) for i in (0, 1)),
                 pa.array([o[2] for o in out], pa.int32())], names=["key", "part", "repeated", "later", "reach"])

    return stored(lists.mapInArrow(runs, INFO), "repeats")


def _level_one(batch: pa.RecordBatch) -> tuple:
    words, n = hashed_words(texts(batch))
    _, _, where, _ = chosen(words, n)
    first = np.cumsum(n) - n
    doc = np.searchsorted(first, where, "right") - 1
    before = np.searchsorted(doc, np.arange(len(n)))  # choices of earlier documents
    return window_hashes(words, where, BASE) if len(where) else words[:0], doc, np.arange(len(where)) - before[doc]


def _level_two(batch: pa.RecordBatch) -> tuple:
    words, n = hashed_words(texts(batch))
    at, doc, where, choice = chosen(words, n)
    first = np.cumsum(n) - n
    owner = np.searchsorted(first, where, "right") - 1
    flagged = np.zeros(len(where), bool)
    flagged[from_runs(batch.column("repeated").to_pylist(), np.searchsorted(owner, np.arange(len(n))))] = True
    keep = flagged[choice] if len(at) else np.zeros(0, bool)
    at, doc = at[keep], doc[keep]
    return window_hashes(words, at, WORDS) if len(at) else words[:0], doc, at - first[doc]


def _doubled(length: int) -> Callable[[pa.RecordBatch], tuple]:
    def windows(batch: pa.RecordBatch) -> tuple:
        words, n = hashed_words(texts(batch))
        first = np.cumsum(n) - n
        is_start = np.zeros(len(words) + length, bool)
        is_start[from_runs(batch.column("repeated").to_pylist(), first)] = True
        at = np.flatnonzero(is_start[:len(words)] & is_start[length:])
        doc = np.searchsorted(np.cumsum(n), at, "right")
        inside = at + 2 * length <= np.cumsum(n)[doc]
        at, doc = at[inside], doc[inside]
        return window_hashes(words, at, 2 * length) if len(at) else words[:0], doc, at - first[doc]

    return windows


def repeated_spans(docs: DataFrame, extend: bool = True) -> DataFrame:
    """Every row of ``docs`` (doc_id, text; other columns are dropped) with key, part, whole (a copy of
    a smaller document), later (runs of 13-word windows that also start in a smaller document) and
    longest (words of the longest compared windows that do, 0 if none).

    Null text has no words. Null ids count as larger than all others and as one document. Repeated
    rows do not remove each other, they are one document. An empty table gives no rows.
    """
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), SPACE, " "))
    key, part = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("key"), F.hash("text").alias("part")
    digests = stored(docs.select(key, part, F.md5(plain).alias("words")), "digests")
    copies = digests.groupBy("words").agg(F.min("key").alias("owner"), F.max("key").alias("last"))
    copies = digests.join(copies.where("owner < last"), "words").where("owner < key")
    copies = stored(copies.select("key", "part", F.lit(True).alias("whole")).distinct(), "copies")
    base = docs.select("doc_id", "text", key, part)
    single = sized_join(base, copies, ["key", "part"], width=24, how="left_anti").select("key", "part", "text")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(digests.count() / BUCKET_DOCS))

    def again(docs: DataFrame, info: DataFrame) -> DataFrame:
        return sized_join(docs, info.select("key", "part", "repeated"), ["key", "part"], width=80, how="inner")

    info = compare(again(single, compare(single, _level_one, buckets)), _level_two, buckets)
    length, levels = WORDS, [(WORDS, info)]
    more = info.where(F.col("reach") >= length)
    if extend and not more.isEmpty():
        single = stored(again(single, more).drop("repeated"), "extended")
        while not more.isEmpty():
            found = compare(again(single, more), _doubled(length), buckets)
            length *= 2
            levels.append((length, found))
            more = found.where(F.col("reach") >= length)
    longest = None
    for n, found in levels:
        part = found.where(F.octet_length("later") > 0).select("key", "part", F.lit(n).cast("long").alias("longest"))
        longest = part if longest is None else longest.unionByName(part)
    longest = longest.groupBy("key", "part").agg(F.max("longest").alias("longest"))
    found = stored(info.join(longest, ["key", "part"]).select("key", "part", "later", "longest"), "spans")
    spans = sized_join(sized_join(base, copies, ["key", "part"], width=24), found, ["key", "part"], width=80)
    return spans.withColumn("whole", F.coalesce("whole", F.lit(False)))


def _covered(n: int, whole: bool, later: bytes | None) -> np.ndarray:
    gone = np.zeros(n, bool)
    if whole:
        gone[:] = n >= WORDS
    for first, last in np.frombuffer(later or b"", np.int32).reshape(-1, 2):
        gone[first:last + WORDS] = True
    return gone


def remove_repeats(docs: DataFrame, extend: bool = True) -> DataFrame:
    """doc_id, kept (the words that stay, joined by one space), n_words, n_removed and longest of every
    row. A word goes if a 13-word window over it also starts in a document with a smaller id; windows
    are those of the input."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            out = []
            for text, whole, later, longest in zip(texts(batch), *(batch.column(c).to_pylist() for c in ("whole", "later", "longest"))):
                words = text.split()
                gone = _covered(len(words), whole, later)
                if whole and len(words) >= WORDS:
                    longest = WORDS << int(math.log2(len(words) / WORDS))
                kept = [w for w, g in zip(words, gone.tolist()) if not g] if gone.any() else words
                out.append((b" ".join(kept), len(words), int(gone.sum()), longest or 0))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([o[0] for o in out], pa.binary()).cast(pa.string()),
                 *(pa.array([o[i] for o in out], pa.int64()) for i in (1, 2, 3))],
                names=["doc_id", "kept", "n_words", "n_removed", "longest"])

    spans = repeated_spans(docs, extend).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "whole", "later", "longest")
    return spans.mapInArrow(work, "doc_id long, kept string, n_words long, n_removed long, longest long")
