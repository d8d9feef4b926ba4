"""Alignment of the tokens of two tokenizers over the bytes of each text.

Both tokenizers cut the same bytes. A token ends at a byte offset; the two lists of ends are
intersected by galloping: each end of the shorter list moves on from the place of the one before it,
in steps that double until they pass it, and a binary search settles the last step. Ends in both lists
cut the tokens into groups. The place found for an end, common or not, is its rank in the other list,
and the ranks of a token's two ends bound the tokens that overlap it.

Texts are encoded once and their ids kept in the shared folder. A pass over them counts the linked
pairs of ids, first in each task; a second pass looks the counts up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftengine.llm.common import ramp, rows, stored, texts
from driftengine.llm.tokens import encoder

#: Ends that one lane of the galloping search walks through.
LANE = 64
#: Distinct pairs a task counts before it hands them on; bounds its memory.
PAIRS = 1 << 20
#: Counted pairs are sent to every task if they were measured to be no more than this (16 bytes each).
SHARED_PAIRS = 4 << 20
#: Bytes of text, and of A's ids, in one step of a task.
TEXT_BYTES, STEP_BYTES = 512 << 10, 512 << 10
#: Pieces of texts whose A ids a worker keeps.
KEEP = 200_000

RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def byte_values() -> dict[str, int]:
    """Character of a byte-level vocabulary to its byte: printable Latin-1 bytes are themselves, the
    others follow from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(others)}


def _byte_level(path: str) -> list[bytes]:
    """Bytes of each id of a byte-level ``tokenizers`` file."""
    value, vocabulary = byte_values(), encoder(path, special=False, keep=KEEP).tokenizer.get_vocab()
    out = [b""] * (max(vocabulary.values()) + 1)
    for token, i in vocabulary.items():
        # Added tokens are plain strings; they never come up in ordinary text.
        out[i] = bytes(value[c] for c in token) if all(c in value for c in token) else token.encode()
    return out


def _pieces(model) -> list[bytes]:
    """Bytes of each id of a ``sentencepiece`` model."""
    return [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode() for i in range(model.get_piece_size())]


_pairs_of_tokenizers: dict[tuple[str, str], Both] = {}


class Both:
    """The two tokenizers of a worker, with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.first = encoder(path_a, special=False, keep=KEEP)
        self.second = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a, self.bytes_b = _byte_level(path_a), _pieces(self.second)
        self.size_a = np.fromiter(map(len, self.bytes_a), np.int64, len(self.bytes_a))
        self.size_b = np.fromiter(map(len, self.bytes_b), np.int64, len(self.bytes_b))
        #: Ids are stored in as few bytes as hold them.
        self.kind = np.dtype("<u2" if max(len(self.bytes_a), len(self.bytes_b)) <= 1 << 16 else "<u4")
        # Ids as text: those inside a group first, then those at its end.
        self.text_a, self.text_b = (np.array([f"{i}{c}" for c in (",", end) for i in range(n)], object)
                                    for n, end in ((len(self.bytes_a), "|"), (len(self.bytes_b), ";")))

    def encode(self, plain: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of each text in both; none where the joined tokens are not a space and the text."""
        ids, n = self.first.encode([" " + t for t in plain])
        out, at, none = [], 0, np.zeros(0, self.kind)
        for text, more, b in zip(plain, n.tolist(), self.second.encode(plain, num_threads=1)):
            a = ids[at:at + more]
            at += more
            whole = b" " + text.encode()
            same = text and b"".join(map(self.bytes_b.__getitem__, b)) == whole \
                and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole
            out.append((a.astype(self.kind), np.array(b, self.kind)) if same else (none, none))
        return out


def both(path_a: str, path_b: str) -> Both:
    """One per pair of files and worker process."""
    if (path_a, path_b) not in _pairs_of_tokenizers:
        _pairs_of_tokenizers[path_a, path_b] = Both(path_a, path_b)
    return _pairs_of_tokenizers[path_a, path_b]


def gallop(shorter: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """For each value of ``shorter`` the first index in ``longer`` of a value that is not smaller.

    Both rise strictly and end with the same value. The shorter list is divided into lanes. Their first
    values are sought from the list's beginning, then all lanes take one value a step together, each
    from where it stands: steps of 1, 2, 4, ... until the value is passed, then a binary search.
    """
    n, m = len(shorter), len(longer)
    out = np.empty(n, np.int64)
    heads = np.arange(0, n, LANE)
    place = np.zeros(len(heads), np.int64)
    for k in range(min(LANE, n)):
        if heads[len(place) - 1] + k >= n:  # the last lane may be shorter
            place = place[:-1]
        at = heads[:len(place)] + k
        want = shorter[at]
        low, high, step = place.copy(), place.copy(), 1  # what is before ``low`` is smaller
        behind = np.flatnonzero(longer[high] < want)
        while len(behind):
            low[behind] = high[behind] + 1
            high[behind] = np.minimum(high[behind] + step, m - 1)
            step *= 2
            behind = behind[longer[high[behind]] < want[behind]]
        apart = np.flatnonzero(low < high)
        while len(apart):
            middle = (low[apart] + high[apart]) >> 1
            less = longer[middle] < want[apart]
            low[apart] = np.where(less, middle + 1, low[apart])
            high[apart] = np.where(less, high[apart], middle)
            apart = apart[low[apart] < high[apart]]
        place = low
        out[at] = place
    return out


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Common ends as indices into both lists, and the overlapping pairs as indices into both."""
    if not len(ends_a):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    turned = len(ends_a) > len(ends_b)
    shorter, longer = (ends_b, ends_a) if turned else (ends_a, ends_b)
    place = gallop(shorter, longer)
    met = longer[place] == shorter
    # A token reaches from where the one before it ends to its own end.
    first = np.concatenate([[0], (place + met)[:-1]])
    n = place - first + 1
    own = np.repeat(np.arange(len(shorter)), n)
    other = np.repeat(first, n) + ramp(n)
    common = np.flatnonzero(met), place[met]
    return (common[1], common[0], other, own) if turned else (*common, own, other)


class Batch:
    """Documents' ids in both tokenizers, aligned."""

    def __init__(self, batch: pa.RecordBatch, tok: Both):
        self.tok = tok
        raw = [batch.column(c).to_pylist() for c in ("a", "b")]
        self.n_a, self.n_b = (np.array([len(x) // tok.kind.itemsize for x in side], np.int64) for side in raw)
        self.a, self.b = (np.frombuffer(b"".join(side), tok.kind).astype(np.int64) for side in raw)
        # A document has as many bytes in both, so ends counted on over the documents agree as well.
        self.common_a, self.common_b, self.link_a, self.link_b = overlaps(
            np.cumsum(tok.size_a[self.a]), np.cumsum(tok.size_b[self.b]))
        self.pair = self.a[self.link_a] << 32 | self.b[self.link_b]

    def per_document(self, index: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
        """Number, or sum of the weights, of entries that belong to each document by their A token."""
        upto = np.searchsorted(index, np.cumsum(self.n_a))
        if weight is not None:
            upto = np.concatenate([[0], np.cumsum(weight, dtype=np.int64)])[upto]
        return np.diff(upto, prepend=0)

    def digests(self) -> list[str]:
        """Hex SHA-256 of each document's groups as text."""
        last_a, last_b = np.zeros(len(self.a), bool), np.zeros(len(self.b), bool)
        last_a[self.common_a], last_b[self.common_b] = True, True
        # An A token comes after the B tokens of earlier groups, a B token after its own group's A tokens too.
        before_a = np.concatenate([[0], self.common_b + 1])[np.cumsum(last_a) - last_a]
        before_b = (self.common_a + 1)[np.cumsum(last_b) - last_b] if len(self.b) else 0
        words = np.empty(len(self.a) + len(self.b), object)
        words[np.arange(len(self.a)) + before_a] = self.tok.text_a[self.a + last_a * len(self.tok.bytes_a)]
        words[np.arange(len(self.b)) + before_b] = self.tok.text_b[self.b + last_b * len(self.tok.bytes_b)]
        words, ends = words.tolist(), np.cumsum(self.n_a + self.n_b).tolist()
        return [hashlib.sha256("".join(words[s:e])[:-1].encode()).hexdigest() if e > s else ""
                for s, e in zip([0, *ends], ends)]


def _batches(found: Iterator[pa.RecordBatch], tok: Both) -> Iterator[tuple[pa.RecordBatch, Batch]]:
    tok.first.forget()  # everything is encoded by now
    for batch in rows(found, STEP_BYTES, "a"):
        yield batch, Batch(batch, tok)


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row (a key of its own), doc_id and the ids of every document's text in both tokenizers (unsigned and
    little-endian, two bytes each where the vocabularies allow)."""
    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = both(path_a, path_b)
        for batch in rows(found, TEXT_BYTES):
            ids = tok.encode([t.decode() for t in texts(batch)])
            sides = [pa.array([x[i].tobytes() for x in ids], pa.binary()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), *sides],
                                             names=["row", "doc_id", "a", "b"])

    keyed = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return keyed.mapInArrow(work, "row long, doc_id long, a binary, b binary")


def pair_counts(ids: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """pair (A id times 2^32 plus B id), how many links hold it, and whether no pair of its B id has more."""
    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for _, x in _batches(found, both(path_a, path_b)):
            new, n = np.unique(x.pair, return_counts=True)
            keys, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, n]), len(keys)).astype(np.int64)
            if len(keys) > PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])
                keys, counts = keys[:0], counts[:0]
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], ["pair", "n"])

    counts = ids.select("a", "b").mapInArrow(work, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # A B id meets no more A ids than there are in the vocabulary.
    highest = F.max("n").over(Window.partitionBy(F.expr("pair & 4294967295")))
    return counts.select("pair", "n", (F.col("n") == highest).alias("best"))


def _looked_up(ids: DataFrame, pairs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """row, n_best and count_sum by a join of each document's counted pairs with all pairs."""
    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(found, both(path_a, path_b)):
            document = np.repeat(np.arange(len(x.n_a)), x.per_document(x.link_a))
            order = np.lexsort((x.pair, document))
            document, pair = document[order], x.pair[order]
            new = np.ones(len(pair), bool)
            new[1:] = (document[1:] != document[:-1]) | (pair[1:] != pair[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row").take(pa.array(document[at])), pa.array(pair[at]),
                 pa.array(np.diff(np.append(at, len(pair))))], ["row", "pair", "times"])

    links = ids.select("row", "a", "b").mapInArrow(work, "row long, pair long, times long")
    return links.join(pairs, "pair").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("n")).alias("count_sum"))


def align(docs: DataFrame, path_a: str, path_b: str, shared_pairs: int = SHARED_PAIRS) -> DataFrame:
    """One row per document: doc_id, n_a and n_b (tokens), n_groups, n_links, n_best (links whose pair no
    other pair of its B id exceeds), count_sum (over the links, how many links hold the pair) and
    groups_sha256.

    ``path_a`` is a byte-level file of ``tokenizers``, ``path_b`` a ``sentencepiece`` model; a space is
    put before A's text, as B does by itself, and strings of special tokens are plain text. Null and
    empty texts, and those whose tokens do not join to the text again (B drops or changes something),
    have zeros and an empty digest. Repeated rows are documents of their own and count as often; null
    ids stay null; extra columns are ignored; an empty table gives no rows.

    Pair counts are sent to all tasks when measured to be at most ``shared_pairs``. Beyond that each
    document's pairs, counted, are joined with them. The rows are the same.
    """
    ids = stored(encoded(docs, path_a, path_b), "token-ids")
    pairs = stored(pair_counts(ids, path_a, path_b), "pair-counts")
    known = None
    if pairs.count() <= shared_pairs:
        table = pairs.orderBy("pair").toArrow()
        known = ids.sparkSession.sparkContext.broadcast(
            [table.column(c).to_numpy(zero_copy_only=False) for c in ("pair", "n", "best")])

    def work(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _batches(found, both(path_a, path_b)):
            if known is None:
                last, looked_up = ["row"], [batch.column("row")]
            else:
                pair, n, best = known.value
                at = np.searchsorted(pair, x.pair)
                last = ["n_best", "count_sum"]
                looked_up = [x.per_document(x.link_a, best[at]), x.per_document(x.link_a, n[at])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(x.n_a), pa.array(x.n_b), pa.array(x.per_document(x.common_a)),
                 pa.array(x.per_document(x.link_a)), *map(pa.array, looked_up), pa.array(x.digests(), pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", *last, "groups_sha256"])

    if known is not None:
        return ids.mapInArrow(work, RESULT)
    counted = ids.mapInArrow(work, RESULT.replace("n_best long, count_sum long", "row long"))
    joined = counted.join(stored(_looked_up(ids, pairs, path_a, path_b), "looked-up"), "row", "left")
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return joined.select("doc_id", "n_a", "n_b", "n_groups", "n_links", *zero, "groups_sha256")
