"""N-gram Jaccard join: T-occurrence search with DivideSkip, in blocks that hold all similar pairs.

A document is the set of its k-word shingles. Two documents link if their sets have a Jaccard
similarity of ``percent`` or more.

1. Equal sets are counted as one, by a 128-bit digest.
2. A set that links shares ``percent`` of its shingles or more, so sets with more shingles of their own than
   that allows are told by counting which shingles occur in one row only, and link with none. Documents that
   have but a passage in common go here; they would tie all others into one block.
3. Blocks. Similar sets of a size class differ in at most d shingles, so if shingles are dealt into
   more than d parts, the sets agree in a part. Documents with an equal part are candidates; the
   connected components of candidates are the blocks, so no similar pair is cut. A batch sends one
   entry for each part that several of its documents share. Blocks are then cut by size class and by
   parity sketches: a set sets bit h(s) mod m an odd number of times or not, and sets that differ in x
   shingles differ in at most x bits, so sketches that differ in more than d bits rule a pair out.
4. In a block, an inverted index lists the documents of every shingle. A query needs T common
   shingles: its longest lists, of weight up to T - 1, are set aside, the short ones are merged with
   a heap, and documents that occur there often enough are probed in the long lists by binary search
   until they reach the overlap their sizes require, or cannot any more.
5. Links are joined into components.

Lists of shingles with the same documents are one list of that weight. Documents of one component need
not be compared again, so a block first searches the leaders (documents that linked with no earlier
leader), then only what is outside of its largest component searches all. Blocks over
``BLOCK_DOCS`` or ``BLOCK_SHINGLES`` are searched in chunks that share pivots; what is then outside of the block's largest
component is sent to every chunk. So thousands of near copies cost about one search each.
"""

from __future__ import annotations

import heapq
import math
from array import array
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftengine.llm.common import forget_shuffles, hashed_words, mix, ramp, rows, shingles, sized_join, stored, texts
from driftengine.llm.components import components

#: Documents of a block that are searched in one task, their shingles, and the pivots that chunks share.
BLOCK_DOCS, BLOCK_SHINGLES, PIVOTS = 4096, 1 << 22, 16
#: Sketches of a block and size class that are compared in one task; more are dealt into parts, and each
#: two parts meet in a task.
SKETCH_DOCS = 8192
#: Documents per bucket of the comparison of parts.
BUCKET_DOCS = 2048
#: Distinct shingles of batches that are counted in one task.
COUNTED = 1 << 21
#: Bytes of text that are sent on together, and that are made into sets at once.
BATCH, PIECE = 1 << 20, 1 << 18


def document_sets(docs: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, and their number."""
    words, n = hashed_words(docs, lower=True)
    hashes, size = shingles(words, n, k)
    doc = np.repeat(np.arange(len(docs)), size)
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.bincount(doc[new], minlength=len(docs))


def batch_sets(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``document_sets`` of a batch, made in pieces: the hashes of words take many times the text."""
    made = [document_sets(texts(piece), k) for piece in rows([batch], PIECE)]
    return tuple(np.concatenate(m) for m in zip(*made))


def size_classes(percent: int, largest: int) -> list[int]:
    """First size of each class: a set can only be similar to sets of its own class or the next."""
    firsts = [1]
    while firsts[-1] <= largest:
        firsts.append(max(firsts[-1] + 1, -(-firsts[-1] * 100 // percent)))
    return firsts


def parts_of(level: int, firsts: list[int], percent: int) -> tuple[int, int]:
    """Parts for pairs of a class and the next, and how many empty ones a set may have before its
    empty parts count too: more parts agree than the smaller number of empty ones."""
    low, top = firsts[level], firsts[level + 1] - 1
    differ = (top + 100 * top // percent) * (100 - percent) // (100 + percent)
    spare = 2
    while True:
        parts = differ + 1 + spare
        empty = parts * math.exp(-low / parts)
        if spare >= min(empty + 4 * math.sqrt(empty), parts // 2) or not differ:
            return parts, spare
        spare += 1


def signatures(hashes: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every part that counts, and the document it is of."""
    firsts = size_classes(percent, int(size.max(initial=0)) + 1)
    own = np.searchsorted(firsts, size, "right") - 1  # -1 for the empty set
    table = [parts_of(i, firsts, percent) for i in range(len(firsts) - 1)]
    first = np.cumsum(size) - size
    out, of = [], []
    for step in (0, 1):  # with its own class and the next, and with the class before
        doc = np.flatnonzero((size > 0) & (own >= step))
        if not len(doc):
            continue
        level = own[doc] - step
        parts, spare = np.array([table[i] for i in level]).T
        at = np.repeat(first[doc], size[doc]) + ramp(size[doc])
        base = np.cumsum(parts) - parts
        slot = np.repeat(base, size[doc]) + ((hashes[at] >> np.uint64(9)) % np.repeat(parts, size[doc]).astype(np.uint64)).astype(np.int64)
        total = np.zeros(parts.sum(), np.uint64)
        np.add.at(total, slot, mix(hashes[at]))
        filled = np.bincount(slot, minlength=len(total)) > 0
        empty = parts - np.add.reduceat(filled.astype(np.int64), base)
        keep = filled | np.repeat(empty > spare, parts)
        name = (np.repeat(level, parts).astype(np.uint64) << np.uint64(32)) + ramp(parts).astype(np.uint64)
        out.append(mix(total + mix(name + np.uint64(1)))[keep])
        of.append(np.repeat(doc, parts)[keep])
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out), np.concatenate(of)


def sketch_bits(level: int, firsts: list[int], percent: int) -> int:
    """Bits of a parity sketch: about four times what similar sets of the level may differ in."""
    top = firsts[level + 1] - 1
    differ = (top + 100 * top // percent) * (100 - percent) // (100 + percent)
    return 64 * max(1, -(-4 * differ // 64))


def parity_sketches(hashes: np.ndarray, size: np.ndarray, bits: np.ndarray) -> list[bytes]:
    base = np.cumsum(bits) - bits
    slot = np.repeat(base, size) + ((hashes >> np.uint64(13)) % np.repeat(bits, size).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(slot, minlength=int(bits.sum())) & 1
    packed = np.packbits(odd.astype(np.uint8))
    return [packed[a // 8:(a + n) // 8].tobytes() for a, n in zip(base, bits)]


def sketch_components(sketches: np.ndarray, size: np.ndarray, percent: int, split: int | None = None) -> np.ndarray:
    """Smallest position that each row is connected to by pairs the sketches do not rule out; with
    ``split``, by pairs of a row before that place and one from there on."""
    label = np.arange(len(size))
    for i in range(len(size) - 1 if split is None else split):
        rest = i + 1 if split is None else split
        differ = np.bitwise_count(sketches[rest:] ^ sketches[i]).sum(axis=1, dtype=np.int64)
        both = size[rest:] + size[i]
        near = differ * (100 + percent) <= both * (100 - percent)
        other = np.unique(label[rest:][near])
        other = other[other != label[i]]
        if len(other):
            joined = np.append(other, label[i])
            label[np.isin(label, joined)] = joined.min()
    return label


def _edges(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.unique(np.stack([a, b], axis=1)[a != b], axis=0)


def linkable(docs: DataFrame, k: int, percent: int, shingles: int, partitions: int) -> DataFrame:
    """(key, n) of each row of ``docs`` whose set may link: enough of its n shingles occur in other rows.

    ``shingles`` is their number in all rows. They are counted by 32 bits of the hash within buckets of its
    other half; where two of them clash, both count as shared, so no set that links is left out.
    """
    buckets = max(partitions, math.ceil(shingles / COUNTED))

    def sent(number: list[int], batch: list[int], shingle: list, owner: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(number, pa.int32()), pa.array(batch, pa.int64()), pa.array(shingle, pa.binary()), pa.array(owner, pa.binary())],
            names=["bucket", "batch", "shingle", "owner"])

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(i, 1 << 16) for b in rows(batches, BATCH) for i in range(0, b.num_rows, 1 << 16))
        for batch in pieces:  # owners are 16 bits
            hashes, size = batch_sets(batch, k)
            key = np.asarray(batch.column("key"))
            with np.errstate(over="ignore"):  # names the rows and their sets, in this order
                at = np.arange(1, len(key) + 1, dtype=np.uint64)
                name = int((mix(mix(key.view(np.uint64)) + at).sum() ^ mix(hashes + mix(np.repeat(at, size))).sum()).view(np.int64))
            owner = np.repeat(np.arange(len(key), dtype=np.uint16), size)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            new = np.ones(len(hashes), bool)
            new[1:] = hashes[1:] != hashes[:-1]
            single = (new & np.append(new[1:], True))[new]
            hashes, owner = hashes[new], owner[new]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((~single, bucket))  # shingles that several rows of the batch have are sent without an owner
            shingle, owner = hashes[order].astype(np.uint32), owner[order]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            alone = np.bincount(bucket, single, buckets).astype(np.int64)
            used = np.flatnonzero(np.diff(edge)).tolist()
            yield sent([*used, name % buckets], [name] * (len(used) + 1),
                       [*(shingle[edge[i]:edge[i + 1]].tobytes() for i in used), None],
                       [*(owner[edge[i]:edge[i] + alone[i]].tobytes() for i in used), np.concatenate([key, size]).tobytes()])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, shingles, owners = [], [], []
        for batch in batches:
            known = pa.compute.is_null(batch.column("shingle"))
            yield batch.filter(known)
            batch = batch.filter(pa.compute.invert(known))
            for name, shingle, owner in zip(*(batch.column(c).to_pylist() for c in ("batch", "shingle", "owner"))):
                names.append(name)
                shingles.append(np.frombuffer(shingle, np.uint32))
                owners.append(np.frombuffer(owner, np.uint16))
        if not names:
            return
        start = np.cumsum([0, *map(len, shingles)])
        shingle = np.concatenate(shingles)
        del shingles
        order = np.argsort(shingle)
        shingle = shingle[order]
        new = np.ones(len(shingle) + 1, bool)
        new[1:-1] = shingle[1:] != shingle[:-1]
        alone = np.empty(len(shingle), bool)
        alone[order] = new[:-1] & new[1:]
        del order, shingle
        for at in range(0, len(names), 1 << 10):
            some = names[at:at + (1 << 10)]
            own = [np.sort(o[alone[a:a + len(o)]]).tobytes() for o, a in zip(owners[at:], start[at:at + len(some)])]
            yield sent([0] * len(some), some, [b""] * len(some), own)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = defaultdict(list), {}
        for batch in batches:
            for name, shingle, owner in zip(*(batch.column(c).to_pylist() for c in ("batch", "shingle", "owner"))):
                if shingle is None:
                    known[name] = np.frombuffer(owner, np.int64).reshape(2, -1)
                else:
                    own[name].append(np.frombuffer(owner, np.uint16))
        for name, (key, size) in known.items():
            alone = np.bincount(np.concatenate(own[name]), minlength=len(key)) if name in own else 0
            may = (size > 0) & ((size - alone) * 100 >= percent * size)
            yield pa.RecordBatch.from_arrays([pa.array(key[may]), pa.array(size[may])], names=["key", "n"])

    schema = "bucket int, batch long, shingle binary, owner binary"
    counted = docs.select("key", "text").mapInArrow(settle, schema).repartition(buckets, "bucket").mapInArrow(count, schema)
    return counted.select("batch", "shingle", "owner").repartition(partitions, "batch").mapInArrow(choose, "key long, n long")


def candidate_edges(docs: DataFrame, k: int, percent: int, buckets: int) -> DataFrame:
    """(a, b): documents that share a part, each with the smallest one that has it."""
    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, BATCH):
            hashes, size = batch_sets(batch, k)
            sig, of = signatures(hashes, size, percent)
            key = np.asarray(batch.column("key"))[of]
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])[: len(sig)]
            least = key[new][np.cumsum(new) - 1]
            known = _edges(key, least)
            sig, key = sig[new], key[new]
            bucket = (sig >> np.uint64(20)) % np.uint64(buckets)
            by = np.argsort(bucket, kind="stable")
            bucket, sig, key = bucket[by], sig[by], key[by]
            edge = np.searchsorted(bucket, np.arange(buckets + 1))
            out = [(i, sig[a:b].tobytes(), key[a:b].tobytes()) for i, (a, b) in enumerate(zip(edge, edge[1:])) if b > a]
            if len(known):
                out.append((int(known[0, 0] % buckets), None, known.tobytes()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))],
                names=["bucket", "sig", "key"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sigs, keys = [], []

        def found(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

        for batch in batches:
            for sig, key in zip(batch.column("sig").to_pylist(), batch.column("key").to_pylist()):
                if sig is None:
                    yield found(np.frombuffer(key, np.int64).reshape(-1, 2))
                else:
                    sigs.append(np.frombuffer(sig, np.uint64))
                    keys.append(np.frombuffer(key, np.int64))
        if sigs:
            sig, key = np.concatenate(sigs), np.concatenate(keys)
            order = np.lexsort((key, sig))
            sig, key = sig[order], key[order]
            new = np.concatenate([[True], sig[1:] != sig[:-1]])
            yield found(_edges(key, key[new][np.cumsum(new) - 1]))

    sent = docs.select("key", "text").mapInArrow(settle, "bucket int, sig binary, key binary")
    return sent.repartition(buckets, "bucket").mapInArrow(decide, "a long, b long")


class Forest:
    """Union of items; the root is the smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int):
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


class Runs:
    """Runs of numbers, one after the other in one array: a run takes no object of its own."""

    def __init__(self, values: np.ndarray, length: np.ndarray):
        self.values = memoryview(np.ascontiguousarray(values, np.intc))
        self.start = array("q", (np.cumsum(length) - length).astype(np.int64).tobytes())
        self.held = array("i", length.astype(np.intc).tobytes())

    def __len__(self) -> int:
        return len(self.held)

    def __getitem__(self, i: int) -> memoryview:
        return self.values[self.start[i]:self.start[i] + self.held[i]]

    def emptied(self) -> Runs:
        """As many runs, empty, with room for as many numbers."""
        out = Runs(np.zeros(len(self.values), np.intc), np.asarray(self.held))
        out.held = array("i", bytes(4 * len(out.held)))
        return out

    def append(self, i: int, value: int):
        self.values[self.start[i] + self.held[i]] = value
        self.held[i] += 1


class Block:
    """Inverted index over the sets of a block; items are in the order of their sizes."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent, self.size = percent, [len(s) for s in sets]
        # Four bytes an entry, and what is not needed any more goes: the entries are a task's memory.
        shingle = np.concatenate(sets)
        order = np.argsort(shingle, kind="stable")  # items of a shingle stay in order
        item = np.repeat(np.arange(len(sets), dtype=np.intc), self.size)[order]
        shingle = shingle[order]
        del order
        new = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
        length = np.diff(np.append(new, len(shingle)))
        del shingle
        with np.errstate(over="ignore"):
            name = np.add.reduceat(mix(np.arange(1, len(sets) + 1))[item], new)
        several = length > 1
        new, length, name = new[several], length[several], name[several]
        _, where, weight = np.unique(name, return_index=True, return_counts=True)
        new, length = new[where], length[where]
        item = item[np.repeat(new, length) + ramp(length)]
        #: Documents of each distinct list, ascending, and how many shingles have that list.
        self.lists = Runs(item, length)
        self.weight = array("q", weight.astype(np.int64).tobytes())
        #: Lists of each item, ascending.
        number = np.repeat(np.arange(len(length), dtype=np.intc), length)
        self.of = Runs(number[np.argsort(item, kind="stable")], np.bincount(item, minlength=len(sets)))

    def needed(self, x: int, y: int) -> int:
        """Common shingles that two sets of these sizes must have."""
        return -(-self.percent * (self.size[x] + self.size[y]) // (100 + self.percent))

    def search(self, x: int, lists: Runs, same) -> Iterator[int]:
        """Items linked with ``x`` in ``lists`` (list number to ascending items); items for which
        ``same`` is true are passed over."""
        fewest = -(-self.percent * self.size[x] // 100)
        mine = sorted(((lists.held[i], i) for i in self.of[x] if lists.held[i]), reverse=True)
        # DivideSkip: the longest lists are only probed; the share it recommends for mu = 0.01.
        most = fewest / (0.01 * math.log2(mine[0][0] + 1) + 1) if mine else 0
        long, set_aside, at = [], 0, 0
        while at < len(mine) and set_aside + self.weight[mine[at][1]] <= min(most, fewest - 1):
            set_aside += self.weight[mine[at][1]]
            long.append(mine[at][1])
            at += 1
        short = [i for _, i in mine[at:]]
        if not short:
            return
        merged = heapq.merge(*[zip(lists[i], repeat(self.weight[i])) for i in short])  # one entry of a list at a time
        current, count = -1, 0
        for y, w in chain(merged, [(-2, 0)]):
            if y == current:
                count += w
                continue
            if current >= 0 and current != x and count >= fewest - set_aside and not same(current):
                if self._probe(x, current, count, long, set_aside, lists):
                    yield current
            current, count = y, w

    def _probe(self, x, y, count, long, left, lists) -> bool:
        needed = self.needed(x, y)
        for i in long:
            if count >= needed or count + left < needed:
                break
            left -= self.weight[i]
            members = lists[i]
            at = bisect_left(members, y)
            if at < len(members) and members[at] == y:
                count += self.weight[i]
        return count >= needed

    def links(self, queries: list[int] | None = None) -> list[tuple[int, int]]:
        """Links that connect all linked items; with ``queries``, at least all that connect those."""
        n = len(self.size)
        forest, out = Forest(n), []

        def ask(x: int, lists):
            for y in self.search(x, lists, lambda y: forest.find(y) == forest.find(x)):
                forest.join(x, y)
                out.append((x, y))

        if queries is None:
            leaders = self.lists.emptied()
            for x in range(n):
                before = len(out)
                ask(x, leaders)
                if len(out) == before:
                    for i in self.of[x]:
                        leaders.append(i, x)
            groups = defaultdict(list)
            for x in range(n):
                groups[forest.find(x)].append(x)
            largest = max(groups.values(), key=len)
            queries = [x for g in groups.values() if g is not largest for x in g]
        for x in queries:
            ask(x, self.lists)
        return out


def _block_links(items: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) in each block of ``items`` (block, key, query, shingles). A block with any query is
    searched for its queries only."""
    return _by_block(items, lambda group: _links_of(group, percent))


def _by_block(items: DataFrame, work: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Rows (a, b) that ``work`` makes of each block, one block in memory at a time."""
    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = [], None
        for batch in batches:
            ids = batch.column("block").to_pylist()
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    if held and ids[a] != block:
                        yield from work(pa.Table.from_batches(held)).to_batches()
                        held = []
                    block = ids[a]
                    held.append(batch.slice(a, b - a))
        if held:
            yield from work(pa.Table.from_batches(held)).to_batches()

    ordered = items.repartition("block").sortWithinPartitions("block", "key")
    return ordered.mapInArrow(stream, "a long, b long")


def _sketched(searching: DataFrame, blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """Edges that connect what sketches leave of each block (node, root). Common passages can tie most
    documents into one block; its sketches are a small part of its shingles."""
    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, PIECE):
            hashes, size = document_sets(texts(batch), k)
            firsts = size_classes(percent, int(size.max(initial=0)) + 1)
            own = np.searchsorted(firsts, size, "right") - 1
            for step in (0, 1):  # documents of a class meet it and the class before
                doc = np.flatnonzero((size > 0) & (own >= step))
                level = own[doc] - step
                bits = np.array([sketch_bits(i, firsts, percent) for i in level], np.int64)
                picked = np.repeat(np.isin(np.arange(len(size)), doc), size)
                made = parity_sketches(hashes[picked], size[doc], bits)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("root").take(pa.array(doc)), pa.array(level, pa.int32()), batch.column("key").take(pa.array(doc)),
                     pa.array(size[doc]), pa.array(made, pa.binary())], names=["root", "level", "key", "n", "sketch"])

    def connect(group: pa.Table) -> pa.Table:
        group = group.sort_by("side")
        key, size, side = (np.asarray(group.column(c)) for c in ("key", "n", "side"))
        bits = np.stack([np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("sketch")])
        label = sketch_components(bits, size, percent, int((side == 0).sum()) if side.any() else None)
        return pa.table({"a": key, "b": key[label]}).filter(pa.array(key != key[label]))

    inside = sized_join(searching, blocks.withColumnRenamed("node", "key"), "key", width=24, how="inner")
    made = stored(inside.select("root", "key", "text").mapInArrow(
        sketches, "root long, level int, key long, n long, sketch binary"), "sketches")
    per = made.groupBy("root", "level").agg(F.ceil(F.count(F.lit(1)) / SKETCH_DOCS).cast("int").alias("parts"))
    wide = stored(per.where("parts > 1"), "wide")
    dealt = sized_join(made, wide, ["root", "level"], width=24).withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.concat_ws(":", *[c.cast("string") for c in (F.col("root"), F.col("level"), F.least("part", "other"), F.greatest("part", "other"))])
    cells = dealt.select(name.alias("block"), "key", "n", "sketch", (F.col("part") > F.col("other")).cast("int").alias("side"))
    return _by_block(cells, connect)


def _links_of(group: pa.Table, percent: int) -> pa.Table:
    sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in group.column("shingles")]
    key, query = np.asarray(group.column("key")), np.asarray(group.column("query"))
    order = np.lexsort((key, [len(s) for s in sets]))
    key, query = key[order], query[order]
    found = Block([sets[i] for i in order], percent).links(np.flatnonzero(query).tolist() if query.any() else None)
    a, b = (key[[f[i] for f in found]] if found else key[:0] for i in (0, 1))
    return pa.table({"a": a, "b": b})


def similar_components(docs: DataFrame, k: int = 5, percent: int = 80, block_docs: int = BLOCK_DOCS,
                       block_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of
    every row of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs of bytes other than ASCII white space, A-Z lower-cased. A text with fewer than ``k``
    words is one shingle; null and empty texts have none and link with nothing. Rows that share an id
    are one document with the links of all its texts. Rows with a null id link with nothing and have
    no component. An empty table gives no rows.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("key"), "text")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, PIECE):
            hashes, size = document_sets(texts(batch), k)
            upto = np.concatenate([[0], np.cumsum(size)])
            with np.errstate(over="ignore"):
                pair = [np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes + np.uint64(s)))]) for s in (1, 2)]
                pair = [(p[upto[1:]] - p[upto[:-1]]).view(np.int64) for p in pair]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array(size), *map(pa.array, pair)], names=["key", "n", "d1", "d2"])

    known = stored(base.mapInArrow(digests, "key long, n long, d1 long, d2 long"), "digests")
    linked = known.where("n > 0 and key is not null")
    # Of equal sets, the one with the smallest id searches for all.
    groups = linked.groupBy("n", "d1", "d2").agg(F.min("key").alias("owner"), F.max("key").alias("last"))
    groups = stored(groups.where("owner < last").drop("last"), "groups")  # AQE can split a large group's rows
    copies = stored(linked.join(groups, ["n", "d1", "d2"]).where("key > owner").select("key", "owner").distinct(), "copies")
    # An id all of whose texts are copies need not search.
    one = F.struct("n", "d1", "d2")
    once = linked.groupBy("key").agg(F.min(one).alias("least"), F.max(one).alias("most")).where("least = most").select("key")
    silent = stored(copies.join(once, "key").select("key").distinct(), "silent")
    searching = sized_join(base.where("key is not null"), silent, "key", width=16, how="left_anti")

    size = known.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("shingles")).first()

    def buckets(n_docs: int) -> int:
        return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_docs / BUCKET_DOCS))

    may = linkable(searching, k, percent, size.shingles, buckets(size.docs))
    may = stored(may.groupBy("key").agg(F.sum("n").alias("n")), "linkable")
    searching = sized_join(searching, may.select("key"), "key", width=16, how="left_semi")

    forget_shuffles(docs.sparkSession)  # each of the next steps needs about as much as this one

    def with_roots(found: DataFrame) -> DataFrame:
        out = stored(found.union(found.select("root", "root").distinct()), "blocks")
        forget_shuffles(docs.sparkSession)
        return out

    blocks = with_roots(components(candidate_edges(searching, k, percent, buckets(may.count()))))
    blocks = with_roots(components(_sketched(searching, blocks, k, percent)))
    sizes = sized_join(blocks, may.withColumnRenamed("key", "node"), "node", width=24).groupBy("root").agg(
        F.count(F.lit(1)).alias("docs"), F.ceil(F.greatest(F.count(F.lit(1)) / block_docs, F.sum("n") / block_shingles)).cast("int").alias("chunks"))
    large = stored(sizes.where("chunks > 1"), "large")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, PIECE):
            hashes, size = document_sets(texts(batch), k)
            parts = np.split(hashes, np.cumsum(size)[:-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column("root"), batch.column("key"), pa.array([p.tobytes() for p in parts], pa.binary())],
                names=["root", "key", "shingles"])

    items = sized_join(searching, blocks.withColumnRenamed("node", "key"), "key", width=24, how="inner")
    items = items.select("root", "key", "text").mapInArrow(sets, "root long, key long, shingles binary")
    items = items.where(F.octet_length("shingles") > 0)
    if large.isEmpty():
        links = stored(_block_links(items.select(F.struct("root", F.lit(0)).cast("string").alias("block"), "key",
                                                 F.lit(False).alias("query"), "shingles"), percent), "links")
    else:
        links = _search_large(stored(items, "items"), large, percent, block_docs, block_shingles)
    roots = components(links.union(copies))
    return known.join(roots, F.col("key") == F.col("node"), "left").select(
        F.col("key").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "key").alias("component_id"))


def _search_large(items: DataFrame, large: DataFrame, percent: int, block_docs: int, block_shingles: int) -> DataFrame:
    """Links of all blocks when some have more than ``block_docs`` documents or ``block_shingles`` shingles.

    Those are dealt into chunks, each with the block's pivots. Then every document outside of the
    block's largest component so far is a query in every chunk, in slices of about the same size.
    """
    name = lambda *c: F.concat_ws(":", *[x.cast("string") for x in c])
    order = F.xxhash64("key")
    dealt = items.join(large, "root", "left")
    dealt = dealt.withColumn("chunk", F.pmod(order, F.coalesce("chunks", F.lit(1))))
    pivots = dealt.where("chunks is not null").groupBy("root", "chunks").agg(
        F.slice(F.array_sort(F.collect_set(F.when(F.pmod(order, F.col("docs") / PIVOTS) < 1, F.col("key")))), 1, PIVOTS).alias("p"))
    pivots = dealt.join(pivots.select("root", F.explode("p").alias("key")), ["root", "key"]).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    first = dealt.unionByName(pivots).select(
        name(F.col("root"), F.col("chunk")).alias("block"), "key", F.lit(False).alias("query"), "shingles")
    links = stored(_block_links(first.dropDuplicates(["block", "key", "shingles"]), percent), "links")

    so_far = components(links).select(F.col("node").alias("key"), F.col("root").alias("component"))
    placed = dealt.where("chunks is not null").join(so_far, "key", "left").withColumn(
        "component", F.coalesce("component", "key"))
    counts = placed.groupBy("root", "component").agg(F.count(F.lit(1)).alias("n"))
    major = counts.groupBy("root").agg(F.max(F.struct("n", "component")).alias("m")).select("root", F.col("m.component").alias("major"))
    outside = placed.join(major, "root").where("component <> major")
    n = F.sum(F.octet_length("shingles") / 8)
    per = outside.groupBy("root").agg(F.ceil(F.greatest(F.count(F.lit(1)) / block_docs, n / block_shingles)).cast("int").alias("slices"))
    asks = outside.join(per, "root").withColumn("slice", F.pmod(order, F.col("slices"))).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    index = placed.join(per, "root").withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    block = name(F.col("root"), F.col("chunk"), F.col("slice")).alias("block")
    second = asks.select(block, "key", F.lit(True).alias("query"), "shingles").unionByName(
        index.select(block, "key", F.lit(False).alias("query"), "shingles"))
    second = second.groupBy("block", "key", "shingles").agg(F.max("query").alias("query"))
    return stored(links.union(_block_links(second.select("block", "key", "query", "shingles"), percent)), "links")


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose id is the smallest of its component, or null, with all columns."""
    first = similar_components(docs.select("doc_id", "text"), k, percent).where(
        F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    gone = stored(first, "near-copies")
    return sized_join(docs, gone, "doc_id", width=16, how="left_anti").select(*docs.columns)
