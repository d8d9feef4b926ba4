"""Token ids and character spans of whole texts from a byte-level BPE file of ``tokenizers``.

A byte-level BPE never joins bytes across the cuts its pre-tokenizer makes, and there is always a cut
before a single space or line feed between two other characters. Texts are cut there, and each
distinct piece is encoded once for as long as a worker keeps it, which gives the ids of the whole
text (tested) at several times the speed. Pieces of up to 16 bytes, nearly all, are told apart by these
bytes and looked up a batch at a time.
"""

from __future__ import annotations

import itertools
import os
import re
from collections.abc import Sequence

import numpy as np

from driftengine.llm.common import mix, ramp

#: Pieces a worker keeps before it starts anew; bounds its memory (about 100 bytes a piece, more
#: with spans).
KEEP, KEEP_SPANS = 1_500_000, 300_000
#: Pieces encoded in one call.
LEARN = 20_000
#: Pieces of one text among them.
JOIN = 100
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")
#: Bytes that a piece of a regular text can begin with; NUL stands before a text's first piece.
_LEADS = np.isin(np.arange(256), [0, 10, 32])
#: The low bytes of a 64-bit number, none to all eight of them.
_LOW = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
_encoders: dict[tuple[str, bool, bool, int | None], Encoder] = {}


def encoder(path: str, spans: bool = False, special: bool = True, keep: int | None = None) -> Encoder:
    """One encoder per file, kind and worker process; only one made for ``spans`` can give them.

    Strings of special tokens in a text are these tokens, as ``tokenizers`` reads them by default, or
    ordinary text if not ``special``."""
    key = path, spans, special, keep
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _regular(text: str) -> bool:
    """Words between single spaces or line feeds, no other white space or control character."""
    return not ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text.endswith((" ", "\n"))) \
        and text.replace("\n", "").isprintable()


class Table:
    """Numbers of pieces of up to 16 bytes, two words each: open addressing with linear probing."""

    def __init__(self, slots: int = 1 << 14):
        self.held, self.mask = 0, slots - 1
        self.words, self.number = np.zeros((2, slots), np.uint64), np.full(slots, -1, np.int32)

    def _slot(self, words: np.ndarray) -> np.ndarray:
        return (mix(words[0] ^ mix(words[1])) & np.uint64(self.mask)).astype(np.int64)

    def find(self, words: np.ndarray) -> np.ndarray:
        """The number of each piece (columns of ``words``), or -1."""
        slot = self._slot(words)
        out = self.number[slot]
        left = np.flatnonzero((out >= 0) & (self.words[:, slot] != words).any(axis=0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & self.mask
            out[left] = self.number[slot]
            other = (out[left] >= 0) & (self.words[:, slot] != words[:, left]).any(axis=0)
            left, slot = left[other], slot[other]
        return out.astype(np.int64)

    def add(self, words: np.ndarray, number: np.ndarray):
        """Take in distinct pieces that are not held."""
        if 2 * (self.held + len(number)) > len(self.number):
            held = self.number >= 0
            words, number = np.concatenate([self.words[:, held], words], axis=1), np.concatenate([self.number[held], number])
            self.__init__(1 << (4 * len(number)).bit_length())
        self.held += len(number)
        slot = self._slot(words)
        while len(number):
            free = self.number[slot] < 0
            self.number[slot[free]] = number[free]  # of several pieces at a slot, one stays
            stays = self.number[slot] == number
            self.words[:, slot[stays]] = words[:, stays]
            words, number, slot = words[:, ~stays], number[~stays], (slot[~stays] + 1) & self.mask


class Encoder:
    def __init__(self, path: str, spans: bool = True, special: bool = True, keep: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not special
        added = self.tokenizer.get_added_tokens_decoder()
        self.uncut = [t.content for t in added.values()] if special else []
        self.wide = {i: len(t.content.encode()) for i, t in added.items()}
        self.with_spans, self.token_bytes = spans, None
        self.keep = keep or (KEEP_SPANS if spans else KEEP)
        self.forget()

    def forget(self):
        """Let go of all pieces."""
        self.table, self.index = Table(), {}
        self.count, self.chars, self.first = (np.zeros(0, np.int32) for _ in range(3))
        self.ids, self.start, self.end = (np.zeros(0, np.uint32) for _ in range(3))

    def _keys(self, text: str) -> list[str]:
        """Pieces of a text that is not regular, each with a leading NUL. A text with a special token is
        one piece: such a token may take the white space around it."""
        if any(t in text for t in self.uncut):
            return ["\0" + text]
        return ["\0" + p for p in _CUT.split(text) if p]

    def _learn(self, keys: list[str]) -> np.ndarray:
        """Encode pieces one by one, those after a leading NUL without it, and number them in their order."""
        plain = [k[1:] if k[0] == "\0" else k for k in keys]
        encode = self.tokenizer.encode_batch if self.with_spans else self.tokenizer.encode_batch_fast
        found = encode(plain, add_special_tokens=False)
        ids = [e.ids for e in found]
        count = np.fromiter(map(len, ids), np.int32, len(ids))
        if self.with_spans:
            spans = np.array([s for e in found for s in e.offsets], np.uint32).reshape(-1, 2)
            self.chars = np.concatenate([self.chars, np.fromiter(map(len, plain), np.int32, len(plain))])
            self.start, self.end = (np.concatenate([old, spans[:, i]]) for i, old in enumerate((self.start, self.end)))
        return self._numbered(np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(count.sum())), count)

    def _learn_joined(self, raw: bytes, size: np.ndarray) -> np.ndarray:
        """The same for pieces of these sizes, one after the other, that begin with a space or line feed.

        Such pieces make a text that is cut between them, and long texts cost less a piece. Where a piece
        ends follows from the bytes of its tokens."""
        ends = np.cumsum(size)
        cuts = [0, *ends[JOIN - 1:-1:JOIN].tolist(), len(raw)]
        found = self.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(cuts, cuts[1:])], add_special_tokens=False)
        ids = [e.ids for e in found]
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.uint32, sum(map(len, ids)))
        upto = np.searchsorted(np.cumsum(self._token_bytes()[flat]), ends, "left") + 1
        return self._numbered(flat, np.diff(upto, prepend=0).astype(np.int32))

    def _numbered(self, ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Keep the ids of new pieces."""
        at = len(self.count)
        self.first = np.concatenate([self.first, len(self.ids) + (np.cumsum(count) - count).astype(np.int32)])
        self.count, self.ids = np.concatenate([self.count, count]), np.concatenate([self.ids, ids])
        return np.arange(at, at + len(count))

    def _token_bytes(self) -> np.ndarray:
        """Bytes of each token; its string has one character a byte, that of an added token is plain."""
        if self.token_bytes is None:
            vocabulary = self.tokenizer.get_vocab()
            self.token_bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            self.token_bytes[list(vocabulary.values())] = [self.wide.get(i, len(t)) for t, i in vocabulary.items()]
        return self.token_bytes

    def _listed(self, keys: list[str]) -> np.ndarray:
        """Numbers of pieces of any length."""
        new = list(dict.fromkeys(k for k in keys if k not in self.index))
        for i in range(0, len(new), LEARN):
            self.index.update(zip(new[i:i + LEARN], self._learn(new[i:i + LEARN]).tolist()))
        return np.fromiter(map(self.index.__getitem__, keys), np.int64, len(keys))

    def _packed(self, regular: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the pieces of regular texts, and how many each has: from a space, a line feed or
        the text's beginning to the next."""
        marked = [(t if t[:1] in ("", " ", "\n") else "\0" + t).encode() for t in regular]
        raw = b"".join([*marked, bytes(16)])
        values = np.frombuffer(raw, np.uint8)
        start = np.flatnonzero(_LEADS[values[:-16]])
        size = np.diff(start, append=len(raw) - 16)
        upto = np.searchsorted(start, np.cumsum([len(m) for m in marked]))
        eight = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))  # from every byte on
        words = np.stack([eight[start] & _LOW[np.minimum(size, 8)], eight[start + 8] & _LOW[np.clip(size - 8, 0, 8)]])
        at = self.table.find(words)
        cut = lambda of: [raw[a:b].decode() for a, b in zip(start[of].tolist(), (start[of] + size[of]).tolist())]
        missing = np.flatnonzero((at < 0) & (size <= 16))
        if len(missing):
            missing = missing[np.lexsort(words[:, missing])]
            new = np.append(True, (words[:, missing[1:]] != words[:, missing[:-1]]).any(axis=0))
            first, number = missing[new], np.zeros(int(new.sum()), np.int64)
            joined = (values[start[first]] > 0) & (not self.with_spans)
            for together in (True, False):
                which = np.flatnonzero(joined == together)
                for i in range(0, len(which), LEARN):
                    part = which[i:i + LEARN]
                    a, n = start[first[part]], size[first[part]]
                    number[part] = self._learn_joined(values[np.repeat(a, n) + ramp(n)].tobytes(), n) if together else self._learn(cut(first[part]))
            self.table.add(words[:, first], number)
            at[missing] = number[np.cumsum(new) - 1]
        long = np.flatnonzero(size > 16)
        at[long] = self._listed(cut(long))
        return at, np.diff(upto, prepend=0)

    def _pieces(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.count) > self.keep:
            self.forget()
        regular = np.fromiter((_regular(t) and not any(s in t for s in self.uncut) for t in texts), bool, len(texts))
        pieces = np.zeros(len(texts), np.int64)
        packed, pieces[regular] = self._packed([t for t, r in zip(texts, regular) if r])
        keys = [self._keys(t) for t, r in zip(texts, regular) if not r]
        pieces[~regular] = [len(k) for k in keys]
        at, of_regular = np.zeros(pieces.sum(), np.int64), np.repeat(regular, pieces)
        at[of_regular] = packed
        at[~of_regular] = self._listed(list(itertools.chain.from_iterable(keys)))
        return at, pieces

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        at, pieces = self._pieces(texts)
        count = self.count[at]
        ids = self.ids[np.repeat(self.first[at], count) + ramp(count)]
        upto = np.concatenate([[0], np.cumsum(count)])
        ends = np.cumsum(pieces)
        return ids, upto[ends] - upto[ends - pieces]

    def spans(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character and end of every token in its text, and the number of tokens of each."""
        at, pieces = self._pieces(texts)
        count, ends = self.count[at], np.cumsum(pieces)
        chars = np.concatenate([[0], np.cumsum(self.chars[at])])
        base = chars[:-1] - np.repeat(chars[ends - pieces], pieces)
        token = np.repeat(self.first[at], count) + ramp(count)
        base = np.repeat(base, count)
        upto = np.concatenate([[0], np.cumsum(count)])
        return base + self.start[token], base + self.end[token], upto[ends] - upto[ends - pieces]
