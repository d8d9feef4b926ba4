"""Token counts of sections, from one encoding of the whole document.

A document is encoded once, so its counts add up to the tokens that a model would see. The character
spans of the tokens are joined with the intervals of the sections, and a token that crosses a boundary
is allocated by a stated rule:

* ``first``: to the section of its first character,
* ``last``: to the section of its last character,
* ``most``: to the section with most of its characters, the earlier one if equal,
* ``share``: to every section in proportion to its characters there (counts are then fractions).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from driftengine.llm.common import ramp, rows, texts
from driftengine.llm.tokens import encoder

RULES = ("first", "last", "most", "share")
SCHEMA = "doc_id long, section long, start long, stop long, n_tokens double, n_crossing long"


def section_starts(text: str, boundary: re.Pattern) -> list[int]:
    """Where sections begin: at 0 and after each match of ``boundary`` that is not at the end."""
    return [0, *(m.end() for m in boundary.finditer(text) if 0 < m.end() < len(text))]


def allocate(start: np.ndarray, end: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens per section and crossing tokens by the section they begin in. Section i is
    ``[bounds[i], bounds[i + 1])``; tokens lie within the bounds and have a character at least."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, start, "right") - 1
    last = np.searchsorted(bounds, end - 1, "right") - 1
    crossing = np.bincount(first[first < last], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    if rule == "last":
        return np.bincount(last, minlength=n).astype(float), crossing
    count = np.bincount(first[first == last], minlength=n).astype(float)
    over = np.flatnonzero(first < last)
    width = last[over] - first[over] + 1
    token = np.repeat(over, width)
    section = first[token] + ramp(width)
    inside = np.minimum(end[token], bounds[section + 1]) - np.maximum(start[token], bounds[section])
    if rule == "share":
        np.add.at(count, section, inside / (end - start)[token])
    elif len(token):
        order = np.lexsort((section, -inside, token))
        best = order[np.concatenate([[True], np.diff(token[order]) != 0])]
        np.add.at(count, section[best], 1)
    return count, crossing


def section_tokens(docs: DataFrame, tokenizer: str, boundary: str = "\n", rule: str = "first") -> DataFrame:
    """One row per section of every document: doc_id, section (from 0), its characters [start, stop),
    n_tokens (double, whole unless ``rule`` is share) and n_crossing, its tokens that end in a later
    section. Sections end with each match of ``boundary``.

    A document without text (null or empty) has one empty section. Null ids stay null, repeated rows
    and extra columns change nothing, an empty table gives no rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    cut = re.compile(boundary)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches):
            plain = [t.decode() for t in texts(batch)]
            start, end, n = encoder(tokenizer, spans=True).spans(plain)
            size = np.array([len(t) for t in plain])
            base = np.cumsum(size) - size
            begins = [section_starts(t, cut) for t in plain]
            per = np.array([len(b) for b in begins])
            local = np.concatenate([np.array(b) for b in begins])
            doc = np.repeat(np.arange(len(plain)), per)
            last = np.cumsum(per) - 1
            stop = np.append(local[1:], 0)
            stop[last] = size
            # Empty documents have no tokens; the others' sections follow each other without gaps.
            used = np.flatnonzero(size[doc] > 0)
            bounds = np.append((base[doc] + local)[used], size.sum())
            shift = np.repeat(base, n)
            count, crossing = np.zeros(len(doc)), np.zeros(len(doc), np.int64)
            if len(used):
                count[used], crossing[used] = allocate(start + shift, end + shift, bounds, rule)
            ids = batch.column("doc_id").take(pa.array(doc))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(ramp(per)), pa.array(local), pa.array(stop), pa.array(count), pa.array(crossing)],
                names=["doc_id", "section", "start", "stop", "n_tokens", "n_crossing"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(work, SCHEMA)
