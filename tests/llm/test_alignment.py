"""Token alignment against a version that compares all tokens of a text byte by byte."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from driftengine.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["hello world, unalignable tokenizations", " leading", "two  spaces\n\ttab", "日本語 Ünï 😀 naïve", None, "",
         "a▁b is changed by B", "<|endoftext|> and <s> are text <|endoftext|>", "x", "\u0000 control", "ﬁ ligature",
         "word " * 3000, "hello world, unalignable tokenizations"]
ROWS = [*enumerate(TEXTS), (None, "no id"), (0, TEXTS[0])]


def brute(rows):
    tok, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    tok.encode_special_tokens = True
    value = alignment.byte_values()
    docs = []
    for i, t in rows:
        a = tok.encode(" " + (t or ""), add_special_tokens=False) if t else None
        b = pieces.encode(t) if t else []
        raw_a = [bytes(value[c] for c in w) for w in a.tokens] if t else []
        raw_b = [bytes([int(pieces.id_to_piece(x)[3:5], 16)]) if pieces.is_byte(x)
                 else pieces.id_to_piece(x).replace("▁", " ").encode() for x in b]
        whole = b" " + (t or "").encode()
        if not t or b"".join(raw_a) != whole or b"".join(raw_b) != whole:
            docs.append((i, [], [], [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in raw_a]).tolist(), np.cumsum([len(x) for x in raw_b]).tolist()
        links = [(x, y) for x, (s, e) in enumerate(zip([0, *ends_a], ends_a))
                 for y, (u, v) in enumerate(zip([0, *ends_b], ends_b)) if s < v and u < e]
        groups, at_a, at_b = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            to_a, to_b = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append((a.ids[at_a:to_a], b[at_b:to_b]))
            at_a, at_b = to_a, to_b
        docs.append((i, a.ids, b, groups, [(a.ids[x], b[y]) for x, y in links]))
    count = Counter(x for d in docs for x in d[4])
    highest = defaultdict(int)
    for (_, b), n in count.items():
        highest[b] = max(highest[b], n)
    out = []
    for i, a, b, groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((i, len(a), len(b), len(groups), len(links), sum(count[x] == highest[x[1]] for x in links),
                    sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return out


@pytest.fixture(scope="module")
def want():
    short = [r if len(r[1] or "") < 5000 else (r[0], "word " * 300) for r in ROWS]
    return short, brute(short)


@pytest.mark.parametrize("shared_pairs", [alignment.SHARED_PAIRS, 0])
def test_align(spark, want, shared_pairs):
    rows, expected = want
    df = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in rows], "doc_id long, text string, n_a int, row string, a binary")
    key = lambda r: tuple((x is None, x) for x in r)
    got = alignment.align(df.repartition(4), A, B, shared_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(expected, key=key)
    assert alignment.align(df.limit(0), A, B, shared_pairs).collect() == []


def test_long_text_keeps_every_link(spark):
    df = spark.createDataFrame([(1, "tokenization " * 60_000)], "doc_id long, text string")
    r = alignment.align(df, A, B).first()
    assert r.n_links == r.n_a + r.n_b - r.n_groups and r.n_a > 60_000


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(1, 3000), min_size=1), st.sets(st.integers(1, 3000)))
def test_gallop_is_a_search(one, other):
    last = max(one | other)
    x, y = (np.array(sorted(s | {last})) for s in (one, other))
    shorter, longer = (x, y) if len(x) <= len(y) else (y, x)
    assert alignment.gallop(shorter, longer).tolist() == np.searchsorted(longer, shorter).tolist()
