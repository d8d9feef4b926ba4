"""Training-data operators against brute force on small tables with every awkward row."""

import hashlib
import random
import re
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftengine.llm import (attribution, classify, components, exact, jaccard, mixing, packing, quality, substring,
                             tokens, topk, toxicity, warc)
from driftengine.llm.queries import EPOCHS, LEVELS, WEIGHTS

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
SPACE = re.compile(rb"[\x20\x09-\x0D]+")
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, key string, part int, score int, "
          "kept string, row int, n long, bucket array<int>")


def corpus(n=60, seed=3):
    """Documents with copies, near copies, shared passages, repeated rows, nulls and one long text."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "日本", "don't", "A"]
    text = lambda k: " ".join(rng.choice(words) for _ in range(k))
    passage, out = text(40), []
    for i in range(n):
        kind = i % 6
        if kind == 1 and out:
            t = out[i // 2]  # a copy, with other white space
            t = t if i % 4 == 1 else (t or "").replace(" ", "\n\t", 3)
        elif kind == 2 and out:
            w = (out[i // 3] or "x").split(" ")
            w[len(w) // 2] = "changed"
            t = " ".join(w)
        elif kind == 3:
            t = f"{text(30)} {passage}\n{text(20)}"
        else:
            t = text(rng.choice([0, 1, 2, 12, 13, 14, 60, 90]))
        out.append(t)
    out[5], out[10], out[15], out[20] = None, "", " \n ", text(5000)
    return list(enumerate(out))


def frame(spark, rows):
    full = [(i, t, "en" if (i or 0) % 3 else None, f"src{(i or 0) % 4}", len(t or ""), "k", 1, 2, "x", 3, 4, [1])
            for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def docs():
    rows = corpus()
    return rows + [rows[4], rows[7]]  # repeated rows


@pytest.fixture(scope="module")
def df(spark, docs):
    return frame(spark, docs).cache()


@pytest.fixture(scope="module")
def odd(spark, docs):
    """With null ids as well."""
    return frame(spark, [*docs, (None, docs[4][1]), (None, None), (None, "only here")]).cache()


@pytest.fixture(scope="module")
def empty(df):
    return df.limit(0)


def words(text, lower=False):
    raw = (text or "").encode()
    raw = re.sub(rb"[A-Z]", lambda m: m[0].lower(), raw) if lower else raw
    return [w for w in SPACE.split(raw) if w]


# exact deduplication

def test_exact_groups(df, docs):
    norm = {i: SPACE.sub(b" ", (t or "").encode()) for i, t in docs}
    first, size = {}, defaultdict(int)
    for i, t in docs:
        first[norm[i]] = min(i, first.get(norm[i], i))
        size[norm[i]] += 1
    for capacity in (exact.CAPACITY, 2):
        got = exact.exact_groups(df, capacity).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        want = [(i, first[norm[i]], size[norm[i]], i == first[norm[i]], hashlib.sha256(norm[i]).hexdigest()) for i, _ in docs]
        assert sorted(map(tuple, got)) == sorted(want)


def test_exact_index_splits_buckets(df):
    index = exact.build_index(df, capacity=2)
    slots = index.directory.collect()
    assert max(r.entries for r in slots) <= 2 and len({(r.depth, r.bucket) for r in slots}) > 4
    assert index.entries.count() == index.entries.select("key").distinct().count()


def test_deduplicate_keeps_columns(odd, empty):
    got = exact.deduplicate(odd)
    assert got.columns == odd.columns and got.where("kept <> 'x'").count() == 0
    assert exact.deduplicate(empty).collect() == []


# mixing

def test_mixture_reaches_budgets(df, docs):
    got = mixing.mix_sources(df, LEVELS, WEIGHTS, "total", EPOCHS).toPandas()
    total = sum(len(words(t)) for _, t in docs)
    assert len(got) == len(docs) and got.taken_tokens.sum() == total
    assert (got.prefix_tokens <= got.n_tokens).all()
    leaves = got.groupby(["domain", "lang", "source"]).sum(numeric_only=True)
    assert (leaves.taken_tokens <= EPOCHS * leaves.n_tokens).all()
    cut = got[(got.prefix_tokens > 0) & (got.prefix_tokens < got.n_tokens)]
    assert (cut.groupby(["domain", "lang", "source"]).size() <= 1).all()


def test_shortage_goes_to_siblings_first(spark):
    leaves = spark.createDataFrame(
        [("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000), ("b", "u", 1000)], "d string, s string, tokens long")
    got = mixing.leaf_budgets(leaves, ["d", "s"], {"d": "1", "s": "1"}, "800L", 1)
    assert {r.s: r.given for r in got.collect()} == {"x": 10, "y": 390, "z": 200, "u": 200}
    more = mixing.leaf_budgets(leaves, ["d", "s"], {"d": "1", "s": "1"}, "2500L", 1)
    assert {r.s: r.given for r in more.collect()} == {"x": 10, "y": 1000, "z": 745, "u": 745}


def test_mixed_documents(odd, empty, docs):
    plan = mixing.mix_sources(odd, LEVELS, WEIGHTS, "total", EPOCHS).toPandas()
    got = mixing.mixed_documents(odd, LEVELS, WEIGHTS, "total", EPOCHS)
    assert got.columns == odd.columns
    rows = got.collect()
    assert sum(len(words(r.text)) for r in rows) == plan.taken_tokens.sum()
    assert all(r.n_chars == len(r.text or "") for r in rows)
    assert mixing.mixed_documents(empty, LEVELS, WEIGHTS, "total").collect() == []


# n-gram Jaccard join

def linked(docs, k, percent):
    sets = defaultdict(list)
    for i, t in docs:
        w = words(t, lower=True)
        sets[i].append({tuple(w[p:p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return sorted((i, len(s), find(i)) for i, ss in sets.items() for s in ss)


@pytest.mark.parametrize("k, percent, block", [(3, 90, 4096), (5, 80, 4096), (3, 60, 4), (1, 50, 3)])
def test_jaccard_components(df, docs, k, percent, block):
    got = jaccard.similar_components(df, k, percent, block).collect()
    assert sorted(map(tuple, got)) == linked(docs, k, percent)


def test_jaccard_odd_rows(odd, empty, docs):
    got = jaccard.similar_components(odd).collect()
    assert [r.component_id for r in got if r.doc_id is None] == [None] * 3
    assert sorted(tuple(r) for r in got if r.doc_id is not None) == linked(docs, 5, 80)
    assert jaccard.keep_one(odd).columns == odd.columns
    assert jaccard.similar_components(empty).collect() == []


def test_jaccard_many_near_copies(spark):
    """One large group, searched in chunks, with some of it outside."""
    rng = random.Random(1)
    base = [f"b{i}" for i in range(80)]
    rows = []
    for i in range(120):
        w = list(base)
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(base[:40] + [f"y{i}_{j}" for j in range(40)])) for i in range(30)]
    got = jaccard.similar_components(frame(spark, rows), 3, 90, 16).collect()
    assert sorted(map(tuple, got)) == linked(rows, 3, 90)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for percent in (50, 80, 90):
        for n in (1, 2, 5, 9, 10, 11, 19, 40, 150, 700):
            for _ in range(8):
                x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
                y = x.copy()
                while True:  # change as much as the similarity allows
                    z = np.union1d(y[1:], rng.integers(0, 2**63, rng.integers(0, 2)).astype(np.uint64))
                    both = len(np.intersect1d(x, z))
                    if not len(z) or 100 * both < percent * (len(x) + len(z) - both):
                        break
                    y = z
                sig, of = jaccard.signatures(np.concatenate([x, y]), np.array([len(x), len(y)]), percent)
                assert set(sig[of == 0]) & set(sig[of == 1]), (percent, n)


def test_components_of_a_path_and_a_star(spark):
    path = [(i + 1, i) for i in range(40)] + [(100, 100 + i) for i in range(30)] + [(7, 7)]
    got = dict(map(tuple, components.components(spark.createDataFrame(path, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


@pytest.mark.parametrize("most", [4, 7, 8192])
def test_large_blocks_are_cut_by_sketches(spark, monkeypatch, most):
    """Documents that share a passage, each with a near copy: of one block, only the copies are left together."""
    monkeypatch.setattr(jaccard, "SKETCH_DOCS", most)
    rng = random.Random(12)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, rows = text(30), []
    for i in range(20):
        words = text(60) + passage
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:5], "changed", *words[6:]]))]
    docs = spark.createDataFrame(rows, "key long, text string").repartition(3)
    blocks = spark.createDataFrame([(i, 0) for i in range(40)], "node long, root long")
    forest = jaccard.Forest(40)
    for a, b in jaccard._sketched(docs, blocks, 3, 80).collect():
        forest.join(a, b)
    assert [forest.find(i) for i in range(40)] == [i - i % 2 for i in range(40)]
    found = jaccard.similar_components(docs.withColumnRenamed("key", "doc_id"), 3, 80).collect()
    assert sorted((r.doc_id, r.component_id) for r in found) == [(i, i - i % 2) for i in range(40)]


def test_sketches_of_two_parts():
    rng = np.random.default_rng(4)
    bits, size = rng.integers(0, 1 << 62, (9, 4)).astype(np.uint64), np.full(9, 60)
    bits[6] = bits[1]
    bits[3] = bits[2]
    assert jaccard.sketch_components(bits, size, 80).tolist() == [0, 1, 2, 2, 4, 5, 1, 7, 8]
    assert jaccard.sketch_components(bits, size, 80, 5).tolist() == [0, 1, 2, 3, 4, 5, 1, 7, 8]


# top-k

@pytest.mark.parametrize("block", [4096, 7])
def test_topk(spark, block):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.normal(size=6)], "x") for i in range(90)]
    rows[3] = (3, rows[4][1], "x")
    rows += [rows[9], (200, None, "x"), (201, [None] * 6, "x"), (202, [float("nan")] * 6, "x"),
             (203, [float("inf")] * 6, "x"), (None, [1.0] * 6, "x"), (204, [], "x"), (205, [1.0, -2.0], "x")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    vectors = topk.integer_vectors(df)
    got = topk.top_k(vectors.where("id % 5 = 0"), vectors, 5, block, 4).collect()
    known = {i: np.resize(np.append(np.floor(256 * np.array(v)), np.zeros(6)), 6) for i, v, _ in rows
             if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    for i, v, _ in rows:
        if i in (204, 205):
            known[i] = np.append(np.floor(256 * np.array(v)), np.zeros(6 - len(v)))
    want = []
    for q in known:
        if q % 5 == 0:
            best = sorted((-int(known[q] @ v), i) for i, v in known.items() if i != q)[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert topk.top_k(vectors.limit(0), vectors).collect() == []
    few = vectors.where("id < 3")
    assert topk.top_k(few, few).count() == 6
    huge = topk.integer_vectors(spark.createDataFrame([(0, [1e17, 1.0]), (1, [-1e17, 3.0])], "vec_id long, embedding array<double>"))
    assert {r.score for r in topk.top_k(huge, huge).collect()} == {-(2**63 - 1)}


def test_topk_broadcasts_nothing(spark, capsys):
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([(i, rng.normal(size=8).tolist()) for i in range(300)], "vec_id long, embedding array<double>")
    vectors = topk.integer_vectors(df)
    few = topk.top_k(vectors.where("id % 3 = 0"), vectors, 5, 16, 8)
    few.explain()
    assert "Broadcast" not in capsys.readouterr().out  # the queries were, once for every block of vectors
    assert sorted(few.collect()) == sorted(topk.top_k(vectors.where("id % 3 = 0"), vectors).collect())


# classifiers

INSULTS = ["idiot", "moron", "pathetic"]


def labelled_corpus(spark, n=600):
    rng = random.Random(5)
    good = [f"{a}{b}" for a in ("the", "of", "ba", "ko", "li") for b in ("ra", "ti", "mo", "su", "ne")]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(good) for _ in range(rng.randint(20, 120))]
        toxic, fine = int(rng.random() < 0.25), int(rng.random() < 0.75)
        if not fine:
            w = [x.upper() + "!!" for x in w] if i % 2 else [w[0]] * len(w)
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(INSULTS)
        rows.append((i, " ".join(w)))
        labels.append((i, fine, toxic, "x"))
    rows += [(n, None), (n + 1, ""), (None, "of the"), (n + 2, "word " * 30000)]
    labels += [(0, labels[0][1], labels[0][2], "x"), (None, 1, 1, "x"), (5, None, None, "x"), (n + 9, 1, 0, "x")]
    return frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string"), labels[:n]


@pytest.mark.parametrize("module, column, threshold, least", [(toxicity.toxicity, 2, 0.5, 0.97), (quality.quality, 1, 0.3, 0.97)])
def test_classifier_on_held_out_documents(spark, module, column, threshold, least):
    df, labels, truth = labelled_corpus(spark)
    got = {r.doc_id: r for r in module(df, labels).collect()}
    assert len(got) == df.count()
    right = total = 0
    for row in truth:
        r = got[row[0]]
        assert r.held_out == (zlib.crc32(str(row[0]).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold)
        if r.held_out:
            total += 1
            right += int((r.score >= 0.5) == bool(row[column]))
    assert right / total >= least
    assert all(0 <= got[i].score <= 1 for i in (600, 601, None, 602))


def test_frequent_words_do_not_crowd_out_a_decisive_one(spark):
    rng = random.Random(4)
    style = [["".join(rng.choice("abcdefghij") for _ in range(10)) for _ in range(400)] for _ in range(2)]
    rows, labels = [], []
    for i in range(400):
        toxic = i % 2
        words = style[toxic if rng.random() < 0.8 else 1 - toxic] + ["zyx!zyx"] * toxic
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    got = toxicity.toxicity(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    right = [r.predicted == labels[r.doc_id][1] for r in got if r.held_out]
    assert np.mean(right) >= 0.97


def test_fit_and_score_count_alike(monkeypatch):
    """The regression's margins over words are those of the score, also of slots in over 255 words."""
    docs = [b" ".join(b"%d-same" % i for i in range(400)), b"one two same", b""]
    doc, slot, count = toxicity.document_features(docs)
    assert count.max() > 255
    weights = np.random.default_rng(0).normal(size=toxicity.SLOTS)
    want = np.bincount(doc, count * weights[slot], minlength=3)
    seen = []
    monkeypatch.setattr(toxicity, "sigmoid", lambda z: seen.append(z) or classify.sigmoid(z))
    y = np.array([0.0, 1, 1])
    w, b = toxicity._regression(docs, weights, np.ones(3), y, np.ones(3), steps=2)
    toxicity.Model(weights, 0.0).score(docs)
    assert np.allclose(seen[-1], want)
    # The first step's gradient is of the features with their whole counts.
    toxicity._regression(docs, weights, np.ones(3), y, np.ones(3), steps=1)
    error = (classify.sigmoid(seen[-1]) - y) / 3
    x = np.zeros((3, toxicity.SLOTS))
    x[doc, slot] = count
    w1, _ = toxicity._regression(docs, weights, np.ones(3), y, np.ones(3), steps=1)
    assert np.allclose(w1, -2.0 * weights * (error @ x))


def test_classifiers_without_labels(spark, df, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    one = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    for labels in (none, one):
        for module in (toxicity.toxicity, quality.quality):
            assert {round(r.score, 6) for r in module(df, labels).collect()} is not None
            assert module(empty, labels).collect() == []


def test_held_out_labels_do_not_matter(spark):
    df, labels, _ = labelled_corpus(spark, 200)
    flipped = labels.withColumn("toxic", F.when(classify.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted((r.doc_id or -1, r.score) for r in toxicity.toxicity(df, x).collect()) for x in (labels, flipped))
    assert a == b


def test_keep_harmless(spark):
    df, labels, truth = labelled_corpus(spark)
    got = toxicity.keep_harmless(df, labels)
    kept = {r.doc_id for r in got.collect()}
    clean = {i for i, _, t, _ in truth if not t}
    assert got.columns == df.columns and len(clean - kept) <= 3
    assert len({i for i, _, t, _ in truth if t} & kept) <= 6


# tokens, packing, attribution

def reference(special=True):
    """An unchanged tokenizer, or one that reads the strings of special tokens as text."""
    t = Tokenizer.from_file(TOKENIZER)
    if not special:
        t.encode_special_tokens = True
    return t


def test_special_tokens_are_found_as_by_the_library():
    for special in (True, False):
        ids, _ = tokens.Encoder(TOKENIZER, spans=False, special=special).encode(["hello <|endoftext|> world"])
        assert (50256 in ids) == special


@pytest.mark.parametrize("special", [True, False])
def test_cached_encoder_equals_the_tokenizer(docs, special):
    rng = random.Random(1)
    parts = ["a", "B", " ", "\n", "\t", "  ", "é", "日", "'s", "'", "!", "1", "\r\n", "\x1c", " ", "\0", "<|endoftext|>", "the", "."]
    texts = [t or "" for _, t in docs] + ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(5000)]
    own = tokens.Encoder(TOKENIZER, special=special)
    want = reference(special).encode_batch(texts, add_special_tokens=False)
    ids, n = own.encode(texts)
    assert ids.tolist() == tokens.Encoder(TOKENIZER, spans=False, special=special).encode(texts)[0].tolist()
    start, end, m = own.spans(texts)
    assert list(n) == list(m) == [len(e.ids) for e in want]
    assert ids.tolist() == [i for e in want for i in e.ids]
    assert list(zip(start, end)) == [s for e in want for s in e.offsets]


@pytest.mark.parametrize("shard", [packing.SHARD_TOKENS, 3000])
def test_packing_is_gapless(odd, shard):
    rows = odd.select("doc_id", "text").collect()
    pieces = packing.pack(odd, TOKENIZER, shard_tokens=shard).toPandas()
    whole = defaultdict(list)
    for r in rows:
        ids = np.array([*reference().encode(r.text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        whole[r.doc_id].append(ids)
    for i, group in pieces.groupby(pieces.doc_id.fillna(-1)):
        want = sorted(whole[None if i == -1 else int(i)])
        assert sum(group.length) * 4 == sum(map(len, want))
        if len(want) == 1:
            group = group.sort_values("start")
            assert b"".join(map(bytes, group.ids)) == want[0]
            assert list(group.start) == [0, *np.cumsum(group.length)[:-1]]
    for _, s in pieces.sort_values("offset").groupby("sequence_id"):
        assert list(s.offset) == [0, *np.cumsum(s.length)[:-1]]
        n = s.length.sum()
        assert n <= packing.WINDOW and n & (n - 1) == 0


def test_packing_joins_related_documents():
    rng = np.random.default_rng(0)
    topic = [rng.integers(1000 * t, 1000 * t + 60, 300) for t in range(1, 7) for _ in range(4)]
    order = rng.permutation(len(topic))
    docs = [topic[i].astype("<u4") for i in order]
    df = np.zeros(8000)
    for d in docs:
        df[np.unique(d)] += 1
    pieces = packing.fill_windows(docs, packing.Index(docs, df, len(docs), 300.0), 1024)
    mixed = defaultdict(list)
    for doc, _, length, sequence, _ in pieces:
        mixed[sequence].append(order[doc] // 4)
    follows = [a == b for s in mixed.values() for a, b in zip(s, s[1:])]
    assert np.mean(follows) > 0.5  # by chance: 0.13


def test_neighbours_are_ranked_by_all_terms_of_the_seed():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.zipf(1.2, n) % 3000 + 1, 0).astype("<u2") for n in rng.integers(1, 900, 60)]
    docs += [docs[3], docs[3][-1:], np.array([4000, 4001, 0], "<u2"), np.array([4000, 4002, 0], "<u2")]
    sets = [dict(zip(*np.unique(d, return_counts=True))) for d in docs]
    df = np.zeros(1 << 16)
    for s in sets:
        df[list(s)] += 1
    index, mean = packing.Index(docs, df, len(docs), 300.0), 300.0
    for seed, asked in enumerate(sets):
        unused = rng.random(len(docs)) < 0.8
        unused[seed] = False
        score = np.zeros(len(docs))
        for d, have in enumerate(sets):
            for t in asked.keys() & have.keys():
                idf = np.log1p((len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                score[d] += idf * have[t] * 2.2 / (have[t] + 1.2 * (0.25 + 0.75 * len(docs[d]) / mean))
        for most in (5, 1000):
            got = index.neighbours(seed, unused, most)
            want = np.sort(score[unused])[::-1][:most]
            assert len(set(got)) == len(got) and unused[got].all() and np.allclose(score[got], want)


def test_packing_retrieves_from_all_blocks(spark):
    rng = random.Random(5)
    rows = []
    for t in range(40):
        words = [f"t{t}x{rng.randint(0, 40)}" for _ in range(90)]
        rows += [(2 * t, " ".join(words)), (2 * t + 1, " ".join(words[10:] + words[:10]))]
    rng.shuffle(rows)
    docs = frame(spark, rows)
    for shard in (3000, 9000):
        pieces = packing.pack(docs, TOKENIZER, shard_tokens=shard).toPandas()
        at = pieces.groupby("doc_id").sequence_id.agg(set)
        assert len(at) == 80
        met = np.mean([bool(at[2 * t] & at[2 * t + 1]) for t in range(40)])
        assert met > 0.8  # 0.33 at most when a document met those of its shard only


def packing_corpus(n=150, seed=1):
    rng = np.random.default_rng(seed)
    docs = [np.append(rng.zipf(1.2, k) % 3000 + 1, 0).astype("<u2") for k in rng.integers(1, 2500, n)]
    df = np.zeros(1 << 16)
    for d in docs:
        df[np.unique(d)] += 1
    return docs, df, float(np.mean([len(d) for d in docs]))


def test_one_chain_is_filled_like_the_windows_of_a_block():
    docs, df, mean = packing_corpus()
    index, size = packing.Index(docs, df, len(docs), mean), np.array([len(d) for d in docs])
    for most in (1, 3, 1000):  # lists that are cut only make more passes
        def retrieve(seeds, unused, _):
            lists = [index.neighbours(s, unused, 1000) for s in seeds]
            return [(x[:most], len(x) <= most) for x in lists]

        chain, at, end = packing.take_turns(size, np.arange(len(docs)), 1024, 1, retrieve)
        pieces = packing.fill_windows(docs, index, 1024)
        assert np.argsort(at).tolist() == list(dict.fromkeys(p[0] for p in pieces))
        assert not chain.any() and end.tolist() == [size.sum()]


@pytest.mark.parametrize("dense", [0, 5, 1024])
def test_blocks_retrieve_like_one_index(spark, monkeypatch, dense):
    monkeypatch.setattr(packing, "DENSE", dense)
    docs, df, mean = packing_corpus()
    tokens = spark.createDataFrame([(i, i, len(d), d.tobytes()) for i, d in enumerate(docs)],
                                   "row long, doc_id long, n long, ids binary").repartition(3)
    blocks = packing.Blocks(tokens, df, len(docs), mean, 20_000)
    assert len(blocks.number) > 5 and sorted(blocks.row) == list(range(len(docs)))
    index = packing.Index(docs, df, len(docs), mean)
    unused = np.random.default_rng(2).random(len(docs)) < 0.7
    seeds = np.flatnonzero(~unused)[:9].tolist()
    for most in (1, 1000):
        for seed, (found, whole) in zip(seeds, blocks.retrieve(seeds, unused, [most] * len(seeds))):
            free = np.zeros(len(docs), bool)
            free[blocks.row[unused]] = True
            want = index.neighbours(int(blocks.row[seed]), free, len(docs))
            assert whole == (most == 1000) and blocks.row[found].tolist() == want[:len(found)].tolist()
            assert len(found) == len(want) if whole else 16 <= len(found)


def test_packing_of_nothing(empty):
    assert packing.pack(empty, TOKENIZER).collect() == []


@pytest.mark.parametrize("rule", attribution.RULES)
def test_section_tokens(odd, rule):
    got = defaultdict(list)
    for r in attribution.section_tokens(odd, TOKENIZER, boundary=r"[ ]?\n|w1", rule=rule).collect():
        got[r.doc_id].append((r.section, r.start, r.stop, round(r.n_tokens, 6)))
    want = defaultdict(list)
    for r in odd.select("doc_id", "text").collect():
        text = r.text or ""
        starts = [0, *(m.end() for m in re.finditer(r"[ ]?\n|w1", text) if m.end() < len(text))]
        edges = [*starts, len(text)]
        count = [0.0] * len(starts)
        for a, b in reference().encode(text, add_special_tokens=False).offsets:
            share = [max(0, min(b, e) - max(a, s)) / (b - a) for s, e in zip(edges, edges[1:])]
            inside = [i for i, x in enumerate(share) if x > 0]
            if rule == "share":
                for i in inside:
                    count[i] += share[i]
            else:
                count[{"first": inside[0], "last": inside[-1], "most": share.index(max(share))}[rule]] += 1
        want[r.doc_id] += [(i, s, e, round(c, 6)) for i, (s, e, c) in enumerate(zip(edges, edges[1:], count))]
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_section_tokens_of_nothing(empty):
    assert attribution.section_tokens(empty, TOKENIZER).collect() == []


# substrings

def without_repeats(docs):
    first = {}
    for i, t in docs:
        w = words(t)
        for p in range(len(w) - 12):
            g = tuple(w[p:p + 13])
            first[g] = min(i, first.get(g, i))
    out = []
    for i, t in docs:
        w = words(t)
        gone = [any(first[tuple(w[q:q + 13])] < i for q in range(max(0, p - 12), min(p, len(w) - 13) + 1)) for p in range(len(w))]
        out.append((i, b" ".join(x for x, g in zip(w, gone) if not g).decode(), len(w), sum(gone)))
    return out


def test_remove_repeats(df, docs):
    got = substring.remove_repeats(df).collect()
    assert sorted(tuple(r)[:4] for r in got) == sorted(without_repeats(docs))
    assert max(r.longest for r in got) >= 52


def test_remove_repeats_odd_rows(odd, empty, docs):
    got = substring.remove_repeats(odd).collect()
    last = [(10**6, r.text) for r in odd.where("doc_id is null").collect()]
    want = [(None if i == 10**6 else i, *r) for i, *r in without_repeats([*docs, *last])]
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert substring.remove_repeats(empty).collect() == []


# WARC

def test_warc_round_trip(spark):
    body = "<html>" + "word é " * 40
    rows = [(i, f"http://x/{i}?q=a b", f"{body} page {i} " + "filler text of a page " * (i % 7)) for i in range(200)]
    rows += [(500 + i, f"http://y/{i}", rows[17][2]) for i in range(5)] + [(300, None, None), (301, "http://z", ""), (302, "u", "short"),
             (303, "u", "short"), (None, "http://n", rows[17][2]), (None, None, None), rows[3]]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    manifest = warc.write_archives(pages, archive_bytes=20_000)
    assert manifest.count() > 3 and manifest.agg(F.sum("records")).first()[0] == len(rows)
    got = warc.read_archives(manifest).collect()
    full = {r[0]: (r[2] or "").encode() for r in rows}
    key = lambda r: tuple((x is None, x) for x in r)
    want = []
    for i, url, html in rows:
        raw = (html or "").encode()
        first = min((j for j, _, h in rows if h == html and j is not None), default=None) if len(raw) >= 100 else i
        again = first is not None and first != i
        want.append((i, url, "revisit" if again else "response", len(raw), hashlib.sha256(raw).hexdigest(), first if again else None))
    assert sorted(((r.page_id, r.url, r.record_type, r.payload_bytes, r.payload_digest, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert all(bytes(r.payload) == full[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_warc_dictionary_frame_and_empty_table(spark):
    import pyarrow.fs as pafs
    pages = spark.createDataFrame([(i, "u", "some common text of pages " * 9 + str(i)) for i in range(300)], "page_id long, url string, html string")
    file = warc.write_archives(pages.coalesce(1)).first().file
    fs, path = pafs.FileSystem.from_uri(file)
    with fs.open_input_stream(path) as f:
        assert f.read(4) == warc.DICT_MAGIC
    nothing = warc.write_archives(pages.limit(0))
    assert nothing.count() == 0 and warc.read_archives(nothing).collect() == []


def test_every_warc_archive_has_a_dictionary(spark):
    import pyarrow.fs as pafs
    rng = random.Random(4)
    large = ["".join(rng.choice("abcdefgh <>") for _ in range(300_000)) for _ in range(3)]
    for html in (large, ["tiny"], [None]):
        pages = spark.createDataFrame([(i, "u", h) for i, h in enumerate(html)], "page_id long, url string, html string")
        manifest = warc.write_archives(pages.coalesce(1))
        fs, path = pafs.FileSystem.from_uri(manifest.first().file)
        with fs.open_input_stream(path) as f:
            assert f.read(4) == warc.DICT_MAGIC and int.from_bytes(f.read(4), "little") > 0
        assert sorted(bytes(r.payload).decode() for r in warc.read_archives(manifest).collect()) == sorted(h or "" for h in html)


def test_components_over_chunks(spark, monkeypatch):
    """A long path, a hub and a few cycles, joined in chunks of any size."""
    edges = [(i, i + 1) for i in range(300)] + [(1000, j) for j in range(1001, 1100)] + [(2000, 2001), (2001, 2002), (2002, 2000), (5, 5)]
    random.Random(2).shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    for chunk in (1 << 20, 40):
        monkeypatch.setattr(components, "CHUNK", chunk)
        got = components.components(df).collect()
        assert sorted(map(tuple, got)) == [*((i, 0) for i in range(1, 301)), *((i, 1000) for i in range(1001, 1100)), (2001, 2000), (2002, 2000)]
    assert components.components(df.limit(0)).collect() == []


def test_pieces_of_regular_texts_are_looked_up_together():
    rng = random.Random(8)
    odd = ["", " ", "\n", "a", " a", "\na", "é" * 8, " " + "x" * 15, " " + "x" * 16, "x" * 40 + " y", "a  b", "a<|endoftext|> b", "\0a b"]
    odd += ["".join(rng.choice(["a", " ", "\n", "é", "漢", ".", "1", "\0", "x" * 9, "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    words = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 20))) for _ in range(300)) for _ in range(40)]
    ours = tokens.Encoder(TOKENIZER, spans=False, keep=4000)  # words force the table to grow and to start anew
    for given in (odd, words[:20], odd, words[20:], odd):
        ids, n = ours.encode(given)
        want = [e.ids for e in ours.tokenizer.encode_batch(given, add_special_tokens=False)]
        assert n.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    short = tokens.Encoder(TOKENIZER, spans=False)
    short.encode(["some words and some more\nwords"])
    assert not short.index and short.table.held == 6  # a dictionary look-up for every word before


def test_block_takes_few_bytes_an_entry():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40_000, 400, np.uint64)) for _ in range(500)]
    entries = sum(map(len, sets))
    jaccard.Block(sets[:9], 80)
    tracemalloc.start()
    block = jaccard.Block(sets, 80)
    held, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(block.lists) > 30_000 and peak < 60 * entries and held < 40 * entries, (peak / entries, held / entries)


def test_block_searches_without_lists_of_entries():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 2**63, 400, np.uint64)
    sets = [np.unique(np.concatenate([rng.choice(base, 340, False), rng.integers(0, 2**63, 60, np.uint64)])) for _ in range(500)]
    entries = sum(map(len, sets))
    block = jaccard.Block(sets, 90)
    tracemalloc.start()
    assert block.links() == []
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 8 * entries, peak / entries  # 18.6 with a tuple for each entry of the short lists


def test_jaccard_common_passages_make_no_block(spark, monkeypatch):
    """A passage in all documents used to tie them into one block, of which every chunk was sent to every slice."""
    passage = [f"p{j}" for j in range(60)]
    rows = [(i, " ".join(passage + [f"w{i}_{j}" for j in range(60)])) for i in range(150)]
    rows += [(500 + i, rows[i][1].replace(f"w{i}_59", "other")) for i in range(20)]
    rows += [(900, ""), (901, None), (902, "p1"), (903, "p1")]
    rows += [(7, "another text of number seven"), (904, "another text of number seven")]
    may = jaccard.linkable(frame(spark, rows).selectExpr("doc_id as key", "text"), 5, 80, 20_000, 3).collect()
    assert sorted(r.key for r in may) == sorted([*range(20), *range(500, 520), 902, 903, 7, 904])
    monkeypatch.setattr(jaccard, "_search_large", None)
    got = jaccard.similar_components(frame(spark, rows), 5, 80, 64).collect()
    assert sorted(map(tuple, got)) == linked(rows, 5, 80)


def test_jaccard_blocks_are_bounded_in_shingles(spark, monkeypatch):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        w = [f"b{j}" for j in range(80)]
        w[rng.randrange(80)] = f"x{i}"
        rows.append((i, " ".join(w)))
    seen, search = [], jaccard._search_large
    monkeypatch.setattr(jaccard, "_search_large", lambda *a: seen.append(a) or search(*a))
    got = jaccard.similar_components(frame(spark, rows), 3, 90, 4096, 1000).collect()
    assert seen and sorted(map(tuple, got)) == linked(rows, 3, 90)
