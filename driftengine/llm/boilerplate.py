"""Main text of web pages: what a site repeats from page to page goes, what is a page's own stays.

Every page becomes blocks of text, in page order, and a stream of tokens: the words of its blocks, each
block led by its tag. The streams of a host are concatenated and their suffixes sorted, by doubling
the length that is compared up to ``RUN`` tokens. Neighbours in that order which agree so far are one
string; if it comes from distinct pages, every place of it is covered. A block outside of the page's
article that is mostly covered is boilerplate.

Three things are settled by markup: text inside of an article stays although other pages may quote it
(the stream has a mark of the page's own in its place, so no run crosses it), elements that can't hold
an article (menus, footers, forms, ...) go although they may be unique, and scripts are no text.

A host of any size is divided into shards by the pages' digests. Runs that a shard has on one page
only are compared with those of the host's other shards, so that dividing a host changes nothing.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftengine.llm.common import SMALL_BYTES, hashed_spans, hashed_words, mix, rows, stored

#: Tokens of a run that makes it boilerplate when it is on distinct pages of a host.
RUN = 8
#: Tokens of a host's pages that one task sorts.
SHARD_TOKENS = 1 << 18
RESULT = "page_id long, url string, text string, n_chars long, n_repeated long, n_marked long"

SKIP, CHROME, OPEN, MAIN = range(4)

# Elements by what they mean for text (fixed values of HTML).
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
HIDDEN = RAW | frozenset("head template noscript object svg math canvas audio video select button datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
IN_HEAD = frozenset("base link meta title style script noscript template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre "
    "search section summary table tbody td tfoot th thead title tr ul".split())
#: A tag of the first kind ends an open element of the second, unless one of the third is between them.
IMPLIED = [
    (BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "option",
              "optgroup", "title"}, frozenset({"p"}), frozenset({"table", "td", "th", "button", "object"})),
    (frozenset({"li"}), frozenset({"li"}), frozenset({"ul", "ol", "menu", "dir"})),
    (frozenset({"dt", "dd"}), frozenset({"dt", "dd"}), frozenset({"dl"})),
    (frozenset({"td", "th"}), frozenset({"td", "th"}), frozenset({"table", "tr"})),
    (frozenset({"tr"}), frozenset({"tr"}), frozenset({"table"})),
    (frozenset({"tbody", "tfoot"}), frozenset({"tbody", "thead"}), frozenset({"table"})),
]
ARTICLE = frozenset({"article", "main"})
ARTICLE_ROLES = frozenset({"article", "main"})
AROUND = frozenset("nav footer aside form menu dialog fieldset search".split())
AROUND_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu "
                         "menubar toolbar".split())
#: Words of a class or an id that tell what an element is for.
ADVERT_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored adsbygoogle".split())
AROUND_WORDS = frozenset(
    "banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo related share sharing sidebar signup social "
    "subscribe toolbar widget".split())

_MARKUP = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for t in RAW}


def _zone(tag: str, raw: str, around: int) -> int:
    """What text in an element is, given what text around it is."""
    if around == SKIP or tag in HIDDEN:
        return SKIP
    words: set[str] = set()
    roles: set[str] = set()
    article = tag in ARTICLE
    if raw and not raw.isspace():
        found = {k.lower(): a or b or c for k, a, b, c in reversed(_ATTRIBUTE.findall(raw))}
        if "hidden" in found:
            return SKIP
        named = f"{found.get('class', '')} {found.get('id', '')}".lower()
        # An article may say that it has comments; it is one only if a whole name says so.
        words = set(named.split() if article else re.split(r"[^a-z0-9]+", named))
        roles = set(found.get("role", "").lower().split())
        article = article or bool(roles & ARTICLE_ROLES) or "articleBody" in found.get("itemprop", "").split()
    if around == CHROME or tag in AROUND or words & ADVERT_WORDS or roles & AROUND_ROLES:
        return CHROME
    if tag in BLOCK and tag not in ("html", "body") and words & AROUND_WORDS:
        return CHROME
    if around == MAIN or article:
        return MAIN
    return CHROME if tag == "header" or "header" in words and tag in ("div", "section") else OPEN


def blocks(page: str) -> list[tuple[int, str, list[str]]]:
    """Zone, tag and words of every block that has text, in page order. Broken markup is read as
    browsers do in the cases that change where an element ends."""
    out: list[tuple[int, str, list[str]]] = []
    stack: list[tuple[str, int]] = []
    parts: list[str] = []
    held = [OPEN, "body"]

    def flush():
        if parts:
            words = "".join(parts).split()
            if words:
                out.append((held[0], held[1], words))
            parts.clear()

    def add(text: str):
        if stack and stack[-1][0] == "head" and not text.isspace():
            stack.pop()
        zone = stack[-1][1] if stack else OPEN
        if zone == SKIP:
            return
        if zone != held[0]:  # a piece of a sentence in another zone is a block of its own
            flush()
        if not parts:
            held[:] = zone, next((t for t, _ in reversed(stack) if t in BLOCK), "body")
        parts.append(html.unescape(text) if "&" in text else text)

    at = 0
    while True:
        m = _MARKUP.search(page, at)
        end = m.start() if m else len(page)
        if end > at:
            add(page[at:end])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if tag == "br" and parts:
            parts.append(" ")
        if tag in BLOCK:
            flush()
        if m[1]:
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if place >= 0 and tag not in ("html", "body"):
                if tag in BLOCK or not any(t in BLOCK for t, _ in stack[place:]):
                    del stack[place:]
                else:
                    del stack[place]
            continue
        if tag not in IN_HEAD and tag not in ("html", "head") and any(t == "head" for t, _ in stack):
            del stack[next(i for i, (t, _) in enumerate(stack) if t == "head"):]
        for opens, ends, between in IMPLIED:
            if tag in opens:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] in ends:
                        del stack[i:]
                        break
                    if stack[i][0] in between:
                        break
        if tag in VOID:
            continue
        if tag in RAW:
            closing = _RAW_END[tag].search(page, at)
            at = closing.end() if closing else len(page)
            continue
        stack.append((tag, _zone(tag, m[3], stack[-1][1] if stack else OPEN)))
    flush()
    return out


def stream(found: list[tuple[int, str, list[str]]], mark: str) -> tuple[str, np.ndarray]:
    """Tokens of a page, joined by spaces, and how many of them each block has. Blocks of an article
    are one token that no other page has."""
    words, sizes = [], []
    for i, (zone, tag, own) in enumerate(found):
        here = [f"\0{mark}{i}"] if zone == MAIN else [f"<{tag}>", *own]
        words += here
        sizes.append(len(here))
    return " ".join(words), np.array(sizes, np.int64)


def repeats(tokens: np.ndarray, lengths: np.ndarray, run: int = RUN) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order of concatenated pages, as far as ``run`` tokens: the starts of all strings of that
    length, equal ones next to each other, and for each whether it is on two pages or more."""
    size = len(tokens)
    page = np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(size)  # tokens up to the end of the page
    rank, width = np.unique(tokens, return_inverse=True)[1], 1
    while width < run:
        step = min(width, run - width)
        inside = np.flatnonzero(left >= width + step)
        pair = rank[inside] * np.int64(size) + rank[inside + step]
        rank = np.full(size, -1)
        rank[inside] = np.unique(pair, return_inverse=True)[1]
        width += step
    order = np.argsort(rank, kind="stable")
    order = order[np.searchsorted(rank[order], 0):] if width > 1 else order
    first = np.flatnonzero(np.diff(rank[order], prepend=-1))
    ends = np.append(first[1:], len(order))
    if not len(order):
        return order, np.zeros(0, bool)
    spread = page[order[first]] != page[order[ends - 1]]  # equal strings are in page order
    return order, np.repeat(spread, ends - first)


def _streams(pages: DataFrame) -> DataFrame:
    """host, digest and tokens (64-bit hashes) of every distinct page that has a run."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, column="html"):
            marks = batch.column("digest").to_pylist()
            docs = [stream(blocks(p), m.hex())[0].encode("utf-8", "replace")
                    for p, m in zip(batch.column("html").to_pylist(), marks)]
            hashes, n = hashed_words(docs)
            ends = np.cumsum(n)
            tokens = [hashes[e - k:e].tobytes() if k >= RUN else None for e, k in zip(ends, n)]
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("digest"), pa.array(tokens, pa.binary())],
                                             names=["host", "digest", "tokens"])

    found = pages.select("host", "digest", "html").mapInArrow(work, "host string, digest binary, tokens binary")
    return found.where("tokens is not null").groupBy("host", "digest").agg(F.min("tokens").alias("tokens"))


def _sorted_shard(table: pa.Table) -> pa.Table:
    """Covered starts of each page of a shard. Of a divided host also the strings that the shard has on
    one page only (``alone``: their starts, keys, and 1 at a string's first place) and the keys of those
    it covers (``known``, each once)."""
    parts = [np.frombuffer(t, np.uint64) for t in table.column("tokens").to_pylist()]
    lengths = np.array([len(p) for p in parts])
    tokens = np.concatenate(parts)
    order, spread = repeats(tokens, lengths)
    upto = np.cumsum(lengths)
    page = np.searchsorted(upto, order, "right")
    start = (order - (upto - lengths)[page]).astype(np.int32)

    def dealt(at: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
        """Values at places of the order as one list a page."""
        by = np.argsort(page[at], kind="stable")
        cuts = np.searchsorted(page[at][by], np.arange(len(parts) + 1))
        return pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(values[at][by], kind))

    covered, none = np.flatnonzero(spread), np.zeros(0, np.int64)
    alone, known, first, key = none, none, np.zeros(len(order), np.int8), np.zeros(len(order), np.int64)
    if table.column("shards")[0].as_py() > 1:
        at = np.sort(order)
        whole = np.zeros(len(tokens), np.uint64)
        whole[at] = hashed_spans(tokens, at, at + RUN)
        key = mix(whole[order] ^ np.int64(table.column("number")[0].as_py()).astype(np.uint64)).astype(np.int64)
        once = np.unique(key, return_index=True)[1]
        first[once] = 1
        alone, known = np.flatnonzero(~spread), once[spread[once]]
    return pa.table({
        "digest": table.column("digest"), "covered": dealt(covered, start, pa.int32()),
        "alone": dealt(alone, start, pa.int32()), "keys": dealt(alone, key, pa.int64()),
        "firsts": dealt(alone, first, pa.int8()), "known": dealt(known, key, pa.int64())})


def covered_runs(pages: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """digest (of host and page) and the starts of a page's runs that other pages of the host have too."""
    streams = stored(_streams(pages), "streams")
    hosts = stored(streams.groupBy("host").agg(F.ceil(F.sum(F.octet_length("tokens")) / (8 * shard_tokens)).cast("long").alias("shards")), "hosts")
    # A string's key has its host in it; hosts' and pages' names stay out of what is compared.
    dealt = measured_join(streams, hosts, ["host"]).select(
        "host", "digest", "tokens", "shards", F.xxhash64("host").alias("number"), F.expr("pmod(xxhash64(digest), shards)").alias("shard"))
    local = stored(dealt.groupBy("host", "shard").applyInArrow(
        _sorted_shard,
        "digest binary, covered array<int>, alone array<int>, keys array<long>, firsts array<byte>, known array<long>"), "shards")
    # A string counts once for every shard that has it on one page, and twice where a shard covers it.
    once = local.select(F.explode(F.arrays_zip("keys", "firsts")).alias("s")).where("s.firsts = 1").select(
        F.col("s.keys").alias("key"), F.lit(1).alias("n"))
    twice = local.select(F.explode("known").alias("key"), F.lit(2).alias("n"))
    across = stored(once.unionByName(twice).groupBy("key").agg(F.sum("n").alias("n")).where("n > 1").select("key"), "across")
    alone = local.select("digest", F.explode(F.arrays_zip("alone", "keys")).alias("s"))
    found = alone.select("digest", F.col("s.alone").alias("start"), F.col("s.keys").alias("key"))
    small = across.count() * 16 <= SMALL_BYTES
    found = found.join(F.broadcast(across) if small else across, "key", "left_semi")
    more = found.groupBy("digest").agg(F.collect_list("start").alias("runs"))  # as many as a page has tokens at most
    own = local.select("digest", F.col("covered").alias("runs")).where("size(runs) > 0")
    return own.unionByName(more).groupBy("digest").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def measured_join(big: DataFrame, info: DataFrame, on: list[str]) -> DataFrame:
    """Left join with a stored table of one row a key, which is broadcast only if its counted bytes are
    few: 16 a row and 8 for each character of its keys and each entry of its arrays."""
    sizes = [F.size(c) if t.startswith("array") else F.octet_length(c) for c, t in info.dtypes
             if t.startswith("array") or t in ("string", "binary")]
    held = info.agg(F.coalesce(F.sum(sum((F.coalesce(s, F.lit(0)) for s in sizes), F.lit(2))), F.lit(0))).first()[0] * 8
    return big.join(F.broadcast(info) if held <= SMALL_BYTES else info, on, "left")


def main_text(pages: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per page: page_id, url, text, n_chars, n_repeated (words left out because the site
    repeats them) and n_marked (words left out by markup alone).

    Text in an article (``article``, ``main`` and their roles) stays, but for menus, asides, footers,
    forms, adverts and comments in it. Elsewhere a block stays unless at least half of its words are
    in runs of ``RUN`` tokens that distinct pages of the host have, or its markup names it a menu,
    header, footer, sidebar, notice, advert, form or comment. A block that stays stays whole.

    Pages with equal html are one page, so copies don't make each other boilerplate. Null and empty
    html give an empty text; pages without url are one host's; null and repeated ids and repeated rows
    keep a row each; other columns are ignored; an empty table gives no rows.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[^:/?#]+://([^/?#]*)", 1))
    page = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         page.alias("html"), host.alias("host"),
                         F.unhex(F.md5(F.concat_ws("\0", host, page).cast("binary"))).alias("digest"))
    runs = stored(covered_runs(keyed, shard_tokens), "covered")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor()
        for batch in rows(batches, column="html"):
            packed = [pack.compress(json.dumps([(z, len(w), " ".join(w) if z != CHROME else "") for z, _, w in blocks(p)]).encode())
                      for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("page_id", "url", "digest")), pa.array(packed, pa.binary())], names=["page_id", "url", "digest", "blocks"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in rows(batches, column="blocks"):
            text, repeated, marked = [], [], []
            for packed, starts in zip(batch.column("blocks").to_pylist(), batch.column("runs").to_pylist()):
                found = json.loads(unpack.decompress(packed))
                sizes = np.array([1 if z == MAIN else n + 1 for z, n, _ in found], np.int64)
                covered = np.zeros(int(sizes.sum()) + 1, np.int64)
                if starts:
                    covered[(np.array(starts)[:, None] + np.arange(RUN)).ravel()] = 1
                ends = np.cumsum(sizes)
                # The first token of a block is its tag, not a word.
                hit = np.concatenate([[0], np.cumsum(covered)])
                inside = hit[ends] - hit[np.minimum(ends - sizes + 1, ends)]
                kept, by_run, by_mark = [], 0, 0
                for (zone, words, own), n in zip(found, inside.tolist()):
                    if zone == MAIN or zone == OPEN and 2 * n < words:
                        kept.append(own)
                    elif 2 * n >= words:
                        by_run += words
                    else:
                        by_mark += words
                text.append("\n".join(kept))
                repeated.append(by_run)
                marked.append(by_mark)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(text, pa.string()),
                 pa.array([len(t) for t in text], pa.int64()), pa.array(repeated, pa.int64()), pa.array(marked, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_repeated", "n_marked"])

    # Runs grow with the pages, so both sides are shuffled at any size; pages as packed blocks, not as markup.
    parsed = keyed.select("page_id", "url", "html", "digest").mapInArrow(parse, "page_id long, url string, digest binary, blocks binary")
    return parsed.join(runs.hint("merge"), "digest", "left").select("page_id", "url", "blocks", "runs").mapInArrow(work, RESULT)
