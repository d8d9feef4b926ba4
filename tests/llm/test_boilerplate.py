"""Main text of pages: blocks on awkward markup, and runs of a site against all windows compared."""

import html
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pytest

from driftengine.llm import boilerplate

SCHEMA = "page_id long, url string, html string, text int, host string, runs int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, 1, "h", 2, "d") for i, u, h in rows], SCHEMA).repartition(4)


def texts(found, *zones):
    return [" ".join(w) for z, _, w in found if z in zones]


@pytest.mark.parametrize("page, kept", [
    ("<p>a &amp; b&copy c&am</p>", ["a & b© c&am"]),
    ("<p>one<p>two <b>bold<br>line</p>three", ["one", "two bold line", "three"]),
    ("<script>if (a < b) '<p>no</p>'</script>yes<style>p{}</style>", ["yes"]),
    ("<head><title>t</title><p>body begins", ["body begins"]),
    ("a <!-- <p>no</p> --> b <!-- open", ["a b"]),
    ("1 < 2 and <3 <p class='x>y'>quoted</p>", ["1 < 2 and <3", "quoted"]),
    ("<ul><li>one<li>two</ul><textarea>no</textarea>", ["one", "two"]),
    ("a <span hidden>no</span>b", ["a b"]),
    ("<b><p>kept</b> open</p>", ["kept open"]),
    ("<p unfinished", []), ("", []), ("</div></p></b>text", ["text"]),
    ("<td>a&nbsp;\n b</td><td>c</td>", ["a b", "c"]),
])
def test_blocks(page, kept):
    assert texts(boilerplate.blocks(page), boilerplate.OPEN) == kept


def test_zones():
    page = """<header>h</header><div class="site-nav">n</div><div id="Sidebar">s</div><article class="post comments-on">
      <header>title</header>text <aside>x</aside><form>f</form><div class="ad">ad</div><section id="comments">c</section>
      <footer>f</footer><p class="lead">more</p></article><div role="dialog">d</div><div class="notice">n</div>rest"""
    found = boilerplate.blocks(page)
    assert texts(found, boilerplate.MAIN) == ["title", "text", "more"] and texts(found, boilerplate.OPEN) == ["rest"]


def site(n=40, seed=2):
    """Pages without an article element: a menu and a footer in plain divisions, a text of their own, quotes."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    menu, quote = " ".join(word() for _ in range(12)), " ".join(word() for _ in range(9))
    out = []
    for i in range(n):
        own = " ".join(word() for _ in range(rng.choice([30, 60] if i % 5 == 0 else [3, 30, 60])))
        said = f"{own} {quote}" if i % 5 == 0 else own
        out.append((i, f"https://Site{i % 3}.example.org/{i}",
                    f"<body><div>{menu}</div><div>{said}</div><section>{menu} and end</section></body>", own, said))
    return out, menu


def test_repeated_blocks_go_and_own_text_stays(spark):
    pages, menu = site()
    rows = [p[:3] for p in pages]
    odd = [(100, None, None), (101, "no url at all", ""), (None, "https://site0.example.org", rows[3][2]), rows[4],
           (102, "https://alone.example.org/x", f"<div>{menu}</div>"), (103, rows[0][1], rows[3][2])]
    df = frame(spark, rows + odd)
    got = boilerplate.main_text(df)
    assert got.columns == ["page_id", "url", "text", "n_chars", "n_repeated", "n_marked"]
    one = sorted(map(str, got.collect()))
    assert one == sorted(map(str, boilerplate.main_text(df, shard_tokens=60).collect()))  # divided hosts alike
    by_id = {r.page_id: r for r in got.collect()}
    for i, _, _, _, said in pages:
        assert by_id[i].text == said and by_id[i].n_chars == len(said) and by_id[i].n_repeated == 26
    assert by_id[100].text == by_id[101].text == "" and by_id[102].text == menu  # nobody repeats it there
    assert by_id[103].text == by_id[3].text and got.count() == len(rows) + len(odd)
    assert boilerplate.main_text(df.limit(0)).collect() == []


def test_copies_of_a_page_are_one_page(spark):
    text = "<div>" + " ".join(f"word{i}" for i in range(50)) + "</div>"
    got = boilerplate.main_text(frame(spark, [(i, "https://a.example.org", text) for i in range(30)])).collect()
    assert len(got) == 30 and all(len(r.text.split()) == 50 for r in got)


def test_an_article_stays_whatever_repeats(spark):
    long = " ".join(f"w{i % 977}" for i in range(200_000))
    pages = [(i, "https://a.example.org", f"<div>{i} {long[:300]}</div><article><p>{long}</p><p>{i}</p></article>") for i in range(3)]
    for r in boilerplate.main_text(frame(spark, pages)).collect():
        assert r.text == f"{long}\n{r.page_id}" and r.n_repeated > 0


@pytest.mark.parametrize("run", [1, 2, 3, 5, 8])
def test_suffix_order_finds_all_repeated_strings(run):
    rng = np.random.default_rng(run)
    for _ in range(30):
        lengths = rng.integers(1, 25, rng.integers(1, 8))
        tokens = rng.integers(0, 3, lengths.sum()).astype(np.uint64)
        starts = np.cumsum(lengths) - lengths
        at, pages = {}, defaultdict(set)
        for p, (s, n) in enumerate(zip(starts, lengths)):
            for i in range(n - run + 1):
                at[s + i] = tuple(tokens[s + i:s + i + run])
                pages[at[s + i]].add(p)
        order, spread = boilerplate.repeats(tokens, lengths, run)
        assert sorted(order) == sorted(at)
        assert all(len(pages[at[i]]) > 1 for i in order[spread]) and all(len(pages[at[i]]) == 1 for i in order[~spread])


def test_pages_of_the_test_data(spark):
    path = "/root/testdata/sf0.001/pages.parquet"
    got = {r.page_id: r.text for r in boilerplate.main_text(spark.read.parquet(path)).collect()}
    for i, page in duckdb.sql(f"select page_id, html from '{path}'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        parts = [re.sub(r"<[^>]*>", "", p) for p in re.split(r"</?(?:p|h1)>", inner)]
        want = [" ".join(html.unescape(p).split()) for p in parts]
        assert got[i] == "\n".join(p for p in want if p)
