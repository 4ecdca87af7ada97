"""Pages that no one would write: deep, long, torn; and tree matching against an exhaustive one."""

import itertools
import random
import re
import time

import pytest

from marlpit.llm import markup, warc, wrapper

N = 250_000
TORN = {
    "nested": "<div>" * 100_000 + "core text" + "</div>" * 100_000,
    "nested open": "<ul><li>x" * 60_000,
    "nested with text": "<div>a" * 50_000 + "</div>b" * 50_000,
    "links": "<a " * (N * 4 // 3),
    "links and an end": "<a " * (N * 4 // 3) + ">",
    "heads": "<head " * (N * 2 // 3),
    "whole heads": "<head>" * (N * 2 // 3),
    "scripts": "<script " * (N // 2) + ">",
    "whole scripts": "<script>" * (N // 2),
    "quotes": "<a '" * N + ">",
    "both quotes": "<p \"'>" * (N * 2 // 3),
    "values": '<a href="' * (N // 9 * 4) + ">",
    "comments": "<!--" * N + ">",
    "declarations": "<!" * (N * 2) + ">",
    "ends": "</" * (N * 2) + ">",
    "closing": "</div>" * (N * 2 // 3),
    "long tag": "<div " + "x=y " * N + ">text",
    "blanks": "<div class" + " " * (4 * N) + ">text",
    "class without end": "<div " + "class " * (N * 2 // 3) + ">text",
    "siblings": "<p>x</p>" * (N // 2),
    "entities": "&amp" * N,
}


@pytest.mark.parametrize("name", TORN)
def test_any_page_takes_linear_time(name):
    page = TORN[name]
    other = page[: len(page) // 2] + "<p>more</p>"
    for work in (
        lambda: wrapper.main_text(page, []), lambda: wrapper.main_text(page, [other]), lambda: wrapper.keys(wrapper.parse(page)),
        lambda: (warc.plain_text(page), warc.title(page), warc.links(page)),
    ):
        start = time.process_time()
        work()
        assert time.process_time() - start < 8


def test_deep_text_is_kept():
    assert wrapper.main_text(TORN["nested"], []) == "core text"
    assert warc.plain_text(TORN["nested"]) == "core text"


PIECES = ["<", ">", "</", "<a", "<a href=", '"', "'", "<!--", "-->", "<!", "<p>", "</p>", "<script>", "</script>", "x", " ", "=", "/", "<b class=c>"]


@pytest.mark.parametrize("seed", range(5))
def test_tokens_cover_a_page_in_order(seed):
    random_ = random.Random(seed)
    for _ in range(300):
        page = "".join(random_.choices(PIECES, k=random_.randrange(1, 25)))
        at = 0
        for token in markup.tokens(page):
            assert at <= token.start < token.end <= len(page) and page[token.start] == "<"
            if token.name:
                assert page[token.start + 1 + token.closing :].lower().startswith(token.name)
            at = token.end
        for _ in (wrapper.main_text(page, [page]), warc.plain_text(page), warc.links(page), warc.title(page)):
            pass


def test_tags_of_plain_pages():
    page = '<P Class="a>b" id=\'c\' x=y/><!-- <i> --><br/>t<a href = "/q?a=1&amp;b=2">l</a><title>a<b</title><script>"<p>"</script  ><p>'
    found = [(t.name, t.closing) for t in markup.tokens(page)]
    assert found == [("p", False), ("", False), ("br", False), ("a", False), ("a", True), ("title", False), ("title", True), ("script", False), ("script", True), ("p", False)]
    first = next(markup.tokens(page))
    assert markup.attributes(first.attributes) == {"class": "a>b", "id": "c", "x": "y/"}
    assert warc.links(page) == ["/q?a=1&b=2"]


def tree(random_, depth):
    block = wrapper.Block(random_.choice("ab"))
    for _ in range(random_.randrange(0, 4) if depth else 0):
        if random_.random() < 0.4:
            block.kids.append(wrapper.Block("#", text=random_.choice(["one", "two", "three"])))
        else:
            block.kids.append(tree(random_, depth - 1))
    return block


def exhaustive(a, b):
    """The size of the best match, every choice of aligned siblings tried."""
    best = 0
    for n in range(min(len(a.kids), len(b.kids)) + 1):
        for left in itertools.combinations(a.kids, n):
            for right in itertools.combinations(b.kids, n):
                if all(x.tag == y.tag for x, y in zip(left, right)):
                    best = max(best, sum(pair_size(x, y) for x, y in zip(left, right)))
    return 1 + best


def pair_size(x, y):
    one, two = wrapper._said(x), wrapper._said(y)
    if x.kids and y.kids and not (one and two):
        return exhaustive(x, y)
    return 2 + 2 * (one == two)


@pytest.mark.parametrize("seed", range(40))
def test_alignment_is_the_largest(seed):
    random_ = random.Random(seed)
    a, b = tree(random_, 3), tree(random_, 3)
    found = wrapper.Alignment(a, b)
    assert found.size == exhaustive(a, b)
    one, other = wrapper.runs(a), wrapper.runs(b)
    places = [([id(r) for r in one].index(id(x)), [id(r) for r in other].index(id(y))) for x, y in found.pairs]
    assert len({i for i, _ in places}) == len({j for _, j in places}) == len(places)
    assert [j for _, j in sorted(places)] == sorted(j for _, j in places)


def test_alignment_beyond_its_bounds_pairs_equal_texts(monkeypatch):
    page = wrapper.parse("".join(f"<p>text {i}</p>" for i in range(40)))
    other = wrapper.parse("".join(f"<p>text {i}</p>" for i in range(0, 40, 2)))
    for name in ("PAIRS", "LEVELS"):
        monkeypatch.setattr(wrapper, name, -1)
        assert {x.text for x, y in wrapper.Alignment(page, other).pairs if x.text == y.text} == {f"text {i}" for i in range(0, 40, 2)}
        monkeypatch.undo()


def test_all_articles_links_in_lists_and_labels_stay():
    body = "<p>A river runs past the old stone mill.</p>"
    assert wrapper.main_text(f"<article>{body}</article><nav>menu</nav><article><p>It froze.</p></article>", []) == "A river runs past the old stone mill. It froze."
    listed = '<div class="story">' + body * 3 + '<ul><li><a href="/m">The mill</a></li></ul></div>'
    assert wrapper.main_text(listed, []).endswith("The mill")
    inside = f"<article>{body}<p>Let <math><mi>x</mi></math> be <label>one</label>.</p></article>"
    assert re.sub(" +", " ", wrapper.main_text(inside, [])).endswith("Let x be one.")


NAMES = "amber basalt cedar dune ember flint garnet heath iris jade kelp loam".split()


def varied(i, n):
    """One make of page with parts that some pages have and others lack."""
    more = "".join(f"<{tag}><span>extra {tag} of {n} number {i}</span></{tag}>" for k, tag in enumerate(("section", "table", "dl", "center")) if i >> k & 1)
    return f"<html><body><div><p>All of {n} and more of {n} is told here, at length.</p>{more}</div><div>Join our daily letter today</div></body></html>"


def test_templates_are_counted_over_all_pages_of_a_host(spark):
    """No two pages have the same tag paths; rows of other hosts, copies and empty pages do not count."""
    pages = [(i, "https://one.example/a", varied(i, n)) for i, n in enumerate(NAMES)]
    pages += [(100, "https://two.example/a", varied(0, "other")), (101, "https://one.example/b", None), (0, "https://one.example/a", pages[0][2])]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    from pyspark.sql import functions as F

    names = "host slot key mark keys others n salt text".split()
    got = {r.page_id: r.text for r in wrapper.extract(table.select("*", *[F.lit("x").alias(c) for c in names])).collect()}
    assert all("Join our" not in got[i] and f"All of {n} and more of {n}" in got[i] for i, n in enumerate(NAMES))
    assert got[101] == "" and "All of other" in got[100]


@pytest.mark.parametrize("keys,characters", [(0, 0), (1 << 20, 1 << 23)])
def test_shared_keys_are_those_of_plain_counting(spark, monkeypatch, keys, characters):
    """Also where what hosts tell is too large to broadcast."""
    monkeypatch.setattr(wrapper, "TOLD_KEYS", keys)
    monkeypatch.setattr(wrapper, "TOLD_CHARACTERS", characters)
    random_ = random.Random(5)
    texts = ["letter", "legal notice", "menu of all"] + [f"text {i} of its own" for i in range(30)]
    pages = []
    for i in range(40):
        parts = "".join(f"<div>{random_.choice(texts[:3])}</div>" for _ in range(2)) + f"<section>{random_.choice(texts)}</section>"
        pages.append((i, f"https://h{i % 3}.example/", f"<body>{parts}<p>page {i // 2 * 2} alone says this</p></body>"))
    pages += [(90, "https://pair.example/", varied(1, "amber")), (91, "https://pair.example/", varied(1, "loam"))]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    given = table.select("page_id", "url", "html", wrapper.host(table.url).alias("host"))
    got = {r.host: set(r["keys"]) for r in wrapper.shared(wrapper.describe(given)).collect()}
    wanted = {}
    marks: dict = {}
    at_slot: dict = {}
    for _, url, page in pages:
        name, found = url.split("/")[2], wrapper.keys(wrapper.prune(wrapper.parse(page)))
        mark = wrapper.drawn_run(found)
        for _, slot, key in found:
            marks.setdefault((name, slot, key), set()).add(mark)
            at_slot.setdefault((name, slot), set()).add(mark)
    for (name, slot, key), own in marks.items():
        if len(own) >= 3 and 2 * len(own) >= len(at_slot[name, slot]):
            wanted.setdefault(name, set()).add(key)
    assert got == wanted
    out = {r.page_id: r.text for r in wrapper.extract(table).collect()}
    assert len(out) == len(pages) and "Join our" not in out[90] and "All of amber" in out[90]
