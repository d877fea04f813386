"""Alignment against brute force, and texts that depend on the host's wrapper alone."""

import random

import pytest

from skimlark.llm import wrappers


def tree(r: random.Random, depth: int) -> wrappers.Node:
    node = wrappers.Node(r.choice("abc"))
    node.children = [tree(r, depth - 1) for _ in range(r.randint(0, 4) if depth else 0)]
    return node


def largest(x: wrappers.Node, y: wrappers.Node) -> int:
    if x.tag != y.tag:
        return 0
    best = [[0] * (len(y.children) + 1) for _ in range(len(x.children) + 1)]
    for i, p in enumerate(x.children):
        for j, q in enumerate(y.children):
            best[i + 1][j + 1] = max(best[i][j] + largest(p, q), best[i][j + 1], best[i + 1][j])
    return 1 + best[-1][-1]


def test_alignment_is_the_largest():
    r = random.Random(3)
    for _ in range(500):
        a, b = tree(r, 3), tree(r, 3)
        wrappers._sizes(a)
        wrappers._sizes(b)
        assert len(wrappers.matched(a, b)) == largest(a, b)
    a, b = (wrappers.parsed(t) for t in ("<div><div><i>x</i></div><div><p>1<p>2<p>3</div></div>", "<div><div><p>1<p>2<p>3</div></div>"))
    assert len(wrappers.matched(a, b)) == largest(a, b) == 9


def test_alignment_of_long_lists_keeps_order_and_tags(monkeypatch):
    monkeypatch.setattr(wrappers, "CELLS", 9)
    r = random.Random(5)
    for _ in range(200):
        a, b = wrappers.Node("r"), wrappers.Node("r")
        a.children, b.children = ([tree(r, 2) for _ in range(r.randint(0, 25))] for _ in range(2))
        wrappers._sizes(a)
        wrappers._sizes(b)
        pairs = wrappers.matched(a, b)
        assert all(x.tag == y.tag for x, y in pairs)
        assert len({id(x) for x, _ in pairs}) == len({id(y) for _, y in pairs}) == len(pairs) <= largest(a, b)
        places = sorted((i, j) for i, x in enumerate(a.children) for j, y in enumerate(b.children) if any(x is p and y is q for p, q in pairs))
        assert [j for _, j in places] == sorted(j for _, j in places)


def test_very_deep_pages_end():
    assert wrappers.main_texts(["<div>" * 1500 + "a", "<div>" * 1400 + "<p>b"]) == ["a", "b"]


@pytest.mark.parametrize("n", [1, 2, 3, 6])
def test_headings_between_slots_stay(n):
    page = lambda k: f"<article><h1>T{k}</h1><h2>Summary</h2><p>{k} one {k * k} two</p><h2>Conclusion</h2><p>{k} three {k + 7} four</p></article>"
    assert wrappers.main_texts([page(k) for k in range(n)]) == [f"T{k}\nSummary\n{k} one {k * k} two\nConclusion\n{k} three {k + 7} four" for k in range(n)]


def test_texts_do_not_depend_on_how_pages_are_dealt(spark, monkeypatch):
    page = lambda k: f"<article><p>Shared start</p><p>{k} first {k * 3} word {k + 5}</p><p><a href=x>Go on</a></p><p>{k} last {k * 7}</p><p>All rights</p></article>"
    rows = [(2**60 + k, f"http://h/{k}", page(k)) for k in range(60)] + [(2**60 + 3, "http://h/3", page(3))] * 5 + [(None, "http://k/", page(1)), (9, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    texts = lambda: sorted(map(tuple, wrappers.extracted(pages).collect()), key=repr)
    whole = texts()
    monkeypatch.setattr(wrappers, "PART", 4)
    monkeypatch.setattr(wrappers, "HOSTS", 0)
    assert texts() == whole and len(whole) == len(rows)
    found = {r[0]: r[2] for r in whole}
    assert all(found[2**60 + k] == f"{k} first {k * 3} word {k + 5}\n{k} last {k * 7}" for k in range(60))
    assert found[None] == "Shared start\n1 first 3 word 6\nGo on\n1 last 7\nAll rights" and found[9] == ""
    assert wrappers.extracted(pages.where("false")).count() == 0


def test_every_page_of_a_host_says_what_is_template(spark, monkeypatch):
    """The first line differs on one page of 200, the last on none: the odd page is heard wherever it stands, whether texts are shipped or joined."""
    page = lambda k, first: f"<article><p>{first}</p><p>{k} first {k * 3} word {k + 5}</p><p>All rights</p></article>"
    odd = [7, 50, 93, 141, 188]
    rows = [(1000 * o + k, f"http://h{o}/{k}", page(k, "Other start" if k == o else "Shared start")) for o in odd for k in range(200)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    for shipped in (wrappers.SHIPPED, 0):
        monkeypatch.setattr(wrappers, "SHIPPED", shipped)
        monkeypatch.setattr(wrappers, "HELD", wrappers.HELD if shipped else 0)
        found = {r["page_id"]: r["text"] for r in wrappers.extracted(pages).collect()}
        assert found == {1000 * o + k: f"{'Other start' if k == o else 'Shared start'}\n{k} first {k * 3} word {k + 5}" for o in odd for k in range(200)}
