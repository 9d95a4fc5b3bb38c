"""Main text by wrapper induction, against pages whose article is known."""

import random

import pytest

from tessel.llm.wrappers import extract, extract_pages, main_slot, match, parse, walk

SCHEMA = "page_id long, url string, html string"


def texts(spark, rows):
    return {r["page_id"]: r["text"] for r in extract_pages(spark.createDataFrame(rows, SCHEMA)).collect()}


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(n))


def soup(rng, article):
    """A page without a telling element or class: its template shows in other pages alone."""
    body = "".join(f"<p>{p}</p>" for p in article)
    return (
        "<html><body><div class=q1><div>The Daily Tessellation</div><div>All the news that tiles</div></div>"
        f"<div class=q2><h1>{article[0]}</h1>{body}<p>Subscribe to our letter today.</p></div>"
        f"<div class=q3><a href=/a>{words(rng, 1)}</a> <a href=/b>{words(rng, 1)}</a> <ul><li><a href=/c>{words(rng, 1)}</a></ul></div>"
        "<div class=q4>All rights reserved by the publisher of these pages.</div></body></html>"
    )


def test_constant_nodes_are_template_and_varying_slots_content(spark):
    rng = random.Random(1)
    articles = [[words(rng, 20) for _ in range(rng.randint(2, 6))] for _ in range(12)]
    rows = [(i, f"http://soup.example/{i}", soup(rng, a)) for i, a in enumerate(articles)]
    found = texts(spark, rows)
    for i, a in enumerate(articles):
        assert found[i] == "\n".join([a[0], *a])


def test_copies_of_an_article_stay(spark):
    rng = random.Random(2)
    same = [words(rng, 30) for _ in range(4)]
    other = [[words(rng, 30) for _ in range(3)] for _ in range(3)]
    rows = [(i, f"http://copies.example/{i}", soup(rng, same)) for i in range(20)]
    rows += [(100 + i, f"http://copies.example/o{i}", soup(rng, a)) for i, a in enumerate(other)]
    found = texts(spark, rows)
    for i in range(20):
        assert "\n".join(same) in found[i]
    for i, a in enumerate(other):
        assert "\n".join(a) in found[100 + i]


def test_marked_elements_go_and_references_are_decoded(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><div class="cookie-notice">We use cookies.</div><div id="ad-7">Buy &amp; sell</div>
<main><article class="post"><h2>A &lt;title&gt;</h2><p><b>One  two<br>three<p>Fish &amp; chips &copy; caf&eacute; &#8364;5 &am</p><ul><li>first<li>second</ul>
<form><label>Name</label><input></form><section class="comments"><article class="comment"><p>Nice!</p></article></section></article></main>
<aside>More</aside><footer>&copy; us</footer>"""
    found = texts(spark, [(1, "http://one.example/a", page), (2, None, page), (3, "not a url", page)])
    assert set(found.values()) == {"A <title>\nOne two three\nFish & chips © café €5 &am\nfirst\nsecond"}


def test_defined_results_for_odd_pages(spark):
    long = "<body><article>" + "".join(f"<p>w{i} &amp; x</p>" for i in range(30_000)) + "</article>"
    deep = "<div>" * 3000 + "bottom" + "</div>" * 3000
    rows = [(1, "http://h.example/1", None), (2, "http://h.example/2", ""), (3, None, "plain text only"), (4, "http://h.example/4", long), (5, "http://h.example/5", deep), (6, "http://h.example/6", "<p>a</p></div></p><p>b < c"), (7, "http://h.example/7", "<!-- open"), (6, "http://h.example/6", "<p>a</p></div></p><p>b < c")]
    df = spark.createDataFrame(rows, SCHEMA)
    extra = df.selectExpr("*", "page_id AS text", "page_id AS host", "page_id AS reference", "page_id AS n_chars")
    out = extract_pages(extra)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    found = out.collect()
    assert len(found) == 8 and all(r["n_chars"] == len(r["text"]) for r in found)
    by_id = {r["page_id"]: r["text"] for r in found}
    assert by_id[1] == by_id[2] == by_id[7] == "" and by_id[3] == "plain text only" and by_id[5] == "bottom" and by_id[6] == "a\nb < c"
    assert by_id[4].count("\n") == 29_999 and by_id[4].endswith("w29999 & x")
    assert extract_pages(df.limit(0)).count() == 0


def test_result_does_not_depend_on_the_cut_of_the_rows(spark):
    rng = random.Random(3)
    rows = [(i, f"http://cut.example/{i}", soup(rng, [words(rng, 15) for _ in range(3)])) for i in range(30)]
    one, many = spark.createDataFrame(rows, SCHEMA).coalesce(1), spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)
    assert sorted(map(tuple, extract_pages(one).collect())) == sorted(map(tuple, extract_pages(many).collect()))


def brute(a, b):
    """Most matched nodes of two trees by plain recursion."""
    if a.tag != b.tag:
        return 0

    def best(i, j):
        if i == len(a.children) or j == len(b.children):
            return 0
        w = brute(a.children[i], b.children[j])
        return max(best(i + 1, j), best(i, j + 1), w + best(i + 1, j + 1) if w else 0)

    return 1 + best(0, 0)


@pytest.mark.parametrize("seed", range(12))
def test_simple_tree_matching_has_the_most_nodes(seed):
    rng = random.Random(seed)

    def tree(depth):
        tag = rng.choice(["div", "section", "ul"])
        return f"<{tag}>{''.join(tree(depth - 1) for _ in range(rng.randint(0, 3)))}</{tag}>" if depth else ""

    a, b = parse(tree(3)), parse(tree(3))
    list(walk(a))
    met = match(a, b)
    assert len(met) == brute(a, b)
    assert len({id(n) for n in met.values()}) == len(met)


def test_wrapper_slot():
    page = parse("<body><div><p>short</p></div><div><div><p>long text of the page</p><p>more of the text</p></div></div></body>")
    nodes = list(walk(page))
    chars = [len(n.text) for n, *_ in nodes]
    slot = nodes[main_slot(nodes, chars)][0]
    assert [c.tag for c in slot.children] == ["p", "p"]
    assert extract(page, None) == "long text of the page\nmore of the text"


def test_wide_lists_are_matched_as_narrow_ones():
    """A long list whose like stands over 50 places further on: no size may switch to a coarser alignment."""
    own, more = "".join(f"<h2>a{i}</h2>" for i in range(500)), "".join(f"<p>x{i}</p>" for i in range(60))
    a, b = parse(f"<div>{own}</div>"), parse(f"<div>{more}{own}</div>")
    for root in (a, b):
        list(walk(root))
    found = match(a, b)
    assert sum(n.tag == "h2" for n in found.values()) == 500
