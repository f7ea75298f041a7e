import math
import time
from collections import Counter

import pytest

from plumeline.llm import site_tree

FULL = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad -->
<div class="ad">Buy</div><div id="cookie-banner">Cookies?</div><article><h1>Title &amp; more</h1><p><b>Lead</b>ing&nbsp;text.<br><p>Second
 line</p><ul><li>one<li>two</ul><form><input>Search</form><aside>Side</aside><section class="comments"><p>Nice!</p></section></article><footer>&copy; x</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")


def texts(found):
    return {r.page_id: (r.text, r.n_chars) for r in found.collect()}


def test_article_without_noise(spark):
    found = texts(site_tree.extract(pages(spark, [(1, "http://a/1", FULL), (2, None, None), (3, "http://a/2", ""), (4, "x", "plain <b>te</b>xt"), (1, "http://a/1", FULL)])))
    want = "Title & more Leading text. Second line one two"
    assert found == {1: (want, len(want)), 2: ("", 0), 3: ("", 0), 4: ("plain text", 10)}
    assert site_tree.extract(pages(spark, [])).isEmpty()


PLAIN = "<html><head><title>Page {}</title></head><body><div><p>{}</p></div><section><p>Same words on all pages</p></section></body></html>"


def site(pages_of, host="h.example"):
    return [(i, f"https://{host}/{i}", PLAIN.format(i, t)) for i, t in enumerate(pages_of)]


@pytest.mark.parametrize("limit", [0, 100_000])
def test_repeated_branches_go_by_entropy(spark, monkeypatch, limit):
    """Pages that mark nothing: what a host repeats is no content, what differs is; another host's pages do not count."""
    monkeypatch.setattr(site_tree, "BROADCAST_BRANCHES", limit)
    rows = site([f"own text {i}" for i in range(30)]) + [(99, "https://other.example/", PLAIN.format(0, "single"))]
    found = texts(site_tree.extract(pages(spark, rows)))
    assert {found[i][0] for i in range(30)} == {f"own text {i}" for i in range(30)}
    assert found[99][0] == "single Same words on all pages"


def test_without_entropy_the_repeated_branch_stays(spark, monkeypatch):
    """The priors alone decide nothing here: with all counts ignored the words of the site come back."""
    monkeypatch.setattr(site_tree, "PRIOR_PAGES", 1e9)
    found = texts(site_tree.extract(pages(spark, site([f"own text {i}" for i in range(30)]))))
    assert found[3][0] == "own text 3 Same words on all pages"


def test_tree_inside_articles(spark):
    """The tree removes from an article what nearly all pages of the host have, and no passage that a part of them shares, no heading and no copy."""
    page = "<html><head><title>T {}</title></head><body><article><h2>Introduction</h2><p>{}</p><p>{}</p><div><p>Read more on our site.</p></div></article></body></html>"
    rows = [(i, f"http://h/{i}", page.format(i, f"text {i}", "A passage that every third page has" if i % 3 == 0 else f"other {i}")) for i in range(40)]
    rows += [(100 + i, "http://h/copy", page.format("copy", "the same article", "in all its parts")) for i in range(200)]
    found = texts(site_tree.extract(pages(spark, rows)))
    assert found[3][0] == "Introduction text 3 A passage that every third page has"
    assert found[4][0] == "Introduction text 4 other 4"
    assert found[150][0] == "Introduction the same article in all its parts"


def test_importance_equals_definition(spark):
    """Counts, entropies and importance of every branch against plain Python."""
    rows = site(["a", "a", "b", "c", "c", "c"]) + site(["x", "y"], "two.example") + [(7, None, PLAIN.format("n", "a"))] * 2
    branch = {}
    for host, group in (("h.example", rows[:6]), ("two.example", rows[6:8]), ("", rows[8:])):
        seen = {}
        for _, _, html in group:
            root = site_tree.parse(html)
            site_tree.set_contents(root)
            for node in site_tree.branches(root):
                seen.setdefault(node.path, {}).setdefault((site_tree.branch_key(node), node.prior), {})[site_tree.title_of(html)] = ",".join(c.label for c in node.children if not isinstance(c, str))
        for contents in seen.values():
            looks = {t: l for own in contents.values() for t, l in own.items()}
            m, kinds = len(looks), Counter(looks.values())
            entropy = -sum(k / m * math.log2(k / m) for k in kinds.values()) / math.log2(max(2, m))
            for (key, prior), own in contents.items():
                if len(own) > 1:
                    measured = 0.8 * (1 - math.log2(len(own)) / math.log2(max(2, m))) + 0.2 * entropy
                    branch[host, key] = (m / (m + 4) * measured + 4 / (m + 4) * prior, len(own), m)
    given = spark.createDataFrame([(h, r[2]) for h, own in (("h.example", rows[:6]), ("two.example", rows[6:8]), ("", rows[8:])) for r in own], "host string, html string")
    found = {(r.host, r.branch): (r.importance, r.n, r.m) for r in site_tree.style_tree(given).collect()}
    assert found.keys() == branch.keys() and found
    for key, (importance, n, m) in branch.items():
        assert found[key] == (pytest.approx(importance), n, m)


def test_repeated_articles_stay(spark):
    found = texts(site_tree.extract(pages(spark, [(i, "http://h/", FULL) for i in range(20)])))
    assert {t for t, _ in found.values()} == {"Title & more Leading text. Second line one two"}


def test_names():
    """Slugs of headings and sections are no noise; comments are, though they are articles."""
    body = '<article><h2 id="related-work">R</h2><section id="social-history"><p>S</p></section><h3 id="menu">M</h3><div class="share-buttons">x</div><div class="adSlot">x</div><section id="comments">x</section><article class="comment">x</article><p>end</p></article>'
    assert site_tree.main_text(body, set()) == "R S M end"
    assert site_tree.main_text('<div role="navigation">x</div><div class="story">kept<div id="cookie-banner">x</div></div><div aria-hidden="true">x</div>', set()) == "kept"


def test_nulls_and_keys(spark):
    found = site_tree.extract(pages(spark, [(None, None, FULL), (2**60 + 1, "no url", FULL), (2**60 + 1, "no url", None)])).collect()
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in found) == [(0, True), (2**60 + 1, False), (2**60 + 1, True)]


def test_broken_markup():
    deep = "<div>" * 3000 + "deep" + "</div>" * 10
    assert site_tree.main_text("<p>a<script>if (a<b) {}", set()) == "a"
    assert site_tree.main_text("a < b <p x='>'>c</q> &#233;&lt;", set()) == "a < b c é<"
    assert site_tree.main_text("<!-- open", set()) == ""
    assert site_tree.main_text(deep, set()) == "deep"
    assert site_tree.main_text("\u0130" * 40 + "<script>x</SCRIPT ><p>after</p>", set()) == "\u0130" * 40 + " after"
    assert site_tree.main_text('<p title="open>text</p><p>more</p>', set()) == "text more"
    assert site_tree.main_text("<![CDATA[a <b>]]> c</p", set()) == "a <b> c"


@pytest.mark.parametrize("part", ['<a "', '<a b="', "<div>", "<b><p>", "<", "<!--", "</q>", "<li>", "<script>", "<p x='>"])
def test_time_is_linear(part):
    took = []
    for n in (20_000, 80_000):
        began = time.perf_counter()
        site_tree.main_text(part * n, {1})
        took.append(time.perf_counter() - began)
    assert took[1] < 12 * took[0] + 0.5
