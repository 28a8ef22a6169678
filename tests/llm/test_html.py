"""Main text: the template at work, and what browsers make of odd markup."""

import numpy as np
import pytest

from vexel.llm import html

VOCAB = ["".join(np.random.default_rng(i).choice(list("abcdeéñ"), 2 + i % 6)) for i in range(300)]
SCHEMA = "page_id long, url string, html string, host string, text string, container string"


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], SCHEMA)
    return {r.page_id: r.text for r in html.extract(df).collect()}


BOXES = """<html><body><div><p>Welcome</p></div><article><h1>{t}</h1><div><p>Written by the staff of this place</p></div><p>{a}</p><p>{b}</p>
<div><div><a href=1>{c}</a><span> - </span></div><div><a href=2>{d}</a><span> - </span></div>{e}</div><div><p>Like it? Tell your friends</p></div></article></body></html>"""


def test_template_in_the_article(spark):
    """Constant boxes and a list of links inside the article, told by nothing but the occurrence vectors."""
    item = "<div><a href=3>{}</a><span> - </span></div>"
    rows = [(i, "http://site.example/p", BOXES.format(t=prose(4, i), a=prose(40, 50 + i), b=prose(30, 90 + i), c=prose(3, 130 + i), d=prose(3, 170 + i), e="".join(item.format(prose(3, 900 + 10 * i + k)) for k in range(i % 3)))) for i in range(9)]
    got = run(spark, rows)
    assert got == {i: f"{prose(4, i)} {prose(40, 50 + i)} {prose(30, 90 + i)}" for i in range(9)}
    alone = html.main_text(rows[0][2])  # without the template all of it stays
    assert "Written by the staff" in alone and "Tell your friends" in alone and prose(3, 130) in alone


def test_copies_make_no_template(spark):
    page = BOXES.format(t="t", a=prose(40, 1), b=prose(30, 2), c="c", d="d", e="")
    got = run(spark, [(i, "http://copies.example/p", page) for i in range(8)])
    assert all(prose(40, 1) in x and prose(30, 2) in x for x in got.values())


def test_versions_of_one_article_stay(spark):
    same = [prose(40, 10 + k) for k in range(6)]
    page = "<html><body><div><p>Welcome</p></div><article><h1>{}</h1>" + "".join(f"<p>{x}</p>" for x in same) + "<p>{}</p></article></body></html>"
    got = run(spark, [(i, "http://versions.example/p", page.format(prose(4, i), prose(20, 40 + i))) for i in range(8)])
    assert got[3] == " ".join([prose(4, 3), *same, prose(20, 43)])


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="content no-sidebar"><p>Hello world text</p></div>', "Hello world text"),
        ('<article class="post has-comments"><p>A</p></article>', "A"),
        ('<article><p class="notice-board">A</p><p>B</p></article>', "A B"),
        ('<article><p>A</p><div class="cookie-notice">x</div><div id="commentList2">y</div><div class="site-footer wide">z</div></article>', "A"),
        ('<p class="x>Hello</p><p>More text</p>', ""),
        ('<p>One</p><p class="x>Hello</p><p title="y">More text</p>', "One More text"),
        ("<p title=it's>One <a href=a\"b>two</a></p><p>three's</p>", "One two three's"),
        ('<p title="a > b">One</p><p title = \'c > "d\'>two</p>', "One two"),
        ("<p>One</p><!-- x --!><p>two</p><!-- open <p>three", "One two"),
        ("a < b and c &lt; d<br/>e", "a < b and c < d e"),
        ("<p>One</p><p cut", "One"),
        ("", ""),
        (None, ""),
    ],
)
def test_markup(page, text):
    assert html.main_text(page) == text


def test_long_page(spark):
    page = "<html><body><nav>x</nav><article>" + "".join(f"<p>{prose(50, i)}</p>" for i in range(3000)) + "</article></body></html>"
    assert run(spark, [(1, None, page), (1, None, page)])[1] == " ".join(prose(50, i) for i in range(3000))


def test_joined_templates(spark, monkeypatch):
    monkeypatch.setattr(html, "TEMPLATE_BYTES", 0)
    monkeypatch.setattr(html, "COPIES", -1)
    test_template_in_the_article(spark)


RECIPE = """<html><body><div class="top"><ul><li><a href=1>Start</a></li><li><a href=2>All recipes</a></li><li><a href=3>Us</a></li></ul></div>
<div class="page"><article><h1>{t}</h1><p>{a}</p><h2>Ingredients</h2><p>{b}</p><h2>Method</h2><p>{c}</p><p>Serve at once, with a little salt.</p><p>{d}</p>
<p>Sources:</p><ul><li><a href=4>Annual report {y}</a></li><li><a href=5>Census data {y}</a></li><li><a href=6>{e}</a></li></ul></article></div><div>All rights kept by us</div></body></html>"""


def test_recurring_headings_sentences_and_sources_stay(spark):
    p = [[prose(n, 1000 * i + n) for n in (4, 31, 22, 33, 14, 3)] for i in range(10)]
    got = run(spark, [(i, "http://cook.example/p", RECIPE.format(y=1990 + i, **dict(zip("tabcde", x, strict=True)))) for i, x in enumerate(p)])
    for i, (t, a, b, c, d, e) in enumerate(p):
        assert got[i] == f"{t} {a} Ingredients {b} Method {c} Serve at once, with a little salt. {d} Sources: Annual report {1990 + i} Census data {1990 + i} {e}"


def test_a_long_comment_never_wins_over_a_short_article(spark):
    page = '<html><body><main><article class="post"><h1>{}</h1><p>{}</p></article><section class="{}"><article class="{}"><p>{}</p></article>{}</section></main></body></html>'
    for section, name in (("responses", "response"), ("x1", "x2")):
        rows = [(i, f"http://{name}.example/p", page.format(prose(3, i), prose(9, 30 + i), section, name, prose(200, 60 + i), f'<article class="{name}"><p>again {i}</p></article>' * (i % 3))) for i in range(8)]
        rows = [(i, u, h.replace("<main>", "<div>").replace("</main>", "</div>")) for i, u, h in rows]
        got = run(spark, rows)
        want = {i: f"{prose(3, i)} {prose(9, 30 + i)}" for i in range(8)}
        if section == "responses":  # told by its name, without a template too
            assert got == want and html.main_text(rows[0][2]) == want[0]
        else:  # told by the template: the article comes once on every page, comments as often as they like
            assert {i: x for i, x in got.items()} == want


def test_short_articles_beside_long_ones_stay():
    page = f"<article><p>{prose(100, 1)}</p></article><article><p>{prose(10, 2)}</p></article>"
    assert html.main_text(page) == f"{prose(100, 1)} {prose(10, 2)}"
    assert html.main_text("<article><p>Sources:</p><ul><li><a>Annual report</a><li><a>Census data</a><li><a>Interview notes</a></ul></article>") == "Sources: Annual report Census data Interview notes"
    assert html.main_text('<article><p>A</p><div class="cta-banner">x</div></article>') == "A"


def test_classes_by_signature_equal_classes_by_gathered_vectors(spark):
    """Brute force: every role's vector of counts over the pages, side by side; equal vectors are one class."""
    item = "<div><a href=3>{}</a><span> - </span></div>"
    pages = [BOXES.format(t=prose(4, i), a=prose(40, 50 + i), b=prose(30, 90 + i), c="c", d="d", e="".join(item.format(f"x{i}{k}") for k in range(i % 4))) + f"<p>{'tail' if i % 2 else 'end'}</p>" * (i % 3) for i in range(14)]
    df = spark.createDataFrame([(i, "h", p) for i, p in enumerate(pages)], "page_id long, host string, html string")
    got = html.occurrences(df.repartition(5)).collect()
    vectors = {}
    for i, p in enumerate(pages):
        for role, (n, *_) in html.roles(html.parse(p)).items():
            vectors.setdefault(role, [0] * len(pages))[i] = n
    assert {r.role for r in got} == {*vectors, ""}
    by_sig, by_vector = {}, {}
    for r in got:
        if r.role:
            v = vectors[r.role]
            assert (r.pages, r.most, r.least, r.total) == (sum(n > 0 for n in v), max(v), min(n for n in v if n), sum(v))
            by_sig.setdefault(r.sig, set()).add(r.role)
            by_vector.setdefault(tuple(v), set()).add(r.role)
    assert sorted(map(sorted, by_sig.values())) == sorted(map(sorted, by_vector.values())) and len(by_vector) > 8
