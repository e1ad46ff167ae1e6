"""Main texts of pages: what names may decide, headlines, comments, independence of order and partitions, growth."""

import random
import time

import pytest

from grantmill.llm import html_text


def texts_of(spark, pages, parts=3, url="http://a.example/x"):
    rows = [(k, url, p) for k, p in enumerate(pages)]
    found = html_text.report(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)).collect()
    return {r.page_id: r.text for r in found}


def prose(k, n=30):
    rng = random.Random(k)
    return " ".join("".join(rng.choices("aeioubdfgklmnrst", k=rng.randint(2, 8))) for _ in range(n)) + "."


@pytest.mark.parametrize("name", ["content no-sidebar", "has-sidebar", "menu-open", "sharing-enabled", "content-with-widget", "search", "page-wrapper ad"])
@pytest.mark.parametrize("pages", [1, 6])
def test_names_hide_no_ancestor_of_the_article(spark, name, pages):
    made = [f'<html><body class="with-menu"><div class="{name}"><article><h1>Head {k}</h1><p>{prose(k)}</p></article></div></body></html>' for k in range(pages)]
    assert texts_of(spark, made) == {k: f"Head {k}\n{prose(k)}" for k in range(pages)}


def test_a_form_around_the_page_hides_nothing(spark):
    made = [f'<body><form id="aspnetForm"><div class="x"><h1>Head {k}</h1><p>{prose(k)}</p></div><form class="search"><p>find</p></form></form></body>' for k in range(2)]
    assert texts_of(spark, made) == {k: f"Head {k}\n{prose(k)}" for k in range(2)}


def test_blocks_by_name(spark):
    block = '<div class="{}"><p>{}</p></div>'
    kept = ["related-work", "history-of-advertising-law", "comment-free-zone", "menu-open"]
    gone = ["ad", "cookie-notice", "reader-comments", "sidebar-left", "ad-slot", "share buttons", "site-footer", "widget_area"]
    made = ["<body><article><p>" + prose(k) + "</p>" + "".join(block.format(n, f"{n.replace('-', ' ')} {k}") for n in kept + gone) + "</article></body>" for k in range(4)]
    assert texts_of(spark, made) == {k: "\n".join([prose(k), *(f"{n.replace('-', ' ')} {k}" for n in kept)]) for k in range(4)}


@pytest.mark.parametrize("pages", [1, 5])
def test_articles_that_are_comments(spark, pages):
    remark = lambda k: f'<article class="comment"><p>reader comment {k} {prose(k + 100, 9)}</p></article>'
    inside = [f'<body><article><p>main {k} {prose(k)}</p>{remark(k)}{remark(k + 1)}</article></body>' for k in range(pages)]
    after = [f'<body><article><p>main {k} {prose(k)}</p></article><section id="comments">{remark(k)}<article><p>unnamed</p></article></section></body>' for k in range(pages)]
    long = [f'<body><article><p>main {k} {prose(k)}</p></article>{"".join(remark(k + j) for j in range(40))}</body>' for k in range(pages)]
    for made in (inside, after, long):
        assert texts_of(spark, made) == {k: f"main {k} {prose(k)}" for k in range(pages)}


def test_fixed_headlines_stay_where_text_follows(spark):
    made = [f'<body><div class="recipe"><h1>Dish {k}</h1><h2>Ingredients</h2><p>{prose(k)}</p><h2>Method</h2><p>{prose(k + 50)}</p><div><p>Printed from our site</p></div><h3>Share this</h3></div></body>' for k in range(6)]
    assert texts_of(spark, made) == {k: f"Dish {k}\nIngredients\n{prose(k)}\nMethod\n{prose(k + 50)}" for k in range(6)}


def varied(k):
    rng = random.Random(k)
    blocks = [f"<p>{prose(k * 7 + j, 12)}</p>" for j in range(rng.randint(1, 4))]
    blocks += rng.sample(["<h2>Sources</h2>", f"<ul><li><a href='/'>{prose(k, 2)}</a></li></ul>", "<p>All rights reserved</p>", f"<div class='m{rng.randint(0, 2)}'><p>{prose(k + 9, 4)}</p></div>", "<table><tr><td>cell</td></tr></table>"], rng.randint(0, 4))
    rng.shuffle(blocks)
    body = f"<div class='main v{'xyz'[k % 3]}'>{''.join(blocks)}</div>"
    if rng.random() < 0.3:
        body = f"<div class='m'>{body}</div>"
    return f"<html><body>{'<div><p>Welcome</p></div>' * rng.randint(0, 1)}{body}<div class='end'><p>Imprint {k % 2}</p></div></body></html>"


def test_texts_depend_on_neither_order_nor_partitions(spark, monkeypatch):
    monkeypatch.setattr(html_text, "BUCKET", 4)
    monkeypatch.setattr(html_text, "ROUND_BITS", 2)
    made = [varied(k) for k in range(60)]
    first = texts_of(spark, made, 1)
    for parts, seed in ((2, 1), (5, 2), (8, 3)):
        order = [*range(60)]
        random.Random(seed).shuffle(order)
        got = texts_of(spark, [made[k] for k in order] + made[:7], parts)  # and some rows repeated
        assert {order[k]: t for k, t in got.items() if k < 60} == first
    assert all(first.values())


def test_wrappers_stay_as_small_as_pages_whatever_the_names():
    def page(k):
        rng = random.Random(k)
        return "<body>" + "".join(f'<div class="c{"".join(rng.choices("abcdefghij", k=9))}"><p>{prose(k * 10 + j, 6)}</p></div>' for j in range(10)) + "</body>"

    labels = {"body", "html", "p"}  # what SUPPORT pages have
    sizes, seconds = [], []
    for n in (50, 200):
        began = time.perf_counter()
        wrapper = None
        for k in range(n):
            own = html_text._shape(html_text.parse(page(k), labels), k)
            wrapper = own if wrapper is None else html_text._merge(wrapper, own)
        seconds.append(time.perf_counter() - began)
        sizes.append(len(html_text._json(wrapper)))
    assert sizes[1] <= sizes[0] * 1.1 and seconds[1] < seconds[0] * 10


def test_rare_names_are_left_out_of_account(spark):
    pages = [f'<body><div class="main gen{chr(97 + k // 26)}{chr(97 + k % 26)}"><p>{prose(k)}</p></div><div class="foot"><p>Imprint</p></div></body>' for k in range(50)]
    df = spark.createDataFrame([("h", p) for p in pages + pages[:5]] + [("few", pages[0])], "host string, html string")
    found = {r.host: (r.n, r.labels) for r in html_text.hosts(df).collect()}
    assert found == {"h": (50, ["div foot"]), "few": (1, [])}
    assert texts_of(spark, pages) == {k: prose(k) for k in range(50)}


def test_callers_columns_may_have_any_names(spark):
    df = spark.createDataFrame([(1, "http://a/", "<p>x</p>", "h", "l", "old")], "page_id long, url string, html string, _host string, labels string, text string").withColumnRenamed("labels", "_labels")
    out = html_text.extract_text(df)
    assert out.columns == ["page_id", "url", "html", "_host", "_labels", "text", "n_chars"] and tuple(out.first()) == (1, "http://a/", "<p>x</p>", "h", "l", "x", 1)
