from conftest import CLASHING

from pyspark.sql import functions as F

from sluice.llm import html_text
from sluice.llm.html_text import extract_text, lines_of, main_text

LONG = "This is a sentence of the article with quite some words in it, and then some more."


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{x}}</style></head><body>{body}</body></html>"


def test_article_without_furniture():
    body = f"""<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav>
    <div class="cookie-notice">We use cookies, many of them, and we tell you so in a very long line of text here.</div>
    <article><h1>Title &amp; more</h1><p>{LONG}</p><script>var t="</p>";</script><p>Of  <b>bo</b>ld&nbsp;&copy;.<br>Line</p>
    <div class="ad">Buy this, it is a very good thing to buy for everyone and everything.</div><p>End.</p>
    <form><label>Name</label><input></form></article><aside>{LONG}</aside>
    <section id="comments"><p>{LONG}</p></section><footer>&copy; someone {LONG}</footer>"""
    assert main_text(page(body)) == f"Title & more {LONG} Of bold ©. Line End."


def test_links_alone_are_no_text():
    links = "".join(f'<li><a href="/{i}">a link of some length number {i}</a></li>' for i in range(30))
    assert main_text(page(f"<div><ul>{links}</ul></div><div></div>" + "<nav>x</nav>" + f"<p>{LONG}</p>")) == LONG


def test_broken_pages():
    assert main_text(page(f"<article><p><b>{LONG}<br><p>a < b & c &am")).startswith(f"{LONG} a < b & c &am")
    assert main_text(f"<article><p>{LONG}<footer>cut off") == LONG
    assert main_text(f"<p title='>'>{LONG}</p><!-- never closed") == LONG
    assert main_text(f"<p title=\">{LONG}</p><p>{LONG}</p>").endswith(LONG)
    assert main_text("") == main_text("<html><nav>a</nav></html>") == ""
    assert main_text("<article><p>Of.</p></article>") == "Of."
    assert main_text("<p hidden>no</p><p style='display: none'>no</p><p>yes</p>") == "yes"


def test_long_page():
    paragraphs = "".join(f"<p>{LONG} {i}</p>" for i in range(5000))
    assert main_text(page(paragraphs)) == " ".join(f"{LONG} {i}" for i in range(5000))
    assert len(lines_of("<" * 20_000, 3)[0]) == 1


def test_operator(spark):
    rows = [(1, None), (2, ""), (3, page(f"<article><p>{LONG}</p></article>")), (3, page("<p>é</p>"))]
    own = spark.createDataFrame(rows, "page_id long, html string").withColumns({c: F.lit(1) for c in (*CLASHING, "text", "n_chars")})
    found = sorted((r.id, r.text, r.n_chars) for r in extract_text(own).collect())
    assert found == [(1, "", 0), (2, "", 0), (3, LONG, len(LONG)), (3, "é", 1)]
    assert extract_text(own.where("false")).count() == 0


def test_names_that_only_contain_a_mark():
    for name in ("has-sidebar", "no-sidebar", "with-sidebar", "comment-open", "ad-free", "search-results"):
        assert main_text(page(f"<div class='{name}'><h1>Title</h1><p>{LONG}</p></div>")) == f"Title {LONG}", name
    assert main_text(page(f"<div class='page-sidebar'><p>{LONG}</p><p>{LONG} 2</p></div><p>Short.</p>")).startswith(f"{LONG} {LONG} 2")
    assert main_text(page(f"<div class='left-sidebar'>no</div><p>{LONG}</p>")) == LONG


def test_furniture_ends_with_its_parent():
    assert main_text(page(f"<p class='notice'>no<p>{LONG}")) == LONG
    assert main_text(page(f"<ul><li class='nav-item'>no<li>{LONG}</ul><p>More.</p>")) == f"{LONG} More."
    assert main_text(page(f"<div><div class='ad'>no</b></p><script>'</section>'</script></div></div><p>{LONG}</p>")) == LONG
    assert main_text(page(f"<section><div class='ad'>no</section><p>{LONG}</p>")) == LONG
    assert main_text(page(f"<div class='ad'>no<article><p>{LONG}</p></article>")).endswith(LONG)
    assert main_text(page(f"<div class='ad'>{LONG} {LONG}</div><article><p>Short.</p></article>")) == "Short."


def test_scripts_are_raw_text():
    for script in ("for(i=0;i<n;i++){}", 'var s="<script src=x>"', "x='<!--'", "</scripty>", "if(a</b/.test(c)){}"):
        assert main_text(page(f"<script>{script}</script><article><p>{LONG}</p></article>")) == LONG, script
    assert main_text(page(f"<p>{LONG}</p><script>never closed <p>no</p>")) == LONG
    assert main_text(f"<head><title>no<p></title><body><textarea><p>no</textarea><p>{LONG}</p>") == LONG


def test_headings_and_own_headers_stay():
    text = main_text(page(f"<article><header class='article-header'><h1 class='article-header'>Title</h1></header><p>{LONG}</p></article>"))
    assert text == f"Title {LONG}"
    assert main_text(page(f"<h2 id='search-engines'>Title</h2><section id='related-work'><p>{LONG}</p></section><math><mi>x</mi></math>")) == f"Title {LONG} x"


def test_distribution_without_names(monkeypatch):
    """Menus, teasers and footers that nothing names are told apart by the weights alone."""
    monkeypatch.setattr(html_text, "_hints", frozenset())
    links = "".join(f"<li><a href='/{i}'>{LONG}</a></li>" for i in range(5))
    body = f"<div><ul>{links}</ul></div><div><div>Buy it now.</div></div><div><div><div><h1>T</h1><p>{LONG} {LONG}</p><p>{LONG}</p><p>End.</p></div></div></div><div><div>All rights reserved</div></div>"
    assert main_text(page(body)) == f"T {LONG} {LONG} {LONG} End."
    assert main_text(page(body), window=50) == f"Buy it now. T {LONG} {LONG} {LONG} End. All rights reserved"
    assert main_text(page(body), surge=0, share=0) == f"Buy it now. T {LONG} {LONG} {LONG} End. All rights reserved"


def test_distribution_as_brute_force():
    """Pages of paragraphs, links and nested boxes: every line against the definition, over all pairs of lines."""
    import random

    for seed in range(300):
        chance = random.Random(seed)
        window, surge, share = chance.choice((1, 2, 3, 5)), chance.choice((0, 40, 80)), chance.choice((0, 0.2, 0.5))
        items, body = [], []
        for i in range(chance.randrange(1, 14)):
            kind = chance.choice("pplg")
            if kind == "g":
                boxes = chance.randrange(1, 4)
                body.append("<div></div>" * boxes)
                items += [("", 0)] * 2 * boxes if items else []
            else:
                text = f"{i} " + "x" * chance.choice((3, 30, 200))
                body.append(f"<p>{text}</p>" if kind == "p" else f"<p><a href=x>{text}</a></p>")
                items.append((text, len(text) - 1 if kind == "p" else 0))
        texts = [i for i, (_, n) in enumerate(items) if n]
        dive = lambda a, b: any(all(n == 0 for _, n in items[k : k + window]) for k in range(a, b - window + 1))
        groups = {i: [j for j in texts if not dive(min(i, j), max(i, j) + 1)] for i in texts}
        weight = {i: max(sum(n for _, n in items[k : k + window] if k >= g[0]) if k + window <= g[-1] + 1 else sum(n for _, n in items[k : g[-1] + 1]) for k in range(g[0], g[-1] + 1)) for i, g in groups.items()}
        peak = max(weight.values(), default=0)
        need = max(min(surge, peak / 2), share * peak)
        surged = [i for i in texts if weight[i] >= need]
        kept = {k for i in texts if surged and surged[0] <= i <= surged[-1] for k in range(groups[i][0], groups[i][-1] + 1)}
        assert main_text("".join(body), window, surge, share) == " ".join(items[k][0] for k in sorted(kept) if items[k][0]), seed


def test_deep_and_unclosed():
    assert main_text("<div>" * 30_000 + f"<p>{LONG}" + "</b>" * 30_000) == LONG
    assert main_text(f"<table><tr><td>{LONG}<td>{LONG}<tr><td>c</table>") == f"{LONG} {LONG} c"
    assert main_text(f"<a href=x>menu<p>{LONG}</p></div><p>{LONG}</p>").endswith(LONG)
    assert main_text(f"<div><a href=x>menu</div><p>{LONG}</p>").endswith(LONG)


def test_headings_and_short_boxes_between_long_ones_stay():
    box = lambda x: f"<div><div>{x}</div></div>"
    titled = "".join(box(f"<h2>Heading {i}</h2>") + box(f"<p>{LONG} {LONG} {i}</p>") for i in range(2))
    assert main_text(page(titled)) == f"Heading 0 {LONG} {LONG} 0 Heading 1 {LONG} {LONG} 1"
    said = box(f"<p>{LONG} {LONG}</p>") + box("<p>They said no.</p>") + box(f"<p>{LONG} {LONG}</p>")
    assert main_text(page(box("<p>Menu</p>") + said + box("<p>Imprint</p>"))) == f"{LONG} {LONG} They said no. {LONG} {LONG}"


def test_every_article_counts_and_main_is_one():
    assert main_text(page(f"<article><p>{LONG} {LONG}</p></article><article><p>Short news.</p></article>")) == f"{LONG} {LONG} Short news."
    comments = "<section class=comments>" + f"<p>{LONG}</p>" * 8 + "</section>"
    assert main_text(page(f"<main><p>{LONG}</p><p>{LONG} 2</p>{comments}</main>")) == f"{LONG} {LONG} 2"
    assert main_text(page(f"<main><article><p>{LONG}</p>{comments}</article><div>More</div></main>")) == f"{LONG} More"
    assert main_text(page(f"<div>Please accept our cookies, all of them, for ever and in every browser you use.</div><article><p>{LONG[:40]}</p></article>")) == LONG[:40]
    teaser = "<article><p>Read on.</p></article>"
    assert main_text(page(f"{teaser}<div><div><p>{LONG} {LONG} {LONG}</p></div></div>")) == f"Read on. {LONG} {LONG} {LONG}"
