import html
import itertools
import random
import re

from foliant.llm import html_extract as op
from tests.conftest import MEDIUM


def cost(labels, unary, links):
    cut = sum(w for a, b, w in links if labels[a] != labels[b])
    return cut + sum(abs(u) for u, x in zip(unary, labels, strict=True) if x != (u > 0) and u)


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(150):
        n = rng.randint(1, 8)
        unary = [rng.uniform(-2, 2) for _ in range(n)]
        links = [
            (a, b, rng.uniform(0, 1.5)) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5
        ]
        best = min(cost(x, unary, links) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(op.minimum_cut(unary, links), unary, links) - best) < 1e-9


def test_flow_alone_is_minimal():
    unary = [0.4, -0.3, 0.2, -0.25, 0.1]
    links = [(0, 1, 0.5), (1, 2, 0.5), (2, 3, 0.5), (3, 4, 0.5), (0, 3, 0.2)]
    best = min(cost(x, unary, links) for x in itertools.product([False, True], repeat=5))
    assert abs(cost(op.minimum_cut(unary, links), unary, links) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="<p>x</p>"</script></head><body>
<header class=top><a href=/>Home</a> Site</header><nav><ul><li><a>one</a><li><a>two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies to make this better. Accept them now, please.</p></div>
<div id=main><article class="post"><header class="entry-header"><h1>The title</h1></header>
<p>First &eacute;t&eacute; &#8212; text  with a <a href=x>link</a>
in it.<p>Second one<br>with break.<div class=advert>Buy this now, it is cheap.</div>
<ul><li>item one<li>item two</ul></article>
<aside><p>Related: a long story that is told elsewhere, in another place.</p></aside>
<form>Name <input name=x><label>mail</label><button>Go</button></form>
<section id=comments><div class=comment><p>I like this article very much, thanks for it. It was great.</p></div>
</section></div><footer><p>Copyright of all.</p></footer></body></html>"""


def test_page_with_everything():
    assert op.main_text(PAGE).split("\n\n") == [
        "The title",
        "First été — text with a link in it.",
        "Second one with break.",
        "item one",
        "item two",
    ]


def test_odd_pages():
    assert op.main_text("") == ""
    assert op.main_text("<script>x</script><style>y</style><!-- z -->") == ""
    assert op.main_text("<nav><a>a</a></nav>") == ""
    plain = "Just a text without any markup, but with a sentence that is long enough to be one."
    assert op.main_text(plain) == plain
    assert op.main_text("<article><p>Open and never closed. It is a text <b>that goes on") == (
        "Open and never closed. It is a text that goes on"
    )
    long = "word " * 200_000
    assert op.main_text(f"<article><p>{long}</p></article>") == long.strip()


LONG = "This is a sentence of the article that says a little more than the one before it. " * 12


def test_head_left_open():
    for body in ("<body>", "", "<body class=x>"):
        page = f"<html><head><meta charset=utf-8><title>t</title><style>p{{}}</style>{body}<article><p>{LONG}</p></article>"
        assert op.main_text(page) == LONG.strip()
    assert op.main_text(f"<head><title>t</title><script>var a;</script></head><p>{LONG}</p>") == LONG.strip()


def test_article_below_badly_named_wrappers_and_forms():
    article = f"<article><h1>The title</h1><p>{LONG}</p><p>{LONG}</p></article>"
    want = "\n\n".join(["The title", LONG.strip(), LONG.strip()])
    nav = "<nav><a href=/>Home</a></nav><div class=related><p>Read this other story too, it is good.</p></div>"
    for before, after in (
        ("<div class='content has-sidebar'>", "</div>"), ("<div class='with-sidebar'>", "</div>"),
        ("<form action=/>", "</form>"), ("<div class=no-header><form><div class=has-widgets>", "</div></form></div>"),
    ):
        assert op.main_text(f"<body>{before}{nav}{article}{after}</body>") == want
        assert op.main_text(f"<body>{before}{nav}<main>{article}</main>{after}</body>") == want
    assert op.main_text(f"<div class='page sidebar'>{nav}<main>{article}</main></div>") == want
    teasers = "<article><p>A short teaser of something else, told elsewhere.</p></article>" * 3
    assert op.main_text(f"{article}<div class=related-posts>{teasers}</div><section id=comments>{teasers}</section>") == want
    for outer in ("aside", "nav", "footer"):
        assert op.main_text(f"<{outer}><article><p>A short teaser of something else.</p></article></{outer}>") == ""
    assert op.main_text(f"<article><p>{LONG}</p><div class=comments><article class=comment><p>I like it very much.</p></article></div></article>") == LONG.strip()


def test_given_pages(spark):
    rows = spark.read.parquet(f"{MEDIUM}/pages.parquet")
    got = {r["page_id"]: r["text"] for r in op.extract(rows).collect()}
    for r in rows.collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)


def test_table_cases(spark):
    rows = [(1, "u", None), (1, "u", None), (None, None, "<article><p>Some text here, that is it.</p></article>"), (2, "v", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = op.extract(df).collect()
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in got) == [
        (0, "Some text here, that is it.", 27), (1, "", 0), (1, "", 0), (2, "", 0),
    ]
    assert op.extract(df.limit(0)).count() == 0
