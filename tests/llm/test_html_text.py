import time

from ledgerlens.llm.html_text import extract, main_text

LONG = "This paragraph has quite a few words, so that its ratio of text to tags is high. " * 3
ARTICLE = f"<h1>A   title &amp; more</h1><p>{LONG}</p><p>Short.</p><p>{LONG}<br>after <b>bold<p>{LONG}</p>"
WANT = ["A title & more", LONG.strip(), "Short.", f"{LONG.strip()} after bold", LONG.strip()]
NOISE = [
    '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">Other pages</a></li></ul></nav>',
    "<header><p>The site's header line</p></header>",
    '<div class="cookie-banner"><p>We use cookies on this site, please do accept all of them now.</p></div>',
    '<div id="sidebar"><p>Read these other articles which are also quite long and wordy.</p></div>',
    '<div class="ad">Buy this thing</div>',
    "<form><label>Your mail</label><input></form>",
    "<aside>Related</aside>",
]
AFTER = [
    '<section class="comments"><h2>Comments</h2><p>A reader wrote a rather long comment that is no part of the article at all.</p></section>',
    "<footer>&copy; someone</footer>",
    "<script>var a = '<p>x</p>';</script><style>p{margin:0}</style>",
]


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>x</style></head><body>{''.join(NOISE)}{body}{''.join(AFTER)}</body></html>"


def test_article_element():
    assert main_text(page(f"<article>{ARTICLE}</article>")).split("\n\n") == WANT


def test_without_article_element():
    assert main_text(page(f'<div class="post">{ARTICLE}</div>')).split("\n\n") == WANT
    assert main_text(page(f"<main><div>{ARTICLE}</div></main>")).split("\n\n") == WANT


def test_noise_inside_the_article():
    inner = ARTICLE.replace("<p>Short.</p>", '<p>Short.</p><div class="advert">Buy now</div><!-- x --><figure><script>1</script></figure>')
    assert main_text(page(f"<article>{inner}</article>")).split("\n\n") == WANT


def test_links_and_headers_of_the_article_stay():
    body = f'<article><div class="entry-header"><h1>Title</h1></div><p>{LONG}</p><p><a href="/x">A linked line</a></p><ol class="commentlist"><li>Nice!</li></ol></article>'
    assert main_text(page(body)).split("\n\n") == ["Title", LONG.strip(), "A linked line"]
    tail = f'<div><h2>Head</h2><p>{LONG}</p><p>{LONG}</p><p>a</p><p>b</p><p>c</p><p>The end.</p></div>'
    assert main_text(page(tail)).split("\n\n") == ["Head", LONG.strip(), LONG.strip(), "a", "b", "c", "The end."]


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == main_text("<<<>>") * 0 == ""
    assert main_text("just text &lt;b&gt; &#233;&nbsp;x") == "just text <b> é x"
    assert main_text("<p>unclosed <b>bold") == "unclosed bold"
    assert main_text("<head><title>t</title><body><p>no end of head</p>") == "no end of head"
    assert main_text(f"<article><p>{'word ' * 100000}</p></article>") == ("word " * 100000).strip()


def test_extract(spark):
    rows = [(1, "u", page(f"<article>{ARTICLE}</article>"), "old"), (2, None, None, None), (None, "u", "", ""), (1, "u", page(f"<article>{ARTICLE}</article>"), "old")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extract(df).collect()
    assert sorted(r.n_chars for r in got) == sorted([0, 0, *[len("\n\n".join(WANT))] * 2])
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    assert extract(df.limit(0)).count() == 0


def test_wrappers_do_not_hide_the_article():
    story = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
    want = ["Title", LONG.strip(), "Short.", LONG.strip()]
    for around in ("<form action='/'>%s</form>", '<div class="content has-sidebar">%s</div>', '<div class="page-with-sidebar no-comments">%s</div>', '<div class="withMenu">%s</div>', '<div id="page-header-wrap">%s</div>'):
        for inner in ("<article>%s</article>", "<div>%s</div>"):
            assert main_text(page(around % (inner % story))).split("\n\n") == want, (around, inner)
    assert main_text(f"<form><article>{story}</article><div class='sidebar'><p>{LONG}</p></div><input></form>").split("\n\n") == want


def test_reader_comments_drop_in_any_element():
    story = f"<article><h1>Title</h1><p>{LONG}</p></article>"
    comments = "".join(f'<article class="{name}"><p>{LONG}</p></article>' for name in ("comment", "comment-body", "user comment"))
    for body in (story + comments, story + f'<div class="comments">{comments}</div>', story + f'<section id="respond"><article><p>{LONG}</p></article></section>'):
        assert main_text(page(body)).split("\n\n") == ["Title", LONG.strip()]
    assert main_text(page(f'<article class="post comments-open"><p>{LONG}</p></article>')) == LONG.strip()


def test_the_cluster_chooses_not_the_element():
    promo = "<article><p>Buy a</p></article>"
    story = f"<div><h2>Title</h2><p>{LONG}</p><p>{LONG}</p></div>"
    for body in (promo + story, story + promo):
        assert main_text(page(body)).split("\n\n") == ["Title", LONG.strip(), LONG.strip()]


def test_time_follows_the_length_of_odd_pages():
    began = time.process_time()
    for html in ("<div>" * 100_000 + "x", "<b>a" * 100_000, "<p>a</i>" * 100_000, "<li><div>" * 50_000, '<div class="ad"><form>' * 50_000, "<article>a" * 50_000):
        main_text(html)
    assert time.process_time() - began < 60
    assert main_text("<b>a" * 30_000) == "a" * 30_000


def test_clashing_columns_and_kept_html(spark):
    df = spark.createDataFrame([("u", f"<p>{LONG}</p>", "old", 3)], "__html string, html string, text string, n_chars int")
    assert [r.asDict() for r in extract(df).collect()] == [{"__html": "u", "text": LONG.strip(), "n_chars": len(LONG.strip())}]
    assert extract(df, keep=["html", "text"]).columns == ["html", "text", "n_chars"]


STORY = f"<h1>Title</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p>"
TOLD = ["Title", LONG.strip(), "Short.", LONG.strip()]


def test_pages_without_body_and_unclosed_menus():
    assert main_text(f"<html><head><title>t</title><meta charset=x><h1>Title</h1><p>{LONG}</p>") == f"Title\n\n{LONG.strip()}"
    assert main_text(f"<html><head><title>t</title></head><article>{STORY}</article></html>").split("\n\n") == TOLD
    assert main_text("<head>text in a head") == "text in a head"
    for tag in ("nav", "aside", "header", "footer", "menu"):
        for inner in (f"<article>{STORY}</article>", f"<div>{STORY}</div>"):
            links = '<ul><li><a href="/">Home</a></li><li><a href="/b">Other pages</a></li></ul>'
            assert main_text(f"<body><{tag}>{links}{inner}<footer><p>{LONG}</p></footer></body>").split("\n\n") == TOLD, (tag, inner)
    assert main_text(f"<nav><h1>Menu</h1><p>{LONG}</p></nav>") == ""
    assert main_text(page(f"<aside><article>{STORY}{STORY}</article></aside><div>{STORY}</div>")).split("\n\n") == TOLD


def test_forms_around_pages_of_divs():
    assert main_text(f"<form action='/'><div>{LONG}</div><div>{LONG}</div><input></form>") == f"{LONG.strip()}\n\n{LONG.strip()}"
    assert main_text("<form><div>Name</div><input><div>Mail</div><input></form>") == ""


def test_lead_and_tail_beside_the_body():
    story = f"<div class='story'><div class='lead'><p>{LONG}</p></div><div class='text'>{f'<p>{LONG}</p>' * 8}</div><div class='last'><p>{LONG}</p></div></div>"
    assert main_text(page(f"<div class='layout'>{story}</div>")).split("\n\n") == [LONG.strip()] * 10


def test_linked_paragraphs_stay():
    story = f"<h1>Title</h1><p>{LONG}</p><p><a href='/x'>This paragraph is a link</a></p><p>{LONG}</p>"
    for around in ("div", "article"):
        assert main_text(page(f"<{around}>{story}</{around}>")).split("\n\n") == ["Title", LONG.strip(), "This paragraph is a link", LONG.strip()]


def test_class_words_do_not_decide_within_the_cluster():
    odd = f"<div class='social-history'><p>{LONG}</p></div><p class='notice-period'>The period of notice.</p><table id='related-parties'><tr><td>Parties</td><td>Sums</td></tr></table>"
    for around in ("div", "article"):
        got = main_text(page(f"<{around}><h1>Title</h1><p>{LONG}</p>{odd}<p>{LONG}</p></{around}>")).split("\n\n")
        assert got == ["Title", LONG.strip(), LONG.strip(), "The period of notice.", "Parties", "Sums", LONG.strip()], around
    outside = f"<div class='promo-carousel'><p>{LONG}</p></div>"
    for around in ("div", "article"):
        assert main_text(page(f"{outside}<{around}>{STORY}</{around}>{outside}")).split("\n\n") == TOLD


def test_rows_of_links_and_copyright_lines_go():
    share = "<div>Share: <a href='/f'>Facebook</a> <a href='/t'>Twitter</a></div>"
    after = "<div><a href='/n'>Next article</a></div>"
    for around in ("div", "article"):
        for end in (share + after, share, "<p>&copy; 2020 Someone</p>", "<p>Copyright 2020 Someone. All rights reserved.</p>"):
            assert main_text(page(f"<{around}>{STORY}{end}</{around}>")).split("\n\n") == TOLD, (around, end)
    listed = f"<article>{STORY}<ul><li><a href='/1'>One source</a></li></ul><p>Copyright law is old.</p></article>"
    assert main_text(page(listed)).split("\n\n") == [*TOLD, "One source", "Copyright law is old."]
