"""What names tell on pages without a wrapper, and markup that a page's text must survive."""

import pytest

from quillbank.llm.wrapper_induction import extract_main_text, main_text

BODY = "<p>" + "One sentence of the story, which is long enough to be its body. " * 4 + "</p>"
TEXT = ("One sentence of the story, which is long enough to be its body. " * 4).strip()


@pytest.mark.parametrize(
    "extra",
    [
        '<div class="main-nav"><a href="/">Home</a> <a href="/b">News</a></div>', '<div class="page-notice">We moved.</div>', '<div class="site-footer">(c) us</div>', '<div id="left-sidebar"><p>Most read</p></div>',
        "<div hidden>unseen</div>", '<div class="x" style="color:red; display: none">unseen</div>', '<p hidden="">unseen</p>', "<!-->", "<!--->", "<!-- a > b -->", '<div class="top-menu"><ul><li>One</li></ul></div>',
    ],
)
def test_pages_without_a_wrapper(extra):
    for page in (f"<body>{extra}{BODY}</body>", f"<body>{BODY}{extra}</body>", f"<body><div>{extra}</div>{BODY}</body>"):
        assert main_text(page) == TEXT


def test_adverts_inside_a_line_go():
    page = '<body><p>Before <span class="advert">Buy <span>this</span> now</span> after.</p><p><span class="sponsored">Open to the end</p>' + BODY + "</body>"
    assert main_text(page) == "Before after.\n" + TEXT
    assert main_text('<p>a <span class="x">b</span> <em class="note">c</em> <br class="ad">d</p>') == "a b c d"


@pytest.mark.parametrize(
    "page",
    [
        f'<body class="no-sidebar">{BODY}</body>', f'<body><div id="content" class="with-sidebar">{BODY}</div></body>', f'<body><article class="post comments-open">{BODY}</article></body>', f'<body><div class="story-banner">{BODY}</div></body>',
        f'<body><div class="site-menu"><main>{BODY}</main></div></body>', f'<body><div class="big-alert">{BODY}</div></body>', f'<body><div data-x="hidden" class="hidden-gem">{BODY}</div></body>',
    ],
)
def test_names_that_drop_nothing(page):
    assert main_text(page) == TEXT


def test_headings_in_articles_stay():
    page = f'<body><article><div class="article-header"><h1>Title</h1></div><div class="page-header"><h2>More</h2></div>{BODY}</article></body>'
    assert main_text(page) == f"Title\nMore\n{TEXT}"


def test_small_hosts_through_spark(spark):
    html = f'<body><div class="main-nav">Home News</div>{BODY}<div class="site-footer">(c) us</div></body>'
    rows = [(i, f"http://h{i % 2}.x/{i}", html) for i in range(4)] + [(9, None, None)]
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {**{i: (TEXT, len(TEXT)) for i in range(4)}, 9: ("", 0)}
