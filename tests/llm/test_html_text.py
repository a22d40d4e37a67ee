import html
import re

from lodestone.llm.html_text import extract, main_text


def by_tags(page):
    """The article's text where pages mark it plainly."""
    inner = page.split("<article>", 1)[1].split("</article>")[0]
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_pages_match_a_plain_reading(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in extract(pages).collect():
        assert r.text == by_tags(r.html)


LONG = "The quick brown fox jumps over the lazy dog, again and again, until the sun goes down behind the hills. " * 2


def test_article_parts_that_are_left_out():
    page = f"""<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script><style>p{{}}</style></head><body>
    <header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div>
    <article><h1>Head &amp; tail</h1><p>Short.<p>{LONG}<!-- hidden <p>x</p> --> <b>bo</b>ld
     x&lt;y <a href="#">link</a></p><aside>Related</aside><div id="comments"><p>First!</p></div><form><label>Mail</label></form><p>End.</p></article>
    <footer>&copy; all</footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Head & tail", "Short.", f"{LONG.strip()} bold x<y link", "End."]


def test_line_blocks_without_semantic_tags():
    menu = "".join(f'<div><a href="/{k}">Item {k}</a></div>' for k in range(9))
    page = f"<body>{menu}<div><p>Hi.</p><p>{LONG}</p><p>See <a href=x>this</a> for more of it.</p><p>Bye.</p></div>{menu}<div class='sidebar'>{LONG}</div><div>All rights</div></body>"
    assert main_text(page).split("\n\n") == ["Hi.", LONG.strip(), "See this for more of it.", "Bye."]


def test_edges(spark):
    assert main_text(None) == main_text("") == main_text("<nav>a</nav>") == main_text("<script>x") == ""
    assert main_text("just text") == "just text"
    assert main_text("<p>a &am") == "a &am" and main_text("<article><p>cut <b>of") == "cut of" and main_text("<p>x<div cla") == "x"
    assert main_text("</div></p>a<br>b&nbsp;c") == "a b c"
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    assert main_text(deep) == "x"
    rows = [(1, None, "old"), (2, "", "old"), (2, "", "old"), (None, "<p>é</p>", None), (3, "<p>" + "word " * 200000, None)]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = extract(df).collect()
    assert len(got) == 5 and [r.text for r in got[:4]] == ["", "", "", "é"] and len(got[4].text) == 999999
    assert extract(spark.createDataFrame([], df.schema)).count() == 0


def test_article_teasers_beside_a_story():
    story = "".join(f"<p>Paragraph {k}. {LONG}</p>" for k in range(12))
    teasers = "<article><h3>Other story</h3></article><article><h3>Third story</h3></article>"
    want = [f"Paragraph {k}. {LONG.strip()}" for k in range(12)]
    for page in (f"<body><div>{story}</div>{teasers}</body>", f"<body>{teasers}<div>{story}</div></body>", f"<div>{story[: len(story) // 2]}{story[len(story) // 2 :]}</div><main>{teasers}</main>"):
        assert main_text(page).split("\n\n") == want
    split = f"<div><p>{LONG}</p><article><h3>Other story</h3></article><p>Last words.</p></div>"
    assert main_text(split).split("\n\n") == [LONG.strip(), "Last words."]


def test_surge_and_dive_choose_lines_of_an_article():
    menu = "".join(f'<p><a href="/{k}">Item number {k}</a></p>' for k in range(5))
    page = f"<article><h1>Head</h1><p><a href=x>The source</a></p><p>{LONG}</p>{menu}<p>Short end.</p>{menu}</article>"
    assert main_text(page).split("\n\n") == ["Head", "The source", LONG.strip(), "Short end."]


def test_paragraphs_that_a_removed_element_splits_off():
    last = "A last paragraph of the story that comes after an advert and has some 85 characters."
    page = f"<body><div><p>First.</p><div class=ad>Buy</div><p>{LONG}</p><div class=ad>Buy</div><p>{last}</p><div class=ad>Buy</div><p>End.</p></div><div class=sidebar>x</div><div>All rights</div></body>"
    assert main_text(page).split("\n\n") == ["First.", LONG.strip(), last, "End."]


def test_marked_blocks_of_an_article():
    table = "<table class='widget'><tr><td>Widgets made in the first year of the works</td><td>A thousand and one of them</td></tr></table>"
    share = "<div class=share><a href=a>Share this page with all of your friends and family</a></div><ul class=social><li>Tweet<li>Mail</ul>"
    page = f"<article><p>{LONG}</p><p class='social'>Social history of the town in those years.</p>{table}{share}<p>See <span class=search>the search</span> for it.</p><div class=ads>{LONG}</div></article>"
    assert main_text(page).split("\n\n") == [LONG.strip(), "Social history of the town in those years.", "Widgets made in the first year of the works", "A thousand and one of them", "See the search for it."]


def test_hostile_pages_take_time_in_proportion():
    import time

    pages = ["<a b " * 200_000, "<div>" * 60_000 + "</p></x>" * 60_000, "<p title=\"a>one</p>" * 50_000, "<!--" * 200_000, "<script>" * 100_000, "'\"<p '\">" * 100_000]
    for page in pages:
        began = time.perf_counter()
        main_text(page)
        assert time.perf_counter() - began < 6


def test_unclosed_quotes_and_the_articles_heading():
    assert main_text('<article><p title="a>one of these</p><p>two of these</p></article>') == "one of these\n\ntwo of these"
    text = "Words of the article that follow here and there, and more of them. " * 4
    page = f'<article><div class="entry-header"><h1>Title</h1></div><p>{text}</p><div class="share-header">Share</div><p>{text}</p></article>'
    assert main_text(page).startswith("Title\n\n") and "Share" not in main_text(page)
    assert main_text('<p alt="x > y">kept</p><img alt="a > b">') == "kept"


FOOT = "<div><a href=/a>About</a></div><div><a href=/b>Jobs</a></div><div><a href=/c>Help</a></div><div>All rights</div>"
STORY = f"<h1>Head</h1><p>{LONG}</p><p>Short end.</p>"
WANT = ["Head", LONG.strip(), "Short end."]


def test_wrappers_that_hold_the_article():
    for tag in ('div class="story related-page"', 'div class="page-with-sidebar"', 'form id="aspnetForm"', 'div class="no-comments single"', "header", "aside", 'section role="complementary"'):
        name = tag.split()[0]
        assert main_text(f"<body><{tag}>{STORY}</{name}>{FOOT}</body>").split("\n\n") == WANT, tag
        assert main_text(f"<body><nav>Menu</nav><main><{tag}>{STORY}<div class=comments><p>{LONG}</p><p>{LONG}</p></div></{name}></main>{FOOT}</body>").split("\n\n") == WANT, tag
    both = f'<form id="f"><div class="page-with-sidebar">{STORY}</div><div class="sidebar">Ads here.</div></form>'
    assert main_text(both).split("\n\n") == WANT


def test_long_elements_that_hold_no_article():
    few = f"<article><p>{LONG}</p></article>"
    for other in ("<div class=comments>", "<div id=disqus>", "<div class='cookie consent'>", "<div class=sidebar>", "<aside>"):
        end = "</aside>" if other == "<aside>" else "</div>"
        assert main_text(f"{few}{other}{f'<p>{LONG}</p>' * 2}{end}") == LONG.strip(), other
    assert main_text(f"<div><p>{LONG}</p></div><div class=comments>{f'<p>{LONG}</p>' * 9}</div>") == LONG.strip()
    assert main_text(f"<div class=comments><p>{LONG}</p></div>") == ""
    assert main_text(f"<nav>{LONG}</nav>") == main_text(f"<div hidden><h1>x</h1>{LONG}</div>") == ""


def test_short_parts_of_a_text():
    links = "".join(f"<div><a href=/{k}>Item {k}</a></div>" for k in range(4))
    assert main_text(f"<body><div><p>{LONG}</p>{links}<p>Last words.</p></div>{FOOT}</body>").split("\n\n") == [LONG.strip(), "Last words."]
    assert main_text(f"<body><div><h1>Head</h1></div><nav>Menu</nav><div><p>{LONG}</p></div>{FOOT}</body>").split("\n\n") == ["Head", LONG.strip()]
    assert main_text(f"<body><div><p>{LONG}</p></div><aside>Other</aside><div><p>Last words of it.</p></div>{FOOT}</body>").split("\n\n") == [LONG.strip(), "Last words of it."]
    assert main_text(f"<body><div><p>{LONG}</p></div><aside>Other</aside><div>© 2020 The Company. All rights reserved.</div></body>") == LONG.strip()


def test_links_that_belong_to_the_article():
    cited = "".join(f"<li><a href=/{k}>Work {k}</a></li>" for k in range(4))
    works = [f"Work {k}" for k in range(4)]
    assert main_text(f"<article><p>{LONG}</p><h2>References</h2><ul>{cited}</ul></article>").split("\n\n") == [LONG.strip(), "References", *works]
    long = "".join(f"<li><a href=/{k}>A longer title of the work with number {k}</a></li>" for k in range(4))
    assert main_text(f"<article><p>{LONG}</p><ol>{long}</ol><p>End.</p></article>").count("A longer title") == 4
    assert main_text(f"<article><p><a href=x>{LONG}</a></p><p><a href=y>{LONG}</a></p></article>").split("\n\n") == [LONG.strip()] * 2
    assert main_text(f"<article><p>{LONG}</p><p class=comment>So much for that.</p></article>").split("\n\n")[0] == LONG.strip()
    note = "The author adds that nothing of this is certain as yet."
    assert note in main_text(f"<article><p>{LONG}</p><p class=comment>{note}</p></article>")


def test_depth_and_marked_inline_elements():
    for depth in (3, 70, 500):
        page = "<div>" * depth + f"<div><p>{LONG}</p><div class=ad>Buy</div><p>End.</p></div><div class=ad>Buy</div><div>All rights</div>" + "</div>" * depth
        assert main_text(page).split("\n\n") == [LONG.strip(), "End."]
    assert main_text(f"<p>{LONG}</p><p><span class=ad>Buy <span>now</span></span> the text goes on here for a while.</p>").split("\n\n") == [LONG.strip(), "the text goes on here for a while."]
    import time

    deep = "".join(f"<div><p>a{k}</p><nav></nav>" for k in range(20_000)) + "<p>end</p></div>" * 20_000
    began = time.perf_counter()
    main_text(deep)
    assert time.perf_counter() - began < 6
